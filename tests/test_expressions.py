import pytest

from tidemark.functions.catalog import ALIASES, CATALOG, resolve
from tidemark.plans.compiler import evaluate
from tidemark.plans.expr import Call, ExpressionError, Name, Number, names, parse
from tidemark.plans.frame import IntervalFrame


def test_catalogue_is_whole():
    assert len(CATALOG) == 190 and [o.number for o in CATALOG.values()] == list(range(1, 191))
    assert len(ALIASES) == 37 and all(a in CATALOG for a in ALIASES.values())
    assert resolve("var").name == "variance" and resolve("std").accepts(2) and not resolve("std").accepts(3)


def test_power_binds_tighter_than_a_sign():
    assert parse("-x ** 2") == Call("negate", (Call("power", (Name("x"), Number(2.0))),))
    assert parse("2 ** -3 ** 2") == Call("power", (Number(2.0), Call("negate", (Call("power", (Number(3.0), Number(2.0))),))))


def test_precedence_and_comments():
    assert parse("1 + 2 * x # note") == Call("add", (Number(1.0), Call("multiply", (Number(2.0), Name("x")))))
    assert names(parse("mean(a) + b")) == {"a", "b"}


@pytest.mark.parametrize("bad", ["1 < 2 < 3", "x.y", "f(", "True", "a and b", "'s'", "f(x=1)", "", "1 +", "(" * 200 + "1" + ")" * 200])
def test_rejected(bad):
    with pytest.raises(ExpressionError):
        parse(bad)


@pytest.fixture
def frame(spark):
    rows = [(1, i, float(v), v > 2) for i, v in enumerate([1, 3, 2, 4])] + [(2, 0, float("nan"), True), (2, 1, 5.0, False)]
    return IntervalFrame(spark.createDataFrame(rows, "p int, pos long, x double, m boolean"), ("p",))


def one(df):
    return {r["p"]: r for r in df.collect()}


def test_equal_subexpressions_are_one_node(frame):
    from tidemark.plans.compiler import Plan

    plan = Plan(frame, {"x", "m"})
    assert plan.node(parse("mean(x)")) is plan.node(parse("sequence_mean(x)"))


def test_unknown_names_and_arity(frame):
    for e in ("nope(x)", "y + 1", "mean(x, x, x)", "lag(x) + x", "linear_fit(x)"):
        with pytest.raises(ExpressionError):
            evaluate(frame, e)


def test_failures_raise_or_isolate(frame):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        evaluate(frame, "1 / (length(x) - length(x))").collect()
    got = one(evaluate(frame, {"bad": "1 / (length(x) - length(x))", "fine": "length(x)", "few": "skewness(x)"}, error_policy="isolate"))
    assert got[1]["bad_status"] == 2 and got[1]["fine"] == 4 and got[1]["fine_status"] == 0
    assert got[2]["few_status"] == 4


def test_status_follows_an_untaken_branch(frame):
    got = one(evaluate(frame, {"r": "where(length(x) > 0, 1, 1 / (length(x) - length(x)))"}, error_policy="isolate"))
    assert got[1]["r_status"] == 2


def test_missing_values_are_unordered(frame):
    rows = evaluate(frame, {"lt": "x < 3", "ne": "x != x", "lo": "minimum(x, 2)", "hi": "maximum(2, x)"}).where("p = 2 AND pos = 0").first()
    assert rows.lt is False and rows.ne is True and rows.lo != rows.lo and rows.hi == 2.0


def test_filter_apply_renumbers(frame):
    got = one(evaluate(frame, {"s": "filter_apply(linear_slope(x), m, 9)", "e": "filter_apply(mean(x), x > 100, 9)"}, error_policy="isolate"))
    assert got[1].s == pytest.approx(1.0)  # 3, 4 at positions 0, 1
    assert (got[2].s_status, got[1].e, got[1].e_status) == (4, 9.0, 0)
    assert one(evaluate(frame, {"e": "filter_apply(linear_slope(x), x > 100, 9)"}))[1].e == 9.0


def test_block_and_empty(spark, frame):
    from tidemark.plans.scopes import block_apply

    assert [r.m for r in block_apply(frame, {"m": "mean(x)"}, 2).where("p = 1").orderBy("pos").collect()] == [2.0, 3.0]
    empty = IntervalFrame(frame.data.where("false"), ("p",))
    assert evaluate(empty, {"m": "mean(x)", "d": "drawdown_series(x)"}).count() == 0


def test_minimum_observations_and_bindings(frame):
    got = one(evaluate(frame, {"r": "2 * b"}, error_policy="isolate", bindings={"a": "mean(x)", "b": "a + 1"}, minimum_observations=3))
    assert (got[1].r, got[1].r_status, got[2].r_status) == (7.0, 0, 1) and got[2].r != got[2].r
    with pytest.raises(Exception, match="INSUFFICIENT_OBSERVATIONS"):
        evaluate(frame, "first(x)", minimum_observations=3).collect()
    with pytest.raises(ExpressionError):
        evaluate(frame, "a", bindings={"a": "a + 1"})


def test_tail_is_one_shorter(frame):
    assert one(evaluate(frame, {"n": "length(interval_tail(x))", "s": "sum(interval_tail(x) - lag(x))"}))[1].asDict() == {"p": 1, "n": 3.0, "s": 3.0}


def test_every_operator_is_there(spark, frame):
    from pyspark.sql import functions as F

    from tidemark.operators import registry

    assert registry.missing() == []
    assert frame.data.where("p = 1").select(registry.call("mul", F.col("x"), F.lit(2.0)).alias("y")).agg(F.sum("y")).first()[0] == 20.0
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i long, j long, v double")
    assert registry.call("trace", m).first().v == 1.0
    with pytest.raises(TypeError):
        registry.call("lag", F.col("x"))
