import numpy as np
import pytest

from tidemark.sources.tables import META, load_payload, read_table, save_payload, write_table
from tidemark.streaming import causal


def run(query):
    query.processAllAvailable()
    query.stop()


def test_stream_state_crosses_batches_and_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [[("a", "2024-01-01 00:00:01", 10.0), ("a", "2024-01-01 00:00:00", 2.0)], [("a", "2024-01-01 00:00:02", 4.0), ("a", "2023-01-01 00:00:00", 99.0)]]
    out = None
    for part in rows:
        spark.createDataFrame(part, "k string, t string, v double").selectExpr("k", "cast(t as timestamp) as t", "v").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).parquet(src)
        out = causal.apply_causal(stream, "k", "t", "v", causal.exponential(0.5))
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).start()
        run(q)
    got = [(r.value, r.out, r.dropped) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    assert [g[:2] for g in got] == [(2.0, 2.0), (10.0, 6.0), (4.0, 5.0)]


def test_steps_equal_batch_kernels():
    from tidemark.operators.kernels import state_hysteresis

    x = np.array([5.0, 60.0, 45.0, 10.0, 35.0, float("nan"), 70.0])
    step, state = causal.hysteresis(50, 40, 15, 30)
    out = []
    for v in x:
        state, y = step(state, v)
        out.append(y)
    assert out == state_hysteresis(x, 50, 40, 15, 30).tolist()
    step, state = causal.drawdown()
    state, a = step(state, 4.0)
    assert (a, step(state, 3.0)[1]) == (0.0, -0.25)


def stepped(operator, xs):
    step, state = operator
    out = []
    for v in xs:
        state, y = step(state, float(v))
        out.append(y)
    return out


def test_filters_equal_batch_kernels():
    from tidemark.operators.kernels import scalar_kalman, state_confirm
    from tidemark.operators.latent import filters_of

    r = np.random.default_rng(8)
    x = np.where(r.random(60) < 0.15, np.nan, r.normal(size=60))
    np.testing.assert_allclose(stepped(causal.kalman(0.1, 0.5, 2.0), x), scalar_kalman(x, 0.1, 0.5, 2.0)[0], rtol=1e-12)
    codes = np.repeat(r.integers(-1, 3, 150), r.integers(1, 5, 150))
    for needed, hold in ((1, 0), (1, 3), (2, 0), (2, 4), (3, 2)):
        assert stepped(causal.confirm(needed, hold), codes) == state_confirm(codes, needed, hold).tolist()
    y, m, v = r.normal(size=40), np.array([-1.0, 0.5, 1.0]), np.array([0.5, 1.0, 0.25])
    start, move = [0.5, 0.25, 0.25], [[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]]
    e = -0.5 * (np.log(2 * np.pi * v) + (y[:, None] - m) ** 2 / v)
    np.testing.assert_allclose(stepped(causal.markov(start, move, m, v, 1), y), filters_of(e[None], start, move)[0, :, 1], rtol=1e-9)


def test_windowed_metrics(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS k, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 10,0) AS t, double(id) AS v FROM range(12)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, t timestamp, v double").parquet(src)
    q = causal.windowed_metrics(stream, "k", "t", "v", "30 minutes", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").start()
    run(q)
    got = spark.sql("SELECT n, mean FROM w ORDER BY start").collect()
    assert [(r.n, r["mean"]) for r in got][:2] == [(3, 1.0), (3, 4.0)]


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_formats_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    write_table(df, str(tmp_path / kind), kind)
    assert sorted(read_table(spark, str(tmp_path / kind), kind, df.schema).collect(), key=lambda r: r.a) == df.collect()


def test_text_needs_a_schema(spark, tmp_path):
    for kind in ("csv", "json", "xml"):
        with pytest.raises(ValueError):
            read_table(spark, str(tmp_path), kind)


def test_payload_keeps_identity(spark, tmp_path):
    fields = {"w": np.array([[0.5, 0.25]]), "n": np.array([2**60], np.int64)}
    meta = dict.fromkeys(META, "x")
    own = save_payload(spark, str(tmp_path / "p"), fields, meta)
    got, m = load_payload(spark, str(tmp_path / "p"))
    assert m == meta and all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in fields.items())
    assert own != save_payload(spark, str(tmp_path / "q"), fields | {"n": np.array([1], np.int64)}, meta)
