"""The corpus pipeline on a small corpus with planted cases, against plain versions of its stages."""

import random
import re

import corpus_pipeline
import pytest

from tests.llm.test_operators import plain_dedup, plain_fingerprint, plain_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, a in {"en": "etaoinshr", "de": "enisratdüß"}.items()}
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, make(k, rng.randint(30, 200)), k) for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(6)]  # exact copies
    passage = make("en", 60)
    rows += [(200 + i, make("en", 40) + " " + passage + "\n" + make("en", 40), "en") for i in range(4)]
    item = make("de", 30)
    rows += [(300, make("de", 50) + ". " + re.sub("[a-z]", lambda m: m[0].upper(), item) + "! " + make("de", 20), "de")]
    rows += [(400, None, None), (401, "123 !!", None), (402, "Съешь же ещё этих мягких французских булок", None), (403, "", "en")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, texts = docs.columns, {i: t for i, t, _ in rows}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{path}/{name}")
            docs = spark.read.parquet(f"{path}/{name}")
            steps[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i in texts if i < 400}
    assert set(steps["language_id"]) == kept
    fps = {i: plain_fingerprint(texts[i]) for i in kept}
    first = {i for i in kept if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in kept)}
    assert set(steps["near_dedup"]) == first and not first & set(range(100, 106))
    plain = {i: w for (i, _), w in plain_dedup([(i, texts[i]) for i in sorted(first)], 20).items()}
    for i in first:
        whole = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        assert steps["substring_dedup"].get(i) == (texts[i] if plain[i] == whole else " ".join(plain[i]) or None)
    assert steps["substring_dedup"][200] == texts[200] and all(len(steps["substring_dedup"][200 + i].split()) == 80 for i in range(1, 4))
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    hit = {i for i, _, n, _ in plain_hits(list(steps["substring_dedup"].items()), [(1, item)]) if n}
    assert hit == {300} and set(steps["decontamination"]) == set(steps["substring_dedup"]) - hit
    assert {r.doc_id for r in docs.collect()} == set(steps["decontamination"])


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in spark.read.parquet(f"{path}/decontamination").select("doc_id").collect()}
    full = out.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_judge_rows_not_ids(spark, tmp_path):
    """Null ids, ids that stand twice, equal rows, ties, long texts and extra columns go through every stage."""
    rng = random.Random(77)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, copy, long, front = make(30), make(80), make(60_000), make(50)
    rows = [(i, make(60), "en") for i in range(40)]
    rows += [(None, front + " " + item, "en"), (None, make(70), None), (50, make(40) + " " + item, "en"), (50, make(90), "en"), (51, copy, "en"), (51, copy, "en"), (None, copy, "en"), (52, long, "en"), (53, None, None), (53, "", "en")]
    schema = SCHEMA + ", uid string, spans int, _gone int, key long, new string, fp long"
    docs = spark.createDataFrame([(i, t, k, "s", 1, "u", 1, 2, 3, "n", 4) for i, t, k in rows], schema).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    clean = sorted(t for i, t, _ in rows if t and item not in t and t != copy)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()) == sorted([*clean, copy, front])  # the row without an id lost the item's words to the earlier one of id 50, and is clean
    assert spark.read.parquet(f"{tmp_path}/near_dedup").where("doc_id = 51").count() == 1
    assert {r.doc_id for r in docs.collect()} == {*range(40), None, 50, 51, 52}


def test_run_deletes_what_it_no_longer_needs(spark, folder):
    import os

    from tidemark.llm import common

    path, _ = folder
    before = set(common.made)
    out = corpus_pipeline.run(spark, path)
    left = [p for p in common.made if p not in before]
    assert len(left) == 1 and os.path.isdir(left[0].removeprefix("file:").replace("//", "/")) and out.count() > 0
