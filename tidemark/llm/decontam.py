"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions only.

An item window (``window`` consecutive item words; a shorter item is one window)
is found in a document when its words stand there consecutively.  Each window
is a set of positioned word shingles, ordered by rarity in the documents
(counted over all of them).  Containment must be complete, so the necessary
prefix is one shingle: the window's rarest.  Documents are joined on that one,
kept by the length bound (the window fits into the document) and the positional
bound (the shingle's place fixes the window's start), and verified word by word.

Only item windows and their shingles are broadcast, in slices of about ``slice_bytes`` bytes that are counted beforehand; a
larger benchmark takes several passes instead of a larger broadcast.  Rows fall to slices by a hash of the
window, so that a prefix shared by many windows is spread as well.

Defined cases: null or word-less text has no words and no hits; items without
words have no windows; null item ids count as no item, though their windows still hit; an empty benchmark leaves every document
clean; rows with one id, or null ids, are judged each and give a result row each; ties for the rarest shingle go to
the smaller key, then the earlier place; texts of any length are split into words whole, in the memory of a task;
columns other than the ids and texts are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALL_DOCS = -(2**63) + 11
#: bytes of a broadcast key beside texts
KEY_BYTES = 80


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds an array column of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of ``text``, A-Z lower-cased."""
    t = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    raw = F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), NON_WORD)
    lead = F.when(F.get("_raw", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("_raw") > 1) & (F.element_at("_raw", -1) == ""), 1).otherwise(0)
    return (
        df.withColumn("_raw", raw)
        .withColumn(out, F.slice("_raw", lead + 1, F.size("_raw") - lead - tail))
        .drop("_raw")
    )


def _key(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def _item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: win, ids (the items that hold it)."""
    w = with_words(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("_text")), "_text", "words")
    w = w.where(F.size("words") > 0).select(
        "item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("s")
    )
    return (
        w.select("item", F.slice("words", F.col("s") + 1, window).alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("ids"))
    )


def _shingles(windows: DataFrame, size: int) -> DataFrame:
    """win, ids, off, key: the shingles of windows of at least ``size`` words."""
    return windows.select(
        "win", "ids", F.explode(F.sequence(F.lit(0), F.size("win") - size)).alias("off")
    ).select("win", "ids", "off", _key("win", F.col("off"), size).alias("key"))


def _places(docs: DataFrame, sizes: list[int], marker: bool) -> DataFrame:
    """A row for each document place and shingle size: uid, doc, words, n, p, key.

    With ``marker`` a row at p = -1 with the key ALL_DOCS stands for the document itself.
    """
    p = docs.select("*", F.explode(F.sequence(F.lit(-1 if marker else 0), F.col("n"))).alias("p"))
    fits = [F.when((F.col("p") >= 0) & (F.col("p") + s <= F.col("n")), _key("words", F.col("p"), s)) for s in sizes]
    mark = F.when(F.col("p") < 0, F.lit(ALL_DOCS))
    if len(sizes) == 1:
        return p.withColumn("key", F.coalesce(mark, fits[0]))
    return p.withColumn("key", F.explode(F.array_distinct(F.array(*[F.coalesce(mark, f) for f in fits]))))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 5,
    slice_bytes: int = 32 << 20,
    carried: Column | None = None,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted ids).  ``carried`` stands in the place of doc_id if given."""
    spark = docs.sparkSession
    windows, windows_path = materialize(_item_windows(items, item_id, item_text, window), "item-windows")
    lengths = {r[0]: r[1] for r in windows.groupBy(F.size("win").alias("n")).count().collect()}
    sizes = sorted({min(shingle, n) for n in lengths}) or [shingle]
    n_keys = sum(c * (n - min(shingle, n) + 1) for n, c in lengths.items())
    slices = max(1, -(-n_keys * KEY_BYTES // slice_bytes))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), (F.col(doc_id) if carried is None else carried).alias("_doc"), F.col(text).alias("_text"))
    if slices > 1:  # row numbers that several passes share
        src, _ = materialize(src, "documents")
    base = with_words(src, "_text", "words").withColumn("n", F.size("words"))

    def shingles_of() -> DataFrame:
        parts = []
        for s in sizes:
            held = windows.where(F.size("win") == s) if s < shingle else windows.where(F.size("win") >= shingle)
            parts.append(_shingles(held, s))
        return reduce(DataFrame.union, parts)

    # rarity of every item shingle over all documents
    rarity = None
    if n_keys:
        all_keys = shingles_of().select("key").distinct()
        lean = base.select("words", "n")
        for i in range(slices):
            part = all_keys.where(F.pmod("key", F.lit(slices)) == i)
            hit = _places(lean, sizes, False).select("key").join(F.broadcast(part), "key", "left_semi")
            c = hit.groupBy("key").agg(F.count("*").alias("freq"))
            rarity = c if rarity is None else rarity.union(c)
        # necessary prefix: the rarest shingle; a window with a shingle that stands nowhere can't occur
        ranked = (
            shingles_of()
            .join(rarity, "key", "left")
            .groupBy("win", "ids")
            .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "off")).alias("r"))
            .where("r.freq > 0")
            .select("win", "ids", F.col("r.off").alias("off"), F.col("r.key").alias("key"))
        )
        ranked, _ = materialize(ranked, "windows")
        lengths = [F.octet_length(F.concat_ws(" ", c)) + 24 * F.size(c) for c in ("win", "ids")]
        probe_bytes = ranked.agg(F.sum(lengths[0] + lengths[1] + KEY_BYTES)).first()[0] or 0
    else:
        ranked, probe_bytes = None, 0
    release(spark, windows_path)
    mark = spark.range(1).select(
        F.array().cast("array<string>").alias("win"),
        F.array().cast("array<string>").alias("ids"),
        F.lit(0).alias("off"),
        F.lit(ALL_DOCS).cast("long").alias("key"),
    )
    start, size = F.col("p") - F.col("off"), F.size("win")
    found = (
        (F.col("p") >= 0) & (size > 0) & (start >= 0) & (start + size <= F.col("n"))
        & (F.slice("words", F.greatest(start, F.lit(0)) + 1, size) == F.col("win"))
    )
    matches = None
    slices = max(1, -(-probe_bytes // slice_bytes))
    for i in range(slices):
        probe = mark if i == 0 else None
        if ranked is not None:
            part = ranked.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == i)
            probe = part if probe is None else probe.union(part)
        m = (
            _places(base, sizes, i == 0)
            .join(F.broadcast(probe), "key")
            .where(((F.col("p") < 0) & (size == 0)) | found)
            .select(
                "uid", "_doc", "n", start.alias("s"), (start + size).alias("e"), "ids",
            )
        )
        matches = m if matches is None else matches.union(m)
    w = Window.partitionBy("uid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(w), F.lit(0))))
    out = (
        matches.withColumn("c", covered)
        .groupBy("uid")
        .agg(
            F.first("_doc").alias("doc_id"),
            F.first("n").cast("long").alias("n_words"),
            F.sum("c").cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        )
    )
    return out.drop("uid")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no item window stands, with all their columns.

    Rows are told apart by id and two hashes of the text, so a hit row takes no clean one of the same id, or of none, with it.
    """
    key = {"_d": F.col(doc_id), "_h": F.xxhash64(text), "_k": F.xxhash64(F.lit(1), F.col(text))}
    carried = F.struct(*[c.alias(k) for k, c in key.items()])
    found = decontaminate(docs, items, doc_id=doc_id, text=text, carried=carried, **options).where("n_hit > 0")
    gone, _ = materialize(found.select("doc_id.*").distinct().toDF("_d", "_h", "_k"), "contaminated")
    same = docs[doc_id].eqNullSafe(gone["_d"]) & (F.xxhash64(docs[text]) == gone["_h"]) & (F.xxhash64(F.lit(1), docs[text]) == gone["_k"])
    return docs.join(bounded(gone, gone.count(), KEY_BYTES), same, "left_anti")
