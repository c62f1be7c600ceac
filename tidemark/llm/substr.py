"""Substring dedup: words that an earlier passage of at least ``window`` words already holds.

The reference is the corpus itself, so an automaton of all of it can't be broadcast under any bound.
Reference shards are cut by content instead, and automaton and passages meet in one task:

1. A window of 20 words selects its minimizer, the smallest hash of its 4-word grams
   (the first of equals).  Equal windows select equal grams at equal places.  Gram
   hashes are counted, pre-aggregated by batch and task.
2. The hashes that occur more than once go into a Bloom filter of at most
   ``bloom_bits`` bits; such filters are the only thing that is broadcast.  A full filter
   only lets more passages through; results don't depend on it.
3. Documents are streamed again.  The consecutive windows of one minimizer that
   may be repeated form a passage (20 to 36 words) and go to the task of that minimizer.  Equal passages meet within the map task
   first: all but the earliest are removed there, so that a task sends each passage once, however often it stands there.
   A minimizer that occurs over ``hot`` times (a second filter) is split: its windows go one by one, each under its own
   hash, so that a passage in a third of all documents, in however many variants, is spread over tasks.
4. For each minimizer a suffix automaton of its distinct passages is built (the shard), and
   the passages are streamed through it.  The state of each place's longest match,
   cut to 20 words, names the window exactly; the earliest start of each state stays, later ones are removed.
5. Removed spans are gathered per document and applied to the whole text.

Windows are judged on the input.  "Earlier" is a smaller id, or an earlier start in the same document.

Defined cases: null and empty texts have no words; documents shorter than a window lose nothing;
null ids count as the largest; rows with one id are one document in the order (a window isn't earlier than
itself, so equal rows with equal ids keep their words) and are otherwise handled each;
an empty table gives no rows; other columns are kept by ``dedup_text`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.common import materialize, texts, worker_cache

LAST = 2**63 - 1
SLICES = 64
PROBES = 4
FLUSH = 150_000
WORDS_AT_ONCE = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = h
        return h


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def minimizers(docs: list[list[bytes]], window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the documents: (document, first window, last window, gram hash) of each minimizer's run of windows."""
    at = 0
    while at < len(docs):
        end, total = at, 0
        while end < len(docs) and (end == at or total + len(docs[end]) <= WORDS_AT_ONCE):
            total += len(docs[end])
            end += 1
        own = [(i, w) for i, w in enumerate(docs[at:end], at) if len(w) >= window]
        if own:
            get = worker_cache("words", WordHashes).__getitem__
            sizes = np.array([len(w) for _, w in own])
            h = np.fromiter((x for _, w in own for x in map(get, w)), np.uint64, int(sizes.sum()))
            g, width = h, 1
            while width < gram:  # a gram has a power of two of words
                g = _mix(g[:-width] * np.uint64(0xD6E8FEB86659FD93) + g[width:])
                width *= 2
            per = window - gram + 1
            m, width = g, 1
            while width * 2 <= per:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            if width < per:
                m = np.minimum(m[: len(m) - (per - width)], m[per - width :])
            n = len(m)
            place = np.full(n, -1, np.int64)
            for o in range(per - 1, -1, -1):
                place[g[o : o + n] == m] = o
            place += np.arange(n)
            starts = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(own)), sizes)
            valid = np.arange(n) - starts[doc[:n]] + window <= sizes[doc[:n]]
            first = valid.copy()
            first[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]))
            lo = np.flatnonzero(first)
            last = valid.copy()
            last[:-1] &= ~(valid[1:] & (place[1:] == place[:-1]))
            hi = np.flatnonzero(last)
            d = doc[lo]
            yield np.array([i for i, _ in own])[d], lo - starts[d], hi - starts[d], g[place[lo]]
        at = end


def _bits(h: np.ndarray, slice_bits: int) -> Iterator[np.ndarray]:
    x = h
    for _ in range(PROBES):
        x = _mix(x + np.uint64(0x632BE59BD9B4E019))
        yield (x & np.uint64(slice_bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, slices: dict[int, bytes], slice_bits: int) -> None:
        self.slice_bits = slice_bits
        self.bits = np.zeros(SLICES * slice_bits // 8, np.uint8)
        for i, b in slices.items():
            self.bits[i * slice_bits // 8 : (i + 1) * slice_bits // 8] = np.frombuffer(b, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        base = (h & np.uint64(SLICES - 1)).astype(np.int64) * self.slice_bits
        out = np.ones(len(h), bool)
        for x in _bits(h, self.slice_bits):
            at = base + x
            out &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return out


def bloom_of(hashes: DataFrame, bloom_bits: int) -> Bloom:
    """A filter of the column h; its slices are built apart and only they come to the driver."""
    n = hashes.count()
    slice_bits = 1 << max(13, min(bloom_bits // SLICES, 16 * n // SLICES + 1).bit_length() - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            part = (h & np.uint64(SLICES - 1)).astype(np.int64)  # low bits: the high ones of a minimum are small
            for i in np.unique(part):
                bits = own.setdefault(int(i), np.zeros(slice_bits, bool))
                for x in _bits(h[part == i], slice_bits):
                    bits[x] = True
        for i, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["i", "bits"])

    by_slice = hashes.repartition(min(SLICES, max(1, n // 500_000)), F.col("h").bitwiseAND(F.lit(SLICES - 1)))
    return Bloom({r.i: bytes(r.bits) for r in by_slice.mapInArrow(build, "i int, bits binary").toLocalIterator()}, slice_bits)


def repeated_grams(src: DataFrame, window: int, gram: int, bloom_bits: int, hot: int) -> tuple[Bloom, Bloom]:
    """Filters of the minimizers that occur more than once, and more than ``hot`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            for part in minimizers([(t or b"").split() for t in texts(b)], window, gram):
                h, n = np.unique(part[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])
        worker_cache("idle")

    counted = src.select("text").mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counted, _ = materialize(counted, "grams")
    return bloom_of(counted.select("h"), bloom_bits), bloom_of(counted.where(F.col("n") > hot).select("h"), bloom_bits)


SPAN = "key long, passage binary, dk long, uid long, lo int, hi int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "passage", "dk", "uid", "lo", "hi"])


def passages(bloom: Broadcast, window: int, gram: int):
    """Map side of step 3.  passage is null for a span [lo, hi] of words that is removed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int, int, int]] = {}
        gone: list[tuple] = []
        repeated, hot = bloom.value

        def candidates(words, doc, lo, hi, h):  # noqa: ANN001, ANN202
            """(document, first window, last window, key, words): passages, or single windows of a hot minimizer."""
            may = repeated.holds(h)
            doc, lo, hi, h = doc[may], lo[may], hi[may], h[may]
            for i, first, last, key, many in zip(doc.tolist(), lo.tolist(), hi.tolist(), h.view(np.int64).tolist(), hot.holds(h).tolist(), strict=True):
                if not many:
                    yield i, first, last, key, b" ".join(words[i][first : last + window])
                    continue
                for at in range(first, last + 1):
                    p = b" ".join(words[i][at : at + window])
                    yield i, at, at, xxhash.xxh64_intdigest(p, 11) - (1 << 63), p

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            if everything:
                rows = [(k, p, dk, uid, lo, hi) for p, (dk, lo, uid, hi, k) in held.items()]
                held.clear()
                for i in range(0, len(rows), 20_000):
                    yield _batch(rows[i : i + 20_000])
            if gone:
                yield _batch(gone)
                gone.clear()

        for b in few(batches):
            words = [(t or b"").split() for t in texts(b)]
            dks, uids = b.column("dk").to_pylist(), b.column("uid").to_pylist()
            for doc, lo, hi, h in minimizers(words, window, gram):
                for i, first, last, key, p in candidates(words, doc, lo, hi, h):
                    new, old = (dks[i], first, uids[i], last, key), held.get(p)
                    if old is None:
                        held[p] = new
                        continue
                    if old[:2] == new[:2]:  # rows with one id: neither is earlier
                        if old[2] != new[2]:
                            gone.append((key, p, new[0], new[2], first, last))
                        continue
                    if new < old:
                        held[p], new = new, old
                    to = new[3] + window - 1
                    if gone and gone[-1][1] is None and gone[-1][2:4] == (new[0], new[2]) and gone[-1][4] <= new[1] <= gone[-1][5] + 1:
                        gone[-1] = (*gone[-1][:5], max(to, gone[-1][5]))  # spans of one document in a row are one span
                    else:
                        gone.append((new[2], None, new[0], new[2], new[1], to))
                if len(held) > FLUSH or len(gone) > FLUSH:
                    yield from flush(len(held) > FLUSH)
        yield from flush(True)
        worker_cache("idle")  # gives memory back, the next stage may be the JVM's alone

    return run


def judge(rows: list[tuple[bytes, int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Step 4 for one minimizer: (passage, dk, uid, lo, hi) -> removed spans (dk, uid, lo, hi) of words."""
    by: dict[bytes, list[tuple[int, int, int, int]]] = {}
    for p, dk, uid, lo, hi in rows:
        by.setdefault(p, []).append((dk, lo, uid, hi))
    out, firsts = [], []
    for p, places in by.items():
        low = min(places)
        for dk, lo, uid, hi in places:
            if (dk, lo) == low[:2]:
                firsts.append((p, dk, lo, uid, hi))
            else:
                out.append((dk, uid, lo, hi + window - 1))
    if len(by) == 1:
        return out
    auto = SuffixAutomaton()
    tokens = {p: p.split(b" ") for p in by}
    for t in tokens.values():
        auto.add(t)
    states = {p: [auto.at_length(s, window) for s, n in auto.walk(t) if n >= window] for p, t in tokens.items()}
    low: dict[int, tuple[int, int]] = {}
    for p, dk, lo, _, _ in firsts:
        for j, s in enumerate(states[p]):
            if s not in low or (dk, lo + j) < low[s]:
                low[s] = (dk, lo + j)
    for p, dk, lo, uid, _ in firsts:
        begin = None
        own = states[p]
        for j in range(len(own) + 1):
            later = j < len(own) and low[own[j]] < (dk, lo + j)
            if later and begin is None:
                begin = j
            if not later and begin is not None:
                out.append((dk, uid, lo + begin, lo + j - 1 + window - 1))
                begin = None
    return out


def removed_spans(src: DataFrame, window: int, gram: int, bloom_bits: int, hot: int) -> DataFrame:
    """dk, uid, lo, hi: spans of words to remove; src has dk, uid and text."""
    bloom = src.sparkSession.sparkContext.broadcast(repeated_grams(src, window, gram, bloom_bits, hot))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, out = None, [], []

        def result() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["dk", "uid", "lo", "hi"])
            out.clear()
            return made

        for b in batches:
            for k, p, dk, uid, lo, hi in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if p is None:
                    out.append((dk, uid, lo, hi))
                    continue
                if k != key:
                    if len(run) > 1:
                        out += judge(run, window)
                    key, run = k, []
                run.append((p, dk, uid, lo, hi))
            if out:
                yield result()
        if len(run) > 1:
            out += judge(run, window)
        if out:
            yield result()

    found = src.select("text", "dk", "uid").mapInArrow(passages(bloom, window, gram), SPAN)
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(reduce, "dk long, uid long, lo int, hi int")


def kept_words(text: bytes | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all."""
    words = (text or b"").split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] + 1 for s in spans], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)], len(words)


def _with_spans(docs: DataFrame, doc_id: str, text: str, window: int, gram: int, bloom_bits: int, hot: int, columns: list[str]) -> DataFrame:
    """text, spans and the wanted columns (under the names _0, _1, ...)."""
    src = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("dk"), F.xxhash64(doc_id, text).alias("uid"), F.col(text).alias("text"),
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)],
    )
    spans = removed_spans(src, window, gram, bloom_bits, hot).groupBy("dk", "uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return src.join(spans, ["dk", "uid"], "left")


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = 4, bloom_bits: int = 1 << 29, hot: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row a document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(texts(b), b.column("spans").to_pylist(), strict=True):
                kept, n = kept_words(t, s)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("_0").cast(pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    joined = _with_spans(docs, doc_id, text, window, gram, bloom_bits, hot, [doc_id])
    return joined.select("text", "spans", "_0").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = 4, bloom_bits: int = 1 << 29, hot: int = 2000) -> DataFrame:
    """The documents with their removed words cut; a text that loses nothing stays as it is, one that loses all goes."""
    names = docs.columns

    @F.pandas_udf("string")
    def cut(t, spans):  # noqa: ANN001, ANN202
        return type(t)([x if s is None else b" ".join(kept_words(x.encode(), list(s))[0]).decode() for x, s in zip(t, spans, strict=True)])

    joined = _with_spans(docs, doc_id, text, window, gram, bloom_bits, hot, names)
    new = joined.withColumn("new", cut("text", "spans")).where("spans IS NULL OR new <> ''")
    return new.select(*[F.col("new" if c == text else f"_{i}").alias(c) for i, c in enumerate(names)])
