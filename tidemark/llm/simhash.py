"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit set where over half of the hashes of its word shingles have it.
Anchors are the words of a covering code on the 64 bits: the direct sum of two binary Golay
codes (23 bits, covering radius 3), a Hamming code (7 bits, radius 1) and the zero word on the
other 11 bits (radius 11, never a constraint).  If two fingerprints differ in at most
2t bits, some point lies within t bits of both, and its anchor lies within the
covering radius plus t of both, block by block.  So each distinct fingerprint is replicated to every anchor
within radius plus t (spread over the blocks) and only fingerprints at a common anchor are compared.
No pair is missed.  With many fingerprints the 11 free bits get a code as well (another Hamming code and four bits as they are),
so that an anchor holds few that are not near; either code finds every pair.

Hot groups.  Equal fingerprints count once, with the smallest id.  At an anchor, fingerprints
come sorted and are searched breadth first from seeds over those not yet reached, so
a large group of near copies gives a tree of links and not all its pairs.  Anchors that hold over about ``block`` fingerprints
are found in a sample of one in ``SHARE`` and cut into blocks, and a task gets two blocks: every two fingerprints of the anchor
still meet in one.  The sample decides on the cut alone; compared are all.

Defined cases: null, empty and word-less texts have fingerprint zero and link like any other; fewer words
than a shingle make one shingle; repeated rows have equal fingerprints and link; null ids
are kept, belong to the component of their fingerprint and are never its name unless it has no other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, connected_components, materialize, per_batch, texts

GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HAMMING = 0b1011  # x^3 + x + 1
#: (bits, generator, covering radius) of each part of the code; generator 1 is the code of all words
BLOCKS = ((23, GOLAY, 3), (23, GOLAY, 3), (7, HAMMING, 1))
FINE = (*BLOCKS, (7, HAMMING, 1), (4, 1, 0))
#: fingerprints from which the fine code is used; sampling of hot anchors; fingerprints of a block
FINE_FROM, SHARE, BLOCK = 50_000_000, 64, 16_384
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or b"").lower().split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: n - words + 1].tolist()
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, n - words + 1)
    counts = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    cuts = np.arange(0, len(h), 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(0)
    over = counts * 2 > len(h)
    return int.from_bytes(np.packbits(over.T.reshape(-1), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str, text: str, words: int, seed: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words, seed) for t in texts(b)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

        return f

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(per_batch(make), "doc_id long, fp long")


class BlockCode:
    """For every syndrome of a cyclic perfect code: the errors to codewords within radius + t, by t."""

    def __init__(self, n: int, generator: int, radius: int, t: int) -> None:
        self.n, self.check = n, generator.bit_length() - 1
        single = [self._rem(1 << i, generator) for i in range(n)]
        self.tables = np.zeros(((n + 7) // 8, 256), np.int64)
        for i in range(n):
            at = np.arange(256) >> (i % 8) & 1 == 1
            self.tables[i // 8][at] ^= single[i]
        found: list[list[list[int]]] = [[[] for _ in range(1 << self.check)] for _ in range(t + 1)]
        for weight in range(radius + t + 1):
            for bits in combinations(range(n), weight):
                s = 0
                for i in bits:
                    s ^= single[i]
                found[max(0, weight - radius)][s].append(sum(1 << i for i in bits))
        self.errors = []
        for level in found:
            padded = np.full((1 << self.check, max(map(len, level))), -1, np.int64)
            for s, own in enumerate(level):
                padded[s, : len(own)] = own
            self.errors.append(padded)

    @staticmethod
    def _rem(x: int, g: int) -> int:
        while x.bit_length() >= g.bit_length():
            x ^= g << (x.bit_length() - g.bit_length())
        return x

    def anchors(self, block: np.ndarray, level: int) -> np.ndarray:
        """Message bits of the codewords at that level for each block, -1 where there are fewer."""
        s = np.zeros(len(block), np.int64)
        for i, table in enumerate(self.tables):
            s ^= table[block >> (8 * i) & 255]
        e = self.errors[level][s]
        return np.where(e < 0, -1, (block[:, None] ^ e) >> self.check)


_codes: dict[tuple, list[BlockCode]] = {}


def anchors_of(fp: np.ndarray, t: int, blocks: tuple = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) for every anchor within the covering radius plus t."""
    if (t, blocks) not in _codes:
        _codes[t, blocks] = [BlockCode(n, g, r, t) for n, g, r in blocks]
    codes, u, parts, shift = _codes[t, blocks], fp.view(np.uint64), [], 0
    for code in codes:
        block = ((u >> np.uint64(shift)) & np.uint64((1 << code.n) - 1)).astype(np.int64)
        parts.append([code.anchors(block, level) for level in range(t + 1)])
        shift += code.n
    index, key = [], []
    for levels in product(range(t + 1), repeat=len(codes)):
        if sum(levels) > t:
            continue
        at, anchor, width = np.arange(len(fp)), np.zeros(len(fp), np.int64), 0
        for code, part, level in zip(codes, parts, levels, strict=True):
            own = part[level][at]
            row, column = np.nonzero(own >= 0)
            at, anchor = at[row], anchor[row] | own[row, column] << width
            width += code.n - code.check
        index.append(at)
        key.append(anchor)
    return np.concatenate(index), np.concatenate(key)


def _near(run: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that span the components of fingerprints at one anchor."""
    left = run.view(np.uint64)
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            node = queue.pop()
            close = np.bitwise_count(left ^ node) <= most
            if close.any():
                for x in left[close]:
                    yield node, x
                queue += list(left[close])
                left = left[~close]


def near_links(distinct: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(u, v) links of fingerprints that differ in at most ``most`` bits, spanning their components."""
    t = (most + 1) // 2
    blocks = FINE if distinct.count() >= FINE_FROM else BLOCKS

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for i in range(0, len(fp), 2048):
                own = fp[i : i + 2048]
                at, anchor = anchors_of(own, t, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[at])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the run that is open at the end of a batch
        key = None
        seen: set[tuple[int, int]] = set()

        def links(runs: list[np.ndarray]) -> pa.RecordBatch:
            pairs = [(int(np.int64(np.uint64(a))), int(np.int64(np.uint64(b)))) for r in runs for a, b in _near(r, most)]
            return out(pairs)

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            new = [p for p in dict.fromkeys(pairs) if p not in seen]
            if len(seen) < 200_000:
                seen.update(new)  # a pair meets at many anchors
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.int64()), pa.array([b for _, b in new], pa.int64())], ["u", "v"])

        for b in batches:
            anchor, fp = b.column("anchor").to_numpy(), b.column("fp").to_numpy()
            bounds = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(anchor)]])
            pairs: list[tuple[int, int]] = []
            if key is not None and anchor[0] == key:
                held.append(fp[: ends[0]])
                first = 1
            else:
                first = 0
            if first < len(starts) and held:
                yield links([np.concatenate(held)])
                held = []
            size = ends - starts
            inner = np.arange(first, len(starts) - 1)
            two = inner[size[inner] == 2]  # most runs with any pair
            x, y = fp[starts[two]], fp[starts[two] + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= most
            pairs += zip(x[near].tolist(), y[near].tolist(), strict=True)
            for i in inner[size[inner] > 2]:
                pairs += [(int(p.view(np.int64)), int(q.view(np.int64))) for p, q in _near(fp[starts[i] : ends[i]], most)]
            if first < len(starts):
                held = [fp[starts[-1] : ends[-1]]]
            key = anchor[-1]
            yield out(pairs)
        if held:
            yield links([np.concatenate(held)])

    replicas = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    some = distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0).mapInArrow(replicate, "anchor long, fp long")
    hot = some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * SHARE > block)
    hot, _ = materialize(hot.select("anchor", F.ceil(F.col("n") * SHARE / block).cast("int").alias("blocks")), "hot")
    if n := hot.count():
        cut = replicas.join(bounded(hot, n, 48), "anchor", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("anchor", F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
        # two groups that share a hash are compared as one, which finds no less
        replicas = cut.select(F.explode(F.when(F.col("blocks").isNull(), F.array("anchor")).otherwise(pairs)).alias("anchor"), "fp")
    return replicas.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "u long, v long")


def _components(docs: DataFrame, doc_id: str, text: str, words: int, seed: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) a document, and (fp, root, rep) a fingerprint: its component and the smallest id that has it."""
    own, _ = materialize(fingerprints(docs, doc_id, text, words, seed), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct, _ = materialize(distinct, "distinct")
    roots = connected_components(near_links(distinct, most_bits)).withColumnRenamed("node", "fp")
    return own, distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    seed: int = 42,
    most_bits: int = 4,
) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest id that can be reached)."""
    own, named = _components(docs, doc_id, text, words, seed, most_bits)
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    seed: int = 42,
    most_bits: int = 4,
) -> DataFrame:
    """Exactly one row of each component: that with the smallest id, a null id only where there is no other.

    Of rows that share that id in a component, those of the smallest fingerprint compete, and of these that with the smallest
    hash of all columns stays; an id that stands for different texts stays once in each component that it leads.
    """
    own, named = _components(docs, doc_id, text, words, seed, most_bits)
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("best")
    first, _ = materialize(named.groupBy("root").agg(best).select("best.fp", F.col("best.rep").alias("doc_id")), "first")
    led = first.select("fp", F.col("doc_id").alias("lead"), F.lit(1).alias("is_first"))
    led = own.join(led, "fp", "left").withColumn("first", F.col("is_first").isNotNull() & F.col("doc_id").eqNullSafe(F.col("lead")))
    tally = led.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"))
    tally, _ = materialize(tally.where("n > 1 OR firsts = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("_gone"), "firsts"), "gone")
    kept = docs.where(F.col(doc_id).isNotNull()).join(tally.select("_gone"), docs[doc_id] == tally["_gone"], "left_anti")
    shared = tally.where("firsts > 0").select("_gone")
    if shared.isEmpty():
        return kept

    # rows of repeated or null ids: the fingerprint tells them apart
    cols = [f"_{i}" for i in range(len(docs.columns))]

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words, seed) for t in texts(b, "_text")], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], [*cols, "_id", "_fp"])

        return f

    some = docs.join(shared, docs[doc_id].cast("long").eqNullSafe(shared["_gone"]), "left_semi")
    src = some.select(F.col(text).alias("_text"), *[F.col(f"`{c}`").alias(i) for i, c in zip(cols, docs.columns, strict=True)], F.col(doc_id).cast("long").alias("_id"))
    kinds = ", ".join(f"{i} {t.dataType.simpleString()}" for i, t in zip(cols, docs.schema, strict=True))
    marked = src.mapInArrow(per_batch(make), f"{kinds}, _id long, _fp long")
    marked = marked.join(first, marked["_id"].eqNullSafe(first["doc_id"]) & (marked["_fp"] == first["fp"]), "left_semi")
    one = marked.groupBy("_id", "_fp").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("row"))
    return kept.unionAll(one.select(*[F.col(f"row.{i}").alias(c) for i, c in zip(cols, docs.columns, strict=True)]))
