"""Vector best-fit packing of tokenised documents into sequences, over the whole table.

A document's tokens plus an end token are cut only where they exceed a sequence.  A piece is
a vector (tokens, 1 document, attention cost length^2) that must fit into a
sequence's residual capacities in every component.  The open sequence with the smallest
weighted residual norm after placing (``score="norm"``), or the smallest weighted dot-product
of piece and residual (``score="dot"``), takes the piece; pieces come longest first.

The vector depends on the length alone, so the choice needs only the histogram of lengths:
at most ``capacity`` numbers come to the driver however large the table is.  There,
sequences with equal residuals are placed together as ranges of sequence numbers, which gives
for every length a list of (rank -> sequence, offset) ranges.  Executors rank pieces within
their length by task counters plus the distributed prefix sums of the counters, and look up their range.

Defined cases: null text is empty and packs as the end token alone; an empty table packs to
nothing; texts of any length are cut into full sequences and a rest; repeated rows are packed
each (pieces of a row belong together by ``doc_id`` and ``piece``); other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, texts, worker_cache

_LATIN = re.compile(r"[\x00-\xff]*")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = b"\xff"  # stands for the end of a word; never a byte of UTF-8

def _byte_alphabet() -> dict[str, int]:
    """Byte-level tokens write printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


_BYTE_OF = _byte_alphabet()


class ChunkIds(dict):
    """White-space separated chunk -> its ids as little-endian unsigned 32-bit bytes, a bounded cache.

    ``tokenizers`` encodes white space away and merges nothing across it, so a text's ids are those of its
    chunks.  Chunks of Latin-1 characters go through the same merges in ``tiktoken``, several times faster;
    all others, and those that may hold a special token, through ``tokenizers`` itself.
    """

    def __init__(self, file: str, limit: int) -> None:
        import json

        import regex
        import tiktoken

        super().__init__()
        self.file, self.limit = file, limit // 2
        self.older: dict[bytes, bytes] = {}
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        model = spec["model"]
        split = next((p["pattern"].get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and split == _PIECES and kinds == ["NFC", "Replace", "Lowercase"]:
            ranks = {self._bytes(k): v for k, v in model["vocab"].items()}
            order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if order == sorted(order) and order[0] >= 512 and all(bytes([c]) in ranks for c in range(256)):
                self.pieces = regex.compile(_PIECES)
                self.fast = tiktoken.Encoding("chunks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):  # noqa: ANN201
        """The library's own tokenizer, loaded where it is needed first."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        full = Tokenizer.from_file(self.file)
        full.no_truncation()
        full.no_padding()
        return full

    @staticmethod
    def _bytes(token: str) -> bytes:
        """A byte-level token as bytes, its end-of-word mark as _END."""
        word = token.endswith("</w>")
        return bytes(_BYTE_OF[c] for c in (token[:-4] if word else token)) + (_END if word else b"")

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.older.pop(chunk, None)
        if out is None:
            out = self._ids(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:  # frequent chunks come back from the older half
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.fast is None or not _LATIN.fullmatch(text):
            return self._full(text)
        small = text.lower()
        if text.isalpha():
            return self._piece(text if text.isascii() else unicodedata.normalize("NFC", text))
        if text[:-1].isalpha() and text[-1] in ".,;:!?":
            return self[small[:-1].encode()] + self[text[-1].encode()]
        if any(s in text for s in self.special):
            return self._full(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self._piece, self.pieces.findall(text.lower())))

    def _full(self, text: str) -> bytes:
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", self.fast._core_bpe.encode_single_piece(piece.lower().encode() + _END)).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


def place(
    histogram: dict[int, int],
    capacity: int,
    max_docs: int,
    max_cost: int,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    score: str = "norm",
) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, pieces a sequence, offset of the first)], in rank order."""
    full = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> ranges (first, count) of sequences
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    n_seq = 0

    def fits(res: tuple[int, int, int], size: int) -> int:
        return min(res[0] // size, res[1], res[2] // (size * size))

    def put(res: tuple[int, int, int], size: int, q: int, first: int, count: int) -> None:
        left = (res[0] - q * size, res[1] - q, res[2] - q * size * size)
        if left[0] > 0 and left[1] > 0 and left[2] > 0:
            open_.setdefault(left, []).append((first, count))

    for size in sorted(histogram, reverse=True):
        left, rank, own = histogram[size], 0, []
        item = np.array([size, 1, size * size], float) / full
        if not fits((capacity, max_docs, max_cost), size):
            raise ValueError(f"a piece of {size} tokens fits into no empty sequence")
        keys = [r for r in open_ if fits(r, size)]
        if keys:
            res = np.array(keys, float) / full
            rating = ((res - item) ** 2 * w).sum(1) if score == "norm" else (res * item * w).sum(1)
            keys = [keys[i] for i in np.lexsort((np.arange(len(keys)), rating))]
        for r in keys:  # tightest first; a sequence that took one is tighter still and takes the next
            q = fits(r, size)
            ranges = open_.pop(r)
            while ranges and left:
                first, count = ranges.pop()
                use = min(count, left // q)
                if use:
                    own.append((rank, first, q, capacity - r[0]))
                    put(r, size, q, first, use)
                    rank, left, first, count = rank + use * q, left - use * q, first + use, count - use
                if count and left:
                    own.append((rank, first, left, capacity - r[0]))
                    put(r, size, left, first, 1)
                    rank, left, first, count = rank + left, 0, first + 1, count - 1
                if count:
                    ranges.append((first, count))
            if ranges:
                open_.setdefault(r, []).extend(ranges)
            if not left:
                break
        empty = (capacity, max_docs, max_cost)
        q = fits(empty, size)
        for use, each in ((left // q, q), (int(left % q > 0), left % q)):
            if use:
                own.append((rank, n_seq, each, 0))
                put(empty, size, each, n_seq, use)
                rank, n_seq = rank + use * each, n_seq + use
        out[size] = own
    return out


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    score: str = "norm",
    with_ids: bool = False,
    cache_size: int = 240_000,
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    ``max_docs`` and ``max_cost`` bound the pieces and the summed squared lengths of a sequence; by default
    they follow from ``capacity`` and never bind before it.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("packing", tokenizer_file, cache_size), lambda: ChunkIds(tokenizer_file, cache_size))
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for few in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            rows: list[tuple] = []
            for doc, t in zip(few.column("doc_id").to_pylist(), texts(few), strict=True):
                ids = table.encode(t) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    row = (doc, piece, at // 4, n, zlib.crc32(part), task, ranks[n])
                    rows.append(row + (np.frombuffer(part, "<u4").tolist(),) if with_ids else row)
                    ranks[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<long>" * with_ids
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces, _ = materialize(src.mapInArrow(cut, schema), "pieces")
    counts = pieces.groupBy("length", "task").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan = place(histogram, capacity, max_docs or capacity, max_cost or capacity * capacity, weights, score)
    plan = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in plan.items()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "task")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            bounds = np.flatnonzero(np.diff(size[order], prepend=-1))
            for rows in np.split(order, bounds[1:]) if len(order) else []:
                n = int(size[rows[0]])
                p = plan.value[n]
                at = np.searchsorted(p[:, 0], rank[rows], side="right") - 1
                k = rank[rows] - p[at, 0]
                seq[rows], off[rows] = p[at, 1] + k // p[at, 2], p[at, 3] + k % p[at, 2] * n
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in result[:5]] + [pa.array(seq), pa.array(off)] + [b.column(c) for c in result[7:]], result
            )

    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return ranked.select(*result[:5], "rank", *["ids"] * with_ids).mapInArrow(
        assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    )
