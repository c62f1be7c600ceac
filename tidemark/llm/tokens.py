"""Token counts by a map-side two-tier look-up: no text and no segment is shuffled.

A SentencePiece model without pieces that hold a space mark after another
character can't merge across the start of a run of spaces, so a text's count is
the sum over its segments (a run of spaces and what follows up to the next
space).  Tier one is a compact table {segment: length} of frequent segments, built on the driver
from the first ``sample_rows`` rows (of each its first ``SAMPLE_CHARS`` characters; a cache, counts don't depend on it) and broadcast; tier two is a
bounded cache in each worker, filled by encoding misses.  Both only store what
the library returns, so counts equal it exactly.  Models for which segments
don't hold (checked when the model is loaded) and texts that hold the space mark
itself are encoded whole.  Long texts go through the tables part by part, cut where segments begin.

Defined cases: null and empty text have 0 tokens and 0 bytes; texts of any length
are counted whole, a single segment of any length in one call of the library; null ids stay null; repeated rows are counted each;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, texts

SPACE_MARK = "▁"
_RUNS = re.compile(rb" +[^ ]*")
_START = re.compile(rb"[^ ](?= )")
#: Longer segments aren't kept; longer texts are counted in parts of about this size.
LONGEST_KEY, PART_BYTES = 64, 1_000_000
SAMPLE_CHARS = 20_000
AT_ONCE = 64


class SegmentLengths(dict):
    """Segment (without its first space) -> token count; encodes misses, at most ``limit`` of them kept."""

    def __init__(self, model_file: str, frequent: dict[bytes, int], limit: int, part_bytes: int = PART_BYTES) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__(frequent)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        self.segments_hold = (
            spec.trainer_spec.model_type == 2
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
            and not norm.precompiled_charsmap
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 or SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in spec.pieces)
        )
        self.pieces = {p.piece for p in spec.pieces if p.type == 1}
        self.long: list[bytes] = []
        self.limit, self.frequent, self.part_bytes = limit + len(frequent), frequent, part_bytes

    def learn(self, segments: set[bytes]) -> None:
        """Encodes the segments that aren't known in one call of the library."""
        for x in self.long:
            self.pop(x, None)
        missing = [x for x in segments if x not in self]
        if len(self) + len(missing) > self.limit:
            self.clear()
            self.update(self.frequent)
            missing = list(segments)
        self.long = [x for x in missing if len(x) > LONGEST_KEY]  # for this call only
        self.update(zip(missing, map(len, self.sp.encode([x.decode() for x in missing], num_threads=1)), strict=True))
        self[b""] = 1 if SPACE_MARK in self.pieces else len(SPACE_MARK.encode())  # a space alone

    def _parts(self, text: bytes) -> Iterator[list[bytes] | int]:
        """Lists of segments (without their first space) of the text's parts, or its whole count."""
        if not self.segments_hold or b"\xe2\x96\x81" in text:
            yield len(self.sp.encode(text.decode(), num_threads=1))
            return
        at = 0
        while at < len(text):
            cut = _START.search(text, at + self.part_bytes) if len(text) - at > self.part_bytes else None
            end = cut.end() if cut else len(text)
            part = text[at:end] if at else b" " + text[:end]  # later parts begin with their own space
            if b"  " in part or part[-1:] == b" ":
                yield [m[1:] for m in _RUNS.findall(part)]
            else:
                yield part[1:].split(b" ")
            at = end

    def count_all(self, batch: list[bytes | None]) -> list[int]:
        """Token counts of some texts."""
        out, open_, held = [0] * len(batch), [], 0
        get = self.__getitem__

        def settle() -> None:
            self.learn(set().union(*(x for _, x in open_)))
            for i, x in open_:
                out[i] += sum(map(get, x))
            open_.clear()

        for i, text in enumerate(batch):
            for part in self._parts(text) if text else ():
                if isinstance(part, int):
                    out[i] += part
                    continue
                open_.append((i, part))
                held += len(part)
                if held > self.part_bytes // 4:
                    settle()
                    held = 0
        settle()
        return out


def frequent_segments(docs: DataFrame, text: str, model_file: str, sample_rows: int, size: int) -> dict[bytes, int]:
    """At most ``size`` segments of a few rows, taken from as few partitions as hold them."""
    seen: Counter[bytes] = Counter()
    for r in docs.select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text")).limit(sample_rows).collect():
        seen.update((r.text or "").encode().split(b" "))
    table = SegmentLengths(model_file, {}, 1 << 20)
    keys = [k for k, _ in seen.most_common(size)]
    table.learn(set(keys))
    return {k: table[k] for k in keys}


def count_tokens(
    docs: DataFrame,
    model_file: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit_tokens: int = 4096,
    sample_rows: int = 1024,
    table_size: int = 65_536,
    cache_size: int = 400_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row a document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_segments(docs, text, model_file, sample_rows, table_size))

    def make():
        table = SegmentLengths(model_file, frequent.value, cache_size)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            raw = b.column("text").cast(pa.binary())
            n_bytes = pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64())
            n = pa.array([x for i in range(0, len(raw), AT_ONCE) for x in table.count_all(raw[i : i + AT_ONCE].to_pylist())], pa.int64())
            return pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, n, pc.greater(n, limit_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(per_batch(make), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
