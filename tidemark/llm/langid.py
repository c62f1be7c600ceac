"""Language identification by nearest centroid.

A text is lower-cased, everything but letters becomes a space, and its byte n-grams (3 bytes) are
counted in ``buckets`` hash buckets over the whole text.  Sub-linear counts times inverse document frequencies,
normalised, are compared by cosine with several centroids per language, which spherical
k-means finds among the language's training texts.  The nearest centroid gives
the language.

Rejection.  A text is rejected if its distance to the nearest centroid, 1 - cosine, is over a limit that depends on its
number of different grams: any text comes closer to every centroid as it grows, be it noise.  Below ``SHORT`` of them
the limit is ``max_distance``.  Above, it is fitted: each half of the training texts is held against centroids of
the other, single and added up to longer ones, and in each doubling of that number the limit stands ``SLACK``
of the way from the 0.99 quantile of these distances to 1, ``max_distance`` at most; longer texts than
any learned have the limit of the longest.  So random letters, other scripts and unlearned languages go at any length; an
unlearned language that shares many grams with a learned one may stay where the text is short.

Training: at most ``per_lang`` texts of each of the ``most_languages`` languages with most rows, and at most ``train_rows`` in
all, chosen by a hash of the id (the same rows at any partitioning); idf and centroids come from this bounded sample, which is
all that comes to the driver, as sparse counts.

score: the share of the winner among the languages' best cosines, raised to a power (soft-max); 0 for ``und``.

Defined cases: null texts and those without a letter are ``und`` with score 0 and rejected;
null languages are never learned, null ids are (those that share a hash with the last one chosen may count as well); with
nothing to learn every text is ``und``; texts of any length are counted whole, in memory of some ten times their size; of
equal cosines the language that sorts first wins; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hash_share, materialize, per_batch, texts

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: bytes after lower-casing: ASCII letters and all non-ASCII stay, the rest are spaces
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
AT_ONCE = 1_000_000
#: different grams from which the fitted limits hold
SHORT = 64
SLACK = 0.7


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return _ASCII_LETTER.search(text) is not None or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def cleaned(text: bytes) -> np.ndarray:
    """The lower-cased letters of the text as bytes, words between single spaces."""
    return np.frombuffer(b" " + b" ".join(text.decode().lower().encode().translate(_LETTERS).split()) + b" ", np.uint8)


def grams(clean: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 3 bytes."""
    b = clean.astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def counts_of(batch: list[bytes | None], buckets: int, at_once: int = AT_ONCE) -> np.ndarray:
    """Gram counts, a row a text.  A long text's grams are made ``at_once`` at a time; slices share two bytes, so none is lost or doubled."""
    out = np.zeros((len(batch), buckets), np.float32)
    for i, t in enumerate(batch):
        if t:
            clean = cleaned(t)
            for at in range(0, max(1, len(clean) - 2), at_once):
                out[i] += np.bincount(grams(clean[at : at + at_once + 2], buckets), minlength=buckets)
    return out


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    matrix: np.ndarray  # buckets x centroids
    owner: np.ndarray  # centroid -> language
    limits: np.ndarray | None = None  # by doublings of the number of different grams -> distance

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, distance to the nearest centroid."""
        cos = self.vectors(counts) @ self.matrix
        best = np.full((len(cos), len(self.languages)), -1.0)
        for k in range(len(self.languages)):
            best[:, k] = cos[:, self.owner == k].max(1)
        near = cos.argmax(1)
        lang = self.owner[near]
        e = np.exp(24.0 * (best - best.max(1, keepdims=True)))
        return lang, e.max(1) / e.sum(1), 1 - cos[np.arange(len(cos)), near]

    def limit(self, counts: np.ndarray, max_distance: float) -> np.ndarray:
        """The distance over which a text is rejected."""
        if self.limits is None:
            return np.full(len(counts), max_distance)
        n = (counts > 0).sum(1)
        return np.where(n < SHORT, max_distance, np.minimum(self.limits[doublings(n)], max_distance))


def doublings(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(np.int64)


def fit_limits(rows: list[tuple[str, np.ndarray]], buckets: int) -> np.ndarray | None:
    """Limit of the distance by doublings of the number of different grams; None without two texts."""
    size, far = [], []
    halves = rows[::2], rows[1::2]
    for own, other in (halves, halves[::-1]):
        model = fit(other, buckets)
        if model is None:
            return None
        for k in sorted({x for x, _ in own}):
            part = np.stack([c for x, c in own if x == k])
            while len(part):
                size.append((part > 0).sum(1))
                far.append(model.predict(part)[2])
                part = part[: len(part) // 2 * 2]
                part = part[::2] + part[1::2]
    at, distance = doublings(np.concatenate(size)), np.concatenate(far)
    out = np.ones(buckets.bit_length())
    for i in range(at.min(), len(out)):
        q = np.quantile(distance[at == i], 0.99) if (at == i).any() else 1.0
        before = out[i - 1] if i > at.min() else 1.0
        out[i] = min(before, q + SLACK * (1 - q))
    return out


def fit(rows: list[tuple[str, np.ndarray]], buckets: int, per_centroid: int = 4, rounds: int = 12) -> Centroids | None:
    """rows: (language, counts)."""
    languages = sorted({x for x, _ in rows})
    if not languages:
        return None
    counts = np.stack([c for _, c in rows]).astype(np.float32)
    label = np.array([languages.index(x) for x, _ in rows])
    df = (counts > 0).sum(0)
    model = Centroids(languages, (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32), np.zeros((buckets, 0)), np.zeros(0, int))
    x = model.vectors(counts)
    columns, owner = [], []
    for k in range(len(languages)):
        own = x[label == k]
        picked = [own.mean(0)]
        while len(picked) < min(per_centroid, len(own)):  # farthest first
            picked.append(own[(own @ np.stack(picked).T).max(1).argmin()])
        c = np.stack(picked)
        for _ in range(rounds):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            at = (own @ c.T).argmax(1)
            c = np.stack([own[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        columns += list(c)
        owner += [k] * len(c)
    model.matrix, model.owner = np.stack(columns, 1).astype(np.float32), np.array(owner)
    return model


def identify(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    learn: Column | None = None,
    per_lang: int = 400,
    most_languages: int = 1000,
    train_rows: int = 8000,
    buckets: int = 8192,
    max_distance: float = 0.95,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row a document.

    ``learn`` marks the rows that may be learned from, by default all; ``keep`` asks for
    these columns of the documents in front of lang_pred, score and rejected instead of doc_id.
    """
    may = F.col(lang).isNotNull() & F.col(text).isNotNull() & (learn if learn is not None else F.lit(True))
    ranked = docs.where(may).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("h"))
    sizes, _ = materialize(ranked.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages), "languages")
    per_lang = min(per_lang, max(2, train_rows // max(1, sizes.count())))
    # the lowest hashes of a language are among a share of rows that holds about four times the wanted number
    share = F.lit(4.0 * per_lang + 100) / F.col("rows")
    ranked = ranked.join(F.broadcast(sizes), "lang").where(hash_share("id", share)).select("id", "lang", "h")  # most_languages rows at most
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = ranked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("id", "lang")
    sample = docs.where(may).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi")  # train_rows rows at most

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, t in zip(b.column("lang").to_pylist(), texts(b), strict=True):
                if has_letter(t):
                    c = counts_of([t], buckets)[0]
                    at = np.flatnonzero(c)
                    rows.append((name, at.astype(np.int32).tobytes(), c[at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "at", "n"])

    def dense(at: bytes, n: bytes) -> np.ndarray:
        c = np.zeros(buckets, np.float32)
        c[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.float32)
        return c

    learned = [(r.lang, bytes(r.at), bytes(r.n)) for r in sample.mapInArrow(sparse, "lang string, at binary, n binary").collect()]
    learned.sort(key=lambda r: (r[0], zlib.crc32(r[1] + r[2])))  # the same halves at any partitioning
    limits = fit_limits([(k, dense(at, n)) for k, at, n in dict.fromkeys(learned)], buckets)
    fitted = fit([(k, dense(at, n)) for k, at, n in learned], buckets)
    if fitted is not None:
        fitted.limits = limits
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def make():
        m = model.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            pred, score, gone = [], [], []
            all_texts = texts(b, "_text")
            for i in range(0, len(all_texts), 128):
                part = all_texts[i : i + 128]
                letters = [m is not None and has_letter(t) for t in part]
                if m is None:
                    at, s, over = np.zeros(len(part), int), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    counts = counts_of(part, buckets)
                    at, s, far = m.predict(counts)
                    over = far > m.limit(counts, max_distance)
                pred += [m.languages[k] if ok else "und" for k, ok in zip(at, letters, strict=True)]
                score += [float(x) if ok else 0.0 for x, ok in zip(s, letters, strict=True)]
                gone += [bool(x) or not ok for x, ok in zip(over, letters, strict=True)]
            extra = [b.column(i) for i in range(1, b.num_columns)]
            names = [f"_{i}" for i in range(len(extra))]
            return pa.RecordBatch.from_arrays([*extra, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

        return f

    columns = keep if keep is not None else [doc_id]
    src = docs.select(F.col(text).alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = src.mapInArrow(per_batch(make), f"{kinds}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"_{i}").alias(c if keep is not None else "doc_id") for i, c in enumerate(columns)], "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected."""
    spec = identify(docs, keep=docs.columns, **options)
    cut = len(docs.columns)
    named = spec.toDF(*[f"_{i}" for i in range(cut)], "lang_pred", "score", "rejected")
    return named.where("NOT rejected").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

