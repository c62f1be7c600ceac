"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text -> shallow trees, boosted on subsamples of the training rows -> every path
from a root becomes a conjunctive rule over the statistics -> a lasso-penalised logistic
regression keeps few of them -> these are compiled into one Spark column expression, which scores all rows.

Statistics are computed for all rows once and written to the shared folder.  The model is fitted on at
most ``train_rows`` labelled rows, chosen by a hash of the id; only their statistics come to the driver.

Defined cases: null and empty texts have statistics of zero and a score like any other; null labels and held-out rows are never
learned; several labels of one id are each a training row; with one class or none to learn, the score is
the share of label 1 (0.5 without labels); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_share, materialize, per_batch, texts

STATISTICS = [
    "n_words", "n_bytes", "word_length", "distinct_share", "top_share", "short_share", "long_share", "upper_share", "digit_share",
    "symbol_share", "pipe_share", "bang_share", "stop_share", "word_symbol_share", "line_words", "repeated_lines", "repeated_bigrams", "letter_share", "capital_share",
]
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum()) + b" \n\t\r.,'" + bytes(range(128, 256))
_SYMBOL_WORD = re.compile(rb"[^\x00-\x7fA-Za-z0-9 .,'\s]|[#$%&*|!?<>{}@~^=+_\\/-]")


def statistics(text: bytes | None) -> tuple[float, ...]:
    t = text or b""
    words = t.split()
    n, size = len(words), len(t)
    if not n:
        return (0.0, float(size)) + (0.0,) * (len(STATISTICS) - 2)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = t.split(b"\n")
    upper, digits = size - len(t.translate(None, _UPPER)), size - len(t.translate(None, _DIGIT))
    symbols = len(t.translate(None, _PLAIN))
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    letters = size - len(t.translate(None, bytes(c for c in range(256) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122)))
    return (
        float(n), float(size), float(lengths.mean()), len(counts) / n, max(counts.values()) / n,
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), upper / size, digits / size, symbols / size,
        t.count(b"|") / n, t.count(b"!") / n, t.count(b".") / n, min(1.0, symbols / n), n / len(lines),
        1 - len(set(lines)) / len(lines), 1 - pairs / (n - 1) if n > 1 else 0.0, letters / size,
        sum(w[:1].isupper() for w in words) / n,
    )


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, above?, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.terms:
            out &= (x[:, k] > at) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, at in self.terms:
            c = F.col(STATISTICS[k])
            out = out & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {at:.6g}" for k, above, at in self.terms)


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        terms = [F.lit(self.bias)] + [F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        while len(terms) > 1:  # a balanced tree, so that the expression stays shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += rule.holds(x) * weight
        return 1 / (1 + np.exp(-total))


def _tree(x: np.ndarray, r: np.ndarray, depth: int, least: int, columns: np.ndarray, path: tuple, out: list[tuple]) -> None:
    """Greedy squared-error splits; every path below the root goes to ``out`` as (terms, mean)."""
    if path:
        out.append((path, float(r.mean())))
    if depth == 0 or len(r) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    for k in columns:
        order = np.argsort(x[:, k], kind="stable")
        v, s = x[order, k], np.cumsum(r[order])
        n = np.arange(1, len(r))
        gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(r) - n) - s[-1] ** 2 / len(r)
        gain[(v[1:] <= v[:-1]) | (n < least) | (len(r) - n < least)] = 0
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best[0]:
            best = (float(gain[i]), int(k), float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return
    above = x[:, best[1]] > best[2]
    for side in (False, True):
        m = above == side
        _tree(x[m], r[m], depth - 1, least, columns, (*path, (best[1], side, best[2])), out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.0004, seed: int = 7) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, ())
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return RuleEnsemble(base, ())
    rng = np.random.default_rng(seed)
    f = np.full(len(y), base)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        at = rng.choice(len(y), min(len(y), max(200, len(y) // 4)), replace=False)
        some = rng.choice(len(STATISTICS), max(4, len(STATISTICS) // 2), replace=False)
        r = y - 1 / (1 + np.exp(-f))
        paths: list[tuple] = []
        _tree(x[at], r[at], depth, max(5, len(at) // 200), some, (), paths)
        longest = {p for p, _ in paths}
        for terms, mean in paths:
            rules[Rule(terms)] = None
            if not any(len(q) > len(terms) and q[: len(terms)] == terms for q in longest):
                f += 0.8 * np.clip(mean * 4, -1, 1) * Rule(terms).holds(x)
    kept = [r for r in rules]
    z = np.stack([r.holds(x) for r in kept], 1).astype(np.float64)
    mu = z.mean(0)
    ok = (mu > 0) & (mu < 1)
    kept, z = [r for r, o in zip(kept, ok, strict=True) if o], z[:, ok]
    # accelerated proximal gradient on the mean logistic loss + penalty * |w|_1
    w, b = np.zeros(z.shape[1]), base
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(np.hstack([z, np.ones((len(z), 1))]), 2) ** 2 / len(z))
    for _ in range(600):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        nw = v - step * (z.T @ g / len(y))
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return RuleEnsemble(float(b), tuple((r, float(c)) for r, c in zip(kept, w, strict=True) if c))


def with_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in texts(b)])
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS])

        return f

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(per_batch(make), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn: Column | None = None,
    train_rows: int = 12_000,
    threshold: float = 0.7,
) -> tuple[DataFrame, RuleEnsemble]:
    """doc_id, score, predicted: one row a document; and the model.  ``learn`` is over the column doc_id."""
    stats, _ = materialize(with_statistics(docs, doc_id, text), "statistics")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(learn) if learn is not None else known
    # the lowest hashes are among a share of rows that holds about four times the wanted number
    known = known.where(hash_share("doc_id", F.lit((4.0 * train_rows + 100) / max(1, known.count()))))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    rows = stats.join(F.broadcast(chosen), "doc_id").select("y", *STATISTICS).orderBy(*STATISTICS, "y").limit(4 * train_rows).toPandas()
    model = fit(rows[STATISTICS].to_numpy(float), rows["y"].to_numpy(float))
    out = stats.select("doc_id", model.column().alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")), model
