"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One scan turns every whole text into a row of statistics, which is written to the shared folder.  Class
means and covariances are sums over all labelled rows, taken by a grouped aggregate (two rows reach the
driver).  Each covariance is shrunk to the pooled one and that to its diagonal; its Cholesky factor is
computed once, and a row's score is the logistic of the difference of the two Mahalanobis log densities.

Nulls and empty texts have the statistics of no words and are scored like any other.  Null ids stay null;
repeated rows get a row each; a repeated label row counts each time.  Without labels of both classes every
score is the share of class 1 (0.5 if there are no labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_array

NAMES = ("words", "word_len", "word_len_sd", "symbols", "punct", "bangs", "pipes", "digits", "upper", "dup_lines", "repeats", "distinct", "line_words", "top_word", "short_words", "sentences", "other")
SYMBOLS = bytes(c for c in range(256) if chr(c) in "#*$%&<>@^~_=+/\\{}[]")
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def statistics(text: str) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), max(1, len(raw))
    lens = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    counts = Counter(words)
    grams = Counter(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = sum(c for c in grams.values() if c > 1)
    lines = [x for x in text.split("\n") if x.strip()]
    has = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    lettery = has(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
    rate = lambda k, of: math.log((k + 0.5) / (max(of, k) + 1.0))
    return (
        math.log1p(n),
        math.log1p(float(lens.mean())),
        math.log1p(float(lens.std())),
        rate(has(SYMBOLS), size),
        rate(has(b".,;:"), size),
        rate(has(b"!?"), size),
        rate(raw.count(b"|"), size),
        rate(has(b"0123456789"), size),
        rate(has(bytes(range(65, 91))), max(1, lettery)),
        rate(len(lines) - len(set(lines)), len(lines)),
        rate(repeated, max(1, n - 4)),
        rate(len(counts), n),
        math.log1p(n / max(1, len(lines))),
        rate(max(counts.values(), default=0), n),
        rate(int((lens <= 3).sum()) if n else 0, n),
        rate(sum(1 for w in words if w[-1] in ".!?"), n),
        rate(size - lettery - has(b" \n\t"), size),
    )


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and one double for each of NAMES, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in slices(off, 1 << 20):
                x = np.array([statistics(t) for t in texts.slice(i, j - i).to_pylist()], float).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x[:, k]) for k in range(len(NAMES)))], ["doc_id", *NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def moments(rows: DataFrame, by: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of NAMES for each value of ``by``: sums, so partial ones combine."""
    d = len(NAMES)
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    sums += [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for r in rows.groupBy(by).agg(F.count("*").alias("n"), *sums).collect():
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] / r["n"] for j in range(d)] for i in range(d)]) - np.outer(mean, mean)
        out[r[by]] = (r["n"], mean, cov)
    return out


class Discriminant:
    def __init__(self, classes: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float, diagonal: float):
        self.constant = None
        total = sum(c[0] for c in classes.values())
        if min((classes[k][0] if k in classes else 0 for k in (0, 1)), default=0) < 2:
            self.constant = classes[1][0] / total if 1 in classes else 0.0 if total else 0.5
            return
        pooled = sum(n * c for n, _, c in classes.values()) / total
        target = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(len(pooled))
        self.parts = []
        for k in (0, 1):
            n, mean, cov = classes[k]
            own = shrink + (1 - shrink) * len(mean) / (n + len(mean))  # few rows lean on the pooled covariance
            factor = np.linalg.cholesky((1 - own) * cov + own * target)
            self.parts.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), math.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, inverse, logdet, prior in self.parts:
            z = (x - mean) @ inverse.T
            density.append(prior - 0.5 * ((z * z).sum(1) + logdet))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "quality", shrink: float = 0.05, diagonal: float = 0.1) -> DataFrame:
    """doc_id and score of every document; labels count where ``train`` holds."""
    rows = stage(statistics_table(docs), "statistics")
    known = labels.where(train).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    model = Discriminant(moments(rows.join(known, "doc_id"), "label"), shrink, diagonal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(NAMES))], 1) if len(batch) else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
