"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text.  The ordinary one is zstandard's own training
on ordinary windows.  The toxic one starts with the byte strings that toxic documents hold far more often
than ordinary ones (the training picks spans of ``gram`` bytes by their document counts) and goes on with
the ordinary dictionary, so that ordinary words cost the same under both and the lengths part only where
toxic spans occur.  A text is cut into windows of ``words`` words, each compressed under both; the largest
savings, their mean and their share are calibrated by logistic regression on labelled documents that
neither dictionary has seen, with the labels' own share of toxic rows as prior.

Fitting takes at most ``positives`` toxic and ``negatives`` ordinary labelled rows (the first by a hash of
the id, of texts up to ``longest`` characters); scoring takes whole texts of all rows.

Nulls and texts without words are one empty window.  Null ids stay null; repeated rows get a row each.
Without labelled rows of both classes every score is the toxic share (0 if there are no labels).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_array

LEVEL = 9
N_FEATURES = 8


def word_list(text: str) -> list[str]:
    return text.lower().split()


def windows(text: str, words: int) -> list[bytes]:
    w = word_list(text)
    return [(" " + " ".join(w[i : i + words])).encode("utf-8", "surrogatepass") for i in range(0, max(len(w), 1), words)]


def grams(word: str, gram: int) -> set[bytes]:
    s = (" " + word).encode("utf-8", "surrogatepass")
    return {s[i : i + gram] for i in range(max(1, len(s) - gram + 1))}


def contrast(toxic: list[list[str]], ordinary: list[list[str]], gram: int, support: int = 4, z: float = 3.0, ratio: float = 8.0) -> set[bytes]:
    """Byte strings that are far more frequent in toxic documents, by document counts."""
    counts = []
    for docs in (toxic, ordinary):
        c: Counter = Counter()
        memo: dict[str, set[bytes]] = {}
        for d in docs:
            seen: set[bytes] = set()
            for w in set(d):
                if w not in memo:
                    memo[w] = grams(w, gram)
                seen |= memo[w]
            c.update(seen)
        counts.append(c)
    t, o = counts
    nt, no = len(toxic), len(ordinary)
    out = set()
    for g, c in t.items():
        p, q = (c + 0.5) / (nt + 1), (o[g] + 0.5) / (no + 1)
        if c >= support and p > ratio * q and (p - q) / math.sqrt(p * (1 - p) / nt + q * (1 - q) / no) > z:
            out.add(g)
    return out


def toxic_spans(docs: list[list[str]], good: set[bytes], gram: int, most: int) -> bytes:
    """The stretches of words that contrasting grams cover, the most frequent last (nearest to the window)."""
    spans: Counter = Counter()
    for w, c in Counter(w for d in docs for w in set(d)).items():
        x = (" " + w).encode("utf-8", "surrogatepass")
        start = None
        ends = 0
        for i in range(len(x)):
            if x[i : i + gram] in good:
                start = i if start is None or i > ends else start
                ends = i + gram
            elif start is not None and i >= ends:
                spans[x[start:ends]] += c
                start = None
        if start is not None:
            spans[x[start:ends]] += c
    return b"".join(s for s, _ in sorted(spans.items(), key=lambda k: (k[1], k[0])))[-most:]


def compressor(content: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=1024, dict_size=len(content), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p)


class Distance:
    def __init__(self, toxic: bytes, ordinary: bytes, words: int):
        self.toxic, self.ordinary, self.words = compressor(toxic), compressor(ordinary), words

    def features(self, text: str) -> tuple[float, ...]:
        a, b = self.toxic.compress, self.ordinary.compress
        x = np.array([len(b(w)) - len(a(w)) for w in windows(text, self.words)], float)
        top = np.sort(x)[::-1][:4]
        top = np.concatenate([top, np.full(4 - len(top), min(top[-1], 0.0))])
        return top[0], top[1], top[2], top.mean(), x.mean(), math.log1p(len(x)), math.log1p((x >= 2).sum()), math.log1p((x >= 4).sum())


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised columns: mean, scale, weights (intercept first)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + l2 * np.eye(len(w)), a.T @ (p - y) / len(y) + l2 * w)
    return mean, scale, w


def unlike(texts: list[str], hashes: int = 4) -> list[str]:
    """Without near copies, whose own words would pass for toxic ones: a text goes if one of its minimal
    hashes of three words in a row was met before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        w = [x.encode("utf-8", "surrogatepass") for x in word_list(t)]
        h = np.array([zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
        own = {(k, int(((h * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min())) for k in range(hashes)}
        if not own & seen:
            out.append(t)
        seen |= own
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, value: int, n: int, longest: int) -> list[str]:
    """Texts of the first n labelled ids by hash; the ids are bounded by n, so they are broadcast."""
    ids = labels.where(F.col(label) == value).select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.join(F.broadcast(ids), "doc_id").where(F.length("text") <= longest).select("doc_id", "text")
    return unlike([r.text or "" for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text or ""))])


def fit(toxic: list[str], ordinary: list[str], share: float, words: int, gram: int, dictionary: int) -> dict:
    import zstandard as z

    if not toxic or not ordinary:
        return {"constant": share}
    t, o = toxic[::2], ordinary[::2]  # dictionaries from one half, calibration on the other
    wt, wo = [word_list(x) for x in t], [word_list(x) for x in o]
    windowed = [w for x in o for w in windows(x, words) if len(w) >= 8]
    try:
        base = z.train_dictionary(dictionary, windowed).as_bytes()
    except z.ZstdError:  # too little text to train on
        base = b"".join(windowed)[-dictionary:].rjust(64)
    own = toxic_spans(wt, contrast(wt, wo, gram), gram, dictionary)
    if not own:
        return {"constant": share}
    far = Distance(own + base, base, words)
    seen_t, seen_o = toxic[1::2] or t, ordinary[1::2] or o
    x = np.array([far.features(s) for s in [*seen_t, *seen_o]])
    y = np.array([1.0] * len(seen_t) + [0.0] * len(seen_o))
    mean, scale, w = logistic(x, y)
    w[0] += math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(len(seen_t) / len(seen_o))
    return {"toxic": own + base, "ordinary": base, "mean": mean, "scale": scale, "w": w}


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "toxic", positives: int = 2000, negatives: int = 4000, longest: int = 100_000, words: int = 8, gram: int = 5, dictionary: int = 1 << 14) -> DataFrame:
    """doc_id, score and max_saving of every document; labels count where ``train`` holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(train).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    share = pos / n if n else 0.0
    model = fit(sample(docs, known, label, 1, positives, longest), sample(docs, known, label, 0, negatives, longest), share, words, gram, dictionary)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        far = None if "constant" in m else Distance(m["toxic"], m["ordinary"], words)
        for batch in batches:
            texts = text_array(batch.column(1))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in slices(off, 1 << 20):
                if far:
                    x = np.array([far.features(t) for t in texts.slice(i, j - i).to_pylist()]).reshape(-1, N_FEATURES)
                    logit = m["w"][0] + ((x - m["mean"]) / m["scale"]) @ m["w"][1:]
                    score, top = 1 / (1 + np.exp(-np.clip(logit, -30, 30))), x[:, 0]
                else:
                    score, top = np.full(j - i, m["constant"]), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score, pa.float64()), pa.array(top, pa.float64())], ["doc_id", "score", "max_saving"])

    return docs.mapInArrow(run, "doc_id long, score double, max_saving double")
