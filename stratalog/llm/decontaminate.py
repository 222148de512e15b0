"""Benchmark decontamination by word positions that are looked up in slices of documents.

No postings are stored.  A slice of a scan task builds, in memory, the ascending word positions of the test
terms in its own documents.  A phrase is answered by the positions of its rarest term in the slice: there the
other terms are compared with the word array at their offsets (only ``slop`` > 0 searches the other terms'
positions too).  A phrase with a term that the slice lacks costs nothing.  Nothing leaves its slice, so there is no
shuffle and no hot term; documents of any length are one slice of their own at most.

The phrases come from the benchmark in blocks of at most ``block_bytes``; each block is a broadcast of
that proven size and every block meets every row.  ``slop`` > 0 asks for proximity instead of the exact
phrase: each term within ``slop`` words of its place relative to the rarest one.

Nulls: null texts have no words; null ids stay null (a null item_id is the string "null").  Repeated rows
get a row each; repeated items count once by id.  Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, slices, text_array

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: str) -> list[bytes]:
    return TOKEN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


class Phrases:
    """Distinct windows of a block of items, grouped by length, as term numbers from 1."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.terms: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = defaultdict(set)
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[k : k + window])].add(number[item])
        self.groups = []
        for n in sorted({len(w) for w in owners}):
            wins = [w for w in owners if len(w) == n]
            own = [sorted(owners[w]) for w in wins]
            self.groups.append((np.array(wins, np.int32).reshape(-1, n), np.cumsum([0, *map(len, own)]), np.array([x for o in own for x in o], np.int64)))


def find(ids: np.ndarray, doc: np.ndarray, windows: np.ndarray, postings: tuple, slop: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of windows and the positions where they start."""
    order, first, count = postings
    counts = count[windows]
    rank = np.argsort(counts, axis=1, kind="stable")
    least = np.take_along_axis(counts, rank[:, :1], 1)[:, 0]
    alive = np.flatnonzero(least)
    ends = np.cumsum(least[alive])
    at = 0
    while at < len(alive):  # blocks of windows with at most `most` candidates (or one window)
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        w = alive[at:upto]
        at = upto
        n = least[w]
        win = np.repeat(w, n)
        anchor = np.repeat(rank[w, 0], n)
        nth = np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
        place = order[first[windows[win, anchor]] + nth]
        start = place - anchor
        keep = (start >= 0) & (start + windows.shape[1] <= len(ids)) if not slop else np.ones(len(win), bool)
        win, start, place = win[keep], start[keep], place[keep]
        for k in range(1, windows.shape[1]):
            if not len(win):
                break
            off = rank[win, k]
            if not slop:
                ok = ids[start + off] == windows[win, off]
            else:  # the next posting of the term from the lower bound on
                term = windows[win, off]
                ok = np.zeros(len(win), bool)
                for t in np.unique(term):
                    mine = np.flatnonzero(term == t)
                    own = order[first[t] : first[t] + count[t]]
                    low = np.searchsorted(own, start[mine] + off[mine] - slop)
                    # the interval may reach into the document before: step to the first posting of this one
                    near = own[np.minimum(low, len(own) - 1)]
                    begin = np.searchsorted(own, np.searchsorted(doc, doc[place[mine]]))
                    near = own[np.minimum(np.maximum(low, begin), len(own) - 1)]
                    ok[mine] = (np.abs(near - start[mine] - off[mine]) <= slop) & (doc[near] == doc[place[mine]])
            win, start, place = win[ok], start[ok], place[ok]
        yield win, start


def match_rows(texts: list[str], blocks: Iterator[Phrases], slop: int) -> list[tuple]:
    """For each text: n_words, n_hit, item names, merged hit spans in words."""
    words = [words_of(t) for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    first_word = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(len(texts)), lens)
    cover = np.zeros(first_word[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        get = block.terms.get
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), np.int32, first_word[-1])
        order = np.argsort(ids, kind="stable")
        count = np.bincount(ids, minlength=len(block.terms) + 1)
        first = np.cumsum(count) - count
        for windows, own_at, own in block.groups:
            n = windows.shape[1]
            for win, start in find(ids, doc, windows, (order, first, count), slop):
                if not slop:  # a window lies in one document
                    ok = doc[start] == doc[start + n - 1]
                    win, start = win[ok], start[ok]
                    d = doc[start]
                    lo, hi = start, start + n
                else:
                    d = doc[np.clip(start, 0, len(doc) - 1)]
                    lo = np.maximum(np.clip(start, 0, len(doc) - 1), first_word[d])
                    hi = np.minimum(np.maximum(start + n, lo + 1), first_word[d + 1])
                np.add.at(cover, lo, 1)
                np.add.at(cover, hi, -1)
                for k, w in set(zip(d.tolist(), win.tolist(), strict=True)):
                    items[k].update(block.names[x] for x in own[own_at[w] : own_at[w + 1]])
    hit = np.cumsum(cover)[:-1] > 0
    out = []
    for k in range(len(texts)):
        own = hit[first_word[k] : first_word[k + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        out.append((int(lens[k]), int(own.sum()), sorted(items[k]), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of items whose texts have at most block_bytes bytes together (or are one item)."""
    sc, held, size, out = benchmark.sparkSession.sparkContext, [], 0, []
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            out.append(sc.broadcast(held))
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    return [*out, sc.broadcast(held)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, slop: int = 0, share: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans of every document.

    contaminated: any hit, and ``share`` * hits >= words."""
    return verdicts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, slop, share, block_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, slop: int = 0, share: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns; nothing is exchanged."""
    held = phrase_blocks(benchmark, window, block_bytes)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, n, got in matched(batches, at, held, window, slop):
            yield batch.slice(i, n).filter(pa.array([not (g[1] > 0 and share * g[1] >= g[0]) for g in got]))

    return docs.mapInArrow(run, docs.schema)


def matched(batches: Iterator[pa.RecordBatch], at: int, held: list, window: int, slop: int) -> Iterator[tuple]:
    """The batch, first row, number of rows and match_rows of each slice."""
    only = [Phrases(held[0].value, window)] if len(held) == 1 else None
    for batch in batches:
        texts = text_array(batch.column(at))
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for i, j in slices(off, 1 << 20 if only else 1 << 23):
            yield batch, i, j - i, match_rows(texts.slice(i, j - i).to_pylist(), only or (Phrases(b.value, window) for b in held), slop)


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int, slop: int, share: int, block_bytes: int) -> DataFrame:
    held = phrase_blocks(benchmark, window, block_bytes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, n, got in matched(batches, 1, held, window, slop):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, n),
                    *(pa.array(x, pa.int64()) for x in ([g[0] for g in got], [g[1] for g in got], [len(g[2]) for g in got])),
                    pa.array([hashlib.sha256(",".join(g[2]).encode()).hexdigest() for g in got]),
                    pa.array([g[1] > 0 and share * g[1] >= g[0] for g in got]),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in g[3]] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return docs.mapInArrow(run, SCHEMA)
