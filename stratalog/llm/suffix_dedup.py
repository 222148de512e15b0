"""Exact substring dedup by bucket refinement over suffixes.

Suffixes are put into buckets by their first 8 bytes, and a bucket is refined by the bucket identifier of a
later offset: the identifier of the first 2L bytes at p comes from those of L bytes at p and at p + L, so
each refinement reuses the ones before.  Identifiers are 64-bit names, equal for equal bytes wherever they
stand, so refinement needs no exchange: every suffix of a slice has the names of its first 8 and 16 bytes, those that
are compared are refined to 32, ... 256 bytes, and names of any length up to twice that come from two overlapping ones.

Only suffixes that can share ``length`` bytes are sorted together.  A window of ``length`` bytes belongs to
its anchor, the position of the least 16-byte name in its first ``reach`` positions: equal windows have
equal anchors.  An anchor's windows form a segment, a run of bytes.  Rounds:

1. anchors meet in buckets of their next ``length - reach + 1`` bytes; single anchors are done;
2. buckets are refined by the whole segment; where segments agree, all their windows repeat;
3. where a bucket holds different segments, their bytes are fetched and buckets are refined by runs of 16
   windows: bytes that all of a run share and no other segment has end it, bytes that any of a run covers and
   another segment has repeat it whole;
4. the windows of the runs in between are refined one by one.

Buckets are only ever counted (least, greatest and number, combined on the map side) and joined back, so one
passage in a third of all documents is no task of its own.  Covered runs meet the texts again at the end.

Asked for ``words``, the same rounds over windows of words instead of bytes tell which rows share a passage of so many
words with another row, however few bytes it has.

Nulls: a null text is empty, a null doc_id stays null (rows are told apart by id and text).  Repeated rows are
copies: both lose what they share.  Texts of fewer than ``length`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, flat, hash64, mix, release, slices, stage, staged

NONE = -(1 << 63)
#: A longer text is cut into pieces of so many window starts, each with the bytes its windows need.
PIECE = 1 << 20
ANCHORS = "doc long, th long, key long, seg long, anchor long, lo long, hi long"


#: One factor for each doubling.  The name of twice the bytes is by * the first half's + the second half's: a sum of mixed 8-byte
#: names whose weights are products of the factors.  Each factor less 1 is twice an odd number, so sums of weights with any signs by
#: halves (the patterns that one common factor maps to zero) keep all but 5 of the 64 bits.
DOUBLING = {8: np.uint64(0x9E3779B97F4A7C17), 16: np.uint64(0xC2B2AE3D27D4EB4F), 32: np.uint64(0xD6E8FEB86659FD93), 64: np.uint64(0xA0761D6478BD642F), 128: np.uint64(0xE7037ED1A0B428DB)}


class Names:
    """Bucket identifiers of all suffixes of some bytes: at every position up to ``dense`` bytes, of longer ones where asked."""

    def __init__(self, data: np.ndarray, dense: int = 256):
        n = len(data)
        first = np.ndarray(n, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
        self.n, self.levels = n, {8: mix(first, np.uint64(8) + np.zeros(1, np.uint64))}
        size = 8
        while size < dense:
            a = self.levels[size] * DOUBLING[size]
            a[: max(0, n - size)] += self.levels[size][size:]
            size *= 2
            self.levels[size] = a

    def level(self, at: np.ndarray, size: int) -> np.ndarray:
        if size in self.levels:
            return self.levels[size][at]
        half = size // 2
        return self.level(at, half) * DOUBLING[half] + self.level(at + half, half)

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the length bytes at these positions (which must lie inside), for 16 <= length <= 512."""
        size = min(256, 1 << (length.bit_length() - 1))
        return mix(self.level(at, size), self.level(at + (length - size), size))


def anchored(low: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side: text number, anchor, first and last window start, by the names that anchors are chosen by (used up)."""
    n = len(low)
    starts = np.zeros(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        starts[a : max(a, b - length + 1)] = True
    bits = np.uint64(24)  # a slice has fewer than 1 << 24 places; one width, so that equal windows agree in any slice
    low >>= bits
    low <<= bits
    low |= np.arange(n, dtype=np.uint64)
    size, other = 1, np.empty_like(low)
    while size < reach:  # sliding minimum by doubling
        step = min(size, reach - size)
        np.minimum(low[: n - step], low[step:], out=other[: n - step])
        other[n - step :] = low[n - step :]
        low, other = other, low
        size += step
    at = np.flatnonzero(starts)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    begin = np.ones(n, bool)  # a window starts a run if it is the first of its text or has another anchor than the one before
    np.not_equal(low[1:], low[:-1], out=begin[1:])
    begin[1:] |= ~starts[:-1]
    begin &= starts
    lo = np.flatnonzero(begin)
    ends = np.ones(n, bool)
    np.logical_not(starts[1:], out=ends[:-1])
    ends[:-1] |= begin[1:]
    ends &= starts
    hi = np.flatnonzero(ends)
    anchor = (low[lo] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, lo, side="right") - 1
    return text, anchor, lo, hi


def segments(data: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side: text number, anchor, first and last window start (all in data), and the names."""
    names = Names(data, 16)
    return *anchored(names.levels.pop(16), offsets, length, reach), names  # the names of 16 bytes make way for the order


def pieces(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, bytes, offsets and the place of each piece in its text; whole texts unless very long."""
    data, off = flat(batch.column(column))
    for i, j in slices(off):
        if j - i == 1 and off[j] - off[i] > PIECE + length:
            for p in range(0, int(off[j] - off[i]) - length + 1, PIECE):
                part = data[off[i] + p : min(off[j], off[i] + p + PIECE + length - 1)]
                yield np.array([i]), part, np.array([0, len(part)]), np.array([p])
        else:
            yield np.arange(i, j), data[off[i] : off[j]], off[i : j + 1] - off[i], np.zeros(j - i, np.int64)


def anchor_rows(length: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, data, off, place in pieces(batch, 2, length):
                if len(data) < length:
                    continue
                text, anchor, lo, hi, names = segments(data, off, length, reach)
                if not len(lo):
                    continue
                key = names.of(anchor, length - reach + 1)
                shape = ((anchor - lo) * length + (hi - lo)).astype(np.uint64)
                seg = mix(mix(names.of(lo, length), names.of(hi, length)), shape)
                base = place[text] - off[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[rows[text]], th[rows[text]], key.view(np.int64), seg.view(np.int64), anchor + base, lo + base, hi + base)], ["doc", "th", "key", "seg", "anchor", "lo", "hi"])

    return run


def fragment_rows(length: int):
    """The bytes of the segments asked for (doc, th, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(2))
            docs, ths, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for row in range(len(batch)):
                spans = asked[row].values
                lo, hi, key, seg, anchor = (spans.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "key", "seg", "anchor"))
                body = [data[off[row] + a : off[row] + b + length].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                n = len(lo)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ([docs[row]] * n, [ths[row]] * n, key, seg, anchor, lo, hi)), pa.array(body, pa.binary())], ["doc", "th", "key", "seg", "anchor", "lo", "hi", "body"])

    return run


STEP = 16


def interval_rows(length: int):
    """For each run of STEP window starts, aligned to the anchor: the name of the bytes that all windows of the
    whole run share, and the name of the bytes that the segment's part a..b of the run covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, key, seg, anchor, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            bodies, off = flat(batch.column(7))
            for i, j in slices(off):
                names = Names(bodies[off[i] : off[j]], 64)
                # run k starts at anchor - STEP * (k + 1) + 1, so that run 0 ends at the anchor
                last, first = (anchor[i:j] - lo[i:j]) // STEP, (anchor[i:j] - hi[i:j]) // STEP
                n = last - first + 1
                row = np.repeat(np.arange(i, j), n)
                place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = anchor[row] - STEP * (place + 1) + 1
                a, b = np.maximum(begin, lo[row]), np.minimum(begin + STEP - 1, hi[row])
                move = off[row] - off[i] - lo[row]  # from places in the text to places in the slice
                own = key[row].view(np.uint64)
                inside = mix(mix(names.of(begin + STEP - 1 + move, length - STEP + 1), place.astype(np.uint64)), own)
                shape = ((anchor[row] - a) * STEP + (b - a)).astype(np.uint64)
                around = mix(mix(mix(names.of(a + move, length), names.of(b + move, length)), shape), own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], th[row], seg[row], lo[row], a, b, inside.view(np.int64), around.view(np.int64))], ["doc", "th", "seg", "lo", "a", "b", "inside", "around"])

    return run


def window_rows(length: int):
    """Name, segment and start of every window of the runs asked for (doc, th, key, seg, lo, body, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, key, seg, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            bodies, off = flat(batch.column(5))
            for i, j in slices(off):
                names = Names(bodies[off[i] : off[j]])
                asked = batch.column(6).slice(i, j - i)
                runs = asked.flatten()
                a, b = (runs.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
                row = np.repeat(np.arange(i, j), np.array([len(x) for x in asked]))
                n = b - a + 1
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                row = np.repeat(row, n)
                name = mix(names.of(at + off[row] - off[i] - lo[row], length), key[row].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], th[row], name.view(np.int64), seg[row], at)], ["doc", "th", "name", "seg", "at"])

    return run


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words of texts side by side, and the offsets of each text's words (n + 1)."""
    n = len(data)
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    bounds = offsets[(offsets > 0) & (offsets < n)]  # words of neighbouring texts do not run together
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    begin, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= begin
    eight = np.ndarray(n, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mix(eight[begin] & mask[np.minimum(size, 8)], size.astype(np.uint64))
    k, more = 8, np.flatnonzero(size > 8)
    while len(more) and k < 64:
        out[more] = mix(out[more], eight[begin[more] + k] & mask[np.minimum(size[more] - k, 8)])
        k += 8
        more = more[size[more] > k]
    if len(more):
        out[more] = mix(out[more], hash64([data[a + k : a + m].tobytes() for a, m in zip(begin[more].tolist(), size[more].tolist(), strict=True)]))
    return out, np.searchsorted(begin, offsets)


def passages(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of windows of so many words: text number, first and last window start, bucket, name, and all windows' names.

    An anchor is the place of the least name of 8 words in a window, and this name is its bucket."""
    whole, off = word_names(data, offsets)
    long = len(off) == 2 and len(whole) > PIECE + words
    for p in range(0, len(whole) - words + 1, PIECE) if long else [0]:
        one, at = (whole[p : p + PIECE + words - 1], np.array([0, min(PIECE + words - 1, len(whole) - p)])) if long else (whole, off)
        if len(one) < words:
            continue
        size = 1
        while size < 32:
            if size == 8:
                eight = one
            one, half = one * DOUBLING[8 * size], one
            one[: max(0, len(half) - size)] += half[size:]
            size *= 2
        text, anchor, lo, hi = anchored(eight.copy(), at, words, words - 7)
        names = mix(one[: len(one) - (words - 32)], one[words - 32 :])
        shape = ((anchor - lo) * words + (hi - lo)).astype(np.uint64)
        yield text, lo, hi, eight[anchor], mix(mix(names[lo], names[hi]), shape), names


def distinct(text: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Where each combination of a text and its parts stands first."""
    name = text.astype(np.uint64)
    for p in parts:
        name = mix(name, p)
    return np.unique(name, return_index=True)[1]


def passage_rows(words: int):
    """Bucket and name of every segment of words, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = flat(batch.column(2))
            for i, j in slices(off):
                found = [(text, key, seg) for text, _, _, key, seg, _ in passages(data[off[i] : off[j]], off[i : j + 1] - off[i], words)]
                if found:
                    text, key, seg = (np.concatenate(x) for x in zip(*found, strict=True))
                    at = distinct(text, key, seg)
                    row = text[at] + i
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], th[row], key[at].view(np.int64), seg[at].view(np.int64))], ["doc", "th", "key", "seg"])

    return run


def passage_windows(words: int):
    """Names of all windows of words in the buckets asked for (doc, th, text, keys), once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ths, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            data, off = flat(batch.column(2))
            for row in range(len(batch)):
                keys, found = asked[row].values.to_numpy(zero_copy_only=False).view(np.uint64), []
                for _, lo, hi, key, _, names in passages(data[off[row] : off[row + 1]], np.array([0, off[row + 1] - off[row]]), words):
                    held = np.flatnonzero(np.isin(key, keys))
                    found += [names[a : b + 1] for a, b in zip(lo[held].tolist(), hi[held].tolist(), strict=True)]
                if found:
                    name = np.unique(np.concatenate(found)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(name), pa.int64()) for x in (docs[row], ths[row])), pa.array(name)], ["doc", "th", "name"])

    return run


@staged
def sharing(rows: DataFrame, words: int) -> DataFrame:
    """doc and th of the rows (doc, th, text) with so many words in a row that another row has too.

    Rows that agree in a whole segment share its windows.  Only rows without such a segment are compared by windows, with
    one row of each kind of segment in their buckets: a kind that several rows have is in no such row itself."""
    anchors = rows.select("doc", "th", "text").mapInArrow(passage_rows(words), "doc long, th long, key long, seg long")
    buckets = anchors.groupBy("key").agg(F.count("*").alias("c"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("c > 1")
    met = stage(anchors.join(buckets.select("key", (F.col("s0") != F.col("s1")).alias("mixed")), "key"), "met")
    release(rows.sparkSession)
    mixed = met.where("mixed")
    kinds = stage(mixed.groupBy("key", "seg").agg(F.count("*").alias("c"), F.min(F.struct("doc", "th")).alias("r")), "kinds")
    again = mixed.join(kinds.where("c > 1").select("key", "seg"), ["key", "seg"]).select("doc", "th")
    again = stage(met.where("not mixed").select("doc", "th").union(again).distinct(), "again")
    left = mixed.join(again, ["doc", "th"], "left_anti").select("key").distinct()
    asked = kinds.join(left, "key", "left_semi").groupBy("r.doc", "r.th").agg(F.collect_set("key").alias("keys"))
    asked = stage(asked, "passages")
    windows = rows.join(asked, ["doc", "th"]).select("doc", "th", "text", "keys").mapInArrow(passage_windows(words), "doc long, th long, name long")
    windows = stage(windows, "words")
    hits = windows.join(windows.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "name").select("doc", "th")
    out = stage(again.union(hits).distinct(), "sharing")
    release(rows.sparkSession)
    return out


#: A run that stands for a passage in another row.
MARK = -1


def cut_rows(words: int):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of texts with the runs to remove; with words, shares_passage before spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            out = []
            for row in range(len(batch)):
                text = data[off[row] : off[row + 1]]
                runs = batch.column(2)[row].as_py() or []
                spans = merged([r for r in runs if r["a"] != MARK])
                keep, at = hashlib.sha256(), 0
                for a, b in spans:
                    keep.update(text[at:a])
                    at = b
                keep.update(text[at:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), keep.hexdigest(), int(any(r["a"] == MARK for r in runs)), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [batch.column(0), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32()), pa.array(cols[5], kind)]
            made = dict(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", "spans"], made, strict=True))
            if not words:
                del made["shares_passage"]
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return run


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@staged
def dedup(docs: DataFrame, *, length: int = 400, reach: int = 256, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte ranges) of every row.

    With words (33 to 64) also shares_passage, int: 1 if the text has so many words in a row that another row has too, in
    however few bytes.  It removes nothing."""
    if not 2 * reach >= length > reach + 15 or length < 272:
        raise ValueError("needs 272 <= length and reach + 15 < length <= 2 * reach")
    if words and not 33 <= words <= 64:
        raise ValueError("needs 33 <= words <= 64, or 0 for none")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), F.xxhash64("text").alias("th"), "text", "doc_id")
    marked = sharing(rows, words) if words else None
    anchors = rows.select("doc", "th", "text").mapInArrow(anchor_rows(length, reach), ANCHORS)
    buckets = anchors.groupBy("key").agg(F.count("*").alias("c"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("c > 1")
    shared = stage(anchors.join(buckets.select("key", (F.col("s0") != F.col("s1")).alias("mixed")), "key"), "shared")
    release(docs.sparkSession)
    # one kind of segment in the bucket: all windows repeat
    plain = shared.where("not mixed").select("doc", "th", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("key", "seg").agg(F.count("*").alias("c"), F.min("doc").alias("d0"))
    mixed = stage(mixed.join(kinds, ["key", "seg"]), "mixed")
    whole = mixed.where("c > 1").select("doc", "th", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    # single segments, and one text of those that repeat: their bytes, run by run and then window by window
    asked = mixed.where("c = 1 or doc = d0").groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi", "key", "seg", "anchor")).alias("spans"))
    fragments = rows.join(asked, ["doc", "th"]).select("doc", "th", "text", "spans").mapInArrow(fragment_rows(length), f"{ANCHORS}, body binary")
    fragments = stage(fragments, "fragments")
    release(docs.sparkSession)
    runs = stage(fragments.mapInArrow(interval_rows(length), "doc long, th long, seg long, lo long, a long, b long, inside long, around long"), "runs")
    met = lambda df, name: df.groupBy(name).agg(F.min("seg").alias("s0"), F.max("seg").alias("s1")).where("s0 <> s1").select(name)
    part = runs.join(met(runs, "inside"), "inside")
    part = stage(part.join(met(part, "around").withColumn("full", F.lit(True)), "around", "left").select("doc", "th", "seg", "lo", "a", "b", "inside", "around", F.col("full").isNotNull().alias("full")), "part")
    drop_stage(runs)
    covered = part.where("full").select("doc", "th", "a", (F.col("b") + length).alias("b"))
    rest = part.where("not full")  # and, to compare them with, one of each kind of repeated run that shares their bytes
    kind = F.min(F.struct("doc", "th", "seg", "lo", "a", "b")).alias("r")
    shown = part.where("full").join(rest.select("inside").distinct(), "inside", "left_semi").groupBy("inside", "around").agg(kind).select("r.*")
    open_runs = rest.select("doc", "th", "seg", "lo", "a", "b").unionByName(shown).groupBy("doc", "th", "seg", "lo").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    windows = fragments.join(open_runs, ["doc", "th", "seg", "lo"]).select("doc", "th", "key", "seg", "lo", "body", "runs").mapInArrow(window_rows(length), "doc long, th long, name long, seg long, at long")
    windows = stage(windows, "windows")
    drop_stage(fragments)
    release(docs.sparkSession)
    hits = windows.join(met(windows, "name"), "name").select("doc", "th", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    runs = plain.union(whole).union(covered).union(hits)
    if words:
        runs = runs.union(marked.select("doc", "th", F.lit(MARK).cast("long").alias("a"), F.lit(MARK).cast("long").alias("b")))
    runs = runs.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = rows.join(runs, ["doc", "th"], "left").select("doc_id", "text", "runs")
    more = "shares_passage int, " if words else ""
    return joined.mapInArrow(cut_rows(words), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {more}spans array<struct<start:long,end:long>>")
