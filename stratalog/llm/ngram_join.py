"""N-gram Jaccard join by partitioning the universe of shingles.

A document is the set of its distinct word shingles.  Documents with equal sets are one class.  Two classes
within the threshold differ in at most H shingles, H following from the larger size; sizes are cut into
bands with one H each.  In a band, shingles are hashed into segments.  If segment i may differ in t_i
shingles (0: equal, 1: one deletion apart) and the sum of t_i + 1 exceeds H, a linked pair agrees in some
segment, so classes are indexed by their segments, and by the one-deletion neighbourhoods of the segments
that have t_i = 1.  How many segments of either kind a band has is the cheapest allocation between rows to
write and expected collisions.  A band has a few segments more than it needs: as far as they go, a set's empty segments
and those of its most frequent shingles - equal in many sets that share no more than a passage - are not indexed.

Classes that share an index entry form candidate groups.  Groups of at most ``most`` sets are compared in one task, or, if they
have more than ``whole`` shingles together, in one task for each part of the universe.  In larger groups nothing is paired with everything: a member in the middle
of a bounded sample is the group's center, and each set is stored as its difference from it.  The distance of two
sets is the size of the difference of their differences, so

* what is near the center is linked with it without a join;
* a pair with a member that is far has a common part of both differences that is at least half of either (the
  bounds are in ``prefixes``), so it shares one of the first elements of either difference.  Elements are
  ordered from rare to frequent (own shingles before missing ones, by their counts in the sample), so only
  these first ones are listed;
* pairs whose sizes are too far apart, whose parity sketches differ in more bits than linked sets may, or whose differences
  are too short from a listed element on are dropped before their differences meet;
* in rounds, the least member of each listed element is compared with the element's members of other
  components, one row each; what still shares a listed element across components is compared in pairs.

Both ways verify exactly, on whole sets.

Nulls: null texts, empty texts and texts without words have no set and are linked with nothing.  A null
doc_id is never a component id unless all of its component are null.  Repeated rows are copies.  An empty table
gives no rows.  Other columns of the input, whatever their names, are not looked at.  Texts of any length are read
whole; a set is held by one task at a time.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD, hash64, lean, mix, release, slices, stage, staged, text_array
from .graph import components

INDEXED = "doc_id long, th long, n_shingles long, key long, key2 long"


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the n-word shingles (of the whole text if it has fewer words)."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hash64(words)
    k = min(n, len(h))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = mix(out, h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Bands:
    """Size bands and the allocation of their segments, for sets linked when den * common >= num * union.

    ``levels`` orders shingles from rare to frequent (see levels_of); without it all are alike."""

    def __init__(self, num: int, den: int, rows: int, levels: np.ndarray | None = None):
        self.num, self.den, self.rows = num, den, max(rows, 1)
        self.levels = np.zeros(1, np.uint8) if levels is None else levels
        self.first, self.last, self.plan = [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low, low * 5 // 4)
            self.first.append(low)
            self.last.append(high)
            self.plan.append(self.allocate(low, high))
            low = high + 1

    def allocate(self, low: int, high: int, alike: float = 0.3, partners: int = 100) -> tuple[int, int, int]:
        """How many segments are indexed as they are, how many with their one-deletion neighbourhood, and how many
        agreements the index may leave out.

        The cost of a set is its entries and its collisions, counted for at most ``partners`` other sets that share
        the part ``alike`` of its shingles (a passage) without being linked.  A third more than is needed lets sets leave out
        what they hold of passages, if these are up to about a third of a set."""
        most = 2 * high * (self.den - self.num) // (self.den + self.num)
        if most == 0:
            return 0, 0, 0  # linked sets are equal ones
        best = None
        for deletions in sorted({0, (most + 1) // 8, (most + 1) // 4, (most + 1) // 2, (most + 2) // 2}):
            equal = max(0, most + 1 - 2 * deletions) + (most + 2) // 3
            while True:
                m, room = equal + deletions, equal + 2 * deletions - most - 1
                s = low / m
                empty = math.exp(-s)
                lost = equal * empty + deletions * (2 + s) * empty
                if room >= lost + 3 * math.sqrt(2 * lost) or m >= low:
                    break
                equal += max(1, most // 64)
            own = math.exp(-2 * s * (1 - alike)) * (1 - math.exp(-s * alike)) * min(self.rows, partners)
            cost = equal * (1 - empty + own) + deletions * (1 + s + own * (1 + s * (1 - alike)) ** 2)
            if best is None or cost < best[0]:
                best = (cost, equal, deletions, room)
        return best[1:]

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.last, size))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        band = self.of(len(s))
        out = [self.in_band(s, band)]
        if len(s) * self.den >= self.num * self.first[band + 1]:  # may be linked with a set of the next band
            out.append(self.in_band(s, band + 1))
        return np.concatenate(out)

    def most_entries(self, size: int) -> int:
        """No set of so many shingles has more entries."""
        at = self.of(size)
        return sum(min(size, sum(self.plan[b][:2])) + (size if self.plan[b][1] else 0) for b in (at, at + 1))

    def in_band(self, s: np.ndarray, band: int) -> np.ndarray:
        """The entries of a set in a band, but for those of the most frequent shingles.

        An entry's level is that of its rarest shingle, and that of no shingles is above all others; of one level, segments
        differ by their numbers.  Entries above a bound are left out, the lowest bound with which at most ``room`` agreements
        can be lost.  An entry has the same level and number in both sets of a pair, so the set with the lower bound has
        counted all that the two leave out."""
        equal, deletions, room = self.plan[band]
        m = equal + deletions
        if not m:
            return np.zeros(0, np.uint64)
        level = self.levels[s & np.uint64(len(self.levels) - 1)].astype(np.int64)
        seg = ((s >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        order = np.lexsort((level, seg))
        s, seg, level = s[order], seg[order], level[order]
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, s)
        place = np.arange(m, dtype=np.uint64) + np.uint64(band << 32)
        count = np.bincount(seg, minlength=m)
        start = np.cumsum(count) - count
        padded = np.concatenate([level, [NOTHING, NOTHING]])
        least = np.where(count > 0, padded[start], NOTHING) * m + np.arange(m)
        second = np.where(count > 1, padded[start + 1], NOTHING) * m + np.arange(m)
        # what a pair can lose: an agreement of a segment whose own entry is left out, and of a segment with deletions
        # one more where the entry without its rarest shingle is left out
        bound = np.sort(np.concatenate([least, second[:deletions]]))[::-1][room]
        out = [mix(sums, place)[least <= bound]]
        if deletions:
            rarest = np.arange(len(s)) == start[seg]
            take = (seg < deletions) & (np.where(rarest, second[seg], least[seg]) <= bound)
            near, where = s[take], seg[take]
            out.append(mix(sums[where] - near, place[where]))
        return np.concatenate(out)


#: Above the levels of all shingles.
NOTHING = 255


def table_bits(shingles: int) -> int:
    """Bits of the table of levels: so many entries that at most 64 shingles of sets meet in one by chance (32 MB at most).

    In a table that does not grow, what meets by chance hides passages that a few hundred texts share, and with the input
    ever more of these join groups."""
    return min(25, max(20, (max(shingles, 1) - 1).bit_length() - 6))


#: Entries of the table of levels that are exchanged together.
BLOCK = 1 << 16


def levels_of(docs: DataFrame, n: int, bits: int = 20) -> np.ndarray:
    """How frequent shingles are, in half powers of two, by the last ``bits`` bits of their names (a table of 2 ** bits bytes).

    Counts are over all texts, combined in the scan and exchanged packed, in blocks; equal sets that a task meets together
    count once.  Shingles with the same bits are counted together, which blurs the order and costs no link."""
    most = 1 << bits

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total, held, seen, size = np.zeros(most, np.uint32), [], set(), 0

        def add() -> None:
            at, count = np.unique(np.concatenate(held), return_counts=True)
            total[at] += count.astype(np.uint32)

        for batch in batches:
            for t in text_array(batch.column(0)):
                s = shingles(t.as_py(), n)
                if len(s) and (k := set_key(s)) not in seen:
                    seen.add(k)
                    held.append((s & np.uint64(most - 1)).astype(np.int64))
                    size += len(s)
                if size > 1 << 20:
                    add()
                    held, seen, size = [], set(), 0
        if held:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, part in enumerate(total.reshape(-1, BLOCK)):
            if part.any():
                planes = part.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(planes)], pa.binary())], ["block", "counts"])

    @lean
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def level(block: int, total: np.ndarray) -> pa.RecordBatch:
            out = np.minimum(np.floor(2 * np.log2(np.maximum(total, 1))), NOTHING - 1).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "level"])

        at, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at and at is not None:
                    yield level(at, total)
                    total = np.zeros(BLOCK, np.int64)
                at = block
                total += np.frombuffer(unpack(blob.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        if at is not None:
            yield level(at, total)

    found = docs.select("text").mapInArrow(run, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    found = found.mapInArrow(summed, "block int, level binary").toArrow()
    out = np.zeros(most, np.uint8)
    for block, level in zip(found.column("block").to_pylist(), found.column("level").to_pylist(), strict=True):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(level, np.uint8)
    return out


def index(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the text's hash, n_shingles and the 128-bit name of the set of every row (docs: doc_id, text, th)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in slices(off, 1 << 20):
                sets = [shingles(t, n) for t in texts.slice(i, j - i).to_pylist()]
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys]))], ["doc_id", "th", "n_shingles", "key", "key2"])

    return docs.mapInArrow(run, INDEXED)


def first_of_runs(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by sig: where each run starts, and the row's start of run."""
    start = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    at = np.flatnonzero(start)
    return at, np.repeat(at, np.diff(np.concatenate([at, [len(sig)]])))


#: Bits of an entry and of a class that are exchanged.  What two of either have in common by chance only makes a group larger.
SIG_BITS, NAME_BITS = 56, 40
MARKS = "<IB"  # rows, bytes of a step


def packed_marks(sig: np.ndarray, name: np.ndarray, base: int) -> bytes:
    """Entries sorted by sig, all at least base: steps and names, byte by byte of all rows, so that the steps' empty bytes vanish."""
    import zstandard

    step = np.diff(sig, prepend=np.uint64(base))
    k = max(1, (int(step.max()).bit_length() + 7) // 8)
    planes = lambda x, k: x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()
    return struct.pack(MARKS, len(sig), k) + zstandard.ZstdCompressor(level=1).compress(planes(step, k) + planes(name, NAME_BITS // 8))


def unpacked_marks(blob: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, k = struct.unpack_from(MARKS, blob)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[struct.calcsize(MARKS) :]), np.uint8)

    def column(planes: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, : len(planes) // n] = planes.reshape(-1, n).T
        return out.view(np.uint64).ravel()

    return np.cumsum(column(body[: n * k]), dtype=np.uint64) + np.uint64(base), column(body[n * k :])


def bases(parts: int) -> list[int]:
    """The least entry of each part of all entries, and the end."""
    return [(p << SIG_BITS) // parts for p in range(parts + 1)]


def marks_of(docs: DataFrame, bands: Bands, n: int, parts: int, most: int = 1 << 21) -> DataFrame:
    """part, marks: the index entries of every class and the class's name, combined in the scan and packed by part.

    Of the classes that a task meets together (``most`` entries) and that share an entry, the least keeps it; each other one gets an entry that only the
    two of them have.  So a common entry is a few rows for each
    task, not one for each document."""
    cuts = bases(parts)

    def combined(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate(list(found.values()))
        key = np.repeat(np.fromiter(found, np.int64, len(found)), [len(v) for v in found.values()])
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        at, first = first_of_runs(sig, key)
        twin = np.flatnonzero(key != key[first])
        pair = np.unique(np.stack([key[first[twin]], key[twin]], 1), axis=0)
        own = mix(pair[:, 0].view(np.uint64).copy(), pair[:, 1].view(np.uint64).copy())
        sig = np.concatenate([sig[at], own, own]) >> np.uint64(64 - SIG_BITS)
        name = np.concatenate([key[at], pair[:, 0], pair[:, 1]]).view(np.uint64) >> np.uint64(64 - NAME_BITS)
        order = np.argsort(sig, kind="stable")
        sig, name = sig[order], name[order]
        at = np.searchsorted(sig, np.array(cuts, np.uint64))
        held = np.flatnonzero(np.diff(at))
        for lo in range(0, len(held), 16):
            some = held[lo : lo + 16].tolist()
            blobs = [packed_marks(sig[at[p] : at[p + 1]], name[at[p] : at[p + 1]], cuts[p]) for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "marks"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for t in text_array(batch.column(0)):
                s = shingles(t.as_py(), n)
                if len(s) and (k := set_key(s)[0]) not in found:
                    found[k] = bands.signatures(s)
                    size += len(found[k])
                if size > most:
                    yield from combined(found)
                    found, size = {}, 0
        if size:
            yield from combined(found)

    return docs.select("text").mapInArrow(run, "part int, marks binary")


def stars(parts: int):
    """src, dst: the least name of each entry with its other names, from packed rows sorted by part."""
    cuts = bases(parts)

    def linked(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        sig, name = (np.concatenate(x) for x in zip(*(unpacked_marks(b, cuts[part]) for b in blobs), strict=True))
        order = np.argsort(sig, kind="stable")
        sig, name = sig[order], name[order]
        same = sig[1:] == sig[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sig, name = sig[several], name[several]
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        lead = name[first_of_runs(sig, name)[1]]
        edge = np.flatnonzero(name != lead)
        pair = np.unique(np.stack([lead[edge], name[edge]], 1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["src", "dst"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != at and held:
                    yield linked(at, held)
                    held = []
                at = part
                held.append(blob.as_py())
        if held:
            yield linked(at, held)

    return run


def near_of(docs: DataFrame, classes: DataFrame, bands: Bands, n: int, per_part: int = 1 << 21) -> DataFrame:
    """src, dst: names of classes that share an index entry, as the edges of stars."""
    spark = docs.sparkSession
    sizes = classes.groupBy(F.floor(3 * F.log2("n"))).agg(F.max("n").alias("n"), F.count("*").alias("rows")).collect()
    entries = sum(r.rows * bands.most_entries(r.n) for r in sizes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // per_part))
    marks = marks_of(docs, bands, n, parts).repartition(parts, "part").sortWithinPartitions("part")
    return marks.mapInArrow(stars(parts), "src long, dst long").distinct()


def near_name(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - NAME_BITS)


def sets_of(found: DataFrame, n: int) -> DataFrame:
    """g, members, key, n and the set of every wanted row (found: text, want, g, members)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(0))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            want = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(off, 1 << 20):
                sets = [shingles(t, n) for t in texts.slice(i, j - i).to_pylist()]
                keep = [k for k, s in enumerate(sets) if set_key(s)[0] == want[i + k]]
                take = pa.array([i + k for k in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(3).take(take), batch.column(1).take(take), pa.array([len(sets[k]) for k in keep], pa.int64()), arrays([sets[k].view(np.int64) for k in keep])], ["g", "members", "key", "n", "elements"])

    return found.select("text", "want", "g", "members").mapInArrow(run, "g long, members long, key long, n long, elements array<long>")


def arrays(rows: list[np.ndarray]) -> pa.ListArray:
    off = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def lists(col: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, as views of its values."""
    off, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """g and the distinct (key, n, elements) of each group, from rows (g, key, n, elements) sorted by g and key."""
    at, rows = None, []
    for batch in batches:
        g, key, n = (batch.column(k).to_pylist() for k in range(3))
        for row in zip(g, key, n, lists(batch.column(3)), strict=True):
            if row[0] != at:
                if rows:
                    yield at, rows
                at, rows = row[0], []
            if not rows or rows[-1][0] != row[1]:
                rows.append((row[1], row[2], row[3].copy()))
    if rows:
        yield at, rows


def commons(rows: list[tuple]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    elements = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    names, number, count = np.unique(elements, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[number] > 1
    out = np.zeros((len(rows), len(rows)), np.int64)
    owner, number = owner[keep], shared[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 1 << 14):
        a, b = np.searchsorted(number, [lo, lo + (1 << 14)])
        has = np.zeros((len(rows), int(number[b - 1]) - lo + 1), np.float32)
        has[owner[a:b], number[a:b] - lo] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


def small_links(num: int, den: int):
    """Links of the groups that come whole: a spanning set of them, exactly verified."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for _, rows in grouped(batches):
            common, size = commons(rows), np.array([len(r[2]) for r in rows])
            a, b = np.nonzero(np.triu(den * common >= num * (size[:, None] + size[None, :] - common), 1))
            root = list(range(len(rows)))

            def find(k, root=root):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if find(i) != find(j):
                    root[find(j)] = find(i)
                    src.append(rows[i][0])
                    dst.append(rows[j][0])
            if len(src) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def parts_of(found: DataFrame, n: int) -> DataFrame:
    """part, key, n and the shingles of every wanted row in each part of the universe (found: text, want, g, parts)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, gs, counts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for text, key, g, parts in zip(text_array(batch.column(0)), wanted, gs, counts, strict=True):
                s = shingles(text.as_py(), n)
                if set_key(s)[0] != key:
                    continue
                part = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(parts + 1))
                held = np.flatnonzero(np.diff(at))
                names = mix(np.full(len(held), g, np.int64).view(np.uint64), held.astype(np.uint64)).view(np.int64)
                same = [pa.array(np.full(len(held), x, np.int64)) for x in (key, len(s))]
                yield pa.RecordBatch.from_arrays([pa.array(names), *same, arrays([s[order[at[p] : at[p + 1]]].view(np.int64) for p in held])], ["part", "key", "n", "elements"])

    return found.select("text", "want", "g", "parts").mapInArrow(run, "part long, key long, n long, elements array<long>")


def split_links(found: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links of groups of a few long sets: what each two have in common is counted in parts of the universe that come whole,
    and added up (found: text, want, g, parts)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            common, key, size = commons(rows), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            near = den * np.minimum(size[:, None], size) >= num * np.maximum(size[:, None], size)
            a, b = np.nonzero(np.triu(near & (common > 0), 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[a], key[b], size[a] + size[b], common[a, b])], ["src", "dst", "both", "common"])

    parts = parts_of(found, n).repartition("part").sortWithinPartitions("part", "key")
    met = parts.mapInArrow(run, "src long, dst long, both long, common long").groupBy("src", "dst", "both").agg(F.sum("common").alias("common"))
    return met.where(den * F.col("common") >= num * (F.col("both") - F.col("common"))).select("src", "dst")


@lean
def centers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, center, base and often of each sampled group: the key and the set of the member nearest to what more than
    half of the sample have, and the elements that several of the sample's differences from it have, rare ones first."""
    for g, rows in grouped(batches):
        names, count = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
        middle = names[2 * count > len(rows)]
        key, _, base = min(rows, key=lambda r: (len(np.setxor1d(r[2], middle, assume_unique=True)), r[0]))
        apart = [np.setxor1d(r[2], base, assume_unique=True) for r in rows]
        names, count = np.unique(np.concatenate(apart), return_counts=True)
        often = names[count > 1][np.argsort(count[count > 1], kind="stable")]
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([key], pa.int64()), arrays([base]), arrays([often])], ["g", "center", "base", "often"])


def prefixes(n: int, d: int, cn: int, num: int, den: int) -> tuple[bool, int, int]:
    """Whether a set of n shingles, d from a center of cn, is far from it; how many of the first elements of its
    difference are listed for near partners, and how many for far ones.

    With r = (den - num) / (den + num), sets of n and m shingles are linked if they differ in at most r (n + m).  Two
    sets d and e from the center, with c common elements of their differences, differ in d + e - 2c.  If one is far,
    e > r (m + cn), a link asks for 2c > d - r n + r cn.  A far set asks of a near one, whose e is at least |m - cn|,
    for 2c >= d - r (n + cn), which is positive.  Sets with at least c common elements share one of the first d - c + 1
    of either, in any one order."""
    up, all_ = den - num, den + num
    far = all_ * d > up * (n + cn)
    short = d - (all_ * d + up * (cn - n)) // (2 * all_)
    long = d - -(-(all_ * d - up * (n + cn)) // (2 * all_)) + 1 if far else 0
    return far, min(d, max(0, long)), min(d, max(0, short))


SKETCH = 4
DIFFERENCES = f"g long, key long, center long, n long, d long, far boolean, long int, short int, diff array<long>, sketch struct<{', '.join(f's{k}:long' for k in range(SKETCH))}>, wide array<long>, half array<long>"


def sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Parities of the elements by 64 * words bits: two sets differ in at least as many elements as their sketches
    differ in bits."""
    at = ((s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * words)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def apart(a: str, b: str) -> Column:
    """In how many bits the sketches in columns a and b differ."""
    return sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


def differences(n: int, num: int, den: int):
    """DIFFERENCES of the wanted rows (text, want, g, center, base, often): elements from rare to frequent.

    Sets are made where they are compared with their center, so neither they nor a second Python worker are between."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(0))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in slices(off, 1 << 20):
                yield differing(batch.slice(i, j - i), n, num, den)

    return run


def differing(batch: pa.RecordBatch, n: int, num: int, den: int) -> pa.RecordBatch:
    out, diffs, marks, wide = [], [], [], []
    wanted, gs, cs = (batch.column(k).to_pylist() for k in (1, 2, 3))
    for text, key, g, c, base, often in zip(text_array(batch.column(0)), wanted, gs, cs, *(lists(batch.column(k)) for k in (4, 5)), strict=True):
        own = shingles(text.as_py(), n)
        if set_key(own)[0] != key:
            continue
        own = own.view(np.int64)
        more, missing = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
        diff = np.concatenate([more, missing])
        order = np.argsort(often, kind="stable")
        rank = np.zeros(len(diff), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, diff, sorter=order), len(often) - 1)
            rank = np.where(often[order[at]] == diff, order[at] + 1, 0)
        diff = diff[np.lexsort((diff, np.arange(len(diff)) >= len(more), rank))]
        diffs.append(diff)
        marks.append(sketch(own, SKETCH))
        # at least 3 bits for each element that linked sets may differ in; folded once for partners of the class below
        wide.append(sketch(own, max(8, 1 << (6 * len(own) * (den - num) // (64 * (den + num))).bit_length())))
        out.append((g, key, c, len(own), len(diff), *prefixes(len(own), len(diff), len(base), num, den)))
    cols = list(zip(*out, strict=True)) if out else [[]] * 8
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.int32()]
    bits = np.array(marks, np.int64).reshape(-1, SKETCH)
    bits = pa.StructArray.from_arrays([pa.array(bits[:, k].copy()) for k in range(SKETCH)], [f"s{k}" for k in range(SKETCH)])
    return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(cols, kinds, strict=True)), arrays(diffs), bits, arrays(wide), arrays([w[: len(w) // 2] ^ w[len(w) // 2 :] for w in wide])], ["g", "key", "center", "n", "d", "far", "long", "short", "diff", "sketch", "wide", "half"])


def large_links(found: DataFrame, n: int, num: int, den: int, sample: int, rounds: int = 2) -> DataFrame:
    """Links that connect what is connected in large groups (found: text, want, g, members)."""
    drawn = sets_of(found.where(F.pmod(F.xxhash64("want"), F.ceil(F.col("members") / sample)) == 0), n)
    middle = drawn.select("g", "key", "n", "elements").repartition("g").sortWithinPartitions("g", "key")
    middle = stage(middle.mapInArrow(centers, "g long, center long, base array<long>, often array<long>"), "centers")
    none = F.array().cast("array<long>")  # a group that the sample misses has an empty center
    met = found.join(middle, "g", "left").select("text", "want", "g", "center", F.coalesce("base", none).alias("base"), F.coalesce("often", none).alias("often"))
    rows = stage(met.mapInArrow(differences(n, num, den), DIFFERENCES), "differences")
    release(rows.sparkSession)
    links = stage(rows.where("not far and key <> center").select(F.col("center").alias("src"), F.col("key").alias("dst")), "links")
    open_groups = stage(rows.where("far").select("g").distinct(), "open")
    if open_groups.limit(1).count() == 0:
        return links
    opened = rows.join(bounded(open_groups, 100_000), "g", "left_semi")
    # name of (g, element), key, far, brief, at: listed elements that a far member and another one have, and their places
    first = F.slice("diff", 1, F.greatest("long", "short", F.lit(0)))
    listed = opened.where("long > 0 or short > 0").select("g", "key", "far", "short", F.posexplode(first).alias("at", "e"))
    listed = listed.select(F.xxhash64("g", "e").alias("e"), "key", "far", (F.col("at") < F.col("short")).alias("brief"), "at")
    listed = listed.repartition("e").sortWithinPartitions("e", F.desc("far"), "key").mapInArrow(met_elements, "e long, key long, far boolean, brief boolean, at int")
    listed = stage(listed, "listed")
    release(rows.sparkSession)
    comp = F.when(F.col("far"), F.col("key")).otherwise(F.col("center")).alias("comp")
    of = stage(opened.select("key", "g", "n", "d", "sketch", "wide", "half", comp), "of")
    x, y = (of.select(F.col("key").alias(c), *(F.col(k).alias(c + k) for k in ("g", "n", "wide", "half"))) for c in "xy")
    x, y = bounded(x, 100_000), bounded(y, 100_000)
    count = lambda p, q: F.aggregate(F.zip_with(p, q, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda v, w: v + w)
    long, other = F.size("xwide"), F.size("ywide")
    bits = F.when(long == other, count("xwide", "ywide")).when(long == 2 * other, count("xhalf", "ywide")).when(2 * long == other, count("xwide", "yhalf")).otherwise(0)
    alike = (F.col("xg") == F.col("yg")) & (den * F.col("xn") >= num * F.col("yn")) & (den * F.col("yn") >= num * F.col("xn")) & ((den + num) * bits <= (den - num) * (F.col("xn") + F.col("yn")))

    def checked(asked: DataFrame) -> DataFrame:
        """src, dst of the asked pairs (x, y) that are linked."""
        asked = stage(asked.distinct().join(x, "x").join(y, "y").where(alike).select("x", "y"), "asked")
        out = stage(verified(asked, rows, num, den), "links")
        release(rows.sparkSession)
        return out

    comps = of.select("key", "comp")
    for _ in range(rounds):
        now = listed.join(bounded(of.select("key", "d").join(comps, "key"), 100_000), "key")
        tops = now.groupBy("e").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("d", "key", "comp")).alias("top")).where("c0 <> c1").select("e", "top")
        more = checked(now.join(tops, "e").where("comp <> top.comp").select(F.col("top.key").alias("x"), F.col("key").alias("y")))
        if more.limit(1).count() == 0:
            break
        links = stage(links.unionByName(more), "links")
        now = components(links).withColumnRenamed("comp", "now")
        comps = stage(comps.join(now, F.col("key") == F.col("id"), "left").select("key", F.coalesce("now", "comp").alias("comp")), "comps")
    now = listed.join(bounded(of.select("key", "n", "d", "sketch").join(comps, "key"), 100_000), "key")
    left = stage(now.join(now.groupBy("e").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("e"), "e"), "left")
    a = left.where("far").select("e", F.col("key").alias("x"), F.col("comp").alias("xc"), F.col("n").alias("xn"), F.col("brief").alias("xb"), F.col("sketch").alias("xs"), F.col("d").alias("xd"), (F.col("d") - F.col("at")).alias("xr"))
    b = left.where("brief").select("e", F.col("key").alias("y"), F.col("comp").alias("yc"), F.col("n").alias("yn"), F.col("far").alias("yf"), F.col("sketch").alias("ys"), F.col("d").alias("yd"), (F.col("d") - F.col("at")).alias("yr"))
    met = (a["e"] == b["e"]) & (F.col("xc") != F.col("yc")) & (~F.col("yf") | F.col("xb") & (F.col("x") < F.col("y")))
    most = (den - num) * (F.col("xn") + F.col("yn"))
    near = ((den + num) * apart("xs", "ys") <= most) & (den * F.col("xn") >= num * F.col("yn")) & (den * F.col("yn") >= num * F.col("xn"))
    # a linked pair passes at its first common element: all that the differences have in common stands from there on
    near = near & ((den + num) * (F.col("xd") + F.col("yd") - 2 * F.least("xr", "yr")) <= most)
    return links.unionByName(checked(a.join(b, met & near).select("x", "y")))


@lean
def met_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by e, far ones first: those of the elements that have several rows and a far one."""
    names = ["e", "key", "far", "brief", "at"]
    held, last, passing = None, None, False  # a single row that waits; the last element, and whether its rows pass
    for batch in batches:
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, names)])
        if held is not None:
            table, held = pa.concat_tables([held, table]), None
        e, far = (table.column(k).to_numpy() for k in (0, 2))
        if not len(e):
            continue
        at, first = first_of_runs(e, e)
        several = np.repeat(np.diff(np.concatenate([at, [len(e)]])) > 1, np.diff(np.concatenate([at, [len(e)]])))
        keep = several & far[first]
        if last is not None and e[0] == last:
            keep[e == last] = passing
        waits = at[-1] == len(e) - 1 and e[-1] != last
        last_was, last = last, e[-1]
        passing = passing if e[-1] == last_was else bool(keep[-1])
        if waits:
            held, last = table.slice(len(e) - 1), last_was if last_was != e[-1] else None
            keep[-1] = False
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def verified(asked: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """src, dst of the asked pairs (x, y) that are linked, by the size of the difference of their differences."""
    asked = bounded(asked, 200_000)
    side = lambda c: rows.select(F.col("key").alias(c), F.col("n").alias(f"{c}n"), F.col("d").alias(f"{c}d"), F.col("diff").alias(f"{c}diff")).join(asked, c)
    away = F.col("xd") + F.col("yd") - 2 * F.size(F.array_intersect("xdiff", "ydiff"))
    near = (den + num) * away <= (den - num) * (F.col("xn") + F.col("yn"))
    return side("x").join(side("y"), ["x", "y"]).where(near).select(F.col("x").alias("src"), F.col("y").alias("dst"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joined(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, whole: int = 1 << 16, most: int = 64, sample: int = 32, broadcast_rows: int = 500_000) -> DataFrame:
    """The columns of join, and th, key, key2 and comp: the hash of a row's text, the names of its set and of its
    component.  Groups of at most ``most`` sets are compared in one task, or in parts of about ``whole`` shingles.
    Members of groups reach the texts by a broadcast if they are at most ``broadcast_rows`` (48 bytes each)."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = stage(index(docs, n), "index")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = rows.where("n_shingles > 0").groupBy("key", "key2").agg(rep, F.max("n_shingles").alias("n"), F.count("*").alias("n_copies"))
    classes = stage(classes.select("key", "key2", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "n", "n_copies"), "classes")
    held = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bands = Bands(num, den, rows.count(), levels_of(docs, n, table_bits(held)))
    release(docs.sparkSession)
    near = stage(near_of(docs, classes, bands, n), "near")
    release(docs.sparkSession)
    groups = components(near).withColumnRenamed("comp", "g")
    met = stage(groups.join(classes, F.col("id") == near_name("key")).select("g", "key", "n", "rep", "th"), "met")
    sized = stage(met.groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1"), "sized")
    want = stage(met.join(sized, "g").select(F.col("rep").alias("doc_id"), "th", F.col("key").alias("want"), "g", "members", "total"), "want")
    # a row for each text that is asked for, with or without an id
    same = (F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))) & (F.col("d.th") == F.col("w.th"))
    source = docs
    if rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        source = docs.dropDuplicates(["doc_id", "th"])
    few, short = F.col("members") <= most, F.col("total") <= whole
    at_hand = want.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = source.alias("d").join((F.broadcast(want) if at_hand else want).alias("w"), same).select("d.text", "w.want", "w.g", "w.members", "w.total")
    met = met if at_hand else stage(met, "texts")  # beyond that size, texts are shuffled once
    found = met.where  # met by a broadcast, texts stay where they are and each use reads them again
    small = sets_of(found(few & short), n).select("g", "key", "n", "elements").repartition("g").sortWithinPartitions("g", "key")
    links = stage(small.mapInArrow(small_links(num, den), "src long, dst long"), "small")
    if sized.where(few & ~short).limit(1).count():
        parts = found(few & ~short).withColumn("parts", F.ceil(F.col("total") / whole).cast("long"))
        links = stage(links.unionByName(split_links(parts, n, num, den)), "links")
    if sized.where(~few).limit(1).count():
        links = stage(links.unionByName(large_links(found(~few), n, num, den, sample)), "links")
    parts = components(links)
    named = parts.join(classes, F.col("id") == F.col("key")).groupBy("comp").agg(F.min("rep").alias("component_id"))
    names = parts.join(named, "comp").select(F.col("id").alias("key"), "component_id", "comp")
    classes = classes.join(names, "key", "left").select("key", "key2", F.coalesce("component_id", "rep").alias("component_id"), "n_copies", "comp")
    out = rows.join(classes, ["key", "key2"], "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "key", "key2", F.coalesce("comp", "key").alias("comp"))


@staged
def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows with an equal set), in any order; one row a document."""
    return joined(docs, **options).select("doc_id", "n_shingles", "component_id", "n_copies")


@staged
def representatives(docs: DataFrame, **options) -> DataFrame:
    """doc_id, th and n (rows with both) of the row that stands for each component: the one with the least doc_id (null
    last), and of rows with that id the one with the least set key and text hash."""
    found = stage(joined(docs, **options).where("n_shingles > 0").select("doc_id", "th", "key", "key2", "comp"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "key2", "th")).alias("r")
    first = found.groupBy("comp").agg(first).select(F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"))
    count = found.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    return first.alias("a").join(count.alias("b"), same).select("a.doc_id", "a.th", "b.n")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component (see representatives); rows without words all stay.

    Rows whose id is null or repeated are told apart by their texts.  Of rows with the same id and text, any one stays.
    Columns of any name are carried along."""
    held = representatives(docs, **options)
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("words"))
    same = F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.th") == F.col("h.th"))
    spoken = rows.where("words").alias("r")
    out = rows.where("not words").unionByName(spoken.join(held.where("n = 1").alias("h"), same, "left_semi"))
    several = held.where("n > 1")
    if several.limit(1).count():
        out = out.unionByName(spoken.join(several.alias("h"), same, "left_semi").dropDuplicates(["doc_id", "th"]))
    return out.select("row.*")
