"""Cost-balanced packing of tokenised documents.

Attention over a piece of L tokens costs ``linear * L + quadratic * L * L``.  Documents are tokenised
once, in the scan.  What moves on is a row for each piece (no ids): a document gives whole pieces of
``capacity`` tokens, which fill a sequence alone, and one remainder.  Remainders are dealt by hash into
groups of about ``group_tokens`` tokens; in a group, pieces go in descending order to the cheapest
sequence with room.  A piece that fits nowhere is cut on a grid of ``grid`` tokens; checksums of the
cuts come from prefix checksums carried on that grid, so no text is read twice.

Nulls: a null text is empty (one end token); a null doc_id stays null.  Repeated rows are packed each.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, stage, text_array

END_ID = 2
PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, prefix binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks that need no normalisation but A-Z: printable ASCII and Latin-1 letters.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own split, on such chunks after lower-casing (a fixed value of its file).
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ChunkEncoder:
    """Ids of a text as little-endian bytes, equal to the tokenizer's.

    The tokenizer drops white space, so chunks between white space are encoded by themselves and
    remembered; a new plain chunk is put together from remembered parts, any other goes through the
    whole tokenizer. Either memory holds ``keep`` entries and the last ``keep`` before them, of which those that
    are met again move on: texts of any size take the same memory."""

    def __init__(self, path: str, keep: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.known, self.parts, self.known_before, self.parts_before = {}, {}, {}, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if len(self.parts) >= self.keep:
                self.parts, self.parts_before = {}, self.parts
            got = self.parts_before.get(text)
            if got is None:
                word = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
                got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
            self.parts[text] = got
        return got

    def chunk(self, text: str) -> bytes:
        if len(self.known) >= self.keep:
            self.known, self.known_before = {}, self.known
        got = self.known_before.get(text)
        if got is not None:
            pass
        elif PLAIN.fullmatch(text) and "<|" not in text:
            got = b"".join([self.part(x) for x in PARTS.findall(text.lower())])
        else:
            got = self.whole(text)
        self.known[text] = got
        return got

    def __call__(self, text: str) -> bytes:
        if ODD_SPACE.search(text):  # white space to Python, not to the tokenizer
            return self.whole(text)
        chunk = self.chunk
        return b"".join([self.known.get(c) or chunk(c) for c in text.split()])


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker: its memory serves the worker's later tasks too."""
    import sys

    held = sys.__dict__.setdefault("_stratalog_encoders", {})
    if path not in held:
        held[path] = ChunkEncoder(path)
    return held[path]


def pieces_of(ids: bytes, capacity: int, grid: int) -> Iterator[tuple[int, int, int, bytes]]:
    """start, length, crc32, prefix checksums on the grid (of the remainder only)."""
    n = len(ids) // 4
    for start in range(0, n, capacity):
        part = ids[4 * start : 4 * min(n, start + capacity)]
        if len(part) == 4 * capacity:
            yield start, capacity, zlib.crc32(part), b""
            continue
        crc, prefix = 0, []
        for at in range(0, len(part), 4 * grid):
            crc = zlib.crc32(part[at : at + 4 * grid], crc)
            prefix.append(crc)
        yield start, len(part) // 4, crc, np.array(prefix[:-1], "<u4").tobytes()


def tokenise(path: str, capacity: int, grid: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = text_array(batch.column(1))
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in slices(off, 1 << 20):
                rows = []
                for doc, text in zip(batch.column(0).slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist(), strict=True):
                    ids = encode(text) + end
                    rows += [(doc, len(ids) // 4, *p) for p in pieces_of(ids, capacity, grid)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "prefix"])

    return run


def crc_of_tail(whole: int, head: int, tail_bytes: int) -> int:
    """crc32(B) from crc32(A + B) and crc32(A): the checksum is affine over GF(2)."""
    zeros = bytes(tail_bytes)
    return whole ^ zlib.crc32(zeros, head) ^ zlib.crc32(zeros)


def pack_group(rows: list[tuple], capacity: int, grid: int, linear: float, quadratic: float) -> list[tuple]:
    """rows: (doc_id, doc_tokens, start, length, crc, prefix). Returns (doc_id, start, length, crc,
    doc_tokens, sequence in the group, offset)."""
    rows = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[4]))
    out, whole = [], 0
    while whole < len(rows) and rows[whole][3] == capacity:
        r = rows[whole]
        out.append((r[0], r[2], r[3], r[4], r[1], whole, 0))
        whole += 1
    rows = rows[whole:]
    n = -(-sum(r[3] for r in rows) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)

    def put(doc, tokens, start, length, crc, s):
        nonlocal room, cost
        out.append((doc, start, length, crc, tokens, whole + int(s), int(capacity - room[s])))
        room[s] -= length
        cost[s] += linear * length + quadratic * length * length

    for doc, tokens, start, length, crc, prefix in rows:
        heads = np.frombuffer(prefix, "<u4").astype(np.int64)
        at = 0  # tokens of this piece already placed
        while at < length:
            rest = length - at
            own = crc_of_tail(crc, int(heads[at // grid - 1]), 4 * rest) if at else crc
            if (room >= rest).any():
                put(doc, tokens, start + at, rest, own, np.argmin(np.where(room >= rest, cost, np.inf)))
                break
            s = int(np.argmax(room)) if len(room) else 0
            if not len(room) or room[s] < grid:
                room, cost = np.append(room, capacity), np.append(cost, 0.0)
                continue
            take = int(room[s]) // grid * grid
            head = int(heads[(at + take) // grid - 1])
            put(doc, tokens, start + at, take, crc_of_tail(head, int(heads[at // grid - 1]), 4 * take) if at else head, s)
            at += take
    return out


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 4096, group_tokens: int = 1 << 20, grid: int = 64, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise(path, capacity, grid), PIECES), "pieces")
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_tokens))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        packed = pack_group(list(zip(*(c.to_pylist() for c in group.columns[1:]), strict=True)), capacity, grid, linear, quadratic)
        cols = list(zip(*packed, strict=True))
        first = key[0].as_py() << 24
        return pa.table([pa.array(c, pa.int64()) if k != 5 else pa.array([first + x for x in c], pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).alias("grp"), "*")
    return dealt.groupBy("grp").applyInArrow(run, PACKED)
