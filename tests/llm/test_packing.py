import zlib

import numpy as np
import pytest

from stratalog.llm import packing

from .util import documents, frame

pytest.importorskip("public_tokenizers")


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rows = documents(6)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {}
    for r in rows:
        ids.setdefault((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1), []).append([*tok.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID])
    got = packing.pack(frame(spark, rows), capacity=512, group_tokens=4096).collect()
    covered: dict = {}
    sequences: dict = {}
    for r in got:
        own = ids[(r.doc_id, r.doc_tokens)][0]
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        covered.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered.keys() == ids.keys()
    for key, parts in covered.items():
        copies = len(ids[key])
        assert sum(n for _, n in parts) == copies * key[1]
        at = 0
        for start, n in sorted(set(parts)):
            assert copies > 1 or start == at
            at = start + n
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert sum(n for p in sequences.values() for _, n in p) >= 0.8 * 512 * len(sequences)


def test_encoder_equals_tokenizer():
    import random

    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, own = Tokenizer.from_file(path), packing.ChunkEncoder(path, keep=50)
    rng = random.Random(3)
    for _ in range(400):
        s = "".join(rng.choice("aB1 '.É́ßΣİ\x1c\xa0日e's're-_\t\n×<|endoftext|>") for _ in range(rng.randint(0, 16)))
        assert np.frombuffer(own(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids


def test_checksum_of_a_tail():
    a, b = b"some head", b"and its tail"
    assert packing.crc_of_tail(zlib.crc32(a + b), zlib.crc32(a), len(b)) == zlib.crc32(b)


def test_costs_are_balanced():
    rows = [(i, 100 + i % 37, 0, 100 + i % 37, i, b"") for i in range(400)]
    out = packing.pack_group([(d, n, s, ln, c, np.zeros(2, "<u4").tobytes()) for d, n, s, ln, c, _ in rows], 4096, 64, 1.0, 1 / 2048)
    cost: dict = {}
    for r in out:
        cost[r[5]] = cost.get(r[5], 0) + r[2] + r[2] ** 2 / 2048
    full = sorted(cost.values())[1:]
    assert max(full) <= 1.3 * min(full)


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_the_encoders_memory_is_bounded_and_keeps_what_recurs():
    import tracemalloc

    own = packing.ChunkEncoder(packing.default_tokenizer(), keep=50_000)
    words = [f"{'abcdefghij'[k % 10]}{k}é" for k in range(300_000)]
    tracemalloc.start()
    for lo in range(0, len(words), 100):
        own(" ".join(["often", *words[lo : lo + 100]]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 << 20
    small = packing.ChunkEncoder(packing.default_tokenizer(), keep=10)
    for lo in range(0, 200, 5):
        small(" ".join(["often", *words[lo : lo + 5]]))
        assert "often" in small.known | small.known_before and len(small.known) + len(small.known_before) <= 20
