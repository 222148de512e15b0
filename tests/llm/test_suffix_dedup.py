import hashlib
import random

import numpy as np
import pytest

from stratalog.llm import suffix_dedup

from .util import WORD, documents, frame, prose


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen: dict[bytes, int] = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(docs, texts, strict=True):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((d, len(b), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = documents(seed)
    got = suffix_dedup.dedup(frame(spark, rows)).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in rows], 400)


def test_spans_are_the_removed_bytes(spark):
    rows = documents(3)
    for r in suffix_dedup.dedup(frame(spark, rows)).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rows = documents(4)
    got = suffix_dedup.dedup(frame(spark, rows)).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in rows], 400)


def test_empty_and_extra_columns(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    from pyspark.sql import functions as F

    odd = frame(spark, documents(1)).withColumns({"key": F.lit("x"), "th": F.lit(1), "doc": F.lit(2), "spans": F.lit(None)})
    assert suffix_dedup.dedup(odd).count() == len(documents(1))


def test_lengths_are_checked(spark):
    with pytest.raises(ValueError):
        suffix_dedup.dedup(frame(spark, []), length=100)


def test_long_names_are_made_only_where_asked():
    """Names of over 8 bytes at every position were most of the query's CPU time; those asked for are the same."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 6000).astype(np.uint8)
    data[3000:] = data[:3000]
    text, anchor, lo, hi, names = suffix_dedup.segments(data, np.array([0, 3000, 3000, 3399, 6000]), 400, 256)
    assert set(names.levels) == {8}
    windows = [k for a, b in zip(lo, hi, strict=True) for k in range(a, b + 1)]
    assert windows == [*range(0, 2601), *range(3399, 5601)] and (hi - lo).min() >= 0
    assert ((anchor >= hi) & (anchor < lo + 256)).all() and set(text) == {0, 3}
    at = np.arange(2601)
    for length in (145, 256, 385, 400):
        few, all_ = names.of(at, length), suffix_dedup.Names(data, 256).of(at, length)
        assert (few == all_).all() and len(set(few.tolist())) == len(at) and (names.of(at + 3000, length)[: 3000 - length] == few[: 3000 - length]).all()


def brute_sharing(docs, n):
    """doc_id and whether another row has n words in a row that this one has."""
    held: dict[tuple, set] = {}
    for i, (_, t) in enumerate(docs):
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    sharing = set().union(*(x for x in held.values() if len(x) > 1))
    return sorted(((d, int(i in sharing)) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize(("seed", "piece"), [(1, 1 << 20), (2, 1 << 20), (4, 700)])
def test_shares_passage_equals_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng, rows = random.Random(seed), documents(seed)
    base, odd = prose(rng, 300).split(" "), "x" * 90 + " é" + "y" * 200
    texts = [" ".join(prose(rng, 40).split(" ") + base[k : k + n] + prose(rng, 40).split(" ")) for k, n in [(0, 51), (0, 50), (40, 51), (100, 60), (101, 50), (109, 51), (180, 50), (200, 90)]]
    texts += [" ".join(base[150:290]).replace(base[215], "edited"), "\n\t ".join(base[:51]), " ".join(["la"] * 51), " ".join(["la"] * 400), " ".join([prose(rng, 30)] * 9), " ".join([odd, *base[290:]] * 6), " ".join([odd, *base[290:]] * 7)]
    texts += ["\n".join([prose(rng, 7), *[" ".join(base[230:260])] * 3]), "\n".join([prose(rng, 9), *[" ".join(base[230:260])] * 4])]
    rows += [(1000 + k, t, "en", "src1", len(t)) for k, t in enumerate(texts)]
    got = suffix_dedup.dedup(frame(spark, rows), words=51).select("doc_id", "shares_passage").collect()
    want = brute_sharing([(r[0], r[1]) for r in rows], 51)
    assert sorted((tuple(r) for r in got), key=str) == want and {0, 1} == {x for _, x in want}


def test_short_passages_are_told_and_contract_columns_stay(spark):
    """Passages of 51 words in under 400 bytes repeat across documents; n_removed leaves them, shares_passage tells them."""
    rng = random.Random(5)
    passages = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(51)) for _ in range(10)]
    assert max(map(len, passages)) < 400 - 60
    texts = [f"{prose(rng, 60)} {passages[k % 10]} {prose(rng, 60)}" for k in range(20)] + [prose(rng, 170) for _ in range(20)]
    docs = frame(spark, [(k, t, "en", "src1", len(t)) for k, t in enumerate(texts)])
    out = suffix_dedup.dedup(docs, words=51).drop("spans").orderBy("doc_id").collect()
    assert [r.shares_passage for r in out] == [1] * 20 + [0] * 20 and {r.n_removed for r in out} == {0}
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == brute_order(texts)


def brute_order(texts):
    return sorted(brute(list(enumerate(texts)), 400))


def test_word_count_is_checked(spark):
    with pytest.raises(ValueError):
        suffix_dedup.dedup(frame(spark, []), words=20)
    assert suffix_dedup.dedup(frame(spark, []), words=51).count() == 0
