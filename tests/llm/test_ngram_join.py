import random

import numpy as np
import pytest

from stratalog.llm import graph, ngram_join

from .util import brute_components, documents, frame, prose


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, n, num):
    rows = documents(5, 72)
    got = ngram_join.join(frame(spark, rows), n=n, num=num, den=100)
    assert rows_of(got) == brute_components([(r[0], r[1]) for r in rows], n, num, 100)


def test_long_sets_are_compared_in_parts(spark):
    rows = documents(6, 60)
    got = ngram_join.join(frame(spark, rows), n=5, num=80, den=100, whole=40)
    assert rows_of(got) == brute_components([(r[0], r[1]) for r in rows], 5, 80, 100)


def test_large_groups_take_the_difference_path(spark):
    """Near copies with their own edits around the threshold, in groups larger than ``small``."""
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base = prose(rng, 60 + 40 * g).split(" ")
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = prose(rng, 1) + "x"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    got = ngram_join.join(frame(spark, rows), n=3, num=90, den=100, most=3, sample=4)
    assert rows_of(got) == brute_components([(r[0], r[1]) for r in rows], 3, 90, 100)


def test_allocations_find_every_pair(spark):
    """With few rows (identity segments) and very many (deletion neighbourhoods)."""
    rng = random.Random(2)
    words = [prose(rng, 1) + str(i) for i in range(400)]
    for count in (10, 10**12):
        bands = ngram_join.Bands(90, 100, count)
        for size in (10, 19, 20, 40, 95, 160):
            a = ngram_join.shingles(" ".join(words[:size]), 1)
            for cut in range(size // 10 + 1):
                b = ngram_join.shingles(" ".join(words[cut:size]), 1)
                if 100 * len(set(a) & set(b)) >= 90 * len(set(a) | set(b)) and len(a) != len(b):
                    assert set(bands.signatures(a)) & set(bands.signatures(b))


def test_empty_table_and_one_of_each(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    rows = [(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (4, "", "en", "s", 0), (1, "a b c d e f", "en", "s", 1)]
    kept = ngram_join.first_of_each(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101)], "src long, dst long")
    got = {r.id: r.comp for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100


def test_components_of_a_randomly_numbered_path(spark):
    """Far more hops than the rounds of a label that walks hop by hop may have."""
    ids = random.Random(4).sample(range(10**9), 2000)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")
    got = graph.components(edges).collect()
    assert len(got) == 2000 and {r.comp for r in got} == {min(ids)}


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Rows with one id, or none, but different texts are different documents."""
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x")
    texts = [(None, a), (None, b), (None, b), (None, ""), (7, c), (7, d), (7, c), (7, None), (9, d), (8, a), (6, "y z")]
    rows = [(i, x, "en", "s", 1) for i, x in texts]
    kept = ngram_join.first_of_each(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(8, a), (None, b), (None, ""), (7, c), (7, d), (7, None), (6, "y z")], key=str)


def test_sketches_bound_the_difference():
    rng = random.Random(6)
    a = ngram_join.shingles(prose(rng, 900), 1)
    for k in (0, 1, 5, 60):
        b = a[k:]
        for words in (4, 8, 32):
            x, y = ngram_join.sketch(a, words), ngram_join.sketch(b, words)
            assert sum(int(v).bit_count() for v in (x ^ y).view("uint64")) <= k
        assert (ngram_join.sketch(a, 16)[:8] ^ ngram_join.sketch(a, 16)[8:] == ngram_join.sketch(a, 8)).all()


def test_pairs_far_from_the_center_meet_in_their_first_elements():
    """Sets at random distances from a center: whoever is linked, one of them far, shares a listed element."""
    rng = random.Random(8)
    for num in (80, 90):
        for _ in range(300):
            size = rng.choice([12, 30, 60])
            base = set(range(size))
            edits = rng.sample(range(200, 230), 30) + rng.sample(sorted(base), size // 2)
            sets = [base ^ set(rng.sample(edits, rng.randint(0, 10))) for _ in range(6)]
            order = sorted(set().union(*sets) | base, key=lambda e: (e in base, e))
            rows = []
            for s in sets:
                diff = sorted(s ^ base, key=order.index)
                far, long, short = ngram_join.prefixes(len(s), len(diff), size, num, 100)
                rows.append((s, far, set(diff[:long]), set(diff[:short])))
            for i, (a, fa, la, sa) in enumerate(rows):
                for b, fb, lb, sb in rows[i + 1 :]:
                    if (fa or fb) and a != b and 100 * len(a & b) >= num * len(a | b):
                        assert (la | sa) & sb if fa and not fb else sa & (lb | sb) if fb and not fa else sa & sb


def test_entries_left_out_lose_no_pair():
    """Whatever the levels, each two linked sets that are not equal share an entry."""
    rng = random.Random(12)
    nprng = np.random.default_rng(12)
    for num in (80, 90):
        for levels in (None, nprng.integers(0, 4, 1 << 10).astype(np.uint8), nprng.integers(0, 200, 1 << 10).astype(np.uint8)):
            for rows in (10, 10**12):
                bands = ngram_join.Bands(num, 100, rows, levels)
                for size in (1, 2, 7, 11, 19, 24, 40, 75, 160, 420, 900):
                    pool = np.unique(nprng.integers(0, 1 << 63, 2 * size + 4, dtype=np.uint64))
                    nprng.shuffle(pool)
                    most = 2 * size * (100 - num) // (100 + num)
                    for _ in range(12):
                        gone = rng.randint(0, most)
                        a, b = np.sort(pool[:size]), np.sort(pool[gone : size + rng.randint(0, most + 1 - gone)])
                        common = len(np.intersect1d(a, b))
                        if not np.array_equal(a, b) and 100 * common >= num * (len(a) + len(b) - common):
                            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_a_frequent_passage_joins_few():
    """Of sets that share a quarter in frequent shingles few meet; where all count as equally frequent, most do."""
    nprng = np.random.default_rng(3)
    names = np.unique(nprng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    nprng.shuffle(names)
    levels = np.zeros(1 << 20, np.uint8)
    levels[names[:40] & np.uint64((1 << 20) - 1)] = 20
    sets = [np.sort(np.concatenate([names[:40], names[100 + 110 * k : 210 + 110 * k]])) for k in range(100)]

    def met(bands):
        seen = [set(bands.signatures(s).tolist()) for s in sets]
        return sum(not x.isdisjoint(y) for i, x in enumerate(seen) for y in seen[:i]) / 4950

    assert met(ngram_join.Bands(80, 100, 200, levels)) < 0.01 and met(ngram_join.Bands(80, 100, 200)) > 0.5


def test_levels_count_all_texts(spark):
    rows = [(i, "a b c d e f" if i % 2 else f"x{i} y{i} z{i} u{i} v{i} w{i} q{i}", "en", "s", 0) for i in range(40)]
    rows += [(99, None, None, None, None), (98, "", None, None, None)]
    table = ngram_join.levels_of(frame(spark, rows).repartition(10), 5)
    often = ngram_join.shingles("a b c d e f", 5) & np.uint64((1 << 20) - 1)
    once = ngram_join.shingles("x2 y2 z2 u2 v2 w2 q2", 5) & np.uint64((1 << 20) - 1)
    assert len(table) == 1 << 20 and (table[often] >= 2).all() and (table[once] == 0).all()
    assert not ngram_join.levels_of(frame(spark, []), 5).any()


def test_packed_entries_come_back_and_take_less_than_eleven_bytes():
    rng = np.random.default_rng(3)
    cuts = ngram_join.bases(40)
    sig = np.sort(np.concatenate([rng.integers(cuts[7], cuts[8], 50_000, np.uint64), np.full(3, cuts[7], np.uint64), np.full(2, cuts[8] - 1, np.uint64)]))
    name = rng.integers(0, 1 << ngram_join.NAME_BITS, len(sig), np.uint64)
    blob = ngram_join.packed_marks(sig, name, cuts[7])
    for got, want in zip(ngram_join.unpacked_marks(blob, cuts[7]), (sig, name), strict=True):
        assert (got == want).all()
    assert len(blob) < 11 * len(sig)  # 16 bytes as rows
    one = ngram_join.packed_marks(sig[:1], name[:1], cuts[7])
    assert [x.tolist() for x in ngram_join.unpacked_marks(one, cuts[7])] == [sig[:1].tolist(), name[:1].tolist()]


def test_the_exchange_of_entries_is_bounded(spark):
    """Bytes that the entries of sets without partners take on their way."""
    rng = random.Random(4)
    docs = frame(spark, [(i, prose(rng, 400), "en", "s", 0) for i in range(200)])
    bands = ngram_join.Bands(80, 100, 200)
    entries = sum(len(bands.signatures(ngram_join.shingles(r.text, 5))) for r in docs.collect())
    marks = ngram_join.marks_of(docs, bands, 5, 8).collect()
    assert sum(len(r.marks) for r in marks) < 11 * entries and {r.part for r in marks} == set(range(8))
    assert sum(len(ngram_join.unpacked_marks(r.marks, 0)[0]) for r in marks) == entries > 10_000


def test_the_table_of_levels_grows_with_the_shingles(spark):
    """In one of a fixed size a passage of a few hundred texts is no more frequent than what meets by chance."""
    assert [ngram_join.table_bits(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 30, 1 << 40)] == [20, 20, 21, 24, 25]
    rng = random.Random(5)
    passage = prose(rng, 40)
    docs = [(i, f"{prose(rng, 30)} {passage if i % 4 == 0 else ''} {prose(rng, 30)}", "en", "s", 0) for i in range(400)]
    sets = [ngram_join.shingles(d[1], 5) for d in docs]
    for bits in (20, 21):
        table = ngram_join.levels_of(frame(spark, docs).repartition(7), 5, bits)
        at, count = np.unique(np.concatenate(sets) & np.uint64((1 << bits) - 1), return_counts=True)
        want = np.zeros(1 << bits, np.uint8)
        want[at] = np.floor(2 * np.log2(count))
        assert (table == want).all() and table.max() == 13
