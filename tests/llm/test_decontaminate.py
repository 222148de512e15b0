import hashlib
import random
import re

import pytest

from stratalog.llm import decontaminate as d

from .util import documents, fold, frame, prose

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return TOKEN.findall(fold(t))


def brute(docs, items, window=13):
    wins = []
    for item, text in items:
        w = words(text)
        wins += [(str(item), w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, p in wins:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 13, 14, 40])).capitalize() + ".") for i in range(12)] + [(20, None), (21, "..."), (22, "the"), (2, "an er an er an er")]
    docs = documents(seed)
    for i in range(14):
        w = words(rng.choice(items[:12])[1])
        cut = rng.randrange(len(w))
        part = " ".join(w[cut : cut + 20]).upper() if i % 2 else ", ".join(w)
        docs.append((500 + i, f"{prose(rng, rng.randint(0, 300))} {part} {prose(rng, 5)}", "en", "s", 0))
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(1, 4 << 20), (2, 60)])
def test_equals_brute_force(spark, seed, block):
    docs, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(frame(spark, docs), bench, block_bytes=block).drop("items", "spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in docs], items)


def test_clean_drops_only_contaminated(spark):
    docs, items = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.clean(frame(spark, docs), bench)
    bad = [r for r in brute([(r[0], r[1]) for r in docs], items) if r[5]]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(docs) - len(bad) and bad


def test_proximity(spark):
    docs = [(1, "x alpha y beta gamma z"), (2, "alpha beta"), (3, "gamma alpha beta"), (4, "alpha x x x x beta x x x gamma")]
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    near = {r.doc_id for r in d.contamination(rows, bench, slop=1).where("n_items > 0").collect()}
    exact = {r.doc_id for r in d.contamination(rows, bench).where("n_items > 0").collect()}
    assert near == {1} and exact == set()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(frame(spark, []), none).count() == 0
    assert d.contamination(frame(spark, documents(1)), none).where("contaminated or n_hit > 0").count() == 0
