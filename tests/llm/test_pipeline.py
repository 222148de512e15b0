import random

import pytest

import corpus_pipeline
from stratalog.llm import queries

from .test_decontaminate import brute
from .util import base_counts, documents, frame, prose, shingle_set

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [r for r in documents(9, 48) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    items = [(i, prose(rng, 30)) for i in range(4)]
    rows += [(200, items[0][1] + " " + prose(rng, 40), "en", "src1", 0), (201, prose(rng, 40) + " password=9f8e7d6c5b4a392817 " + prose(rng, 20), "en", "src2", 0)]
    out = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    path, rows, items = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
    first = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(seen[n].columns == first for n, _ in corpus_pipeline.STAGES[:-1])
    kept = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    for r in rows:
        n, _, _, _, again = base_counts(r[1])
        if n < 10 or 100 * again > 20 * n:
            assert r[0] not in kept
    ids = sorted(kept)
    sets = {i: shingle_set(kept[i], 5) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in seen["ngram_jaccard_join"].collect()} == {i for i in ids if find(i) == i}
    bad = {r[0] for r in brute([(r.doc_id, r.text) for r in seen["ngram_jaccard_join"].collect()], items) if r[5]}
    after = {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    assert 200 in bad and after == {i for i in ids if find(i) == i} - bad
    clean = {r.doc_id: r for r in seen["secret_scans"].collect()}
    assert clean.keys() == after and "[SECRET]" in clean[201].text and "9f8e7d6c" not in clean[201].text and clean[201].n_chars == len(clean[201].text)
    assert {r.doc_id for r in seen["packing"].collect()} == after


def test_run_is_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
