from pyspark.sql import functions as F

from stratalog.llm import rules

from .util import base_counts, documents, frame, prose


def test_base_counts_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    extra = [prose(rng, 6) for _ in range(3)]
    odd = ["\n".join(extra * 3), " ".join(["a", "b", "c", "d", "e"] * 9), "x " * 50, "# * $ % & | < >\n\n #", "a b c d\x1ce\x85f", "\na b\n a b\na b\n"]
    rows = documents(7) + [(1000 + i, x, "de", "src9", 0) for i, x in enumerate(odd)]
    got = rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *base_counts(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept is not None


def test_outliers_go_and_clean_documents_stay(spark):
    import random

    rng = random.Random(1)
    clean = [(i, prose(rng, rng.randint(30, 200)), "en", f"s{i % 2}", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(rng, 90).split()), "en", "s0", 0) for i in range(12)]
    kept = {r.doc_id: r.kept for r in rules.judge(frame(spark, clean + junk), least=50).collect()}
    assert all(kept[r[0]] for r in clean) and not any(kept[r[0]] for r in junk)


def test_passing_keeps_columns_and_empty_table(spark):
    rows = frame(spark, documents(2)).withColumn("n_words", F.lit("mine")).withColumn("g", F.lit(1))
    out = rules.passing(rows)
    assert out.columns == rows.columns and out.where("n_words <> 'mine'").count() == 0
    assert rules.judge(frame(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = rules.base_counts(frame(spark, documents(2)))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("MapPartitionsInRDD", "") and "Arrow" not in plan
