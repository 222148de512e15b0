import random
import re

from pyspark.sql import functions as F

from stratalog.llm import secret_scan as s

from .util import documents, frame


def test_known_secrets_and_lookalikes(spark):
    rng = random.Random(5)
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    key = "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16))
    true = [f"to rent. {key} Edtiones", f"at the password={hexa(18)} reatat", f'of token = "{hexa(40)}" tily']
    false = ["use password=changeme here", f"commit {hexa(40)} fixes it", "see chapter-section-2024 for it", f"id {rng.randrange(10**15, 10**16)} is it"]
    rows = [(i, x, "en", "src1", 0) for i, x in enumerate(true + false)]
    got = {r.doc_id: r for r in s.report(frame(spark, rows)).collect()}
    assert [got[i].n_secrets for i in range(3)] == [1, 1, 1]
    assert sum(got[i].n_secrets for i in range(3, 7)) <= 1
    assert all(got[i].n_candidates >= 1 for i in range(5))


def test_redaction_and_edge_rows(spark):
    secret = "password=3f9a8b7c6d5e4f3a2b"
    rows = [(1, f"x {secret} y {secret}", "en", "s", 0), (2, None, None, None, None), (3, "", "en", None, 0), *documents(1)]
    out = s.scan(frame(spark, rows).withColumn("findings", F.lit("mine")))
    one = out.where("doc_id = 1 and text like 'x password%'").select("*", s.redacted(F.col("text"), F.col("_findings")).alias("clean")).first()
    assert one.clean == "x password=[SECRET] y password=[SECRET]" and one.findings == "mine"
    assert out.where("doc_id = 2").first()._findings == []
    assert s.report(frame(spark, [])).count() == 0


def features_in_python(cand, before, after, path):
    n = len(cand)
    share = lambda p: (n - len(re.sub(p, "", cand))) / n
    kinds = re.sub("[^0Aa]", "-", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", cand))))
    known = re.fullmatch(f"{s.BLOCK}|{s.FORMATS}", cand) is not None
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), len(re.sub(r"(.)\1*", r"\1", kinds)) / n, len(set(cand)) / n**0.5,
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", cand))), share(f"(?i)(?:{s.WORDS})"), float(known), float(bool(re.search(s.KEYWORDS, before))),
        float(bool(re.search(s.BENIGN, before) or re.search(r"^\.(?:html?|png|jpe?g|pdf|js|css|txt|com|org|net)\b", after))), share("/"), float(bool(re.search(r"[/\\.]$", before))),
        share("(?i)[aeiou]"), share(r"(.)\1{2,}"), share("[-_]"), float(bool(re.search(r"(?i)(?:test|example|fixture|docs?/|sample|mock)", path))),
    ]


def test_features_and_forest_equal_brute_force(spark):
    found = s.generated_findings(300)
    rows = spark.createDataFrame([(i, f["cand"], f["before"], f["after"], f["path"]) for i, f in enumerate(found)], "i int, cand string, before string, after string, path string")
    got = {r.i: r.x for r in rows.select("i", F.array(*s.features(F.col("cand"), F.col("before"), F.col("after"), F.col("path"))).alias("x")).collect()}
    forest = s.train(spark, found, trees=5)

    def vote(tree, x):
        while not isinstance(tree, float):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    right = 0
    for i, f in enumerate(found):
        x = features_in_python(f["cand"], f["before"], f["after"], f["path"])
        assert [round(v, 9) for v in got[i]] == [round(v, 9) for v in x], f
        right += (sum(vote(t, x) for t in forest) / 5 >= 0.5) == bool(f["label"])
    assert right >= 0.97 * len(found)


def test_forest_generalises(spark):
    forest = s.train(spark, s.generated_findings(1200, 7))
    held = s.generated_findings(600, 99)
    rows = spark.createDataFrame([(f["cand"], f["before"], f["after"], f["path"], f["label"]) for f in held], "cand string, before string, after string, path string, label int")
    x = F.array(*s.features(F.col("cand"), F.col("before"), F.col("after"), F.col("path")))
    rows = rows.withColumn("x", x)
    score = sum((s.vote(t, lambda k: F.get("x", F.lit(k))) for t in forest[1:]), s.vote(forest[0], lambda k: F.get("x", F.lit(k)))) / len(forest)
    assert rows.where((score >= 0.5).cast("int") == F.col("label")).count() >= 0.97 * len(held)


def test_candidates_have_no_length_case_or_dash_bounds(spark):
    rng = random.Random(8)
    lines = lambda k: "\n".join("".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(k))
    block = lambda head, k: f"-----BEGIN RSA PRIVATE KEY-----\n{head}{lines(k)}\n-----END RSA PRIVATE KEY-----"
    run = "".join(rng.choices("abcdefghABCDEFGH", k=70)) + "7Qx9"
    whole = [block("", 400), block("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00FF\n\n", 12), run, "Xk9!mQ2zT", "Xk9!mQ2zT7", "Xk9!mQ2zT8", "Xk9!mQ2zT9"]
    before = ["see ", "see ", "of ", "PASSWORD=", "Password: ", '"password": "', "password     =     "]
    rows = [(i, f'x {b}{w}" y', "en", "src1", 0) for i, (b, w) in enumerate(zip(before, whole, strict=True))]
    got = {r.doc_id: r._findings for r in s.scan(frame(spark, rows)).collect()}
    assert [[f.value for f in got[i]] for i in range(len(rows))] == [[w] for w in whole]
    assert [i for i in range(len(rows)) if not got[i][0].secret and i != 2] == []
