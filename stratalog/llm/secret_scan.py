"""Secret scan with a random forest against false positives, in DataFrame expressions only.

A pattern finds candidates: known key formats, values behind words like ``password``, and long mixed runs.
Each candidate gets features - length, shares of digits, upper and lower case, runs of character classes
(transitions), distinct characters, coverage by a word list, a known format, words before and after it, signs of
a path around it and in the document's ``source`` - and the forest's mean vote decides.  The forest is trained
on the driver from labelled findings (a bounded list; the default one is generated from a seed) whose features
come from the same expressions, and is turned into nested CASE expressions.

All candidates of a text stay in its row, so there is no shuffle and a hot source costs nothing; texts are
read whole.  Nulls: a null text is empty, a null source is the empty path.  Repeated rows get a row each.
"""

from __future__ import annotations

import json
import random
import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that name their issuer.
FORMATS = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: From the BEGIN line to the next END line, whatever stands between (headers with '-', any length).
BLOCK = r"-----BEGIN [^\n-]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [^\n-]*PRIVATE KEY(?: BLOCK)?-----"
#: A key word and what stands between it and its value; the value is what follows.
PREFIX = r"(?i:password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|auth)[\"']?\s*[=:]\s*[\"']?"
ASSIGNED = PREFIX + r"[^\s\"',;<>]{6,}"
#: A run that has a digit anywhere.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{BLOCK}|{FORMATS}|{ASSIGNED}|{RUN}"
#: Words that people write where a secret would stand, and ordinary words inside identifiers.
WORDS = "password|passwd|secret|token|example|sample|dummy|placeholder|changeme|change|your|here|test|demo|admin|user|default|access|value|name|public|private|string|none|null|true|false|redacted|insert|enter|version|release|config|server|client|local|host|data|file|image|report|document|page|index|article|chapter|section|order|invoice|number|item|product|abcdef|abcd|1234567890|12345678|123456|1234|qwerty|letmein|welcome|foobar|the|and|for|with|tion|ing|ment|heit|keit|lich"
KEYWORDS = r"(?i)(?:password|passwd|pwd|secret|token|api.?key|access.?key|auth|credential|bearer)\W{0,5}$"
BENIGN = r"(?i)(?:example|sample|dummy|test|commit|sha|md5|checksum|hash|uuid|guid|isbn|build|revision|digest|etag|id|version|file|path|url|href|src)\W{0,5}$"
FEATURES = ("length", "digits", "upper", "lower", "runs", "distinct", "hex", "coverage", "format", "keyword", "benign", "slashes", "before_slash", "vowels", "same", "dashes", "test_path")


def features(cand: Column, before: Column, after: Column, path: Column) -> list[Column]:
    n = F.length(cand).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(cand, pattern, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "[^0Aa]", "-")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) / n,
        F.size(F.array_distinct(F.split(cand, ""))) / F.sqrt(n),
        flag(cand.rlike("^[0-9a-f]+$") | cand.rlike("^[0-9A-F]+$")),
        share(f"(?i)(?:{WORDS})"),
        flag(cand.rlike(f"^(?:{BLOCK}|{FORMATS})$")),
        flag(before.rlike(KEYWORDS)),
        flag(before.rlike(BENIGN) | after.rlike(r"^\.(?:html?|png|jpe?g|pdf|js|css|txt|com|org|net)\b")),
        share("/"),
        flag(before.rlike(r"[/\\.]$")),
        share("(?i)[aeiou]"),
        share(r"(.)\1{2,}"),
        share("[-_]"),
        flag(path.rlike(r"(?i)(?:test|example|fixture|docs?/|sample|mock)")),
    ]


def generated_findings(n: int = 1200, seed: int = 7) -> list[dict]:
    """Labelled findings: secrets in the formats of their issuers, and what looks alike but is none."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    hexa, up, b64 = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    words = ["order", "report", "image", "version", "release", "chapter", "heitung", "tionthe", "erber", "section", "page", "invoice", "ment", "config", "keit", "server", "the", "and"]
    keyed = ["password=", 'token = "', "secret: ", "api_key=", "auth_token=", "pwd: ", "Bearer "]
    prose = ["the ", "of it ", "see ", "und der ", "de la ", "in "]
    true = [
        lambda: (f"AKIA{pick(up, 16)}", r.choice(prose + keyed)),
        lambda: (pick(hexa, r.choice([16, 18, 24, 32, 40, 64])), r.choice(keyed)),
        lambda: (pick(b64, r.choice([20, 24, 32, 40, 43])), r.choice(keyed)),
        lambda: (f"gh{r.choice('pousr')}_{pick(b64, 36)}", r.choice(prose + keyed)),
        lambda: (f"xoxb-{pick(string.digits, 11)}-{pick(b64, 24)}", r.choice(prose + keyed)),
        lambda: (f"AIza{pick(b64, 35)}", r.choice(prose + keyed)),
        lambda: (f"sk-{pick(b64, 40)}", r.choice(prose + keyed)),
        lambda: (f"eyJ{pick(b64, 20)}.{pick(b64, 40)}.{pick(b64, 43)}", r.choice(prose + keyed)),
        lambda: (pick(b64 + "!@#$%^&*", r.choice([10, 12, 14, 16])), r.choice(keyed[:6])),
        lambda: (pick(b64 + "+/", 40), r.choice(prose + keyed)),
    ]
    false = [
        lambda: (f"AKIA{r.choice(['EXAMPLEEXAMPLE12', 'XXXXXXXXXXXXXXXX', 'IOSFODNN7EXAMPLE', '0000000000000000'])}", r.choice(prose + ["example "])),
        lambda: (r.choice(["changeme", "your_password_here", "password123", "xxxxxxxxxxxx", "********", "example_token", "<redacted>", "123456789012", "dummy-secret-value", "letmein1234"]), r.choice(keyed)),
        lambda: (r.choice(words) + "-" + r.choice(words) + "-" + pick(string.digits, r.choice([4, 6, 8])), r.choice(prose)),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice([*prose, "uuid ", "id="])),
        lambda: (pick(hexa, r.choice([40, 64, 32])), r.choice(["commit ", "sha256: ", "md5 ", "checksum ", "digest "])),
        lambda: ("/".join(r.choices(words, k=4)) + pick(string.digits, 3), r.choice([*prose, "https://example.com/"])),
        lambda: ("".join(r.choices(words, k=4)) + pick(string.digits, 1), r.choice(prose)),
        lambda: (pick(string.digits, r.choice([16, 18, 20])), r.choice([*prose, "isbn ", "id "])),
        lambda: ("_".join(r.choices(words, k=3)) + "_v" + pick(string.digits, 2), r.choice([*prose, "file "])),
        lambda: (r.choice("abcxz019") * r.choice([16, 20, 32]), r.choice(prose + keyed)),
    ]
    out = []
    for i in range(n):
        label = i % 2
        cand, before = r.choice(true if label else false)()
        out.append({"cand": cand, "before": before, "after": r.choice([" ", '" and', " the", ".", ","]), "path": r.choice(["src1", "src9", "web", "tests/fixtures" if not label else "app/config"]), "label": label})
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 4):
    """A tree of (feature, threshold, left, right) and leaf means, by Gini gain over a random third of the features."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return p
    best = None
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        for t in cuts if len(cuts) <= 24 else cuts[np.linspace(0, len(cuts) - 1, 24).astype(int)]:
            left = x[:, f] <= t
            a, b = int(left.sum()), int((~left).sum())
            if min(a, b) < least:
                continue
            pa, pb = y[left].mean(), y[~left].mean()
            impurity = a * pa * (1 - pa) + b * pb * (1 - pb)
            if best is None or impurity < best[0]:
                best = (impurity, int(f), float(t), left)
    if best is None:
        return p
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1, rng, least), grow(x[~left], y[~left], depth - 1, rng, least)


def train(spark: SparkSession, findings: list[dict], trees: int = 15, depth: int = 5, seed: int = 3) -> list:
    """A forest from labelled findings (cand, before, after, path, label)."""
    schema = "array<struct<cand:string,before:string,after:string,path:string,label:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings)), schema)).alias("r")).select("r.*")
    got = rows.select("label", F.array(*features(F.col("cand"), F.col("before"), F.col("after"), F.col("path"))).alias("x")).collect()
    x, y = np.array([r.x for r in got], float), np.array([r.label for r in got], float)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        forest.append(grow(x[pick], y[pick], depth, rng))
    return forest


def vote(tree, x: Callable[[int], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, left, right = tree
    return F.when(x(f) <= t, vote(left, x)).otherwise(vote(right, x))


def scan(docs: DataFrame, *, findings: list[dict] | None = None, threshold: float = 0.5, context: int = 32) -> DataFrame:
    """docs with _findings: array of (value, score, secret) in the order of the text."""
    forest = train(docs.sparkSession, generated_findings() if findings is None else findings)
    text, path = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_cands", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("_between", F.when(F.size("_cands") > 0, F.split("_text", CANDIDATE)).otherwise(F.array().cast("array<string>")))

    def judged(c: Column, i: Column) -> Column:
        value = F.regexp_replace(c, f"^{PREFIX}", "")
        prefix = F.left(c, F.length(c) - F.length(value))
        before = F.right(F.concat(F.coalesce(F.get("_between", i), F.lit("")), F.regexp_replace(prefix, r"\s+", " ")), F.lit(context))
        after = F.substring(F.coalesce(F.get("_between", i + F.lit(1)), F.lit("")), 1, context)
        x = F.array(*features(value, before, after, path))
        votes = F.transform(F.array(x), lambda v: sum((vote(t, lambda k: F.get(v, F.lit(k))) for t in forest[1:]), vote(forest[0], lambda k: F.get(v, F.lit(k)))) / F.lit(float(len(forest))))
        return F.transform(votes, lambda s: F.struct(value.alias("value"), s.alias("score"), (s >= threshold).alias("secret")))

    return rows.withColumn("_findings", F.flatten(F.transform("_cands", judged))).drop("_text", "_cands", "_between")


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text without the values judged to be secrets (longest first, wherever they stand)."""
    values = F.array_distinct(F.transform(F.filter(findings, lambda f: f["secret"]), lambda f: f["value"]))
    ordered = F.reverse(F.sort_array(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    return F.aggregate(ordered, F.coalesce(text, F.lit("")), lambda acc, v: F.replace(acc, v["v"], F.lit(mark)))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_candidates, n_secrets, top_score and redacted_sha256 of every document."""
    out = scan(docs.select("doc_id", F.col("text").cast("string").alias("text"), "source"), **options)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("_findings").cast("long").alias("n_candidates"),
        F.size(F.filter("_findings", lambda f: f["secret"])).cast("long").alias("n_secrets"),
        F.round(F.array_max(F.transform("_findings", lambda f: f["score"])), 6).alias("top_score"),
        F.sha2(redacted(F.col("text"), F.col("_findings")), 256).alias("redacted_sha256"),
    )
