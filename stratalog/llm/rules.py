"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Everything is a DataFrame expression.  Whole texts give base counts; transformed counts give a vector of
five statistics.  Documents that pass the fixed rules are strata by (lang, source); a stratum of fewer than
``least`` rows joins its language, and a language of fewer joins all.  In each stratum the minimum
covariance determinant estimate comes from concentration steps: distances under the present estimate are
binned on a logarithmic grid, counts and moments are summed by (stratum, bin) - so a hot source reaches a
reducer as a few hundred rows - and the bins that hold the nearest ``core`` share give the next estimate.
The first estimate is the median and the quartile distance of each statistic, from binned counts as well.
After the steps, one reweighting takes all rows within the 97.5 % quantile.  Rows beyond ``cutoff`` (a
squared Mahalanobis distance) go.  ``floors`` are the least standard deviations, so that a statistic that is
0 nearly everywhere has a scale.

Nulls: a null text has no words; a null lang or source is a value of its own.  Extra columns are ignored.
Repeated rows get a row each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stage, staged

D = 5
FLOORS = (0.06, 0.06, 0.12, 0.10, 0.07)
#: Quantiles of the chi-squared distribution with 5 degrees of freedom, and of 7 for the consistency factor.
CHI5_975 = 12.8325
CONSISTENCY_75 = 1.4126
CONSISTENCY_975 = 1.0590


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def deleted(text: Column, chars: str) -> Column:
    """How many of these characters the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found at least twice in the text.

    Windows are compared by 64-bit hash; only texts with an equal pair sort their windows."""

    def covered(found: Column) -> Column:
        def flagged(s: Column) -> Column:
            at = lambda i: F.get(s, i)["h"]
            same = lambda i: F.coalesce(at(i) == at(i - F.lit(1)), F.lit(False)) | F.coalesce(at(i) == at(i + F.lit(1)), F.lit(False))
            hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), same)
            return F.sort_array(F.transform(hits, lambda i: F.get(s, i)["p"]))

        def union(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + F.lit(1)) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)

        structs = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(let(F.sort_array(structs), flagged), union))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(n))))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, lang, source, the columns of ``keep``, and counts of whole texts."""
    text = F.col("_text")
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split(text, SPACE), "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        *keep,
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        deleted(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        deleted(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics; each rate leans on a constant, so that short texts are not extreme by chance."""
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    return [
        F.log((chars + 100) / (words + 20)),
        F.sqrt(F.col("n_symbols") / (chars + 60)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)),
        F.sqrt(F.col("n_repeat_words") / (words + 20)),
        F.sqrt(F.col("n_upper") / (chars + 60)),
    ]


X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
FACTOR = [f"l{i}{j}" for i in range(D) for j in range(i + 1)]


def levels(rows: DataFrame, least: int) -> DataFrame:
    """_lang, _source and level of every pair: 0 if it has ``least`` rows, 1 if its lang has, else 2."""
    marked = F.when(F.col("n") >= least, F.lit(0)).when(F.col("n_lang") >= least, F.lit(1)).otherwise(F.lit(2))
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    level = counts.join(langs.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l"))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), marked.alias("level"))
    return small(stage(level, "strata"))


def strata(rows: DataFrame, level: DataFrame) -> DataFrame:
    """rows with the column g (its stratum): (lang, source), or (lang), or all."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    g = F.when(F.col("level") == 0, F.to_json(F.array(text(F.col("lang")), text(F.col("source"))))).when(F.col("level") == 1, F.to_json(F.array(text(F.col("lang"))))).otherwise("all")
    return rows.join(level, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).withColumn("g", g).drop("_lang", "_source", "level")


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """Broadcast a staged table of at most ``most`` rows; a larger one takes the shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def factors(estimate: DataFrame) -> DataFrame:
    """Cholesky factors of m (means) and s (covariances), column by column."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"s{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimate.select("g", *(f"m{i}" for i in range(D)), *FACTOR)


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with d2: forward substitution with the stratum's factor."""
    out = rows.join(small(estimate), "g")
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).drop(*(f"z{i}" for i in range(D)), *FACTOR, *(f"m{i}" for i in range(D)))


def sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"a{i}") for i, x in enumerate(X)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS)]


def moments(binned: DataFrame, inside: Column, scale: float) -> DataFrame:
    """The next estimate from summed moments of the bins inside."""
    kept = binned.where(inside).groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in [f"a{i}" for i in range(D)] + [f"p{i}{j}" for i, j in PAIRS]))
    mean = lambda i: F.col(f"a{i}") / F.col("n")
    cov = lambda i, j: (F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j)) * scale + (FLOORS[i] ** 2 if i == j else 0.0)
    return factors(kept.select("g", *(mean(i).alias(f"m{i}") for i in range(D)), *(cov(i, j).alias(f"s{i}{j}") for i, j in PAIRS)))


def quartiles(rows: DataFrame) -> DataFrame:
    """First estimate: median and quartile distance of each statistic, on a grid of 1/200."""
    from pyspark.sql import Window

    cells = rows.select("g", F.posexplode(F.array(*(F.floor(F.col(x) * 200) for x in X))).alias("k", "cell")).groupBy("g", "k", "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "k").orderBy("cell")
    run = cells.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("g", "k")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell"))) / 200.0 + 0.0025
    q = run.groupBy("g", "k").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    var = lambda i: F.pow((pick("q3", i) - pick("q1", i)) / 1.349, F.lit(2.0)) + FLOORS[i] ** 2
    wide = q.groupBy("g").agg(*(pick("q2", i).alias(f"m{i}") for i in range(D)), *((var(i) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS))
    return factors(wide)


def estimates(rows: DataFrame, core: float, steps: int) -> DataFrame:
    """g, means and Cholesky factors of the reweighted minimum covariance determinant estimate."""
    from pyspark.sql import Window

    cell = F.greatest(F.lit(-64), F.least(F.lit(160), F.floor(F.log2(F.col("d2") + 1e-9) * 8))).cast("int")
    estimate = stage(quartiles(rows), "estimate")
    w = Window.partitionBy("g").orderBy("cell")
    for _ in range(steps):
        binned = distances(rows, estimate).withColumn("cell", cell).groupBy("g", "cell").agg(*sums())
        binned = binned.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("g")))
        estimate = stage(moments(binned, F.col("before") < core * F.col("total"), CONSISTENCY_75), "estimate")
    near = distances(rows, estimate).where(F.col("d2") <= CHI5_975).groupBy("g").agg(*sums())
    return stage(moments(near, F.lit(True), CONSISTENCY_975), "estimate")


def passing(docs: DataFrame, *, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever their names.

    Texts are not staged: what is rejected is known by id, hash of the text, language and source, and is taken from the
    rows by a broadcast of at most ``broadcast_rows``, or by a shuffled join beyond."""
    keys = ["doc_id", "th", "lang", "source"]
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    rejected = rejections(docs.select("doc_id", "text", "lang", "source", key[1]), **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return rows.alias("a").join(small(rejected, broadcast_rows).alias("b"), same, "left_anti").select("row.*")


@staged
def rejections(docs: DataFrame, **options) -> DataFrame:
    return judge(docs, keep=("th",), **options).where("not kept").select("doc_id", "th", "lang", "source").distinct()


def judge(docs: DataFrame, *, keep: tuple[str, ...] = (), least: int = 200, core: float = 0.75, steps: int = 3, cutoff: float = 30.0) -> DataFrame:
    """Base counts of every row with base_failed, d2 (null where base_failed), kept and the columns of ``keep``
    (whose names must differ from the counts')."""
    rows = stage(base_counts(docs, *keep).withColumn("base_failed", base_failed()), "counts")
    vectors = rows.select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector()))).where(~F.col("base_failed"))
    passed = strata(vectors, levels(vectors, least))
    found = distances(passed, estimates(stage(passed.select("g", *X), "vectors"), core, steps))
    kept = found.withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    names = [*rows.columns, "d2", "kept"]
    failed = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return kept.select(*names).unionByName(failed.select(*names))
