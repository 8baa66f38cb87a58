"""Quality rules and robust multivariate outliers. Built-in functions only.

Each text gives counts of words, characters, symbols, capitals, repeated lines and repeated
eight-word windows, without leaving its row. Their transformed values are a vector of DIMS
integers (thousandths), and the minimum-covariance-determinant estimate of each group of language
and source says where the bulk of its vectors lies:

* two deterministic starts: medians with absolute deviations, and plain mean with covariance;
* concentration steps: distances under the current estimate, then mean and covariance of the
  nearest three quarters, until no logarithm of a determinant changes by more than SETTLED (STEPS at most). One step is one
  pass: vectors are aggregated by group and distance bin (sums of integers, so the result does not
  depend on the order of rows), and a running count over the bins, 32 to a doubling of the squared
  distance, says which bins make up the subset: three quarters, and what is left of the last bin;
* the start with the smaller determinant wins, is scaled to a chi-squared median, reweighted once,
  and a row is rejected where its squared Mahalanobis distance passes CUT.

Covariances get a floor for each value, so a group in which nothing ever repeats does not reject
the first text that does. Distances come from a Cholesky factor written as column expressions.
Groups under LEAST rows are judged by the estimate of their whole language, and languages under
LEAST rows by that of all rows that pass the base, however few. The tables of estimates have a row a
group; whether they are broadcast is left to their size.

Defined cases: a null or empty text has no words and fails the base; null languages and sources
are groups of their own; equal rows get equal verdicts; an empty table gives no rows; other
columns are kept by ``keep_good`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, cut, drop_cut, let, read_table

REPEAT_WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Values of the vector: name, and the least standard deviation that a group is given, in thousandths.
VALUES = (("word_length", 60), ("symbols", 60), ("capitals", 60), ("repeats", 150), ("dup_lines", 200))
DIMS = len(VALUES)
LEAST, STEPS, SETTLED, BINS, PER_DOUBLING, SUBSET = 50, 20, 1e-2, 1280, 32, 0.75
#: Quantiles of chi-squared with five degrees of freedom: of one half, of 0.975 and of 0.9999.
CHI_HALF, CHI_REWEIGHT, CUT = 4.351, 12.833, 25.745


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more."""
    k = REPEAT_WINDOW

    def of_hashes(hs: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            at = F.sort_array(F.transform(twin, lambda x: x["i"]))
            zero = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n")), lambda a: a["n"])

        some = F.size(F.array_distinct(hs)) < F.size(hs)
        return F.when(some, let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)).otherwise(F.lit(0))

    n = F.size(words) - (k - 1)

    def of_windows(h: Column) -> Column:  # of the words' hashes: no window is copied
        return let(F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])), of_hashes)

    return F.when(n > 1, let(F.transform(words, lambda w: F.xxhash64(w)), of_windows)).otherwise(F.lit(0))


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column __s of counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WORD_SPLIT, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda s: F.struct((F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"), F.size(s).cast("long").alias("n_lines")))
    out = docs.withColumn("__w", of_words).withColumn("__l", of_lines)
    counts = F.struct("__w.n_words", "__w.word_chars", _without(t, "[#*$%&|<>]+").alias("n_symbols"), "__l.n_dup_lines", "__w.n_repeat_words", _without(t, r"\p{Lu}+").alias("n_capitals"), "__l.n_lines")
    return out.withColumn("__s", counts).drop("__w", "__l")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * REPEAT_PERCENT)


def vector(s: Column) -> list[Column]:
    """The transformed statistics, in thousandths: variance-stabilised shares, and a smoothed word length."""

    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0)))

    values = (
        F.ln((s["word_chars"] + 250) / (s["n_words"] + 50)),
        share(s["n_symbols"], s["word_chars"]),
        share(s["n_capitals"], s["word_chars"]),
        share(s["n_repeat_words"], s["n_words"]),
        share(s["n_dup_lines"], s["n_lines"]),
    )
    return [F.round(v * 1000).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


_X = [f"x{k}" for k in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in _X], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p_{i}_{j}") for i, j in _PAIRS]]


_SUMS = ["n", *[f"s_{x}" for x in _X], *[f"p_{i}_{j}" for i, j in _PAIRS]]


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Means m_i, the Cholesky factor l_i_j of the floored covariance, and ln of its determinant."""
    n = F.col("n").cast("double")
    cov = {(i, j): (F.col(f"p_{i}_{j}") / n - (F.col(f"s_x{i}") / n) * (F.col(f"s_x{j}") / n)) for i, j in _PAIRS}
    df = sums.select(*keys, "n", *[(F.col(f"s_x{i}") / n).alias(f"m_{i}") for i in range(DIMS)], *[(c + (VALUES[i][1] ** 2 if i == j else 0)).alias(f"c_{i}_{j}") for (i, j), c in cov.items()])
    for j in range(DIMS):
        rest = F.col(f"c_{j}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest, F.lit(1.0))))
        for i in range(j + 1, DIMS):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    det = sum((F.ln(F.col(f"l_{i}_{i}")) for i in range(DIMS)), F.lit(0.0)).alias("det")
    return df.select(*keys, *[f"m_{i}" for i in range(DIMS)], *[f"l_{i}_{j}" for i, j in _PAIRS], det)


def _distance(df: DataFrame) -> DataFrame:
    """df, with an estimate in each row, with d2: the squared Mahalanobis distance, by forward substitution."""
    total = F.lit(0.0)
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"__y{k}")
        df = df.withColumn(f"__y{i}", rest / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"__y{i}") * F.col(f"__y{i}")
    return df.withColumn("d2", total).drop(*[f"__y{i}" for i in range(DIMS)])


def _bin() -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.log2(F.col("d2") + 1) * PER_DOUBLING)).cast("int")


def _edge(b: Column) -> Column:
    """The middle of a bin of squared distances."""
    return F.pow(F.lit(2.0), (b + 0.5) / PER_DOUBLING) - 1


def _key(level: str, *parts: Column) -> Column:
    return F.concat(F.lit(level), *[x for p in parts for x in (F.lit("\x01"), F.coalesce(p, F.lit("\x00")))])


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows, once for each estimate that they take part in, with its g; and the table of (lang, source) to the g that judges.

    A group of LEAST rows or more judges itself, else its language, else all rows.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("of_lang"), F.min("n").alias("least"))
    total = by_lang.agg(F.sum("of_lang").alias("of_all"), F.min("of_lang").alias("least_lang"))
    named = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(total)  # total is one row
    own, whole, every = _key("s", F.col("lang"), F.col("source")), _key("l", F.col("lang")), _key("a")
    g = F.when(F.col("n") >= LEAST, own).when(F.col("of_lang") >= LEAST, whole).otherwise(every)
    asked = (F.col("least") < LEAST) & (F.col("of_lang") >= LEAST), F.col("least_lang") < LEAST
    parts = F.array_compact(F.array(F.when(F.col("n") >= LEAST, own), F.when(asked[0], whole), F.when(asked[1], every)))
    table = cut(named.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), g.alias("g"), parts.alias("parts")))
    return with_group(rows, table.drop("g")).withColumn("g", F.explode("parts")).drop("parts"), table.drop("parts")


def with_group(rows: DataFrame, table: DataFrame) -> DataFrame:
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(table, same, "left").drop("g_lang", "g_source")


def _medians(long: DataFrame) -> DataFrame:
    """(g, i, median) of rows (g, i, v): from counts of each value, which are few (thousandths)."""
    counts = long.groupBy("g", "i", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "i")
    run = counts.withColumn("run", F.sum("c").over(w.orderBy("v"))).withColumn("all", F.sum("c").over(w))
    return run.filter("2 * run >= all").groupBy("g", "i").agg(F.min("v").alias("median"))


def _first_estimates(x: DataFrame) -> DataFrame:
    """Both starts: 0 from medians and absolute deviations, 1 from mean and covariance."""
    long = x.select("g", F.posexplode(F.array(*_X)).alias("i", "v"))
    med = cut(_medians(long))
    mad = _medians(long.join(med, ["g", "i"]).select("g", "i", F.abs(F.col("v") - F.col("median")).alias("v"))).withColumnRenamed("median", "mad")
    both = med.join(mad, ["g", "i"])
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c}_{k}") for k in range(DIMS) for c in ("median", "mad")])

    def scale(k: int) -> Column:
        return F.sqrt(F.pow(F.col(f"mad_{k}") * 1.4826, F.lit(2)) + VALUES[k][1] ** 2)

    robust = wide.select(
        "g",
        F.lit(0).alias("start"),
        *[F.col(f"median_{k}").cast("double").alias(f"m_{k}") for k in range(DIMS)],
        *[(scale(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _PAIRS],
        sum((F.ln(scale(i)) for i in range(DIMS)), F.lit(0.0)).alias("det"),
    )
    plain = _estimate(x.groupBy("g").agg(*_sums()), ["g"]).select("g", F.lit(1).alias("start"), *[c for c in robust.columns if c not in ("g", "start")])
    return robust.unionByName(plain)


def estimate(rows: DataFrame) -> DataFrame:
    """An estimate for each g of rows (g, x0 ...): means, factor, and the scale of its distances."""
    at = cut(_first_estimates(rows))
    for _ in range(STEPS):
        binned = _distance(rows.join(at, "g")).groupBy("g", "start", _bin().alias("b")).agg(*_sums())
        w = Window.partitionBy("g", "start")
        run = binned.withColumn("before", F.sum("n").over(w.orderBy("b")) - F.col("n")).withColumn("all", F.sum("n").over(w))
        near = run.filter(F.col("before") < F.col("all") * SUBSET)
        sums = near.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in _SUMS])
        new = cut(_estimate(sums, ["g", "start"]))
        was = at.select("g", "start", F.col("det").alias("was"))
        moved = new.join(was, ["g", "start"]).agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        drop_cut(at)
        at = new
        if not moved or moved <= SETTLED:
            break
    best = at.groupBy("g").agg(F.min(F.struct("det", "start")).alias("best")).select("g", F.col("best.start").alias("start"))
    at = cut(at.join(best, ["g", "start"]).drop("start"))
    scaled = _with_scale(rows, at)
    d2 = _distance(rows.join(scaled, "g")).filter(F.col("d2") * F.col("scale") <= CHI_REWEIGHT)
    again = cut(_estimate(d2.groupBy("g").agg(*_sums()), ["g"]))
    return _with_scale(rows, again)


def _with_scale(rows: DataFrame, at: DataFrame) -> DataFrame:
    """at with scale: what makes the median of a group's squared distances that of chi-squared, shrinking none."""
    binned = _distance(rows.join(at, "g")).groupBy("g", _bin().alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    run = binned.withColumn("run", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    half = run.filter("2 * run >= all").groupBy("g").agg(F.min("b").alias("b"))
    return cut(at.join(half, "g").withColumn("scale", F.least(F.lit(1.0), F.lit(CHI_HALF) / _edge(F.col("b")))).drop("b"))


def _model(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (lang, source, failed, x0 ...): the table of groups and the estimates."""
    grouped, table = _grouped(stats.filter("not failed"))
    return table, estimate(cut(grouped.select("g", *_X)))


def _judged(stats: DataFrame, table: DataFrame, at: DataFrame) -> DataFrame:
    """stats with distance (null where nothing is estimated) and kept."""
    placed = _distance(with_group(stats, table).join(at, "g", "left"))
    distance = F.when(~F.col("failed"), F.col("d2") * F.col("scale"))
    return placed.withColumn("distance", distance).withColumn("kept", ~F.col("failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def _statistics_table(docs: DataFrame, keep: list[Column], text: str, lang: str, source: str) -> DataFrame:
    s = F.col("__s")
    return with_statistics(docs, text).select(*keep, F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), base_failed(s).alias("failed"), *vector(s))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, s, failed, distance, kept): each row's counts and verdict."""
    stats = cut(_statistics_table(docs, [F.col(key).alias("key"), F.col("__s").alias("s")], text, lang, source))
    table, at = _model(stats)
    return _judged(stats, table, at).select(F.col("key").alias(key), "s", "failed", "distance", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", F.col("failed").alias("base_failed"), "kept", F.round("distance", 6).alias("distance"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the rows that the rules reject.

    Rows are written once with their statistics, which cost far more than the copy; fitting reads the statistics only.
    """
    stats = cut(_statistics_table(docs, [F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("__doc")], text, lang, source))
    kept = _judged(stats, *_model(stats)).filter("kept")
    return kept.select(*[F.col(f"__doc.c{k}").alias(c) for k, c in enumerate(docs.columns)])
