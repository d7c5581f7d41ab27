"""Quality rules: base counts of a text, and robust outliers by minimum covariance determinant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.llm.shared import WORD_GAP, written

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\f\r"
#: The statistics of the vector: (name, SQL over the base counts, standard deviation of its noise), in thousandths.
#: Rates are square roots, which makes counts' spread about even; texts are short, so rates are noisy, and the noise's
#: variance is added to every covariance, as the regularized form of the method does with its target. Fixed values.
FEATURES = (
    ("x0", "1000 * ln(cast(word_chars as double) / greatest(n_words, 1))", 80),
    ("x1", "1000 * sqrt(cast(n_symbols as double) / greatest(n_words, 1))", 70),
    ("x2", "1000 * sqrt(cast(n_dup_lines as double) / greatest(n_lines, 1))", 120),
    ("x3", "1000 * sqrt(cast(n_repeat_words as double) / greatest(n_words, 1))", 120),
)
#: Every group's moments are joined by so many pseudo-rows with the moments of all groups together (a conjugate
#: prior), at every size: a group of thousands is judged by itself, one of ten mostly by what all groups have.
PRIOR = 40
#: Share of a group's rows in the subset whose covariance has the least determinant; starts and C-steps towards it.
SUBSET, STARTS, STEPS = 0.75, 3, 3
#: Factors that make the covariance of the nearest SUBSET, and of the rows within NEAR, that of the whole for normal
#: vectors of 4 statistics: share / chi-squared CDF with 6 degrees of freedom at the quantile of the share with 4.
SUBSET_SCALE, NEAR_SCALE = 1.4866, 1.0645
#: Squared distance of the last reweighting: the 0.975 quantile of chi-squared with 4 degrees of freedom.
NEAR = 11.1433
#: Squared distance beyond which a row goes: the 1 - 1e-9 quantile of chi-squared with 4 degrees of freedom.
CUT = 47.88


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input columns in the struct `row`, and `id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`.

    A null text has no words. Repeated words are those in 3-word windows found twice or more in the text:
    windows are compared by 64-bit hash within one text, sorted with their places; runs of equal hashes mark
    places, and places nearer than three words share words.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("_t"))
    words = F.filter(F.split("_t", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<long>"))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
            same = lambda a, b: F.coalesce(a.getField("h") == b.getField("h"), F.lit(False))
            twice = F.zip_with(F.zip_with(s, before, lambda a, b: F.struct(a.getField("i").alias("i"), a.getField("h").alias("h"), same(a, b).alias("f"))), after, lambda a, b: F.when(a.getField("f") | same(a, b), a.getField("i")))
            return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

        def words_in(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3)))
            return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda t, g: t + g))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(placed, places), words_in))

    stats = df.select(
        "row",
        "id",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _let(windows(w), covered).cast("long").alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate("_t", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return stats.select("row", "id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)]
FIT = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS)]


def moments(x: str = "x") -> list[Column]:
    """MOMENTS of vectors that stand for `c` equal rows each: exact integers, whatever the order of rows."""
    total = lambda e: f"sum(cast({e} as decimal(19, 0)) * cast(c as decimal(18, 0)))"
    sums = [total("1"), *(total(f"{x}{i}") for i in range(P)), *(total(f"{x}{i} * {x}{j}") for i, j in PAIRS)]
    return [F.expr(f"cast({sql} as double)").alias(name) for name, sql in zip(MOMENTS, sums)]


def covariance(scale: float, noise: list[float]) -> list[list[tuple[str, str]]]:
    """Levels of (name, SQL): means, then covariances with the noise's variance, from MOMENTS."""
    cov = [(f"c{i}{j}", f"{scale} * (p{i}{j} / n - m{i} * m{j})" + (f" + {float(noise[i] ** 2)}" if i == j else "")) for i, j in PAIRS]
    return [[(f"m{i}", f"s{i} / n") for i in range(P)], cov]


def cholesky() -> list[list[tuple[str, str]]]:
    """Levels of (name, SQL): the factor of the covariances, and the logarithm of their determinant."""
    levels = []
    for j in range(P):
        levels.append([(f"l{j}{j}", f"sqrt(c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + ")")])
        if j + 1 < P:
            levels.append([(f"l{i}{j}", f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}") for i in range(j + 1, P)])
    return [*levels, [("logdet", "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(P)) + ")")]]


def distance_sql() -> list[list[tuple[str, str]]]:
    """Levels of (name, SQL): the whitened residuals z and their squared length d2."""
    levels = [[(f"z{i}", f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}")] for i in range(P)]
    return [*levels, [("d2", " + ".join(f"z{i} * z{i}" for i in range(P)))]]


def _levels(df: DataFrame, levels: list[list[tuple[str, str]]]) -> DataFrame:
    for level in levels:
        df = df.withColumns({name: F.expr(sql) for name, sql in level})
    return df


#: Distances are binned at 64ths of powers of two, so that "the nearest SUBSET of a group" is a count by bin.
BIN_SQL = "cast(floor(64 * ln(greatest(d2, 0.0001)) / ln(2.0)) as int)"


def starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """FIT by group and `start`, three that outliers cannot carry off: by median and MAD alone (0), and with the
    correlations of tanh(z) (1) and of z / |z| (2), z being a vector less the medians over the MADs. Medians are exact;
    statistics are integers in thousandths, so a group has few distinct values, however many rows."""
    middle = vectors.groupBy(*keys).agg(*[F.percentile(f"x{i}", F.lit(0.5), F.col("c")).alias(f"m{i}") for i in range(P)])
    gaps = vectors.join(middle, keys)
    apart = gaps.groupBy(*keys).agg(*[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5), F.col("c")).alias(f"a{i}") for i in range(P)])
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), F.lit(2)) + float(FEATURES[i][2] ** 2)).alias(f"d{i}") for i in range(P)]
    centre = written(middle.join(apart, keys).select(*keys, *[f"m{i}" for i in range(P)], *spread), "quality-medians")
    z = vectors.join(centre, keys).withColumns({f"z{i}": F.expr(f"(x{i} - m{i}) / d{i}") for i in range(P)})
    z = z.withColumn("length", F.expr("greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + "), 1e-9)"))
    bent = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), *[F.expr(f"cast(round(1000 * {f.format(i=i)}) as bigint)").alias(f"y{i}") for i in range(P)]) for s, f in ((1, "tanh(z{i})"), (2, "z{i} / length"))]))
    shapes = z.select(*keys, "c", bent.alias("e")).select(*keys, "c", "e.*").groupBy(*keys, "start").agg(*moments("y"))
    shapes = _levels(shapes, covariance(1.0, [100.0] * P))
    plain = centre.select(*keys, F.lit(0).alias("start"), *[F.lit(float(i == j)).alias(f"c{i}{j}") for i, j in PAIRS])
    # A correlation r of the statistics is r * d_i * d_j of their covariance.
    shapes = shapes.select(*keys, "start", *[F.expr(f"c{i}{j} / sqrt(c{i}{i} * c{j}{j})").alias(f"c{i}{j}") for i, j in PAIRS]).unionByName(plain)
    shapes = shapes.join(centre, keys).withColumns({f"c{i}{j}": F.expr(f"c{i}{j} * d{i} * d{j}") for i, j in PAIRS})
    return _levels(shapes, cholesky()).select(*keys, "start", *FIT)


def nearest(by_bin: DataFrame, keys: list[str]) -> DataFrame:
    """MOMENTS by `keys` of exactly ceil(SUBSET of the rows): bins from the nearest on, the last one by the share it still fills."""
    group = Window.partitionBy(*keys)
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(SUBSET * F.sum("n").over(group)) - F.coalesce(F.sum("n").over(before), F.lit(0.0))
    filled = by_bin.withColumn("w", F.greatest(F.least(wanted / F.col("n"), F.lit(1.0)), F.lit(0.0)))
    return filled.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in MOMENTS])


def estimates(rows: DataFrame, keys: list[str], prior: float = PRIOR) -> DataFrame:
    """FIT and `logdet` by group: its minimum covariance determinant estimate, reweighted.

    From each of STARTS robust starts, STEPS C-steps take the SUBSET of the group's rows nearest to the last estimate
    and fit them again; of a group's starts the one with the least determinant wins (of equals, the first). The rows
    within NEAR of it, by the covariance scaled for normal vectors, give the estimate. Each fit joins `prior`
    pseudo-rows to the group, which have the moments of all groups' first subsets, or of all rows within NEAR; they are
    one row of sums through the driver. Equal vectors of a group are one row with a count. Every step is a partial
    aggregation by group, start and bin, and a join with one row per group and start, whatever share of the rows one
    group has.
    """
    vectors = written(rows.groupBy(*keys, *[f[0] for f in FEATURES]).agg(F.count("*").alias("c")), "quality-vectors")
    noise = [f[2] for f in FEATURES]

    def fitted(sums: DataFrame, pool: dict[str, float], scale: float) -> DataFrame:
        # Without a prior, or any row to make one of, a group stands for itself.
        share = prior / pool["n"] if pool["n"] else 0.0
        joined = sums.withColumns({c: F.col(c) + share * (pool[c] or 0.0) for c in MOMENTS})
        return _levels(joined, [*covariance(scale, noise), *cholesky()])

    def pooled(sums: DataFrame) -> dict[str, float]:
        return sums.agg(*[F.sum(c).alias(c) for c in MOMENTS]).first().asDict()

    now, pool = written(starts(vectors, keys), "quality-starts"), None
    for _ in range(STEPS):
        near = with_distance(vectors, now, keys).withColumn("bin", F.expr(BIN_SQL))
        sums = written(nearest(near.groupBy(*keys, "start", "bin").agg(*moments()), [*keys, "start"]), "quality-subsets")
        pool = pool or pooled(sums.filter("start = 0"))
        now = written(fitted(sums, pool, SUBSET_SCALE).select(*keys, "start", *FIT, "logdet"), "quality-steps")
    best = now.groupBy(*keys).agg(F.min_by(F.struct(*FIT), F.struct(F.round("logdet", 9), "start")).alias("f")).select(*keys, "f.*")
    inside = written(with_distance(vectors, best, keys).filter(F.col("d2") <= NEAR).groupBy(*keys).agg(*moments()), "quality-near")
    return fitted(best.select(*keys).join(inside, keys, "left").fillna(0.0, MOMENTS), pooled(inside), NEAR_SCALE).select(*keys, *FIT, "logdet")


def with_distance(vectors: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Add `d2`. There is one fit per group and groups are few beside rows, but nothing bounds them, so Spark picks the join by measured size."""
    return _levels(vectors.join(fits, keys), distance_sql())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), prior: float = PRIOR, carry: bool = False) -> DataFrame:
    """With `carry` the input in `row`; the base counts, `base_failed, d2, kept`.

    Rows that pass the base rules are grouped by language and source (null and empty are one; a key column that
    the input lacks counts as null). A row goes when its vector lies further than CUT from its
    group's robust centre. Every covariance holds the noise that FEATURES states, so a group of equal texts, or a
    statistic that is almost always zero, rejects nobody over trifles; `prior` pseudo-rows of all groups
    steady small groups. Repeated rows are judged alike; empty and null
    texts fail the base rules; no rows give no rows. Input columns may have any name.
    """
    counts = base_counts(docs, id_col, text_col).withColumn("base_failed", base_failed())
    names = [F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in keys]
    k = [f"k{i}" for i in range(len(keys))]
    counts = counts.withColumns(dict(zip(k, names)))
    for name, sql, _ in FEATURES:
        counts = counts.withColumn(name, F.expr(f"cast(round(coalesce({sql}, 0)) as bigint)"))
    counts = written(counts if carry else counts.drop("row"), "quality-counts")  # the texts are read once
    fits = written(estimates(counts.filter("NOT base_failed"), k, prior), "quality-fits")
    out = _levels(counts.join(fits, k, "left"), distance_sql())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUT, F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """`id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept` of every row; see `judged`."""
    return judged(docs, id_col, text_col, keys).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    return judged(docs, id_col, text_col, keys, carry=True).filter("kept").select("row.*")
