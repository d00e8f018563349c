"""Variables by arm: description, standardised differences, tests, balance.

All of these start from two small tables of grouped sums, one row per variable and arm for
numbers and one per variable, level and arm for categories. The data is passed once for
each; every further step works on those few rows. Arms are 0 and 1.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasewise.functions.tail import p_value
from phasewise.names import BALANCE_THRESHOLD

ARM = "arm"


def _number(df: DataFrame, column: str) -> Column:
    """A date counts as days since 1970-01-01."""
    if dict(df.dtypes)[column] == "date":
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _origins(df: DataFrame, numeric: list[str]) -> dict[str, float]:
    """A value of each variable to count from: sums of squares of small differences keep their digits."""
    row = df.select(*[F.coalesce(_number(df, v), F.lit(0.0)).alias(v) for v in numeric]).first() if numeric else None
    return {v: float(row[i]) if row and math.isfinite(row[i]) else 0.0 for i, v in enumerate(numeric)}


def numeric_sums(df: DataFrame, strata: str, numeric: list[str], weight: str | None = None) -> DataFrame:
    """Per variable and arm: rows, weight sum n, mean and sample variance, also without the weight.

    With weights the variance is sum w (x - mean)^2 / sum w times rows / (rows - 1); n2 is
    the sum of squared weights and d2 that of (w (x - mean))^2, for the tests. All of it comes
    from one aggregate; values are counted from one of their own.
    """
    w = _weight(weight)
    origins = _origins(df, numeric)
    aggregates = []
    for v in numeric:
        x = _number(df, v) - F.lit(origins[v])
        known = F.when(x.isNotNull(), w)
        aggregates += [
            F.count(x).alias(f"{v}|rows"),
            F.avg(x).alias(f"{v}|plain"),
            F.var_samp(x).alias(f"{v}|spread"),
            F.sum(known).alias(f"{v}|n"),
            F.sum(w * x).alias(f"{v}|x"),
            F.sum(w * x * x).alias(f"{v}|xx"),
            F.sum(known * known).alias(f"{v}|n2"),
            F.sum(w * w * x).alias(f"{v}|x2"),
            F.sum(w * w * x * x).alias(f"{v}|xx2"),
        ]
    arms = df.groupBy(F.col(strata).alias(ARM)).agg(*aggregates)
    parts = ["rows", "plain", "spread", "n", "x", "xx", "n2", "x2", "xx2"]
    stacked = ", ".join(
        f"'{v}', {origins[v]!r}D, " + ", ".join(f"`{v}|{p}`" for p in parts) for v in numeric)
    rows = arms.select(ARM, F.expr(
        f"stack({len(numeric)}, {stacked}) as (variable, origin, {', '.join(f'`{p}`' for p in parts)})"))
    mean = F.try_divide(F.col("x"), F.col("n"))
    centred = F.greatest(F.try_divide(F.col("xx"), F.col("n")) - mean * mean, F.lit(0.0))
    variance = centred * F.try_divide(F.col("rows"), F.col("rows") - 1) if weight else F.col("spread")
    squares = F.col("xx2") - 2 * mean * F.col("x2") + mean * mean * F.col("n2")
    plain = F.col("plain") + F.col("origin")
    return rows.select(
        "variable", ARM, "rows", "n", (mean + F.col("origin") if weight else plain).alias("mean"),
        variance.alias("variance"), "n2", squares.alias("d2"),
        plain.alias("plain_mean"), F.col("spread").alias("plain_variance"),
    )


def level_sums(df: DataFrame, strata: str, factors: list[str], weight: str | None = None) -> DataFrame:
    """Per variable, level and arm: rows, weight sum, squared weight sum, share of the arm,
    and the share without the weight."""
    w = _weight(weight)
    long = df.select(
        F.col(strata).alias(ARM), w.alias("w"), *[F.col(f).cast("string").alias(f) for f in factors]
    ).unpivot([ARM, "w"], factors, "variable", "level")
    sums = (
        long.where(F.col("level").isNotNull())
        .groupBy("variable", "level", ARM)
        .agg(F.count("*").alias("rows"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("n2"))
    )
    of_arm = sums.groupBy("variable", ARM).agg(F.sum("n").alias("arm_n"), F.sum("rows").alias("arm_rows"))
    return sums.join(of_arm, ["variable", ARM]).select(
        "variable", "level", ARM, "rows", "n", "n2", (F.col("n") / F.col("arm_n")).alias("share"),
        (F.col("rows") / F.col("arm_rows")).alias("plain_share"),
    )


def table_one(
    df: DataFrame, strata: str, numeric: list[str], factors: list[str], weight: str | None = None
) -> DataFrame:
    """Long description by arm: n, mean and sd of numbers, n and percent of levels.

    The row of variable ``n`` gives the arm's size. With a weight, n and percent are weighted.
    """
    none = F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    # the arm's size is a factor with one level
    levels = level_sums(df.withColumn("n", F.lit("")), strata, ["n", *factors], weight)
    size = F.col("variable") == "n"
    return levels.select(
        "variable", F.when(~size, F.col("level")).alias("level"), ARM, "n", none.alias("mean"), none.alias("sd"),
        F.when(~size, 100 * F.col("share")).alias("percent"),
    ).unionByName(numeric_sums(df, strata, numeric, weight).select(
        "variable", text.alias("level"), ARM, "n", "mean", F.sqrt("variance").alias("sd"), none.alias("percent")))


def _by_arm(df: DataFrame, keys: list[str], columns: list[str], missing: float | None = None) -> DataFrame:
    """Arms side by side: column c becomes c1 and c0."""
    def of(arm: int, column: str) -> Column:
        value = F.max(F.when(F.col(ARM) == arm, F.col(column)))
        return value if missing is None else F.coalesce(value, F.lit(missing))

    return df.groupBy(*keys).agg(*[of(a, c).alias(f"{c}{a}") for c in columns for a in (1, 0)])


def smd(
    df: DataFrame, strata: str, numeric: list[str], factors: list[str], weight: str | None = None
) -> DataFrame:
    """Standardised mean difference per variable.

    Numbers: difference of means over the root of the average variance. Categories with k
    levels: the distance of the k - 1 level shares under the average of the two arms'
    multinomial covariances. That matrix is diagonal minus two outer products, so its
    inverse needs only six sums over the levels.
    """
    numbers = _by_arm(numeric_sums(df, strata, numeric, weight), ["variable"], ["mean", "variance"])
    numbers = numbers.select(
        "variable",
        F.try_divide(
            F.abs(F.col("mean1") - F.col("mean0")), F.sqrt((F.col("variance1") + F.col("variance0")) / 2)
        ).alias("smd"),
    )
    levels = _by_arm(level_sums(df, strata, factors, weight), ["variable", "level"], ["share"], 0.0)
    ordered = Window.partitionBy("variable").orderBy("level")
    p1, p0 = F.col("share1"), F.col("share0")
    a, d = (p1 + p0) / 2, p1 - p0
    after_first = F.row_number().over(ordered) > 1
    terms = {"dd": d * d, "d1": p1 * d, "d0": p0 * d, "c11": p1 * p1, "c10": p1 * p0, "c00": p0 * p0}
    sums = (
        levels.select("variable", after_first.alias("counted"), *[(t / a).alias(n) for n, t in terms.items()])
        .where("counted")
        .groupBy("variable")
        .agg(*[F.sum(n).alias(n) for n in terms])
    )
    m11, m00, m10 = 1 - F.col("c11") / 2, 1 - F.col("c00") / 2, -F.col("c10") / 2
    g1, g0 = F.col("d1"), F.col("d0")
    inner = (g1 * g1 * m00 - 2 * g1 * g0 * m10 + g0 * g0 * m11) / 2
    squared = F.col("dd") + F.try_divide(inner, m11 * m00 - m10 * m10)
    return numbers.unionByName(sums.select("variable", F.sqrt(squared).alias("smd")))


def group_tests(df: DataFrame, strata: str, numeric: list[str], factors: list[str]) -> DataFrame:
    """Test statistic, degrees of freedom and p per variable.

    Numbers: one-way F with equal variances. Categories: Pearson chi-square, with continuity
    correction for two levels.
    """
    numbers = _by_arm(numeric_sums(df, strata, numeric), ["variable"], ["rows", "mean", "variance"])
    n1, n0 = F.col("rows1"), F.col("rows0")
    between = n1 * n0 / (n1 + n0) * F.pow(F.col("mean1") - F.col("mean0"), 2)
    inside = (n1 - 1) * F.col("variance1") + (n0 - 1) * F.col("variance0")
    f_rows = numbers.select(
        "variable", F.lit("F").alias("test"),
        F.try_divide(between, F.try_divide(inside, n1 + n0 - 2)).alias("statistic"),
        F.lit(1.0).alias("df1"), (n1 + n0 - 2).cast("double").alias("df2"),
    )
    cells = _by_arm(level_sums(df, strata, factors), ["variable", "level"], ["n"], 0.0)
    per_variable = Window.partitionBy("variable")
    cells = cells.select(
        "*", F.sum("n1").over(per_variable).alias("all1"), F.sum("n0").over(per_variable).alias("all0"),
        F.count("*").over(per_variable).alias("k"),
    )
    level_total = F.col("n1") + F.col("n0")

    def deviation(arm: int) -> tuple[Column, Column]:
        expected = level_total * F.col(f"all{arm}") / (F.col("all1") + F.col("all0"))
        return F.abs(F.col(f"n{arm}") - expected), expected

    (o1, e1), (o0, e0) = deviation(1), deviation(0)
    # Both cells of a level deviate equally and all cells of a 2 x 2 table do.
    shift = F.when(F.col("k") == 2, F.least(F.lit(0.5), o1)).otherwise(0.0)
    part = F.try_divide(F.pow(o1 - shift, 2), e1) + F.try_divide(F.pow(o0 - shift, 2), e0)
    chi_rows = (
        cells.select("variable", "k", part.alias("part"))
        .groupBy("variable")
        .agg(F.sum("part").alias("statistic"), (F.max("k") - 1).cast("double").alias("df1"))
        .select("variable", F.lit("chi-square").alias("test"), "statistic", "df1",
                F.lit(None).cast("double").alias("df2"))
    )
    return _with_p(f_rows.unionByName(chi_rows))


def group_tests_weighted(
    df: DataFrame, strata: str, numeric: list[str], factors: list[str], weight: str
) -> DataFrame:
    """The same for weighted data, with variances that treat the weights as a survey design.

    Numbers: Wald F of the difference of weighted means. Categories: chi-square of the
    weighted shares with the second-order correction of Rao and Scott, as F.
    """
    numbers = _by_arm(
        numeric_sums(df, strata, numeric, weight), ["variable"], ["rows", "n", "mean", "d2"]
    )
    rows = F.col("rows1") + F.col("rows0")
    error = (F.col("d21") / F.pow(F.col("n1"), 2) + F.col("d20") / F.pow(F.col("n0"), 2)) * rows / (rows - 1)
    wald = numbers.select(
        "variable", F.lit("F").alias("test"),
        F.try_divide(F.pow(F.col("mean1") - F.col("mean0"), 2), error).alias("statistic"),
        F.lit(1.0).alias("df1"), (rows - 2).cast("double").alias("df2"),
    )
    return _with_p(wald.unionByName(_rao_scott(level_sums(df, strata, factors, weight))))


def _rao_scott(sums: DataFrame) -> DataFrame:
    """Second-order corrected chi-square, as F, of each variable's levels by arm.

    The correction needs the trace of the design covariance of the shares, scaled by the expected
    ones and projected on the interaction space, and the trace of its square. The projection is a
    product of one for levels and one for arms and the covariance is diagonal plus outer
    products, so both traces are sums over the levels.
    """
    cells = _by_arm(sums, ["variable", "level"], ["rows", "n", "n2"], 0.0)
    totals = cells.groupBy("variable").agg(
        F.sum("n1").alias("all1"), F.sum("n0").alias("all0"), F.sum("n21").alias("sq1"), F.sum("n20").alias("sq0"),
        F.sum(F.col("rows1") + F.col("rows0")).alias("count"), F.count("*").alias("levels"),
    ).where((F.col("levels") > 1) & (F.col("all1") > 0) & (F.col("all0") > 0))
    total = F.col("all1") + F.col("all0")
    r = (F.col("n1") + F.col("n0")) / total
    squares = (F.col("sq1") + F.col("sq0")) / (total * total)
    of_level = (F.col("n21") + F.col("n20")) / (total * total)
    parts = {name: [] for name in ("x", "tq", "aa", "ab", "bb", "daa", "dab", "t1")}
    in_level, by_arm = F.lit(0.0), {}
    for arm in (1, 0):
        c = F.col(f"all{arm}") / total
        p, s, s_arm = F.col(f"n{arm}") / total, F.col(f"n2{arm}") / (total * total), F.col(f"sq{arm}") / (total * total)
        expected = F.sqrt(r * c)
        d = s / (r * c)
        alpha = p / expected - expected
        beta = s / expected - F.sqrt(r) * s_arm / F.sqrt(c) - F.sqrt(c) * of_level / F.sqrt(r) + expected * squares
        for name, value in {
            "x": alpha * alpha, "tq": (1 - r) * (1 - c) * d, "aa": alpha * alpha, "ab": alpha * beta, "bb": beta * beta,
            "daa": d * alpha * alpha, "dab": d * alpha * beta, "t1": (1 - 2 * r) * (1 - 2 * c) * d * d,
        }.items():
            parts[name].append(value)
        in_level = in_level + c * d
        by_arm[f"e{arm}"] = r * d
    found = cells.join(totals, "variable").groupBy("variable", "all1", "all0", "sq1", "sq0", "count").agg(
        *[F.sum(v[0] + v[1]).alias(n) for n, v in parts.items()],
        F.sum((1 - 2 * r) * in_level * in_level).alias("t2"), *[F.sum(e).alias(n) for n, e in by_arm.items()],
    )
    c1, c0 = F.col("all1") / total, F.col("all0") / total
    e1, e0, aa, ab, bb = (F.col(n) for n in ("e1", "e0", "aa", "ab", "bb"))
    diagonal = F.col("t1") + F.col("t2") + (1 - 2 * c1) * e1 * e1 + (1 - 2 * c0) * e0 * e0 + F.pow(c1 * e1 + c0 * e0, 2)
    scale = F.col("count") * F.col("count") / (F.col("count") - 1)
    trace = scale * (F.col("tq") - 2 * ab + squares * aa)
    trace2 = scale * scale * (
        diagonal - 4 * F.col("dab") + 2 * squares * F.col("daa") + 2 * ab * ab + 2 * aa * bb
        - 4 * squares * aa * ab + squares * squares * aa * aa
    )
    df1 = F.try_divide(trace * trace, trace2)
    tested = found.select(
        "variable", F.try_divide(F.col("count") * F.col("x"), trace).alias("statistic"), df1.alias("df1"),
        (df1 * (F.col("count") - 1)).alias("df2"))
    return cells.select("variable").distinct().join(tested, "variable", "left").select(
        "variable", F.lit("Rao-Scott").alias("test"), "statistic", "df1", "df2")


def _with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", p_value(F.col("statistic"), F.col("df1"), F.col("df2")))


def balance(
    df: DataFrame,
    treat: str,
    numeric: list[str],
    factors: list[str],
    weight: str,
    threshold: float = BALANCE_THRESHOLD,
    denominator: str = "unweighted",
) -> DataFrame:
    """|SMD| per covariate level without and with weights, largest unweighted first.

    Each level counts as a 0/1 covariate. ``denominator`` tells whose variances standardise
    the weighted difference.
    """
    numbers = _by_arm(
        numeric_sums(df, treat, numeric, weight), ["variable"], ["mean", "variance", "plain_mean", "plain_variance"])
    levels = _by_arm(level_sums(df, treat, factors, weight), ["variable", "level"], ["share", "plain_share"], 0.0)

    def of_numbers(kind: str) -> list[Column]:
        mean, variance = ([F.col(f"{kind}{c}{a}") for a in (1, 0)] for c in ("mean", "variance"))
        return [mean[0] - mean[1], F.sqrt((variance[0] + variance[1]) / 2)]

    def of_levels(kind: str) -> list[Column]:
        p1, p0 = F.col(f"{kind}share1"), F.col(f"{kind}share0")
        return [p1 - p0, F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2)]

    def named(of: Callable[[str], list[Column]]) -> list[Column]:
        columns = [*of("plain_"), *of("")]
        return [c.alias(n) for c, n in zip(columns, ("difference", "scale", "weighted", "weighted_scale"))]

    text = F.lit(None).cast("string")
    scale = F.col("scale") if denominator == "unweighted" else F.col("weighted_scale")
    return (
        numbers.select("variable", text.alias("level"), *named(of_numbers))
        .unionByName(levels.select("variable", "level", *named(of_levels)))
        .select(
            "variable", "level",
            F.abs(F.try_divide("difference", "scale")).alias("smd_unweighted"),
            F.abs(F.try_divide(F.col("weighted"), scale)).alias("smd_weighted"),
        )
        .withColumn("unbalanced", F.col("smd_weighted") > threshold)
        .orderBy(F.desc("smd_unweighted"), "variable", "level")
    )
