"""Paired Wilcoxon signed-rank tests and agreement of two annotations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which variants are compared, and the words for effect sizes.
COMPARISONS = (("v0", "v1"), ("v1", "v2"), ("v2", "v3"), ("v0", "v3"))
LARGE, MEDIUM = 0.5, 0.3
#: Largest number of pairs, zeros included, that is tested by the exact distribution (`auto`) whatever the differences.
EXACT_UP_TO = 13
#: Largest number of differences whose exact distribution is worked out (`exact`, and `auto` without zeros and ties); beyond it the normal approximation
#: holds, and the result says so.
EXACT_LIMIT = 50
#: Fixed value: the mean alpha from which annotations count as reliable.
RELIABLE = 0.67


def paired(scores: DataFrame, comparisons=COMPARISONS, column: str = "f1", by: str = "kind") -> DataFrame:
    """comparison, by, doc_id, a, b: the two variants' scores of the documents that both have; scores: variant, by, doc_id, column.

    The few comparisons say which variants a row takes part in, so it is exploded at most twice for each; no variant is joined with all."""
    sides = F.array(*(F.struct(F.lit(f"{x}-{y}").alias("comparison"), F.lit(v).alias("variant"), F.lit(s).alias("side")) for x, y in comparisons for v, s in ((x, "a"), (y, "b"))))
    each = scores.select(by, "doc_id", "variant", F.col(column).alias("_x"), F.explode(sides).alias("_s")).where("variant = _s.variant")
    both = each.groupBy(F.col("_s.comparison").alias("comparison"), by, "doc_id").agg(F.max(F.when(F.col("_s.side") == "a", F.col("_x"))).alias("a"), F.max(F.when(F.col("_s.side") == "b", F.col("_x"))).alias("b"))
    return both.where("a is not null and b is not null")


def signed_ranks(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", digits: int = 10) -> DataFrame:
    """by, n, n_used, w_plus, w_minus, total, squares, mean_a, mean_b, tied, ranks: sums over the mid-ranks of the differences that are not 0, and,
    for up to EXACT_LIMIT of them, the ranks themselves, doubled and so whole.

    Equal differences are counted first, so the window that ranks them sorts distinct values, however many pairs a group has; only ranks up to the limit are kept."""
    rows = pairs.withColumn("_d", F.round(F.col(a) - F.col(b), digits))
    size = rows.where("_d <> 0").groupBy(*by, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_p"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = size.withColumn("_r", 2 * before + F.col("_n") + 1)
    sums = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n_used"), (F.sum(F.col("_p") * F.col("_r")) / 2).alias("_plus"), (F.sum((F.col("_n") - F.col("_p")) * F.col("_r")) / 2).alias("_minus"),
        (F.sum(F.col("_n") * F.col("_r")) / 2).alias("_t"), (F.sum(F.col("_n") * F.col("_r") * F.col("_r")) / 4).alias("_s"), F.max("_n").alias("_most"), F.array_sort(F.collect_list(F.when(F.col("_r") - F.col("_n") - 1 <= 2 * EXACT_LIMIT, F.struct("_r", "_n")))).alias("_l"),
    )
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    ranks = F.when(F.col("n_used") <= EXACT_LIMIT, F.flatten(F.transform("_l", lambda x: F.array_repeat(x["_r"], x["_n"].cast("int"))))).otherwise(F.array().cast("array<bigint>"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return whole.join(sums, by, "left").select(*by, "n", F.coalesce("n_used", F.lit(0)).alias("n_used"), zero("_plus", "w_plus"), zero("_minus", "w_minus"), zero("_t", "total"), zero("_s", "squares"), "mean_a", "mean_b", F.coalesce(F.col("_most") > 1, F.lit(False)).alias("tied"), F.coalesce(ranks, F.array().cast("array<bigint>")).alias("ranks"))


def exact_p(ranks: Column, statistic: Column) -> Column:
    """Two-sided p of the smaller rank sum under random signs, from doubled ranks: the number of subsets of each sum, one rank at a time."""
    top = F.aggregate(ranks, F.lit(0).cast("long"), lambda s, r: s + r)
    start = F.transform(F.sequence(F.lit(0).cast("long"), top), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(ranks, start, lambda done, r: F.transform(done, lambda x, i: x + F.when(i >= r, F.get(done, (i - r).cast("int"))).otherwise(0.0)))
    below = F.aggregate(F.slice(ways, 1, (2 * statistic).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), F.size(ranks)))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)


def z_score(statistic: Column, total: Column, squares: Column) -> Column:
    """The statistic's distance from its mean in deviations, with the variance that ties leave, without continuity correction."""
    return (statistic - total / 2) / F.sqrt(squares / 4)


def effect_size(n: Column, statistic: Column) -> Column:
    """1 - 2W / (n (n + 1) / 2), n with zeros."""
    return F.round(1 - 2 * statistic / (n * (n + 1) / 2), 4)


def wilcoxon(pairs: DataFrame, by: list[str], method: str = "auto", alpha: float = 0.05) -> DataFrame:
    """The paired test in each group: n, statistic, p_value, method (exact, normal or none), significant, effect_size_r, effect_label, direction (a, b)."""
    s = signed_ranks(pairs, by).withColumn("_w", F.least("w_plus", "w_minus"))
    exact, normal = exact_p(F.col("ranks"), F.col("_w")), normal_p(F.when(F.col("n_used") > 0, z_score(F.col("_w"), F.col("total"), F.col("squares"))))
    use = {"exact": F.col("n_used") <= EXACT_LIMIT, "normal": F.lit(False), "auto": (F.col("n") <= EXACT_UP_TO) | ~F.col("tied") & (F.col("n") == F.col("n_used")) & (F.col("n") <= EXACT_LIMIT)}[method]
    none = F.col("n_used") == 0
    s = s.withColumn("p_value", F.when(none, 1.0).when(use, exact).otherwise(normal))
    r = F.when(none, 0.0).otherwise(effect_size(F.col("n"), F.col("_w")))
    label = F.when(none, "none").when(F.abs(r) >= LARGE, "large").when(F.abs(r) >= MEDIUM, "medium").otherwise("small")
    return s.select(*by, "n", F.when(~none, F.col("_w")).alias("statistic"), "p_value", F.when(none, "none").when(use, "exact").otherwise("normal").alias("method"), (F.col("p_value") < alpha).alias("significant"), r.alias("effect_size_r"), label.alias("effect_label"), F.when(F.col("mean_a") > F.col("mean_b"), "a > b").otherwise("b > a").alias("direction"))


def agreement(a: DataFrame, b: DataFrame, digits: int = 4) -> DataFrame:
    """doc_id, n_a, n_b, n_both, n_any, agreement of the distinct claims of two annotations (doc_id, claim); the micro F1 is the same number."""
    sides = a.select("doc_id", "claim", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("doc_id", "claim", F.lit(0), F.lit(1)))
    each = sides.groupBy("doc_id", "claim").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    total = each.groupBy("doc_id").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.sum(F.col("x") * F.col("y")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return total.withColumn("agreement", F.round(F.try_divide("n_both", "n_any"), digits))


def nominal_alpha(units: DataFrame, by: list[str], unit: str = "pos", value: str = "value") -> DataFrame:
    """Krippendorff's alpha for nominal values in each group: 1 - observed / expected disagreement; rows are (by, unit, value), a row for each rater.

    Units with one value are left out; where all values are equal alpha is 1. Coincidences are sums over values of a unit; no pairs are made."""
    n = units.where(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count(F.lit(1)).alias("_n"))
    m = n.groupBy(*by, unit).agg(F.sum("_n").alias("_m")).where("_m > 1")
    pairable = n.join(m, [*by, unit])
    observed = pairable.groupBy(*by).agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_n")) / (F.col("_m") - 1)).alias("_o"))
    of_value = pairable.groupBy(*by, value).agg(F.sum("_n").alias("_c"))
    expected = of_value.groupBy(*by).agg(F.sum("_c").alias("_t"), F.sum(F.col("_c") * F.col("_c")).alias("_s"))
    e = (F.col("_t") * F.col("_t") - F.col("_s")) / (F.col("_t") - 1)
    return observed.join(expected, by).select(*by, F.when(F.col("_s") == F.col("_t") * F.col("_t"), 1.0).otherwise(1 - F.col("_o") / e).alias("alpha"))


def mean_alpha(alphas: DataFrame, least: float = RELIABLE, digits: int = 4) -> DataFrame:
    """mean_alpha over the documents that have one, n, and whether it reaches `least`; one row. alphas: alpha."""
    mean = F.avg("alpha")
    return alphas.agg(F.round(mean, digits).alias("mean_alpha"), F.count("alpha").alias("n"), F.coalesce(mean >= least, F.lit(False)).alias("acceptable"))
