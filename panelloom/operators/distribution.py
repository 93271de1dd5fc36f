"""Distances between distributions, ranks, information and neighbourhoods.

The one-dimensional measures work on the distinct values with their counts a side, so repeated values shrink before the
ordered pass. With `group` columns each group is measured for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import edges_below
from .ordered import cumulated, quantiles, quantiles_of, row_numbers
from .vector_index import build, search


def distances(df: DataFrame, x: str, side: Column, group: list[str]) -> DataFrame:
    """(group, wasserstein, ks, auc): of the rows where `side` holds against the others. auc is the chance that a row of
    the first is larger, ties half; null without rows on both sides."""
    c = cumulated(df, x, side, group)
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    both = (F.col("na") > 0) & (F.col("nb") > 0)
    win = F.col("a") * (F.col("cb") - F.col("b") / 2)
    out = c.where(both).groupBy(*group).agg(
        F.coalesce(F.sum(gap * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("wasserstein"), F.max(gap).alias("ks"), (F.sum(win) / F.max(F.col("na") * F.col("nb"))).alias("auc")
    )
    return out


def ks_p_value(ks: Column, na: Column, nb: Column, terms: int = 100) -> Column:
    """Of the two-sample statistic, by the asymptotic series 2 * sum of (-1)^(k-1) * exp(-2 k^2 s^2), s^2 = ks^2 * na nb / (na + nb);
    within 0 and 1."""
    s2 = ks * ks * na * nb / (na + nb)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * s2))
    return F.when(s2 <= 0.02, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))


def total_variation(df: DataFrame, category: str, side: Column, missing: str = "<none>") -> DataFrame:
    n = df.groupBy(F.coalesce(F.col(category), F.lit(missing)).alias("c")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    t = n.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return n.join(F.broadcast(t)).agg((F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("tvd"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10, least: int = 50) -> DataFrame:
    """In nats, over bins at the distinct deciles; the maximum has a bin of its own; 0 below `least` rows."""
    v = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    edges = quantiles_of(v, [(x, "__ex"), (y, "__ey")], [i / bins for i in range(bins + 1)]).select(*[F.array_distinct(e).alias(e) for e in ("__ex", "__ey")])
    at = lambda c, e: edges_below(F.col(c), e, bins + 1) - 1
    b = v.join(F.broadcast(edges)).groupBy(at(x, "__ex").alias("bx"), at(y, "__ey").alias("by")).agg(F.count("*").alias("n"))
    over = lambda c: F.sum("n").over(Window.partitionBy(c))  # noqa: E731  (bins + 1) ** 2 rows at most
    j = b.withColumns({"nx": over("bx"), "ny": over("by"), "nt": over(F.lit(0))})
    mi = F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny"))))
    return j.agg(F.when(F.max("nt") >= least, mi).otherwise(F.lit(0.0)).alias("mi"))


def correlations(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, a, b, r) of each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs])
    return df.groupBy(*(group or [])).agg(cells.alias("__c")).select(*(group or []), F.explode("__c").alias("__p")).select(*(group or []), "__p.*")


def correlation_difference(df: DataFrame, cols: list[str], side: Column) -> DataFrame:
    """(a, b, difference, norm): of the two sides' matrices, with the Frobenius norm of the whole."""
    c = correlations(df.withColumn("__s", side), cols, ["__s"])
    d = c.groupBy("a", "b").agg((F.max(F.when(F.col("__s"), F.col("r"))) - F.max(F.when(~F.col("__s"), F.col("r")))).alias("difference"))
    total = d.agg(F.sqrt(2 * F.sum(F.col("difference") * F.col("difference"))).alias("norm"))
    return d.join(F.broadcast(total))


def tail_exceedance(df: DataFrame, x: str, side: Column, group: list[str], p: float = 0.99) -> DataFrame:
    """Share of the rows where `side` holds above the others' p-quantile."""
    cut = quantiles(df.where(~side), x, [p], group).select(*group, F.col("q")[0].alias("cut"))
    return df.where(side).join(cut, group).groupBy(*group, "cut").agg(F.count("*").alias("n"), F.avg((F.col(x) > F.col("cut")).cast("int")).alias("above"))


def accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, and its mean over the true classes."""
    c = df.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("hit"))
    return c.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def neighbour_overlap(df: DataFrame, vec: str, id_col: str, label: str, k: int = 20, every: int = 1, pivots: int | None = None) -> DataFrame:
    """(label, n, mean, median) of the share of other labels among the k nearest of each query. Queries are the ids that `every`
    divides, searched among all rows by the metric index. Null vectors have no neighbours and are none."""
    queries = df.where(F.col(id_col) % every == 0)
    n, _ = search(build(df, vec, id_col, pivots), queries, vec, id_col, k)
    tags = df.select(F.col(id_col).alias("id"), F.col(label).alias("__l"))
    j = n.join(tags, "id").join(queries.select(F.col(id_col).alias("query"), F.col(label).alias("label")), "query")
    per = j.groupBy("query", "label").agg(F.avg((F.col("__l") != F.col("label")).cast("int")).alias("share"))
    return per.groupBy("label").agg(F.count("*").alias("n"), F.avg("share").alias("mean"), F.percentile("share", F.lit(0.5)).alias("median"))


def centroid_separation(df: DataFrame, vec: str, side: Column) -> DataFrame:
    """Distance of the two sides' centroids over the root of their mean total (sample) variance."""
    e = df.select(side.alias("__s"), F.posexplode(vec).alias("dim", "x"))
    m = e.groupBy("dim", "__s").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    d = m.groupBy("dim").agg((F.max(F.when(F.col("__s"), F.col("m"))) - F.max(F.when(~F.col("__s"), F.col("m")))).alias("d"), F.sum("v").alias("v"))
    return d.agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) / F.sqrt(F.sum("v") / 2)).alias("separation"))


def first_below(errors: DataFrame, k: str, cols: list[str], limit: float) -> DataFrame:
    """The first k at which all errors are below the limit, and whether the first one never rises along k."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c) < limit)
    rows = row_numbers(errors.withColumn("__ok", ok), k, [], out="__i")
    before = rows.select((F.col("__i") + 1).alias("__i"), F.col(cols[0]).alias("__before"))
    rows = rows.join(before, "__i", "left").withColumn("__down", F.coalesce(F.col(cols[0]) <= F.col("__before"), F.lit(True)))
    return rows.agg(F.min(F.when(F.col("__ok"), F.col(k))).alias("first_k"), F.bool_and("__down").alias("monotone"))


def relative_error(df: DataFrame, a: str, b: str, floor: float = 0.1, least: int = 10, limit: float = 0.01) -> DataFrame:
    big = df.where(F.col(b) > floor)
    return big.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(a) - F.col(b)) / F.col(b)).alias("error")).withColumn("passed", (F.col("n") > least) & (F.col("error") < limit))


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def mae_ratio(df: DataFrame, truth: str, model: str, baseline: str, group: list[str]) -> DataFrame:
    """(group, mae, mae_baseline, ratio): the ratio is null where the baseline has no error."""
    g = df.groupBy(*group).agg(F.avg(F.abs(F.col(truth) - F.col(model))).alias("mae"), F.avg(F.abs(F.col(truth) - F.col(baseline))).alias("mae_baseline"))
    return g.withColumn("ratio", F.col("mae") / F.nullif("mae_baseline", F.lit(0.0)))
