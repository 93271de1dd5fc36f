"""Encoding of wide attributes into long tokens, vocabularies, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_numbers
from .positions import positions

from ..functions.scalar import bucket, normalize_item, to_number, truthy


def emit_tokens(df: DataFrame, key: str, continuous: list[str], binary: list[str], categorical: list[str], stats: DataFrame) -> DataFrame:
    """(key, item, kind, value): z-scores of present numbers, 1 for each positive flag, 1 for each present category as
    "column:value". `stats` is (col, mean, std), a row a continuous column. One pass over the wide rows."""
    cells = [F.struct(F.lit(c).alias("item"), F.lit("continuous").alias("kind"), to_number(F.col(c).cast("string")).alias("value")) for c in continuous]
    cells += [F.struct(F.lit(c).alias("item"), F.lit("binary").alias("kind"), F.when(truthy(F.col(c)), F.lit(1.0)).alias("value")) for c in binary]
    for c in categorical:
        name = F.concat(F.lit(f"{c}:"), normalize_item(F.col(c)))
        cells.append(F.struct(name.alias("item"), F.lit("categorical").alias("kind"), F.when(F.col(c).isNotNull(), F.lit(1.0)).alias("value")))
    long = df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").where("value is not null")
    z = long.join(stats.withColumnRenamed("col", "item"), "item", "left")
    return z.select(key, "item", "kind", F.when(F.col("kind") == "continuous", (F.col("value") - F.col("mean")) / F.col("std")).otherwise(F.col("value")).alias("value"))


def train_stats(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    from .aggregates import fit_normalization

    return fit_normalization(df, cols, train)


def vocabulary(df: DataFrame, col: str, train: Column, least: int, other: str = "other") -> DataFrame:
    """(raw, item) of all values: those that `least` training rows have keep their normalised name."""
    counts = df.groupBy(F.col(col).alias("raw")).agg(F.count_if(train).alias("n_train"))
    return counts.select("raw", F.when(F.col("n_train") >= least, normalize_item(F.col("raw"))).otherwise(F.lit(other)).alias("item"), "n_train")


def apply_vocabulary(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    return df.join(vocab.select(F.col("raw").alias(col), F.col("item").alias(out)), col, "left")


def token_coverage(tokens: DataFrame, cases: DataFrame, key: str, group: str, items: DataFrame) -> DataFrame:
    """(item, group, n_cases, n_emitted, fraction, mask): mask 1 where no case of the group has the item, else null."""
    n_cases = cases.groupBy(group).agg(F.countDistinct(key).alias("n_cases"))
    n = tokens.join(cases.select(key, group), key).groupBy("item", group).agg(F.countDistinct(key).alias("n_emitted"))
    dims = items.select("item").distinct().crossJoin(n_cases)  # items x groups
    out = dims.join(n, ["item", group], "left").withColumn("n_emitted", F.coalesce("n_emitted", F.lit(0)))
    return out.select("item", group, "n_cases", "n_emitted", (F.col("n_emitted") / F.col("n_cases")).alias("fraction"), F.when(F.col("n_emitted") == 0, 1).alias("mask"))


def to_matrix(tokens: DataFrame, key: str, items: list[str]) -> DataFrame:
    """Wide rows of the listed items, 0 where a case lacks one."""
    return tokens.groupBy(key).pivot("item", items).agg(F.first("value")).fillna(0.0, subset=items)


def context_vector(tokens: DataFrame, key: str, items: list[str]) -> DataFrame:
    """Nullable columns of the listed items, and how many a case has."""
    wide = tokens.groupBy(key).pivot("item", items).agg(F.first("value"))
    return wide.withColumn("n_ctx", F.size(F.filter(F.array(*items), lambda x: x.isNotNull())))


def coherent(height_cm: Column, weight: Column, bmi: Column, tol: float = 0.05) -> Column:
    """Whether a stated index agrees with height and weight, and both are plausible; null if one is missing."""
    own = weight / F.pow(height_cm / 100, F.lit(2.0))
    return height_cm.between(50, 230) & weight.between(2, 300) & (F.abs(own - bmi) / bmi <= tol)


def split_of(key: Column, percent: int = 85) -> Column:
    """train or val by the key's hash bucket: all rows of a key fall together, and appends move none."""
    return F.when(bucket(key, 100) < percent, "train").otherwise("val")


def sample_per_group(df: DataFrame, group: list[str], key: Column, n: int, seed: str = "0") -> DataFrame:
    """The n rows of each group with the smallest hash of (seed, key). The rank is limited before the shuffle."""
    order = F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
    w = Window.partitionBy(*group).orderBy("__h")
    return df.withColumn("__h", order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__h", "__r")


def quota(df: DataFrame, group: list[str], order: list[str], share: Column) -> DataFrame:
    """Marks the first round(share * N) rows of each group, in the order of a number and then of the other columns."""
    rows = row_numbers(df, order[0], group, order[1:], "__r", "__n")
    return rows.withColumn("picked", F.col("__r") <= F.round(share * F.col("__n"))).drop("__r", "__n")


def stratified_folds(df: DataFrame, group: list[str], key: Column, folds: int = 5, seed: str = "f") -> DataFrame:
    """`df` with `fold`: rows of each class are dealt in the order of their keys' hash."""
    rows = df.withColumn("__h", F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256))
    rows = rows.withColumn("__x", F.conv(F.substring("__h", 1, 13), 16, 10).cast("double"))
    return row_numbers(rows, "__x", group, ["__h"], "__r").withColumn("fold", F.col("__r") % folds).drop("__h", "__x", "__r")


def largest_remainder(counts: DataFrame, group: list[str], n: str, total: int) -> DataFrame:
    """(group, n, take): `total` shared out in proportion to the counts; what rounding down leaves goes to the largest remainders
    (ties: the larger group, then the first). A row a group; never more than a group has."""
    whole = counts.agg(F.sum(n).alias("__t"))
    rows = counts.join(F.broadcast(whole)).withColumn("__q", F.col(n) * F.least(F.lit(total), F.col("__t")) / F.col("__t"))
    rows = rows.withColumn("__f", F.floor("__q"))
    rows = row_numbers(rows.withColumn("__neg", F.round(F.col("__f") - F.col("__q"), 12)), "__neg", [], [F.col(n).desc(), *group], "__i")
    left = rows.agg((F.least(F.lit(total), F.max("__t")) - F.sum("__f")).alias("__left"))
    return rows.join(F.broadcast(left)).select(*group, n, (F.col("__f") + (F.col("__i") <= F.col("__left")).cast("long")).alias("take"))


def in_scope(items: DataFrame, scopes: tuple[str, ...], item: str = "item", mark: str = ":") -> DataFrame:
    """The items whose scope, the part of their name before the mark (or all of it), is one of `scopes`."""
    return items.where(F.element_at(F.split(item, mark), 1).isin(*scopes))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256: the same everywhere."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def exponential(u: Column, mean: float) -> Column:
    return -F.log(1 - u) * mean


def normal(u: Column, v: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def lognormal(z: Column, mu: float, sigma: float) -> Column:
    """Of a standard normal number."""
    return F.exp(mu + sigma * z)


def poisson(u: Column, mean: float) -> Column:
    """Inversion: the least k whose cumulated probability reaches u. The sum goes on as far as 1 - 1e-16 of the mass can lie."""
    top = int(mean + 12 * mean**0.5 + 40)
    one = F.struct(F.lit(0).alias("k"), F.exp(F.lit(-float(mean))).alias("p"), F.exp(F.lit(-float(mean))).alias("s"))

    def more(a: Column, i: Column) -> Column:
        p = a["p"] * F.lit(float(mean)) / i
        return F.when(u > a["s"], F.struct(i.alias("k"), p.alias("p"), (a["s"] + p).alias("s"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), one, more)["k"]


def gamma(seed: str, shape: float, scale: float, *keys: Column, tries: int = 12) -> Column:
    """Rejection from a normal proposal (accepted 95 % of the time or more): the first of `tries` attempts, each with hashed numbers of
    its own, that is accepted. All fail with a probability below 1e-15; then the mean is given. Shapes below 1 are drawn from the next
    larger one and scaled by a power of a further number. The same on any partitioning."""
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3
    c = 1 / (9 * d) ** 0.5
    drawn = []
    for i in range(tries):
        x = normal(uniform(f"{seed}/{i}/x", *keys), uniform(f"{seed}/{i}/y", *keys))
        v = F.pow(1 + c * x, F.lit(3.0))
        taken = F.log(1 - uniform(f"{seed}/{i}/u", *keys)) < 0.5 * x * x + d - d * v + d * F.log(v)
        drawn.append(F.when((v > 0) & taken, d * v))
    out = F.coalesce(*drawn, F.lit(d)) * scale
    return out if shape >= 1 else out * F.pow(1 - uniform(f"{seed}/power", *keys), F.lit(1 / shape))


def balanced_folds(df: DataFrame, entity: str, folds: int = 5, seed: str = "f") -> DataFrame:
    """(entity, n, fold): all rows of an entity in one fold, and the folds' sizes apart by the largest entity's at most. Entities are
    dealt by descending size (ties by hash) forth and back; their order comes from global positions, so none sees all of them."""
    sizes = df.groupBy(entity).agg(F.count("*").alias("n")).withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(entity).cast("string"), F.lit(""))), 256))
    rows = positions(sizes, [F.col("n").desc(), "__h"], "__p")
    at = F.col("__p") % folds
    fold = F.when(F.floor(F.col("__p") / folds) % 2 == 0, at).otherwise(folds - 1 - at)
    return rows.select(entity, "n", fold.cast("int").alias("fold"))


def prefix_mask(x: Column, n: Column | int) -> Column:
    """The array's first n elements, the others 0."""
    return F.transform(x, lambda v, i: F.when(i < n, v).otherwise(F.lit(0).cast("double")))
