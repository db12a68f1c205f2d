"""Statistics of trials and the report they go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(column: str) -> Column:
    """Mean of the middle two for an even count."""
    return F.percentile(column, F.lit(0.5))


def upper_median(column: str) -> Column:
    """Element floor(n / 2) of the sorted values: counted from above, the first that half of them reach. Values are
    counted in parts before the shuffle and never listed."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")


def percentiles(column: str, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> list[Column]:
    """Interpolated between neighbours."""
    return [F.percentile(column, F.lit(p)).alias(f"p{round(100 * p)}") for p in points]


PARTS = 64  # ranges of values with about as many rows each
FEW = 10_000  # groups up to which a row per group goes to all tasks


def _part(value: Column, edges: list, first: int = 0) -> Column:
    """Number of edges at or below the value, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(value < F.lit(edges[mid]), _part(value, edges[:mid], first)).otherwise(_part(value, edges[mid + 1 :], first + mid + 1))


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float | None]) -> DataFrame:
    """(keys, names of `wanted`): the percentile of each name as `percentiles` has it, for None the upper median. Exact, and
    no task gathers a group: values are counted by range, and only the ranges that hold a wanted rank are
    looked at value by value. The edges come from a sketch, which decides how much is read, not what comes out."""
    own = {f"_k{i}": k for i, k in enumerate(keys)}
    base = rows.select(*[F.col(k).alias(n) for n, k in own.items()], F.col(value).alias("_v"))
    points = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    edges, groups = base.agg(F.percentile_approx("_v", points, 10_000), F.approx_count_distinct(F.struct(*own))).first()
    base = base.withColumn("_part", F.when(F.col("_v").isNull(), -1).otherwise(_part(F.col("_v"), sorted(set(edges or ())))))
    ranks = {n: F.floor(F.col("_n") / 2).cast("double") if p is None else (F.col("_n") - 1) * F.lit(p) for n, p in wanted.items()}
    ends = [f(r) for r in ranks.values() for f in (F.floor, F.ceil)]
    counted = base.groupBy(*own, "_part").agg(F.count("_v").alias("_c"))
    group = Window.partitionBy(*own)
    counted = counted.withColumns({"_n": F.sum("_c").over(group), "_below": F.sum("_c").over(group.orderBy("_part")) - F.col("_c")})
    inside = lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c"))
    hit = F.lit(False)
    for e in ends:
        hit = hit | inside(e)
    held = counted.where(hit | (F.col("_n") == 0)).select(*[F.col(n).alias(f"{n}h") for n in own], F.col("_part").alias("_parth"), "_n", "_below")
    same = F.col("_part") == F.col("_parth")
    for n in own:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}h"))
    near = base.join(F.broadcast(held) if groups <= FEW else held, same).groupBy(*own, "_part", "_n", "_below", "_v").agg(F.count("_v").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*own, "_part").orderBy("_v")) - F.col("_c")
    near = near.withColumns({"_below": F.col("_below") + before, "_d": F.col("_v").cast("double")})
    picked = [F.max(F.when(inside(e), F.col("_d"))).alias(f"_e{i}") for i, e in enumerate(ends)]
    found = near.groupBy(*own, "_n").agg(*picked)
    out = []
    for i, (n, r) in enumerate(ranks.items()):
        lo, hi = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(r) - r) * lo + (r - F.floor(r)) * hi).alias(n))
    return found.select(*[F.col(n).alias(k) for n, k in own.items()], *out)


def summary(trials: DataFrame, keys: list[str], size: str, ms: str, out: str) -> DataFrame:
    """Range and median of the time, throughput of the sums and mean of the single ones, ratio."""
    found = trials.groupBy(*keys).agg(
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
        (F.sum(size) / F.sum(ms) / 1000).alias("total_mb_s"), F.avg(F.col(size) / F.col(ms) / 1000).alias("mean_mb_s"),
        (100 * F.sum(out) / F.sum(size)).alias("ratio"),
    )
    middle = order_statistics(trials, keys, ms, {"median_ms": 0.5}).select(*[F.col(k).alias(f"_{k}") for k in keys], "median_ms")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return found.join(middle, same).select(*keys, "median_ms", *[c for c in found.columns if c not in keys])


def consistent(trials: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whether all trials of a key agree in each column; null counts as a value of its own."""
    return trials.groupBy(*keys).agg(*[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == 1).alias(f"same_{c}") for c in columns])


def upsert(report: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of the same key, whatever its case; the others are added."""
    fold = lambda c: F.lower(F.col(c))
    kept = report.alias("r").join(new.alias("n"), fold(f"r.{key}") == fold(f"n.{key}"), "left_anti")
    return kept.unionByName(new)
