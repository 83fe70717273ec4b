"""Assignment of frames to workers, chunks and tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavesift.plans.session import checkpoint


def block_sizes(n: int, ranks: int, load: Sequence[int] | None = None) -> list[int]:
    """Contiguous blocks that even out the load: ranks above the mean get none, the last ones the remainder."""
    load = list(load or [0] * ranks)
    total = sum(load) + n
    free = [r for r in range(ranks) if total > load[r] * ranks]
    if not free:  # nothing to deal
        return [0] * ranks
    goal = sum(load[r] for r in free) + n
    parts = [divmod(goal - load[r] * len(free), len(free)) for r in free]
    sizes = [p for p, _ in parts]
    for k in range(sum(q for _, q in parts) // len(free)):
        sizes[-1 - k] += 1
    out = [0] * ranks
    for r, s in zip(free, sizes, strict=True):
        out[r] = s
    return out


def numbered(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 in global order without a single-task window.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the sizes of the partitions before, a few numbers on the driver.
    """
    part = checkpoint(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = part.withColumn("_p", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before, total = [], 0
    for p, n in sorted((r["_p"], r["n"]) for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each partition
        before += [(p, total)]
        total += n
    starts = df.sparkSession.createDataFrame(before, "_p long, _b long")
    return part.join(F.broadcast(starts), "_p").withColumn(name, F.col("_k") + F.col("_b")).drop("_m", "_p", "_k", "_b")


def assign_ranks(df: DataFrame, order: Sequence[str], ranks: int, n: int) -> DataFrame:
    """Adds the rank of each row when rows are dealt in ``order`` in blocks as block_sizes says."""
    ends, at = [], 0
    for s in block_sizes(n, ranks):
        at += s
        ends.append(at)
    rank = F.lit(ranks - 1)
    for r in range(ranks - 2, -1, -1):
        rank = F.when(F.col("_n") < ends[r], r).otherwise(rank)
    return numbered(df, order, "_n").withColumn("rank", rank.cast("int")).drop("_n")


def chunked(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Adds the chunk of each row: ``size`` rows each, the last one short."""
    return numbered(df, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def tile(x: Column, y: Column, n: int) -> Column:
    """Spatial tile of normalised coordinates: the unit square is cut into about sqrt(n) by sqrt(n) tiles."""
    layers = max(1, round(n**0.5))
    per = n // layers
    return (F.floor(x * layers) + layers * F.floor(y * per)).cast("long")


def normalised(df: DataFrame, columns: Sequence[str], border: float = 0.01) -> DataFrame:
    """Adds n_<column>: scaled to [0, 1) with a border on either side."""
    out = df
    for c in columns:
        lo, hi = df.agg(F.min(c)).scalar(), df.agg(F.max(c)).scalar()
        out = out.withColumn(f"n_{c}", (F.col(c) - (lo - border * (hi - lo))) / ((hi - lo) * (1 + 2 * border)))
    return out


def region(x: Column, y: Column, n: int, how: str = "rect") -> Column:
    """One of ``n`` parts of the unit square: tiles, slices of angle about the middle, rows or columns."""
    if how == "rect":
        return tile(x, y, n)
    along = {"angle": (F.atan2(y - 0.5, x - 0.5) / (2 * math.pi)) + 0.5, "row": y, "column": x}[how]
    return F.least(F.floor(along * n), F.lit(n - 1)).cast("long")


#: Rows of cuts that are broadcast; with more, rows are joined to them.
CUTS = 50_000
#: Ranks of approximate quantiles are wrong by a part of 1 / ACCURACY of a region at most.
ACCURACY = 10_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= CUTS else df


def _cuts(out: DataFrame, shares: Sequence[float], half: Column) -> DataFrame:
    """(_base, _x, _cut, _at): the last row of each region's first part, by value and key; ``_x`` where x parts it.

    Approximate quantiles bracket that row; rows below the bracket are counted and only those
    within are ranked. Where a bracket has missed it, the whole region is its bracket.
    """
    over = F.col("_m") > 1
    pick = F.array_position(F.array(*[F.lit(s) for s in shares]), F.floor(F.col("_m") / 2) / F.col("_m")).cast("int")
    for slack in (4 / ACCURACY, 1.0):
        ends = {f"{f.__name__}_{c}": f(c) for c in ("_u", "_v") for f in (F.min, F.max)}
        around = {f"{side}{c}": F.percentile_approx(F.coalesce(c, F.lit(math.inf)), F.array(*[F.lit(min(max(s + d, 0.0), 1.0)) for s in shares]), F.lit(ACCURACY)) for c in ("_u", "_v") for side, d in (("lo", -slack), ("hi", slack))}
        own = out.filter(over).groupBy("_base", "_m").agg(F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in ends.items()], *[e.alias(k) for k, e in around.items()])
        across_x = F.coalesce(F.col("max__u") - F.col("min__u") >= F.col("max__v") - F.col("min__v"), F.lit(False))
        side = lambda k: F.when(F.col("_x"), F.element_at(f"{k}_u", pick)).otherwise(F.element_at(f"{k}_v", pick)).alias(f"_{k}")
        own = checkpoint(own.withColumn("_x", across_x).select("_base", "_x", F.ceil(half * F.col("_n") / F.col("_m")).alias("_rank"), side("lo"), side("hi")))
        value = F.coalesce(F.when(F.col("_x"), F.col("_u")).otherwise(F.col("_v")), F.lit(math.inf)).alias("_cut")
        near = out.filter(over).join(_small(own), "_base").select("_base", "_x", "_rank", "_lo", "_hi", value, F.col("_key").alias("_at")).filter("_cut <= _hi")
        inside = {c: F.when(F.col("_cut") >= F.col("_lo"), F.col(c)) for c in ("_at", "_cut")}
        ranked = near.withColumns(inside).groupBy("_base", "_x", "_rank", "_cut", "_at").agg(F.count(F.lit(1)).alias("_rows"))
        upto = Window.partitionBy("_base").orderBy(F.asc_nulls_first("_cut"), F.asc_nulls_first("_at"))
        ranked = ranked.withColumn("_upto", F.sum("_rows").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        found = checkpoint(ranked.filter("_cut is not null and _upto >= _rank and _upto - _rows < _rank").select("_base", "_x", "_cut", "_at"))
        if found.count() == own.count():
            break
    return found


def by_load(df: DataFrame, x: str, y: str, key: str, domains: int, name: str = "domain") -> DataFrame:
    """Adds one of ``domains`` regions with as many rows each but for one, however rows cluster.

    The plane is halved again and again across the longer side of a region, at the
    row that parts its share of the rows. Coordinates count as pixels: rows of one
    pixel are told apart by ``key`` (a whole number), so that a crowded pixel can be
    cut, too; of rows that are level even so, those of the smaller key come first. Rows
    of one key and pixel stay together. Places that are null come last.
    """
    shift = F.col(key) * 7919 % F.lit(10007) / 10007
    start = {"_base": F.lit(0), "_m": F.lit(domains), "_u": F.col(x) + shift, "_v": F.col(y) + shift, "_key": F.col(key)}
    half = F.floor(F.col("_m") / 2).cast("int")
    value = F.coalesce(F.when(F.col("_x"), F.col("_u")).otherwise(F.col("_v")), F.lit(math.inf))
    left = F.coalesce((value < F.col("_cut")) | ((value == F.col("_cut")) & (F.col("_key") <= F.col("_at"))), F.lit(False))
    split = (F.col("_m") > 1) & ~F.col("_left")

    def parted(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        joined = rows.join(_small(cuts), "_base", "left").withColumn("_left", left)
        return joined.withColumns({"_base": F.when(split, F.col("_base") + half).otherwise(F.col("_base")), "_m": F.when(F.col("_m") == 1, 1).when(F.col("_left"), half).otherwise(F.col("_m") - half)}).drop("_x", "_cut", "_at", "_left")

    out, sizes = df.withColumns(start), {domains}
    if domains > 1:
        narrow = checkpoint(out.select(*start))  # passes that look for cuts read no more than this
    while any(m > 1 for m in sizes):
        cuts = _cuts(narrow, sorted({(m // 2) / m for m in sizes if m > 1}), half)
        out, narrow = parted(out, cuts), parted(narrow, cuts)
        sizes = {h for m in sizes for h in ((m // 2, m - m // 2) if m > 1 else (1,))}
    return out.withColumn(name, F.col("_base").cast("long")).drop(*start)
