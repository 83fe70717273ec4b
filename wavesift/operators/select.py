"""Selection, corrections and index remapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_range(df: DataFrame, field: str, low, high) -> DataFrame:
    """low <= field <= high."""
    return df.filter(F.col(field).between(low, high))


def select_match(df: DataFrame, field: str, value) -> DataFrame:
    return df.filter(F.col(field) == value)


def select_func(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def pull_records(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    return df.filter(F.col(key).isin(*ids))


def new_fields(df: DataFrame, **defaults) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in defaults.items()})


def add_records(df: DataFrame, records: DataFrame) -> DataFrame:
    return df.unionByName(records, allowMissingColumns=True)


def insert_records(df: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``records`` in place of the rows with their keys."""
    return df.join(records.select(key), key, "left_anti").unionByName(records)


def modify_add(df: DataFrame, predicate: Column, **changes) -> DataFrame:
    """Selected rows once more, with changed fields."""
    return df.unionByName(df.filter(predicate).withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()}))


def frame_filter(frames: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Frames whose key is in ``valid``."""
    return frames.join(valid.select(key), key, "left_semi")


def subtract_dark(raw: Column, dark: Column) -> Column:
    return F.when(raw < dark, 0.0).otherwise(raw - dark)


def dark_flat(raw: Column, dark: Column, flat: Column) -> Column:
    return subtract_dark(raw, dark) / flat


def norm_gate(df: DataFrame, value: str, reference: str, k: float) -> DataFrame:
    """value / reference x mean where the reference is within k standard deviations of its mean, else value."""
    mu, sd = df.agg(F.avg(reference)).scalar(), df.agg(F.stddev_pop(reference)).scalar()
    inside = F.abs(F.col(reference) - mu) < k * sd
    out = F.when(inside, F.col(value) / F.col(reference) * mu).otherwise(F.col(value))
    return df.withColumn("normalised", out).withColumn("in_gate", inside)


def scan_subset(index: Column, skip: int, box: dict[str, tuple[Column, float, float]]) -> Column:
    """Every ``skip``-th index whose coordinates are inside the bounding box, ends included."""
    keep = F.pmod(index, F.lit(skip)) == 0
    for c, low, high in box.values():
        keep = keep & c.between(low, high)
    return keep


def switch_orientation(row: Column, col: Column, height: int, width: int, orientation: int) -> tuple[Column, Column]:
    """New (row, col): bit 4 transposes, then bit 2 flips up-down, then bit 1 left-right."""
    if orientation & 4:
        row, col, height, width = col, row, width, height
    if orientation & 2:
        row = height - 1 - row
    if orientation & 1:
        col = width - 1 - col
    return row, col


def crop_pad(df: DataFrame, keys: Sequence[str], index: str, value: str, size: int, new_size: int, center: int | None = None, fill: float = 0.0) -> DataFrame:
    """One axis cropped or padded about ``center`` (size // 2): every key gets new_size indices."""
    c = size // 2 if center is None else center
    shift = new_size // 2 - c
    grid = df.select(*keys).distinct().withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(new_size - 1))))
    moved = df.select(*keys, (F.col(index) + shift).cast("int").alias(index), F.col(value)).filter(F.col(index).between(0, new_size - 1))
    return grid.join(moved, [*keys, index], "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def confine(x: Column, n: int) -> Column:
    """Wrapped to [-n/2, n/2)."""
    h = n // 2
    return F.pmod(x + h, F.lit(n)) - h


def upsample(df: DataFrame, keys: Sequence[str], axes: Sequence[str], value: str, factor: int) -> DataFrame:
    """Nearest neighbour: each pixel becomes factor^axes pixels that share its value."""
    out = df
    for a in axes:
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(a, F.col(a) * factor + F.col("_k")).drop("_k")
    return out.withColumn(value, F.col(value) / factor ** len(axes)).select(*keys, *axes, value)


def read_view(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], row: str = "r", col: str = "c") -> DataFrame:
    """The part of a long image inside a window, ends exclusive, in the window's own indices."""
    inside = F.col(row).between(rows[0], rows[1] - 1) & F.col(col).between(cols[0], cols[1] - 1)
    return pixels.filter(inside).withColumn(row, F.col(row) - rows[0]).withColumn(col, F.col(col) - cols[0])


def write_view(pixels: DataFrame, patch: DataFrame, at: tuple[int, int], keys: Sequence[str], value: str, row: str = "r", col: str = "c") -> DataFrame:
    """``pixels`` with the values of a patch laid over them at (row, col); what falls outside is cut off."""
    new = patch.select(*keys, (F.col(row) + at[0]).alias(row), (F.col(col) + at[1]).alias(col), F.col(value).alias("_new"))
    return pixels.join(new, [*keys, row, col], "left").withColumn(value, F.coalesce("_new", F.col(value))).drop("_new")


def mirror(index: Column, size: int) -> Column:
    return size - 1 - index
