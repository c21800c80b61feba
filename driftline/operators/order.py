"""Places in a global order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import stored


def placed(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place (from 1) in an order. They are sorted by ranges and written once; only the ranges' sizes, a row for each partition, go to one task."""
    at, part = f"__at_{name}", f"__part_{name}"
    laid = stored(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "placed")
    laid = laid.withColumn(part, F.shiftright(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = laid.join(F.broadcast(sizes.withColumnRenamed("before", f"__before_{name}")), part)  # a row for each partition of the sort
    place = F.col(f"__before_{name}") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return out.select(*rows.columns, place.cast("long").alias(name))
