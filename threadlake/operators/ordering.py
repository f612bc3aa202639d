"""Places, running sums and predecessors of rows within a key, also where one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.storage import sized, written


def ordered(rows: DataFrame, key: str, order: list[str | Column], name: str = "place", sums: dict[str, str | Column] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """rows with their place in the key from 0, sums of what stands before them, and values of the row before.

    No two rows of a key may be equal in `order`. Rows are dealt by ranges of key and order and sorted, so a
    hot key is many partitions; a written row number then gives each partition's first place. Sums and
    predecessors are taken inside each partition of a key by a window that never holds more than that, and
    what the partitions before it add is put in order for one row for each key and partition alone.
    """
    sums, previous = sums or {}, previous or {}
    rows = rows.withColumns({f"__{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
    rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__row", 33)
    totals = [F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"), *[F.sum(f"__{n}").alias(f"__all_{n}") for n in sums], *[F.max_by(c, "__row").alias(f"__last_{n}") for n, c in previous.items()]]
    counts = rows.groupBy(key, part.alias("__part")).agg(*totals)
    parts = Window.partitionBy(key).orderBy("__part")
    ahead = parts.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        key, "__part", (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__shift"),
        *[F.coalesce(F.sum(f"__all_{n}").over(ahead), F.lit(0)).alias(f"__before_{n}") for n in sums], *[F.lag(f"__last_{n}").over(parts).alias(f"__was_{n}") for n in previous],
    )
    out = rows.withColumn("__part", part)
    inside = Window.partitionBy(key, "__part").orderBy("__row")
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.sum(f"__{n}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for n, c in previous.items():
        out = out.withColumn(n, F.lag(F.struct(c)).over(inside))
    out = out.join(sized(written(starts, "starts")), [key, "__part"])
    out = out.withColumn(name, F.col("__row") + F.col("__shift"))
    out = out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums} | {n: F.when(F.col(n).isNotNull(), F.col(f"{n}.{c}")).otherwise(F.col(f"__was_{n}")) for n, c in previous.items()})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def numbered(rows: DataFrame, key: str, *order: str, name: str = "place") -> DataFrame:
    """rows with their place in the key from 0, by `order`, after which no two rows of a key may be equal."""
    return ordered(rows, key, list(order), name)
