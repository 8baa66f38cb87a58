"""Dense ordinals without a single sorted partition a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Ordering keys that one task numbers at once.
SPAN = 1 << 20


def dense_index(df: DataFrame, group: str, order: str, name: str = "idx", span: int = SPAN) -> DataFrame:
    """df with name: 0, 1, ... within group by the integer column order.

    Rows are numbered within spans of the order, and each span is offset by the count of all spans
    before it; only the counts, a row a span, are summed over a whole group.
    """
    spans = df.withColumn("__span", F.floor(F.col(order) / span))
    counts = spans.groupBy(group, "__span").agg(F.count("*").alias("__n"))
    run = Window.partitionBy(group).orderBy("__span")
    offsets = counts.select(group, "__span", (F.sum("__n").over(run) - F.col("__n")).alias("__before"))
    own = Window.partitionBy(group, "__span").orderBy(order)
    return spans.join(offsets, [group, "__span"]).withColumn(name, F.col("__before") + F.row_number().over(own) - 1).drop("__span", "__before")


def global_index(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """df with name: 1, 2, ... by the order columns over all rows.

    Rows are dealt out by range and numbered where they are; the numbers of a range start after the
    counts of those before it. The ranges are written once, so that both uses see the same ones.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed)
    part = F.shiftright("__m", 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row a range
    own = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__p", part).join(offsets, "__p").withColumn(name, F.col("__before") + own + 1).drop("__p", "__m", "__before")
