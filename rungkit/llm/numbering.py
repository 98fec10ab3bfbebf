"""Places within groups without a task that holds a group: rows are
range-partitioned by (group, order), counted within partitions, and shifted by
the counts of the partitions before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungkit.llm.common import saved


def numbered(df: DataFrame, group: str, order: list[str], keep_n: str = "n") -> DataFrame:
    """``df`` with ``idx`` (place within the string column ``group``, from 0)
    and the group's rows as ``keep_n``.  Rows that ``order`` does not tell
    apart may stand in any order; nulls come first; a null group is a group.
    ``df`` is read twice (for the ranges), so it should be a written table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0                     # the group that the batch before ended in
        for b in batches:
            g = b.column(group).to_pylist()
            spot = []
            for x in g:
                seen = seen + 1 if (x,) == last else 0
                last = (x,)
                spot.append(seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spot, pa.int64())], [*b.schema.names, "spot"])

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    parted = saved(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("part", F.spark_partition_id())
                   .mapInArrow(count, f"{kinds}, part int, spot bigint"), "numbered")
    counts = parted.groupBy("part", group).agg(F.count("*").alias("here"))      # a row for each partition and group in it
    w = Window.partitionBy(group).orderBy("part")
    counts = counts.select(F.col("part").alias("c_part"), F.col(group).alias("c_group"),
                           (F.sum("here").over(w) - F.col("here")).alias("before"),
                           F.sum("here").over(Window.partitionBy(group)).alias(keep_n))
    return (parted.join(counts, (F.col("part") == F.col("c_part")) & F.col(group).eqNullSafe(F.col("c_group")))
            .withColumn("idx", F.col("before") + F.col("spot")).drop("part", "spot", "before", "c_part", "c_group"))
