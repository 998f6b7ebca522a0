"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atrium.scratch import Scratch


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their number from 1 among the rows of equal ``keys``, by ``order`` (of equal ones in any order).

    Rows are dealt by ranges of key and order, so one key may fill many partitions. A row's place in its
    partition comes from the sort; what lies before the partition, from one count for each partition and key.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    kept = scratch.keep("rows", dealt)
    spans = kept.groupBy("_p", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)]]
    return kept.join(before, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
