"""Cutting the lineage of iterative jobs, and places of rows in an order of all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, once: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; ``once``: what was shuffled for it is deleted then, as it is not run again.

    The folder is that of spark.checkpoint.dir; only a local session without
    one takes a temporary folder of its own.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    held, free = spark.conf.get(FREE, None), df
    if once:
        spark.conf.set(FREE, "true")
        free = df.select("*")  # planned under the setting
    try:
        free.write.parquet(path)
    finally:
        if once:
            spark.conf.set(FREE, held) if held is not None else spark.conf.unset(FREE)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path  # for drop_cut
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a step that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with the place, from 0, of each row in the order of ``by`` as column ``name``.

    Rows are dealt by ranges and sorted within them; each range starts where those
    before it end, so no window goes over all rows.
    """
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt)
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + low).alias(name))
