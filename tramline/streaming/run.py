"""Running a stream over what its source holds now, to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.operators.components import shared_folder


def drained(stream: DataFrame, mode: str = "append", timed: bool = False) -> DataFrame:
    """All rows that a stream gives until its source has no more, with ``batch``; one micro-batch only if ``timed``, as
    operators with processing-time limits never come to rest.

    Each micro-batch overwrites a folder of its own, so one that is run again after a failure counts once.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(**({"once": True} if timed else {"availableNow": True})).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a sink that keeps the last row of each key holds after an update stream. [T3]"""
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, "m.*")


def staged(rows: DataFrame, by: str, values: list) -> tuple[DataFrame, str]:
    """A stream that gives the rows of each value of ``by`` as one micro-batch, in the order of ``values``; and its folder."""
    spark: SparkSession = rows.sparkSession
    root = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    for value in values:
        rows.where(F.col(by) == value).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root), root
