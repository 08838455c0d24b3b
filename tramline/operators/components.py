"""Iterative operators: steps over tables until nothing changes, each written to reliable storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUNDS = 100


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: made once, and of a size that later joins know."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settled(start: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``step`` applied until ``done`` (or until rows stop changing)."""
    now, mark = checkpointed(start), None
    for _ in range(rounds):
        if done and done(now):
            return now
        now = checkpointed(step(now))
        if done is None:
            found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first())
            if found == mark:
                return now
            mark = found
    raise RuntimeError(f"not settled in {rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of an edge table u, v. [A18]

    Each round a node takes the least label around it and then that label's own label, so labels travel twice as far.
    """
    both = edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v").unionByName(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = checkpointed(both)
    start = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))

    def step(now: DataFrame) -> DataFrame:
        around = both.join(now.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        near = now.join(around, "node").select("node", F.least("component", "c").alias("component"))
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        return near.join(jump, "component", "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"))

    return settled(start, step)


def merged_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts of the same text that share their active periods or their informed entities, as one. [A19]

    ``alerts``: alert_id, text, periods (array of start-end structs), entities (array of strings). Members of a group
    link to its least id (a star, not all pairs); the components of both kinds of groups are merged under their least id,
    with the distinct periods and entities of all.
    """
    keys = alerts.select("alert_id", "text", F.sort_array("periods").alias("p"), F.sort_array("entities").alias("e"))
    links = [keys.select("alert_id", F.min("alert_id").over(Window.partitionBy("text", k)).alias("v")).select(F.col("alert_id").alias("u"), "v") for k in ("p", "e")]
    groups = components(links[0].unionByName(links[1]))
    joined = alerts.join(groups, F.col("alert_id") == F.col("node")).groupBy("component").agg(F.min("text").alias("text"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("periods")))).alias("periods"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"))
    return joined.withColumnRenamed("component", "alert_id")


def shortest_costs(edges: DataFrame, sources: DataFrame, longest: float, rounds: int = ROUNDS) -> DataFrame:
    """``source``, ``node``, ``cost`` of every node within ``longest`` of a source, by relaxing the frontier. [G3, G5, G6, O7]

    ``edges``: a, b, cost (>= 0); ``sources``: source, node. Each round joins only the nodes that the last one improved.
    """
    best = checkpointed(sources.select("source", "node", F.lit(0.0).alias("cost")).distinct())
    frontier = best
    for _ in range(rounds):
        reached = frontier.join(edges.select(F.col("a").alias("node"), "b", F.col("cost").alias("step")), "node").select("source", F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= longest)
        merged = best.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False))).groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min(F.when(F.col("old"), F.col("cost"))).alias("before"))
        merged = checkpointed(merged)
        best = merged.select("source", "node", "cost")
        frontier = merged.where("before IS NULL OR cost < before").select("source", "node", "cost")
        if frontier.isEmpty():
            return best
    raise RuntimeError(f"costs not settled in {rounds} rounds")


def foot_cost(metres, big_street, car_free, unsuited, elevator, steps, wheelchair: bool = False):
    """Seconds to walk an edge; null where it can't be. [G2]"""
    pace = F.lit(1.2) - F.when(big_street, 0.2).otherwise(0.0) + F.when(car_free, 0.1).otherwise(0.0)
    cost = F.when(elevator, F.lit(90.0)).otherwise(F.round(metres / pace) + F.when(unsuited, 90.0).otherwise(0.0))
    return F.when(~(steps & F.lit(wheelchair)), cost)


def earliest_arrivals(calls: DataFrame, footpaths: DataFrame, start_stop: object, departure: int, rounds: int = 12) -> DataFrame:
    """stop_id, arrival and transfers: earliest arrival by up to ``rounds`` rides from a stop. [G8, G7]

    ``calls``: trip_id, stop_sequence, stop_id, arrival, departure; ``footpaths``: from_stop, to_stop, seconds. A round
    boards every trip at the first stop that was reached in time in the round before, rides it to its later stops, and
    walks on; only improvements go on to the next.
    """
    schema_start = calls.sparkSession.createDataFrame([(start_stop, departure, 0)], calls.select("stop_id", F.col("arrival").cast("long"), F.lit(0).cast("int").alias("rides")).schema)

    def walked(frame: DataFrame) -> DataFrame:
        on = frame.join(footpaths.select(F.col("from_stop").alias("stop_id"), "to_stop", "seconds"), "stop_id").select(F.col("to_stop").alias("stop_id"), (F.col("arrival") + F.col("seconds")).alias("arrival"), "rides")
        return frame.unionByName(on)

    best = checkpointed(walked(schema_start).groupBy("stop_id").agg(F.min(F.struct("arrival", "rides")).alias("m")).select("stop_id", "m.arrival", "m.rides"))
    frontier = best
    for ride in range(1, rounds + 1):
        boards = calls.join(frontier.select("stop_id", F.col("arrival").alias("ready")), "stop_id").where("departure >= ready").groupBy("trip_id").agg(F.min("stop_sequence").alias("from_seq"))
        off = calls.join(boards, "trip_id").where("stop_sequence > from_seq").groupBy("stop_id").agg(F.min(F.col("arrival").cast("long")).alias("arrival")).withColumn("rides", F.lit(ride))
        merged = best.withColumn("old", F.lit(True)).unionByName(walked(off).withColumn("old", F.lit(False))).groupBy("stop_id").agg(F.min(F.struct("arrival", "rides")).alias("m"), F.min(F.when(F.col("old"), F.col("arrival"))).alias("before"))
        merged = checkpointed(merged)
        best = merged.select("stop_id", "m.arrival", "m.rides")
        frontier = merged.where("before IS NULL OR m.arrival < before").select("stop_id", "m.arrival", "m.rides")
        if frontier.isEmpty():
            break
    return best
