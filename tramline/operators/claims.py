"""Which version of a feed holds on which days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRACE_DAYS = 5


def claimed_intervals(attempts: DataFrame, today: dt.date, grace: int = GRACE_DAYS) -> DataFrame:
    """``attempts``: feed_id, attempt_id (long, larger is newer), start_date, end_date. Gives feed_id, attempt_id, start_date, end_date, current. [A24]

    From the newest on, an older one ends the day before the newest kept one starts. One that has then ended over
    ``grace`` days ago, or starts no earlier than what is claimed, or comes after one without a start, is dropped;
    the first that holds today is current. A feed's few attempts are folded in an array, whose state is the last kept
    start, which no window frame gives.
    """
    row = "struct<attempt_id:bigint,start_date:date,end_date:date>"
    day = f"DATE'{today.isoformat()}'"
    start = f"named_struct('out', cast(array() AS array<{row}>), 'claimed', cast(NULL AS date), 'open', false)"
    end = "IF(a.claimed IS NULL, r.end_date, least(r.end_date, date_sub(a.claimed, 1)))"
    gone = f"{end} IS NOT NULL AND ({end} < date_sub({day}, {grace}) OR coalesce({end} < r.start_date, false))"
    kept = f"concat(a.out, array(named_struct('attempt_id', r.attempt_id, 'start_date', r.start_date, 'end_date', {end})))"
    step = f"IF(a.open OR {gone}, a, named_struct('out', {kept}, 'claimed', coalesce(r.start_date, a.claimed), 'open', r.start_date IS NULL))"
    holds = f"coalesce(r.start_date <= {day}, true) AND coalesce(r.end_date >= {day}, true)"
    given = F.sort_array(F.collect_list(F.struct(F.col("attempt_id").cast("long").alias("attempt_id"), "start_date", "end_date")), asc=False)
    folded = attempts.groupBy("feed_id").agg(given.alias("rows")).select("feed_id", F.expr(f"aggregate(rows, {start}, (a, r) -> {step}, a -> a.out)").alias("out"))
    first = folded.select("feed_id", F.expr(f"get(filter(out, r -> {holds}), 0).attempt_id").alias("now"), F.explode("out").alias("r"))
    return first.select("feed_id", "r.attempt_id", "r.start_date", "r.end_date", F.col("r.attempt_id").eqNullSafe(F.col("now")).alias("current"))
