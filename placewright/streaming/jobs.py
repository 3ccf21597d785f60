"""Streaming jobs: forecasts against later visits, hourly day-parts, recent-visit
counts and penalties, and dedupe of re-published schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placewright.operators.forecast import match_type, relevance


def forecast_stream(predictions: DataFrame, visits: DataFrame, days: int, delay: str = "1 day", areas=None) -> DataFrame:
    """Left outer stream-stream join on actor and an interval after the target.

    predictions: list_id, rank, target_date, actor, place_name, area, ..., and
    event time ``target_ts``; visits: visit_id, visit_date, actor, ..., and
    ``visit_ts``. Predictions without a visit come out, once the watermark has
    passed their window.
    """
    p = predictions.select("list_id", "rank", "target_ts", F.col("actor").cast("string").alias("actor"), F.col("place_name").alias("p_place"),
                           *_compare(predictions, "p_", areas)).withWatermark("target_ts", delay)
    v = visits.select("visit_id", "visit_ts", F.col("actor").cast("string").alias("a_actor"), F.col("place_name").alias("a_place"),
                      *_compare(visits, "a_", areas)).withWatermark("visit_ts", delay)
    on = (F.col("actor") == F.col("a_actor")) & (F.col("visit_ts") >= F.col("target_ts")) & (
        F.col("visit_ts") < F.col("target_ts") + F.expr(f"interval {days + 1} days"))
    rows = p.join(v, on, "left_outer")
    kind = F.when(F.col("visit_id").isNull(), "no_match").otherwise(match_type())
    return rows.select("list_id", "rank", "actor", "target_ts", "visit_id", "visit_ts", kind.alias("match_type"), relevance(kind).alias("relevance"))


def best_forecast_stream(predictions: DataFrame, visits: DataFrame, days: int, delay: str = "1 day", areas=None) -> DataFrame:
    """One row per prediction, its best visit within ``days`` or no_match, as `forecast_matches` has it.

    A prediction looks up each of its days under its actor and under visits without
    one (a prediction without an actor: under all visits), so state is dealt by
    (actor, day) and a busy actor spreads over days. The outer join hands on a row
    for every look-up; the aggregation behind it keeps the best visit of each
    prediction and gives it out once, when the watermark has passed its window.
    Larger relevance wins, then the smaller visit_id.
    """
    p = predictions.select("list_id", F.col("rank").cast("int").alias("rank"), "target_ts", _text(predictions, "actor").alias("actor"), F.col("place_name").alias("p_place"),
                           *_compare(predictions, "p_", areas)).withWatermark("target_ts", delay)
    v = visits.select("visit_id", "visit_ts", _text(visits, "actor").alias("a_actor"), F.col("place_name").alias("a_place"), *_compare(visits, "a_", areas)).withWatermark("visit_ts", delay)
    # Keys: =name of an actor, * of all named actors, empty of visits without an actor.
    own = F.when(F.col("actor") == "", F.lit("*")).otherwise(F.concat(F.lit("="), F.col("actor")))
    p = p.withColumn("key", F.explode(F.array(own, F.lit("")))).withColumn("day", F.explode(F.expr(f"sequence(date(target_ts), date_add(date(target_ts), {max(days, 0)}))")))
    given = F.when(F.col("a_actor") == "", F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("="), F.col("a_actor")), F.lit("*")))
    v = v.withColumn("a_key", F.explode(given)).withColumn("a_day", F.to_date("visit_ts"))
    start = F.date_trunc("day", F.col("target_ts"))
    on = (F.col("key") == F.col("a_key")) & (F.col("day") == F.col("a_day")) & (F.col("visit_ts") >= F.col("target_ts") - F.expr("interval 1 day")) & (
        F.col("visit_ts") < F.col("target_ts") + F.expr(f"interval {max(days, 0) + 1} days")) & (F.col("visit_ts") >= start)
    kind = F.when(F.col("visit_id").isNull(), "no_match").otherwise(match_type())
    rows = p.join(v, on, "left_outer").withColumn("match_type", kind).withColumn("relevance", relevance(F.col("match_type")))
    best = F.min_by(F.struct("match_type", "relevance", "a_place", "visit_id"), F.when(F.col("relevance") > 0, F.struct(-F.col("relevance"), "visit_id")))
    found = rows.groupBy("list_id", "rank", "target_ts", "actor", "p_place").agg(best.alias("b"))
    return found.select("list_id", "rank", "target_ts", "actor", F.col("p_place").alias("place_name"), F.coalesce("b.match_type", F.lit("no_match")).alias("match_type"),
                        F.coalesce("b.relevance", F.lit(0)).alias("relevance"), F.coalesce("b.a_place", F.lit("")).alias("matched_place"), F.col("b.visit_id").alias("visit_id"))


def _text(df: DataFrame, c: str):
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("")


def _compare(df: DataFrame, prefix: str, areas):
    from placewright.functions.areas import norm_area
    from placewright.functions.text import clean, loose_name

    text = lambda c: clean(F.col(c).cast("string")) if c in df.columns else F.lit("")
    return [loose_name("place_name").alias(prefix + "name"), loose_name(text("address")).alias(prefix + "address"),
            F.coalesce(norm_area(text("area"), areas), F.lit("")).alias(prefix + "area"), text("place_type").alias(prefix + "type")]


def daypart_stream(hourly: DataFrame, ts="ts", key="area", value="value", delay: str = "2 hours") -> DataFrame:
    """Hourly population to daily day-part sums per key, append mode."""
    hour, v = F.hour(ts), F.col(value)
    grouped = hourly.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), key).agg(
        F.sum(v).alias("total_population"), F.sum(F.when(hour.between(6, 10), v).otherwise(0.0)).alias("morning_population"),
        F.sum(F.when(hour.between(11, 17), v).otherwise(0.0)).alias("afternoon_population"))
    return grouped.select(F.col("window.start").alias("day"), key, "total_population", "morning_population", "afternoon_population")


def recent_visits_stream(visits: DataFrame, ts="ts", days: int = 7, delay: str = "1 day") -> DataFrame:
    """Visits per (actor, place) in sliding windows of ``days``, one per day."""
    return visits.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days", "1 day"), "actor", "place_name").agg(
        F.count("*").alias("visits")).select(F.col("window.end").alias("as_of"), "actor", "place_name", "visits")


PENALTY = "day date, place_name string, area string, c7 long, c30 long, older long, a30 long"
_COUNTS = "days array<int>, names array<string>, counts array<long>, older long, stops array<string>"


def penalty_stream(stops: DataFrame, visits: DataFrame, ts="ts", delay: str = "1 day") -> DataFrame:
    """Visit counts behind the recency penalty of each stop; `penalty_of` turns them into the penalty.

    stops and visits: place_name, area, and event time ``ts``. One state per place
    name and one per area serve all windows: counts by day for the last 31 days, and
    one sum of what is older (an area drops it). A stop waits in both until the
    watermark has passed its day and comes out as two rows, its counts by name and
    by area. Visits of later days are not known then and do not count. Rows that are
    behind the watermark are dropped.
    """
    both = stops.select(F.lit(True).alias("stop"), ts, "place_name", F.coalesce("area", F.lit("")).alias("area")).unionByName(
        visits.select(F.lit(False).alias("stop"), ts, "place_name", F.coalesce("area", F.lit("")).alias("area")))
    keyed = both.withWatermark(ts, delay).withColumn("kind", F.explode(F.array(F.lit("name"), F.lit("area"))))
    keyed = keyed.withColumn("key", F.when(F.col("kind") == "name", F.col("place_name")).otherwise(F.col("area"))).filter("key is not null and (kind = 'name' or key <> '' or stop)")
    keyed = keyed.select("kind", "key", "stop", "place_name", "area", F.unix_date(F.to_date(ts)).alias("day"), ts)

    def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, _ = key
        days, names, counts, older, waiting = state.get if state.exists else ([], [], [], 0, [])
        seen = {(d, n): c for d, n, c in zip(days, names, counts)}
        waiting = list(waiting)
        for rows in batches:
            for r in rows.itertuples():
                if r.stop:
                    waiting.append(f"{r.day}|{r.area}|{r.place_name}")
                else:
                    at = (r.day, r.place_name if kind == "area" else "")
                    seen[at] = seen.get(at, 0) + 1
        # Days up to this one are complete.
        done = state.getCurrentWatermarkMs() // 86_400_000 - 1
        out, left = [], []
        for stop in waiting:
            day, area, place = stop.split("|", 2)
            day = int(day)
            if day > done:
                left.append(stop)
                continue
            near = {k: c for k, c in seen.items() if day - 30 <= k[0] <= day}
            if kind == "name":
                c30 = sum(near.values())
                out.append((day, place, area, sum(c for k, c in near.items() if k[0] >= day - 7), c30, older + sum(c for k, c in seen.items() if k[0] <= day) - c30, 0))
            else:
                out.append((day, place, area, 0, 0, 0, sum(c for k, c in near.items() if k[1] != place) if area else 0))
        for k in [k for k in seen if k[0] < done - 31]:
            older += seen.pop(k) if kind == "name" else seen.pop(k) * 0
        days, names = zip(*seen) if seen else ((), ())
        state.update((list(days), list(names), list(seen.values()), older, left))
        if left:
            first = min(int(stop.split("|", 1)[0]) for stop in left)
            state.setTimeoutTimestamp(max((first + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            frame = pd.DataFrame(out, columns=["day", "place_name", "area", "c7", "c30", "older", "a30"])
            frame["day"] = pd.to_datetime(frame["day"], unit="D").dt.date
            yield frame

    return keyed.groupBy("kind", "key").applyInPandasWithState(counted, PENALTY, _COUNTS, "append", GroupStateTimeout.EventTimeTimeout)


def penalty_of(counts: DataFrame) -> DataFrame:
    """(day, place_name, area, visit_penalty) of what `penalty_stream` has written, before the floor; stops that repeat are one."""
    rows = counts.distinct().groupBy("day", "place_name", "area").agg(*[F.max(c).alias(c) for c in ("c7", "c30", "older", "a30")])
    value = -(F.lit(0.50) * F.col("c7") + F.lit(0.30) * (F.col("c30") - F.col("c7")) + F.lit(0.12) * F.col("older") + F.lit(0.10) * F.col("a30"))
    return rows.select("day", "place_name", "area", F.round(value, 4).alias("visit_penalty"))


def dedupe_stream(rows: DataFrame, keys, ts="ts", delay: str = "1 day") -> DataFrame:
    """First of each key within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is available and stop; the checkpoint folder carries state."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
