"""Raw open-data tables -> cleaned tables and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.numbers import num, safe_ratio
from placewright.functions.text import clean, leading_number
from placewright.operators.shaping import drop_blank, first_per, slug_ids


def clean_transit(df: DataFrame) -> DataFrame:
    """Counters summed by (month, line, station) with day-part sums."""
    keys = ["use_month", "line_name", "station_name"]
    counters = [f"{d}_{b}" for b in fv.TRANSIT_BANDS for d in ("in", "out")]
    rows = drop_blank(df.withColumns({k: clean(F.col(k).cast("string")) for k in keys}), keys)
    sums = rows.groupBy(*keys).agg(*[F.sum(num(c).cast("long")).alias(c) for c in counters])
    part = lambda d, bands: sum((F.col(f"{d}_{b}") for b in bands[1:]), F.col(f"{d}_{bands[0]}"))
    early, late = fv.TRANSIT_BANDS[:4], fv.TRANSIT_BANDS[4:]
    return sums.withColumns({
        "station_id": F.concat_ws("_", *keys),
        "morning_total_in": part("in", early), "morning_total_out": part("out", early),
        "afternoon_total_in": part("in", late), "afternoon_total_out": part("out", late),
    })


def clean_markets(df: DataFrame, order) -> DataFrame:
    """Markets with slug ids; first row per (area, name, address) wins."""
    text = ["area", "market_name", "market_type", "market_address"]
    rows = df.withColumns({c: clean(c) for c in text})
    rows = rows.withColumns({"floor_area": num("floor_area"), "store_count": num("store_count").cast("long")})
    rows = drop_blank(rows, ["area", "market_name", "market_address"])
    rows = first_per(rows, ["area", "market_name", "market_address"], order)
    return slug_ids(rows, ["area", "market_name"], order, "market_id")


def clean_parks(df: DataFrame, order) -> DataFrame:
    text = ["park_name", "main_facilities", "region", "park_address"]
    rows = df.withColumns({c: clean(c) for c in text}).withColumns({
        "area_sqm": leading_number(F.col("area_sqm").cast("string")),
        "longitude": F.col("longitude").try_cast("double"), "latitude": F.col("latitude").try_cast("double"),
        "park_id": F.col("park_id").try_cast("long"),
    })
    rows = drop_blank(rows.dropna(subset=["park_id", "longitude", "latitude"]), ["park_name", "park_address"])
    return first_per(rows, ["park_id"], order)


def clean_seniors(df: DataFrame, order) -> DataFrame:
    text = ["facility_name", "facility_type", "area", "facility_address"]
    rows = df.withColumns({c: clean(c) for c in text})
    rows = drop_blank(rows, ["facility_name", "facility_type", "area", "facility_address"])
    return first_per(rows, ["senior_id"], order)


def clean_commercial(df: DataFrame, order) -> DataFrame:
    flows = ["total_flow", "age_20_flow", "age_30_flow", "age_40_flow", "age_60_plus_flow", "flow_06_11",
             "flow_11_14", "flow_14_17", "flow_17_21"]
    rows = df.withColumns({c: num(c) for c in flows}).withColumns({
        "commercial_name": clean("commercial_name"),
        "commercial_id": F.concat_ws("_", F.col("quarter").cast("long").cast("string"),
                                     F.col("commercial_code").cast("long").cast("string")),
    })
    total = F.col("total_flow")
    young = F.col("age_20_flow") + F.col("age_30_flow") + F.col("age_40_flow")
    rows = rows.withColumns({
        "age_20_40_ratio": safe_ratio(young, total, 6), "age_60_plus_ratio": safe_ratio(F.col("age_60_plus_flow"), total, 6),
        "morning_flow_score": safe_ratio(F.col("flow_06_11"), total, 6),
        "afternoon_flow_score": safe_ratio(F.col("flow_11_14") + F.col("flow_14_17") + F.col("flow_17_21"), total, 6),
    })
    return first_per(drop_blank(rows, ["commercial_name", "commercial_id"]), ["commercial_id"], order)


def clean_workers(df: DataFrame, order) -> DataFrame:
    counts = ["total_worker_population", "age_20_workers", "age_30_workers", "age_40_workers", "age_60_plus_workers"]
    rows = df.withColumns({c: num(c) for c in counts}).withColumns({
        "commercial_name": clean("commercial_name"),
        "worker_id": F.concat_ws("_", F.col("quarter").cast("long").cast("string"),
                                 F.col("commercial_code").cast("long").cast("string")),
    })
    total = F.col("total_worker_population")
    young = F.col("age_20_workers") + F.col("age_30_workers") + F.col("age_40_workers")
    rows = rows.withColumns({"age_20_40_worker_ratio": safe_ratio(young, total, 6),
                             "age_60_plus_worker_ratio": safe_ratio(F.col("age_60_plus_workers"), total, 6)})
    return first_per(drop_blank(rows, ["commercial_name", "worker_id"]), ["worker_id"], order)


def daypart_sums(df: DataFrame, keys, hour="hour", total="total", young="young", senior="senior") -> DataFrame:
    """Hourly population -> day-part sums and four ratios per key."""
    t, h = num(total), F.col(hour)
    sums = df.groupBy(*keys).agg(
        F.sum(t).alias("total_population"), F.sum(num(young)).alias("age_20_40_population"),
        F.sum(num(senior)).alias("age_60_plus_population"),
        F.sum(F.when(h.between(6, 10), t).otherwise(0.0)).alias("morning_population"),
        F.sum(F.when(h.between(11, 17), t).otherwise(0.0)).alias("afternoon_population"))
    sums = sums.dropna(subset=list(keys)).filter("total_population > 0")
    day = F.col("morning_population") + F.col("afternoon_population")
    return sums.withColumns({
        "daytime_population": day,
        "age_20_40_ratio": safe_ratio(F.col("age_20_40_population"), F.col("total_population"), 6),
        "age_60_plus_ratio": safe_ratio(F.col("age_60_plus_population"), F.col("total_population"), 6),
        "morning_score": safe_ratio(F.col("morning_population"), day, 6),
        "afternoon_score": safe_ratio(F.col("afternoon_population"), day, 6),
    })


def stat_block(df: DataFrame, features) -> DataFrame:
    """One row of mean, min and max per feature."""
    aggs = []
    for out, c in features.items():
        aggs += [F.avg(num(c)).alias(f"{out}_mean"), F.min(num(c)).alias(f"{out}_min"), F.max(num(c)).alias(f"{out}_max")]
    return df.agg(*aggs)


def aux_summary(commercial: DataFrame, workers: DataFrame, living: DataFrame) -> DataFrame:
    """The 30-value auxiliary summary as one map row."""
    blocks = [
        stat_block(commercial, {"commercial_age_20_40_ratio": "age_20_40_ratio", "commercial_age_60_plus_ratio": "age_60_plus_ratio",
                                "commercial_morning_flow_score": "morning_flow_score",
                                "commercial_afternoon_flow_score": "afternoon_flow_score"}),
        stat_block(workers, {"worker_age_20_40_ratio": "age_20_40_worker_ratio",
                             "worker_age_60_plus_ratio": "age_60_plus_worker_ratio"}),
        stat_block(living, {"living_pop_20_40_ratio": "age_20_40_ratio", "living_pop_60_plus_ratio": "age_60_plus_ratio",
                            "living_pop_morning_score": "morning_score", "living_pop_afternoon_score": "afternoon_score"}),
    ]
    as_map = lambda b: b.select(F.create_map(*[x for c in b.columns for x in (F.lit(c), F.col(c))]).alias("m"))
    maps = [as_map(b) for b in blocks]
    merged = maps[0].select(F.map_concat("m", maps[1].scalar(), maps[2].scalar()).alias("summary"))
    return merged.select(F.map_filter("summary", lambda k, v: v.isNotNull()).alias("summary"))
