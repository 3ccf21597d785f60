"""Day routes in batch: a place pool, per-request candidates, greedy sequencing.

Requests are rows: route_id, date, start_time, end_time, start_location,
areas (array), target_group, goal, preferred_types (array), num_visits,
avoid_duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import norm_area, relation, start_area
from placewright.functions.numbers import max_share, num
from placewright.functions.text import clean, clean_nullish, contains_any, display_name, label_map, lit_array, lookup, normalise_address, route_type
from placewright.functions.times import day_of_week, minutes, time_slots
from placewright.operators.shaping import first_per, latest_period, sort_keys, union_all

POOL = ["place_name", "area", "place_type", "address", "lat", "lng", "score", "source"]
MOST_VISITS = 8


# --- pool -------------------------------------------------------------------------
def source_scores(df: DataFrame, source: str, measure: Column | None = None) -> DataFrame:
    """score = base + spread * measure / max(measure); base alone without one."""
    base, spread = fv.POOL_SCORES[source]
    rows = df.withColumn("source", F.lit(source))
    if measure is None or spread == 0.0:
        return rows.withColumn("score", F.lit(base))
    rows = rows.withColumn("_m", F.greatest(num(measure), F.lit(0.0)))
    top = rows.agg(F.max("_m").alias("t"))
    return rows.withColumn("score", F.lit(base) + F.lit(spread) * max_share(F.col("_m"), top.scalar())).drop("_m")


def public_pool(sources: dict, city: str = "서울특별시") -> DataFrame:
    """Place pool of several sources: source -> (table, place type, measure).

    Tables need place_name and area; rows with either blank are dropped.
    """
    frames = []
    for source, (df, kind, measure) in sources.items():
        if "use_month" in df.columns:
            df = latest_period(df, "use_month")
        rows = df.withColumns({"place_name": clean("place_name"), "area": clean("area")}).filter("place_name <> '' and area <> ''")
        if source == "subway_csv":
            rows = first_per(rows, ["place_name"], ["area", *[c for c in ("place_id",) if c in rows.columns]])
        rows = source_scores(rows, source, measure)
        there = F.concat_ws(" ", F.lit(city), "area", F.lit("일대"))
        given = F.nullif(clean("address"), F.lit("")) if "address" in rows.columns else F.lit(None)
        pick = lambda c: F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double")
        frames.append(rows.select("place_name", "area", F.lit(kind).alias("place_type"), F.coalesce(given, there).alias("address"),
                                  pick("lat").alias("lat"), pick("lng").alias("lng"), "score", "source"))
    return union_all(frames)


def recommended_pool(*lists: DataFrame) -> DataFrame:
    """Rows of finished lists (rec_name, rec_area, rec_type, score) as pool records, the best score of each place.

    A place stands in many lists, so its rows are combined before they meet the other sources.
    """
    rows = union_all([df.select("rec_name", "rec_area", "rec_type", F.col("score").cast("double").alias("score")) for df in lists])
    best = rows.groupBy("rec_name", "rec_area", "rec_type").agg(F.max("score").alias("score"))
    return best.select(F.col("rec_name").alias("place_name"), F.col("rec_area").alias("area"), F.col("rec_type").alias("place_type"), F.lit(None).cast("string").alias("address"),
                       F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), "score", F.lit(fv.SOURCE_DEFAULT).alias("source"))


def record_pool(records: DataFrame, source: str) -> DataFrame:
    """Records met in JSON documents as pool records; a missing score is 0."""
    return records.select("place_name", "area", "place_type", "address", "lat", "lng", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(source).alias("source"))


def canonical_source(*cols) -> Column:
    raw = F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols], F.lit(""))
    return label_map(raw, fv.SOURCE_ALIASES, F.when(raw == "", fv.SOURCE_DEFAULT).otherwise(raw))


def source_priority(source: Column) -> Column:
    return label_map(source, fv.SOURCE_PRIORITY, F.lit(fv.SOURCE_PRIORITY_OTHER))


def type_explanation(kind: Column) -> Column:
    return label_map(kind, fv.TYPE_EXPLANATIONS, F.lit(fv.TYPE_EXPLANATION_OTHER))


def normalise_pool(pool: DataFrame, areas=None) -> DataFrame:
    """Canonical records: known area, named, typed, with source and priority."""
    rows = pool.withColumns({"area": norm_area("area", areas), "place_name": clean("place_name"), "place_type": route_type("place_type"),
                             "source": canonical_source("source"), "score": num("score"), "address": normalise_address("address")})
    rows = rows.filter(F.col("area").isin(list(areas or fv.AREAS)) & (F.col("place_name") != ""))
    flag = F.coalesce(F.col("is_fallback"), F.lit(False)) if "is_fallback" in pool.columns else F.lit(False)
    return rows.withColumns({
        "address": F.when(F.col("address") == fv.ADDRESS_UNKNOWN, F.concat(F.lit("서울특별시 "), F.col("area"), F.lit(" 일대"))).otherwise(F.col("address")),
        "priority": source_priority(F.col("source")), "is_fallback": flag | F.col("source").isin(fv.FALLBACK_SOURCES),
        "identity": F.concat_ws("|", F.regexp_replace("place_name", r"\s+", ""), "area", "place_type")})


POOL_ORDER = ["priority", "-score", "place_name", "place_type"]


def unified_pool(frames, areas=None) -> DataFrame:
    """All sources, best record per identity by (priority, score, name)."""
    rows = normalise_pool(union_all(frames), areas).filter("not is_fallback")
    return first_per(rows, ["identity"], [*POOL_ORDER, "source"])


def source_matrix(pool: DataFrame, sources, areas: DataFrame) -> DataFrame:
    """Per area: rows per source, distinct real places, fallback flag."""
    rows = pool.filter("not is_fallback")
    counts = rows.groupBy("area").pivot("source", list(sources)).agg(F.count(F.lit(1)))
    real = rows.select("area", "identity").distinct().groupBy("area").agg(F.count("*").alias("total_real_count"))
    out = areas.join(counts, "area", "left").join(real, "area", "left").na.fill(0)
    return out.withColumn("fallback_needed", F.col("total_real_count") <= 0)


def source_counts(rows: DataFrame, by="route_id") -> DataFrame:
    """Counts per source and area of each route, as maps."""
    s = rows.groupBy(by, "source").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_counts"))
    a = rows.groupBy(by, "area").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area", "n")))).alias("area_distribution"))
    return s.join(a, by)


# --- requests ---------------------------------------------------------------------
def parse_requests(df: DataFrame, areas=None) -> DataFrame:
    """Defaults, canonical area lists, start area, slots.

    A window that does not end after it starts, or has no readable time, fails
    the job when its slots are read.
    """
    d = fv.ROUTE_DEFAULTS
    fill = lambda c: F.coalesce(F.nullif(clean(c), F.lit("")), F.lit(d[c])) if c in df.columns else F.lit(d[c])
    rows = df.withColumns({c: fill(c) for c in d})
    for c, kind in (("areas", "array<string>"), ("preferred_types", "array<string>"), ("num_visits", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    names = F.array_distinct(F.array_compact(F.transform(F.coalesce("areas", F.array().cast("array<string>")), lambda a: norm_area(a, areas))))
    first = F.get(names, F.lit(0))
    begin = start_area("start_location", areas)
    visits = F.least(F.greatest(F.coalesce(F.col("num_visits").try_cast("int"), F.lit(5)), F.lit(1)), F.lit(MOST_VISITS))
    return rows.withColumns({
        "areas": names, "preferred_types": F.array_distinct(F.transform(F.coalesce("preferred_types", F.array().cast("array<string>")), route_type)),
        "start_area": F.coalesce(F.nullif(begin, F.lit("")), first, F.lit("")), "num_visits": visits,
        "avoid_duplicates": F.coalesce(F.col("avoid_duplicates").cast("boolean"), F.lit(True)) if "avoid_duplicates" in df.columns else F.lit(True),
    }).withColumn("slots", F.when(bad_window(), F.raise_error(F.concat(F.lit("bad time window: "), "start_time", F.lit(" - "), "end_time")).cast("array<string>"))
                  .otherwise(time_slots("start_time", "end_time", "num_visits")))


def bad_window() -> Column:
    lo, hi = minutes("start_time"), minutes("end_time")
    return lo.isNull() | hi.isNull() | (hi <= lo)


def bad_time_windows(requests: DataFrame) -> DataFrame:
    return requests.filter(bad_window())


# --- candidates per request -----------------------------------------------------------
def area_heads(pool: DataFrame, n: int = MOST_VISITS) -> DataFrame:
    """First n records per area, and overall under the area ``*``.

    A route takes at most n stops, so these rows answer every request.
    """
    per = first_per(pool, ["area"], POOL_ORDER, n, "turn").withColumn("_area", F.col("area"))
    every = first_per(per.drop("turn").withColumn("_area", F.lit("*")), ["_area"], POOL_ORDER, n, "turn")
    return per.unionByName(every)


def _asked(requests: DataFrame) -> DataFrame:
    listed = F.when(F.size("areas") > 0, F.col("areas")).otherwise(F.array(F.lit("*")))
    return requests.select("route_id", "num_visits", "preferred_types", F.posexplode(listed).alias("area_pos", "_area"))


ITEM = ["place_name", "area", "place_type", "address", "lat", "lng", "score", "source", "priority", "is_fallback"]


def route_candidates(requests: DataFrame, pool: DataFrame, seeds: DataFrame | None = None, areas=None) -> DataFrame:
    """Ordered candidates per request: real ones interleaved by area, then
    seeds, then generated fillers, up to the number of visits."""
    n = F.col("num_visits")
    # Eight rows for each known area go to the requests; requests are never sent whole.
    real = _asked(requests).join(F.broadcast(area_heads(pool)), "_area").filter(F.col("turn") <= n)
    pos = F.row_number().over(W.partitionBy("route_id").orderBy("turn", "area_pos"))
    real = real.withColumn("pos", pos).filter(F.col("pos") <= n)
    strict = (F.size("preferred_types") == 0) | F.array_contains("preferred_types", F.col("place_type"))
    stage = F.when(strict, "strict_real_candidates").otherwise("relaxed_place_type_real_candidates")
    real = real.select("route_id", "pos", *ITEM, stage.alias("stage"))
    got = real.groupBy("route_id").agg(F.count("*").alias("have"), F.collect_set("place_name").alias("names"),
                                       F.collect_set(F.concat_ws("|", F.regexp_replace("place_name", r"\s+", ""), "area", "place_type")).alias("ids"))
    need = requests.select("route_id", "num_visits", "areas", "preferred_types").join(got, "route_id", "left").na.fill(0, ["have"])
    short = need.filter((F.col("have") < n) & (F.size("areas") > 0))
    parts, filled = [real], short
    if seeds is not None:
        rows = normalise_pool(seeds.withColumn("is_fallback", F.lit(True)), areas)
        rows = first_per(rows, ["identity"], POOL_ORDER)
        rows = first_per(rows, ["area"], POOL_ORDER, 2 * MOST_VISITS)
        open_ = short.select("route_id", "num_visits", "have", "ids", F.posexplode("areas").alias("area_pos", "area"))
        rows = open_.join(rows, "area").filter(~F.coalesce(F.array_contains("ids", F.col("identity")), F.lit(False)))
        turn = F.row_number().over(W.partitionBy("route_id", "area").orderBy(*sort_keys(POOL_ORDER)))
        rows = rows.withColumn("turn", turn)
        extra = F.row_number().over(W.partitionBy("route_id").orderBy("turn", "area_pos"))
        rows = rows.withColumn("pos", F.col("have") + extra).filter(F.col("pos") <= n)
        fill = rows.select("route_id", "pos", *ITEM, F.lit("district_fallback_seed").alias("stage"))
        parts.append(fill)
        used = fill.groupBy("route_id").agg(F.count("*").alias("_n"), F.collect_set("place_name").alias("_names"))
        filled = short.join(used, "route_id", "left").withColumns({"have": F.col("have") + F.coalesce("_n", F.lit(0)), "names": F.concat(
            F.coalesce("names", F.array().cast("array<string>")), F.coalesce("_names", F.array().cast("array<string>")))})
    parts.append(_synthetic(filled.filter(F.col("have") < n)))
    return union_all(parts)


def _synthetic(short: DataFrame) -> DataFrame:
    """Generated fillers that cycle over areas and types."""
    known = F.coalesce("names", F.array().cast("array<string>"))
    types = F.when(F.size("preferred_types") > 0, F.col("preferred_types")).otherwise(lit_array(fv.SYNTHETIC_TYPES))
    item = lambda i: F.struct(
        i.alias("i"), F.concat(F.get("areas", ((i - 1) % F.size("areas")).cast("int")), F.lit(" 생활권 유세 거점 "), i.cast("string")).alias("name"),
        F.get("areas", ((i - 1) % F.size("areas")).cast("int")).alias("area"), F.get(types, ((i - 1) % F.size(types)).cast("int")).alias("type"))
    made = F.filter(F.transform(F.sequence(F.lit(1), F.lit(2 * MOST_VISITS)), item), lambda s: ~F.array_contains(known, s["name"]))
    rows = short.select("route_id", "have", F.posexplode(F.slice(made, F.lit(1), F.col("num_visits") - F.col("have").cast("int"))).alias("_p", "s"))
    return rows.select(
        "route_id", (F.col("have") + F.col("_p") + 1).alias("pos"), F.col("s.name").alias("place_name"), F.col("s.area").alias("area"),
        F.col("s.type").alias("place_type"), F.concat(F.lit("서울특별시 "), F.col("s.area"), F.lit(" 주요 생활권 일대")).alias("address"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), (F.lit(0.98) - F.col("s.i") * F.lit(0.01)).alias("score"),
        F.lit("synthetic_district_fallback").alias("source"), F.lit(100).alias("priority"), F.lit(True).alias("is_fallback"),
        F.lit("synthetic_district_fallback").alias("stage"))


RUNGS = ["strict_real_candidates", "relaxed_place_type_real_candidates", "relaxed_context_real_candidates", "all_real_district_candidates"]


def relaxation_ladder(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """Per request: candidates on each rung, how many places the rungs hold together, and the first rung where these are enough.

    Rung 1 takes the preferred types in the asked areas, rung 2 all types, rung 3
    any context, rung 4 the whole area; a place counts for the first rung that it is
    on. Without areas the whole pool is asked. The pool is one row per place; it is
    counted per (area, type) first, and requests are reduced to what they ask for,
    so a request never meets places. rung is null where all rungs are too few.
    """
    sizes = pool.filter("not is_fallback").groupBy("area", "place_type").agg(F.count("*").alias("rows"))
    sizes = sizes.unionByName(sizes.groupBy("place_type").agg(F.sum("rows").alias("rows")).withColumn("area", F.lit("*")))
    keys = ["areas", "preferred_types"]
    listed = F.when(F.size("areas") > 0, F.array_distinct("areas")).otherwise(F.array(F.lit("*")))
    asks = requests.select(*keys).distinct()
    strict = (F.size("preferred_types") == 0) | F.array_contains("preferred_types", F.col("place_type"))
    counts = asks.withColumn("area", F.explode(listed)).join(sizes, "area").groupBy(*keys).agg(
        F.sum(F.when(strict, F.col("rows")).otherwise(0)).alias("strict"), F.sum("rows").alias("every"))
    rows = requests.select("route_id", "num_visits", *keys).join(counts, keys, "left").na.fill(0, ["strict", "every"])
    rungs = F.array(F.col("strict"), F.col("every"), F.col("every"), F.col("every"))
    # Later rungs hold the earlier ones, so the places met so far are the largest count so far.
    together = F.transform(F.sequence(F.lit(1), F.lit(len(RUNGS))), lambda i: F.array_max(F.slice(rungs, F.lit(1), i)))
    enough = F.transform(together, lambda c: c >= F.col("num_visits"))
    rung = F.nullif(F.array_position(enough, F.lit(True)), F.lit(0).cast("long")).cast("int")
    rows = rows.withColumns({"stage_counts": rungs, "together": together, "rung": rung})
    return rows.select("route_id", "num_visits", *[F.get("stage_counts", F.lit(i)).alias(f"rung_{i + 1}") for i in range(len(RUNGS))],
                       F.element_at("together", -1).alias("together"), "rung", F.get(lit_array(RUNGS), F.col("rung") - 1).alias("rung_name"),
                       F.greatest(F.col("num_visits") - F.element_at("together", -1), F.lit(0)).alias("short_by"))


def candidate_debug(requests: DataFrame, pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per request: counts before and after the area filter, per stage, and
    the stage that was reached. Pool counts are per (area, type) first."""
    sizes = pool.groupBy("area", "place_type").agg(F.count("*").alias("rows"))
    total = pool.agg(F.count("*").alias("n"))
    keys = ["areas", "preferred_types"]
    strict = (F.size("preferred_types") == 0) | F.array_contains("preferred_types", F.col("place_type"))
    counts = requests.select(*keys).distinct().withColumn("area", F.explode("areas")).join(sizes, "area").groupBy(*keys).agg(
        F.sum("rows").alias("in_area"), F.sum(F.when(strict, F.col("rows")).otherwise(0)).alias("strict"))
    inside = requests.select("route_id", *keys).join(counts, keys, "left").groupBy("route_id").agg(F.sum("in_area").alias("in_area"), F.sum("strict").alias("strict"))
    got = candidates.groupBy("route_id").agg(
        F.count("*").alias("returned"), F.count_if(~F.col("is_fallback")).alias("real"), F.count_if(F.col("stage") == "district_fallback_seed").alias("seeds"),
        F.count_if(F.col("stage") == "synthetic_district_fallback").alias("synthetic"))
    rows = requests.select("route_id", "areas", "num_visits").join(inside, "route_id", "left").join(got, "route_id", "left").na.fill(0)
    all_ = F.when(F.size("areas") > 0, F.col("in_area")).otherwise(total.scalar())
    back = F.col("seeds") + F.col("synthetic")
    stage = (F.when((back > 0) & (F.col("real") > 0), "fill_missing_only").when(F.col("synthetic") > 0, "synthetic_district_fallback")
             .when(back > 0, "district_fallback_seed").when(F.col("real") >= F.col("num_visits"), "relaxed_place_type_real_candidates")
             .otherwise("strict_real_candidates"))
    return rows.select("route_id", total.scalar().alias("before_filter"), all_.alias("after_filter"),
                       F.when(F.size("areas") > 0, F.col("strict")).otherwise(F.lit(None)).alias("strict_count"),
                       F.col("real").alias("real_count"), back.alias("fallback_count"), F.col("returned").alias("returned_count"), stage.alias("fallback_stage"))


# --- recency ------------------------------------------------------------------------
def recency_penalty(stops: DataFrame, visits: DataFrame) -> DataFrame:
    """Penalty of (day, place_name, area) for past visits, before its floor.

    Same name: -.50 within 7 days, -.30 within 30, else -.12 per visit. Other
    places of the same area: -.10 per visit within 30 days. Visits are counted
    per day first; windows become equi-joins on the 31 days before.
    """
    asked = stops.select("day", "place_name", "area").distinct()
    daily = visits.groupBy(F.col("visit_date").cast("date").alias("visit_date"), "place_name", "area").agg(F.count("*").alias("n"))
    days = F.expr("transform(sequence(0, 30), i -> struct(date_sub(day, i) AS visit_date, i AS gap))")
    back = asked.select("*", F.inline(days))
    by_name = daily.groupBy("place_name", "visit_date").agg(F.sum("n").alias("n"))
    near = back.join(by_name, ["place_name", "visit_date"]).groupBy("day", "place_name", "area").agg(
        F.sum(F.when(F.col("gap") <= 7, F.col("n")).otherwise(0)).alias("c7"), F.sum("n").alias("c30"))
    ever = daily.groupBy("place_name").agg(F.sum("n").alias("ever"))
    by_area = daily.filter("area <> ''").groupBy("area", "visit_date").agg(F.sum("n").alias("n"))
    area_days = asked.select("day", "area").distinct().select("*", F.inline(days))
    around = area_days.join(by_area, ["area", "visit_date"]).groupBy("day", "area").agg(F.sum("n").alias("a30"))
    own = back.join(daily.filter("area <> ''"), ["place_name", "area", "visit_date"]).groupBy("day", "place_name", "area").agg(F.sum("n").alias("o30"))
    keys = ["day", "place_name", "area"]
    rows = asked.join(near, keys, "left").join(ever, "place_name", "left").join(around, ["day", "area"], "left").join(own, keys, "left").na.fill(0)
    c7, c30 = F.col("c7"), F.col("c30")
    value = -(F.lit(0.50) * c7 + F.lit(0.30) * (c30 - c7) + F.lit(0.12) * (F.col("ever") - c30) + F.lit(0.10) * (F.col("a30") - F.col("o30")))
    return rows.select(*keys, F.round(value, 4).alias("visit_penalty"))


# --- scoring pieces -------------------------------------------------------------------
def time_fit(time: Column, kind: Column, goal: Column) -> Column:
    """Hour x type table plus goal bonuses, at most .38."""
    hour = F.floor(minutes(time) / 60)
    pick = lambda table: lookup(kind, table, 0.06)
    base = None
    for lo, hi, table in fv.ROUTE_TIME_FIT:
        inside = (hour >= lo) & (hour < hi)
        base = F.when(inside, pick(table)) if base is None else base.when(inside, pick(table))
    base = base.otherwise(pick(fv.ROUTE_TIME_FIT_OTHER))
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    total = (base + add(goal.contains("출근") & hour.between(7, 9) & (kind == "교통거점"), 0.08)
             + add(goal.contains("퇴근") & hour.between(17, 19) & kind.isin("교통거점", "골목상권"), 0.08)
             + add(goal.contains("시장") & (kind == "전통시장"), 0.06) + add(goal.contains("공원") & (kind == "공원"), 0.06)
             + add(goal.contains("정책") & (kind == "정책현장"), 0.06))
    return F.round(F.least(total, F.lit(0.38)), 4)


def target_fit(target: Column, kind: Column, name: Column) -> Column:
    text = F.concat_ws(" ", target, kind, name)
    hit = F.lit(False)
    for word, kinds in fv.ROUTE_TARGET_TYPES:
        hit = hit | (text.contains(word) & kind.isin(kinds))
    return F.when(hit, 0.18).otherwise(0.08)


def area_fit(area: Column, wanted: Column, adjacency=None) -> Column:
    near = F.exists(wanted, lambda w: relation(area, w, adjacency) == "adjacent")
    return F.when(F.size(wanted) == 0, 0.08).when(F.array_contains(wanted, area), 0.22).when(near, 0.10).otherwise(0.0)


def start_fit(order: Column, start: Column, area: Column, adjacency=None) -> Column:
    rel = relation(start, area, adjacency)
    return (F.when((order != 1) | (start == "") | (area == ""), 0.0).when(rel == "same", 0.45).when(rel == "adjacent", 0.12).otherwise(-0.35))


def travel(previous: Column, area: Column, adjacency=None) -> tuple[Column, Column]:
    rel = relation(previous, area, adjacency)
    return (F.when(rel == "same", 0.0).when(rel == "adjacent", -0.05).otherwise(-0.15),
            F.when(rel == "same", 12).when(rel == "adjacent", 24).otherwise(42))


def stage_bonus(stage: Column) -> Column:
    return label_map(stage, fv.STAGE_BONUS, F.lit(0.0))


# --- sequencing -----------------------------------------------------------------------
def build_routes(requests: DataFrame, candidates: DataFrame, visits: DataFrame | None = None, areas=None, adjacency=None) -> DataFrame:
    """Greedy routes: per slot the unused candidate with the best
    (priority, -score), given what the route already holds.

    A request has at most eight slots and eight candidates, so its state folds
    over its slots inside one row. All parts of the score that do not depend on
    the state are columns computed before.
    """
    # Written requests pack so well that their size on disk would pass for a table to send whole; they are met by a shuffle.
    asked = requests.select("route_id", "date", "start_area", "areas", "target_group", "goal", "preferred_types", "avoid_duplicates", "slots")
    rows = candidates.join(asked.hint("merge"), "route_id")
    rows = rows.withColumn("day", F.col("date").cast("date"))
    if visits is not None:
        rows = rows.join(recency_penalty(rows.filter("avoid_duplicates"), visits), ["day", "place_name", "area"], "left")
        rows = rows.withColumn("visit_penalty", F.when(F.col("avoid_duplicates"), F.coalesce("visit_penalty", F.lit(0.0))).otherwise(0.0))
    else:
        rows = rows.withColumn("visit_penalty", F.lit(0.0))
    kind = F.col("place_type")
    preferred = F.array_contains("preferred_types", kind)
    rows = rows.withColumns({
        "display": display_name("place_name", "place_type", areas), "fits": F.transform("slots", lambda s: time_fit(s, kind, F.col("goal"))),
        "target_fit": target_fit(F.col("target_group"), kind, F.col("place_name")), "area_fit": area_fit(F.col("area"), F.col("areas"), adjacency),
        "start_fit": start_fit(F.lit(1), F.col("start_area"), F.col("area"), adjacency),
        "preferred": F.when(preferred, 0.05).otherwise(0.0), "bonus": stage_bonus(F.col("stage"))})
    item = F.struct("pos", F.col("priority").cast("int").alias("priority"), "place_name", "display", "area", "place_type", "address", "lat", "lng", "source",
                    "stage", F.col("is_fallback"), F.col("score").alias("place_score"), "fits", "target_fit", "area_fit", "start_fit", "preferred", "visit_penalty", "bonus")
    first = ["start_area", "slots", "avoid_duplicates"]
    lists = rows.groupBy("route_id").agg(F.array_sort(F.collect_list(item)).alias("items"), *[F.first(c).alias(c) for c in first])

    def step(done, i):
        size = F.size(done)
        last = F.when(size == 0, F.col("start_area")).otherwise(F.element_at(done, -1)["area"])
        fresh = F.filter("items", lambda c: ~F.exists(done, lambda d: c["place_name"].isin(d["place_name"], d["display"]) | c["display"].isin(d["place_name"], d["display"])))

        def scored(c):
            types = F.size(F.filter(done, lambda d: d["place_type"] == c["place_type"]))
            places = F.size(F.filter(done, lambda d: d["area"] == c["area"]))
            diversity = (F.round(F.when(types == 0, 0.08).otherwise(0.0) + F.when((places == 0) & (c["area"] != ""), 0.04).otherwise(0.0), 4) + c["preferred"])
            repeat = F.when(places >= 1, -0.10).otherwise(0.0) + F.when(types >= 2, -0.15).otherwise(0.0)
            again = F.when(F.col("avoid_duplicates"), F.round(F.greatest(c["visit_penalty"] + repeat, F.lit(-0.75)), 4)).otherwise(0.0)
            penalty, mins = travel(last, c["area"], adjacency)
            start = F.when(i == 1, c["start_fit"]).otherwise(0.0)
            fit = F.get(c["fits"], i - 1)
            total = c["place_score"] + fit + c["target_fit"] + c["area_fit"] + start + diversity + again + penalty + c["bonus"]
            return F.struct(c["priority"].alias("priority"), (-total).alias("neg"), c["pos"].alias("pos"), c["place_name"].alias("place_name"),
                            c["display"].alias("display"), c["area"].alias("area"), c["place_type"].alias("place_type"), c["source"].alias("source"),
                            c["stage"].alias("stage"), c["is_fallback"].alias("is_fallback"), c["address"].alias("address"), c["lat"].alias("lat"), c["lng"].alias("lng"),
                            c["place_score"].alias("place_score"), fit.alias("time_fit"), c["target_fit"].alias("target_fit"), c["area_fit"].alias("area_fit"),
                            start.alias("start_fit"), F.round(diversity, 4).alias("diversity"), again.alias("visit_penalty"), penalty.alias("travel_penalty"),
                            mins.alias("travel_minutes"), c["bonus"].alias("stage_bonus"), last.alias("previous_area"))

        best = F.array_min(F.transform(fresh, scored))
        return F.when(F.size(fresh) == 0, done).otherwise(F.concat(done, F.array(best)))

    pick = ("struct<priority:int,neg:double,pos:bigint,place_name:string,display:string,area:string,place_type:string,source:string,stage:string,"
            "is_fallback:boolean,address:string,lat:double,lng:double,place_score:double,time_fit:double,target_fit:double,area_fit:double,start_fit:double,"
            "diversity:double,visit_penalty:double,travel_penalty:double,travel_minutes:int,stage_bonus:double,previous_area:string>")
    lists = lists.withColumn("items", F.transform("items", lambda c: c.withField("pos", c["pos"].cast("long"))))
    folded = lists.withColumn("_route", F.aggregate(F.sequence(F.lit(1), F.size("slots")), F.array().cast(f"array<{pick}>"), step))
    out = folded.select("route_id", "slots", F.posexplode("_route").alias("_p", "s"))
    return out.select("route_id", (F.col("_p") + 1).alias("order"), F.get("slots", F.col("_p")).alias("time"), F.col("s.display").alias("place_name"),
                      F.col("s.place_name").alias("raw_place_name"), "s.area", "s.place_type", F.col("s.address").alias("address"), "s.lat", "s.lng", "s.source",
                      F.col("s.stage").alias("fallback_stage"), "s.is_fallback", F.round(-F.col("s.neg"), 4).alias("score"), F.round("s.place_score", 4).alias("place_score"),
                      "s.time_fit", "s.target_fit", "s.area_fit", "s.start_fit", "s.diversity", "s.visit_penalty", "s.travel_penalty", "s.travel_minutes",
                      "s.stage_bonus", F.col("s.priority").alias("source_priority"), "s.previous_area")


def route_reasons(stops: DataFrame, requests: DataFrame, adjacency=None) -> DataFrame:
    """Why a stop is where it is, and why it was recommended."""
    rows = stops.join(requests.select("route_id", "start_area", "target_group", F.size("slots").alias("total")), "route_id")
    hour = F.floor(minutes("time") / 60)
    rel_start, rel_prev = relation(F.col("start_area"), F.col("area"), adjacency), relation(F.col("previous_area"), F.col("area"), adjacency)
    cat = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    first, kind, area, order = F.col("order") == 1, F.col("place_type"), F.col("area"), F.col("order").cast("string")
    mins = F.col("travel_minutes").cast("string")
    sequence = (F.when(first & (rel_start == "same"), cat("시작 위치와 같은 ", area, " 내 ", kind, "이므로 첫 일정으로 배치했습니다."))
                .when(first & (rel_start == "adjacent"), cat("시작 위치 인접 자치구인 ", area, " 후보라 첫 이동 부담이 낮아 초반 일정으로 배치했습니다."))
                .when(first, "출발지와 거리가 있어 감점했지만, 추천 점수와 시간대 적합도가 높아 첫 일정 후보로 선택했습니다.")
                .when((F.col("order") == F.col("total")) & hour.between(17, 19), cat("퇴근 시간대 유동인구가 많은 ", kind, " 후보라 마지막 일정으로 배치했습니다."))
                .when(hour.between(12, 13), cat("점심 시간대 상권·생활권 접촉에 적합하여 ", order, "번째 일정으로 배치했습니다."))
                .when((F.col("previous_area") != "") & (rel_prev == "same"), cat("이전 일정과 같은 ", area, " 안에서 이동 부담을 줄이기 위해 이어서 배치했습니다."))
                .otherwise(cat("이전 일정에서 예상 이동 ", mins, "분 이내로 연결 가능한 후보 장소라 ", order, "번째 일정으로 배치했습니다.")))
    timing = (F.when(hour.between(7, 9), "출근 시간대 접촉 가능성이 높아").when(hour.between(17, 19), "퇴근 시간대 유동 인구 접점이 좋아")
              .when(hour.between(12, 13), "점심 시간대 생활권 접촉에 적합해").otherwise("해당 시간대 현장 방문 맥락에 맞아"))
    repeat = F.when(F.col("visit_penalty") < 0, " 최근 방문 이력이 있어 우선순위가 일부 낮아졌습니다.").otherwise("")
    why = cat(timing, " ", area, "의 ", kind, " 후보 장소로 배치했습니다. ", F.col("target_group"), " 타깃과의 접점, 예상 이동 ", mins, "분을 함께 고려했습니다.", repeat)
    return rows.withColumns({"sequence_reason": sequence, "recommendation_reason": why}).drop("start_area", "target_group", "total")


def route_summary(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Totals, diversity and warnings per request."""
    got = stops.groupBy("route_id").agg(F.count("*").alias("stops"), F.count_distinct("place_type").alias("place_type_diversity"),
                                        F.count_if(F.col("lat").isNull() | F.col("lng").isNull()).alias("no_coords"),
                                        F.count_if("is_fallback").alias("fallbacks"), F.sum("travel_minutes").alias("travel_minutes"))
    rows = requests.join(got, "route_id", "left").na.fill(0, ["stops", "place_type_diversity", "no_coords", "fallbacks", "travel_minutes"])
    total = minutes("end_time") - minutes("start_time")
    length = F.concat(F.floor(total / 60).cast("string"), F.lit("시간 "), (total % 60).cast("string"), F.lit("분"))
    missing = F.concat(F.lit("Returned "), F.col("stops").cast("string"),
                       F.lit(" recommendations because selected district candidates were insufficient for requested "), F.col("num_visits").cast("string"), F.lit(" visits."))
    warnings = F.array_compact(F.array(
        F.when((F.size("areas") > 0) & (F.col("fallbacks") > 0) & (F.col("fallbacks") < F.col("stops")), F.lit("선택한 자치구 내 실제 후보를 우선 사용하고 부족한 일정만 기본 후보로 채웠습니다.")),
        F.when(F.col("no_coords") > 0, F.lit("좌표가 없는 후보는 추천 결과와 타임라인에는 유지되며, 지도 marker에서는 제외됩니다.")),
        F.when(F.col("stops") < F.col("num_visits"), missing)))
    return rows.select("route_id", "date", day_of_week("date").alias("day_of_week"), "start_location", F.col("start_area").alias("start_area"), F.col("stops").alias("num_visits"),
                       length.alias("estimated_total_time"), "place_type_diversity", "travel_minutes", "fallbacks", F.array_join(warnings, " | ").alias("warnings"))


def swap_options(stops: DataFrame, pool: DataFrame, n: int = 4) -> DataFrame:
    """Per stop: other places of its area, same type first, at most n.

    The pool side is cut to n+1 names per (area, type) and n+1 per area first;
    each name enters a cut once, so the stop's own name costs one place only.
    """
    by_type = first_per(first_per(pool, ["area", "place_type", "place_name"], POOL_ORDER), ["area", "place_type"], POOL_ORDER, n + 1, "turn")
    by_area = first_per(first_per(pool, ["area", "place_name"], POOL_ORDER), ["area"], POOL_ORDER, n + 1, "turn")
    cols = [F.col("place_name").alias("swap_name"), F.col("place_type").alias("swap_type"), "turn"]
    same = stops.join(by_type.select("area", *cols, F.col("place_type")), ["area", "place_type"]).withColumn("same_type", F.lit(True))
    other = stops.join(by_area.select("area", *cols), "area").withColumn("same_type", F.col("swap_type") == F.col("place_type"))
    rows = same.unionByName(other).filter(F.col("swap_name") != F.col("raw_place_name"))
    rows = first_per(rows, ["route_id", "order", "swap_name"], [F.desc("same_type"), "turn"])
    return first_per(rows, ["route_id", "order"], [F.desc("same_type"), "turn", "swap_name"], n, "option").select(
        "route_id", "order", "option", "swap_name", "swap_type")


def route_character(stops: DataFrame, requests: DataFrame) -> DataFrame:
    """One label per route from its goal and stop types."""
    has = lambda words: F.max(contains_any(F.lower("place_type"), words))
    flags = stops.groupBy("route_id").agg(has(["교통", "subway"]).alias("c"), has(["시장", "상권", "market"]).alias("m"), has(["정책", "복지", "policy", "welfare"]).alias("w"))
    rows = requests.select("route_id", "goal").join(flags, "route_id", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select("route_id", F.when(contains_any(F.col("goal"), ["출근", "퇴근"]) | f("c"), "출퇴근 인사 중심").when(f("m"), "시장·상권 밀착형")
                       .when(f("w"), "정책현장 방문형").otherwise("생활권 순회형").alias("route_character"))


def package(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """One nested row per route: summary fields and a timeline array."""
    item = F.struct("order", "time", "place_name", "area", "place_type", "score", "source", "travel_minutes")
    line = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(item)).alias("timeline"))
    return route_summary(requests, stops).join(line, "route_id", "left")


# --- choosing stored queries and broadening lists ---------------------------------------
def choose_query(requests: DataFrame, queries: DataFrame, areas=None) -> DataFrame:
    """Best stored query per request: +10 area, +3 target, +3 purpose, +2 hour.

    An area match outweighs everything else, so requests meet the queries of
    their own areas by an equi-join; only requests without one meet the distinct
    (target, type, activity, hour) combinations of all queries. Both sides are
    reduced to distinct combinations first.
    """
    dims = ["target_group", "place_type", "activity_type", "q_hour"]
    keyed = queries.withColumns({"q_area": F.coalesce(norm_area("area", areas), F.lit("")), "q_hour": F.substring(clean("time"), 1, 2)})
    per_area = keyed.groupBy("q_area", *dims).agg(F.min("query_id").alias("query_id"))
    per_dims = per_area.groupBy(*dims).agg(F.min("query_id").alias("query_id"))
    want = requests.withColumns({"r_target": clean("target"), "r_purpose": clean("purpose"), "r_hour": F.substring(clean("time"), 1, 2)})
    asks = want.select("r_target", "r_purpose", "r_hour", "areas").distinct()
    score = (F.when((F.col("r_target") != "") & clean("target_group").contains(F.col("r_target")), 3).otherwise(0)
             + F.when((F.col("r_purpose") != "") & F.concat_ws(" ", clean("place_type"), clean("activity_type")).contains(F.col("r_purpose")), 3).otherwise(0)
             + F.when((F.col("r_hour") != "") & (F.col("q_hour") == F.col("r_hour")), 2).otherwise(0))
    keys = ["r_target", "r_purpose", "r_hour", "areas"]
    pick = lambda rows, s: rows.groupBy(*keys).agg(F.min(F.struct((-s).alias("neg"), "query_id")).alias("_m"))
    near = pick(asks.withColumn("q_area", F.explode("areas")).join(per_area, "q_area"), score + 10)
    rest = asks.join(near.select(*keys), keys, "left_anti")
    every = per_dims.agg(F.collect_list(F.struct(*dims, "query_id")).alias("d"))
    far = pick(rest.withColumn("_d", F.explode(every.scalar())).select(*keys, "_d.*"), score)
    best = near.unionByName(far).select(*keys, F.col("_m.query_id").alias("query_id"), (-F.col("_m.neg")).alias("score"))
    return want.join(best, keys).select("request_id", "query_id", "score")


def broaden(lists: DataFrame, pool: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """Fill a short list from its area, then from seeds.

    ``lists``: list_id, area, item_id, score, rank. ``pool`` and ``seeds``:
    area, item_id, score. Each fill is cut to what any list could need first.
    """
    sizes = lists.groupBy("list_id", "area").agg(F.count("*").alias("have"))
    short = sizes.filter(F.col("have") < limit)
    near = first_per(pool, ["area"], [F.desc("score"), "item_id"], 2 * limit, "_r").select("area", "item_id", "score", "_r")
    # The best seeds of all, 2 * limit of them, as one array value.
    best = seeds.orderBy(F.desc("score"), "item_id").limit(2 * limit).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_neg"), "item_id", "score"))).alias("b"))
    a = short.join(near, "area").select("list_id", "area", "item_id", "score", F.lit(1).alias("stage"), "_r")
    s = short.select("list_id", "area", F.posexplode(best.scalar()).alias("_p", "_b")).select("list_id", "area", "_b.item_id", "_b.score", F.lit(2).alias("stage"), (F.col("_p") + 1).alias("_r"))
    own = lists.select("list_id", "area", "item_id", "score", F.lit(0).alias("stage"), F.col("rank").alias("_r"))
    rows = first_per(union_all([own, a, s]), ["list_id", "item_id"], ["stage", "_r"])
    return first_per(rows, ["list_id"], ["stage", "_r", "item_id"], limit, "position").drop("_r")


# --- display ----------------------------------------------------------------------------
def display_scores(text: Column) -> dict:
    """Display scores by keyword rules; explicit scores should be coalesced first."""
    return {name: F.when(F.lower(text).rlike(p), hi).otherwise(lo) for name, p, hi, lo in fv.DISPLAY_SCORE_RULES}


def feature_labels(text: Column) -> Column:
    """Up to four rule labels, or the two general ones."""
    hit = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in fv.FEATURE_LABEL_RULES]))
    return F.when(F.size(hit) == 0, lit_array(fv.FEATURE_LABEL_OTHER)).otherwise(F.slice(hit, 1, 4))
