"""Place scorers: one weighted sum per place type and context.

A context is (slot, age group). Every scorer takes a place table with the
common columns place_id, name, area plus the measures of its type, scores each
place for every context in one map-side explode, and returns the common result
columns. Maxima for normalising are scalar subqueries, never an unpartitioned
window, and the auxiliary summary is one scalar map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import area_from_name
from placewright.functions.numbers import num
from placewright.functions.text import clean, matched_keywords
from placewright.operators.shaping import filter_area, first_per, latest_period, union_all

CONTEXTS = [(s, a) for s in ("morning", "afternoon") for a in ("20_40", "60_plus")]
RESULT = ["place_id", "name", "place_type", "area", "latitude", "longitude", "slot", "age_group",
          *fv.SCORE_FEATURES, "raw_score", "score", "reasons"]

# Which auxiliary series blend into which score: (target, series, slot, age).
AUX_RULES = {
    "subway": [("age", "worker_age_20_40_ratio", None, "20_40"),
               ("context", "commercial_morning_flow_score", "morning", None),
               ("context", "commercial_afternoon_flow_score", "afternoon", None)],
    "park": [("age", "commercial_age_20_40_ratio", None, "20_40"),
             ("age", "commercial_age_60_plus_ratio", None, "60_plus"),
             ("context", "commercial_afternoon_flow_score", "afternoon", None)],
    "senior_friendly": [("age", "commercial_age_60_plus_ratio", None, "60_plus"),
                        ("age", "worker_age_60_plus_ratio", None, "60_plus"),
                        ("context", "commercial_afternoon_flow_score", None, None)],
    "market": [("age", "commercial_age_20_40_ratio", None, "20_40"), ("age", "worker_age_20_40_ratio", None, "20_40"),
               ("age", "commercial_age_60_plus_ratio", None, "60_plus"),
               ("age", "worker_age_60_plus_ratio", None, "60_plus"),
               ("context", "commercial_morning_flow_score", "morning", None),
               ("context", "commercial_afternoon_flow_score", "afternoon", None)],
}
AUX_COMMON = [("age", "living_pop_20_40_ratio", None, "20_40"), ("age", "living_pop_60_plus_ratio", None, "60_plus"),
              ("context", "living_pop_morning_score", "morning", None),
              ("context", "living_pop_afternoon_score", "afternoon", None)]
AUX_NOTES = {"worker:age": "auxiliary worker population age match applied",
             "commercial:age": "auxiliary commercial age match applied",
             "living:age": "auxiliary living population age match applied",
             "commercial:context": "auxiliary commercial flow context applied",
             "living:context": "auxiliary living population context applied"}


def with_contexts(df: DataFrame, contexts=None) -> DataFrame:
    rows = ", ".join(f"struct('{s}' AS slot, '{a}' AS age_group)" for s, a in (contexts or CONTEXTS))
    return df.select("*", F.expr(f"inline(array({rows}))"))


def aux_series(aux: DataFrame) -> DataFrame:
    """One struct of normalised series from the summary map: places then read
    plain fields instead of normalising a map entry per row."""
    items = []
    for key in fv.AUX_FEATURES:
        mean, low, high = (f"try_element_at(summary, '{key}_{x}')" for x in ("mean", "min", "max"))
        scaled = f"CASE WHEN {high} > {low} THEN ({mean} - {low}) / ({high} - {low}) ELSE {mean} END"
        items.append(f"'{key}', CASE WHEN {mean} IS NOT NULL THEN least(greatest({scaled}, 0D), 1D) END")
    return aux.select(F.expr(f"named_struct({', '.join(items)})").alias("series"))


def _aux(kind: str, target: str):
    """Present values of a target's series (SQL texts) and their notes."""
    values, notes = [], []
    for goal, key, slot, age in [*AUX_RULES[kind], *AUX_COMMON]:
        if goal != target:
            continue
        conds = [f"slot = '{slot}'"] if slot else []
        conds += [f"age_group = '{age}'"] if age else []
        value = f"CASE WHEN {' AND '.join(conds)} THEN _aux.{key} END" if conds else f"_aux.{key}"
        values.append(value)
        notes.append(f"CASE WHEN ({value}) IS NOT NULL THEN '{AUX_NOTES[key.split('_')[0] + ':' + goal]}' END")
    return values, notes


def _adjusted(base: str, values) -> Column:
    """Base plus strength x (mean of the present values - 0.5), clamped."""
    total = " + ".join(f"coalesce({v}, 0D)" for v in values)
    count = " + ".join(f"cast(({v}) IS NOT NULL AS int)" for v in values)
    return F.expr(f"CASE WHEN ({count}) = 0 THEN least(greatest({base}, 0D), 1D) ELSE "
                  f"least(greatest({base} + {fv.AUX_STRENGTH}D * (({total}) / cast({count} AS double) - 0.5D), 0D), 1D) END")


YOUNG, OLDER = "age_group = '20_40'", "age_group = '60_plus'"
MORNING, AFTERNOON = "slot = 'morning'", "slot = 'afternoon'"


def _if(cond: str, yes: float, no: float) -> str:
    return f"(CASE WHEN {cond} THEN {float(yes)!r}D ELSE {float(no)!r}D END)"


def _share(x: str, top: str) -> str:
    return f"(CASE WHEN coalesce({top}, 0D) <= 0 THEN 0D ELSE least(greatest({x} / {top}, 0D), 1D) END)"


def _mix(parts: dict, synergy: str) -> str:
    return " + ".join(f"{w!r}D * {c}" for c, w in parts.items()) + f" + 0.15D * {synergy}"


def _finish(df: DataFrame, kind: str, aux: DataFrame | None, mixed: str, why: str, parts) -> DataFrame:
    """Auxiliary adjustment, interaction feature, weighted score, reasons."""
    notes = []
    if aux is not None:
        df = df.withColumn("_aux", aux_series(aux).scalar())
        age, age_notes = _aux(kind, "age")
        context, context_notes = _aux(kind, "context")
        notes = age_notes + context_notes
        df = df.withColumns({"age_score": _adjusted("age_score", age), "context_score": _adjusted("context_score", context)})
    else:
        clamped = lambda c: F.expr(f"least(greatest({c}, 0D), 1D)")
        df = df.withColumns({"age_score": clamped("age_score"), "context_score": clamped("context_score")})
    df = df.withColumns({"interaction_score": F.expr(f"least(greatest({mixed}, 0D), 1D)"), "_why": F.expr(why)})
    total = "0D" + "".join(f" + {c} * {w!r}D" for c, w in zip(fv.SCORE_FEATURES, fv.TYPE_WEIGHTS[kind]))
    reasons = F.expr(f"array_distinct(array_compact(array({', '.join([*parts, *notes])})))")
    return df.withColumns({"raw_score": F.expr(total), "reasons": reasons}).withColumns({"place_type": F.lit(kind), "score": F.round("raw_score", 4)})


def _head(time_tail: str, age_tail: str, context_tail: str, facility_tail: str):
    tails = {"time_match_score": ("time_score", time_tail), "age_match_score": ("age_score", age_tail), "context_score": ("context_score", f"'{context_tail}'"),
             "facility_score": ("facility_score", f"'{facility_tail}'"), "interaction_score": ("interaction_score", "concat('from ', _why)")}
    return [f"concat('{n}=', format_string('%.2f', {c}), ' ', {t})" for n, (c, t) in tails.items()]


FOR_GROUP = "concat('for target group ', age_group)"


def _texts(rows: DataFrame, cols) -> DataFrame:
    return rows.withColumns({c: F.expr(f"coalesce(trim({c}), '')") for c in cols})


def score_transit(df: DataFrame, aux=None, contexts=None, station_areas=None) -> DataFrame:
    """Columns used: place_id, name, use_month, morning_in, afternoon_in, [area]."""
    rows = latest_period(df.withColumn("use_month", F.col("use_month").try_cast("long")), "use_month")
    rows = _texts(rows, ["name"]).withColumns({"morning_in": num("morning_in"), "afternoon_in": num("afternoon_in")})
    rows = rows.filter("name <> ''").withColumn("_all", F.expr("morning_in + afternoon_in"))
    inferred = area_from_name("name", station_areas)
    rows = rows.withColumn("area", inferred if "area" not in rows.columns else F.coalesce(F.nullif(clean("area"), F.lit("")), inferred))
    top = rows.agg(F.expr("struct(max(morning_in) AS m, max(afternoon_in) AS a, max(_all) AS d)").alias("t"))
    rows = with_contexts(rows.withColumn("_top", top.scalar()), contexts)
    rows = rows.withColumns({
        "time_score": F.expr(f"CASE WHEN {MORNING} THEN {_share('morning_in', '_top.m')} ELSE {_share('afternoon_in', '_top.a')} END"),
        "age_score": F.expr(_if(YOUNG, 1.0, 0.55)), "context_score": F.expr(_share("_all", "_top.d")), "facility_score": F.lit(0.60)})
    mixed = _mix({"time_score": 0.45, "context_score": 0.25, "age_score": 0.15}, f"{_if(f'{MORNING} AND {YOUNG}', 1.0, 0.78)} * {_if(YOUNG, 1.0, 0.60)}")
    why = f"CASE WHEN {YOUNG} THEN 'commuter timing and working-age audience synergy' ELSE 'broad transit exposure interaction for mixed-age outreach' END"
    parts = _head("concat('from ', slot, ' rider volume in latest month ', cast(use_month AS string))", "'for target outreach fit'",
                  "from overall station exposure", "for baseline transit visibility")
    parts.append("CASE WHEN age_score >= 0.95 THEN 'suitable for working-age outreach' END")
    out = _finish(rows, "subway", aux, mixed, why, parts)
    return first_per(out, ["slot", "age_group", "name"], [F.desc("raw_score"), "place_id"])


def score_parks(df: DataFrame, aux=None, contexts=None, known_areas=None) -> DataFrame:
    """Columns used: place_id, name, area, area_sqm, main_facilities, latitude, longitude."""
    rows = _texts(df, ["name", "area"]).withColumns({"area_sqm": num("area_sqm"), "main_facilities": F.expr("coalesce(main_facilities, '')")}).filter("name <> ''")
    rows = rows.withColumns({"_log": F.expr("ln(greatest(area_sqm, 1D))"), "_len": F.expr("cast(length(main_facilities) AS double)"),
                             "_words": matched_keywords(F.col("main_facilities"), fv.PARK_KEYWORDS), "_known": F.col("area").isin(list(known_areas or fv.AREAS))})
    top = rows.agg(F.expr("struct(max(_log) AS a, max(_len) AS l)").alias("t"))
    rows = rows.withColumns({"_top": top.scalar(), "_density": F.expr(f"cast(size(_words) AS double) / {float(len(fv.PARK_KEYWORDS))!r}D")})
    rows = with_contexts(rows, contexts).withColumns({
        "time_score": F.expr(_if(AFTERNOON, 1.0, 0.75)), "age_score": F.expr(_if(YOUNG, 1.0, 0.70)),
        "context_score": F.expr(f"0.65D * {_if('_known', 1.0, 0.45)} + 0.35D * _density"),
        "facility_score": F.expr(f"0.75D * {_share('_log', '_top.a')} + 0.25D * {_share('_len', '_top.l')}")})
    mixed = _mix({"time_score": 0.20, "age_score": 0.22, "context_score": 0.23, "facility_score": 0.20},
                 f"_density * {_if(AFTERNOON, 1.0, 0.75)} * {_if(YOUNG, 1.0, 0.78)}")
    why = (f"CASE WHEN {YOUNG} AND {AFTERNOON} THEN 'afternoon leisure context and working-age outreach synergy' WHEN {AFTERNOON} THEN "
           "'afternoon park footfall and neighborhood outreach synergy' ELSE 'park amenity context interaction applied' END")
    parts = _head("concat('because parks fit ', slot, ' outreach')", FOR_GROUP, "from place context and district fit", "from park scale and facilities")
    parts += ["CASE WHEN size(_words) > 0 THEN concat('context keyword match: ', array_join(_words, ', ')) END",
              "CASE WHEN _known THEN 'located in a Seoul district' ELSE 'non-Seoul district penalty applied' END"]
    return _finish(rows, "park", aux, mixed, why, parts)


def score_seniors(df: DataFrame, aux=None, contexts=None) -> DataFrame:
    """Columns used: place_id, name, area, facility_type, facility_address."""
    rows = _texts(df, ["name", "area", "facility_type", "facility_address"]).filter("name <> '' and area <> '' and facility_type <> ''")
    rows = rows.withColumn("_text", F.expr("concat_ws(' ', name, facility_type)"))
    raw = "0D" + "".join(f" + CASE WHEN contains(_text, '{k}') THEN {w!r}D ELSE 0D END" for k, w in fv.SENIOR_KEYWORD_WEIGHTS.items())
    rows = rows.withColumns({"_words": matched_keywords(F.col("_text"), list(fv.SENIOR_KEYWORD_WEIGHTS)), "_raw": F.expr(raw),
                             "_len": F.expr("cast(length(name) AS double)")})
    top = rows.agg(F.expr("struct(max(_raw) AS r, max(_len) AS l)").alias("t"))
    has = "size(_words) > 0"
    rows = with_contexts(rows.withColumn("_top", top.scalar()), contexts).withColumns({
        "time_score": F.expr(_if(AFTERNOON, 1.0, 0.85)), "age_score": F.expr(_if(OLDER, 1.0, 0.45)),
        "context_score": F.expr("0.80D * " + _if("facility_address <> ''", 1.0, 0.50) + " + 0.20D * " + _share("_len", "_top.l")),
        "facility_score": F.expr(f"0.65D * {_if(has, 1.0, 0.40)} + 0.35D * {_share('_raw', '_top.r')}")})
    mixed = _mix({"time_score": 0.18, "age_score": 0.30, "context_score": 0.17, "facility_score": 0.20},
                 f"{_if(has, 1.0, 0.55)} * {_if(AFTERNOON, 1.0, 0.82)} * {_if(OLDER, 1.0, 0.65)}")
    why = f"CASE WHEN {OLDER} THEN 'afternoon senior welfare context and 60_plus outreach synergy' ELSE 'senior-friendly facility interaction applied' END"
    parts = _head("concat('for ', slot, ' senior outreach timing')", FOR_GROUP, "from district and address context", "from facility keyword relevance")
    parts += [f"CASE WHEN {has} THEN concat('facility keyword match: ', array_join(_words, ', ')) ELSE 'basic senior-friendly facility match' END",
              "'district diversity applied'"]
    out = _finish(rows, "senior_friendly", aux, mixed, why, parts)
    return first_per(out, ["slot", "age_group", "area"], [F.desc("raw_score"), "name", "place_id"])


def score_markets(df: DataFrame, aux=None, contexts=None) -> DataFrame:
    """Columns used: place_id, name, area, market_type, market_address, store_count, floor_area."""
    rows = _texts(df, ["name", "area", "market_type", "market_address"]).withColumns({
        "store_count": num("store_count"), "floor_area": F.greatest(num("floor_area"), F.lit(0.0))})
    rows = rows.filter("name <> '' and area <> '' and market_address <> ''")
    top = rows.agg(F.expr("struct(max(store_count) AS s, max(floor_area) AS f)").alias("t"))
    by_kind = lambda a, b, c: f"(CASE WHEN contains(market_type, '골목형') THEN {a!r}D WHEN contains(market_type, '건물형') THEN {b!r}D ELSE {c!r}D END)"
    rows = with_contexts(rows.withColumn("_top", top.scalar()), contexts).withColumns({
        "time_score": F.expr(_if(AFTERNOON, 1.0, 0.70)), "age_score": F.expr(_if(YOUNG, 0.65, 0.82)), "context_score": F.expr(by_kind(0.78, 0.68, 0.60)),
        "facility_score": F.expr(f"0.60D * {_share('store_count', '_top.s')} + 0.40D * {_share('floor_area', '_top.f')}")})
    mixed = _mix({"time_score": 0.18, "age_score": 0.22, "context_score": 0.20, "facility_score": 0.25},
                 f"{by_kind(1.0, 0.85, 0.70)} * {_if(AFTERNOON, 1.0, 0.72)} * {_if(OLDER, 1.0, 0.80)}")
    why = (f"CASE WHEN {OLDER} AND {AFTERNOON} THEN 'afternoon market activity and senior neighborhood outreach synergy' WHEN {AFTERNOON} THEN "
           "'afternoon market activity and working-age neighborhood contact synergy' ELSE 'market context interaction applied' END")
    parts = _head("concat('for ', slot, ' market outreach timing')", FOR_GROUP, "from market type and local context", "from store count and floor area")
    parts += ["concat('market type: ', market_type)", "concat('district: ', area)"]
    return _finish(rows, "market", aux, mixed, why, parts)


SCORERS = {"subway": score_transit, "park": score_parks, "senior_friendly": score_seniors, "market": score_markets}


def result_columns(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    keep = [F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in RESULT]
    return df.select(*keep).withColumn("place_id", F.col("place_id").cast("string"))


def score_places(tables: dict, aux=None, contexts=None, selected=None, normalise_over="all", **options) -> DataFrame:
    """Scores of every place table for every context, one table.

    ``normalise_over="selected"`` filters to the selected areas before the
    maxima are taken (scores then depend on the selection); ``"all"`` filters
    afterwards.
    """
    frames = []
    for kind, df in tables.items():
        if selected and normalise_over == "selected":
            df = filter_area(df, selected, ["area"], options.get("areas"))
        extra = {k: v for k, v in options.items() if k in SCORERS[kind].__code__.co_varnames}
        frames.append(result_columns(SCORERS[kind](df, aux, contexts, **extra)))
    out = union_all(frames)
    if selected and normalise_over == "all":
        out = filter_area(out, selected, ["area"], options.get("areas")).drop("area_normalised")
    return out


def recommend(tables: dict, contexts=None, top_n: int = 3, aux=None, **options) -> DataFrame:
    """Top places per (slot, age group, place type)."""
    scored = score_places(tables, aux, contexts, **options)
    return first_per(scored, ["slot", "age_group", "place_type"], [F.desc("raw_score"), "name", "place_id"], top_n, "rank")


def recommend_counts(before: DataFrame, after: DataFrame, top_n: int) -> DataFrame:
    """Debug counts: rows before and after the area filter, shortage flag."""
    b = before.groupBy("place_type").agg(F.count("*").alias("before_filter"))
    a = after.groupBy("place_type").agg(F.count("*").alias("after_filter"))
    out = b.join(a, "place_type", "left").na.fill(0, ["after_filter"])
    return out.withColumn("short", F.col("after_filter") < top_n)


def messages(rows: DataFrame, extra_market=True) -> DataFrame:
    """Messages per (place_type, age_group) row, or the default one."""
    rules = fv.MESSAGE_RULES + (fv.MARKET_MESSAGES if extra_market else [])
    dim = rows.sparkSession.createDataFrame(rules, "place_type string, age_group string, seq int, message string, why string")
    keyed = rows.withColumn("place_type", F.when(F.col("place_type") == "senior", "senior_friendly").otherwise(F.col("place_type")))
    out = keyed.join(F.broadcast(dim), ["place_type", "age_group"], "left")
    return out.withColumns({"seq": F.coalesce("seq", F.lit(1)), "message": F.coalesce("message", F.lit(fv.MESSAGE_DEFAULT[0])),
                            "why": F.coalesce("why", F.lit(fv.MESSAGE_DEFAULT[1]))})
