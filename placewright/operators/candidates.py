"""Candidate pools: what a request may be offered, frozen before re-ranking.

A pool depends on a request only through its area and context (slot, age group,
place types, query type). Requests therefore map to a ``pool_id``; pools are
built once per distinct id, so the work grows with the dictionaries and the
place table, and requests are only joined to a finished list of at most
``top_k`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import norm_area, standard_area
from placewright.functions.text import all_rules, clean, contains_any, join_context, label_map, lit_array, lit_map, place_key
from placewright.functions.times import time_slot2
from placewright.operators.shaping import first_by_score, first_per

TEXT_COLUMNS = ["place_type", "activity_type", "target_group", "context_tags"]


def request_types(text: Column) -> Column:
    """Scorers to run: the first matching rule, else all of them."""
    out = None
    for kind, words in fv.REQUEST_TYPE_RULES:
        hit = contains_any(text, words)
        out = F.when(hit, F.array(F.lit(kind))) if out is None else out.when(hit, F.array(F.lit(kind)))
    return out.otherwise(lit_array(fv.REQUEST_TYPE_DEFAULT))


def expected_types(*cols) -> Column:
    """Every type whose keywords occur."""
    return all_rules(join_context(*cols), fv.EXPECTED_TYPE_RULES)


def with_request_context(requests: DataFrame, areas=None, extra=("evaluation_context",)) -> DataFrame:
    """Adds slot, age_group, rec_types, query_area and pool_id."""
    have = [c for c in TEXT_COLUMNS if c in requests.columns]
    context = join_context(*have, *[c for c in extra if c in requests.columns])
    age = F.when(contains_any(join_context(*have), fv.SENIOR_WORDS), "60_plus").otherwise("20_40")
    out = requests.withColumns({
        "slot": time_slot2("time"), "age_group": age, "rec_types": request_types(context),
        "query_area": F.coalesce(norm_area("area", areas), clean("area"))})
    parts = ["query_area", "slot", "age_group", F.array_join("rec_types", "+"), clean("place_type")]
    return out.withColumn("pool_id", F.concat_ws("|", *parts))


def pools_of(requests: DataFrame) -> DataFrame:
    """Distinct pools; partial aggregation keeps this to the dictionary size."""
    return requests.select("pool_id", "query_area", "slot", "age_group", "rec_types",
                           clean("place_type").alias("query_type")).distinct()


def context_pool(scored: DataFrame, size: int = 200) -> DataFrame:
    """Top places per (slot, age group, type), cut before any area filter."""
    return first_by_score(scored, ["slot", "age_group", "place_type"], "raw_score", ["name", "place_id"], size, "list_pos")


def alias_table(aliases: DataFrame, order=("ord",), areas=None) -> DataFrame:
    """Aliases with blanks filled, keys, area, inferred type and id, deduped."""
    rows = aliases.withColumns({c: clean(c) for c in ["canonical_name", "alias_name", "area", "place_type", "source", "note"]})
    rows = rows.filter("canonical_name <> '' or alias_name <> ''")
    rows = rows.withColumns({"canonical_name": F.coalesce(F.nullif("canonical_name", F.lit("")), "alias_name"),
                             "alias_name": F.coalesce(F.nullif("alias_name", F.lit("")), "canonical_name")})
    rows = rows.withColumns({"canonical_key": place_key("canonical_name"), "alias_key": place_key("alias_name"),
                             "std_area": standard_area("area", fv.ALIAS_LANDMARK_AREAS, areas),
                             "candidate_type": candidate_type("place_type", "canonical_name", "alias_name")})
    rows = rows.withColumn("place_id", F.concat(F.lit("alias:"), place_key("std_area"), F.lit(":"), place_key("canonical_name")))
    return first_per(rows, ["canonical_key", "alias_key", "std_area", "place_type"], list(order))


def candidate_type(place_type, *names) -> Column:
    """Recommender type of an alias: keyword cascade, then the type label."""
    text = join_context(place_type, *names)
    out = None
    for kind, words in fv.ALIAS_TYPE_RULES:
        hit = contains_any(text, words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(label_map(clean(place_type), fv.ALIAS_TYPE_BY_LABEL, F.lit("market")))


def alias_candidates(pools: DataFrame, aliases: DataFrame, areas=None, most: int = 50) -> DataFrame:
    """Area- and type-compatible aliases per pool, in (type, name, alias) order.

    Aliases are one row per (name, area, type) before anything is cut. Pools
    without an area meet the first ``most`` of each alias type, which hold every
    row that they can keep; the others join on their area.
    """
    keyed = pools.withColumn("std_area", standard_area("query_area", fv.ALIAS_LANDMARK_AREAS, areas))
    cols = ["alias_type", "canonical_name", "alias_name", "place_id"]
    renamed = aliases.select("std_area", F.col("place_type").alias("alias_type"), "canonical_name", "alias_name",
                             "candidate_type", "place_id", "source")
    # Types meet by an equi-join: a pool asks for each type that fits its own, or for any (*).
    listed = F.coalesce(F.try_element_at(lit_map(fv.TYPE_COMPATIBILITY), F.col("query_type")), F.array().cast("array<string>"))
    fits = F.when(F.col("query_type") == "", F.array(F.lit("*"))).otherwise(F.array_distinct(F.concat(F.array("query_type", F.lit("")), listed)))
    typed = keyed.withColumn("fit", F.explode(fits))
    each = renamed.withColumn("fit", F.explode(F.array("alias_type", F.lit("*"))))
    scoped = typed.filter("std_area <> ''").join(each, ["std_area", "fit"])
    heads = first_per(first_per(each, ["canonical_name", "std_area", "candidate_type", "fit"], cols), ["fit"], cols, most)
    open_pools = typed.filter("std_area = ''").drop("std_area").join(heads, "fit")
    rows = first_per(scoped.unionByName(open_pools), ["pool_id", "canonical_name", "std_area", "candidate_type"], cols)
    rows = first_per(rows, ["pool_id"], cols, most, "alias_pos")
    source = F.concat(F.lit("alias_table:"), F.coalesce(F.nullif("source", F.lit("")), F.lit("manual")))
    return rows.select("pool_id", F.col("canonical_name").alias("rec_name"), F.col("std_area").alias("rec_area"),
                       F.col("candidate_type").alias("rec_type"), "place_id", source.alias("candidate_source"), "alias_pos")


def pool_candidates(pools: DataFrame, context: DataFrame) -> DataFrame:
    """Deduplicated in-area candidates per pool.

    Equi-join on (slot, age group, type, area). A pool without an area takes
    the whole context pool, which is bounded by its cut. Both sides are small:
    distinct pools, and ``size`` rows per context.
    """
    places = context.select("slot", "age_group", "place_type", F.col("area").alias("query_area"), "name", "place_id", "score", "list_pos")
    wild = places.withColumns({"_area": F.lit("")})
    keyed = places.filter(F.coalesce("query_area", F.lit("")) != "").withColumn("_area", F.col("query_area")).unionByName(wild)
    asked = pools.select("pool_id", "slot", "age_group", F.col("query_area").alias("_area"),
                         F.posexplode("rec_types").alias("type_pos", "place_type"))
    rows = asked.join(keyed, ["slot", "age_group", "place_type", "_area"])
    rows = rows.select("pool_id", F.col("name").alias("rec_name"), F.coalesce("query_area", F.lit("")).alias("rec_area"),
                       F.col("place_type").alias("rec_type"), "place_id", F.col("score").alias("base_score"),
                       F.col("place_type").alias("candidate_source"), "type_pos", "list_pos")
    return first_per(rows.filter("rec_name <> ''"), ["pool_id", "rec_name", "rec_area", "rec_type"], ["type_pos", "list_pos"])


BASE_ORDER = ["-base_score", "-rec_name", "-rec_area", "-rec_type"]


def baseline_recommend(candidates: DataFrame, k: int = 10, key="pool_id") -> DataFrame:
    """Top k by (score, name), both descending."""
    return first_per(candidates, [key], BASE_ORDER, k, "rank")


def variant_recommend(candidates: DataFrame, requests: DataFrame, models=None, k: int = 10) -> DataFrame:
    """Online variants: base score plus the bonuses of each model, per request.

    ``candidates`` are one list per pool; requests join their finished pool.
    Bonuses depend on the request text, so lists are made per distinct text.
    """
    from placewright.operators.ranking import variant_features  # shared bonus expressions

    texts = ["pool_id", "area", "time", "place_type", "activity_type", "target_group", "context_tags"]
    distinct = requests.select(*texts).distinct().withColumn("list_id", F.concat_ws("|", *texts))
    rows = variant_features(distinct.join(candidates, "pool_id"), online=True)
    chosen = models or fv.MODEL_VARIANTS
    rows = rows.withColumn("model", F.explode(lit_array(chosen)))
    on = lambda *m: F.col("model").isin(*m, "combined").cast("double")
    score = (F.col("base_score") + on("area_weighted") * F.col("area_bonus") + on("type_weighted") * F.col("type_bonus")
             + on("time_weighted") * F.col("time_bonus") + on() * F.col("context_bonus"))
    rows = rows.withColumn("score", F.round(score, 4)).withColumn("_exact", score)
    order = [F.desc("_exact"), F.desc("rec_name"), F.desc("rec_area"), F.desc("rec_type")]
    return first_per(rows, ["model", "list_id"], order, k, "rank").drop("_exact")


def freeze_pools(candidates: DataFrame, top_k: int = 50, aliases: DataFrame | None = None, protect: int = 10) -> DataFrame:
    """Frozen pool per ``pool_id``: protected top rows, aliases, then the rest.

    Rows above the lowest protected score that did not make the protected list
    are left out; aliases enter just below that score. The result is re-sorted
    by (score, protected rank, name) and ranked.
    """
    protect = min(protect, top_k)
    w = W.partitionBy("pool_id")
    ranked = first_per(candidates, ["pool_id"], BASE_ORDER, top_k + 1, "_base")
    floor = F.min(F.when(F.col("_base") <= protect, F.col("base_score"))).over(w)
    rows = ranked.withColumn("_floor", floor)
    kept = rows.filter((F.col("_base") <= protect) | (F.col("base_score") <= F.col("_floor")))
    kept = kept.withColumn("_stage", F.when(F.col("_base") <= protect, 0).otherwise(2))
    cols = ["pool_id", "rec_name", "rec_area", "rec_type", "place_id", "base_score", "candidate_source", "_base", "_stage"]
    every = kept.select(*cols)
    if aliases is not None:
        floors = candidates_floor(candidates, protect)
        score = F.round(F.when(F.col("_floor").isNull(), 0.45).otherwise(
            F.greatest(F.lit(0.01), F.col("_floor") - F.lit(0.0001))), 4)
        extra = aliases.join(floors, "pool_id", "left").select(
            "pool_id", "rec_name", "rec_area", "rec_type", "place_id", score.alias("base_score"), "candidate_source",
            F.col("alias_pos").alias("_base"), F.lit(1).alias("_stage"))
        every = first_per(every.unionByName(extra), ["pool_id", "rec_name", "rec_area", "rec_type"], ["_stage", "_base"])
    cut = first_per(every, ["pool_id"], ["_stage", "_base"], top_k)
    shield = F.when(F.col("_stage") == 0, F.col("_base")).otherwise(999999)
    order = [F.desc("base_score"), shield, "rec_name", "_stage", "_base"]
    out = cut.withColumn("raw_rank", F.row_number().over(w.orderBy(*order)))
    return out.withColumn("base_score", F.round("base_score", 4)).drop("_base", "_stage")


def candidates_floor(candidates: DataFrame, protect: int) -> DataFrame:
    top = first_per(candidates, ["pool_id"], BASE_ORDER, protect)
    return top.groupBy("pool_id").agg(F.min("base_score").alias("_floor"))


def raw_candidates(requests: DataFrame, frozen: DataFrame) -> DataFrame:
    """Frozen rows per request, in the published layout.

    The frozen side holds at most ``top_k`` rows per pool; a pool shared by many
    requests is a hot join key, which adaptive execution splits.
    """
    keep = [c for c in ["query_id", "actor", "date", "time", "area", *TEXT_COLUMNS, "evaluation_context"] if c in requests.columns]
    return requests.select(*keep, "pool_id").join(frozen, "pool_id")
