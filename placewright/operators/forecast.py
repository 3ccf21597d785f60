"""Forecast places checked against later visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright.functions.areas import norm_area
from placewright.functions.numbers import dcg_gain
from placewright.functions.text import clean, loose_name
from placewright.operators.shaping import first_per, split_eligible

LEVELS = {"exact_place_match": 3, "alias_match": 3, "same_address_match": 2, "same_district_place_type_match": 1, "no_match": 0}


def match_type() -> Column:
    """Match of a prediction (p_*) and an actual visit (a_*)."""
    p, a = F.col("p_name"), F.col("a_name")
    named = (p != "") & (a != "")
    pa, aa = F.col("p_address"), F.col("a_address")
    place = (F.col("p_area") != "") & (F.col("p_area") == F.col("a_area")) & ((F.col("a_type") == "") | (F.col("p_type") == F.col("a_type")))
    return (F.when(named & (p == a), "exact_place_match").when(named & (p.contains(a) | a.contains(p)), "alias_match")
            .when((pa != "") & (aa != "") & (pa.contains(aa) | aa.contains(pa)), "same_address_match")
            .when(place, "same_district_place_type_match").otherwise("no_match"))


def relevance(kind: Column) -> Column:
    return F.when(kind.isin("exact_place_match", "alias_match"), 3).when(kind == "same_address_match", 2).when(
        kind == "same_district_place_type_match", 1).otherwise(0)


def _or_blank(df: DataFrame, c: str) -> Column:
    return clean(F.col(c).cast("string")) if c in df.columns else F.lit("")


def predictions_of(df: DataFrame, areas=None) -> DataFrame:
    """list_id, rank, target_date, actor plus comparison columns."""
    return df.select("list_id", F.col("rank").cast("int").alias("rank"), F.col("target_date").cast("date").alias("target_date"),
                     clean(F.col("actor").cast("string")).alias("actor"), F.col("place_name").alias("p_place"), loose_name("place_name").alias("p_name"),
                     loose_name(_or_blank(df, "address")).alias("p_address"), F.coalesce(norm_area(_or_blank(df, "area"), areas), F.lit("")).alias("p_area"),
                     _or_blank(df, "place_type").alias("p_type"))


def actuals_of(df: DataFrame, areas=None) -> DataFrame:
    return df.select("visit_id", F.col("visit_date").cast("date").alias("visit_date"), clean(F.col("actor").cast("string")).alias("a_actor"),
                     F.col("place_name").alias("a_place"), loose_name("place_name").alias("a_name"),
                     loose_name(_or_blank(df, "address")).alias("a_address"), F.coalesce(norm_area(_or_blank(df, "area"), areas), F.lit("")).alias("a_area"),
                     _or_blank(df, "place_type").alias("a_type"))


def window_join(p: DataFrame, a: DataFrame, days: int) -> DataFrame:
    """Visits of the same actor within ``days`` after the target date.

    The range is turned into an equi-join on (actor, day): a prediction looks up
    its days+1 dates, so a busy actor spreads over dates. Visits without an
    actor pass for every actor and are joined on the date alone.
    """
    seen = p.withColumn("visit_date", F.explode(F.expr(f"sequence(target_date, date_add(target_date, {max(days, 0)}))")))
    named = seen.join(a.filter("a_actor <> ''").withColumnRenamed("a_actor", "actor"), ["actor", "visit_date"])
    open_actor = seen.filter("actor = ''").join(a.filter("a_actor <> ''").drop("a_actor"), "visit_date")
    anyone = seen.join(a.filter("a_actor = ''").drop("a_actor"), "visit_date")
    return named.unionByName(open_actor).unionByName(anyone)


def forecast_matches(predictions: DataFrame, actuals: DataFrame, days: int = 0, k: int = 5, areas=None) -> DataFrame:
    """Best match of each top-k prediction; the first visit wins ties.

    Visits of one (actor, day, comparison value) are equal for matching, so
    they are reduced to their first visit before the join.
    """
    p = first_per(predictions_of(predictions, areas), ["list_id"], ["rank", "p_place"], k)
    a = actuals_of(actuals, areas)
    distinct = a.groupBy("visit_date", "a_actor", "a_name", "a_address", "a_area", "a_type").agg(
        F.min(F.struct("visit_id", "a_place")).alias("_f"))
    distinct = distinct.select("*", F.col("_f.visit_id").alias("visit_id"), F.col("_f.a_place").alias("a_place")).drop("_f")
    pairs = window_join(p, distinct, days).withColumn("match_type", match_type()).withColumn("relevance", relevance(F.col("match_type")))
    best = first_per(pairs.filter("relevance > 0"), ["list_id", "rank"], [F.desc("relevance"), "visit_id"])
    best = best.select("list_id", "rank", "match_type", "relevance", F.col("a_place").alias("matched_place"), "visit_id")
    out = p.select("list_id", "rank", "target_date", "actor", F.col("p_place").alias("place_name")).join(best, ["list_id", "rank"], "left")
    return out.withColumns({"match_type": F.coalesce("match_type", F.lit("no_match")), "relevance": F.coalesce("relevance", F.lit(0)),
                            "matched_place": F.coalesce("matched_place", F.lit(""))})


def actual_counts(predictions: DataFrame, actuals: DataFrame, days: int) -> DataFrame:
    """Comparable visits per list, counted per (actor, day) before the join."""
    lists = predictions.groupBy("list_id").agg(F.min_by(F.struct(F.col("target_date").cast("date").alias("target_date"),
                                                                  clean(F.col("actor").cast("string")).alias("actor")), "rank").alias("_f"))
    lists = lists.select("list_id", "_f.*")
    daily = actuals.groupBy(F.col("visit_date").cast("date").alias("visit_date"), clean(F.col("actor").cast("string")).alias("a_actor")).agg(F.count("*").alias("n"))
    return window_join(lists, daily, days).groupBy("list_id").agg(F.sum("n").alias("actual_count"))


def forecast_metrics(matches: DataFrame, counts: DataFrame, k: int = 5) -> DataFrame:
    """Hit, precision, recall (capped), NDCG against its own ideal, MRR."""
    rel = F.col("relevance")
    pos = F.row_number().over(W.partitionBy("list_id").orderBy("rank"))
    best = F.row_number().over(W.partitionBy("list_id").orderBy(F.desc("relevance"), "rank"))
    rows = matches.withColumns({"_pos": pos, "_best": best})
    sums = rows.groupBy("list_id").agg(
        F.count_if(rel >= 2).alias("direct"), F.sum(dcg_gain(rel, F.col("_pos"))).alias("dcg"), F.sum(dcg_gain(rel, F.col("_best"))).alias("idcg"),
        F.min(F.when(rel >= 2, F.col("_pos"))).alias("first"))
    out = sums.join(counts, "list_id", "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))
    n, d = F.col("actual_count"), F.col("direct")
    return out.select(
        "list_id", "actual_count", F.when(d > 0, 1.0).otherwise(0.0).alias("hit_at_k"), (d / F.lit(float(max(1, k)))).alias("precision_at_k"),
        F.coalesce(F.try_divide(F.least(d, n).cast("double"), n.cast("double")), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.try_divide(F.col("dcg"), F.col("idcg")), F.lit(0.0)).alias("ndcg_at_k"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def request_filter(target_date: str, actor: str, areas) -> Column:
    """Same date and actor, allowed area; blanks pass (no areas: all pass)."""
    day = F.col("visit_date").cast("string")
    same = (F.coalesce(day, F.lit("")) == "") | (day == target_date)
    who = (clean("actor") == "") | (clean("actor") == actor)
    return same & who & (F.col("area").isin(list(areas)) if areas else F.lit(True))


def matched_split(matches: DataFrame):
    return split_eligible(matches, F.col("relevance") > 0)


def controlled_top_k(items: DataFrame, list_col: str, order, k: int, seed) -> DataFrame:
    """Seeded pseudo-random k of the first max(k, 3k) items per list.

    Items are ordered by md5(seed | name-position), then score.
    """
    pool = first_per(items, [list_col], order, max(k, 3 * k), "source_rank")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("place_name"), (F.col("source_rank") - 1).cast("string")))
    return first_per(pool.withColumn("draw", draw), [list_col], ["draw", F.desc("score")], k, "rank")
