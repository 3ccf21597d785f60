"""Precision, recall and NDCG at k, summaries and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.numbers import dcg_gain
from placewright.functions.text import lit_array
from placewright.operators.matching import first_gold, match_pairs, match_picks, prepare_gold, prepare_recs
from placewright.operators.shaping import first_per, hash_order


def gold_stats(gold: DataFrame, ks) -> DataFrame:
    """Per query: relevant rows, and the ideal DCG at each k.

    Counts combine before the shuffle; ideal gains need only the k most
    relevant rows, cut per task before the shuffle. Which of equally relevant rows
    stay is no part of the sum, so ids stay out of the shuffle.
    """
    top = first_per(gold, ["query_id"], [F.desc("relevance")], max(ks), "_r")
    gain = dcg_gain(F.col("relevance"), F.col("_r"))
    ideal = top.groupBy("query_id").agg(*[F.sum(F.when(F.col("_r") <= k, gain)).alias(f"idcg_{k}") for k in ks])
    return gold.groupBy("query_id", "list_id").agg(F.count("*").alias("total_relevant")).join(ideal, "query_id")


def evaluate(gold: DataFrame, recs: DataFrame, ks=None, list_col="query_id", aliases=None, by=None, by_values=None, areas=None) -> DataFrame:
    """Metrics per (query, k), greedy one-to-one matching.

    ``list_col`` names the list a query is served from (its own id, or the
    signature it shares with other queries). ``by`` is a column of ``recs``
    (model, ablation) evaluated side by side; every query scores 0 where it has
    no recommendations.
    """
    ks = sorted(set(ks or fv.EVAL_KS))
    if any(k <= 0 for k in ks):
        raise ValueError("k must be positive")
    keys = [by] if by else []
    g = prepare_gold(gold, list_col, areas)
    r = prepare_recs(recs, list_col, most=max(ks), by=keys, areas=areas)
    picks = match_picks(match_pairs(g, r, aliases, keys), max(ks), keys)
    sizes = r.groupBy(*keys, "list_id").agg(F.count("*").alias("_n"))
    base = gold_stats(g, ks)
    if by:
        # The values of `by` meet a query side by side, one entry a value, so that queries are dealt once.
        pack = lambda df, key, value, name: df.filter(F.col(by).isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(by, value))).alias(name))
        rows = base.join(pack(picks, "query_id", "picks", "_picks"), "query_id", "left").join(pack(sizes, "list_id", "_n", "_sizes"), "list_id", "left")
        rows = rows.withColumn(by, F.explode(lit_array(by_values)))
        rows = rows.withColumns({"picks": F.try_element_at("_picks", F.col(by)), "_n": F.try_element_at("_sizes", F.col(by))}).drop("_picks", "_sizes")
    else:
        rows = base.join(picks, "query_id", "left").join(sizes, "list_id", "left")
    options = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"idcg_{k}").alias("idcg")) for k in ks])
    rows = rows.withColumn("_k", F.explode(options)).withColumns({"k": F.col("_k.k"), "idcg": F.col("_k.idcg")})
    none = F.array().cast(rows.schema["picks"].dataType)
    # Most queries have no picks: they skip the folds below.
    some = F.col("picks").isNotNull()
    rows = rows.withColumn("_got", F.when(some, F.filter("picks", lambda p: p["rank"] <= F.col("k"))).otherwise(none))
    hits = F.when(some, F.size("_got")).otherwise(0)
    dcg = F.when(some, F.aggregate("_got", F.lit(0.0), lambda acc, p: acc + dcg_gain(p["relevance"], p["rank"]))).otherwise(0.0)
    return rows.select(
        *keys, "query_id", "k", (hits / F.col("k")).alias("precision_at_k"), (hits / F.col("total_relevant")).alias("recall_at_k"),
        F.coalesce(F.try_divide(dcg, F.col("idcg")), F.lit(0.0)).alias("ndcg_at_k"), hits.alias("hits"), "total_relevant",
        F.least(F.coalesce("_n", F.lit(0)), F.col("k").cast("long")).alias("recommended_count_at_k"),
        F.array_join(F.transform("_got", lambda p: p["gold_id"]), ";").alias("matched_gold_ids"),
        F.array_join(F.transform("_got", lambda p: p["method"]), ";").alias("match_methods"))


def summarise(detail: DataFrame, by=()) -> DataFrame:
    """Macro averages by k. Detail holds one row per query and k."""
    return detail.groupBy(*by, "k").agg(
        F.avg("precision_at_k").alias("precision_at_k"), F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("ndcg_at_k").alias("ndcg_at_k"), F.count("*").alias("query_count"))


def flatten_summary(summary: DataFrame, key="model", ks=None) -> DataFrame:
    """One row per model: p_k, r_k, ndcg_k."""
    ks = ks or fv.EVAL_KS
    names = {"precision_at_k": "p", "recall_at_k": "r", "ndcg_at_k": "ndcg"}
    aggs = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}_{k}") for c, n in names.items() for k in ks]
    return summary.groupBy(key).agg(*aggs)


def objective(weights=None) -> Column:
    total = None
    for c, w in (weights or fv.OBJECTIVE).items():
        term = F.lit(w) * F.coalesce(F.col(c), F.lit(0.0))
        total = term if total is None else total + term
    return total


def fast_detail(gold: DataFrame, recs: DataFrame, ks=None, list_col="query_id", aliases=None, by=None, areas=None) -> DataFrame:
    """Evaluator that takes, per recommendation, the first gold row that
    matches, and counts each gold item once, at its best rank."""
    ks = sorted(set(ks or fv.EVAL_KS))
    keys = [by] if by else []
    g = prepare_gold(gold, list_col, areas)
    r = prepare_recs(recs, list_col, most=max(ks), by=keys, areas=areas)
    labels = first_gold(match_pairs(g, r, aliases, keys), keys)
    best = first_per(labels, [*keys, "query_id", "gold_item"], ["rank"])
    gain = dcg_gain(F.col("relevance"), F.col("rank"))
    sums = best.groupBy(*keys, "query_id").agg(*[x for k in ks for x in (
        F.count_if(F.col("rank") <= k).alias(f"hits_{k}"), F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}"))])
    return gold_stats(g, ks).join(sums, "query_id", "left")


def similarity_at(rows: DataFrame, by=(), k=10) -> DataFrame:
    """Mean match features over the top k rows."""
    top = rows.filter(F.col("rank") <= k)
    cols = {"area_10": "area_match", "type_10": "type_match", "time_10": "time_match", "context_10": "context_match",
            "target_10": "target_match", "composite_10": "composite", "hit_10": "exact_place_hit"}
    return top.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(n) for n, c in cols.items() if c in rows.columns],
                                F.count("*").alias("evaluated_rows"))


def similarity_table(gold: DataFrame, recs: DataFrame) -> DataFrame:
    names = gold.select("query_id", F.col("place_name").alias("gold_place_name"))
    return recs.join(names, "query_id").select(
        "query_id", "rank", "gold_place_name", "rec_name", "exact_place_hit", "area_match", "type_match", "time_match",
        "context_match", "target_match", "semantic", "composite")


def train_split(ids: DataFrame, key="query_id", ratio=0.7, seed=42, least_one=False) -> DataFrame:
    """Seeded split: the first floor(ratio*n) ids in hash order are train."""
    distinct = ids.select(key).distinct()
    total = distinct.agg(F.count("*").alias("n"))
    cut = F.floor(total.scalar() * F.lit(ratio))
    cut = F.greatest(cut, F.lit(1)) if least_one else cut
    ordered = hash_order(distinct, key, seed)
    return ordered.select(key, F.when(F.col("position") <= cut, "train").otherwise("validation").alias("split"))


def split_summaries(detail: DataFrame, splits: DataFrame, by=()) -> DataFrame:
    """Train, validation and full summaries in one table."""
    tagged = detail.join(splits, "query_id").withColumn("split", F.explode(F.array("split", F.lit("full"))))
    return summarise(tagged, [*by, "split"])


def transitions(before: DataFrame, after: DataFrame, actors: DataFrame, per_actor: int = 1) -> DataFrame:
    """The first queries of each actor that were missed before and are hit after: query_id, actor, rank_after.

    before, after: (query_id, rank), the best matching rank of a run, rows of missed
    queries absent. Each task keeps per_actor rows of an actor before the shuffle.
    """
    turned = after.join(before.select("query_id"), "query_id", "left_anti").withColumnRenamed("rank", "rank_after")
    return first_per(actors.join(turned, "query_id"), ["actor"], ["query_id"], per_actor).select("query_id", "actor", "rank_after")


def trace_sample(actors: DataFrame, turned: DataFrame, heads: int = 2, cap: int = 5) -> DataFrame:
    """Queries to trace (query_id, actor, reason): the first of each actor, then the first that turned into a hit; ``cap`` in all.

    reason is head, miss_to_hit or fill; a query is listed once, for its first reason.
    """
    head = first_per(actors, ["actor"], ["query_id"], heads, "_n").select("query_id", "actor", F.lit(0).alias("_k"), F.col("actor").alias("_by"))
    turn = turned.orderBy("query_id").limit(1).select("query_id", "actor", F.lit(1).alias("_k"), F.lit("").alias("_by"))
    fill = actors.orderBy("query_id").limit(cap + heads).select("query_id", "actor", F.lit(2).alias("_k"), F.lit("").alias("_by"))
    rows = first_per(head.unionByName(turn).unionByName(fill), ["query_id"], ["_k", "_by"])
    picked = rows.orderBy("_k", "_by", "query_id").limit(cap)
    return picked.select("query_id", "actor", F.get(lit_array(["head", "miss_to_hit", "fill"]), F.col("_k")).alias("reason"))


def trace(recs: DataFrame, gold: DataFrame, models, samples: DataFrame, k=10, aliases=None, list_col="query_id", areas=None) -> DataFrame:
    """Per sampled query: best matching rank and top-k names of each model.

    ``recs`` has a row per (model, list, rank); ``list_col`` names the list of a query.
    """
    some = gold.join(samples.select("query_id"), "query_id", "left_semi")
    lists = some.select("query_id", F.col(list_col).alias("list_id")).distinct()
    rows = recs.withColumn("list_id", F.col(list_col)).filter(F.col("rank") <= k).join(lists.select("list_id").distinct(), "list_id", "left_semi")
    pairs = match_pairs(prepare_gold(some, list_col, areas), prepare_recs(rows, "list_id", by=["model"], areas=areas), aliases, ["model"])
    best = pairs.groupBy("query_id").pivot("model", list(models)).agg(F.min("rank"))
    names = rows.groupBy("list_id").pivot("model", list(models)).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("rank", "rec_name"))), lambda x: x["rec_name"]), " | "))
    ranked = best.select("query_id", *[F.col(m).alias(f"{m}_rank") for m in models])
    listed = lists.join(names.select("list_id", *[F.col(m).alias(f"{m}_places") for m in models]), "list_id", "left").drop("list_id")
    return samples.join(listed, "query_id", "left").join(ranked, "query_id", "left")
