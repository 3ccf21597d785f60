"""Alias audits and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.text import clean, contains_any, lit_array, place_key
from placewright.operators.evaluation import evaluate, flatten_summary, summarise
from placewright.operators.matching import match_pairs, near_pairs, prepare_gold, prepare_recs
from placewright.operators.ranking import RANK_ORDER, TUNED_FEATURES, in_area, weighted
from placewright.operators.shaping import first_per, union_all
from placewright.session import cut_lineage


def public_keys(sources: dict) -> DataFrame:
    """(source, key) of every public table: name -> (table, name column)."""
    return union_all([t.select(F.lit(s).alias("source"), place_key(c).alias("key")) for s, (t, c) in sources.items()]).filter("key <> ''").distinct()


def classify_aliases(aliases: DataFrame, gold: DataFrame, keys: DataFrame) -> DataFrame:
    """Labels, primary class and leak suspicion of each alias row.

    Aliases need alias_row_id. Gold names meet aliases through their distinct
    keys, so a name repeated in many gold rows is compared once.
    """
    a = aliases.select("alias_row_id", "canonical_name", "alias_name", "source", "note",
                       place_key("canonical_name").alias("ck"), place_key("alias_name").alias("ak"))
    names = gold.select("query_id", place_key("place_name").alias("gk")).groupBy("gk").agg(F.count("*").alias("rows"))
    flat = a.select("alias_row_id", F.explode(F.array_distinct(F.array("ck", "ak"))).alias("k")).filter("k <> ''")
    near = near_pairs(flat, names.withColumnRenamed("gk", "g"), "k", "g")
    hit = flat.join(near, flat["k"] == near["a"]).groupBy("alias_row_id", F.col("b").alias("gk")).agg(F.max("similarity").alias("sim"))
    gold_hits = hit.join(names, "gk").groupBy("alias_row_id").agg(F.sum("rows").alias("gold_match_count"), F.max("sim").alias("max_gold_similarity"))
    public = flat.join(keys, flat["k"] == keys["key"]).groupBy("alias_row_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("public_source_matches"))
    rows = a.drop("source").join(aliases.select("alias_row_id", "source"), "alias_row_id").join(gold_hits, "alias_row_id", "left").join(public, "alias_row_id", "left")
    rows = rows.withColumns({"gold_match_count": F.coalesce("gold_match_count", F.lit(0)),
                             "max_gold_similarity": F.coalesce("max_gold_similarity", F.lit(0.0)),
                             "public_source_matches": F.coalesce("public_source_matches", F.lit(""))})
    c = fv.ALIAS_CLASS_PREFERENCE
    in_gold, in_public = F.col("gold_match_count") > 0, F.col("public_source_matches") != ""
    station = contains_any(clean("alias_name"), fv.ALIAS_STATION_WORDS) | F.lower(clean("note")).contains("station")
    flags = {c[1]: in_public, c[2]: station, c[3]: contains_any(clean("alias_name"), fv.ALIAS_LANDMARK_WORDS),
             c[4]: (clean("canonical_name") != clean("alias_name")) & (F.col("ck") != F.col("ak")),
             c[5]: clean("source") == "manual_alias_seed", c[0]: in_gold}
    labels = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]))
    primary = F.coalesce(*[F.when(flags[n], F.lit(n)) for n in c], F.lit(c[5]))
    return rows.select("alias_row_id", "canonical_name", "alias_name", primary.alias("primary_class"), F.array_join(labels, ";").alias("all_labels"),
                       "public_source_matches", "gold_match_count", F.round("max_gold_similarity", 6).alias("max_gold_similarity"),
                       ((F.col("gold_match_count") == 1) & ~in_public).alias("single_query_suspect"))


def performance_split(public: DataFrame, expanded: DataFrame) -> DataFrame:
    """Metric rows (metric, value) before and after, and the alias-only part."""
    p, e = public.select("metric", F.col("value").alias("public_only")), expanded.select("metric", F.col("value").alias("alias_expanded"))
    rows = p.join(e, "metric", "full").na.fill(0.0)
    return rows.withColumn("alias_only_contribution", F.col("alias_expanded") - F.col("public_only"))


def alias_contribution(gold: DataFrame, recs: DataFrame, public_hits: DataFrame, list_col="query_id", aliases=None, areas=None) -> DataFrame:
    """Where the first top-10 match of each query came from.

    ``recs`` carries candidate_source; ``public_hits`` has (query_id, hit).
    """
    g = prepare_gold(gold, list_col, areas)
    pairs = match_pairs(g, prepare_recs(recs, list_col, most=10, areas=areas), aliases)
    first = first_per(pairs, ["query_id"], ["rank", "ord", "gold_item"]).select("query_id", "list_id", "rank", "method")
    src = recs.select(F.col(list_col).alias("list_id"), F.col("rank").cast("int").alias("rank"), "rec_name", "candidate_source")
    queries = gold.select("query_id").distinct()
    rows = queries.join(first.join(src, ["list_id", "rank"], "left"), "query_id", "left").join(public_hits, "query_id", "left")
    already = F.coalesce("hit", F.lit(False))
    kind = (F.when(F.col("rank").isNull(), "not_hit_after_expansion").when(already, "public_candidate_already_hit")
            .when(F.col("candidate_source").startswith("alias_table"), "new_hit_from_alias_candidate")
            .otherwise("new_hit_from_public_candidate_or_matching_change"))
    return rows.select("query_id", F.col("rank").isNotNull().alias("after_hit"), already.alias("public_hit"), kind.alias("contribution_category"),
                       F.col("rank").alias("matched_rank"), F.coalesce("rec_name", F.lit("")).alias("matched_place_name"),
                       F.coalesce("candidate_source", F.lit("")).alias("matched_source"), F.coalesce("method", F.lit("")).alias("matched_method"))


def contribution_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contribution_category").agg(F.count("*").alias("queries"))


def leave_one_out(features: DataFrame, gold: DataFrame, weights, removed, prefix="alias_table", type_col="place_type", list_col="sig",
                  ks=None, aliases=None, areas=None) -> DataFrame:
    """Rank and evaluate once per removed type, all ablations in one job.

    The ablation is a column: each candidate row is kept for the ablations that
    do not remove it. ``removed`` lists the types; "" removes nothing.
    """
    names = ["", *removed]
    gone = F.col("candidate_source").startswith(prefix)
    kept = F.filter(lit_array(names), lambda a: (a == "") | ~(gone & (F.col(type_col) == a)))
    tagged = features.withColumn("ablation", F.explode(kept))
    scored = in_area(tagged, list_col, areas).withColumn("score", F.round(weighted(TUNED_FEATURES, weights), 6))
    recs = first_per(scored, ["ablation", list_col], RANK_ORDER, 10, "rank")
    metrics = flatten_summary(summarise(evaluate(gold, recs, ks, list_col, aliases, "ablation", names, areas), ["ablation"]), "ablation", ks)
    g = prepare_gold(gold, list_col, areas)
    raw = prepare_recs(features.withColumn("kept", kept), list_col, "raw_rank", by=["kept"], areas=areas)
    found = match_pairs(g, raw, aliases, ["kept"]).select("kept", "query_id", "gold_item")
    found = found.groupBy("query_id", "gold_item").agg(F.array_distinct(F.flatten(F.collect_set("kept"))).alias("kept")).select(F.explode("kept").alias("ablation"))
    total = gold.agg(F.count("*").cast("double").alias("n"))
    counts = found.groupBy("ablation").agg(F.count("*").alias("found"))
    rows = metrics.join(counts, "ablation", "left").withColumn("raw_recall_50", F.coalesce("found", F.lit(0)) / total.scalar())
    # A row per ablation, read twice: cut here, so that the evaluation runs once.
    rows = cut_lineage(rows)
    base = rows.filter("ablation = ''").agg(F.struct(*[F.max(c).alias(c) for c in ["raw_recall_50", "r_10", "ndcg_10"]]).alias("b"))
    rows = rows.withColumn("_b", base.scalar())
    return rows.select("ablation", "raw_recall_50", "p_1", "r_10", "ndcg_10",
                       *[(F.col(c) - F.col(f"_b.{c}")).alias(f"delta_{c}") for c in ["raw_recall_50", "r_10", "ndcg_10"]])


def alias_ablation(runs: dict) -> DataFrame:
    """Setting x metrics from two finished runs: name -> flat metric table."""
    return union_all([df.withColumn("setting", F.lit(name)) for name, df in runs.items()])
