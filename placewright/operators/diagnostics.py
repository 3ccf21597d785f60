"""Coverage, hit and miss analysis, failure classes, contribution, deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.numbers import safe_ratio
from placewright.operators.matching import MARKS, gold_item, gold_text, match_pairs, matched_texts, pairs_of, prepare_gold, prepare_recs, text_mark
from placewright.operators.shaping import first_per
from placewright.session import cut_lineage, release


def best_ranks(gold: DataFrame, recs: DataFrame, rank: str, name: str, list_col="query_id", aliases=None, by=(), areas=None) -> DataFrame:
    """Best matching rank per gold item, any method."""
    g = prepare_gold(gold, list_col, areas)
    pairs = match_pairs(g, prepare_recs(recs, list_col, rank, by=by, areas=areas), aliases, by)
    return pairs.groupBy(*by, "query_id", "gold_item").agg(F.min("rank").alias(name))


def coverage(gold: DataFrame, raw: DataFrame, final: DataFrame, list_col="query_id", aliases=None, areas=None) -> DataFrame:
    """Per gold row: pool size, best raw and final rank, coverage status.

    Raw and final lists are matched in one pass. Only gold rows that can have a rank
    meet the ranks: those whose text matched, and those whose item stands in several
    rows, for rows of an item share its best rank. All others stay where they are.
    """
    sizes = raw.groupBy(F.col(list_col).alias("_list")).agg(F.count("*").alias("raw_candidate_count"))
    base = gold.withColumn("gold_item", F.col("gold_id").cast("string"))
    g = prepare_gold(gold, list_col, areas)
    sides = [prepare_recs(recs.withColumn("_side", F.lit(side)), list_col, rank, by=["_side"], areas=areas) for side, recs, rank in (("raw", raw, "raw_rank"), ("final", final, "rank"))]
    found, marks = matched_texts(g, sides[0].unionByName(sides[1]), aliases, ["_side"])
    best = lambda side, name: F.min(F.when(F.col("_side") == side, F.col("rank"))).alias(name)
    ranks = pairs_of(g, found, marks, aliases, ["_side"]).groupBy("query_id", "gold_item").agg(best("raw", "best_raw_rank"), best("final", "best_final_rank"))
    item = g.select("query_id", "gold_item").groupBy(F.xxhash64("query_id", "gold_item").alias("_item")).agg(F.count("*").alias("n")).filter("n > 1").select("_item")
    several = cut_lineage(item) if marks is not None else None
    release(gold.sparkSession)
    if marks is None or several.limit(MARKS + 1).count() > MARKS:
        rows = base.join(ranks, ["query_id", "gold_item"], "left")
    else:
        own = gold_item(gold)
        known = base.withColumns({"_mark": text_mark(gold_text(gold, list_col)), "_item": F.xxhash64(F.col("query_id"), own), "_own": F.coalesce(own == F.col("gold_item"), F.lit(False))})
        known = known.join(F.broadcast(marks.withColumn("_text", F.lit(True))), "_mark", "left").join(F.broadcast(several.withColumn("_several", F.lit(True))), "_item", "left")
        may = F.coalesce("_text", "_several", ~F.col("_own"))
        some = known.filter(may).select(base.columns).join(ranks, ["query_id", "gold_item"], "left")
        none = F.lit(None).cast("int")
        rows = some.unionByName(known.filter(~may).select(*base.columns, none.alias("best_raw_rank"), none.alias("best_final_rank")))
    keep = [c for c in ["place_type", "activity_type", "actor"] if c in gold.columns]
    rows = rows.join(sizes, rows[list_col] == sizes["_list"], "left")
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    return rows.select(
        "query_id", "gold_id", *dict.fromkeys([list_col] if list_col != "query_id" else []), F.col("place_name").alias("gold_place_name"),
        F.col("area").alias("gold_area"), *keep, F.coalesce("raw_candidate_count", F.lit(0)).alias("raw_candidate_count"),
        within("best_raw_rank", 50).alias("in_raw_top50"), within("best_raw_rank", 100).alias("in_raw_top100"), "best_raw_rank",
        within("best_final_rank", 10).alias("in_top10"), "best_final_rank",
        F.when(F.col("best_raw_rank").isNotNull(), "covered").otherwise("missing_from_raw_candidates").alias("coverage_status"))


def top_names(recs: DataFrame, key="query_id", n=3) -> DataFrame:
    """Top row and the first n names per list."""
    top = recs.filter(F.col("rank") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "rec_name"))), lambda x: x["rec_name"])
    return top.groupBy(key).agg(F.array_join(names, "; ").alias("recommended_top3"),
                                F.max(F.when(F.col("rank") == 1, F.col("rec_name"))).alias("recommended_top1"),
                                F.max(F.when(F.col("rank") == 1, F.col("rec_area"))).alias("top1_area"),
                                F.max(F.when(F.col("rank") == 1, F.col("rec_type"))).alias("top1_type"))


def hit_analysis(covered: DataFrame, recs: DataFrame, list_col="query_id") -> DataFrame:
    """hit@k flags, best rank, top names and an estimated reason per gold row."""
    bonus = recs.select(F.col(list_col), F.col("rank").alias("best_final_rank"), "area_bonus", "type_bonus")
    rows = covered.join(top_names(recs, list_col), list_col, "left").join(bonus, [list_col, "best_final_rank"], "left")
    hit = lambda k: F.coalesce(F.col("best_final_rank") <= k, F.lit(False))
    t = fv.HIT_REASONS
    why = (F.when(hit(10) & (F.col("area_bonus") > 0), t["area"]).when(hit(10) & (F.col("type_bonus") > 0), t["type"])
           .when(hit(10), t["base"]).when(F.col("best_raw_rank").isNull(), t["gap"]).when(F.col("best_raw_rank") > 10, t["low"])
           .when(F.coalesce("top1_area", F.lit("")) != F.col("gold_area"), t["area_miss"]).otherwise(t["near"]))
    return rows.select("query_id", "gold_id", "gold_place_name", "gold_area", *[hit(k).alias(f"hit_at_{k}") for k in fv.EVAL_KS],
                       F.col("best_final_rank").alias("best_hit_rank"), F.coalesce("recommended_top1", F.lit("")).alias("recommended_top1"),
                       F.coalesce("recommended_top3", F.lit("")).alias("recommended_top3"), why.alias("reason_estimate"))


def failure_cases(covered: DataFrame, recs: DataFrame, list_col="query_id") -> DataFrame:
    """Failure class per gold row from its ranks and the top row's features."""
    top = recs.filter("rank = 1").select(list_col, F.col("rec_name").alias("recommended_top1"), F.col("rec_type").alias("top1_type"),
                                         "type_match", "time_match", *[c for c in ["composite"] if c in recs.columns])
    if "composite" not in top.columns:
        top = top.withColumn("composite", F.lit(0.0))
    rows = covered.join(top, list_col, "left")
    kind = (F.when(F.col("in_top10"), "hit").when(~F.col("in_raw_top50"), "candidate_generation_gap")
            .when(F.col("type_match") < 0.5, "place_type_mismatch").when(F.col("time_match") < 0.5, "time_context_mismatch")
            .otherwise("ranking_demoted"))
    return rows.select("query_id", "gold_id", "gold_place_name", "gold_area", kind.alias("failure_category"), "best_raw_rank", "best_final_rank",
                       F.coalesce("recommended_top1", F.lit("")).alias("recommended_top1"), F.coalesce("top1_type", F.lit("")).alias("top1_type"),
                       F.coalesce("composite", F.lit(0.0)).alias("top1_composite"))


# --- grouped diagnosis ----------------------------------------------------------
def missing_by_group(rows: DataFrame, group: str) -> DataFrame:
    """Totals, misses and hits per group from one aggregate."""
    sums = rows.groupBy(group).agg(F.count("*").alias("total_gold_count"), F.count_if(~F.col("in_raw_top50")).alias("missing_count"),
                                   F.count_if(F.col("in_top10")).alias("hit_at_10_count"))
    missing = rows.agg(F.count_if(~F.col("in_raw_top50")).alias("m"))
    total = F.col("total_gold_count")
    covered = total - F.col("missing_count")
    ratio = F.col("missing_count") / total
    return sums.select(group, "total_gold_count", "missing_count", ratio.alias("missing_ratio_among_group"),
                       safe_ratio(F.col("missing_count"), missing.scalar()).alias("missing_ratio_among_missing"),
                       covered.alias("raw_coverage_count"), (covered / total).alias("raw_coverage_rate"), "hit_at_10_count",
                       (F.col("hit_at_10_count") / total).alias("hit_at_10_rate"),
                       F.when(ratio >= 0.75, fv.AREA_DIAGNOSIS[0]).otherwise(fv.AREA_DIAGNOSIS[1]).alias("diagnosis"))


def hit_vs_miss(rows: DataFrame, levels) -> DataFrame:
    """Overall and per level in one table by grouping sets.

    ``levels`` maps level name -> column; rows have in_raw_top50, in_top10,
    best_final_rank and raw_candidate_count.
    """
    cols = list(levels.values())
    sets = [[], *[[F.col(c)] for c in cols]]
    hit = lambda k: F.count_if(F.coalesce(F.col("best_final_rank") <= k, F.lit(False))).alias(f"hit_at_{k}_count")
    names = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(n)) for n, c in levels.items()], F.lit("overall"))
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols], F.lit("ALL"))
    grouped = rows.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        names.alias("group_level"), value.alias("group_value"), F.count("*").alias("query_count"),
        F.count_if("in_raw_top50").alias("raw_covered_count"), *[hit(k) for k in fv.EVAL_KS],
        F.avg("raw_candidate_count").alias("avg_raw_candidate_count"))
    n = F.col("query_count")
    cover, rate = F.col("raw_covered_count") / n, F.col("hit_at_10_count") / n
    return grouped.select(
        "group_level", "group_value", "query_count", "raw_covered_count", (n - F.col("raw_covered_count")).alias("raw_missing_count"),
        cover.alias("raw_coverage_rate"), *[f"hit_at_{k}_count" for k in fv.EVAL_KS], rate.alias("hit_at_10_rate"), "avg_raw_candidate_count",
        F.when(cover < 0.3, fv.GROUP_DIAGNOSIS[0]).when(rate < cover, fv.GROUP_DIAGNOSIS[1]).otherwise(fv.GROUP_DIAGNOSIS[2]).alias("diagnosis"))


def diagnosis_summary(rows: DataFrame, groups, n: int = 10) -> DataFrame:
    """Overall metrics, then the n worst groups per grouping."""
    total = F.count("*").cast("double")
    stats = {"total_queries": F.count("*"), "raw_candidate_missing_queries": F.count_if(~F.col("in_raw_top50")),
             "raw_candidate_recall_at_50": F.count_if("in_raw_top50"), "optimized_hit_at_10": F.count_if("in_top10")}
    items = F.array(*[F.struct(F.lit("overall").alias("diagnosis_category"), F.lit(m).alias("metric"), c.alias("value"),
                               safe_ratio(c, total).alias("ratio")) for m, c in stats.items()])
    parts = [rows.agg(items.alias("_i")).select(F.inline("_i"))]
    for g in groups:
        worst = missing_by_group(rows, g).orderBy(F.desc("missing_count"), F.desc("total_gold_count"), g).limit(n)
        parts.append(worst.select(F.lit(f"missing_by_{g}").alias("diagnosis_category"), F.col(g).alias("metric"),
                                  F.col("missing_count").alias("value"), F.col("missing_ratio_among_group").alias("ratio")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def feature_contribution(rows: DataFrame, features, hit="is_hit", weight: str | None = None) -> DataFrame:
    """Per feature: non-zero count and ratio, mean, max, sum, correlation with
    hits, comment. One aggregate pass; sums are weighted when one row stands
    for several (the rows of a shared list)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(hit).cast("double")
    aggs = [F.sum(w).alias("n"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.sum(F.when(x != 0, w).otherwise(0.0)).alias(f"nz_{f}"), F.sum(w * x).alias(f"sx_{f}"), F.sum(w * x * x).alias(f"sxx_{f}"),
                 F.sum(w * x * y).alias(f"sxy_{f}"), F.max(x).alias(f"mx_{f}")]
    wide = rows.agg(*aggs)
    n, sy, syy = F.col("n"), F.col("sy"), F.col("syy")
    items = []
    for f in features:
        sx, sxx, sxy = F.col(f"sx_{f}"), F.col(f"sxx_{f}"), F.col(f"sxy_{f}")
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        flat = (vx <= 1e-9 * F.greatest(n * sxx, F.lit(1e-300))) | (vy <= 1e-9 * F.greatest(n * syy, F.lit(1e-300)))
        corr = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))), F.lit(0.0)))
        nz = F.col(f"nz_{f}")
        comment = F.when(corr > 0.05, fv.CONTRIBUTION_COMMENTS[0]).when(nz == 0, fv.CONTRIBUTION_COMMENTS[1]).otherwise(fv.CONTRIBUTION_COMMENTS[2])
        items.append(F.struct(F.lit(f).alias("feature_name"), nz.cast("long").alias("non_zero_count"), safe_ratio(nz, n).alias("non_zero_ratio"),
                              safe_ratio(sx, n).alias("mean_bonus"), F.col(f"mx_{f}").alias("max_bonus"), sx.alias("total_bonus"),
                              corr.alias("correlation_with_hit"), comment.alias("comment")))
    return wide.select(F.inline(F.array(*items)))


# --- before and after -------------------------------------------------------------
def relative_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(1.0)).otherwise((after - before) / F.abs(before))


def interpretation(metric: Column, before: Column, after: Column) -> Column:
    delta = after - before
    return (F.when(F.abs(delta) < 1e-12, F.concat(metric, F.lit(" did not change under the improved candidate pool.")))
            .otherwise(F.concat(metric, F.lit(" "), F.when(delta > 0, "increased").otherwise("decreased"), F.lit(" by "),
                                F.format_string("%.4f", delta), F.lit(" after alias-based candidate expansion."))))


def before_after(before: DataFrame, after: DataFrame, key="metric", value="value") -> DataFrame:
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    x, y = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return b.join(a, key, "full").select(key, x.alias("before"), y.alias("after"), (y - x).alias("absolute_change"),
                                         relative_change(x, y).alias("relative_change"), interpretation(F.col(key), x, y).alias("interpretation"))


def coverage_stats(covered: DataFrame, raw_sizes: DataFrame, weight: str | None = None) -> DataFrame:
    """Long (metric, value) table of recall, misses, demotions and pool sizes.

    ``raw_sizes`` has one row per query with its pool size in ``rows``, or one row
    per pool with its number of queries in the column that ``weight`` names.
    """
    times = F.col(weight) if weight else F.lit(1)
    n = F.sum(times)
    c = covered.agg(F.avg(F.col("in_raw_top50").cast("double")).alias("raw_recall_50"),
                    F.count_if(~F.col("in_raw_top50")).cast("double").alias("missing_query_count"),
                    F.count_if(F.col("in_raw_top50") & ~F.col("in_top10")).cast("double").alias("raw_present_not_top10_count"),
                    F.avg(F.col("in_top10").cast("double")).alias("hit_10_rate"))
    s = raw_sizes.agg(F.sum(F.col("rows") * times).cast("double").alias("raw_candidate_rows"), F.coalesce(n, F.lit(0)).cast("double").alias("raw_query_count"),
                      F.try_divide(F.sum(F.col("rows") * times), n).alias("avg_raw_candidates_per_query"))
    long = lambda d: d.unpivot([], d.columns, "metric", "value")
    return long(c).unionByName(long(s))


def missing_before_after(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    cols = ["total_gold_count", "missing_count", "raw_coverage_rate", "hit_at_10_rate"]
    b = before.select(group, *[F.col(c).alias(f"{c}_before") for c in cols])
    a = after.select(group, *[F.col(c).alias(f"{c}_after") for c in cols])
    rows = b.join(a, group, "full").na.fill(0)
    delta = {f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in cols[1:]}
    rows = rows.withColumns(delta)
    d = F.col("missing_count_change")
    text = (F.when(d < 0, F.concat(F.col(group), F.lit(": missing decreased by "), F.abs(d).cast("string"), F.lit(".")))
            .when(d == 0, F.concat(F.col(group), F.lit(": missing unchanged.")))
            .otherwise(F.concat(F.col(group), F.lit(": missing increased by "), d.cast("string"), F.lit("."))))
    return rows.withColumn("interpretation", text)


def improvement_summary(metrics: DataFrame, stats: DataFrame, chosen_metrics, chosen_stats) -> DataFrame:
    return metrics.filter(F.col("metric").isin(list(chosen_metrics))).unionByName(stats.filter(F.col("metric").isin(list(chosen_stats))))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("rows"))


def review_samples(hits: DataFrame, n: int, order) -> DataFrame:
    """First n hits and first n misses in the stated order."""
    return first_per(hits, ["hit_at_1"], order, n, "case_no")


# --- dashboards -------------------------------------------------------------------
def query_detail(gold: DataFrame, covered: DataFrame, hits: DataFrame) -> DataFrame:
    """Gold with its coverage and hit rows (left joins)."""
    c = covered.select("query_id", "gold_id", "raw_candidate_count", "in_raw_top50", "best_raw_rank", "in_top10", "coverage_status")
    h = hits.select("query_id", "gold_id", *[f"hit_at_{k}" for k in fv.EVAL_KS], "best_hit_rank", "recommended_top1", "reason_estimate")
    return gold.join(c, ["query_id", "gold_id"], "left").join(h, ["query_id", "gold_id"], "left")
