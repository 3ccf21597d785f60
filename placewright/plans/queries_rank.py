"""Scores, pools, matching, evaluation and search."""

from __future__ import annotations

from placewright.plans.oracle import FINAL_SCORE, MODELS, TUNED_SCORE, metrics_sql
from placewright.plans.queries import *  # noqa: F403


@query("place_score", """
SELECT place_id, name, place_type, area, slot, age AS age_group, round(ts, 6) AS time_score, round(asc_, 6) AS age_score, round(cs, 6) AS context_score,
 round(fs, 6) AS facility_score, round(ins, 6) AS interaction_score, score FROM r_scored""")
def place_score(spark, sf):
    return pipe.scored(spark, sf).select("place_id", "name", "place_type", "area", "slot", "age_group", *R6(*fv.SCORE_FEATURES), "score")


@query("place_recommend_top3", """
SELECT slot, age AS age_group, place_type, rank, place_id, name, area, score FROM (SELECT *, row_number() OVER (PARTITION BY slot, age, place_type
 ORDER BY raw_score DESC, name, place_id) AS rank FROM r_scored) WHERE rank <= 3""")
def place_recommend_top3(spark, sf):
    rows = scoring.recommend(roles.place_tables(spark, sf), None, 3, pipe.aux(spark, sf), known_areas=roles.KNOWN_AREAS, areas=roles.AREAS)
    return rows.select("slot", "age_group", "place_type", "rank", "place_id", "name", "area", "score")


@query("frozen_pool", "SELECT pool_id, raw_rank, rec_name, rec_area, rec_type, place_id, base_score, candidate_source FROM r_frozen")
def frozen_pool(spark, sf):
    return pipe.frozen(spark, sf).select("pool_id", "raw_rank", "rec_name", "rec_area", "rec_type", "place_id", "base_score", "candidate_source")


@query("variant_recommendations", """
SELECT model, sig, rank, rec_name, rec_area, rec_type, round(base_score, 4) AS base_score, area_bonus, type_bonus, time_bonus, context_bonus, target_bonus, score FROM r_variants_ranked""")
def variant_recommendations(spark, sf):
    rows = pipe.variants(spark, sf)
    return rows.select("model", "sig", "rank", "rec_name", "rec_area", "rec_type", "base_score", "area_bonus", "type_bonus", "time_bonus", "context_bonus", "target_bonus", "score")


@query("eval_detail", f"""WITH {metrics_sql('SELECT * FROM r_combined')}
SELECT query_id, k, round(p, 6) AS precision_at_k, round(r, 6) AS recall_at_k, round(n, 6) AS ndcg_at_k, hits, total_relevant, ids AS matched_gold_ids FROM detail""")
def eval_detail(spark, sf):
    recs = pipe.variants(spark, sf, "combined")
    rows = ev.evaluate(pipe.gold(spark, sf), recs, list_col="sig", areas=roles.AREAS)
    return rows.select("query_id", "k", *R6("precision_at_k", "recall_at_k", "ndcg_at_k"), "hits", "total_relevant", "matched_gold_ids")


@query("model_comparison", f"""WITH {metrics_sql('SELECT * FROM r_variants_ranked', 'model', MODELS)},
s AS (SELECT model, k, avg(p) AS p, avg(r) AS r, avg(n) AS n FROM detail GROUP BY model, k),
f AS (SELECT model, {', '.join(f"max(CASE WHEN k = {k} THEN {c} END) AS {a}_{k}" for c, a in (('p', 'p'), ('r', 'r'), ('n', 'ndcg')) for k in (1, 3, 5, 10))} FROM s GROUP BY model)
SELECT model, {', '.join(f"round({a}_{k}, 6) AS {a}_{k}" for a in ('p', 'r', 'ndcg') for k in (1, 3, 5, 10))},
 round(0.35 * ndcg_10 + 0.25 * p_1 + 0.20 * p_3 + 0.10 * p_5 + 0.10 * r_10, 6) AS objective FROM f""")
def model_comparison(spark, sf):
    recs = pipe.variants(spark, sf)
    rows = ev.evaluate(pipe.gold(spark, sf), recs, list_col="sig", by="model", by_values=fv.MODEL_VARIANTS, areas=roles.AREAS)
    flat = ev.flatten_summary(ev.summarise(rows, ["model"])).withColumn("objective", ev.objective())
    return flat.select("model", *R6(*[c for c in flat.columns if c != "model"]))


@query("tuned_features", """
SELECT sig, raw_rank, area_bonus, round(type_bonus, 6) AS type_bonus, time_bonus, round(context_bonus, 6) AS context_bonus, target_bonus, rank_bonus FROM r_tuned""")
def tuned_features(spark, sf):
    rows = pipe.tuned(spark, sf)
    return rows.select("sig", "raw_rank", "area_bonus", *R6("type_bonus"), "time_bonus", *R6("context_bonus"), "target_bonus", "rank_bonus")


@query("tuned_rerank", "SELECT sig, rank, rec_name, rec_type, raw_rank, score FROM r_tuned_recs")
def tuned_rerank(spark, sf):
    rows = pipe.tuned_recs(spark, sf)
    return rows.select("sig", "rank", "rec_name", "rec_type", "raw_rank", "score")


@query("split_evaluation", f"""WITH {metrics_sql('SELECT * FROM r_tuned_recs')},
t AS (SELECT d.*, split FROM detail d JOIN r_split USING (query_id) UNION ALL SELECT d.*, 'full' FROM detail d)
SELECT split, k, round(avg(p), 6) AS precision_at_k, round(avg(r), 6) AS recall_at_k, round(avg(n), 6) AS ndcg_at_k, count(*) AS query_count FROM t GROUP BY split, k""")
def split_evaluation(spark, sf):
    recs = pipe.tuned_recs(spark, sf)
    gold = pipe.gold(spark, sf)
    rows = ev.evaluate(gold, recs, list_col="sig", areas=roles.AREAS)
    out = ev.split_summaries(rows, ev.train_split(gold))
    return out.select("split", "k", *R6("precision_at_k", "recall_at_k", "ndcg_at_k"), "query_count")


TRIALS = 300


def trials_sql(names, grid, required, n_trials):
    lists = ", ".join(f"(SELECT unnest({[float(v) for v in g]}) AS {n}, unnest(range({len(g)})) AS i{i})" for i, (n, g) in enumerate(zip(names, grid)))
    stride, parts = 1, []
    for i in reversed(range(len(names))):
        parts.append(f"i{i} * {stride}")
        stride *= len(grid[i])
    req = ", ".join("(" + ", ".join(str(x) for x in [j, *row]) + ")" for j, row in enumerate(required, 1))
    cols = ", ".join(names)
    return f"""
 grid AS (SELECT {' + '.join(parts)} AS grid_id, {cols} FROM {lists}),
 pick AS (SELECT row_number() OVER (ORDER BY md5('42|' || grid_id::VARCHAR), grid_id) AS pos, {cols} FROM grid QUALIFY pos <= {n_trials}),
 every AS (SELECT * FROM (VALUES {req}) r(seq, {cols}) UNION ALL SELECT pos + {len(required)}, {cols} FROM pick),
 trials AS (SELECT row_number() OVER (ORDER BY seq) AS trial_id, * FROM (SELECT {cols}, min(seq) AS seq FROM every GROUP BY {cols}))"""


def _search_sql(tail):
    return f"""WITH {trials_sql(fv.TUNED_WEIGHTS, fv.TUNED_GRID, fv.TUNED_REQUIRED, TRIALS)},
 recs AS (SELECT *, row_number() OVER (PARTITION BY trial_id, sig ORDER BY score DESC, base_score DESC, raw_rank) AS rank FROM (
   SELECT trial_id, sig, raw_rank, rec_name, rec_area, base_score, {TUNED_SCORE} AS score FROM r_tuned, trials WHERE area = rec_area) QUALIFY rank <= 10),
 lab AS (SELECT g.query_id, g.sig, l.raw_rank, g.gold_id, g.relevance FROM r_goldsig g JOIN r_lists l ON l.sig = g.sig AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name))
   AND (g.area = '' OR g.area = l.rec_area) JOIN r_split s ON s.query_id = g.query_id AND s.split = 'train'
   QUALIFY row_number() OVER (PARTITION BY g.query_id, l.raw_rank ORDER BY g.gold_id) = 1),
 best AS (SELECT trial_id, query_id, gold_id, max(relevance) AS relevance, min(rank) AS rank FROM lab JOIN recs USING (sig, raw_rank) GROUP BY trial_id, query_id, gold_id),
 ideal AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos, count(*) OVER (PARTITION BY query_id) AS total FROM r_goldsig),
 ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
 st AS (SELECT query_id, k, max(total) AS total, sum(CASE WHEN pos <= k THEN (pow(2.0, relevance) - 1.0) / log2(pos + 1.0) ELSE 0.0 END) AS idcg FROM ideal, ks GROUP BY query_id, k),
 n AS (SELECT count(*)::DOUBLE AS n FROM r_split WHERE split = 'train'),
 m AS (SELECT trial_id, k, count(*) / k::DOUBLE AS p, sum(1.0 / total) AS r, sum((pow(2.0, relevance) - 1.0) / log2(rank + 1.0) / idcg) AS nd FROM best JOIN st USING (query_id)
   WHERE rank <= k GROUP BY trial_id, k),
 f AS (SELECT trial_id, {', '.join(f"coalesce(max(CASE WHEN k = {k} THEN {c} END), 0.0) / max(n) AS {a}_{k}" for k in (1, 3, 5, 10) for c, a in (('p', 'p'), ('r', 'r'), ('nd', 'ndcg')))}
   FROM trials LEFT JOIN m USING (trial_id), n GROUP BY trial_id),
 res AS (SELECT t.*, f.* EXCLUDE (trial_id), 0.35 * ndcg_10 + 0.25 * p_1 + 0.20 * p_3 + 0.10 * p_5 + 0.10 * r_10 AS objective FROM trials t JOIN f USING (trial_id))
 {tail}"""


def _search(spark, sf):
    features = pipe.tuned(spark, sf)
    gold = pipe.gold(spark, sf)
    trials = search.build_trials(spark, fv.TUNED_WEIGHTS, fv.TUNED_GRID, fv.TUNED_REQUIRED, "random", TRIALS)
    return search.search_weights(features, features, gold, ev.train_split(gold), trials, list_col="sig", areas=roles.AREAS)


_M = [f"{a}_{k}" for k in (1, 3, 5, 10) for a in ("p", "r", "ndcg")]


@query("weight_search", _search_sql(f"SELECT trial_id, {', '.join(fv.TUNED_WEIGHTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in [*_M, 'objective'])} FROM res"))
def weight_search(spark, sf):
    return _search(spark, sf).select("trial_id", *fv.TUNED_WEIGHTS, *R6(*_M, "objective"))


def _grid_sql(names, grid):
    """All combinations with their row number, last list fastest."""
    stride, parts, lists = 1, [], []
    for i in reversed(range(len(names))):
        parts.append(f"i{i} * {stride}")
        stride *= len(grid[i])
    for i, (n, g) in enumerate(zip(names, grid)):
        lists.append(f"(SELECT unnest({[float(v) for v in g]}) AS {n}, unnest(range({len(g)})) AS i{i})")
    return f"SELECT {' + '.join(parts)} AS grid_id, {', '.join(names)} FROM {', '.join(lists)}"


def _grid_means(features, names, grid, cols):
    """Every grid row with the mean score that its weights give the candidates."""
    means = features.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = search.grid_trials(features.sparkSession, names, grid).withColumn("m", means.agg(F.first(F.struct(*means.columns))).scalar())
    total = None
    for i, n in enumerate(names):
        term = F.col(n) * F.col(f"m.m{i}")
        total = term if total is None else total + term
    return rows.select("grid_id", *names, F.round(total, 6).alias("mean_score"))


@query("weight_grid", f"""WITH grid AS ({_grid_sql(fv.TUNED_WEIGHTS, fv.TUNED_GRID)}), m AS (SELECT {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(rank.TUNED_FEATURES))} FROM r_tuned)
SELECT grid_id, {', '.join(fv.TUNED_WEIGHTS)}, round({' + '.join(f'{n} * m{i}' for i, n in enumerate(fv.TUNED_WEIGHTS))}, 6) AS mean_score FROM grid, m""")
def weight_grid(spark, sf):
    """All 3 840 rows of the tuned grid."""
    return _grid_means(pipe.tuned(spark, sf), fv.TUNED_WEIGHTS, fv.TUNED_GRID, rank.TUNED_FEATURES)


@query("weight_search_best", _search_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS criterion, arg_max(trial_id, ({c}, -trial_id)) AS trial_id, round(max({c}), 6) AS value FROM res"
    for n, c in {"best_by_ndcg10": "ndcg_10", "best_by_p1": "p_1", "best_by_p3": "p_3", "best_by_objective": "objective"}.items())))
def weight_search_best(spark, sf):
    rows = search.best_trials(_search(spark, sf), {"best_by_ndcg10": "ndcg_10", "best_by_p1": "p_1", "best_by_p3": "p_3", "best_by_objective": "objective"})
    return rows.select("criterion", "trial_id", *R6("value"))


@query("raw_coverage", """SELECT query_id, gold_id, gold_place_name, gold_area, raw_candidate_count, in_raw_top50, in_raw_top100, best_raw_rank, in_top10, best_final_rank,
 coverage_status FROM r_coverage""")
def raw_coverage(spark, sf):
    return _coverage(spark, sf)[0].drop("sig", "place_type", "activity_type", "actor")


def _coverage(spark, sf):
    return pipe.coverage(spark, sf), pipe.tuned_recs(spark, sf), pipe.gold(spark, sf)


_H = fv.HIT_REASONS


@query("hit_analysis", f"""
SELECT c.query_id, c.gold_id, c.gold_place_name, c.gold_area, {', '.join(f'coalesce(best_final_rank <= {k}, false) AS hit_at_{k}' for k in (1, 3, 5, 10))},
 best_final_rank AS best_hit_rank, coalesce(t1, '') AS recommended_top1, coalesce(t3, '') AS recommended_top3,
 CASE WHEN best_final_rank <= 10 AND r.area_bonus > 0 THEN '{_H['area']}' WHEN best_final_rank <= 10 AND r.type_bonus > 0 THEN '{_H['type']}' WHEN best_final_rank <= 10 THEN '{_H['base']}'
 WHEN best_raw_rank IS NULL THEN '{_H['gap']}' WHEN best_raw_rank > 10 THEN '{_H['low']}' WHEN coalesce(a1, '') <> gold_area THEN '{_H['area_miss']}' ELSE '{_H['near']}' END AS reason_estimate
FROM r_coverage c LEFT JOIN (SELECT sig, max(CASE WHEN rank = 1 THEN rec_name END) AS t1, max(CASE WHEN rank = 1 THEN rec_area END) AS a1,
 string_agg(rec_name, '; ' ORDER BY rank) AS t3 FROM r_tuned_recs WHERE rank <= 3 GROUP BY sig) t USING (sig)
 LEFT JOIN r_tuned_recs r ON r.sig = c.sig AND r.rank = c.best_final_rank""")
def hit_analysis(spark, sf):
    covered, recs, _ = _coverage(spark, sf)
    return diag.hit_analysis(covered, recs, "sig")


@query("missing_by_area", f"""
SELECT gold_area, count(*) AS total_gold_count, count_if(NOT in_raw_top50) AS missing_count, round(count_if(NOT in_raw_top50) / count(*)::DOUBLE, 6) AS missing_ratio_among_group,
 round(count_if(NOT in_raw_top50) / (SELECT count_if(NOT in_raw_top50) FROM r_coverage)::DOUBLE, 6) AS missing_ratio_among_missing, count_if(in_raw_top50) AS raw_coverage_count,
 round(count_if(in_raw_top50) / count(*)::DOUBLE, 6) AS raw_coverage_rate, count_if(in_top10) AS hit_at_10_count, round(count_if(in_top10) / count(*)::DOUBLE, 6) AS hit_at_10_rate,
 CASE WHEN count_if(NOT in_raw_top50) / count(*)::DOUBLE >= 0.75 THEN '{fv.AREA_DIAGNOSIS[0]}' ELSE '{fv.AREA_DIAGNOSIS[1]}' END AS diagnosis FROM r_coverage GROUP BY gold_area""")
def missing_by_area(spark, sf):
    rows = diag.missing_by_group(_coverage(spark, sf)[0], "gold_area")
    return rows.select(*[F.round(c, 6).alias(c) if "ratio" in c or "rate" in c else c for c in rows.columns])


_LV = {"place_type": "place_type", "area": "gold_area", "activity_type": "activity_type"}


@query("hit_vs_miss", " UNION ALL ".join(
    f"""SELECT '{n}' AS group_level, {v} AS group_value, count(*) AS query_count, count_if(in_raw_top50) AS raw_covered_count, count_if(NOT in_raw_top50) AS raw_missing_count,
 round(count_if(in_raw_top50) / count(*)::DOUBLE, 6) AS raw_coverage_rate, {', '.join(f'count_if(coalesce(best_final_rank <= {k}, false)) AS hit_at_{k}_count' for k in (1, 3, 5, 10))},
 round(count_if(in_top10) / count(*)::DOUBLE, 6) AS hit_at_10_rate, round(avg(raw_candidate_count), 6) AS avg_raw_candidate_count,
 CASE WHEN count_if(in_raw_top50) / count(*)::DOUBLE < 0.3 THEN '{fv.GROUP_DIAGNOSIS[0]}' WHEN count_if(in_top10) < count_if(in_raw_top50) THEN '{fv.GROUP_DIAGNOSIS[1]}'
 ELSE '{fv.GROUP_DIAGNOSIS[2]}' END AS diagnosis FROM r_coverage {g}"""
    for n, v, g in [("overall", "'ALL'", ""), *[(n, c, f"GROUP BY {c}") for n, c in _LV.items()]]))
def hit_vs_miss(spark, sf):
    rows = diag.hit_vs_miss(_coverage(spark, sf)[0], _LV)
    return rows.select(*[F.round(c, 6).alias(c) if "rate" in c or "avg" in c else c for c in rows.columns])


@query("diagnosis_summary", f"""
WITH o AS (SELECT 'overall' AS diagnosis_category, unnest(['total_queries', 'raw_candidate_missing_queries', 'raw_candidate_recall_at_50', 'optimized_hit_at_10']) AS metric,
 unnest([count(*), count_if(NOT in_raw_top50), count_if(in_raw_top50), count_if(in_top10)]) AS value, count(*) AS n FROM r_coverage)
SELECT diagnosis_category, metric, value, round(value / n::DOUBLE, 6) AS ratio FROM o
UNION ALL (SELECT 'missing_by_place_type', place_type, count_if(NOT in_raw_top50) AS m, round(count_if(NOT in_raw_top50) / count(*)::DOUBLE, 6) FROM r_coverage GROUP BY place_type
 ORDER BY m DESC, count(*) DESC, place_type LIMIT 10)
UNION ALL (SELECT 'missing_by_gold_area', gold_area, count_if(NOT in_raw_top50) AS m, round(count_if(NOT in_raw_top50) / count(*)::DOUBLE, 6) FROM r_coverage GROUP BY gold_area
 ORDER BY m DESC, count(*) DESC, gold_area LIMIT 10)""")
def diagnosis_summary(spark, sf):
    rows = diag.diagnosis_summary(_coverage(spark, sf)[0], ["place_type", "gold_area"])
    return rows.select("diagnosis_category", "metric", "value", *R6("ratio"))


_F6 = ["area_bonus", "type_bonus", "time_bonus", "context_bonus", "target_bonus", "rank_bonus"]


@query("feature_contribution", f"""
WITH h AS (SELECT DISTINCT g.query_id, r.rank FROM r_goldsig g JOIN r_tuned_recs r ON r.sig = g.sig AND (contains(r.rec_name, g.place_name) OR contains(g.place_name, r.rec_name)) AND (g.area = '' OR g.area = r.rec_area)),
 t AS (SELECT r.*, (h.rank IS NOT NULL)::INT::DOUBLE AS hit FROM r_asked a JOIN r_tuned_recs r USING (sig) LEFT JOIN h ON h.query_id = a.query_id AND h.rank = r.rank),
 s AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature_name, count_if({f} <> 0) AS nz, count(*) AS n, avg({f}) AS mean_bonus, max({f}) AS max_bonus, sum({f}) AS total_bonus, "
                           f"CASE WHEN max({f}) = min({f}) OR max(hit) = min(hit) THEN 0.0 ELSE corr({f}, hit) END AS c FROM t" for f in _F6)})
SELECT feature_name, nz AS non_zero_count, round(nz / n::DOUBLE, 4) AS non_zero_ratio, round(mean_bonus, 4) AS mean_bonus, round(max_bonus, 4) AS max_bonus,
 round(total_bonus, 2) AS total_bonus, round(c, 4) AS correlation_with_hit,
 CASE WHEN c > 0.05 THEN '{fv.CONTRIBUTION_COMMENTS[0]}' WHEN nz = 0 THEN '{fv.CONTRIBUTION_COMMENTS[1]}' ELSE '{fv.CONTRIBUTION_COMMENTS[2]}' END AS comment FROM s""")
def feature_contribution(spark, sf):
    """Rows are (list row, hit or not) with the number of requests behind each."""
    recs = pipe.tuned_recs(spark, sf)
    gold = pipe.gold(spark, sf)
    pairs = match.match_pairs(match.prepare_gold(gold, "sig", roles.AREAS), match.prepare_recs(recs, "sig", areas=roles.AREAS))
    hits = pairs.select("query_id", "list_id", "rank").distinct().groupBy(F.col("list_id").alias("sig"), "rank").agg(F.count("*").alias("hits"))
    sizes = pipe.asked(spark, sf).groupBy("sig").agg(F.count("*").alias("queries"))
    rows = recs.join(sizes, "sig").join(hits, ["sig", "rank"], "left").na.fill(0, ["hits"])
    both = rows.withColumn("_b", F.explode(F.array(F.struct(F.lit(1.0).alias("is_hit"), F.col("hits").alias("w")),
                                                   F.struct(F.lit(0.0).alias("is_hit"), (F.col("queries") - F.col("hits")).alias("w"))))).select("*", "_b.*").filter("w > 0")
    out = diag.feature_contribution(both, _F6, "is_hit", "w")
    return out.select("feature_name", "non_zero_count", *R4("non_zero_ratio", "mean_bonus", "max_bonus"), F.round("total_bonus", 2).alias("total_bonus"),
                      *R4("correlation_with_hit"), "comment")
