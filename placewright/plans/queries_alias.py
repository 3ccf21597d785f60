"""Alias-expanded pools: what they change, and where the hits come from."""

from __future__ import annotations

from placewright.plans.oracle import CTE, TUNED_SCORE, metrics_sql
from placewright.plans.queries import *  # noqa: F403
from placewright.session import cut_lineage

_TYPES = ["공원", "교통거점", "전통시장"]
_FITS = ", ".join(f"('{q}', '{t}')" for q in ("교통거점", "전통시장", "공원", "복지시설", "정책현장") for t in _TYPES if t == q or t in fv.TYPE_COMPATIBILITY.get(q, []))

CTE["r_alias"] = """
SELECT DISTINCT p_name AS cn, string_split(p_name, ' ')[-1] AS an, p_brand AS area, CASE string_split(p_name, ' ')[-1] WHEN 'widget' THEN '공원' WHEN 'ring' THEN '교통거점' ELSE '전통시장' END AS alias_type,
 CASE string_split(p_name, ' ')[-1] WHEN 'widget' THEN 'park' WHEN 'ring' THEN 'subway' ELSE 'market' END AS kind, 'alias:' || lower(replace(p_brand, '#', '')) || ':' || replace(p_name, ' ', '') AS place_id FROM part"""
CTE["r_alias_rows"] = f"""
SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY alias_type, cn, an, place_id) AS pos FROM (
 SELECT p.pool_id, a.* FROM r_pools p JOIN (VALUES {_FITS}) f(q, t) ON f.q = p.query_type JOIN r_alias a ON a.area = p.area AND a.alias_type = f.t
 QUALIFY row_number() OVER (PARTITION BY p.pool_id, cn, a.area, kind ORDER BY alias_type, cn, an, place_id) = 1)
 QUALIFY pos <= 50"""
CTE["r_frozen_alias"] = """
SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY base_score DESC, CASE WHEN st = 0 THEN base ELSE 999999 END, rec_name, st, base) AS raw_rank FROM (
 SELECT * FROM (
  SELECT r.pool_id, rec_name, rec_area, rec_type, place_id, base_score, candidate_source, base, CASE WHEN base <= 10 THEN 0 ELSE 2 END AS st FROM r_ranked r WHERE base <= 51
  UNION ALL SELECT a.pool_id, cn, area, kind, place_id, round(CASE WHEN floor IS NULL THEN 0.45 ELSE greatest(0.01, floor - 0.0001) END, 4), 'alias_table:manual_alias_seed', pos, 1
   FROM r_alias_rows a LEFT JOIN r_floor f USING (pool_id))
 QUALIFY row_number() OVER (PARTITION BY pool_id, rec_name, rec_area, rec_type ORDER BY st, base) = 1)
 QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY st, base) <= 50"""
CTE["r_lists_alias"] = "SELECT s.*, rec_name, rec_area, rec_type, place_id, round(base_score, 4) AS base_score, candidate_source, raw_rank FROM r_sigs s JOIN r_frozen_alias f USING (pool_id)"
CTE["r_tuned_alias"] = CTE["r_tuned"].replace("r_lists", "r_lists_alias")
CTE["r_tuned_recs_alias"] = CTE["r_tuned_recs"].replace("r_tuned", "r_tuned_alias")
_MATCH = "(contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name)) AND (g.area = '' OR g.area = l.rec_area)"

# SQL of queries that the report module defines.
register("alias_pool", "SELECT pool_id, raw_rank, rec_name, rec_type, round(base_score, 4) AS base_score, candidate_source FROM r_frozen_alias")

_SETTINGS = ["public_only", "alias_expanded"]
_KM = [f"{a}_{k}" for a in ("p", "r", "ndcg") for k in fv.EVAL_KS]
_FLAT = lambda by: (f"fs AS (SELECT {by}, k, avg(p) AS p, avg(r) AS r, avg(n) AS n FROM detail GROUP BY {by}, k), fl AS (SELECT {by}, "
                    + ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {a}_{k}" for c, a in (("p", "p"), ("r", "r"), ("n", "ndcg")) for k in fv.EVAL_KS) + f" FROM fs GROUP BY {by})")


def _runs(spark, sf):
    """Recommendations and candidates of the runs with and without aliases, one column apart."""
    both = lambda stage: shaping.union_all([stage(spark, sf, a).withColumn("setting", F.lit(s)) for s, a in zip(_SETTINGS, (False, True))])
    return both(pipe.tuned_recs), both(pipe.tuned)


@query("alias_ablation", f"""WITH {metrics_sql("SELECT 'public_only' AS setting, * FROM r_tuned_recs UNION ALL BY NAME SELECT 'alias_expanded' AS setting, * FROM r_tuned_recs_alias", 'setting', "('public_only'), ('alias_expanded')")},
 {_FLAT('setting')}, raw AS (SELECT setting, count(DISTINCT gold_id) / (SELECT count(*) FROM r_goldsig)::DOUBLE AS raw_recall_50 FROM (
  SELECT 'public_only' AS setting, g.gold_id FROM r_goldsig g JOIN r_lists l ON l.sig = g.sig AND {_MATCH} UNION ALL SELECT 'alias_expanded', g.gold_id FROM r_goldsig g JOIN r_lists_alias l ON l.sig = g.sig AND {_MATCH}) GROUP BY setting),
 w AS (SELECT * FROM fl JOIN raw USING (setting)), u AS (UNPIVOT w ON {', '.join(_KM)}, raw_recall_50 INTO NAME metric VALUE v)
SELECT metric, round(max(CASE WHEN setting = 'public_only' THEN v END), 6) AS public_only, round(max(CASE WHEN setting = 'alias_expanded' THEN v END), 6) AS alias_expanded,
 round(max(CASE WHEN setting = 'alias_expanded' THEN v END) - max(CASE WHEN setting = 'public_only' THEN v END), 6) AS alias_only_contribution FROM u GROUP BY metric""")
def alias_ablation(spark, sf):
    """Metrics of the two settings, evaluated in one job, and what the aliases add."""
    recs, pool = _runs(spark, sf)
    gold = pipe.gold(spark, sf)
    flat = ev.flatten_summary(ev.summarise(ev.evaluate(gold, recs, list_col="sig", by="setting", by_values=_SETTINGS, areas=roles.AREAS), ["setting"]), "setting")
    total = gold.agg(F.count("*").alias("n"))
    found = diag.best_ranks(gold, pool, "raw_rank", "best", "sig", by=["setting"], areas=roles.AREAS).filter("best <= 50").groupBy("setting").agg((F.count("*") / total.scalar()).alias("raw_recall_50"))
    # A few rows, read once per setting: cut here, so that the evaluation runs once.
    long = cut_lineage(flat.join(found, "setting").unpivot("setting", [*_KM, "raw_recall_50"], "metric", "value"))
    of = lambda s: long.filter(F.col("setting") == s).select("metric", "value")
    rows = ablation.performance_split(of("public_only"), of("alias_expanded"))
    return rows.select("metric", *R6("public_only", "alias_expanded", "alias_only_contribution"))


@query("alias_contribution", f"""
WITH q AS (SELECT DISTINCT query_id, sig FROM r_goldsig),
 m AS (SELECT g.query_id, l.sig, rank, CASE WHEN l.rec_name = g.place_name THEN 'exact' ELSE 'partial' END AS method, rec_name, candidate_source FROM r_goldsig g JOIN r_tuned_recs_alias l ON l.sig = g.sig AND {_MATCH}
   QUALIFY row_number() OVER (PARTITION BY g.query_id ORDER BY rank, g.gold_id) = 1),
 ph AS (SELECT DISTINCT g.query_id FROM r_goldsig g JOIN r_tuned_recs l ON l.sig = g.sig AND {_MATCH})
SELECT q.query_id, rank IS NOT NULL AS after_hit, ph.query_id IS NOT NULL AS public_hit, CASE WHEN rank IS NULL THEN 'not_hit_after_expansion' WHEN ph.query_id IS NOT NULL THEN 'public_candidate_already_hit'
 WHEN starts_with(candidate_source, 'alias_table') THEN 'new_hit_from_alias_candidate' ELSE 'new_hit_from_public_candidate_or_matching_change' END AS contribution_category,
 rank AS matched_rank, coalesce(rec_name, '') AS matched_place_name, coalesce(candidate_source, '') AS matched_source, coalesce(method, '') AS matched_method
FROM q LEFT JOIN m USING (query_id) LEFT JOIN ph USING (query_id)""")
def alias_contribution(spark, sf):
    """Each query's first match among ten with its source, and whether it was hit without aliases."""
    gold = pipe.gold(spark, sf)
    hits = diag.best_ranks(gold, pipe.tuned_recs(spark, sf), "rank", "best", "sig", areas=roles.AREAS).select("query_id").distinct().withColumn("hit", F.lit(True))
    return ablation.alias_contribution(gold, pipe.tuned_recs(spark, sf, True), hits, "sig", areas=roles.AREAS)


CTE["r_cover_alias"] = CTE["r_cover"].replace("r_lists", "r_lists_alias").replace("r_tuned_recs", "r_tuned_recs_alias")
CTE["r_coverage_alias"] = CTE["r_coverage"].replace("r_cover", "r_cover_alias")


def _stats_sql(coverage, frozen, name):
    sizes = f"SELECT sum(n * q)::DOUBLE AS raw_candidate_rows, sum(q)::DOUBLE AS raw_query_count, sum(n * q)::DOUBLE / sum(q) AS avg_raw_candidates_per_query FROM (SELECT pool_id, count(*) AS n FROM {frozen} GROUP BY pool_id) JOIN (SELECT pool_id, count(*) AS q FROM r_asked GROUP BY pool_id) USING (pool_id)"
    cover = f"SELECT avg(in_raw_top50::INT) AS raw_recall_50, count_if(NOT in_raw_top50)::DOUBLE AS missing_query_count, count_if(in_raw_top50 AND NOT in_top10)::DOUBLE AS raw_present_not_top10_count, avg(in_top10::INT) AS hit_10_rate FROM {coverage}"
    return f"{name} AS (UNPIVOT (SELECT * FROM ({cover}), ({sizes})) ON COLUMNS(*) INTO NAME metric VALUE v)"


register("coverage_before_after", f"""WITH {_stats_sql('r_coverage', 'r_frozen', 'b')}, {_stats_sql('r_coverage_alias', 'r_frozen_alias', 'a')},
 x AS (SELECT metric, b.v AS before, a.v AS after FROM b JOIN a USING (metric))
SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS absolute_change,
 round(CASE WHEN before = 0 THEN CASE WHEN after = 0 THEN 0.0 ELSE 1.0 END ELSE (after - before) / abs(before) END, 6) AS relative_change,
 CASE WHEN abs(after - before) < 0.000000000001 THEN metric || ' did not change under the improved candidate pool.'
 ELSE metric || ' ' || CASE WHEN after > before THEN 'increased' ELSE 'decreased' END || ' by ' || printf('%.4f', after - before) || ' after alias-based candidate expansion.' END AS interpretation FROM x""")


def _missing_sql(coverage):
    return f"SELECT place_type, count(*) AS total, count_if(NOT in_raw_top50) AS missing, count_if(in_raw_top50) / count(*)::DOUBLE AS cov, count_if(in_top10) / count(*)::DOUBLE AS hit FROM {coverage} GROUP BY place_type"


@query("missing_before_after", f"""WITH b AS ({_missing_sql('r_coverage')}), a AS ({_missing_sql('r_coverage_alias')})
SELECT place_type, b.missing AS missing_count_before, a.missing AS missing_count_after, round(b.cov, 6) AS raw_coverage_rate_before, round(a.cov, 6) AS raw_coverage_rate_after,
 round(b.hit, 6) AS hit_at_10_rate_before, round(a.hit, 6) AS hit_at_10_rate_after, a.missing - b.missing AS missing_count_change, round(a.cov - b.cov, 6) AS raw_coverage_rate_change,
 round(a.hit - b.hit, 6) AS hit_at_10_rate_change, CASE WHEN a.missing < b.missing THEN place_type || ': missing decreased by ' || (b.missing - a.missing) || '.' WHEN a.missing = b.missing THEN place_type || ': missing unchanged.'
 ELSE place_type || ': missing increased by ' || (a.missing - b.missing) || '.' END AS interpretation FROM b JOIN a USING (place_type)""")
def missing_before_after(spark, sf):
    """Missed gold rows by type of place, without and with aliases."""
    b, a = (diag.missing_by_group(pipe.covered(spark, sf, x), "place_type") for x in (False, True))
    rows = diag.missing_before_after(b, a, "place_type")
    rates = [f"{c}_{s}" for s in ("before", "after", "change") for c in ("raw_coverage_rate", "hit_at_10_rate")]
    return rows.select("place_type", "missing_count_before", "missing_count_after", "missing_count_change", *R6(*rates), "interpretation")


_REMOVED = ["전통시장", "공원", "교통거점", "복지시설"]
_NAMES = ", ".join(f"('{n}')" for n in ["", *_REMOVED])
_WEIGHTS = ", ".join(f"{v} AS {n}" for n, v in zip(fv.TUNED_WEIGHTS, fv.TUNED_REQUIRED[2]))
register("leave_one_type_out", f"""
WITH tg AS MATERIALIZED (SELECT ablation, t.* FROM r_tuned_alias t, (VALUES {_NAMES}) a(ablation) WHERE ablation = '' OR NOT (starts_with(candidate_source, 'alias_table') AND place_type = ablation)),
 {metrics_sql(f"SELECT *, row_number() OVER (PARTITION BY ablation, sig ORDER BY score DESC, base_score DESC, raw_rank) AS rank FROM (SELECT *, {TUNED_SCORE} AS score FROM tg, (SELECT {_WEIGHTS}) WHERE area = rec_area) QUALIFY rank <= 10", 'ablation', _NAMES)},
 {_FLAT('ablation')}, rw AS (SELECT ablation, count(DISTINCT gold_id) / (SELECT count(*) FROM r_goldsig)::DOUBLE AS raw_recall_50 FROM r_goldsig g JOIN tg l ON l.sig = g.sig AND {_MATCH} GROUP BY ablation),
 x AS (SELECT ablation, raw_recall_50, p_1, r_10, ndcg_10 FROM fl JOIN rw USING (ablation)), b AS (SELECT * FROM x WHERE ablation = '')
SELECT x.ablation, {', '.join(f'round(x.{c}, 6) AS {c}' for c in ('raw_recall_50', 'p_1', 'r_10', 'ndcg_10'))}, {', '.join(f'round(x.{c} - b.{c}, 6) AS delta_{c}' for c in ('raw_recall_50', 'r_10', 'ndcg_10'))} FROM x, b""")


@query("template_greedy", "WITH " + f"""c AS (SELECT slot, age, place_type AS kind, name, coalesce(area, '') AS area, score FROM r_scored
   QUALIFY row_number() OVER (PARTITION BY slot, age, place_type ORDER BY raw_score DESC, name, place_id) <= 3),
 pl(template, step, slot, kind) AS (VALUES {', '.join(f"('{t}', {i}, '{slot}', '{kind}')" for t, steps in fv.ROUTE_TEMPLATES.items() for i, (_, slot, kind) in enumerate(steps, 1))}),
 o AS MATERIALIZED (SELECT age, template, step, name, c.area, score FROM pl JOIN c USING (slot, kind)),
 """ + ",\n ".join(f"""g{i} AS MATERIALIZED (SELECT {'' if i == 1 else 'g.* EXCLUDE (last, used), '}o.age AS age_{i}, o.template AS template_{i}, o.name AS stop_{i}, round(greatest(0.0, o.score - mv), 4) AS score_{i}, o.area AS last, {'[o.name]' if i == 1 else 'list_append(used, o.name)'} AS used
   FROM (SELECT o.*, {'0.0' if i == 1 else "CASE WHEN g.last <> '' AND o.area <> '' AND g.last <> o.area THEN 0.05 ELSE 0.0 END"} AS mv FROM o {'' if i == 1 else f'JOIN g{i - 1} g ON g.age_1 = o.age AND g.template_1 = o.template'} WHERE step = {i}) o
   {'' if i == 1 else f'JOIN g{i - 1} g ON g.age_1 = o.age AND g.template_1 = o.template'}
   QUALIFY row_number() OVER (PARTITION BY o.age, o.template ORDER BY {'' if i == 1 else 'list_contains(used, o.name)::INT, '}-greatest(0.0, o.score - mv), -o.score, o.name) = 1)""" for i in range(1, 5)) + """
SELECT age_1 AS age_group, template_1 AS template, stop_1, stop_2, stop_3, stop_4, score_1, score_2, score_3, score_4 FROM g4""")
def template_greedy(spark, sf):
    """Greedy fallback of each template: the next best unused place after the price of a move."""
    rows = templates.greedy_routes(templates.slot_lists(pipe.scored(spark, sf)))
    return rows.select("age_group", "template", *[F.col(f"c{i}.name").alias(f"stop_{i}") for i in range(1, 5)], *[F.col(f"a{i}").alias(f"score_{i}") for i in range(1, 5)])
