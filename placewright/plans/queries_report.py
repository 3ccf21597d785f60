"""Aliases, ablations, deltas, profiles, similarity and forecasts."""

from __future__ import annotations

from placewright.plans.oracle import FINAL_SCORE, key, metrics_sql
from placewright.plans.queries import *  # noqa: F403
from placewright.session import cut_lineage

_FF = ["area_match", "type_match", "time_match", "target_match", "footfall", "worker", "transit", "market", "welfare", "context_match", "style", "rank_score", "diversity"]


@query("final_features", f"SELECT sig, raw_rank, {', '.join(f'round({c}, 6) AS {c}' for c in _FF)} FROM r_final")
def final_features(spark, sf):
    return pipe.final_base(spark, sf).select("sig", "raw_rank", *R6(*_FF))


_CTXW = fv.FINAL_MODEL_WEIGHTS["profile"]


def _final_recs(spark, sf, weight=0.0):
    rows = rank.area_or_all(pipe.final_base(spark, sf), areas=roles.AREAS).withColumn("base_final", rank.final_score(_CTXW))
    return rank.diverse_rerank(rows, ("sig",), 10, weight)


@query("final_rerank", f"""SELECT sig, raw_rank, row_number() OVER (PARTITION BY sig ORDER BY s DESC, base_score DESC, raw_rank) AS rank, round(s, 6) AS score FROM (
 SELECT *, {FINAL_SCORE(_CTXW)} AS s FROM r_final) QUALIFY rank <= 10""")
def final_rerank(spark, sf):
    """Diversity weight 0: the greedy form must equal the plain top k."""
    return _final_recs(spark, sf).select("sig", "raw_rank", "rank", "score")


def _diverse_sql(weight, k=10):
    """The greedy steps, unrolled: each takes the best of what is left under the penalties of the picks before."""
    steps = [f"c AS MATERIALIZED (SELECT sig, raw_rank, rec_type, rec_area, s, row_number() OVER (PARTITION BY sig ORDER BY s DESC, base_score DESC, raw_rank) AS pos FROM (SELECT *, {FINAL_SCORE(_CTXW)} AS s FROM r_final))",
             "d0 AS MATERIALIZED (SELECT sig, 0 AS rank, raw_rank, rec_type, rec_area, s AS adj FROM c WHERE false)"]
    for r in range(1, k + 1):
        d = f"d{r - 1}"
        steps.append(f"""d{r} AS MATERIALIZED (SELECT * FROM {d} UNION ALL SELECT sig, {r}, raw_rank, rec_type, rec_area, adj FROM (
 SELECT c.*, s - {weight} * (coalesce(t.n, 0)::DOUBLE * 0.70 + greatest(0.0, coalesce(a.n, 0)::DOUBLE - 2.0) * 0.30) AS adj FROM c
 LEFT JOIN (SELECT sig, rec_type, count(*) AS n FROM {d} GROUP BY sig, rec_type) t USING (sig, rec_type) LEFT JOIN (SELECT sig, rec_area, count(*) AS n FROM {d} GROUP BY sig, rec_area) a USING (sig, rec_area)
 WHERE NOT EXISTS (SELECT 1 FROM {d} x WHERE x.sig = c.sig AND x.raw_rank = c.raw_rank) QUALIFY row_number() OVER (PARTITION BY sig ORDER BY adj DESC, pos) = 1))""")
    return f"WITH {', '.join(steps)} SELECT sig, raw_rank, rank, rec_type, round(adj, 6) AS score FROM d{k}"


@query("diverse_rerank", _diverse_sql("0.10"))
def diverse_rerank(spark, sf):
    return _final_recs(spark, sf, 0.10).select("sig", "raw_rank", "rank", "rec_type", "score")


@query("similarity_at_10", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY s DESC, base_score DESC, raw_rank) AS rank FROM (SELECT *, {FINAL_SCORE(_CTXW)} AS s FROM r_final) QUALIFY rank <= 10)
SELECT place_type, count(*) AS evaluated_rows, round(avg(area_match), 6) AS area_10, round(avg(type_match), 6) AS type_10, round(avg(time_match), 6) AS time_10,
 round(avg(context_match), 6) AS context_10, round(avg(target_match), 6) AS target_10 FROM t GROUP BY place_type""")
def similarity_at_10(spark, sf):
    rows = ev.similarity_at(_final_recs(spark, sf), ["place_type"])
    return rows.select("place_type", "evaluated_rows", *R6("area_10", "type_10", "time_10", "context_10", "target_10"))


@query("failure_classes", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY s DESC, base_score DESC, raw_rank) AS rank FROM (SELECT *, {FINAL_SCORE(_CTXW)} AS s FROM r_final) QUALIFY rank <= 10),
 f AS (SELECT g.gold_id, min(l.rank) AS bf FROM r_goldsig g JOIN t l ON l.sig = g.sig AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name))
  AND (g.area = '' OR g.area = l.rec_area) GROUP BY g.gold_id)
SELECT c.gold_id, CASE WHEN coalesce(bf <= 10, false) THEN 'hit' WHEN NOT in_raw_top50 THEN 'candidate_generation_gap' WHEN t.type_match < 0.5 THEN 'place_type_mismatch'
 WHEN t.time_match < 0.5 THEN 'time_context_mismatch' ELSE 'ranking_demoted' END AS failure_category FROM r_coverage c LEFT JOIN f USING (gold_id)
 LEFT JOIN t ON t.sig = c.sig AND t.rank = 1""")
def failure_classes(spark, sf):
    recs = _final_recs(spark, sf)
    covered = diag.coverage(pipe.gold(spark, sf), pipe.lists(spark, sf), recs, "sig", areas=roles.AREAS)
    return diag.failure_cases(covered, recs, "sig").select("gold_id", "failure_category")


@query("baseline_top10", "SELECT pool_id, base AS rank, rec_name, rec_area, rec_type, round(base_score, 4) AS score FROM r_ranked WHERE base <= 10")
def baseline_top10(spark, sf):
    """Top ten of every pool by score alone."""
    rows = cand.baseline_recommend(pipe.candidates(spark, sf), 10)
    return rows.select("pool_id", "rank", "rec_name", "rec_area", "rec_type", F.round("base_score", 4).alias("score"))


def _rule_sql(text):
    scores = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{p}') THEN {hi} ELSE {lo} END AS {n}" for n, p, hi, lo in fv.DISPLAY_SCORE_RULES)
    labels = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{p}') THEN '{n}' END" for n, p in fv.FEATURE_LABEL_RULES)
    return f"{scores}, list_filter([{labels}], lambda x: x IS NOT NULL) AS hit"


@query("display_rules", f"""SELECT place_id, {', '.join(n for n, *_ in fv.DISPLAY_SCORE_RULES)}, CASE WHEN len(hit) = 0 THEN '{'|'.join(fv.FEATURE_LABEL_OTHER)}' ELSE array_to_string(hit[1:4], '|') END AS labels
 FROM (SELECT place_id, {_rule_sql("kind || ' ' || name")} FROM r_places)""")
def display_rules(spark, sf):
    """Display scores and feature labels by keyword rules."""
    text = F.concat_ws(" ", "kind", "name")
    return roles.places(spark, sf).select("place_id", *[c.alias(n) for n, c in routes.display_scores(text).items()], F.array_join(routes.feature_labels(text), "|").alias("labels"))


@query("semantic_similarity", "SELECT sig, raw_rank, round(semantic, 6) AS semantic, round(composite, 6) AS composite FROM r_whole")
def semantic_similarity(spark, sf):
    return pipe.final(spark, sf).select("sig", "raw_rank", *R6("semantic", "composite"))


@query("actor_profile", "SELECT actor, dim, key, round(p, 6) AS p FROM r_profile")
def actor_profile(spark, sf):
    return rank.actor_profiles(pipe.asked(spark, sf)).select("actor", "dim", "key", *R6("p"))


@query("actor_profile_text", """SELECT actor, dim, string_agg(key || ':' || printf('%.3f', p), '; ' ORDER BY p DESC, key) AS top FROM (
 SELECT * FROM r_profile QUALIFY row_number() OVER (PARTITION BY actor, dim ORDER BY p DESC, key) <= 4) GROUP BY actor, dim""")
def actor_profile_text(spark, sf):
    return rank.top_shares_text(rank.actor_profiles(pipe.asked(spark, sf)))


@query("actor_profile_priors", f"""
WITH s AS (SELECT CASE s_suppkey % 7 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' WHEN 4 THEN 'MACHINERY' WHEN 5 THEN 'NEWCOMER' ELSE 'OUTSIDER' END AS actor,
  CASE s_nationkey % 4 WHEN 0 THEN 'subway' WHEN 1 THEN 'market' WHEN 2 THEN 'park' ELSE 'senior_friendly' END AS key FROM supplier),
 pr AS (SELECT actor, 'category' AS dim, key, count(*) / sum(count(*)) OVER (PARTITION BY actor)::DOUBLE AS prior FROM s GROUP BY actor, key)
SELECT actor, dim, key, round(CASE WHEN actor IN (SELECT actor FROM r_profile) THEN greatest(coalesce(p, 0.0), {fv.PRIOR_DISCOUNT} * coalesce(prior, 0.0)) ELSE prior END, 6) AS p
FROM r_profile FULL JOIN pr USING (actor, dim, key)""")
def actor_profile_priors(spark, sf):
    """Observed shares with discounted priors; actors without history keep their priors whole."""
    return rank.actor_profiles(pipe.asked(spark, sf), roles.priors(spark, sf)).select("actor", "dim", "key", *R6("p"))


_TRACED = ["baseline", "type_weighted", "combined"]


@query("recommendation_trace", f"""
WITH b AS (SELECT model, g.query_id, min(rank) AS rank FROM r_goldsig g JOIN r_variants_ranked l ON l.sig = g.sig AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name)) AND (g.area = '' OR g.area = l.rec_area)
  GROUP BY model, g.query_id),
 q AS (SELECT DISTINCT query_id, actor, sig FROM r_goldsig),
 turned AS (SELECT query_id, actor FROM q JOIN (SELECT query_id FROM b WHERE model = 'combined' EXCEPT SELECT query_id FROM b WHERE model = 'baseline') USING (query_id)
   QUALIFY row_number() OVER (PARTITION BY actor ORDER BY query_id) = 1),
 s AS (SELECT query_id, actor, 0 AS k, actor AS o FROM q QUALIFY row_number() OVER (PARTITION BY actor ORDER BY query_id) <= 1
  UNION ALL (SELECT query_id, actor, 1, '' FROM turned ORDER BY query_id LIMIT 1) UNION ALL (SELECT query_id, actor, 2, '' FROM q ORDER BY query_id LIMIT 9)),
 pick AS (SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k, o) = 1) ORDER BY k, o, query_id LIMIT 8)
SELECT query_id, actor, ['head', 'miss_to_hit', 'fill'][k + 1] AS reason, {', '.join(f"(SELECT rank FROM b WHERE model = '{m}' AND b.query_id = pick.query_id) AS {m}_rank" for m in _TRACED)},
 {', '.join(f"(SELECT string_agg(rec_name, ' | ' ORDER BY rank) FROM r_variants_ranked v WHERE model = '{m}' AND v.sig = q.sig) AS {m}_places" for m in _TRACED)}
FROM pick JOIN q USING (query_id, actor)""")
def recommendation_trace(spark, sf):
    """First query of each actor, the first miss that the combined model turns into a hit, and fillers: eight in all, with ranks and names by model."""
    recs, gold = pipe.variants(spark, sf), pipe.gold(spark, sf)
    found = diag.best_ranks(gold, recs, "rank", "rank", "sig", by=["model"], areas=roles.AREAS).groupBy("model", "query_id").agg(F.min("rank").alias("rank"))
    of = lambda m: found.filter(F.col("model") == m).select("query_id", "rank")
    actors = gold.select("query_id", "actor").distinct()
    samples = ev.trace_sample(actors, ev.transitions(of("baseline"), of("combined"), actors), 1, 8)
    return ev.trace(recs, gold, _TRACED, samples, list_col="sig", areas=roles.AREAS).select("query_id", "actor", "reason", *[f"{m}_rank" for m in _TRACED], *[f"{m}_places" for m in _TRACED])


@query("tfidf_similarity", f"""
WITH n AS (SELECT count(*) AS nb FROM benchmark), pr AS (SELECT doc_id, 'd' || doc_id AS l, 'b' || item_id AS r, text AS lt, bt AS rt FROM (SELECT d.*, b.item_id, b.text AS bt FROM documents d, n
  JOIN (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, * FROM benchmark) b ON b.i = doc_id % nb)),
 docs AS (SELECT DISTINCT l AS doc, lt AS t FROM pr UNION SELECT DISTINCT r, rt FROM pr),
 tok AS (SELECT doc, unnest(list_filter(list_transform(regexp_split_to_array(t, '[;,/|()\\s]+'), lambda x: {key('x')}), lambda x: length(x) >= 2)) AS token FROM docs),
 tf AS (SELECT doc, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc) AS len FROM tok GROUP BY doc, token),
 idf AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)::DOUBLE) + 1.0 AS idf FROM tf GROUP BY token),
 v AS (SELECT doc, tf.token, c / len::DOUBLE * idf AS w FROM tf JOIN idf USING (token)), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc),
 dot AS (SELECT doc_id, sum(a.w * b.w) AS dot FROM pr JOIN v a ON a.doc = l JOIN v b ON b.doc = r AND b.token = a.token GROUP BY doc_id)
SELECT pr.doc_id, round(coalesce(dot / (x.norm * y.norm), 0.0), 5) AS semantic FROM pr LEFT JOIN dot USING (doc_id) LEFT JOIN nm x ON x.doc = l LEFT JOIN nm y ON y.doc = r""")
def tfidf_similarity(spark, sf):
    """Each document against one benchmark item; the corpus is all texts in use."""
    d, b = roles.table(spark, sf, "documents"), roles.table(spark, sf, "benchmark")
    items = shaping.number_rows(b, ["item_id"], name="n").withColumn("i", F.col("n") - 1)
    size = b.agg(F.count("*").alias("n"))
    pairs = d.withColumn("i", F.col("doc_id") % size.scalar()).join(items.select("i", "item_id"), "i").select(
        "doc_id", F.concat(F.lit("d"), "doc_id").alias("left_doc"), F.concat(F.lit("b"), "item_id").alias("right_doc"))
    # Read by the frequencies and by the vectors: tokens are made once, and written as blocks of counted tokens.
    left = cut_lineage(rank.token_blocks(d.select(F.concat(F.lit("d"), "doc_id").alias("doc"), rank.document_tokens("text").alias("tokens"))))
    used = pairs.select(F.col("right_doc").alias("doc")).distinct()
    right = b.select(F.concat(F.lit("b"), "item_id").alias("doc"), rank.document_tokens("text").alias("tokens"), F.lit(1).alias("copies")).join(used, "doc", "left_semi")
    idf = rank.token_idf(left.select("tokens", "counts", "copies").unionByName(right.select("tokens", "copies"), allowMissingColumns=True))
    sims = rank.pair_cosine(pairs, rank.doc_vectors(left, idf), rank.doc_vectors(right, idf))
    return pairs.join(sims, ["left_doc", "right_doc"]).select("doc_id", F.round("semantic", 5).alias("semantic"))


# --- aliases ------------------------------------------------------------------------------
_ALIAS = """al AS (SELECT DISTINCT p_name AS cn, string_split(p_name, ' ')[2] AS an, p_brand AS area FROM part),
 ed AS (SELECT DISTINCT area, replace(cn, ' ', '') AS f, an AS t FROM al UNION SELECT DISTINCT area, an, replace(cn, ' ', '') FROM al)"""


@query("alias_match", f"""
WITH {_ALIAS}, ok AS MATERIALIZED (SELECT area, f, t FROM ed), gx AS (SELECT gold_id, sig, area, replace(place_name, ' ', '') AS k FROM r_goldsig), rx AS (SELECT DISTINCT sig, rank, rec_area, replace(rec_name, ' ', '') AS k FROM r_combined),
 base AS MATERIALIZED (SELECT gold_id, rank, g.k AS gk, r.k AS rk, CASE WHEN g.k = r.k THEN 'exact' WHEN contains(g.k, r.k) OR contains(r.k, g.k) THEN 'partial' END AS m, r.rec_area AS a FROM gx g JOIN rx r ON r.sig = g.sig AND (g.area = '' OR g.area = r.rec_area)),
 names AS MATERIALIZED (SELECT DISTINCT gk, rk, a FROM base WHERE m IS DISTINCT FROM 'exact'),
 gt AS MATERIALIZED (SELECT gk, rk, a, t FROM names JOIN ok ON f = gk AND area = a),
 ah AS MATERIALIZED (SELECT DISTINCT gk, rk, a FROM gt JOIN ok y ON y.f = rk AND y.area = a AND y.t = gt.t)
SELECT gold_id, rank, method FROM (SELECT gold_id, rank, CASE WHEN m = 'exact' THEN 'exact' WHEN ah.gk IS NOT NULL THEN 'alias' ELSE m END AS method FROM base LEFT JOIN ah USING (gk, rk, a))
WHERE method IS NOT NULL""")
def alias_match(spark, sf):
    recs = pipe.variants(spark, sf, "combined")
    g, r = match.prepare_gold(pipe.gold(spark, sf), "sig", roles.AREAS), match.prepare_recs(recs, "sig", areas=roles.AREAS)
    pairs = match.match_pairs(g, r, pipe.alias_table(spark, sf))
    return pairs.select("gold_id", "rank", "method")


@query("alias_table", f"""WITH {_ALIAS} SELECT replace(cn, ' ', '') AS canonical_key, an AS alias_key, area AS std_area,
 'alias:' || lower(replace(area, '#', '')) || ':' || replace(cn, ' ', '') AS place_id FROM al""")
def alias_table(spark, sf):
    return pipe.alias_table(spark, sf).select("canonical_key", "alias_key", "std_area", "place_id")


@query("alias_pool")
def alias_pool(spark, sf):
    return pipe.frozen(spark, sf, True).select("pool_id", "raw_rank", "rec_name", "rec_type", "base_score", "candidate_source")


@query("leave_one_type_out")
def leave_one_type_out(spark, sf):
    rows = ablation.leave_one_out(pipe.tuned(spark, sf, True), pipe.gold(spark, sf), fv.TUNED_REQUIRED[2], ["전통시장", "공원", "교통거점", "복지시설"], areas=roles.AREAS)
    return rows.select("ablation", *R6(*[c for c in rows.columns if c != "ablation"]))


#: Public sources under the reference's names, and the kind of place of each.
_PUBLIC = {"market": "market", "park": "park", "senior": "senior_friendly", "subway": "subway"}


@query("alias_audit")
def alias_audit(spark, sf):
    rows = shaping.number_rows(pipe.alias_table(spark, sf), ["canonical_key", "std_area"], name="alias_row_id")
    p = roles.places(spark, sf)
    keys = ablation.public_keys({source: (p.filter(F.col("kind") == kind), "name") for source, kind in _PUBLIC.items()})
    gold = roles.gold(spark, sf).select("query_id", "place_name")
    return ablation.classify_aliases(rows, gold, keys).groupBy("primary_class", "public_source_matches").agg(F.count("*").alias("aliases"), F.sum("gold_match_count").alias("gold_rows"))


@query("coverage_before_after")
def coverage_before_after(spark, sf):
    asked = pipe.asked(spark, sf).groupBy("pool_id").agg(F.count("*").alias("queries"))
    sizes = lambda a: pipe.frozen(spark, sf, a).groupBy("pool_id").agg(F.count("*").alias("rows")).join(asked, "pool_id")
    b, a = (diag.coverage_stats(pipe.covered(spark, sf, x), sizes(x), "queries") for x in (False, True))
    rows = diag.before_after(b, a)
    return rows.select("metric", *R6("before", "after", "absolute_change", "relative_change"), "interpretation")


# --- forecasts --------------------------------------------------------------------------------
_FORE = """
p AS (SELECT user_id, ts::DATE AS d, 'place ' || json_extract_string(props, '$.k') AS name, 'Brand#' || (json_extract_string(props, '$.k')::INT % 25 + 1) AS area,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS rank FROM events WHERE event_type = 'view' QUALIFY rank <= 5),
a AS (SELECT event_id, user_id, ts::DATE AS d, 'place ' || json_extract_string(props, '$.k') AS name, 'Brand#' || (json_extract_string(props, '$.k')::INT % 25 + 1) AS area FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.user_id, p.d, rank, a.event_id, CASE WHEN a.name = p.name OR contains(replace(p.name, ' ', ''), replace(a.name, ' ', '')) OR contains(replace(a.name, ' ', ''), replace(p.name, ' ', '')) THEN 3
  WHEN a.area = p.area THEN 1 ELSE 0 END AS rel, a.name = p.name AS same FROM p JOIN a ON a.user_id = p.user_id AND a.d BETWEEN p.d AND p.d + 7),
b AS (SELECT p.user_id, p.d, p.rank, coalesce(max(rel), 0) AS rel, arg_max(CASE WHEN rel = 3 THEN CASE WHEN same THEN 'exact_place_match' ELSE 'alias_match' END WHEN rel = 1 THEN 'same_district_place_type_match' ELSE 'no_match' END,
  (rel, -event_id)) AS kind FROM p LEFT JOIN m USING (user_id, d, rank) GROUP BY p.user_id, p.d, p.rank)"""


def _forecast(spark, sf):
    views = roles.visits(spark, sf).filter("place_type = 'view'").drop("place_type")
    listed = views.withColumn("list_id", F.concat_ws("|", "actor", F.col("visit_date").cast("string")))
    preds = shaping.first_per(listed, ["list_id"], ["visit_id"], 5, "rank").withColumn("target_date", F.col("visit_date"))
    actual = roles.visits(spark, sf).filter("place_type = 'purchase'").drop("place_type")
    return preds, actual


@query("forecast_match", f"WITH {_FORE} SELECT user_id::VARCHAR || '|' || d::VARCHAR AS list_id, rank, coalesce(kind, 'no_match') AS match_type, rel AS relevance FROM b")
def forecast_match(spark, sf):
    preds, actual = _forecast(spark, sf)
    return fc.forecast_matches(preds, actual, 7, 5, roles.AREAS).select("list_id", "rank", "match_type", "relevance")


@query("forecast_metrics", f"""WITH {_FORE},
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY rel DESC) AS best FROM b),
 s AS (SELECT user_id, d, count_if(rel >= 2) AS direct, sum((pow(2.0, rel) - 1.0) / log2(rank + 1.0)) AS dcg, sum((pow(2.0, rel) - 1.0) / log2(best + 1.0)) AS idcg, min(CASE WHEN rel >= 2 THEN rank END) AS first FROM o GROUP BY user_id, d),
 c AS (SELECT l.user_id, l.d, count(*) AS n FROM (SELECT DISTINCT user_id, d FROM p) l JOIN a ON a.user_id = l.user_id AND a.d BETWEEN l.d AND l.d + 7 GROUP BY l.user_id, l.d)
SELECT s.user_id::VARCHAR || '|' || s.d::VARCHAR AS list_id, coalesce(n, 0) AS actual_count, (direct > 0)::INT::DOUBLE AS hit_at_k, direct / 5.0 AS precision_at_k,
 round(coalesce(CASE WHEN n > 0 THEN least(direct, n) / n::DOUBLE END, 0.0), 6) AS recall_at_k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg_at_k,
 round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM s LEFT JOIN c USING (user_id, d)""")
def forecast_metrics(spark, sf):
    preds, actual = _forecast(spark, sf)
    rows = fc.forecast_metrics(fc.forecast_matches(preds, actual, 7, 5, roles.AREAS), fc.actual_counts(preds, actual, 7), 5)
    return rows.select("list_id", "actual_count", "hit_at_k", "precision_at_k", *R6("recall_at_k", "ndcg_at_k", "mrr"))


@query("recency_penalty", """
WITH v AS (SELECT ts::DATE AS d, 'place ' || json_extract_string(props, '$.k') AS name, 'Brand#' || (json_extract_string(props, '$.k')::INT % 25 + 1) AS area FROM events),
 s AS (SELECT DISTINCT DATE '2024-01-20' + (user_id % 20)::INT AS day, 'place ' || json_extract_string(props, '$.k') AS name, 'Brand#' || (json_extract_string(props, '$.k')::INT % 25 + 1) AS area FROM events),
 a AS (SELECT day, s.name, s.area, sum(CASE WHEN v.d BETWEEN day - 7 AND day THEN 0.50 WHEN v.d BETWEEN day - 30 AND day THEN 0.30 ELSE 0.12 END) AS x FROM s JOIN v ON v.name = s.name GROUP BY day, s.name, s.area),
 b AS (SELECT day, s.name, s.area, sum(0.10) AS y FROM s JOIN v ON v.area = s.area AND v.name <> s.name AND v.d BETWEEN day - 30 AND day GROUP BY day, s.name, s.area)
SELECT day::VARCHAR AS day, s.name AS place_name, s.area, round(-(coalesce(x, 0.0) + coalesce(y, 0.0)), 2) AS visit_penalty FROM s LEFT JOIN a USING (day, name, area) LEFT JOIN b USING (day, name, area)""")
def recency_penalty(spark, sf):
    v = roles.visits(spark, sf)
    stops = v.select(F.expr("date_add(DATE '2024-01-20', cast(actor AS int) % 20)").alias("day"), "place_name", "area")
    rows = routes.recency_penalty(stops, v)
    return rows.select(F.col("day").cast("string").alias("day"), "place_name", "area", F.round("visit_penalty", 2).alias("visit_penalty"))

