"""The same queries as SQL over the given tables, written independently.

``SQL`` maps query name -> statement. Shared subqueries are named in ``CTE`` and
pulled in where a statement mentions them.
"""

from __future__ import annotations

import re

from placewright import fixed_values as fv
from placewright.plans.roles import CANDIDATE_POOL

CTE: dict[str, str] = {}
SQL: dict[str, str] = {}


def any_of(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def first_of(text, rules, default):
    return "CASE " + " ".join(f"WHEN {any_of(text, ws)} THEN '{n}'" for n, ws in rules) + f" ELSE '{default}' END"


def all_of(text, rules):
    arms = ", ".join(f"CASE WHEN {any_of(text, ws)} THEN '{n}' END" for n, ws in rules)
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


def case(col, table, other):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def bands(hour, kind, table, other):
    out = f"CASE WHEN {hour} IS NULL THEN 0.0 "
    for lo, hi, t in table:
        out += f"WHEN {hour} >= {lo} AND {hour} < {hi} THEN {case(kind, t, 0.0)} "
    return out + f"ELSE {case(kind, other, 0.0) if other else 0.0} END"


def key(text):
    return f"regexp_replace(lower(trim({text})), '[^0-9a-z가-힣]', '', 'g')"


def clamp(x):
    return f"least(greatest({x}, 0.0), 1.0)"


def build(body: str) -> str:
    """Statement with the shared subqueries it needs, and double literals."""
    names = list(CTE)
    used: set[str] = set()

    def visit(text):
        for n in names:
            if n not in used and re.search(rf"\b{n}\b", text):
                used.add(n)
                visit(CTE[n])

    visit(body)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in names if n in used)
    own = re.match(r"\s*WITH\s", body)
    if ctes and own:
        text = f"WITH {ctes}, {body[own.end():]}"
    else:
        text = (f"WITH {ctes} " if ctes else "") + body
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def register(name: str, body: str) -> None:
    SQL[name] = build(body)


# --- roles -----------------------------------------------------------------------
CTE["r_places"] = """
SELECT p_partkey::VARCHAR AS place_id, p_partkey AS pk, p_name AS name, p_brand AS area,
 CASE p_type WHEN 'PROMO' THEN 'subway' WHEN 'LARGE' THEN 'park' WHEN 'MEDIUM' THEN 'park' WHEN 'SMALL' THEN 'senior_friendly' ELSE 'market' END AS kind,
 p_size AS size, p_retailprice AS price, 36.9 + (p_partkey % 130) / 100.0 AS latitude, 125.9 + (p_partkey % 230) / 100.0 AS longitude FROM part"""
CTE["r_commercial"] = """
SELECT c_custkey AS k, c_name AS name, c_acctbal + 2000 AS total, (c_custkey % 100)::DOUBLE + (c_custkey % 70)::DOUBLE + (c_custkey % 50)::DOUBLE AS young,
 (c_custkey % 90)::DOUBLE AS senior, (c_custkey % 400)::DOUBLE AS morning, (c_custkey % 300)::DOUBLE + (c_custkey % 200)::DOUBLE + (c_custkey % 110)::DOUBLE AS afternoon FROM customer"""


def ratio6(a, b):
    return f"round(coalesce(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END, 0.0), 6)"


CTE["r_commercial_clean"] = f"""
SELECT k, name, {ratio6('young', 'total')} AS young_ratio, {ratio6('senior', 'total')} AS senior_ratio, {ratio6('morning', 'total')} AS morning_score,
 {ratio6('afternoon', 'total')} AS afternoon_score FROM r_commercial"""
CTE["r_workers_clean"] = f"""
SELECT s_suppkey AS k, {ratio6('(s_suppkey % 100)::DOUBLE + (s_suppkey % 70)::DOUBLE + (s_suppkey % 50)::DOUBLE', 's_acctbal + 2000')} AS young_ratio,
 {ratio6('(s_suppkey % 90)::DOUBLE', 's_acctbal + 2000')} AS senior_ratio FROM supplier"""
CTE["r_living"] = f"""
SELECT area_id, total, young, senior, morning, afternoon, {ratio6('young', 'total')} AS young_ratio, {ratio6('senior', 'total')} AS senior_ratio,
 {ratio6('morning', 'morning + afternoon')} AS morning_score, {ratio6('afternoon', 'morning + afternoon')} AS afternoon_score FROM (
 SELECT user_id AS area_id, sum(value) AS total, sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END) AS young,
  sum(CASE WHEN event_id % 5 = 0 THEN value ELSE 0.0 END) AS senior, sum(CASE WHEN hour(ts) BETWEEN 6 AND 10 THEN value ELSE 0.0 END) AS morning,
  sum(CASE WHEN hour(ts) BETWEEN 11 AND 17 THEN value ELSE 0.0 END) AS afternoon FROM events GROUP BY user_id) WHERE total > 0"""
_stat = lambda c: f"CASE WHEN max({c}) > min({c}) THEN {clamp(f'(avg({c}) - min({c})) / (max({c}) - min({c}))')} ELSE {clamp(f'avg({c})')} END"
CTE["r_aux"] = f"""
SELECT * FROM (SELECT {_stat('young_ratio')} AS c2040, {_stat('senior_ratio')} AS c60, {_stat('morning_score')} AS cm, {_stat('afternoon_score')} AS ca FROM r_commercial_clean),
 (SELECT {_stat('young_ratio')} AS w2040, {_stat('senior_ratio')} AS w60 FROM r_workers_clean),
 (SELECT {_stat('young_ratio')} AS l2040, {_stat('senior_ratio')} AS l60, {_stat('morning_score')} AS lm, {_stat('afternoon_score')} AS la FROM r_living)"""
CTE["r_contexts"] = "SELECT s AS slot, a AS age FROM (VALUES ('morning'), ('afternoon')) x(s), (VALUES ('20_40'), ('60_plus')) y(a)"


def adj(base, *aux):
    """base + .12 * (mean of present aux - .5), clamped."""
    total = " + ".join(f"coalesce({a}, 0.0)" for a in aux)
    n = " + ".join(f"(({a}) IS NOT NULL)::INT" for a in aux)
    return (f"CASE WHEN ({n}) = 0 THEN {clamp(base)} ELSE {clamp(f'({base}) + 0.12 * (({total}) / ({n})::DOUBLE - 0.5)')} END")


Y, O, M, A = "age = '20_40'", "age = '60_plus'", "slot = 'morning'", "slot = 'afternoon'"
on = lambda cond, v: f"CASE WHEN {cond} THEN {v} END"
LIVE_AGE = f"CASE WHEN {Y} THEN l2040 WHEN {O} THEN l60 END"
LIVE_CTX = f"CASE WHEN {M} THEN lm ELSE la END"


def scorer(kind, base, time, age, context, facility, age_aux, ctx_aux, mix, dedupe):
    w = fv.TYPE_WEIGHTS[kind]
    total = "0.0"
    for c, x in zip(["ts", "asc_", "cs", "fs", "ins"], w):
        total = f"{total} + {c} * {x}"
    part = f"""
SELECT place_id, pk, name, '{kind}' AS place_type, area, slot, age, ts, asc_, cs, fs, ins, {total} AS raw_score FROM (
 SELECT *, {clamp(mix)} AS ins FROM (
  SELECT b.*, slot, age, {time} AS ts, {adj(age, *age_aux)} AS asc_, {adj(context, *ctx_aux)} AS cs, {facility} AS fs FROM ({base}) b, r_contexts, r_aux))"""
    if dedupe:
        part = f"SELECT * FROM ({part}) QUALIFY row_number() OVER (PARTITION BY slot, age, {dedupe}) = 1"
    return part


share = lambda x, top: f"CASE WHEN coalesce({top}, 0.0) <= 0 THEN 0.0 ELSE {clamp(f'({x}) / ({top})')} END"
CTE["s_subway"] = scorer(
    "subway",
    """SELECT *, max(mi) OVER () AS tm, max(af) OVER () AS ta, max(mi + af) OVER () AS td FROM (SELECT *, (pk * 37 % 1000)::DOUBLE AS mi,
     (pk * 53 % 1000 + size)::DOUBLE AS af FROM r_places WHERE kind = 'subway' AND pk % 2 = (SELECT max(pk % 2) FROM r_places WHERE kind = 'subway'))""",
    f"CASE WHEN {M} THEN {share('mi', 'tm')} ELSE {share('af', 'ta')} END", f"CASE WHEN {Y} THEN 1.0 ELSE 0.55 END", share("mi + af", "td"), "0.60",
    [on(Y, "w2040"), LIVE_AGE], [f"CASE WHEN {M} THEN cm ELSE ca END", LIVE_CTX],
    f"0.45 * ts + 0.25 * cs + 0.15 * asc_ + 0.15 * (CASE WHEN {M} AND {Y} THEN 1.0 ELSE 0.78 END) * (CASE WHEN {Y} THEN 1.0 ELSE 0.60 END)",
    "name ORDER BY raw_score DESC, place_id")
_dens = "nk::DOUBLE / 5.0"
_count = lambda text, words: " + ".join(f"contains({text}, '{w}')::INT" for w in words)
CTE["s_park"] = scorer(
    "park",
    f"""SELECT *, {_count('fac', fv.PARK_KEYWORDS)} AS nk, max(ln(greatest(sqm, 1.0))) OVER () AS ta, max(length(fac)::DOUBLE) OVER () AS tl FROM (
     SELECT *, (size * size * 10)::DOUBLE AS sqm, CASE size % 4 WHEN 0 THEN '광장 산책로' WHEN 1 THEN '문화 체육' WHEN 2 THEN '' ELSE name END AS fac
     FROM r_places WHERE kind = 'park')""",
    f"CASE WHEN {A} THEN 1.0 ELSE 0.75 END", f"CASE WHEN {Y} THEN 1.0 ELSE 0.70 END",
    f"0.65 * (CASE WHEN substr(area, 7)::INT <= 20 THEN 1.0 ELSE 0.45 END) + 0.35 * ({_dens})",
    f"0.75 * ({share('ln(greatest(sqm, 1.0))', 'ta')}) + 0.25 * ({share('length(fac)::DOUBLE', 'tl')})",
    [on(Y, "c2040"), on(O, "c60"), LIVE_AGE], [on(A, "ca"), LIVE_CTX],
    f"0.20 * ts + 0.22 * asc_ + 0.23 * cs + 0.20 * fs + 0.15 * ({_dens}) * (CASE WHEN {A} THEN 1.0 ELSE 0.75 END) * (CASE WHEN {Y} THEN 1.0 ELSE 0.78 END)", "")
_raw = "0.0" + "".join(f" + CASE WHEN contains(txt, '{k}') THEN {v} ELSE 0.0 END" for k, v in fv.SENIOR_KEYWORD_WEIGHTS.items())
_has = any_of("txt", fv.SENIOR_KEYWORD_WEIGHTS)
CTE["s_senior"] = scorer(
    "senior_friendly",
    f"""SELECT *, max({_raw}) OVER () AS tr, max(length(name)::DOUBLE) OVER () AS tl FROM (SELECT *, name || ' ' ||
     CASE size % 4 WHEN 0 THEN '노인복지관' WHEN 1 THEN '종합복지관 노인교실' WHEN 2 THEN '경로당' ELSE '복지센터' END AS txt FROM r_places WHERE kind = 'senior_friendly')""",
    f"CASE WHEN {A} THEN 1.0 ELSE 0.85 END", f"CASE WHEN {O} THEN 1.0 ELSE 0.45 END",
    f"0.80 * (CASE WHEN size % 5 <> 0 THEN 1.0 ELSE 0.50 END) + 0.20 * ({share('length(name)::DOUBLE', 'tl')})",
    f"0.65 * (CASE WHEN {_has} THEN 1.0 ELSE 0.40 END) + 0.35 * ({share(_raw, 'tr')})",
    [on(O, "c60"), on(O, "w60"), LIVE_AGE], ["ca", LIVE_CTX],
    f"""0.18 * ts + 0.30 * asc_ + 0.17 * cs + 0.20 * fs + 0.15 * (CASE WHEN {_has} THEN 1.0 ELSE 0.55 END) * (CASE WHEN {A} THEN 1.0 ELSE 0.82 END)
     * (CASE WHEN {O} THEN 1.0 ELSE 0.65 END)""", "area ORDER BY raw_score DESC, name, place_id")
_kind3 = lambda a, b, c: f"(CASE size % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END)"
CTE["s_market"] = scorer(
    "market", "SELECT *, max(size::DOUBLE) OVER () AS t1, max(price) OVER () AS t2 FROM r_places WHERE kind = 'market'",
    f"CASE WHEN {A} THEN 1.0 ELSE 0.70 END", f"CASE WHEN {Y} THEN 0.65 ELSE 0.82 END", _kind3(0.78, 0.68, 0.60),
    f"0.60 * ({share('size::DOUBLE', 't1')}) + 0.40 * ({share('price', 't2')})",
    [on(Y, "c2040"), on(Y, "w2040"), on(O, "c60"), on(O, "w60"), LIVE_AGE], [f"CASE WHEN {M} THEN cm ELSE ca END", LIVE_CTX],
    f"0.18 * ts + 0.22 * asc_ + 0.20 * cs + 0.25 * fs + 0.15 * {_kind3('1.0', 0.85, '0.70')} * (CASE WHEN {A} THEN 1.0 ELSE 0.72 END) * (CASE WHEN {O} THEN 1.0 ELSE 0.80 END)", "")
CTE["r_scored"] = "SELECT *, round(raw_score, 4) AS score FROM (SELECT * FROM s_subway UNION ALL SELECT * FROM s_park UNION ALL SELECT * FROM s_senior UNION ALL SELECT * FROM s_market)"
CTE["r_pool"] = f"""SELECT *, row_number() OVER (PARTITION BY slot, age, place_type ORDER BY raw_score DESC, name, place_id) AS list_pos FROM r_scored
 QUALIFY list_pos <= {CANDIDATE_POOL}"""
CTE["r_requests"] = """
SELECT query_id, date, time, hh, area, place_type, activity_type, target_group, actor, place_type || ';' || area || ';' || token || ';오전' AS context_tags FROM (
SELECT o_orderkey AS query_id, strftime(o_orderdate, '%Y-%m-%d') AS date, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS time, (o_orderkey % 24)::INT AS hh,
 'Brand#' || (c_nationkey + 1)::VARCHAR AS area,
 CASE o_orderpriority WHEN '1-URGENT' THEN '교통거점' WHEN '2-HIGH' THEN '전통시장' WHEN '3-MEDIUM' THEN '공원' WHEN '4-NOT SPECIFIED' THEN '복지시설' ELSE '정책현장' END AS place_type,
 CASE o_orderpriority WHEN '1-URGENT' THEN '거리인사' WHEN '2-HIGH' THEN '지역상권방문' WHEN '3-MEDIUM' THEN '현장방문' WHEN '4-NOT SPECIFIED' THEN '주민간담회' ELSE '공약발표' END AS activity_type,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '직장인' WHEN 'BUILDING' THEN '지역주민' WHEN 'FURNITURE' THEN '상인' WHEN 'HOUSEHOLD' THEN '어르신' ELSE '노동자' END AS target_group,
 CASE (o_orderkey % 24) % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'ring' ELSE '상권' END AS token, c_mktsegment AS actor
FROM orders JOIN customer ON o_custkey = c_custkey)"""
_ctx = "concat_ws(' ', place_type, activity_type, target_group, context_tags)"
_types = "CASE " + " ".join(f"WHEN {any_of('ctx', ws)} THEN ['{n}']" for n, ws in fv.REQUEST_TYPE_RULES) + " ELSE ['market', 'park', 'subway', 'senior_friendly'] END"
CTE["r_asked"] = f"""
SELECT *, concat_ws('|', area, slot, age, array_to_string(types, '+'), place_type) AS pool_id,
 concat_ws('|', area, slot, age, array_to_string(types, '+'), place_type, area, time, place_type, activity_type, target_group, context_tags) AS sig FROM (
 SELECT *, CASE WHEN hh BETWEEN 5 AND 11 THEN 'morning' ELSE 'afternoon' END AS slot, CASE WHEN {any_of('ctx', fv.SENIOR_WORDS)} THEN '60_plus' ELSE '20_40' END AS age,
  {_types} AS types FROM (SELECT *, {_ctx} AS ctx FROM r_requests))"""
CTE["r_pools"] = "SELECT DISTINCT pool_id, area, slot, age, types, place_type AS query_type FROM r_asked"
CTE["r_candidates"] = """
SELECT pool_id, name AS rec_name, area AS rec_area, place_type AS rec_type, place_id, score AS base_score, place_type AS candidate_source FROM (
 SELECT p.pool_id, s.*, list_position(p.types, s.place_type) AS type_pos FROM r_pools p JOIN r_pool s ON s.slot = p.slot AND s.age = p.age AND s.area = p.area
  AND list_contains(p.types, s.place_type))
 QUALIFY row_number() OVER (PARTITION BY pool_id, name, area, place_type ORDER BY type_pos, list_pos) = 1"""
CTE["r_ranked"] = "SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY base_score DESC, rec_name DESC, rec_area DESC, rec_type DESC) AS base FROM r_candidates"
CTE["r_floor"] = "SELECT pool_id, min(base_score) AS floor FROM r_ranked WHERE base <= 10 GROUP BY pool_id"
CTE["r_frozen"] = """
SELECT pool_id, rec_name, rec_area, rec_type, place_id, round(base_score, 4) AS base_score, candidate_source,
 row_number() OVER (PARTITION BY pool_id ORDER BY base_score DESC, CASE WHEN base <= 10 THEN base ELSE 999999 END, rec_name, base) AS raw_rank
FROM r_ranked WHERE base <= 50"""
CTE["r_sigs"] = "SELECT DISTINCT sig, pool_id, area, time, hh, place_type, activity_type, target_group, context_tags FROM r_asked"
CTE["r_lists"] = "SELECT s.*, rec_name, rec_area, rec_type, place_id, base_score, candidate_source, raw_rank FROM r_sigs s JOIN r_frozen f USING (pool_id)"
CTE["r_gold"] = """
SELECT l_orderkey AS query_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, l_quantity::BIGINT) AS gold_id, p_name AS place_name, CASE WHEN l_returnflag = 'R' THEN '' ELSE p_brand END AS area,
 1 + (l_quantity > 17)::INT + (l_quantity > 34)::INT AS relevance FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTE["r_goldsig"] = "SELECT g.*, sig, place_type, activity_type, actor FROM r_gold g JOIN (SELECT query_id, sig, place_type, activity_type, actor FROM r_asked) USING (query_id)"


def metrics_sql(recs, by="", models=""):
    """Greedy matching, unrolled: rank 1 takes its best gold row, then rank 2 of
    what is left, and so on; best is (exact before partial, relevance, first)."""
    b = f"{by}, " if by else ""
    same = f"AND a.{by} = p.{by}" if by else ""
    steps, before = [], None
    for r in range(1, 11):
        free = "" if before is None else f" AND NOT EXISTS (SELECT 1 FROM {before} a WHERE a.query_id = p.query_id AND a.gold_id = p.gold_id {same})"
        pick = (f"SELECT {b}query_id, {r} AS rank, arg_min(gold_id, (-prio, -relevance, gold_id)) AS gold_id, arg_min(relevance, (-prio, -relevance, gold_id)) AS relevance "
                f"FROM prs p WHERE rank = {r}{free} GROUP BY {b}query_id")
        steps.append(f"a{r} AS MATERIALIZED ({pick}{'' if before is None else f' UNION ALL SELECT * FROM {before}'})")
        before = f"a{r}"
    return f"""
 rcs AS MATERIALIZED ({recs}),
 prs AS MATERIALIZED (SELECT {b}g.query_id, g.gold_id, g.relevance, l.rank, CASE WHEN l.rec_name = g.place_name THEN 4 ELSE 1 END AS prio FROM r_goldsig g JOIN rcs l ON l.sig = g.sig
   AND (g.area = '' OR g.area = l.rec_area) AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name))),
 {', '.join(steps)}, hits AS (SELECT * FROM a10),
 ideal AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos, count(*) OVER (PARTITION BY query_id) AS total FROM r_goldsig),
 ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
 st AS (SELECT query_id, k, max(total) AS total_relevant, sum(CASE WHEN pos <= k THEN (pow(2.0, relevance) - 1.0) / log2(pos + 1.0) ELSE 0.0 END) AS idcg FROM ideal, ks GROUP BY query_id, k),
 ht AS (SELECT {b}query_id, k, count(*) AS hits, sum((pow(2.0, relevance) - 1.0) / log2(rank + 1.0)) AS dcg, string_agg(gold_id::VARCHAR, ';' ORDER BY rank) AS ids
   FROM hits, ks WHERE rank <= k GROUP BY {b}query_id, k),
 detail AS MATERIALIZED (SELECT {b}st.query_id, st.k, coalesce(hits, 0) AS hits, total_relevant, coalesce(hits, 0) / st.k::DOUBLE AS p, coalesce(hits, 0) / total_relevant::DOUBLE AS r,
   coalesce(dcg, 0.0) / idcg AS n, coalesce(ids, '') AS ids FROM st {f"CROSS JOIN (VALUES {models}) m({by})" if by else ""} LEFT JOIN ht USING ({b}query_id, k))"""


# --- variants ------------------------------------------------------------------------
_type_ctx = "concat_ws(' ', place_type, target_group, context_tags)"
_vt = "CASE " + " ".join(f"WHEN rec_type = '{k}' AND {any_of('tt', ws)} THEN 0.15" for k, ws in fv.EXPECTED_TYPE_RULES)
_vt += f" WHEN rec_type = 'park' AND {any_of('place_type', ['체육', '어린이', '가족'])} THEN 0.10 ELSE 0.0 END"
bonus = lambda text, rules: "CASE " + " ".join(f"WHEN rec_type = '{k}' AND {any_of(text, ws)} THEN {v}" for k, v, ws in rules) + " ELSE 0.0 END"
CTE["r_bonus"] = f"""
SELECT *, CASE WHEN area = rec_area THEN 0.18 ELSE 0.0 END AS ab, {_vt} AS tb, {bands('hh', 'rec_type', fv.VARIANT_TIME_BONUS, {})} AS hb,
 {bonus("concat_ws(' ', target_group, context_tags)", fv.VARIANT_CONTEXT_BONUS)} AS cb, {bonus('target_group', fv.VARIANT_TARGET_BONUS)} AS gb
FROM (SELECT *, {_type_ctx} AS tt FROM r_lists)"""
CTE["r_models"] = "SELECT * FROM (VALUES ('baseline', 0.0, 0.0, 0.0, 0.0), ('area_weighted', 1.0, 0.0, 0.0, 0.0), ('type_weighted', 0.0, 1.0, 0.0, 0.0), ('time_weighted', 0.0, 0.0, 1.0, 0.0), ('combined', 1.0, 1.0, 1.0, 1.0)) m(model, wa, wt, wh, wx)"
CTE["r_variants"] = """
SELECT * FROM (SELECT model, sig, rec_name, rec_area, rec_type, place_id, candidate_source, base_score, raw_rank, ab * wa AS area_bonus, tb * wt AS type_bonus, hb * wh AS time_bonus,
 cb * wx AS context_bonus, gb * wx AS target_bonus, round(base_score + ab * wa + tb * wt + hb * wh + cb * wx + gb * wx, 4) AS score FROM r_bonus, r_models WHERE area = rec_area)
 QUALIFY row_number() OVER (PARTITION BY model, sig ORDER BY score DESC, base_score DESC, raw_rank) <= 10"""
CTE["r_variants_ranked"] = "SELECT *, row_number() OVER (PARTITION BY model, sig ORDER BY score DESC, base_score DESC, raw_rank) AS rank FROM r_variants"
CTE["r_combined"] = "SELECT * FROM r_variants_ranked WHERE model = 'combined'"
MODELS = ", ".join(f"('{m}')" for m in fv.MODEL_VARIANTS)

# --- tuned features ------------------------------------------------------------------------


def cats(text, words):
    strip = lambda w: "".join(ch for ch in w.lower() if ch.isalnum())
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(text, [strip(w) for w in ws])} THEN '{c}' END" for c, ws in words.items()) + "], lambda x: x IS NOT NULL)"


def related(c, kind, pairs):
    best = ", ".join(f"CASE WHEN list_contains({c}, '{q}') AND {kind} = '{t}' THEN {w} ELSE 0.0 END" for q, t, w in pairs)
    return f"CASE WHEN list_contains({c}, {kind}) THEN 1.0 ELSE greatest({best}) END"


# Tags of a request are: type, area, token, day part. The area and the day part
# are skipped; the type and the token are looked up in the candidate's own text.
_own = key("concat_ws(' ', rec_name, rec_area, rec_type, place_id, candidate_source)")
_tag = lambda t: (f"CASE WHEN {t} IN ('오전','오후','저녁','아침','점심','출근','퇴근') OR {t} = akey THEN 0.0 WHEN contains(own, {t}) THEN 0.18 "
                  f"WHEN length({t}) >= 3 AND (contains(own, substr({t}, 1, 3)) OR contains(own, substr({t}, length({t}) - 2))) THEN 0.08 ELSE 0.0 END")
_listed = f"0.0 + ({_tag(key('tags[1]'))}) + ({_tag(key('tags[2]'))}) + ({_tag(key('tags[3]'))}) + ({_tag(key('tags[4]'))})"
_goal = "CASE " + " ".join(f"WHEN rec_type = '{k}' AND {any_of('target_group', ws)} THEN {v}" for k, v, ws in fv.TUNED_TARGET)
CTE["r_tuned"] = f"""
SELECT *, CASE WHEN area = rec_area THEN 1.0 ELSE 0.0 END AS area_bonus, {related('asked', 'rec_type', fv.TUNED_RELATEDNESS)} AS type_bonus,
 {bands('hh', 'rec_type', fv.TUNED_TIME_TABLE, fv.TUNED_TIME_OTHER)} AS time_bonus,
 least({_listed} + CASE WHEN list_contains(meant, rec_type) THEN 0.35 WHEN {related('meant', 'rec_type', fv.TUNED_RELATEDNESS)} > 0 THEN 0.12 ELSE 0.0 END, 1.0) AS context_bonus,
 {_goal} WHEN contains(target_group, '일반시민') THEN 0.25 ELSE 0.0 END AS target_bonus, round(1.0 - (least(greatest(raw_rank::DOUBLE, 1.0), 50.0) - 1.0) / 49.0, 6) AS rank_bonus
FROM (SELECT *, {_own} AS own, {key('area')} AS akey, string_split(context_tags, ';') AS tags,
 {cats(key("concat_ws(' ', place_type, target_group, context_tags)"), fv.TUNED_CATEGORY_WORDS)} AS asked,
 {cats(key("concat_ws(' ', context_tags, target_group)"), fv.TUNED_CATEGORY_WORDS)} AS meant FROM r_lists)"""
TUNED_SCORE = ("round(base_score * baseline_weight + area_bonus * area_weight + type_bonus * type_weight + time_bonus * time_weight + context_bonus * context_weight "
               "+ target_bonus * target_weight + rank_bonus * rank_weight, 6)")
_grid = ", ".join(f"{v} AS {n}" for n, v in zip(fv.TUNED_WEIGHTS, fv.TUNED_REQUIRED[2]))
CTE["r_tuned_recs"] = f"""
SELECT *, row_number() OVER (PARTITION BY sig ORDER BY score DESC, base_score DESC, raw_rank) AS rank FROM (
 SELECT *, {TUNED_SCORE} AS score FROM r_tuned, (SELECT {_grid}) WHERE area = rec_area) QUALIFY rank <= 10"""
# --- coverage ------------------------------------------------------------------------------
CTE["r_cover"] = """
SELECT g.query_id, g.gold_id, g.place_name AS gold_place_name, g.area AS gold_area, g.sig, g.place_type, g.activity_type, n.raw_candidate_count, r.best_raw_rank, f.best_final_rank
FROM r_goldsig g LEFT JOIN (SELECT sig, count(*) AS raw_candidate_count FROM r_lists GROUP BY sig) n USING (sig)
LEFT JOIN (SELECT g.gold_id, min(raw_rank) AS best_raw_rank FROM r_goldsig g JOIN r_lists l ON l.sig = g.sig AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name)) AND (g.area = '' OR g.area = l.rec_area)
 GROUP BY g.gold_id) r USING (gold_id)
LEFT JOIN (SELECT g.gold_id, min(rank) AS best_final_rank FROM r_goldsig g JOIN r_tuned_recs l ON l.sig = g.sig AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name))
 AND (g.area = '' OR g.area = l.rec_area) GROUP BY g.gold_id) f USING (gold_id)"""
CTE["r_coverage"] = """
SELECT query_id, gold_id, sig, gold_place_name, gold_area, place_type, activity_type, coalesce(raw_candidate_count, 0) AS raw_candidate_count,
 coalesce(best_raw_rank <= 50, false) AS in_raw_top50, coalesce(best_raw_rank <= 100, false) AS in_raw_top100, best_raw_rank, coalesce(best_final_rank <= 10, false) AS in_top10,
 best_final_rank, CASE WHEN best_raw_rank IS NOT NULL THEN 'covered' ELSE 'missing_from_raw_candidates' END AS coverage_status FROM r_cover"""
# --- seeded order --------------------------------------------------------------------------
CTE["r_split"] = """
SELECT query_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || query_id::VARCHAR), query_id) <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT DISTINCT query_id FROM r_goldsig)"""
# --- final features ------------------------------------------------------------------------
_ask = key("concat_ws(' ', place_type, activity_type, target_group, context_tags)")
_bucket = "CASE " + " ".join(f"WHEN hh >= {lo} AND hh < {hi} THEN '{n}'" for lo, hi, n in fv.TIME_BUCKETS) + " ELSE 'evening' END"
CTE["r_profile"] = f"""
SELECT actor, dim, k AS key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY actor, dim)::DOUBLE AS p FROM (
 SELECT actor, 'category' AS dim, unnest(CASE WHEN len(c) = 0 THEN ['unknown'] ELSE c END) AS k FROM (SELECT actor, {cats(_ask, fv.FINAL_CATEGORY_WORDS)} AS c FROM r_asked)
 UNION ALL SELECT actor, 'area', area FROM r_asked UNION ALL SELECT actor, 'time', {_bucket} FROM r_asked UNION ALL SELECT actor, 'activity', activity_type FROM r_asked)
GROUP BY actor, dim, k"""
_tt = "CASE bucket || '>' || rec_type " + " ".join(f"WHEN '{b}>{k}' THEN {v}" for b, t in fv.FINAL_TIME_TABLE.items() for k, v in t.items()) + " ELSE 0.0 END"
_ft = "CASE " + " ".join(f"WHEN rec_type = '{k}' AND {any_of('goal', ws)} THEN {v}" for k, v, ws in fv.FINAL_TARGET)
CTE["r_final"] = f"""
SELECT *, least(1.0, 0.70 * coalesce(pc, 0.0) + 0.15 * coalesce(pa, 0.0) + 0.15 * coalesce(pt, 0.0)) AS style FROM (
SELECT f.*, c.p AS pc, a.p AS pa, t.p AS pt FROM (
 SELECT *, CASE WHEN area = rec_area THEN 1.0 ELSE 0.0 END AS area_match, {related('asked', 'rec_type', fv.FINAL_RELATEDNESS)} AS type_match, {_tt} AS time_match,
 {_ft} WHEN {any_of('goal', ['일반시민', '지역주민'])} THEN 0.30 ELSE 0.0 END AS target_match,
 least(1.0, 0.55 * base_score + 0.25 * ({case('rec_type', fv.FOOTFALL_TYPE, 0.35)}) + 0.20 * ({case('bucket', fv.FOOTFALL_SLOT, 0.55)})) AS footfall,
 least(1.0, CASE WHEN {any_of('work', fv.WORKER_WORDS)} THEN 0.45 ELSE 0.0 END + CASE WHEN bucket IN ('morning_commute', 'evening_commute') THEN 0.30 ELSE 0.0 END
  + CASE rec_type WHEN 'subway' THEN 0.25 WHEN 'market' THEN 0.10 ELSE 0.0 END) AS worker,
 CASE WHEN rec_type = 'subway' THEN 1.0 WHEN rec_type = 'market' THEN 0.25 ELSE 0.10 END AS transit,
 CASE WHEN rec_type = 'market' THEN 1.0 WHEN rec_type = 'subway' THEN 0.20 ELSE 0.05 END AS market,
 least(1.0, CASE WHEN {any_of('wel', fv.WELFARE_WORDS)} THEN 0.45 ELSE 0.0 END + CASE WHEN rec_type = 'senior_friendly' THEN 0.45 ELSE 0.0 END
  + CASE WHEN rec_type = 'park' AND {any_of('wel', fv.WELFARE_PARK_WORDS)} THEN 0.20 ELSE 0.0 END) AS welfare,
 least(1.0, 0.75 * ({related('asked', 'rec_type', fv.FINAL_RELATEDNESS)}) + 0.25 * (len(list_intersect(tagk, ownk))::DOUBLE / len(list_distinct(tagk))::DOUBLE)) AS context_match,
 greatest(0.0, 1.0 - (raw_rank::DOUBLE - 1.0) / 99.0) AS rank_score, 1.0 / count(*) OVER (PARTITION BY sig, rec_type)::DOUBLE AS diversity FROM (
  SELECT l.*, q.actor, q.queries, {cats(_ask, fv.FINAL_CATEGORY_WORDS)} AS asked, {_bucket} AS bucket, {key('target_group')} || {key('context_tags')} AS goal,
  {key("concat_ws(' ', target_group, context_tags)")} AS work, {key("concat_ws(' ', place_type, activity_type, context_tags)")} AS wel,
  list_distinct(list_transform(string_split(context_tags, ';'), lambda x: {key('x')})) AS tagk,
  [{key('rec_type')}, {key('candidate_source')}, {key('rec_area')}] || {cats(key("rec_type || ' ' || candidate_source"), fv.FINAL_CATEGORY_WORDS)} AS ownk
  FROM r_lists l JOIN (SELECT sig, actor, count(*) AS queries FROM r_asked GROUP BY sig, actor) q USING (sig))) f
 LEFT JOIN r_profile c ON c.actor = f.actor AND c.dim = 'category' AND c.key = f.rec_type
 LEFT JOIN r_profile a ON a.actor = f.actor AND a.dim = 'area' AND a.key = f.area
 LEFT JOIN r_profile t ON t.actor = f.actor AND t.dim = 'time' AND t.key = f.bucket)"""
FINAL_SCORE = lambda w: ("base_score * {0} + area_match * {1} + type_match * {2} + time_match * {3} + context_match * {4} + target_match * {5} + (footfall + worker) / 2.0 * {6} "
                         "+ transit * {7} + market * {8} + welfare * {9} + style * {10} + rank_score * 0.03").format(*w)
# --- text similarity -----------------------------------------------------------------------
_derived = cats(key("rec_type || ' ' || candidate_source"), fv.FINAL_CATEGORY_WORDS)
CTE["r_told"] = f"""
SELECT sig, raw_rank, queries, concat_ws(' ', place_type, activity_type, target_group, context_tags, area, time) AS l,
 concat_ws(' ', rec_type, candidate_source, rec_area, array_to_string(list_sort({_derived}), ';'), bucket) AS r FROM r_final"""
CTE["r_semantic"] = f"""
WITH d AS (SELECT 'l' AS side, l AS doc, sum(queries) AS copies FROM r_told GROUP BY l UNION ALL SELECT 'r', r, sum(queries) FROM r_told GROUP BY r),
 tok AS (SELECT side, doc, copies, unnest(list_filter(list_transform(regexp_split_to_array(doc, '[;,/|()\\s]+'), lambda x: {key('x')}), lambda x: length(x) >= 2)) AS token FROM d),
 tf AS (SELECT side, doc, copies, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY side, doc) AS len FROM tok GROUP BY side, doc, copies, token),
 idf AS (SELECT token, ln(((SELECT sum(copies) FROM d) + 1)::DOUBLE / (sum(copies) + 1)::DOUBLE) + 1.0 AS idf FROM tf GROUP BY token),
 v AS (SELECT side, doc, token, c / len::DOUBLE * idf AS w FROM tf JOIN idf USING (token)), nm AS (SELECT side, doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY side, doc),
 pr AS (SELECT DISTINCT l, r FROM r_told),
 dot AS (SELECT l, r, sum(a.w * b.w) AS dot FROM pr JOIN v a ON a.side = 'l' AND a.doc = l JOIN v b ON b.side = 'r' AND b.doc = r AND b.token = a.token GROUP BY l, r)
SELECT sig, raw_rank, coalesce(dot / (x.norm * y.norm), 0.0) AS semantic FROM r_told t LEFT JOIN dot USING (l, r) LEFT JOIN nm x ON x.side = 'l' AND x.doc = t.l LEFT JOIN nm y ON y.side = 'r' AND y.doc = t.r"""
CTE["r_whole"] = f"""
SELECT *, {clamp(' + '.join(f'{w} * {c}' for c, w in fv.COMPOSITE.items()))} AS composite FROM r_final JOIN r_semantic USING (sig, raw_rank)"""
