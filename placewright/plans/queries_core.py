"""Cleaning, keys, dedupe, profiling, text and time functions."""

from __future__ import annotations

from placewright.functions import numbers as nf, text as tf, times as tm
from placewright.plans.oracle import all_of, any_of, first_of, key, ratio6
from placewright.plans.queries import *  # noqa: F403

T = roles.table


@query("daypart_sums", """SELECT area_id, round(total, 4) AS total_population, round(young, 4) AS age_20_40_population, round(senior, 4) AS age_60_plus_population,
 round(morning, 4) AS morning_population, round(afternoon, 4) AS afternoon_population, young_ratio AS age_20_40_ratio, senior_ratio AS age_60_plus_ratio, morning_score, afternoon_score FROM r_living""")
def daypart_sums(spark, sf):
    rows = cleaning.daypart_sums(roles.living(spark, sf), ["area_id"])
    return rows.select("area_id", *R4("total_population", "age_20_40_population", "age_60_plus_population", "morning_population", "afternoon_population"),
                       "age_20_40_ratio", "age_60_plus_ratio", "morning_score", "afternoon_score")


@query("commercial_ratios", "SELECT '20241_' || k::VARCHAR AS commercial_id, name AS commercial_name, young_ratio, senior_ratio, morning_score, afternoon_score FROM r_commercial_clean")
def commercial_ratios(spark, sf):
    rows = cleaning.clean_commercial(roles.commercial(spark, sf), ["commercial_code"])
    return rows.select("commercial_id", "commercial_name", F.col("age_20_40_ratio").alias("young_ratio"), F.col("age_60_plus_ratio").alias("senior_ratio"),
                       F.col("morning_flow_score").alias("morning_score"), F.col("afternoon_flow_score").alias("afternoon_score"))


_AUX_COLUMNS = [*((c, "r_commercial_clean") for c in ("young_ratio", "senior_ratio", "morning_score", "afternoon_score")), *((c, "r_workers_clean") for c in ("young_ratio", "senior_ratio")),
                *((c, "r_living") for c in ("young_ratio", "senior_ratio", "morning_score", "afternoon_score"))]


@query("aux_stats", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg({c}), 6) AS mean, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM {t}" for n, (c, t) in zip(fv.AUX_FEATURES, _AUX_COLUMNS)))
def aux_stats(spark, sf):
    """All ten series."""
    names = fv.AUX_FEATURES
    get = lambda n, s: F.round(F.try_element_at("summary", F.lit(f"{n}_{s}")), 6)
    items = [F.struct(F.lit(n).alias("feature"), get(n, "mean").alias("mean"), get(n, "min").alias("low"), get(n, "max").alias("high")) for n in names]
    return pipe.aux(spark, sf).select(F.inline(F.array(*items)))


@query("monthly_counters", """
SELECT use_month || '_' || line || '_' || station AS station_id, min_ AS morning_total_in, mout AS morning_total_out, ain AS afternoon_total_in, aout AS afternoon_total_out FROM (
SELECT strftime(l_shipdate, '%Y%m') AS use_month, l_suppkey::VARCHAR AS line, l_partkey::VARCHAR AS station,
 sum(CASE WHEN h IN (6,7,8,9) THEN l_quantity ELSE 0 END)::BIGINT AS min_, sum(CASE WHEN h IN (6,7,8,9) THEN l_linenumber ELSE 0 END)::BIGINT AS mout,
 sum(CASE WHEN h BETWEEN 12 AND 17 THEN l_quantity ELSE 0 END)::BIGINT AS ain, sum(CASE WHEN h BETWEEN 12 AND 17 THEN l_linenumber ELSE 0 END)::BIGINT AS aout
FROM (SELECT *, l_orderkey % 24 AS h FROM lineitem) GROUP BY 1, 2, 3)""")
def monthly_counters(spark, sf):
    rows = cleaning.clean_transit(roles.transit_raw(spark, sf))
    return rows.select("station_id", "morning_total_in", "morning_total_out", "afternoon_total_in", "afternoon_total_out")


@query("slug_ids", """SELECT pk, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS slug_id FROM (SELECT pk, replace(area || '_' || name, ' ', '_') AS base,
 row_number() OVER (PARTITION BY area, name ORDER BY pk) AS n FROM r_places)""")
def slug_ids(spark, sf):
    return shaping.slug_ids(roles.places(spark, sf), ["area", "name"], ["pk"]).select("pk", "slug_id")


@query("sequential_ids", """SELECT query_id, 'Q' || substr(actor, 1, 2) || '_' || CASE WHEN n >= 1000 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 4, '0') END AS seq_id FROM (
 SELECT *, row_number() OVER (PARTITION BY substr(actor, 1, 2) ORDER BY date, time, query_id) AS n FROM r_requests)""")
def sequential_ids(spark, sf):
    rows = roles.requests(spark, sf).select("query_id", "actor", "date", "time")
    prefix = F.concat(F.lit("Q"), F.substring("actor", 1, 2))
    return shaping.sequential_ids(rows, prefix, ["date", "time", "query_id"], "seq_id").select("query_id", "seq_id")


@query("dedupe_first", "SELECT name, area, min(pk) AS pk FROM r_places GROUP BY name, area")
def dedupe_first(spark, sf):
    return shaping.first_per(roles.places(spark, sf), ["name", "area"], ["pk"]).select("name", "area", "pk")


@query("dedupe_keep_blank", """SELECT gid, doc_id FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE md5(text) END AS gid, doc_id FROM documents)
 QUALIFY gid = '' OR row_number() OVER (PARTITION BY gid ORDER BY doc_id) = 1""")
def dedupe_keep_blank(spark, sf):
    rows = T(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.md5("text")).alias("gid"), "doc_id")
    return shaping.dedupe_keep_blank(rows, "gid", ["doc_id"])


_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("profile_table", " UNION ALL ".join(f'SELECT \'{c}\' AS "column", count(*) AS rows, count_if({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct" FROM part' for c in _COLS))
def profile_table(spark, sf):
    return quality.profile(T(spark, sf, "part"))


@query("candidate_keys", " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", CASE WHEN count(DISTINCT {c}) = count(*) THEN \'exact\' ELSE \'near\' END AS kind, round(count(DISTINCT {c}) / count(*)::DOUBLE, 6) AS unique_ratio,'
    f' count(*) - count(DISTINCT {c}) AS duplicates FROM part HAVING count(DISTINCT {c}) / count(*)::DOUBLE >= 0.95' for c in _COLS))
def candidate_keys(spark, sf):
    return quality.candidate_keys(quality.profile(T(spark, sf, "part")))


@query("quality_checks", """
WITH c AS (SELECT count(*)::DOUBLE AS n, count_if(NOT regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))::DOUBLE AS bad_date, count_if(target_group = '')::DOUBLE AS blank_target,
 count_if(place_type NOT IN ('교통거점', '전통시장', '공원'))::DOUBLE AS other_type FROM r_requests)
SELECT 'row_count' AS check_name, 'INFO' AS severity, n >= 1 AS passed, n AS actual, 1.0 AS expected, '' AS detail FROM c
UNION ALL SELECT 'date_format', 'CRITICAL', bad_date = 0, bad_date, 0.0, '' FROM c UNION ALL SELECT 'target_blank', 'CRITICAL', blank_target = 0, blank_target, 0.0, '' FROM c
UNION ALL SELECT 'type_domain', 'WARNING', other_type = 0, other_type, 0.0, 'narrow domain' FROM c""")
def quality_checks(spark, sf):
    bad = F.count_if(~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    rules = [("row_count", "INFO", F.count("*"), ">=", 1, ""), ("date_format", "CRITICAL", bad, "==", 0, ""),
             ("target_blank", "CRITICAL", F.count_if(F.col("target_group") == ""), "==", 0, ""),
             ("type_domain", "WARNING", F.count_if(~F.col("place_type").isin("교통거점", "전통시장", "공원")), "==", 0, "narrow domain")]
    return quality.quality_checks(roles.requests(spark, sf), rules)


@query("rows_preserved", "SELECT DISTINCT name || '|' || area AS row_key FROM r_places WHERE kind = 'park' AND NOT EXISTS (SELECT 1 FROM r_places b WHERE b.kind = 'market' AND b.name = r_places.name AND b.area = r_places.area)")
def rows_preserved(spark, sf):
    p = roles.places(spark, sf)
    return quality.lost_keys(p.filter("kind = 'park'"), p.filter("kind = 'market'"), ["name", "area"])


@query("date_gaps", """SELECT d::VARCHAR AS day FROM (SELECT unnest(generate_series(min(date)::DATE, max(date)::DATE, INTERVAL 1 DAY))::DATE AS d FROM r_requests)
 WHERE d::VARCHAR NOT IN (SELECT date FROM r_requests WHERE place_type = '공원')""")
def date_gaps(spark, sf):
    rows = roles.requests(spark, sf)
    parks = F.when(F.col("place_type") == "공원", F.col("date"))
    out = quality.date_gaps(rows.withColumn("park_day", parks), "park_day", F.min("date"), F.max("date"))
    return out.select(F.col("day").cast("string").alias("day"))


@query("text_keys", f"""SELECT doc_id, {key('text')} AS place_key, length(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS collapsed,
 len(list_filter(regexp_split_to_array(trim(text), '[;,/|()\\s]+'), lambda x: x <> '')) AS tokens FROM documents""")
def text_keys(spark, sf):
    return T(spark, sf, "documents").select("doc_id", tf.place_key("text").alias("place_key"), F.length(tf.collapse_spaces("text")).alias("collapsed"),
                                            F.size(tf.split_tokens("text")).alias("tokens"))


@query("exact_text_groups", "SELECT k, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT md5(" + key("text") + ") AS k, doc_id FROM documents) GROUP BY k")
def exact_text_groups(spark, sf):
    rows = T(spark, sf, "documents").select(F.md5(tf.place_key("text")).alias("k"), "doc_id")
    return rows.groupBy("k").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("time_functions", """
SELECT query_id, CASE WHEN hh BETWEEN 5 AND 11 THEN 'morning' WHEN hh BETWEEN 12 AND 17 THEN 'afternoon' WHEN hh BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS slot4,
 CASE WHEN hh BETWEEN 5 AND 11 THEN 'morning' ELSE 'afternoon' END AS slot2,
 CASE WHEN hh BETWEEN 6 AND 9 THEN 'morning_commute' WHEN hh IN (10, 11) THEN 'late_morning' WHEN hh IN (12, 13) THEN 'lunch' WHEN hh BETWEEN 14 AND 16 THEN 'afternoon'
 WHEN hh BETWEEN 17 AND 19 THEN 'evening_commute' ELSE 'evening' END AS bucket6, (['월','화','수','목','금','토','일'])[isodow(date::DATE)] AS day_of_week,
 'D-' || datediff('day', date::DATE, DATE '2026-06-03')::VARCHAR AS d_day, lpad(hh::VARCHAR, 2, '0') || ':05' AS padded FROM r_requests""")
def time_functions(spark, sf):
    loose = F.concat(tm.hour_of("time").cast("string"), F.lit(":5"))
    return roles.requests(spark, sf).select("query_id", tm.time_slot4("time").alias("slot4"), tm.time_slot2("time").alias("slot2"), tm.time_bucket6("time").alias("bucket6"),
                                            tm.day_of_week("date").alias("day_of_week"), tm.d_day("date").alias("d_day"), tm.norm_time(loose).alias("padded"))


@query("request_context", "SELECT query_id, slot, age AS age_group, array_to_string(types, '+') AS rec_types, pool_id, " +
       f"array_to_string({all_of('ctx', fv.EXPECTED_TYPE_RULES)}, '+') AS expected FROM r_asked")
def request_context(spark, sf):
    wanted = cand.expected_types("place_type", "activity_type", "target_group", "context_tags")
    return pipe.asked(spark, sf).select("query_id", "slot", "age_group", F.array_join("rec_types", "+").alias("rec_types"), "pool_id", F.array_join(wanted, "+").alias("expected"))


_TXT = "concat_ws(' ', place_type, place_name, title, tags)"
_PRES = "CASE " + " ".join(f"WHEN {any_of('ptext', ws)} THEN '{n}'" for n, ws in fv.PRESENCE_RULES) + " ELSE 'unknown' END"


@query("gold_normalised", f"""
WITH b AS (SELECT query_id, date, CASE WHEN query_id % 5 = 0 THEN '' ELSE 'hall ' || (query_id % 9)::VARCHAR END AS place_name, CASE WHEN query_id % 3 = 0 THEN '종로구' ELSE '' END AS area0,
  CASE query_id % 6 WHEN 0 THEN '여의도 출근 인사' WHEN 1 THEN '시장 방문' WHEN 2 THEN '방송 인터뷰' WHEN 3 THEN '정책 협약식' WHEN 4 THEN '내부 회의' ELSE '주민 대화' END AS title,
  CASE WHEN query_id % 2 = 0 THEN place_type ELSE '' END AS type0, target_group, hh FROM r_requests),
 a AS (SELECT *, CASE WHEN area0 <> '' THEN area0 WHEN contains(title, '여의도') THEN '영등포구' ELSE '' END AS area,
  CASE WHEN type0 <> '' THEN type0 ELSE {first_of("concat_ws(' ', place_name, title)", fv.PLACE_TYPE_RULES, fv.PLACE_TYPE_DEFAULT)} END AS place_type,
  {first_of("concat_ws(' ', title, place_name)", fv.ACTIVITY_RULES, fv.ACTIVITY_DEFAULT)} AS activity_type FROM b),
 p AS (SELECT *, {_PRES.replace('ptext', "concat_ws(' ', title, place_type)")} AS presence FROM a),
 l AS (SELECT *, concat_ws(' ', title, place_name, place_type, activity_type, presence, target_group) AS lt FROM p)
SELECT query_id, area, place_type, activity_type, presence,
 CASE WHEN presence = 'online' THEN CASE WHEN {any_of('lt', fv.LABEL_ONLINE_WORDS)} THEN 1 ELSE 0 END WHEN place_name = '' OR area = '' THEN 0 WHEN {any_of('lt', fv.LABEL_INTERNAL_WORDS)} THEN 0
 WHEN {any_of('lt', fv.LABEL_MEDIA_WORDS)} THEN 1 WHEN {any_of('lt', fv.LABEL_SECONDARY_WORDS)} THEN 2 WHEN {any_of('lt', fv.LABEL_STRONG_WORDS)} THEN 3
 WHEN presence IN ('offline', 'hybrid') THEN 2 ELSE 0 END AS label,
 concat_ws(';', place_type, activity_type, nullif(area, ''), CASE WHEN hh BETWEEN 5 AND 11 THEN '오전' WHEN hh BETWEEN 12 AND 17 THEN '오후' ELSE '저녁' END) AS context_tags FROM l""")
def gold_normalised(spark, sf):
    q = F.col("query_id")
    title = roles.pick(q % 6, {0: "여의도 출근 인사", 1: "시장 방문", 2: "방송 인터뷰", 3: "정책 협약식", 4: "내부 회의"}, "주민 대화")
    raw = roles.requests(spark, sf).select(
        q.cast("string").alias("gold_id"), "date", "time", "target_group", F.when(q % 5 == 0, "").otherwise(F.concat(F.lit("hall "), (q % 9).cast("string"))).alias("place_name"),
        F.when(q % 3 == 0, "종로구").otherwise("").alias("area"), title.alias("event_title"), F.when(q % 2 == 0, F.col("place_type")).otherwise("").alias("place_type"))
    rows = goldset.normalize_gold(raw)
    return rows.select(F.col("gold_id").cast("long").alias("query_id"), "area", "place_type", "activity_type", "presence", "label", "context_tags")


_MK = "actor, date, time, area, place_name, title"
_MP = "CASE WHEN actor = 'BUILDING' THEN 'BD' WHEN actor = 'MACHINERY' THEN 'MC' ELSE 'CD' END"
_ID = lambda n: f"pre || '_' || CASE WHEN length(({n})::VARCHAR) >= 4 THEN ({n})::VARCHAR ELSE lpad(({n})::VARCHAR, 4, '0') END"


def _gold_rows(spark, sf):
    """Requests as gold rows that repeat often: place, area and title come from few values."""
    q = F.col("query_id")
    title = roles.pick(q % 6, {0: "여의도 출근 인사", 1: "시장 방문", 2: "방송 인터뷰"}, "주민 대화")
    return roles.requests(spark, sf).select(
        F.col("actor"), "date", "time", F.when(q % 5 == 0, "").otherwise(F.concat(F.lit("hall "), (q % 3).cast("string"))).alias("place_name"), F.when(q % 2 == 0, "종로구").otherwise("").alias("area"),
        title.alias("event_title"), F.lit("").alias("source_image"), q.alias("ord"), F.when(F.col("date") < "1996-01-01", "early.csv").otherwise("late.csv").alias("file_path"))


@query("gold_merge", f"""
WITH b AS (SELECT query_id AS ord, actor, date, time, CASE WHEN query_id % 5 = 0 THEN '' ELSE 'hall ' || (query_id % 3) END AS place_name,
  CASE query_id % 6 WHEN 0 THEN '여의도 출근 인사' WHEN 1 THEN '시장 방문' WHEN 2 THEN '방송 인터뷰' ELSE '주민 대화' END AS title, query_id % 2 = 0 AS even FROM r_requests),
 a AS (SELECT *, CASE WHEN even THEN '종로구' WHEN contains(title, '여의도') THEN '영등포구' ELSE '' END AS area, {_MP} AS pre FROM b),
 o AS (SELECT * FROM a WHERE date < '1996-01-01' QUALIFY row_number() OVER (PARTITION BY {_MK} ORDER BY ord) = 1),
 k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pre ORDER BY actor, date, time, area, place_name, ord) AS n FROM o),
 f AS (SELECT a.* FROM a ANTI JOIN k USING ({_MK}) QUALIFY row_number() OVER (PARTITION BY {_MK} ORDER BY ord) = 1),
 g AS (SELECT *, row_number() OVER (PARTITION BY pre ORDER BY actor, date, time, area, place_name, ord) AS n FROM f),
 mx AS (SELECT pre, max(n) AS last FROM k GROUP BY pre),
 st AS (SELECT {_MK}, {_ID('n')} AS gold_id, NULL AS own FROM k UNION ALL SELECT {_MK}, {_ID('n + coalesce(last, 0)')}, g.ord FROM g LEFT JOIN mx USING (pre)),
 s1 AS (SELECT {_MK}, {_ID('n')} AS gold_id, ord AS own FROM k)
SELECT 'first' AS run, a.ord, gold_id, a.ord = own AS is_kept FROM a JOIN s1 USING ({_MK}) WHERE date < '1996-01-01'
UNION ALL SELECT 'second', a.ord, gold_id, coalesce(a.ord = own, false) FROM a JOIN st USING ({_MK})""")
def gold_merge(spark, sf):
    """Early rows first, then all rows: early ids stay, and each row names the row that stands for it."""
    rows, prefixes = _gold_rows(spark, sf), {"BUILDING": "BD", "MACHINERY": "MC"}
    kept, told = goldset.merge_again(None, rows.filter("file_path = 'early.csv'"), prefixes)
    _, again = goldset.merge_again(kept, rows, prefixes)
    runs = {"first": told, "second": again}
    return shaping.union_all([df.select(F.lit(n).alias("run"), "ord", "gold_id", "is_kept") for n, df in runs.items()])


@query("target_groups", f"""SELECT query_id, t AS targets FROM (SELECT query_id, CASE WHEN len(x) = 0 THEN '{fv.TARGET_DEFAULT}' ELSE array_to_string(x, ';') END AS t FROM (
 SELECT query_id, {all_of("concat_ws(' ', place_type, activity_type, target_group)", fv.TARGET_RULES)} AS x FROM r_requests))""")
def target_groups(spark, sf):
    return roles.requests(spark, sf).select("query_id", goldset.infer_targets(tf.join_context("place_type", "activity_type", "target_group")).alias("targets"))


@query("value_counts", "SELECT place_type AS value, count(*) AS rows FROM r_requests GROUP BY place_type")
def value_counts(spark, sf):
    return diag.value_counts(roles.requests(spark, sf), "place_type")


_LEAD = "^(The|That|Is|And|Re|La|Le|Ein)"


@query("schedule_lines", f"""
WITH l AS (SELECT conv_id, turn, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM conversations)),
 g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_LEAD}') OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS grp FROM l)
SELECT conv_id, turn, (grp - 1)::INT AS line_no, string_agg(line, ' ' ORDER BY i) AS line FROM g GROUP BY conv_id, turn, grp""")
def schedule_lines(spark, sf):
    return goldset.schedule_lines(T(spark, sf, "conversations"), "text", ["conv_id", "turn"], _LEAD)


@query("seeded_top_k", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY price DESC, pk) AS sr FROM r_places QUALIFY sr <= 15)
SELECT area, pk, row_number() OVER (PARTITION BY area ORDER BY md5('7|' || name || '|' || (sr - 1)::VARCHAR), price DESC) AS rank FROM s QUALIFY rank <= 5""")
def seeded_top_k(spark, sf):
    items = roles.places(spark, sf).select("area", "pk", F.col("name").alias("place_name"), F.col("price").alias("score"))
    return fc.controlled_top_k(items, "area", ["-score", "pk"], 5, 7).select("area", "pk", "rank")


@query("split_ids", "SELECT query_id, split FROM r_split")
def split_ids(spark, sf):
    return ev.train_split(roles.gold(spark, sf))


# --- functions on messy values --------------------------------------------------------
_FIT = "CASE WHEN fit IS NULL THEN '{0}' ".format(fv.FIT_LABEL_NULL) + " ".join(f"WHEN fit >= {lo} THEN '{n}'" for lo, n in fv.FIT_LABELS) + f" ELSE '{fv.FIT_LABEL_OTHER}' END"
_KINDS = ["market", "", "nan", "체육시설", "policy_site", " subway "]
_ADDRESSES = ["", "확인 필요", "nan", "Main street 1", " 해당 없음 "]
_LABELS = {"market": "전통시장", "": "기타", "nan": "기타", "체육시설": "체육시설", "policy_site": "정책현장", " subway ": "교통거점"}
_PICK = lambda values, n: "[" + ", ".join(f"'{v}'" for v in values) + f"][k % {n} + 1]"


@query("messy_fields", f"""
WITH b AS (SELECT o_orderkey AS k, o_orderkey % 24 AS h, o_orderkey % 60 AS m, o_orderdate AS d, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 100) / 25.0 END AS fit FROM orders)
SELECT k AS id, CASE k % 5 WHEN 0 THEN printf('%02d:%02d', h, m) WHEN 1 THEN printf('%02d:%02d', h % 12 + 12, m) WHEN 2 THEN printf('%02d:%02d', h, m) WHEN 3 THEN '00:30' ELSE '' END AS clock,
 CASE WHEN k % 4 = 3 THEN 'unknown day' ELSE strftime(d, '%Y-%m-%d') END AS day,
 CASE WHEN k % 3 = 0 THEN '' ELSE coalesce(strftime(try_strptime('2026' || strftime(d, '%m%d'), '%Y%m%d'), '%Y-%m-%d'), '') END AS file_day,
 CASE WHEN k % 7 = 0 THEN 0.0 ELSE (k % 5000)::DOUBLE END AS amount, {_FIT} AS fit_label,
 round(CASE WHEN (k % 300) / 100.0 > 1 THEN least(1.0, (k % 300) / 200.0) ELSE (k % 300) / 100.0 END, 6) AS bounded, CASE WHEN k % 3 = 0 THEN (k % 50)::DOUBLE ELSE 12.5 END AS first_number,
 CASE WHEN k % 3 = 0 THEN 'third' WHEN k % 3 = 1 THEN 'second' ELSE 'first' END AS first_text, CASE WHEN h % 2 = 0 THEN h * 60 + m END AS minute_of_day,
 array_to_string(list_transform(range(0, greatest(least(k % 10, 8), 1)), lambda i: printf('%02d:%02d', (round_even(390 + ((8 + k % 15) * 60 - 390) / greatest(greatest(least(k % 10, 8), 1) - 1, 1) * i, 0)::INT // 60),
   round_even(390 + ((8 + k % 15) * 60 - 390) / greatest(greatest(least(k % 10, 8), 1) - 1, 1) * i, 0)::INT % 60)), ' ') AS slots,
 {_PICK([_LABELS[x] for x in _KINDS], 6)} AS kind, {_PICK([fv.ADDRESS_UNKNOWN, fv.ADDRESS_UNKNOWN, fv.ADDRESS_UNKNOWN, 'Main street 1', fv.ADDRESS_UNKNOWN], 5)} AS address,
 {_PICK(['BUILDING', 'MACHINERY', 'other', ''], 4)} AS actor, {_PICK(['hall 3', 'hall 4 x', 'Ab c'], 3)} AS place FROM b""")
def messy_fields(spark, sf):
    """Field functions on values as files have them: several layouts, blanks, labels, full-width letters."""
    o = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    k, h, m = F.col("k"), (F.col("k") % 24).cast("int"), (F.col("k") % 60).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    of = lambda values: F.get(tf.lit_array(values), (k % len(values)).cast("int"))
    raw = o.withColumns({
        "h": h, "m": m, "clock": roles.pick(k % 5, {0: F.concat_ws(":", h.cast("string"), m.cast("string")), 1: F.concat(F.lit("오후 "), (h % 12).cast("string"), F.lit("시 "), m.cast("string"), F.lit("분")),
                                                    2: F.concat(two(h), two(m)), 3: F.lit("오전 12.30")}, F.lit("nan")),
        "day": roles.pick(k % 4, {0: F.date_format("d", "yyyy.MM.dd"), 1: F.date_format("d", "MM/dd/yyyy"), 2: F.date_format("d", "yyyyMMdd")}, F.lit("unknown day")),
        "file": F.when(k % 3 == 0, "scan.png").otherwise(F.concat(F.lit("img "), F.date_format("d", "MMdd"), F.lit(".png"))),
        "amount": F.when(k % 7 == 0, "none").otherwise(F.concat(F.format_number(k % 5000, 0), F.lit("명"))), "fit": F.when(k % 11 != 0, (k % 100) / 25.0),
        "n1": F.when(k % 3 == 0, "x").otherwise("12.5"), "n2": (k % 50).cast("string"), "t1": F.when(k % 3 == 2, " first "), "t2": F.when(k % 3 == 1, "second").otherwise(" "),
        "until": F.concat(two(F.lit(8) + k % 15), F.lit(":00")), "n": (k % 10).cast("int"), "kind": of(_KINDS), "address": of(_ADDRESSES), "actor": of(["BUILDING co", "Mach", "other", "none"]),
        "place": of(["장소 : hall 3", "방문지:hall  4 x", "Ａｂ c"])})
    return raw.select(
        k.alias("id"), tm.norm_time_locale("clock").alias("clock"), tm.norm_date("day").alias("day"), tm.date_from_name("file").alias("file_day"), tf.leading_number("amount").alias("amount"),
        nf.fit_label(F.col("fit")).alias("fit_label"), F.round(nf.bounded((k % 300) / 100.0), 6).alias("bounded"), nf.first_numeric("n1", "n2").alias("first_number"),
        tf.first_non_blank("t1", "t2", F.lit("third")).alias("first_text"), tm.minutes(F.when(h % 2 == 0, F.concat_ws(":", h.cast("string"), two(m))).otherwise("25:00")).alias("minute_of_day"),
        F.array_join(tm.time_slots(F.lit("06:30"), "until", "n"), " ").alias("slots"), tf.route_type("kind").alias("kind"), tf.normalise_address("address").alias("address"),
        tf.normalise_actor("actor", {"BUILDING": ["bldg"], "MACHINERY": ["mach"]}).alias("actor"), tf.clean_place_name("place").alias("place"))
