"""Day routes, templates, coordinates and stored-query choice."""

from __future__ import annotations

from placewright.functions import text as tf
from placewright.plans.oracle import CTE, build, share
from placewright.plans.queries import *  # noqa: F403
from placewright.sources import files

ROUTE_KINDS = {"subway": ("subway_csv", "교통거점"), "market": ("market_csv", "전통시장"), "park": ("park_csv", "공원"), "senior_friendly": ("welfare_csv", "복지시설")}


SOURCES = [fv.SOURCE_DEFAULT, "market_csv", "park_csv", "subway_csv", "welfare_csv", "medical_welfare_csv", "commercial_worker_csv", "commercial_street_csv", "public_csv", "frontend_static_json"]


@pipe.stage
def _pool(spark, sf):
    """Places of optimised lists, frozen candidates, seven public tables and JSON documents, one row per place by source priority."""
    t = {k: d.withColumnRenamed("name", "place_name") for k, d in roles.place_tables(spark, sf).items()}
    measure = {"subway": F.col("morning_in") + F.col("afternoon_in"), "market": F.col("store_count") + F.col("floor_area") / 100.0, "park": F.col("area_sqm"), "senior_friendly": None}
    sources = {src: (t[k].withColumnsRenamed({"latitude": "lat", "longitude": "lng"}), kind, measure[k]) for k, (src, kind) in ROUTE_KINDS.items()}
    sources |= {"medical_welfare_csv": (roles.medical_places(spark, sf), "복지시설", None), "commercial_worker_csv": (roles.worker_places(spark, sf), "골목상권", F.col("total_worker_population")),
                "commercial_street_csv": (roles.commercial_places(spark, sf), "골목상권", F.col("total_flow"))}
    texts = roles.place_documents(spark, sf)
    records = [routes.record_pool(files.flatten_json_records(texts.filter(F.col("source") == s), "value"), s) for s in ("public_csv", "frontend_static_json")]
    lists = routes.recommended_pool(pipe.tuned_recs(spark, sf), pipe.frozen(spark, sf).withColumn("score", F.col("base_score")))
    return routes.unified_pool([lists, routes.public_pool(sources, "City"), *records], roles.AREAS)


_top = lambda x: f"max({x}) OVER ()"
_KIND = "CASE rec_type WHEN 'subway' THEN '교통거점' WHEN 'market' THEN '전통시장' WHEN 'park' THEN '공원' ELSE '복지시설' END"
CTE["r_routepool"] = f"""
SELECT *, CASE source WHEN 'route_candidate_pool' THEN 1 WHEN 'frontend_static_json' THEN 3 ELSE 2 END AS priority FROM (
 SELECT name, area, '교통거점' AS place_type, 'subway_csv' AS source, 0.92 + 0.35 * ({share('m', 't')}) AS score FROM (SELECT *, {_top('m')} AS t FROM (
   SELECT *, (pk * 37 % 1000)::DOUBLE + (pk * 53 % 1000 + size)::DOUBLE AS m FROM r_places WHERE kind = 'subway' AND pk % 2 = (SELECT max(pk % 2) FROM r_places WHERE kind = 'subway')
   QUALIFY row_number() OVER (PARTITION BY name ORDER BY area, place_id) = 1))
 UNION ALL SELECT name, area, '전통시장', 'market_csv', 0.90 + 0.30 * ({share('m', 't')}) FROM (SELECT *, {_top('m')} AS t FROM (SELECT *, size::DOUBLE + price / 100.0 AS m FROM r_places WHERE kind = 'market'))
 UNION ALL SELECT name, area, '공원', 'park_csv', 0.86 + 0.28 * ({share('m', 't')}) FROM (SELECT *, {_top('m')} AS t FROM (SELECT *, (size * size * 10)::DOUBLE AS m FROM r_places WHERE kind = 'park'))
 UNION ALL SELECT name, area, '복지시설', 'welfare_csv', 0.88 FROM r_places WHERE kind = 'senior_friendly'
 UNION ALL SELECT s_name || ' clinic', 'Brand#' || (s_nationkey + 1), '복지시설', 'medical_welfare_csv', 0.86 FROM supplier
 UNION ALL SELECT s_name || ' zone', 'Brand#' || (s_nationkey + 1), '골목상권', 'commercial_worker_csv', 0.88 + 0.32 * ({share('m', 't')}) FROM (SELECT *, {_top('m')} AS t FROM (SELECT *, greatest(s_acctbal + 2000, 0.0) AS m FROM supplier))
 UNION ALL SELECT c_name || ' zone', 'Brand#' || (c_nationkey + 1), '골목상권', 'commercial_street_csv', 0.88 + 0.32 * ({share('m', 't')}) FROM (SELECT *, {_top('m')} AS t FROM (SELECT *, greatest(c_acctbal + 2000, 0.0) AS m FROM customer))
 UNION ALL SELECT p_name || ' plaza', p_brand, '체육시설', CASE WHEN p_size % 2 = 0 THEN 'public_csv' ELSE 'frontend_static_json' END, round(p_retailprice / 10000.0, 6) FROM part
 UNION ALL SELECT rec_name, rec_area, {_KIND}, 'route_candidate_pool', max(s) FROM (SELECT rec_name, rec_area, rec_type, score AS s FROM r_tuned_recs UNION ALL SELECT rec_name, rec_area, rec_type, base_score FROM r_frozen)
  GROUP BY rec_name, rec_area, rec_type)
QUALIFY row_number() OVER (PARTITION BY replace(name, ' ', ''), area, place_type ORDER BY priority, score DESC, name, source) = 1"""
CTE["r_routes"] = """
SELECT c_custkey AS route_id, ['Brand#' || (c_nationkey + 1), 'Brand#' || ((c_nationkey + 1) % 25 + 1)] AS areas, (1 + c_custkey % 8)::INT AS n FROM customer"""


@pipe.stage
def _requests(spark, sf):
    """Every customer asks for a day route in two areas."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    brand = lambda x: F.concat(F.lit("Brand#"), x.cast("string"))
    rows = roles.table(spark, sf, "customer").select(
        k.alias("route_id"), F.expr("cast(date_add(DATE '2024-01-25', cast(c_custkey % 10 AS int)) AS string)").alias("date"), F.lit("09:00").alias("start_time"),
        F.lit("18:30").alias("end_time"), F.lit("").alias("start_location"), F.array(brand(n + 1), brand((n + 1) % 25 + 1)).alias("areas"),
        roles.pick(F.col("c_mktsegment"), {"AUTOMOBILE": "직장인", "BUILDING": "지역주민", "FURNITURE": "상인", "HOUSEHOLD": "노년층"}, "청년").alias("target_group"),
        roles.pick(k % 3, {0: "퇴근인사", 1: "시장방문"}, "공원방문").alias("goal"),
        F.when(k % 2 == 0, F.array(F.lit("market"), F.lit("park"))).otherwise(F.array(F.lit("subway"))).alias("preferred_types"),
        (F.lit(1) + k % 8).cast("int").alias("num_visits"), (k % 5 != 0).alias("avoid_duplicates"))
    return routes.parse_requests(rows, roles.AREAS)


@query("route_pool", "SELECT name AS place_name, area, place_type, source, round(score, 6) AS score FROM r_routepool")
def route_pool(spark, sf):
    return _pool(spark, sf).select("place_name", "area", "place_type", "source", *R6("score"))


@query("source_matrix", f"""SELECT a.area, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SOURCES)}, coalesce(n, 0) AS total_real_count, coalesce(n, 0) <= 0 AS fallback_needed
 FROM (SELECT DISTINCT p_brand AS area FROM part) a LEFT JOIN (SELECT area, {', '.join(f"count_if(source = '{c}') AS {c}" for c in SOURCES)}, count(*) AS n FROM r_routepool GROUP BY area) USING (area)""")
def source_matrix(spark, sf):
    areas = roles.places(spark, sf).select("area").distinct()
    return routes.source_matrix(_pool(spark, sf), SOURCES, areas)


@query("round_robin", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY priority, score DESC, name, place_type) AS turn FROM r_routepool),
 c AS (SELECT route_id, n, turn, list_position(areas, h.area) AS ap, h.name, h.area, h.place_type FROM r_routes JOIN h ON list_contains(areas, h.area) AND turn <= n)
SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY turn, ap) AS pos, name AS place_name, area, place_type FROM c QUALIFY pos <= n""")
def round_robin(spark, sf):
    return routes.route_candidates(_requests(spark, sf), _pool(spark, sf), None, roles.AREAS).filter("not is_fallback").select("route_id", "pos", "place_name", "area", "place_type")


_WANTED = "CASE WHEN c_custkey % 2 = 0 THEN ['전통시장', '공원'] ELSE ['교통거점'] END"


@query("relaxation_ladder", f"""
WITH r AS (SELECT c_custkey AS route_id, (1 + c_custkey % 8)::INT AS n, ['Brand#' || (c_nationkey + 1), 'Brand#' || ((c_nationkey + 1) % 25 + 1)] AS areas, {_WANTED} AS kinds FROM customer),
 c AS (SELECT route_id, n, count_if(list_contains(kinds, place_type)) AS s, count(place_type) AS e FROM r LEFT JOIN r_routepool p ON list_contains(areas, p.area) GROUP BY route_id, n)
SELECT route_id, n AS num_visits, s AS rung_1, e AS rung_2, e AS rung_3, e AS rung_4, e AS together, CASE WHEN s >= n THEN 1 WHEN e >= n THEN 2 END::INT AS rung,
 CASE WHEN s >= n THEN 'strict_real_candidates' WHEN e >= n THEN 'relaxed_place_type_real_candidates' END AS rung_name, greatest(n - e, 0) AS short_by FROM c""")
def relaxation_ladder(spark, sf):
    return routes.relaxation_ladder(_requests(spark, sf), _pool(spark, sf))


def _short(spark, sf):
    """Candidates where clinics are the only real places and each area has one seed: requests fall short in every way."""
    real = routes.unified_pool([routes.public_pool({"medical_welfare_csv": (roles.medical_places(spark, sf), "복지시설", None)}, "City")], roles.AREAS)
    return routes.route_candidates(_requests(spark, sf), real, roles.area_seeds(spark, sf), roles.AREAS)


CTE["r_short"] = f"""
WITH r AS (SELECT c_custkey AS route_id, (1 + c_custkey % 8)::INT AS n, ['Brand#' || (c_nationkey + 1), 'Brand#' || ((c_nationkey + 1) % 25 + 1)] AS areas, {_WANTED} AS kinds FROM customer),
 cl AS (SELECT s_name || ' clinic' AS name, 'Brand#' || (s_nationkey + 1) AS area FROM supplier QUALIFY row_number() OVER (PARTITION BY replace(s_name, ' ', ''), s_nationkey ORDER BY s_name) = 1),
 h AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY name) AS turn FROM cl),
 real AS (SELECT route_id, n, areas, kinds, h.name, h.area, row_number() OVER (PARTITION BY route_id ORDER BY turn, list_position(areas, h.area)) AS pos FROM r JOIN h ON list_contains(areas, h.area) AND turn <= n QUALIFY pos <= n),
 got AS (SELECT r.*, count(real.name) AS have FROM r LEFT JOIN real USING (route_id) GROUP BY r.route_id, r.n, r.areas, r.kinds),
 seed AS (SELECT route_id, n_name || ' base' AS name, areas[k] AS area, have + row_number() OVER (PARTITION BY route_id ORDER BY k) AS pos FROM (SELECT *, unnest([1, 2]) AS k FROM got WHERE have < n) JOIN nation ON 'Brand#' || (n_nationkey + 1) = areas[k]
   QUALIFY pos <= n),
 more AS (SELECT g.*, have + count(seed.name) AS all_ FROM got g LEFT JOIN seed USING (route_id) GROUP BY g.route_id, g.n, g.areas, g.kinds, g.have),
 made AS (SELECT route_id, areas, kinds, all_, unnest(range(1, n - all_ + 1)) AS i FROM more WHERE all_ < n)
SELECT route_id, pos, name AS place_name, area, '복지시설' AS place_type, 0.86 AS score, CASE WHEN list_contains(kinds, '복지시설') THEN 'strict_real_candidates' ELSE 'relaxed_place_type_real_candidates' END AS stage, false AS is_fallback FROM real
UNION ALL SELECT route_id, pos, name, area, '정책현장', 1.05, 'district_fallback_seed', true FROM seed
UNION ALL SELECT route_id, all_ + i, areas[(i - 1) % 2 + 1] || ' 생활권 유세 거점 ' || i, areas[(i - 1) % 2 + 1], kinds[(i - 1) % len(kinds) + 1], 0.98 - i * 0.01, 'synthetic_district_fallback', true FROM made"""


@query("short_lists", "SELECT route_id, pos, place_name, area, place_type, round(score, 6) AS score, stage, is_fallback FROM r_short")
def short_lists(spark, sf):
    """Real candidates, then seeds, then generated fillers, as each request needs."""
    return _short(spark, sf).select("route_id", "pos", "place_name", "area", "place_type", *R6("score"), "stage", "is_fallback")


def _breaks_sql(order):
    return f"""SELECT '{order}' AS ordering, route_id, place_name, pos AS at, f AS first_filler FROM (SELECT *, min(CASE WHEN is_fallback THEN pos END) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
 FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY route_id ORDER BY {'pos' if order == 'as_built' else 'score DESC, pos'}) AS pos) FROM r_short)) WHERE NOT is_fallback AND f IS NOT NULL"""


@query("filler_breaks", f"{_breaks_sql('as_built')} UNION ALL {_breaks_sql('by_score')}")
def filler_breaks(spark, sf):
    """Real stops behind a filler: none as the lists are built, many once they are ordered by score."""
    rows = _short(spark, sf).select("route_id", "place_name", "pos", "score", "is_fallback")
    orders = {"as_built": ["pos"], "by_score": [F.desc("score"), "pos"]}
    ordered = shaping.union_all([shaping.first_per(rows, ["route_id"], o, routes.MOST_VISITS, "at").withColumn("ordering", F.lit(n)) for n, o in orders.items()])
    found = quality.filler_breaks(ordered.withColumn("list", F.concat_ws("|", "ordering", F.col("route_id").cast("string"))), "list", "at")
    return found.select("ordering", "route_id", "place_name", "at", "first_filler")


def _stops(spark, sf):
    req = _requests(spark, sf)
    found = routes.route_candidates(req, _pool(spark, sf), None, roles.AREAS)
    visits = roles.visits(spark, sf).withColumn("place_name", F.concat(F.lit("blue "), F.element_at(F.split("place_name", " "), -1)))
    return req, found, routes.build_routes(req, found, visits, roles.AREAS, roles.ADJACENCY)


@query("route_build")
def route_build(spark, sf):
    return _stops(spark, sf)[2].drop("address", "lat", "lng")


@query("route_summary")
def route_summary(spark, sf):
    req, _, stops = _stops(spark, sf)
    return routes.route_summary(req, stops)


@query("route_debug")
def route_debug(spark, sf):
    req, found, _ = _stops(spark, sf)
    return routes.candidate_debug(req, _pool(spark, sf), found)


@query("route_swaps")
def route_swaps(spark, sf):
    return routes.swap_options(_stops(spark, sf)[2], _pool(spark, sf))


@query("route_distance", """
WITH v AS (SELECT area, pk, latitude AS lat, longitude AS lng FROM r_places WHERE latitude BETWEEN 37.0 AND 38.0 AND longitude BETWEEN 126.0 AND 128.0),
 l AS (SELECT *, lag(lat) OVER (PARTITION BY area ORDER BY pk) AS a, lag(lng) OVER (PARTITION BY area ORDER BY pk) AS b FROM v),
 d AS (SELECT area, CASE WHEN a IS NOT NULL THEN 2 * 6371.0 * atan2(sqrt(h), sqrt(1.0 - h)) END AS km FROM (SELECT *, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lng - b) / 2), 2) AS h FROM l)),
 s AS (SELECT area, sum(km) AS km, count(km) AS legs FROM d GROUP BY area), n AS (SELECT area, count(*) AS stops FROM r_places GROUP BY area), m AS (SELECT area, count(*) AS ok FROM v GROUP BY area)
SELECT area, round(km, 2) AS total_km, legs, stops, stops - ok AS missing_coordinates FROM s JOIN n USING (area) JOIN m USING (area)""")
def route_distance(spark, sf):
    stops = roles.places(spark, sf).select(F.col("area").alias("route_id"), F.col("pk").alias("order"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    rows = coords.route_distance(stops)
    return rows.select(F.col("route_id").alias("area"), F.round("total_km", 2).alias("total_km"), "legs", "stops", "missing_coordinates")


@query("coordinate_sources", """
WITH k AS (SELECT DISTINCT area, name FROM r_places WHERE kind = 'park' AND latitude BETWEEN 37.0 AND 38.0 AND longitude BETWEEN 126.0 AND 128.0),
 s AS (SELECT DISTINCT area, name FROM r_places WHERE kind = 'market' AND latitude BETWEEN 37.0 AND 38.0 AND longitude BETWEEN 126.0 AND 128.0)
SELECT p.place_id, CASE WHEN p.pk % 3 = 0 AND latitude BETWEEN 37.0 AND 38.0 AND longitude BETWEEN 126.0 AND 128.0 THEN 'original' WHEN k.name IS NOT NULL THEN 'known_seoul_coordinates' WHEN s.name IS NOT NULL THEN 'static'
 ELSE 'missing' END AS coordinate_source FROM r_places p LEFT JOIN k USING (area, name) LEFT JOIN s USING (area, name)""")
def coordinate_sources(spark, sf):
    p = roles.places(spark, sf)
    index = lambda k: p.filter(F.col("kind") == k).select("area", tf.place_key("name").alias("key"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    own = F.col("pk") % 3 == 0
    stops = p.select("place_id", "area", F.col("name").alias("place_name"), F.when(own, F.col("latitude")).alias("lat"), F.when(own, F.col("longitude")).alias("lng"))
    return coords.resolve(stops, index("park"), index("market")).select("place_id", "coordinate_source")


@query("template_routes")
def template_routes(spark, sf):
    rows = templates.best_template_routes(pipe.scored(spark, sf))
    return rows.select("age_group", "template", *[F.col(f"c{i}.name").alias(f"stop_{i}") for i in range(1, 5)], "route_score", *R6("mean_place_score", "average_interaction"))


@query("choose_query", """
WITH a AS (SELECT DISTINCT c_nationkey AS nk, c_mktsegment AS seg, ['Brand#' || (c_nationkey + 1), 'Brand#' || ((c_nationkey + 1) % 25 + 1)] AS areas,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '직장인' WHEN 'BUILDING' THEN '지역주민' WHEN 'FURNITURE' THEN '상인' WHEN 'HOUSEHOLD' THEN '노년층' ELSE '청년' END AS target FROM customer),
 q AS (SELECT area, target_group, place_type, activity_type, substr(time, 1, 2) AS h, min(query_id) AS query_id FROM r_requests GROUP BY ALL),
 s AS (SELECT nk, seg, query_id, CASE WHEN contains(target_group, target) THEN 3 ELSE 0 END + CASE WHEN contains(place_type || ' ' || activity_type, '시장') THEN 3 ELSE 0 END
  + CASE WHEN h = '09' THEN 2 ELSE 0 END + CASE WHEN list_contains(areas, area) THEN 10 ELSE 0 END AS score FROM a, q),
 b AS (SELECT nk, seg, arg_min(query_id, (-score, query_id)) AS query_id, max(score) AS score FROM s GROUP BY nk, seg)
SELECT c_custkey AS request_id, query_id, score FROM customer JOIN b ON nk = c_nationkey AND seg = c_mktsegment""")
def choose_query(spark, sf):
    asks = _requests(spark, sf).select(F.col("route_id").alias("request_id"), "areas", F.col("target_group").alias("target"), F.lit("시장").alias("purpose"), F.col("start_time").alias("time"))
    return routes.choose_query(asks, roles.requests(spark, sf), roles.AREAS)


@query("broadened_lists", """
WITH own AS (SELECT sig AS list_id, rec_area AS area, place_id AS item_id, score, 0 AS stage, rank AS r FROM r_tuned_recs WHERE rank <= 3),
 short AS (SELECT list_id, area FROM own GROUP BY list_id, area HAVING count(*) < 5),
 p AS (SELECT area, place_id AS item_id, price / 10000.0 AS score, pk % 2 AS odd FROM r_places),
 near AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, item_id) AS r FROM p WHERE odd = 0 QUALIFY r <= 10),
 seed AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS r FROM p WHERE odd = 1 QUALIFY r <= 10),
 every AS (SELECT * FROM own UNION ALL SELECT list_id, area, item_id, score, 1, r FROM short JOIN near USING (area) UNION ALL SELECT list_id, short.area, item_id, score, 2, r FROM short, seed),
 one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY list_id, item_id ORDER BY stage, r) = 1)
SELECT list_id, area, item_id, score, stage, row_number() OVER (PARTITION BY list_id ORDER BY stage, r, item_id) AS position FROM one QUALIFY position <= 5""")
def broadened_lists(spark, sf):
    recs = pipe.tuned_recs(spark, sf).filter("rank <= 3").select(F.col("sig").alias("list_id"), F.col("rec_area").alias("area"), F.col("place_id").alias("item_id"), "score", "rank")
    p = roles.places(spark, sf).select("area", F.col("place_id").alias("item_id"), (F.col("price") / 10000.0).alias("score"))
    return routes.broaden(recs, p.filter("cast(item_id AS int) % 2 = 0"), p.filter("cast(item_id AS int) % 2 = 1"))
