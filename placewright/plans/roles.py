"""The given tables in the roles of places, requests, gold rows and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AREAS = [f"Brand#{i}" for i in range(1, 26)]
KNOWN_AREAS = AREAS[:20]
ADJACENCY = {a: [b] for a, b in zip(AREAS, AREAS[1:])}
#: Places per type and context that a request's pool is drawn from; the operator's default.
CANDIDATE_POOL = 200


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def pick(c: Column, mapping: dict, other=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other) if other is not None else out


def places(spark, sf) -> DataFrame:
    """part as places; type from p_type, area from p_brand."""
    kind = pick(F.col("p_type"), {"PROMO": "subway", "LARGE": "park", "MEDIUM": "park", "SMALL": "senior_friendly"}, "market")
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("place_id"), F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"), F.col("p_brand").alias("area"),
        kind.alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        (F.lit(36.9) + (F.col("p_partkey") % 130) / F.lit(100.0)).alias("latitude"), (F.lit(125.9) + (F.col("p_partkey") % 230) / F.lit(100.0)).alias("longitude"))


def place_tables(spark, sf) -> dict:
    """One table per place type with the measures its scorer reads."""
    p, size = places(spark, sf), F.col("size")
    only = lambda k: p.filter(F.col("kind") == k)
    transit = only("subway").withColumns({"use_month": F.lit(202401) + (F.col("pk") % 2), "morning_in": (F.col("pk") * 37 % 1000).cast("double"),
                                          "afternoon_in": (F.col("pk") * 53 % 1000 + size).cast("double")})
    parks = only("park").withColumns({"area_sqm": (size * size * 10).cast("double"),
                                      "main_facilities": pick(size % 4, {0: "광장 산책로", 1: "문화 체육", 2: ""}, F.col("name"))})
    seniors = only("senior_friendly").withColumns({
        "facility_type": pick(size % 4, {0: "노인복지관", 1: "종합복지관 노인교실", 2: "경로당"}, "복지센터"),
        "facility_address": F.when(size % 5 == 0, "").otherwise(F.concat("area", F.lit(" addr")))})
    markets = only("market").withColumns({"market_type": pick(size % 3, {0: "골목형상점가", 1: "건물형"}, "상가"), "market_address": F.concat("area", F.lit(" 1")),
                                          "store_count": size.cast("double"), "floor_area": F.col("price")})
    return {"subway": transit, "park": parks, "senior_friendly": seniors, "market": markets}


def requests(spark, sf) -> DataFrame:
    """Every order with its customer as a request."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    hour = F.col("o_orderkey") % 24
    kind = pick(F.col("o_orderpriority"), {"1-URGENT": "교통거점", "2-HIGH": "전통시장", "3-MEDIUM": "공원", "4-NOT SPECIFIED": "복지시설"}, "정책현장")
    act = pick(F.col("o_orderpriority"), {"1-URGENT": "거리인사", "2-HIGH": "지역상권방문", "3-MEDIUM": "현장방문", "4-NOT SPECIFIED": "주민간담회"}, "공약발표")
    target = pick(F.col("c_mktsegment"), {"AUTOMOBILE": "직장인", "BUILDING": "지역주민", "FURNITURE": "상인", "HOUSEHOLD": "어르신"}, "노동자")
    area = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    token = pick(hour % 3, {0: "widget", 1: "ring"}, "상권")
    return rows.select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").cast("date").cast("string").alias("date"),
        F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00")).alias("time"), area.alias("area"), kind.alias("place_type"), act.alias("activity_type"),
        target.alias("target_group"), F.concat_ws(";", kind, area, token, F.lit("오전")).alias("context_tags"), F.col("c_mktsegment").alias("actor"))


def gold(spark, sf) -> DataFrame:
    """Every order line with its part as a gold row; the id holds all columns that tell lines apart."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents, F.col("l_quantity").cast("long")]
    rel = F.lit(1) + (F.col("l_quantity") > 17).cast("int") + (F.col("l_quantity") > 34).cast("int")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("query_id"), F.concat_ws("-", *[c.cast("string") for c in parts]).alias("gold_id"), F.col("p_name").alias("place_name"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("p_brand")).alias("area"), rel.alias("relevance"))
    return rows.select("query_id", "gold_id", "place_name", "area", "relevance", F.col("gold_id").alias("ord"))


def aliases(spark, sf) -> DataFrame:
    """Noun of a two-word part name as its alias, per brand."""
    p = table(spark, sf, "part").select(F.col("p_name").alias("canonical_name"), F.element_at(F.split("p_name", " "), -1).alias("alias_name"),
                                        F.col("p_brand").alias("area")).distinct()
    noun = F.col("alias_name")
    return p.withColumns({"place_type": F.when(noun == "widget", "공원").when(noun == "ring", "교통거점").otherwise("전통시장"), "source": F.lit("manual_alias_seed"),
                          "note": F.lit(""), "ord": F.concat_ws("|", "canonical_name", "area")})


def visits(spark, sf) -> DataFrame:
    """events as visits: actor, day, place and type."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("visit_id"), F.col("ts"), F.col("ts").cast("date").alias("visit_date"), F.col("user_id").cast("string").alias("actor"),
        F.concat(F.lit("place "), k).alias("place_name"), F.concat(F.lit("Brand#"), (k.cast("int") % 25 + 1).cast("string")).alias("area"),
        F.col("event_type").alias("place_type"), F.col("value"))


def living(spark, sf) -> DataFrame:
    """events as hourly footfall per user."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("area_id"), F.hour("ts").alias("hour"), v.alias("total"), F.when(F.col("event_id") % 3 == 0, v).otherwise(0.0).alias("young"),
        F.when(F.col("event_id") % 5 == 0, v).otherwise(0.0).alias("senior"))


def commercial(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda m: (k % m).cast("double")
    return table(spark, sf, "customer").select(
        F.lit(20241).alias("quarter"), k.alias("commercial_code"), F.col("c_name").alias("commercial_name"), (F.col("c_acctbal") + 2000).alias("total_flow"),
        part(100).alias("age_20_flow"), part(70).alias("age_30_flow"), part(50).alias("age_40_flow"), part(90).alias("age_60_plus_flow"),
        part(400).alias("flow_06_11"), part(300).alias("flow_11_14"), part(200).alias("flow_14_17"), part(110).alias("flow_17_21"))


def workers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    part = lambda m: (k % m).cast("double")
    return table(spark, sf, "supplier").select(
        F.lit(20241).alias("quarter"), k.alias("commercial_code"), F.col("s_name").alias("commercial_name"), (F.col("s_acctbal") + 2000).alias("total_worker_population"),
        part(100).alias("age_20_workers"), part(70).alias("age_30_workers"), part(50).alias("age_40_workers"), part(90).alias("age_60_plus_workers"))


def transit_raw(spark, sf) -> DataFrame:
    """lineitem as hourly counters: month of shipping, supplier line, part station."""
    hour = F.col("l_orderkey") % 24
    cols = {}
    for band in ["06_07", "07_08", "08_09", "09_10", "12_13", "13_14", "14_15", "15_16", "16_17", "17_18"]:
        here = hour == int(band[:2])
        cols[f"in_{band}"] = F.when(here, F.col("l_quantity")).otherwise(0)
        cols[f"out_{band}"] = F.when(here, F.col("l_linenumber")).otherwise(0)
    return table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMM").alias("use_month"), F.col("l_suppkey").cast("string").alias("line_name"),
        F.col("l_partkey").cast("string").alias("station_name"), *[c.alias(n) for n, c in cols.items()])


# --- further sources of route places, stored records, priors ------------------------
def commercial_places(spark, sf) -> DataFrame:
    """Customers as commercial areas, workers' areas and medical facilities from suppliers."""
    return table(spark, sf, "customer").select(F.concat("c_name", F.lit(" zone")).alias("place_name"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("area"),
                                               (F.col("c_acctbal") + 2000).alias("total_flow"))


def worker_places(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" zone")).alias("place_name"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("area"),
                                               (F.col("s_acctbal") + 2000).alias("total_worker_population"))


def medical_places(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat("s_name", F.lit(" clinic")).alias("place_name"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("area"))


def area_seeds(spark, sf) -> DataFrame:
    """Nations as the kept seed place of each area."""
    return table(spark, sf, "nation").select(F.concat("n_name", F.lit(" base")).alias("place_name"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("area"),
                                             F.lit("정책현장").alias("place_type"), F.lit("").alias("address"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"),
                                             F.lit(1.05).alias("score"), F.lit("district_fallback_seed").alias("source"))


def place_documents(spark, sf) -> DataFrame:
    """Parts as JSON documents (source, value) that hold one place each, at three depths and under different keys."""
    p = table(spark, sf, "part")
    plaza, score = F.concat("p_name", F.lit(" plaza")), F.round(F.col("p_retailprice") / 10000.0, 6)
    flat = F.to_json(F.struct(plaza.alias("name"), F.col("p_brand").alias("district"), F.lit("체육시설").alias("type"), score.alias("score")))
    listed = F.to_json(F.struct(F.array(F.struct(plaza.alias("place_name"), F.col("p_brand").alias("region"), F.lit("체육시설").alias("category"), score.alias("score"))).alias("items")))
    deep = F.struct(F.struct(F.array(F.struct(plaza.alias("title"), F.col("p_brand").alias("district_name"), F.lit("체육시설").alias("place_type"), score.alias("score"))).alias("places")).alias("group"))
    return p.select(F.when(F.col("p_size") % 2 == 0, "public_csv").otherwise("frontend_static_json").alias("source"),
                    F.when(F.col("p_size") % 3 == 0, flat).when(F.col("p_size") % 3 == 1, listed).otherwise(F.to_json(deep)).alias("value"))


def priors(spark, sf) -> DataFrame:
    """Shares of suppliers by category as priors of the known actors and of two that have no history."""
    s = table(spark, sf, "supplier")
    actor = pick(F.col("s_suppkey") % 7, {0: "AUTOMOBILE", 1: "BUILDING", 2: "FURNITURE", 3: "HOUSEHOLD", 4: "MACHINERY", 5: "NEWCOMER"}, "OUTSIDER")
    key = pick(F.col("s_nationkey") % 4, {0: "subway", 1: "market", 2: "park"}, "senior_friendly")
    counts = s.select(actor.alias("actor"), key.alias("key")).groupBy("actor", "key").agg(F.count("*").alias("n"))
    total = counts.groupBy("actor").agg(F.sum("n").alias("total"))
    return counts.join(total, "actor").select("actor", "key", (F.col("n") / F.col("total")).alias("p"))
