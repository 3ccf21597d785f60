"""Coordinates: resolution by stage, geocode picking, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.numbers import haversine_km, route_minutes, valid_coords
from placewright.functions.text import clean, place_key
from placewright.operators.shaping import first_per


def resolve(stops: DataFrame, known: DataFrame, static: DataFrame) -> DataFrame:
    """Own -> known -> static index -> unresolved, with status and source.

    ``known`` and ``static`` are (area, key, lat, lng), first row per key kept.
    """
    own = valid_coords(F.col("lat"), F.col("lng"))
    pick = lambda d, p: first_per(d.filter(valid_coords(F.col("lat"), F.col("lng"))), ["area", "key"], ["lat", "lng"]).select(
        "area", "key", F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    rows = stops.withColumn("key", place_key("place_name")).join(pick(known, "k"), ["area", "key"], "left").join(pick(static, "s"), ["area", "key"], "left")
    has = (clean("area") != "") & (clean("place_name") != "")
    rejected = F.coalesce(F.col("is_fallback"), F.lit(False)) if "is_fallback" in stops.columns else F.lit(False)
    level = (F.when(~has, "missing_required_fields").when(own, "original").when(F.col("k_lat").isNotNull(), "known_seoul_coordinates")
             .when(rejected, "fallback_coordinate_rejected").when(F.col("s_lat").isNotNull(), "static").otherwise("missing"))
    rows = rows.withColumn("coordinate_source", level)
    by = lambda o, k, s: F.when(level == "original", F.col(o)).when(level == "known_seoul_coordinates", F.col(k)).when(level == "static", F.col(s))
    status = F.when(level == "static", "merged_static").when(level.isin("original", "known_seoul_coordinates"), level).otherwise("not_found")
    found = {"coordinate_status": status, "_lat": by("lat", "k_lat", "s_lat"), "_lng": by("lng", "k_lng", "s_lng")}
    rows = rows.withColumns(found).withColumns({"lat": F.col("_lat"), "lng": F.col("_lng")})
    return rows.withColumn("has_coordinates", F.col("lat").isNotNull()).drop("_lat", "_lng", "k_lat", "k_lng", "s_lat", "s_lng", "key")


def pick_geocode(results: DataFrame, city_word: str = "서울") -> DataFrame:
    """First valid in-city result of the expected area per request, and counts
    of what was rejected before it.

    ``results``: request_id, seq, lat, lng, address, result_area, expected_area.
    """
    valid = valid_coords(F.col("lat"), F.col("lng"))
    in_city = clean("address").contains(city_word)
    fits = (F.col("result_area") == F.col("expected_area")) | clean("address").contains(F.col("expected_area"))
    kind = (F.when(clean("expected_area") == "", "unasked").when(~valid, "invalid").when(~in_city, "outside").when(fits, "picked")
            .when(clean("result_area") != "", "area").otherwise("other"))
    rows = results.withColumn("_kind", kind)
    best = rows.groupBy("request_id").agg(F.min(F.when(F.col("_kind") == "picked", F.struct("seq", "lat", "lng", "address"))).alias("p"),
                                          F.count("*").alias("results"))
    joined = rows.join(best, "request_id")
    before = F.col("p").isNull() | (F.col("seq") < F.col("p.seq"))
    count = lambda k: F.count_if(before & (F.col("_kind") == k))
    return joined.groupBy("request_id").agg(
        F.first("p.lat").alias("lat"), F.first("p.lng").alias("lng"), F.first("p.address").alias("address"), count("area").alias("area_rejected"),
        count("outside").alias("city_rejected"), count("invalid").alias("invalid_coordinates"), F.first("results").alias("results"))


def leg_distances(stops: DataFrame, by="route_id", order="order") -> DataFrame:
    """Kilometres from the previous stop that has valid coordinates."""
    rows = stops.filter(valid_coords(F.col("lat"), F.col("lng")))
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("leg_km", haversine_km(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")))


def route_distance(stops: DataFrame, by="route_id", order="order", start=True) -> DataFrame:
    """Total kilometres, minutes, legs and stops without coordinates per route."""
    legs = leg_distances(stops, by, order).groupBy(by).agg(F.coalesce(F.sum("leg_km"), F.lit(0.0)).alias("total_km"), F.count("leg_km").alias("legs"))
    sizes = stops.groupBy(by).agg(F.count("*").alias("stops"), F.count_if(~valid_coords(F.col("lat"), F.col("lng"))).alias("missing_coordinates"))
    rows = sizes.join(legs, by, "left").na.fill({"total_km": 0.0, "legs": 0})
    return rows.withColumn("estimated_minutes", route_minutes(F.col("total_km"), F.col("stops")))


def start_points(requests: DataFrame) -> DataFrame:
    """Known start coordinates by containment in the start text, as order 0."""
    text = F.regexp_replace(clean("start_location"), r"\s+", "")
    lat = F.coalesce(*[F.when(text.contains(k), F.lit(v[0])) for k, v in fv.KNOWN_STARTS.items()])
    lng = F.coalesce(*[F.when(text.contains(k), F.lit(v[1])) for k, v in fv.KNOWN_STARTS.items()])
    return requests.select("route_id", F.lit(0).alias("order"), lat.alias("lat"), lng.alias("lng")).filter("lat is not null")
