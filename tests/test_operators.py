"""Operators on small fixtures, against brute force where one is short."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placewright.operators import (
    candidates, coords, diagnostics, evaluation, goldset, matching, quality, ranking, routes, scoring, search, shaping, templates)


def test_number_rows_matches_a_plain_count(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    got = {r["id"]: r["n"] for r in shaping.number_rows(df, ["id"], ["g"]).collect()}
    seen, want = {}, {}
    for i in range(500):
        g = "hot" if i % 3 == 0 else f"g{i % 7}"
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want


def test_salted_join_equals_join(spark):
    left = spark.range(200).select("id", F.when(F.col("id") < 150, 1).otherwise(F.col("id") % 5).alias("k"))
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    a = shaping.salted_join(left, right, ["k"], salts=4)
    b = left.join(right, "k")
    assert sorted(map(tuple, a.select("id", "k", "v").collect())) == sorted(map(tuple, b.select("id", "k", "v").collect()))


def test_hash_order_is_a_permutation(spark):
    rows = shaping.hash_order(spark.range(300), "id", 5).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 301))


def test_contracts(spark):
    df = spark.createDataFrame([("a", "1.5"), ("b", "x")], "id string, v string")
    with pytest.raises(quality.DataValidationError):
        quality.assert_numeric(df, "v", ["id"])
    with pytest.raises(quality.DataValidationError):
        quality.assert_positive_int(df.filter("id = 'a'"), "v")
    with pytest.raises(quality.DataValidationError):
        quality.require_columns(df, ["missing"])
    ranks = spark.createDataFrame([("q", 1, 0), ("q", 3, 1), ("q", 2, 2)], "query_id string, rank int, ord int")
    with pytest.raises(quality.DataValidationError):
        quality.assert_monotonic(ranks)
    quality.assert_unique(ranks, ["query_id", "rank"])


GOLD = "query_id string, gold_id string, place_name string, area string, relevance int, ord int"
RECS = "query_id string, rank int, rec_name string, rec_area string"


def test_methods_and_greedy(spark):
    gold = spark.createDataFrame([("q", "g1", "Red Market", "강남구", 2, 1), ("q", "g2", "red-market", "", 3, 2), ("q", "g3", "Big Red Market", "강남구", 1, 3),
                                  ("z", "g9", "Nowhere", "중구", 3, 4)], GOLD)
    recs = spark.createDataFrame([("q", 1, "Red Market", "강남구"), ("q", 2, "red market", "강남구"), ("q", 3, "Red Market", "중구"), ("q", 4, "xx", "강남구")], RECS)
    rows = {(r["query_id"], r["k"]): r for r in evaluation.evaluate(gold, recs, [1, 3, 10]).collect()}
    assert rows[("q", 1)]["matched_gold_ids"] == "g1" and rows[("q", 1)]["match_methods"] == "exact"
    assert rows[("q", 3)]["matched_gold_ids"] == "g1;g2" and rows[("q", 3)]["match_methods"] == "exact;normalized"
    assert rows[("q", 10)]["recommended_count_at_k"] == 4 and rows[("q", 10)]["recall_at_k"] == pytest.approx(2 / 3)
    assert rows[("z", 10)]["hits"] == 0 and rows[("z", 10)]["ndcg_at_k"] == 0.0


def test_alias_is_one_hop_and_area_scoped(spark):
    table = spark.createDataFrame([("Alpha", "A", "강남구", "공원", "s", "", 1), ("Beta", "B", "", "공원", "s", "", 2)],
                                  "canonical_name string, alias_name string, area string, place_type string, source string, note string, ord int")
    aliases = candidates.alias_table(table)
    gold = spark.createDataFrame([("q", "g1", "A", "강남구", 3, 1), ("w", "g2", "A", "중구", 3, 2), ("e", "g3", "B", "중구", 3, 3)], GOLD)
    recs = spark.createDataFrame([("q", 1, "Alpha", "강남구"), ("w", 1, "Alpha", "중구"), ("e", 1, "Beta", "중구")], RECS)
    pairs = matching.match_pairs(matching.prepare_gold(gold), matching.prepare_recs(recs), aliases)
    assert {(r["query_id"], r["method"]) for r in pairs.collect()} == {("q", "alias"), ("e", "alias")}


def test_near_pairs_is_lossless(spark):
    left = ["grandmarket", "centralpark", "abcd", "riverside1", "oldtownhallsquare"]
    right = ["grandmarkets", "centralpork", "xxabcdxx", "riverside2", "oldtownhallsqare", "zzz", "grandmarket"]
    got = {(r["a"], r["b"]) for r in matching.near_pairs(spark.createDataFrame([(x,) for x in left], "k string"), spark.createDataFrame([(x,) for x in right], "g string"), "k", "g").collect()}
    same = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() >= 0.90
    assert got == {(a, b) for a in left for b in right if same(a, b)}


def _greedy(rows, k, w):
    left = sorted(rows, key=lambda r: (-r["base_final"], -r["base_score"], r["raw_rank"]))
    types, places, out = {}, {}, []
    while left and len(out) < k:
        adjusted = [r["base_final"] - w * (types.get(r["rec_type"], 0) * 0.7 + max(0, places.get(r["rec_area"], 0) - 2) * 0.3) for r in left]
        i = adjusted.index(max(adjusted))
        r = left.pop(i)
        out.append(r["raw_rank"])
        types[r["rec_type"]] = types.get(r["rec_type"], 0) + 1
        places[r["rec_area"]] = places.get(r["rec_area"], 0) + 1
    return out


@pytest.mark.parametrize("weight", [0.0, 0.1, 0.5])
def test_diverse_rerank_equals_the_loop(spark, weight):
    rows = [{"sig": s, "raw_rank": i, "base_score": (i * 37 % 11) / 10, "base_final": (i * 53 % 17) / 10, "rec_type": "ab"[i % 2] + str(i % 3), "rec_area": "xyz"[i % 3]}
            for s in ("p", "q") for i in range(1, 25)]
    df = spark.createDataFrame(rows, "sig string, raw_rank int, base_score double, base_final double, rec_type string, rec_area string")
    got = ranking.diverse_rerank(df, ("sig",), 10, weight).filter("sig = 'p'").orderBy("rank").collect()
    assert [r["raw_rank"] for r in got] == _greedy([r for r in rows if r["sig"] == "p"], 10, weight)


def test_grid_is_the_product(spark):
    rows = search.grid_trials(spark, ["a", "b"], [[1.0, 2.0], [0.1, 0.2, 0.3]]).orderBy("grid_id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1.0, 0.1), (1.0, 0.2), (1.0, 0.3), (2.0, 0.1), (2.0, 0.2), (2.0, 0.3)]
    trials = search.build_trials(spark, ["a", "b"], [[1.0, 2.0], [0.1, 0.2, 0.3]], [[1.0, 0.1]], "random", 6)
    assert trials.count() == 6 and trials.filter("trial_id = 1").first()["b"] == 0.1


def test_frozen_pool_order(spark):
    cand = spark.createDataFrame([("p", f"n{i:02d}", "중구", "market", str(i), 0.9 - i * 0.01, "market") for i in range(20)],
                                 "pool_id string, rec_name string, rec_area string, rec_type string, place_id string, base_score double, candidate_source string")
    alias = spark.createDataFrame([("p", "alias", "중구", "market", "a1", "alias_table:manual", 1), ("p", "n03", "중구", "market", "a2", "alias_table:manual", 2)],
                                  "pool_id string, rec_name string, rec_area string, rec_type string, place_id string, candidate_source string, alias_pos int")
    got = candidates.freeze_pools(cand, 12, alias).orderBy("raw_rank").collect()
    assert [r["rec_name"] for r in got] == [f"n{i:02d}" for i in range(10)] + ["alias", "n10"]
    assert got[10]["base_score"] == pytest.approx(0.8099)


def test_label_cascade(spark):
    rows = spark.createDataFrame([("1", "망원시장 방문", "망원시장", "마포구"), ("2", "방송 인터뷰", "스튜디오", "마포구"), ("3", "내부 회의", "사무실", "중구"),
                                  ("4", "정책 협약식", "시청", "중구"), ("5", "행사", "", "")], "gold_id string, event_title string, place_name string, area string")
    got = [r["label"] for r in goldset.normalize_gold(rows).orderBy("gold_id").collect()]
    assert got == [3, 1, 0, 2, 0]


def test_schedule_text(spark):
    text = "09:30 출근 인사 (강남역)\n많은 시민\n오후 2:00 시장 방문 - 망원시장"
    lines = goldset.schedule_lines(spark.createDataFrame([(1, text)], "id int, t string"), "t", ["id"])
    rows = goldset.parse_schedule_line(lines).orderBy("line_no").collect()
    assert [(r["time"], r["place_name"]) for r in rows] == [("09:30", "강남역"), ("14:00", "망원시장")]
    assert rows[0]["area"] == "강남구"


def test_merge_keeps_first_and_numbers(spark):
    cols = "actor string, date string, time string, area string, place_name string, event_title string, source_image string, ord int, source_group string, file_path string"
    old = spark.createDataFrame([("x", "2026-03-01", "9:00", "중구", "시장", "방문", "i", 1, "existing", "a")], cols)
    new = spark.createDataFrame([("x", "2026-03-01", "09:00", "중구", "시장", "방문", "i", 2, "new", "b"), ("x", "2026-03-02", "10:00", "중구", "공원", "방문", "i", 3, "new", "b")], cols)
    merged = goldset.merge_gold(old, new, {"x": "XX"})
    assert sorted(r["gold_id"] for r in merged.collect()) == ["XX_0001", "XX_0002"]
    report = {r["file_path"]: r["input_rows"] for r in goldset.merge_report(old, new, merged).collect()}
    assert report["duplicate_removed"] == 1 and report["final_rows"] == 2


def test_area_rules_differ(spark):
    rows = spark.createDataFrame([("a", "중구", "마포구"), ("b", "중구", "중구"), ("b", "중구", "마포구")], "sig string, area string, rec_area string")
    assert ranking.in_area(rows, "sig").count() == 1
    assert ranking.area_or_all(rows).count() == 2


def _pool(spark):
    rows = [(f"place {i}", a, t, "", None, None, 1.0 - i / 100, "market_csv") for i, (a, t) in enumerate([("중구", "market"), ("중구", "park"), ("마포구", "market"), ("중구", "subway")])]
    return routes.unified_pool([spark.createDataFrame(rows, "place_name string, area string, place_type string, address string, lat double, lng double, score double, source string")])


def _ask(spark, n, areas):
    return routes.parse_requests(spark.createDataFrame([(1, areas, n)], "route_id int, areas array<string>, num_visits int"))


def test_route_real_rows_before_fillers(spark):
    req = _ask(spark, 6, ["마포구", "중구"])
    found = routes.route_candidates(req, _pool(spark))
    stops = routes.build_routes(req, found)
    got = stops.orderBy("order").collect()
    assert len(got) == 6 and [r["is_fallback"] for r in got] == [False] * 4 + [True] * 2
    assert {r["area"] for r in got} <= {"중구", "마포구"}
    safe = quality.area_safety(stops.withColumn("selected_areas", F.array(F.lit("중구"), F.lit("마포구")))).first()
    assert safe["mismatches"] == 0 and safe["fillers_last"]
    assert [r["place_name"] for r in found.orderBy("pos").limit(2).collect()] == ["place 2", "place 0"]
    assert routes.route_summary(req, stops).first()["num_visits"] == 6


def test_bad_time_window(spark):
    req = spark.createDataFrame([(1, "18:00", "09:00")], "route_id int, start_time string, end_time string")
    assert routes.bad_time_windows(req).count() == 1


def test_recency(spark):
    stops = spark.createDataFrame([("2026-05-20", "A", "중구")], "day string, place_name string, area string").withColumn("day", F.to_date("day"))
    visits = spark.createDataFrame([("2026-05-18", "A", "중구"), ("2026-05-01", "A", "중구"), ("2026-01-01", "A", "중구"), ("2026-05-10", "B", "중구"), ("2026-05-25", "B", "중구")],
                                   "visit_date string, place_name string, area string")
    assert routes.recency_penalty(stops, visits).first()["visit_penalty"] == pytest.approx(-(0.5 + 0.3 + 0.12 + 0.1))


def test_geocode_pick(spark):
    rows = spark.createDataFrame([(1, 1, 10.0, 10.0, "서울", "", "중구"), (1, 2, 37.5, 127.0, "서울 마포구", "마포구", "중구"), (1, 3, 37.6, 127.0, "서울 중구", "중구", "중구")],
                                 "request_id int, seq int, lat double, lng double, address string, result_area string, expected_area string")
    r = coords.pick_geocode(rows).first()
    assert (r["lat"], r["invalid_coordinates"], r["area_rejected"]) == (37.6, 1, 1)


def test_template_route_beats_all_combinations(spark):
    item = "slot string, age_group string, place_type string, name string, place_id string, area string, score double, raw_score double, reasons array<string>"
    rows = [(s, "20_40", t, f"{t}{i}" if t != "subway" else f"st{i}", str(i), "중구" if i % 2 else "마포구", 0.9 - i / 10, 0.9 - i / 10, [f"interaction_score=0.{5 + i}0 x"])
            for s, t in [("morning", "subway"), ("afternoon", "park"), ("afternoon", "senior_friendly"), ("afternoon", "subway")] for i in range(3)]
    best = templates.best_template_routes(spark.createDataFrame(rows, item), {"default": [("07:00", "morning", "subway"), ("11:00", "afternoon", "park"),
                                                                                          ("14:00", "afternoon", "senior_friendly"), ("18:00", "afternoon", "subway")]}).first()
    assert best["c1"]["name"] != best["c4"]["name"] and 0 < best["route_score"] <= 1


def test_before_after(spark):
    b = spark.createDataFrame([("m", 0.0), ("n", 0.5)], "metric string, value double")
    a = spark.createDataFrame([("m", 0.2), ("n", 0.5)], "metric string, value double")
    got = {r["metric"]: (r["relative_change"], r["interpretation"]) for r in diagnostics.before_after(b, a).collect()}
    assert got["m"][0] == 1.0 and "did not change" in got["n"][1]


def test_scores_stay_in_range(spark):
    parks = spark.createDataFrame([("1", "A", "중구", 100.0, "광장 문화", 37.5, 127.0), ("2", "B", "부산", None, None, None, None)],
                                  "place_id string, name string, area string, area_sqm double, main_facilities string, latitude double, longitude double")
    rows = scoring.score_places({"park": parks}).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert any("context keyword match: 광장, 문화" in r["reasons"] for r in rows)


def test_recency_ignores_visits_without_area(spark):
    stops = spark.createDataFrame([("2024-05-10", "p", "")], "day string, place_name string, area string").selectExpr("to_date(day) AS day", "place_name", "area")
    visits = spark.createDataFrame([("2024-05-09", "p", "")], "visit_date string, place_name string, area string")
    assert routes.recency_penalty(stops, visits).first()["visit_penalty"] == -0.5


def test_window_that_ends_before_it_starts_fails(spark):
    rows = spark.createDataFrame([(1, ["a"], 3, "10:00", "09:00")], "route_id int, areas array<string>, num_visits int, start_time string, end_time string")
    with pytest.raises(Exception, match="bad time window"):
        routes.parse_requests(rows).collect()


def test_swaps_count_each_name_once(spark):
    stops = spark.createDataFrame([(1, 1, "a", "t0", "own")], "route_id int, order int, area string, place_type string, raw_place_name string")
    names = [("own", f"t{i}") for i in range(6)] + [(f"n{i}", "t9") for i in range(4)]
    pool = spark.createDataFrame([(n, "a", t, "", None, None, 1.0, "s", 1, False, i) for i, (n, t) in enumerate(names)],
                                 "place_name string, area string, place_type string, address string, lat double, lng double, score double, source string, priority int, is_fallback boolean, i int")
    assert routes.swap_options(stops, pool, 4).count() == 4
