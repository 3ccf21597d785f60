"""Steps that must not grow with their input: bounded top lists, records parsed once, requests that stay apart."""

import re

from pyspark.sql import functions as F

from placewright.operators import ablation, blocks, diagnostics, evaluation, goldset, matching, ranking, routes, shaping
from placewright.sources import files


def test_first_by_score_equals_first_per(spark):
    """Ties, nulls, NaN and scores outside 0..1; a low row never reaches the sort."""
    odd = [None, float("nan"), -1.0, 0.0, 0.12345, 0.123451, 0.5, 1.0, 2.0, 3.0]
    rows = [(["a", "b", None][i % 3], odd[i % 10], f"n{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s double, name string, id int")
    for n in (1, 5, 40, 200):
        want = shaping.first_per(df, ["k"], [F.desc("s"), "name", "id"], n, "p").select("k", "id", "p").collect()
        got = shaping.first_by_score(df, ["k"], "s", ["name", "id"], n, "p").select("k", "id", "p").collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_context_pool_sorts_only_the_top(spark):
    from placewright.operators import candidates

    df = spark.createDataFrame([("s", "a", "t", i / 1000, f"n{i}", str(i)) for i in range(1000)], "slot string, age_group string, place_type string, raw_score double, name string, place_id string")
    pool = candidates.context_pool(df, 5)
    assert sorted(r.name for r in pool.collect()) == [f"n{i}" for i in range(995, 1000)]
    assert "_cut" in pool._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_once(spark):
    docs = spark.createDataFrame([('{"items": [{"place_name": "x", "region": "r", "score": 0.5}]}',)], "value string")
    found = files.flatten_json_records(docs, "value")
    assert [tuple(r)[:2] for r in found.collect()] == [("x", "r")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(re.findall("from_json", line)) for line in plan.splitlines()) <= 1


def test_requests_are_not_sent_whole(spark, tmp_path):
    """Requests that pack well on disk are met by a shuffle, not broadcast."""
    ids = spark.range(2000).select(
        F.col("id").alias("route_id"), F.lit("2024-01-25").alias("date"), F.lit("09:00").alias("start_time"), F.lit("18:30").alias("end_time"), F.lit("").alias("start_location"),
        F.array(F.lit("a"), F.lit("b")).alias("areas"), F.lit("x").alias("target_group"), F.lit("").alias("goal"), F.array(F.lit("park")).alias("preferred_types"), F.lit(2).alias("num_visits"))
    routes.parse_requests(ids, ["a", "b"]).write.parquet(str(tmp_path / "r"))
    req = spark.read.parquet(str(tmp_path / "r"))
    pool = spark.createDataFrame([(f"p{i}", "ab"[i % 2], "park", "", None, None, 0.5, "park_csv") for i in range(6)],
                                 "place_name string, area string, place_type string, address string, lat double, lng double, score double, source string")
    pool = routes.unified_pool([pool], ["a", "b"])
    found = routes.route_candidates(req, pool, None, ["a", "b"])
    stops = routes.build_routes(req, found, None, ["a", "b"], {})
    assert stops.count() == 4000
    plan = stops._jdf.queryExecution().sparkPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin [route_id" in line and "Inner" in line]
    assert "SortMergeJoin [route_id" in plan and not sent
    assert routes.candidate_debug(req, pool, found).filter("after_filter = 6 and strict_count = 6 and real_count = 2").count() == 2000


PAIRED = "query_id string, sig string, gold_id string, place_name string, area string, relevance int, ord int"


def _paired(spark):
    gold = [(f"q{i}", f"s{i % 2}", f"g{i}", ["Alpha", None, "city park", "Beta"][i % 4], ["A", "", None][i % 3], 1 + i % 3, i) for i in range(48)]
    recs = [(f"s{i % 2}", i // 2 + 1, ["Alpha", "Gamma", "park", "Beta"][i // 2 % 4], "AB"[i // 2 % 2]) for i in range(12)]
    return spark.createDataFrame(gold, PAIRED), spark.createDataFrame(recs, "sig string, rank int, rec_name string, rec_area string")


def test_texts_are_compared_once_per_list(spark, monkeypatch):
    """Keys and areas are made for distinct texts; sending hashes of matched texts or not gives the same pairs."""
    gold, recs = _paired(spark)
    g, r = matching.prepare_gold(gold, "sig", ["A", "B"]), matching.prepare_recs(recs, "sig", areas=["A", "B"])
    assert matching.gold_texts(g).count() == 12 < gold.count()
    rows = lambda: sorted(map(tuple, matching.match_pairs(g, r).select("query_id", "rank", "gold_id", "method").collect()))
    sent = rows()
    monkeypatch.setattr(matching, "MARKS", 0)
    assert sent == rows() and {m for *_, m in sent} == {"exact", "partial"}
    want = [(x.query_id, y["rank"], x.gold_id) for x in gold.collect() for y in recs.collect() if x.sig == y.sig and x.place_name and (not x.area or x.area == y.rec_area)
            and (x.place_name == y.rec_name or (x.place_name, y.rec_name) == ("city park", "park"))]
    assert [x[:3] for x in sent] == sorted(want)


def test_alias_keys_meet_in_their_area_only(spark):
    """A name that has an alias in many areas opens one edge per compared pair, not one per area."""
    edges = [("x", "y", f"area{i}") for i in range(25)] + [("u", "t", ""), ("v", "t", "area1")]
    aliases = spark.createDataFrame(edges, "canonical_key string, alias_key string, std_area string")
    names = spark.createDataFrame([("x", "y", "area1"), ("x", "y", "none"), ("u", "v", "area1"), ("u", "v", "area2"), ("t", "u", "area9")], "g_key string, r_key string, where string")
    assert sorted(map(tuple, matching.alias_hits(names, aliases).collect())) == [("t", "u", "area9"), ("u", "v", "area1"), ("x", "y", "area1")]


def test_evaluation_runs_once(spark, monkeypatch):
    """The rows of the ablations are read twice and evaluated once; each value of ``by`` keeps its own picks."""
    gold, recs = _paired(spark)
    both = recs.withColumn("model", F.lit("a")).unionByName(recs.filter("rank > 2").withColumn("model", F.lit("b")))
    rows = evaluation.evaluate(gold, both, [1, 6], "sig", by="model", by_values=["a", "b", "c"], areas=["A", "B"])
    one = {m: {(x.query_id, x.k): (x.hits, x.recommended_count_at_k) for x in evaluation.evaluate(gold, both.filter(F.col("model") == m).drop("model"), [1, 6], "sig", areas=["A", "B"]).collect()} for m in "abc"}
    got = rows.collect()
    assert len(got) == 48 * 2 * 3 and all((x.hits, x.recommended_count_at_k) == one[x.model][(x.query_id, x.k)] for x in got)
    cuts = []
    monkeypatch.setattr(ablation, "cut_lineage", lambda df: cuts.append(df) or df)
    feats = recs.selectExpr("sig", "rank as raw_rank", "rec_name", "rec_area", "rec_area as area", "'x' as place_type", "'' as candidate_source", "0.5 as base_score", *[f"0.1 as {c}" for c in ranking.TUNED_FEATURES if c != "base_score"])
    ablation.leave_one_out(feats, gold, [1.0] * len(ranking.TUNED_FEATURES), ["x"], areas=["A", "B"])
    assert len(cuts) == 1


def test_merge_normalises_a_text_once(spark, monkeypatch):
    """Keys are made from distinct texts; only the rows that stand for a key are normalised whole."""
    cols = "actor string, date string, time string, place_name string, area string, event_title string, source_image string, ord long, file_path string"
    rows = spark.createDataFrame([(["a", "b", None][i % 3], "1996-01-02", "09:00", "hall", ["A", None][i % 2], "t", "", i // 2 if i % 5 else None, "f") for i in range(60)], cols)
    sizes, whole = [], goldset.normalize_gold
    monkeypatch.setattr(goldset, "normalize_gold", lambda df, *a: sizes.append(df.count()) or whole(df, *a))
    kept, told = goldset.merge_again(None, rows, None)
    assert sizes[0] == 6 and sizes[1] < 20 and told.count() == 60 and kept.count() == kept.select(*goldset.MERGE_KEY).distinct().count()
    again, second = goldset.merge_again(kept, rows, None)
    assert again.count() == kept.count() and second.filter("is_kept").count() == 0 and second.count() == 60


def test_cosine_reads_left_vectors_once(spark):
    vec = lambda rows: spark.createDataFrame(rows, "doc string, token string, w double")
    pairs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "left_doc string, right_doc string")
    out = ranking.pair_cosine(pairs, vec([("a", "t", 3.0), ("a", "u", 4.0), ("b", "u", 1.0)]), vec([("x", "t", 2.0)]))
    assert {r.left_doc: round(r.semantic, 6) for r in out.collect()} == {"a": 0.6, "b": 0.0, "c": 0.0}
    # One scan of the left vectors, two of the right ones.
    assert len(re.findall(r"LogicalRDD \[doc", out._jdf.queryExecution().optimizedPlan().toString())) == 3


def test_cosine_of_blocks_equals_that_of_rows(spark, monkeypatch):
    """Documents without text, words or key, several texts of a key, tokens in many documents; a block of tokens is dealt out once."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    lists = [["a", "b", "a"], [], None, ["c"], ["a", "é", "c", "c"], ["b"] * 9, ["zz"]]
    rows = [(f"d{i}", lists[i % 7]) for i in range(40)] + [("d1", ["a", "zz"]), ("d3", ["c"]), (None, ["a"]), (None, ["c"])]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>").repartition(3)
    right = spark.createDataFrame([("x", ["a", "b"]), ("y", ["c", "q", "c"]), ("z", [])], "doc string, tokens array<string>").withColumn("copies", F.lit(1))
    pairs = spark.createDataFrame([(f"d{i}", "xyz"[i % 3]) for i in range(40)] + [("d4", "x"), ("d4", None), ("none", "x")], "left_doc string, right_doc string")
    packed = ranking.token_blocks(docs).localCheckpoint()
    idf = ranking.token_idf(packed.select("tokens", "counts", "copies").unionByName(right.select("tokens", "copies"), allowMissingColumns=True))
    plain = ranking.token_idf(docs.withColumn("copies", F.lit(1)).unionByName(right))
    told = lambda df: {r.token: (r.df, round(r.idf, 9)) for r in df.collect()}
    assert told(idf) == told(plain) and packed.count() > 5
    joined = docs.groupBy("doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    cos = lambda left, i: sorted(((r.left_doc, r.right_doc or "", round(r.semantic, 9)) for r in ranking.pair_cosine(pairs, ranking.doc_vectors(left, i), ranking.doc_vectors(right, i)).collect()))
    got = cos(packed, idf)
    assert got == cos(joined, plain) and len({s for *_, s in got}) > 4


def test_coverage_matches_both_lists_at_once(spark, monkeypatch):
    """Items of several rows share their best rank, odd ids included; sending hashes or not gives the same rows."""
    gold, recs = _paired(spark)
    again = gold.filter("ord % 5 = 0").withColumn("place_name", F.lit("Alpha")).unionByName(gold.filter("ord % 7 = 0").withColumn("place_name", F.lit("nowhere")))
    odd = gold.filter("ord < 6").withColumn("gold_id", F.concat(F.lit(" "), "gold_id")).unionByName(gold.filter("ord > 40").withColumn("gold_id", F.lit(None).cast("string")))
    gold = gold.unionByName(again).unionByName(odd).unionByName(gold.limit(2))
    raw, final = recs.withColumn("raw_rank", F.col("rank") + 3), recs.filter("rank % 2 = 1")
    want = gold.withColumn("gold_item", F.col("gold_id"))
    for df, rank, name in ((raw, "raw_rank", "best_raw_rank"), (final, "rank", "best_final_rank")):
        want = want.join(diagnostics.best_ranks(gold, df, rank, name, "sig", areas=["A", "B"]), ["query_id", "gold_item"], "left")
    cols = ["query_id", "gold_id", "best_raw_rank", "best_final_rank"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    calls, real = [], matching.text_pairs
    monkeypatch.setattr(matching, "text_pairs", lambda *a: calls.append(1) or real(*a))
    want = rows(want)
    calls.clear()
    got = diagnostics.coverage(gold, raw, final, "sig", areas=["A", "B"])
    assert rows(got) == want and len(calls) == 1 and got.filter("raw_candidate_count = 6").count() == gold.count()
    assert got.filter("best_raw_rank is null").count() > 0 and got.filter("best_raw_rank is not null").count() > 0
    monkeypatch.setattr(diagnostics, "MARKS", 0)
    assert rows(diagnostics.coverage(gold, raw, final, "sig", areas=["A", "B"])) == want
    monkeypatch.setattr(matching, "MARKS", 0)
    assert rows(diagnostics.coverage(gold, raw, final, "sig", areas=["A", "B"])) == want
