"""Readers, writers and streaming jobs on temporary folders."""

import json
import random

from pyspark.sql import functions as F, types as T

from placewright.sources import files
from placewright.streaming import jobs


def test_csv_strings_keep_blanks_and_drop_bom(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿id,name\n1,\n2,nan\n".encode("utf-8"))
    df = files.read_csv_strings(spark, str(p))
    assert df.columns == ["id", "name"] and [r["name"] for r in df.orderBy("id").collect()] == ["", "nan"]


def test_csv_pruned_picks_columns(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("id,name,extra\n1,x,y\n", encoding="utf-8")
    assert files.read_csv_pruned(spark, str(p), ["name"], encodings=("UTF-8",)).columns == ["name"]


def test_discover_and_dir(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two_manual_reviewed.csv").write_text("a,c\n1,2\n")
    assert [f.rsplit("/", 1)[-1] for f in files.discover_by_schema(spark, [str(tmp_path / "*.csv")], ["a", "b"])] == ["one.csv"]
    assert files.read_dir(spark, str(tmp_path)).columns == ["a", "c", "source_file"]


def test_json_rows_and_records(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"items": [{"name": "x", "rank": 1}]}))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("rank", T.IntegerType())])
    assert [tuple(r) for r in files.read_rows_json(spark, str(p), schema).collect()] == [("x", 1)]
    doc = json.dumps({"a": [{"name": "p", "district": "중구", "inner": {"title": "q", "region": "마포구", "lat": 37.5}}], "b": 1})
    got = files.flatten_json_records(spark.createDataFrame([(doc,)], "j string"), "j")
    assert sorted((r["place_name"], r["area"]) for r in got.collect()) == [("p", "중구"), ("q", "마포구")]


def test_numeric_map_and_optional(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text('{"a": 1.5, "b": "x"}')
    assert files.read_numeric_map(spark, str(p)).first()["summary"] == {"a": 1.5}
    assert files.read_numeric_map(spark, str(tmp_path / "none.json")).first()["summary"] == {}
    assert files.read_optional(spark, str(tmp_path / "none"), T.StructType([T.StructField("a", T.StringType())])).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "actor string, n int")
    files.write_partitioned(df, str(tmp_path / "p"), files_per_key=2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.append_log(df, str(tmp_path / "l"))
    files.append_log(df, str(tmp_path / "l"))
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == 4
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv_strings(spark, str(tmp_path / "c")).columns == ["actor", "n"]


def _land(df, folder, n):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_daypart_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts, 'x' AS area, cast(id AS double) AS value FROM range(60)")
    _land(rows, tmp_path / "in", 1)
    stream = jobs.daypart_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), delay="1 hour")
    jobs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {str(r["day"])[:10]: r["morning_population"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2026-01-01"] == sum(range(6, 11)) and got["2026-01-02"] == sum(range(30, 35))


def test_dedupe_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS ts, id % 3 AS k FROM range(9)")
    _land(rows, tmp_path / "in", 1)
    stream = jobs.dedupe_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"])
    jobs.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_forecast_stream_emits_late_misses(spark, tmp_path):
    p_schema = "list_id string, rank int, target_ts timestamp, actor string, place_name string, area string"
    v_schema = "visit_id long, visit_ts timestamp, actor string, place_name string, area string"
    ts = lambda d: f"timestamp'2026-01-{d:02d} 00:00:00'"
    land = lambda sql, schema, name: _land(spark.sql(sql).to(T._parse_datatype_string(schema)), tmp_path / name, 1)
    land(f"SELECT * FROM VALUES ('l', 1, {ts(1)}, 'a', 'Hall', '중구'), ('l', 2, {ts(1)}, 'b', 'Park', '중구') t(list_id, rank, target_ts, actor, place_name, area)", p_schema, "p")
    land(f"SELECT * FROM VALUES (7L, {ts(2)}, 'a', 'Hall 앞', '중구') t(visit_id, visit_ts, actor, place_name, area)", v_schema, "v")
    read = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
    run = lambda: jobs.run_to_files(jobs.forecast_stream(read("p", p_schema), read("v", v_schema), 3), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    land(f"SELECT * FROM VALUES ('m', 1, {ts(20)}, 'c', 'X', '중구') t(list_id, rank, target_ts, actor, place_name, area)", p_schema, "p")
    land(f"SELECT * FROM VALUES (8L, {ts(20)}, 'd', 'Y', '중구') t(visit_id, visit_ts, actor, place_name, area)", v_schema, "v")
    run()
    got = {(r["list_id"], r["rank"]): r["match_type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("l", 1)] == "exact_place_match" and got[("l", 2)] == "no_match"


def test_recent_visits_counts_match(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 12:00:00' + make_interval(0,0,0,cast(id AS int)) AS ts, 'a' AS actor, 'p' AS place_name FROM range(3)")
    _land(rows, tmp_path / "in", 1)
    stream = jobs.recent_visits_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), days=7)
    q = stream.writeStream.format("memory").queryName("recent").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("recent").agg(F.max("visits")).first()[0] == 3


def test_read_dir_joins_by_name_at_any_depth(spark, tmp_path):
    (tmp_path / "x" / "y" / "z").mkdir(parents=True)
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "x" / "two.csv").write_text("b,a\n9,8\n")
    (tmp_path / "x" / "y" / "z" / "three.csv").write_text("a,c\n5,6\n")
    rows = files.read_dir(spark, str(tmp_path)).select("a", "b", "c", "source_file").collect()
    assert sorted(map(tuple, rows)) == [("1", "2", "", "one.csv"), ("5", "", "6", "three.csv"), ("8", "9", "", "two.csv")]


def test_json_records_at_any_depth(spark):
    import json

    deep = {"name": "n", "district": "d"}
    for i in range(9):
        deep = {"k": [deep]} if i % 2 else {"k": deep, "note": "]]}}"}
    rows = spark.createDataFrame([(json.dumps(deep),), (json.dumps([{"place_name": "p", "region": "r"}]),), ("{}",)], "v string")
    got = files.flatten_json_records(rows, "v").select("place_name", "area").collect()
    assert sorted(map(tuple, got)) == [("n", "d"), ("p", "r")]


def test_readers_of_several_files_keep_quoted_line_breaks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n"one\ntwo",3\n')
    for df in (files.read_dir(spark, str(tmp_path), multi_line=True), files.read_files_tagged(spark, [str(p)], "g", multi_line=True)):
        assert [(r.a, r.b) for r in df.collect()] == [("one\ntwo", "3")]


def test_best_forecast_stream_equals_batch(spark, tmp_path):
    """Each prediction comes out once, with the visit that the batch operator picks; late visits and misses included."""
    from placewright.operators.forecast import forecast_matches

    rng = random.Random(5)
    places = ["Hall", "Great Hall", "Park", "Station", "시장"]
    stamp = lambda day, hour: f"timestamp'2026-01-{day:02d} {hour:02d}:30:00'"
    preds = [(f"l{i // 3}", i % 3, 1 + i % 6, rng.choice(["a", "b", ""]), rng.choice(places), rng.choice(["중구", "종로구"])) for i in range(24)]
    seen = [(i, 1 + i % 9, rng.randint(0, 23), rng.choice(["a", "b", "", "c"]), rng.choice(places), rng.choice(["중구", "종로구", ""])) for i in range(40)]
    p_sql = lambda rows: "SELECT * FROM VALUES " + ", ".join(f"('{l}', {r}, timestamp'2026-01-{d:02d} 00:00:00', '{a}', '{n}', '{g}')" for l, r, d, a, n, g in rows) + " t(list_id, rank, target_ts, actor, place_name, area)"
    v_sql = lambda rows: "SELECT * FROM VALUES " + ", ".join(f"({i}L, {stamp(d, h)}, '{a}', '{n}', '{g}')" for i, d, h, a, n, g in rows) + " t(visit_id, visit_ts, actor, place_name, area)"
    p_schema, v_schema = spark.sql(p_sql(preds)).schema, spark.sql(v_sql(seen)).schema
    read = lambda n, s: spark.readStream.schema(s).parquet(str(tmp_path / n))
    run = lambda: jobs.run_to_files(jobs.best_forecast_stream(read("p", p_schema), read("v", v_schema), 2), str(tmp_path / "out"), str(tmp_path / "ck"))
    _land(spark.sql(p_sql(preds)), tmp_path / "p", 1)
    half = sorted(seen, key=lambda v: v[1])
    for part in (half[20:30], half[:20] + half[30:]):  # some days arrive after later ones
        _land(spark.sql(v_sql(part)), tmp_path / "v", 1)
    run()
    for i in range(3):  # the watermark moves on
        _land(spark.sql(p_sql([("end", i, 25 + i, "z", "none", "중구")])), tmp_path / "p", 1)
        _land(spark.sql(v_sql([(900 + i, 25 + i, 1, "y", "other", "종로구")])), tmp_path / "v", 1)
        run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("list_id <> 'end'").select("list_id", "rank", "match_type", "relevance", "matched_place", "visit_id").collect()]
    batch = forecast_matches(spark.sql(p_sql(preds)).withColumn("target_date", F.to_date("target_ts")), spark.sql(v_sql(seen)).withColumn("visit_date", F.to_date("visit_ts")), 2, 9)
    want = [tuple(r) for r in batch.select("list_id", "rank", "match_type", "relevance", "matched_place", "visit_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"no_match", "exact_place_match", "alias_match"} <= {r[2] for r in got}


def test_penalty_stream_equals_batch(spark, tmp_path):
    from placewright.operators.routes import recency_penalty

    rng = random.Random(9)
    day = lambda n: f"timestamp'2026-01-01 09:00:00' + make_interval(0, 0, 0, {n})"
    sql = lambda rows: "SELECT * FROM VALUES " + ", ".join(f"({day(d)}, '{p}', '{a}')" for d, p, a in rows) + " t(ts, place_name, area)"
    seen = sorted((rng.randint(0, 80), rng.choice("pqr"), rng.choice(["중구", "종로구", ""])) for _ in range(120))
    stops = sorted({(rng.randint(0, 78), rng.choice("pqrs"), rng.choice(["중구", "종로구", ""])) for _ in range(40)})
    schema = spark.sql(sql(seen)).schema
    read = lambda n: spark.readStream.schema(schema).parquet(str(tmp_path / n))
    run = lambda: jobs.run_to_files(jobs.penalty_stream(read("s"), read("v")), str(tmp_path / "out"), str(tmp_path / "ck"))
    for low in range(0, 100, 40):
        inside = lambda rows: [r for r in rows if low <= r[0] < low + 40]
        for name, rows in (("s", inside(stops)), ("v", inside(seen))):
            if rows:
                _land(spark.sql(sql(rows)), tmp_path / name, 1)
        run()
    for i in range(2):
        _land(spark.sql(sql([(120 + i, "end", "중구")])), tmp_path / "v", 1)
        run()
    got = {(str(r["day"]), r["place_name"], r["area"]): r["visit_penalty"] for r in jobs.penalty_of(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {}
    for d, p, a in stops:
        past = spark.sql(sql([s for s in seen if s[0] <= d] or [(200, "none", "")])).withColumn("visit_date", F.to_date("ts"))
        stop = spark.sql(sql([(d, p, a)])).withColumn("day", F.to_date("ts"))
        r = recency_penalty(stop, past).first()
        want[str(r["day"]), p, a] = r["visit_penalty"]
    assert got == want
