"""Column expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from placewright.functions import areas, numbers, text, times


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [
    ("Main St. #1", "mainst1"), ("ＡＢ１２ 시장", "ab12시장"), (None, ""), ("  전통 시장(입구) ", "전통시장입구")])
def test_place_key(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.place_key("v")).first()[0] == want
    assert df.select(text.place_key_nfkc("v")).first()[0] == want


def test_nfkc_only_changes_unusual_text(spark):
    df = spark.createDataFrame([("① 시장",)], "v string")
    assert df.select(text.place_key_nfkc("v")).first()[0] == "1시장"


@pytest.mark.parametrize("a, b, want", [("가나다", "가나다라", True), ("가나", "가나다", False), ("전통가나다시장", "가나다시장", True), ("abc", "xyz", False)])
def test_partial_match(spark, a, b, want):
    assert one(spark, text.partial_match(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("value, want", [
    ("서울특별시 강남구 역삼동", "강남구"), ("강남", "강남구"), ("서울", None), ("nan", None), ("", None), ("부산", "부산"), ("서초구,", "서초구"), ("xx마포yy", "마포구")])
def test_norm_area(spark, value, want):
    assert one(spark, areas.norm_area("v"), v=value) == want


def test_area_from_context_and_name(spark):
    df = spark.createDataFrame([("", "여의도 공원 행사")], "a string, t string")
    assert df.select(areas.area_from_context("a", "t")).first()[0] == "영등포구"
    names = spark.createDataFrame([("사당",), ("구의(광진구청)",), ("어딘가",), ("수유(x)",)], "n string")
    assert [r[0] for r in names.select(areas.area_from_name("n")).collect()] == ["동작구", "광진구", None, "강북구"]


def test_start_area_and_relation(spark):
    assert one(spark, areas.start_area("v"), v="성동구청 앞") == "성동구"
    assert one(spark, areas.relation(F.col("a"), F.col("b")), a="중구", b="마포구") == "far"
    assert one(spark, areas.relation(F.col("a"), F.col("b")), a="강동구", b="송파구") == "adjacent"


@pytest.mark.parametrize("value, want", [("9:5", "09:05"), ("930", "09:30"), ("25:00", "25:00"), ("", ""), ("noon", "noon")])
def test_norm_time(spark, value, want):
    assert one(spark, times.norm_time("v"), v=value) == want


@pytest.mark.parametrize("value, want", [("오후 3:30", "15:30"), ("오전 12:10", "00:10"), ("PM 1.05", "13:05"), ("14시 5분", "14:05"), ("7시", "07:00"), ("x", "x")])
def test_norm_time_locale(spark, value, want):
    assert one(spark, times.norm_time_locale("v"), v=value) == want


@pytest.mark.parametrize("value, want", [("2026.3.1", "2026-03-01"), ("20260310", "2026-03-10"), ("3/10/2026", "2026-03-10"), ("bad", "bad"), ("", "")])
def test_norm_date(spark, value, want):
    assert one(spark, times.norm_date("v"), v=value) == want


def test_dates(spark):
    assert one(spark, times.date_from_name("v"), v="shot_20260312_1.png") == "2026-03-12"
    assert one(spark, times.date_from_name("v"), v="a 0405.png") == "2026-04-05"
    assert one(spark, times.day_of_week("v"), v="2026-03-09") == "월"
    assert one(spark, times.d_day("v"), v="2026-06-01") == "D-2"


def test_time_slots(spark):
    df = spark.createDataFrame([("09:00", "18:00", 4), ("09:00", "18:00", 0)], "s string, e string, n int")
    assert [r[0] for r in df.select(times.time_slots("s", "e", "n")).collect()] == [["09:00", "12:00", "15:00", "18:00"], ["09:00"]]


def test_numbers(spark):
    assert one(spark, text.leading_number("v"), v="1,234.5㎡") == 1234.5
    assert one(spark, numbers.bounded(F.lit(3.0))) == 1.0
    assert one(spark, numbers.fit_label(F.lit(2.5))) == "적합도 보통"
    assert one(spark, numbers.min_max_mean(F.lit(2.0), F.lit(1.0), F.lit(3.0))) == 0.5
    assert one(spark, numbers.blend(F.lit(None).cast("double"), F.lit(0.4), F.lit(0.6))) == 0.5
    km = one(spark, numbers.haversine_km(F.lit(37.5), F.lit(127.0), F.lit(37.5), F.lit(127.0)))
    assert km == 0.0
    assert one(spark, numbers.route_minutes(F.lit(9.0), F.lit(3))) == 46


def test_display_name(spark):
    rows = spark.createDataFrame([("강남", "subway"), ("중구", "park"), ("사당역", "subway"), ("망원시장", "market"), ("", "park")], "n string, t string")
    got = [r[0] for r in rows.select(text.display_name("n", "t")).collect()]
    assert got == ["강남역 11번 출구 앞", "중구 주요 유세 거점", "사당역 출구 앞", "망원시장 입구", "장소 확인 필요"]


def test_place_key_is_the_nfkc_key(spark):
    """Decomposed Hangul, circled digits, superscripts, ligatures, marks and width variants against Python's NFKC."""
    import random
    import re
    import unicodedata

    rng = random.Random(2)
    pool = "aZ9 가힣강남역①⑩²½ﬁ№ｶＡ１ㄱㅏㄴ한가éñx́éÉㅎㅏㄴﾡￂ-_/()😀"
    values = ["강남역", "①번 출구", "²층", "제⑩회 ㈜가", "", None]
    values += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    want = [re.sub("[^0-9a-z가-힣]", "", unicodedata.normalize("NFKC", (v or "").strip(" ")).lower()) for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.k for r in rows.select("i", text.place_key("v").alias("k")).orderBy("i").collect()]
    assert [(v, g, w) for v, g, w in zip(values, got, want) if g != w] == []
    assert want[:3] == ["강남역", "1번출구", "2층"]
