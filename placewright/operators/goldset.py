"""Observed schedules -> labelled gold set -> evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import area_from_context
from placewright.functions.text import (
    all_rules, clean, clean_nullish, clean_place_name, contains_any, first_rule, join_context, normalise_actor, place_key,
    split_tokens)
from placewright.functions.times import d_day, date_from_name, day_of_week, norm_date, norm_time, norm_time_locale, time_slot4
from placewright.operators import quality
from placewright.operators.shaping import (
    composite_key, dedupe_keep_blank, first_per, long_query_id, number_rows, query_id, sequential_ids, trim_all_strings, union_all)
from placewright.session import cut_lineage
from placewright.sources.contracts import GOLD, GOLD_REVIEW


def infer_place_type(text: Column, rules=None) -> Column:
    return first_rule(text, rules or fv.PLACE_TYPE_RULES, fv.PLACE_TYPE_DEFAULT)


def infer_activity(text: Column, rules=None) -> Column:
    return first_rule(text, rules or fv.ACTIVITY_RULES, fv.ACTIVITY_DEFAULT)


def infer_targets(text: Column, rules=None) -> Column:
    """Target groups joined by ``;``; a general group when none is named."""
    found = all_rules(text, rules or fv.TARGET_RULES)
    return F.when(F.size(found) == 0, fv.TARGET_DEFAULT).otherwise(F.array_join(found, ";"))


def presence(text: Column) -> Column:
    """online / offline / hybrid / unknown by an ordered cascade."""
    low = F.lower(text)
    out = None
    for name, words in fv.PRESENCE_RULES_LOWER:
        out = F.when(contains_any(low, words), name) if out is None else out.when(contains_any(low, words), name)
    for name, words in fv.PRESENCE_RULES:
        out = out.when(contains_any(text, words), name)
    return out.otherwise("unknown")


def assign_label(text: Column, presence_col: Column, place: Column, area: Column) -> Column:
    """0-3: online, missing place, internal, media, secondary, strong, other."""
    return (
        F.when(presence_col == "online", F.when(contains_any(text, fv.LABEL_ONLINE_WORDS), 1).otherwise(0))
        .when((place == "") | place.isin(fv.UNKNOWN_WORDS) | (area == ""), 0)
        .when(contains_any(text, fv.LABEL_INTERNAL_WORDS), 0).when(contains_any(text, fv.LABEL_MEDIA_WORDS), 1)
        .when(contains_any(text, fv.LABEL_SECONDARY_WORDS), 2).when(contains_any(text, fv.LABEL_STRONG_WORDS), 3)
        .when(presence_col.isin("offline", "hybrid"), 2).otherwise(0))


def label_reason(label: Column) -> Column:
    out = None
    for value, text in fv.LABEL_REASONS.items():
        out = F.when(label == value, text) if out is None else out.when(label == value, text)
    return out


def as_bool(c) -> Column:
    return F.lower(clean(F.col(c).cast("string") if isinstance(c, str) else c)).isin(fv.TRUE_WORDS)


def context_tags(tags: Column, place_type: Column, activity: Column, area: Column, time: Column) -> Column:
    """Given tags plus type, activity, area and day part; distinct, in order."""
    given = F.filter(F.transform(F.split(clean_nullish(tags), "[;,/]"), lambda t: F.trim(t)), lambda t: t != "")
    known = lambda c: F.when((c != "") & ~c.isin(fv.UNKNOWN_WORDS), c)
    slot = time_slot4(time)
    part = F.when(slot == "unknown", F.lit(None)).otherwise(
        F.when(slot == "morning", fv.DAYPART_TAGS["morning"]).when(slot == "afternoon", fv.DAYPART_TAGS["afternoon"])
        .otherwise(fv.DAYPART_TAGS["evening"]))
    added = F.array_compact(F.array(known(place_type), known(activity), known(area), part))
    return F.array_join(F.array_distinct(F.concat(given, added)), ";")


def review_reasons(areas=None) -> Column:
    place, area, address = clean_nullish("place_name"), clean_nullish("area"), clean_nullish("address")
    names = list(areas or fv.AREAS)
    return F.array_join(F.array_compact(F.array(
        F.when((place == "") | place.isin(fv.UNKNOWN_WORDS) | place.isin(names), F.lit("place_name 확인 필요")),
        F.when((area == "") | ~area.isin(names), F.lit("district 확인 필요")),
        F.when((address == "") | address.isin(fv.UNKNOWN_WORDS), F.lit("address 확인 필요")),
        F.when(clean_nullish("ocr_text").startswith("OCR unavailable"), F.lit("한글 OCR 미지원")))), "; ")


def normalize_gold(df: DataFrame, actors=None, areas=None, landmarks=None) -> DataFrame:
    """The full normalisation, in dependency order, as column expressions."""
    rows = quality.ensure_columns(df, [*GOLD, *GOLD_REVIEW])
    rows = rows.withColumns({c: F.col(c).cast("string") for c in [*GOLD, *GOLD_REVIEW]})
    dated = norm_date("date")
    rows = rows.withColumns({
        "actor": normalise_actor("actor", actors or {}), "source_image": clean_nullish("source_image"),
        "date": F.when(dated == "", date_from_name("source_image")).otherwise(dated), "time": norm_time_locale("time"),
        "place_name": clean_place_name("place_name"), "address": clean_nullish("address"), "event_title": clean_nullish("event_title")})
    rows = rows.withColumn("area", area_from_context("area", "place_name", "address", "event_title", areas=areas, landmarks=landmarks))
    fill = lambda c, value: F.when(clean_nullish(c) == "", value).otherwise(F.col(c))
    text = lambda *cs: F.concat_ws(" ", *[clean_nullish(c) for c in cs])
    rows = rows.withColumn("place_type", fill("place_type", infer_place_type(
        text("place_type", "place_name", "event_title", "context_tags", "activity_type"))))
    rows = rows.withColumn("activity_type", fill("activity_type", infer_activity(text("event_title", "place_name", "context_tags"))))
    rows = rows.withColumn("target_group", fill("target_group", infer_targets(
        text("target_group", "place_type", "place_name", "event_title", "context_tags"))))
    rows = rows.withColumn("presence", presence(text("presence", "event_title", "place_type")))
    label_text = text("event_title", "place_name", "place_type", "activity_type", "presence", "target_group", "context_tags")
    # The label re-reads presence from the presence value, title and type.
    again = presence(text("presence", "event_title", "place_type"))
    inferred = assign_label(label_text, again, clean_place_name("place_name"), F.col("area"))
    given = F.floor(F.coalesce(F.col("label").try_cast("double"), F.lit(0.0))).cast("int")
    rows = rows.withColumn("label", F.least(F.greatest(F.when(clean_nullish("label") == "", inferred).otherwise(given), F.lit(0)), F.lit(3)))
    rows = rows.withColumns({
        "label_reason": fill("label_reason", label_reason(F.col("label"))),
        "use_for_place": (F.col("label") >= 2) & F.col("presence").isin("offline", "hybrid") & (clean_nullish("place_name") != ""),
        "use_for_message": F.col("label") >= 1,
        "context_tags": context_tags(F.col("context_tags"), clean_nullish("place_type"), clean_nullish("activity_type"), clean_nullish("area"), F.col("time")),
        "day_of_week": F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), day_of_week("date")).otherwise(""), "d_day": d_day("date")})
    rows = rows.withColumn("review_reason", review_reasons(areas))
    return rows.withColumn("review_required", F.col("review_reason") != "")


def build_gold_all(df: DataFrame, order="ord") -> DataFrame:
    """Trim, dedupe, strict label and date checks, times and slots."""
    rows = trim_all_strings(df)
    data = [c for c in rows.columns if c != order]
    exact = first_per(rows, data, [order])
    rows = dedupe_keep_blank(exact, "gold_id", [order])
    rows = quality.assert_label_domain(rows, "label", id_cols=["gold_id"])
    rows = quality.assert_date(rows, "date", ["gold_id"])
    return rows.withColumn("time", norm_time("time")).withColumn("time_slot", time_slot4("time"))


def _present(c, *placeholders) -> Column:
    return (clean(c) != "") & ~clean(c).isin(list(placeholders))


def strong_positive(variant="strict") -> Column:
    """Strong-positive predicate: strict, query (hybrid allowed) or audit."""
    label = F.col("label").cast("int") == 3
    place, area = _present("place_name", "확인 필요"), _present("area", "해당 없음")
    if variant == "strict":
        return label & clean("presence").contains("오프라인") & as_bool("use_for_place") & place & area & _present("address", "해당 없음")
    if variant == "query":
        there = F.lower(clean("presence")).isin("offline", "hybrid", "오프라인", "혼합")
        known = ~clean("place_name").isin(fv.UNKNOWN_WORDS) & ~clean("area").isin(fv.UNKNOWN_WORDS)
        return label & there & as_bool("use_for_place") & known
    return label & (F.lower(clean("presence")) == "offline") & as_bool("use_for_place") & (clean("place_name") != "") & (clean("area") != "")


def build_strong(gold: DataFrame, variant="strict") -> DataFrame:
    rows = gold.filter(strong_positive(variant))
    return rows.withColumns({"place_key": place_key("place_name"), "is_strong_positive": F.lit(True)})


def build_queries(strong: DataFrame) -> DataFrame:
    """Queries keyed by date, time and area."""
    day = F.date_format("date", "yyyy-MM-dd")
    ask = F.concat(F.concat_ws(" ", day, "time", "area"), F.lit("에서 유세 장소를 추천"))
    return strong.withColumns({"date": day}).withColumns({
        "query_id": query_id(F.col("date"), F.col("time"), F.col("area")), "evaluation_context": ask, "relevance": F.col("label").cast("int")})


def build_actor_queries(gold: DataFrame, prefixes: dict, order="ord") -> DataFrame:
    """Queries with actor prefix, place key and gold id; first per id."""
    rows = build_strong(gold, "query").filter("place_key <> ''").withColumn("relevance", F.lit(3))
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]) if prefixes else None
    prefix = F.coalesce(F.try_element_at(table, F.col("actor")), F.lit("CD")) if prefixes else F.lit("CD")
    qid = long_query_id(prefix, F.col("date"), F.col("time"), F.col("area"), F.col("place_key"), F.col("gold_id"))
    ask = F.concat(F.concat_ws(" ", "actor", "date", "time", "area"), F.lit("에서 유세 장소를 추천"))
    return first_per(rows.withColumns({"query_id": qid, "evaluation_context": ask}), ["query_id"], [order])


MERGE_KEY = ["actor", "date", "time", "area", "place_name", "event_title", "source_image"]


def merge_gold(old: DataFrame, new: DataFrame, prefixes: dict | None = None, actors=None, areas=None, order="ord") -> DataFrame:
    """Union, normalise, keep the first per 7-column key, number per actor prefix."""
    rows = normalize_gold(union_all([old, new]), actors, areas)
    rows = first_per(rows, MERGE_KEY, [order])
    table = prefixes or {}
    prefix = F.lit("CD")
    for actor, p in table.items():
        prefix = F.when(F.col("actor") == actor, p).otherwise(prefix)
    return sequential_ids(rows, prefix, ["actor", "date", "time", "area", "place_name", order], "gold_id")


def _prefix(prefixes: dict | None) -> Column:
    out = F.lit("CD")
    for actor, p in (prefixes or {}).items():
        out = F.when(F.col("actor") == actor, p).otherwise(out)
    return out


#: Columns that the seven key columns are normalised from.
RAW_KEY = [*MERGE_KEY, "address"]


def _least(none: str, first: str) -> list[Column]:
    """Whether an order value is null (nulls come first), and the least of the others."""
    return [F.max(none).alias("_none"), F.min(first).alias("_first")]


def _same_text(raw) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_raw_{c}")) for c in raw])


def _merge_texts(new: DataFrame, raw, actors, areas, order) -> DataFrame:
    """Distinct raw texts of the key (_raw_*), their normalised key and their first order value, written once.

    Normalising costs far more than reading a row, so a text that stands in many rows is normalised once.
    """
    texts = new.select(*raw, F.col(order).isNull().alias("_none"), F.col(order).alias("_first")).groupBy(*raw).agg(*_least("_none", "_first"))
    texts = texts.withColumns({f"_raw_{c}": F.col(c) for c in raw})
    return cut_lineage(normalize_gold(texts, actors, areas).select(*[f"_raw_{c}" for c in raw], *MERGE_KEY, "_none", "_first"))


def merge_again(kept: DataFrame | None, new: DataFrame, prefixes: dict | None = None, actors=None, areas=None, order="ord") -> tuple[DataFrame, DataFrame]:
    """Merge further rows into a merged set whose ids stay as they are.

    Returns the merged rows, and one row per row of ``new``: its ``order`` value, the
    gold_id of the row that stands for its 7-column key, and whether it is that row
    itself. A key that is known keeps its row; of new rows with one key the first
    stays, and gets the next number of its prefix. Merging the same rows again
    changes nothing.
    """
    raw = [c for c in RAW_KEY if c in new.columns]
    texts = _merge_texts(new, raw, actors, areas, order)
    known = kept.select(*MERGE_KEY, F.col("gold_id").alias("_id")) if kept is not None else None
    open_to = texts if known is None else texts.join(known, MERGE_KEY, "left_anti")
    # Only the rows that stand for a key are normalised whole; ties within an order value are settled after that.
    least = open_to.groupBy(*MERGE_KEY).agg(*_least("_none", "_first"))
    least = least.select(*[F.col(c).alias(f"_key_{c}") for c in MERGE_KEY], F.col("_none").alias("_n"), F.col("_first").alias("_f"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in MERGE_KEY])
    heads = open_to.join(least, same).filter("_none = _n and (_none or _first = _f)")
    heads = heads.select(*[f"_raw_{c}" for c in raw], F.when(~F.col("_none"), F.col("_first")).alias("_at"))
    chosen = new.join(heads, _same_text(raw) & F.col(order).eqNullSafe(F.col("_at")), "left_semi")
    fresh = first_per(normalize_gold(chosen, actors, areas), MERGE_KEY, [order]).withColumn("_prefix", _prefix(prefixes))
    numbered = number_rows(fresh, ["actor", "date", "time", "area", "place_name", order], ["_prefix"], "_n")
    before = F.lit(0)
    if known is not None:
        number = F.regexp_extract("_id", r"_(\d+)$", 1).cast("long")
        last = known.groupBy(F.regexp_replace("_id", r"_\d+$", "").alias("_prefix")).agg(F.max(number).alias("_last"))
        numbered, before = numbered.join(last, "_prefix", "left"), F.coalesce("_last", F.lit(0))
    digits = (F.col("_n") + before).cast("string")
    numbered = numbered.withColumn("gold_id", F.concat_ws("_", "_prefix", F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))).drop("_prefix", "_n", "_last")
    numbered = cut_lineage(numbered)
    stands = numbered.select(*MERGE_KEY, "gold_id", F.col(order).alias("_own"))
    if known is not None:
        stands = known.select(*MERGE_KEY, F.col("_id").alias("gold_id"), F.lit(None).alias("_own")).unionByName(stands)
    ids = texts.join(stands, MERGE_KEY).select(*[f"_raw_{c}" for c in raw], F.col("gold_id").alias("_id"), "_own")
    told = new.select(*raw, order).join(ids, _same_text(raw)).select(order, F.col("_id").alias("gold_id"), F.coalesce(F.col(order) == F.col("_own"), F.lit(False)).alias("is_kept"))
    merged = numbered if kept is None else kept.unionByName(numbered, allowMissingColumns=True)
    return merged, told


def merge_report(old: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows per input file, then totals, duplicates removed and final rows."""
    inputs = union_all([old, new]).groupBy("source_group", "file_path").agg(F.count("*").alias("input_rows"))
    o, n, m = (d.agg(F.count("*").alias("n")).scalar() for d in (old, new, merged))
    one = old.sparkSession.range(1)
    line = lambda name, value: F.struct(F.lit("summary").alias("source_group"), F.lit(name).alias("file_path"), value.cast("long").alias("input_rows"))
    totals = one.select(F.inline(F.array(line("existing_files", o), line("new_file", n), line("duplicate_removed", o + n - m), line("final_rows", m))))
    return inputs.unionByName(totals)


# --- schedule text ---------------------------------------------------------------
def schedule_lines(df: DataFrame, text: str, keys, pattern: str = fv.SCHEDULE_TIME_PATTERN) -> DataFrame:
    """Lines of a text grouped by their leading time line.

    A line with a time opens a group; later lines join it. Groups form inside
    one text with array functions, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda l: F.trim(F.regexp_replace(l, r"\s+", " "))), lambda l: l != "")

    def add(done, line):
        start = line.rlike(pattern) | (F.size(done) == 0)
        last = F.element_at(done, -1)
        return F.when(start, F.concat(done, F.array(line))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), line))))

    folded = F.aggregate(lines, F.array().cast("array<string>"), add)
    return df.select(*keys, F.posexplode(folded).alias("line_no", "line"))


def parse_schedule_line(df: DataFrame, line="line", pattern: str = fv.SCHEDULE_TIME_PATTERN, areas=None, landmarks=None) -> DataFrame:
    """time, event_title, place_name and area of each schedule line."""
    found = F.regexp_extract(F.col(line), pattern, 0)
    at = F.instr(F.col(line), found)
    has = F.col(line).rlike(pattern)
    rest = F.when(has, F.expr(f"substring({line}, instr({line}, _t) + length(_t))")).otherwise(F.col(line))
    rows = df.withColumn("_t", found)
    title = F.trim(F.when(has, F.regexp_replace(rest, r"^[ \-:：]+|[ \-:：]+$", "")).otherwise(F.col(line)))
    rows = rows.withColumns({"time": F.when(has, norm_time_locale("_t")).otherwise(""), "event_title": title})
    bracket = r"[(@（](.*?)[)）]"
    place = (F.when(F.col("event_title").rlike(bracket), F.trim(F.regexp_extract("event_title", bracket, 1)))
             .when(F.col("event_title").contains("@"), F.trim(F.regexp_extract("event_title", r"@(.*)$", 1)))
             .when(F.col("event_title").contains("-"), F.trim(F.regexp_extract("event_title", r".*-(.*)$", 1))).otherwise(""))
    rows = rows.withColumn("_p", place)
    area = area_from_context(F.lit(""), "event_title", "_p", areas=areas, landmarks=landmarks)
    return rows.withColumns({"place_name": clean_place_name("_p"), "area": area}).drop("_t", "_p")
