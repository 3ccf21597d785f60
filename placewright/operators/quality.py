"""Schema contracts, validation, profiling and quality tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright.functions.text import clean
from placewright.functions.times import as_date, norm_date


class DataValidationError(ValueError):
    """Input does not meet its table contract."""


def require_columns(df: DataFrame, cols, label="table") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise DataValidationError(f"{label} lacks required columns: {', '.join(missing)}")
    return df


def ensure_columns(df: DataFrame, cols, default="") -> DataFrame:
    return df.withColumns({c: F.lit(default) for c in cols if c not in df.columns})


def fail_on(df: DataFrame, bad: Column, cols, message: str) -> DataFrame:
    """Raise with up to ten sample rows when any row is bad."""
    sample = df.filter(F.coalesce(bad, F.lit(True))).select(*cols).limit(10).collect()
    if sample:
        raise DataValidationError(f"{message}; sample: {[r.asDict() for r in sample]}")
    return df


def assert_numeric(df, col, id_cols=()):
    value = F.col(col).try_cast("double")
    fail_on(df, value.isNull(), [*id_cols, col], f"{col} is not numeric")
    return df.withColumn(col, value)


def assert_positive_int(df, col, id_cols=()):
    value = F.col(col).try_cast("double")
    bad = value.isNull() | (value <= 0) | (value % 1 != 0)
    fail_on(df, bad, [*id_cols, col], f"{col} is not a positive integer")
    return df.withColumn(col, value.cast("int"))


def assert_label_domain(df, col="label", low=0, high=3, id_cols=()):
    value = F.col(col).try_cast("double")
    bad = value.isNull() | (value % 1 != 0) | ~value.between(low, high)
    fail_on(df, bad, [*id_cols, col], f"{col} is not an integer in {low}..{high}")
    return df.withColumn(col, value.cast("int"))


def assert_date(df, col="date", id_cols=()):
    value = as_date(norm_date(col))
    fail_on(df, value.isNull(), [*id_cols, col], f"{col} is not a date")
    return df.withColumn(col, value)


def assert_no_blank(df, cols):
    bad = reduce(lambda a, b: a | b, [clean(c) == "" for c in cols])
    return fail_on(df, bad, cols, f"blank values in {', '.join(cols)}")


def duplicate_keys(df, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def assert_unique(df, keys):
    fail_on(duplicate_keys(df, keys), F.lit(True), [*keys, "rows"], f"duplicate {', '.join(keys)}")
    return df


def order_breaks(df, key, rank, ordinal) -> DataFrame:
    """Rows whose rank is below the one before it in the stated file order.

    Neighbours are compared, so one break is one row; a key without breaks is
    ascending throughout.
    """
    before = F.lag(rank).over(W.partitionBy(key).orderBy(ordinal))
    return df.withColumn("previous", before).filter(F.col(rank) < F.col("previous"))


def assert_monotonic(df, key="query_id", rank="rank", ordinal="ord"):
    fail_on(order_breaks(df, key, rank, ordinal), F.lit(True), [key, "previous", rank], f"{rank} is not ascending")
    return df


def missing_ids(left: DataFrame, right: DataFrame, key="query_id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def assert_covers(left, right, key="query_id"):
    fail_on(missing_ids(left, right, key), F.lit(True), [key], f"{key} missing from candidates")
    return right


def assert_max_group(df, key="query_id", most=50):
    over = df.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    fail_on(over, F.lit(True), [key, "rows"], f"more than {most} rows per {key}")
    return df


def quality_checks(df: DataFrame, rules) -> DataFrame:
    """Check table from one pass.

    ``rules`` are (check, severity, aggregate Column, operator, expected,
    detail); the operator is one of ``==``, ``>=`` and ``<=``.
    """
    aggs = [agg.cast("double").alias(f"c{i}") for i, (_, _, agg, _, _, _) in enumerate(rules)]
    wide = df.agg(*aggs)
    long = wide.unpivot([], [f"c{i}" for i in range(len(rules))], "slot", "actual")
    info = F.create_map(*[x for i, (name, sev, _, op, exp, detail) in enumerate(rules) for x in (
        F.lit(f"c{i}"), F.struct(F.lit(name).alias("check_name"), F.lit(sev).alias("severity"), F.lit(op).alias("op"),
                                 F.lit(float(exp)).alias("expected"), F.lit(detail).alias("detail")))])
    row = long.withColumn("i", info[F.col("slot")])
    passed = (F.when(F.col("i.op") == "==", F.col("actual") == F.col("i.expected"))
              .when(F.col("i.op") == ">=", F.col("actual") >= F.col("i.expected"))
              .otherwise(F.col("actual") <= F.col("i.expected")))
    return row.select("i.check_name", "i.severity", passed.alias("passed"), "actual", "i.expected", "i.detail")


def lost_keys(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Distinct key texts of the old table that the new one lacks."""
    text = lambda d: d.select(F.concat_ws("|", *[clean(F.col(k).cast("string")) for k in keys]).alias("row_key")).distinct()
    return text(old).join(text(new), "row_key", "left_anti")


def metric_regression(actual: DataFrame, expected: DataFrame, keys=("model", "metric"), tolerance=1e-4) -> DataFrame:
    joined = expected.join(actual, list(keys), "left")
    gap = F.abs(F.col("actual") - F.col("expected"))
    status = F.when(gap.isNotNull() & (gap < tolerance), "PASS").otherwise("WARNING")
    return joined.select(*keys, "expected", "actual", gap.alias("abs_diff"), status.alias("status"))


def profile(df: DataFrame, approximate=False) -> DataFrame:
    """Per column: rows, nulls, distinct values.

    Distinct counts of several columns in one exact aggregate would expand each
    row once per column through one shuffle; (column, value) pairs are instead
    counted in two partial aggregates. ``approximate`` uses sketches, one pass.
    """
    cols = df.columns
    if approximate:
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(cols):
            aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.approx_count_distinct(f"`{c}`").alias(f"d{i}")]
        items = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"),
                                   F.col(f"d{i}").alias("distinct")) for i, c in enumerate(cols)])
        return df.agg(*aggs).select(F.inline(items))
    text = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = text.unpivot([], [f"`{c}`" for c in cols], "column", "value")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"))


def candidate_keys(profiled: DataFrame, near=0.95, most=5) -> DataFrame:
    """Exact keys, else up to five near keys by (ratio, duplicates, name)."""
    full = profiled.filter("nulls = 0 and rows > 0")
    exact = full.filter(F.col("distinct") == F.col("rows")).withColumn("kind", F.lit("exact"))
    part = full.filter((F.col("distinct") < F.col("rows")) & (F.col("distinct") / F.col("rows") >= near))
    part = part.orderBy(F.desc(F.col("distinct") / F.col("rows")), F.col("rows") - F.col("distinct"), "column").limit(most)
    both = exact.unionByName(part.withColumn("kind", F.lit("near")))
    return both.select("column", "kind", F.round(F.col("distinct") / F.col("rows"), 6).alias("unique_ratio"),
                       (F.col("rows") - F.col("distinct")).alias("duplicates"))


def date_gaps(seen: DataFrame, col: str, start: Column, end: Column) -> DataFrame:
    """Days from start to end with no record. Bounds are aggregates of ``seen``."""
    days = seen.agg(start.cast("date").alias("s"), end.cast("date").alias("e"))
    every = days.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("day"))
    return every.join(seen.select(F.col(col).cast("date").alias("day")).distinct(), "day", "left_anti")


def column_presence(df: DataFrame, required) -> DataFrame:
    """Required columns with presence, type and non-null count."""
    types = dict(df.dtypes)
    aggs = [F.count(f"`{c}`").alias(f"k{i}") if c in types else F.lit(0).cast("long").alias(f"k{i}")
            for i, c in enumerate(required)]
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in types).alias("present"),
                               F.lit(types.get(c, "")).alias("type"), F.col(f"k{i}").alias("non_null"))
                      for i, c in enumerate(required)])
    return df.agg(*aggs).select(F.inline(items))


def area_safety(rows: DataFrame, route="route_id", order="order", area="area", selected="selected_areas",
                filler="is_fallback") -> DataFrame:
    """Per route: rows outside the selection, and real rows after a filler."""
    outside = (F.size(selected) > 0) & ~F.coalesce(F.array_contains(selected, F.col(area)), F.lit(False))
    last_real = F.max(F.when(~F.col(filler), F.col(order)))
    first_fill = F.min(F.when(F.col(filler), F.col(order)))
    return rows.groupBy(route).agg(
        F.count("*").alias("rows"), F.count_if(outside).alias("mismatches"),
        F.coalesce(last_real < first_fill, F.lit(True)).alias("fillers_last"))


def filler_breaks(rows: DataFrame, route="route_id", order="order", filler="is_fallback") -> DataFrame:
    """Every real row that stands after a filler of its route, with the first filler before it.

    One running minimum over the ordered stops of a route; equal positions do not break.
    """
    before = W.partitionBy(route).orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    first = F.min(F.when(F.col(filler), F.col(order))).over(before)
    return rows.withColumn("first_filler", first).filter(~F.col(filler) & F.col("first_filler").isNotNull())
