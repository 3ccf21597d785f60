"""Projection, filtering, dedupe, numbering and joins that hold under skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from placewright import fixed_values as fv
from placewright.functions.areas import first_area, norm_area
from placewright.functions.text import clean, contains_any, lit_map, slug
from placewright.functions.numbers import valid_coords
from placewright.session import cut_lineage



# --- projection and filter ---------------------------------------------------
def rename_select(df: DataFrame, mapping: dict) -> DataFrame:
    return df.select([F.col(f"`{a}`").alias(b) for a, b in mapping.items()])


def trim_all_strings(df: DataFrame) -> DataFrame:
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select([F.trim(c).alias(c) if c in text else F.col(c) for c in df.columns])


def drop_blank(df: DataFrame, cols) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [clean(c) != "" for c in cols]))


def drop_null(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))


def latest_period(df: DataFrame, col: str) -> DataFrame:
    """Rows of the latest period; the maximum is a scalar subquery."""
    top = df.select(F.max(col).alias("top"))
    return df.filter(F.col(col) == top.scalar())


def filter_area(df: DataFrame, selected, cols, areas=None) -> DataFrame:
    """Rows whose first known area is selected; no selection passes all."""
    out = df.withColumn("area_normalised", first_area(cols, areas))
    return out if not selected else out.filter(F.col("area_normalised").isin(list(selected)))


def split_by_area(df: DataFrame, selected, cols, areas=None) -> tuple[DataFrame, DataFrame]:
    """Rows inside the selected areas, and one warning row about the others."""
    flagged = df.withColumn("area_normalised", first_area(cols, areas))
    inside = F.coalesce(F.col("area_normalised").isin(list(selected)), F.lit(False)) if selected else F.lit(True)
    outside = flagged.filter(~inside)
    names = F.array_join(F.array_sort(F.collect_set(F.coalesce("area_normalised", F.lit("UNKNOWN")))), ", ")
    warning = outside.agg(F.count("*").alias("removed"), names.alias("areas"))
    return flagged.filter(inside), warning.filter("removed > 0")


def type_compatible(query_type: Column, other_type: Column, table=None) -> Column:
    """True when blank, equal, or listed as compatible."""
    table = table or fv.TYPE_COMPATIBILITY
    listed = F.coalesce(F.array_contains(F.try_element_at(lit_map(table), query_type), other_type), F.lit(False))
    return (query_type == "") | (other_type == "") | (query_type == other_type) | listed


def drop_source_type(df: DataFrame, prefix: str, kind: Column, removed: Column) -> DataFrame:
    """Drop rows of one type whose source starts with a prefix."""
    return df.filter(~(F.col("candidate_source").startswith(prefix) & (kind == removed)))


def blank_passes(value: Column, wanted: Column) -> Column:
    return (F.coalesce(value, F.lit("")) == "") | (F.coalesce(wanted, F.lit("")) == "") | (value == wanted)


def marker_eligible() -> Column:
    """Row can be drawn: id, name, area, valid coordinates, allowed provenance."""
    banned = contains_any(F.concat_ws(" ", "source", "candidate_source", "coordinate_source"), ["fallback", "synthetic"])
    return (
        (clean("route_item_id") != "") & (clean("place_name") != "") & (clean("area") != "")
        & valid_coords(F.col("lat"), F.col("lng"))
        & F.col("coordinate_status").isin(fv.MARKER_STATUSES) & F.col("coordinate_source").isin(fv.MARKER_SOURCES)
        & ~F.coalesce(F.col("is_fallback"), F.lit(False)) & ~banned
    )


def split_eligible(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    marked = F.coalesce(flag, F.lit(False))
    return df.filter(marked), df.filter(~marked)


# --- joins that hold under skew ----------------------------------------------
def salted_join(left: DataFrame, right: DataFrame, keys, how="inner", salts: int = 16, spread=None) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``salts`` buckets.

    The salt is a hash of left columns, so a recomputed task gives the same
    rows. The right side (bounded rows per key) is copied once per salt.
    """
    spread = spread or left.columns
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def sort_keys(order) -> list:
    """Order terms: columns, names, or ``-name`` for descending."""
    return [F.desc(o[1:]) if isinstance(o, str) and o.startswith("-") else F.col(o) if isinstance(o, str) else o for o in order]


# --- dedupe -------------------------------------------------------------------
def first_per(df: DataFrame, keys, order, n: int = 1, rank_col: str | None = None) -> DataFrame:
    """First n rows per key in a total order.

    Spark limits each group before the shuffle, so a hot key ships n rows per
    task, not its whole group.
    """
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*sort_keys(order)))).filter(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def first_by_score(df: DataFrame, keys, score: str, order, n: int, rank_col: str) -> DataFrame:
    """``first_per`` by a falling score and an order, for few keys with very many rows each.

    Counts by key and score level (steps of 0.0001 in 0..1) tell the level that the
    n-th row stands on; only rows from there on are sorted, so a task's memory does
    not grow with its input. The table is read twice.
    """
    value = F.col(score)
    level = F.when(value.isNull(), -1).when(F.isnan(value), 10_001).otherwise(F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 10_000)).cast("int")
    rows = df.withColumn("_level", level)
    sizes = rows.groupBy(*keys, "_level").agg(F.count("*").alias("_size"))
    above = F.sum("_size").over(W.partitionBy(*keys).orderBy(F.desc("_level"))) - F.col("_size")
    cut = sizes.withColumn("_above", above).filter(F.col("_above") < n).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min("_level").alias("_cut"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    kept = rows.join(F.broadcast(cut), same & (F.col("_level") >= F.col("_cut"))).select(*df.columns)
    return first_per(kept, keys, [F.desc(score), *order], n, rank_col)


def dedupe_keep_blank(df: DataFrame, id_col: str, order) -> DataFrame:
    """Drop exact duplicates, then repeated non-blank ids; blank ids all stay."""
    blank = clean(id_col) == ""
    return first_per(df.filter(~blank), [id_col], order).unionByName(df.filter(blank))


def uniq(c: Column) -> Column:
    return F.array_distinct(c)


# --- keys and numbering -------------------------------------------------------
def composite_key(*cols, sep="|") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def number_rows(df: DataFrame, order, group=None, name="n") -> DataFrame:
    """1, 2, 3 ... in a total order, overall or per group, at any group size.

    Rows are range-partitioned by (group, order), numbered inside partitions,
    and shifted by the counts of earlier partitions; the offsets table has one
    row per (partition, group). The ranged table is checkpointed so that both
    passes see the same partitions.
    """
    groups = list(group or [])
    order = sort_keys(order)
    keys = [*[F.col(g) for g in groups], *order]
    ranged = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *groups).orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(inside))
    sizes = ranged.groupBy("_part", *groups).agg(F.count("*").alias("_size"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    out = local.join(offsets, ["_part", *groups])
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def slug_ids(df: DataFrame, cols, order, name="slug_id") -> DataFrame:
    """Slug of the columns; repeats get ``_2``, ``_3`` ... in order."""
    base = df.withColumn("_base", F.concat_ws("_", *[slug(c) for c in cols]))
    numbered = number_rows(base, order, ["_base"], "_n")
    full = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n").cast("string")))
    return numbered.withColumn(name, full).drop("_base", "_n")


def sequential_ids(df: DataFrame, prefix: Column, order, name="gold_id", width: int = 4) -> DataFrame:
    """``PREFIX_0001`` ids counted per prefix in sort order."""
    numbered = number_rows(df.withColumn("_prefix", prefix), order, ["_prefix"], "_n")
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return numbered.withColumn(name, F.concat_ws("_", "_prefix", padded)).drop("_prefix", "_n")


def query_id(date: Column, time: Column, area: Column) -> Column:
    return F.concat_ws("_", date, time, area)


def long_query_id(prefix, date, time, area, key, gold_id) -> Column:
    return F.concat_ws("_", prefix, F.replace(date, F.lit("-"), F.lit("")), F.replace(time, F.lit(":"), F.lit("")),
                       area, F.substring(key, 1, 16), gold_id)


def prediction_id(forecast: Column, target: Column, item: Column, seed) -> Column:
    return F.concat_ws("-", F.lit("pred"), forecast, target, F.substring(F.md5(F.concat_ws("-", item, F.lit(str(seed)))), 1, 8))


# --- set operations -----------------------------------------------------------
def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def interleave(df: DataFrame, group: str, order, group_pos: str, n: Column, within=()) -> DataFrame:
    """Round robin: first of each group in group order, then the second, ...

    ``within`` names outer keys (one list each); at most n rows per list.
    """
    order = sort_keys(order)
    row = F.row_number().over(W.partitionBy(*within, group).orderBy(*order))
    turn = df.withColumn("_turn", row).filter(F.col("_turn") <= n)
    pos = F.row_number().over(W.partitionBy(*within).orderBy("_turn", group_pos, *order))
    return turn.withColumn("position", pos).filter(F.col("position") <= n).drop("_turn")


def hash_order(df: DataFrame, id_col: str, seed, name="position", digits: int = 4) -> DataFrame:
    """Position of each id in a seeded pseudo-random order, 1-based and exact.

    Ids are ordered by md5(seed|id). A histogram over the first hex digits
    (16**digits rows at most, whatever the input) gives each bucket's offset;
    ranking inside the even buckets is distributed.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.row_number().over(W.partitionBy("_b").orderBy("_h", id_col))
    out = hashed.withColumn("_row", row).join(F.broadcast(offsets), "_b")
    return out.withColumn(name, F.col("_row") + F.col("_before")).drop("_h", "_b", "_row", "_before")
