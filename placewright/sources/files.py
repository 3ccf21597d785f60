"""File readers and writers (CSV, JSON, Parquet, logs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from placewright.sources.contracts import JSON_WRAPPERS

BOM = "﻿"


def _paths(spark: SparkSession, pattern: str):
    """Files behind a path or glob, through the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return [] if found is None else [str(s.getPath().toString()) for s in found]


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(_paths(spark, pattern))


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of a CSV; only the first line of one file is needed."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False)
    return [c.lstrip(BOM).strip() for c in reader.csv(path).columns]


def read_csv_pruned(spark, path, cols, encodings=("UTF-8", "MS949"), schema=None) -> DataFrame:
    """CSV with only the contract columns, in the first encoding whose header fits.

    A wrong charset does not fail in Spark, so the header decides. Encodings
    beyond Spark's list need ``spark.sql.legacy.javaCharsets``; those that the
    session refuses are passed over.
    """
    errors = []
    for encoding in encodings:
        try:
            header = header_of(spark, path, encoding)
        except Exception as error:  # a charset the session does not allow
            errors.append(f"{encoding}: {error}")
            continue
        if set(cols) <= set(header):
            full = schema or T.StructType([T.StructField(c, T.StringType()) for c in header])
            reader = spark.read.schema(full).option("header", True).option("encoding", encoding)
            return reader.csv(path).select(*[F.col(f"`{c}`") for c in cols])
        errors.append(f"{encoding}: header lacks {sorted(set(cols) - set(header))}")
    raise ValueError(f"cannot read {path}: " + " / ".join(errors))


def read_csv_strings(spark, path, encoding="UTF-8", multi_line: bool = False) -> DataFrame:
    """All-text CSV; blanks stay blank instead of becoming null.

    Files are split between tasks unless ``multi_line`` says that quoted fields
    hold line breaks, which makes each file one task.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line) \
        .option("escape", '"').option("encoding", encoding).csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    return df.na.fill("")


def csv_files(spark, path) -> list[str]:
    """All CSV files under a folder, at any depth; the listing is Spark's own."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select("path")
    return sorted(r.path for r in rows.collect())


def read_dir(spark, path, prefer_token="manual_reviewed", multi_line: bool = False) -> DataFrame:
    """Every CSV under a folder at any depth, or only those whose name carries the token.

    Files are joined by column name: those that share a header, in whatever
    place, are one read, and headers that differ are united.
    """
    files = csv_files(spark, path)
    preferred = [f for f in files if prefer_token in f.rsplit("/", 1)[-1]]
    chosen = preferred or files
    if not chosen:
        raise FileNotFoundError(path)
    by_header: dict[tuple, list[str]] = {}
    for f in chosen:
        by_header.setdefault(tuple(header_of(spark, f)), []).append(f)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        read_csv_strings(spark, group, multi_line=multi_line).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)) for group in by_header.values()])
    return df.na.fill("")


def discover_by_schema(spark, globs, required, skip_tokens=()) -> list[str]:
    """Files whose header holds every required column."""
    found = sorted({p for g in globs for p in _paths(spark, g)})
    named = [p for p in found if not any(t in p.rsplit("/", 1)[-1] for t in skip_tokens)]
    return [p for p in named if set(required) <= set(header_of(spark, p))]


def read_files_tagged(spark, files, group: str, multi_line: bool = False) -> DataFrame:
    """Several CSVs with differing columns as one table tagged by file."""
    frames = [read_csv_strings(spark, f, multi_line=multi_line).withColumn("file_path", F.lit(f)) for f in files]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.na.fill("").withColumn("source_group", F.lit(group))


def read_rows_json(spark, path, row_schema: T.StructType, wrappers=JSON_WRAPPERS) -> DataFrame:
    """Rows from a JSON list, or from the first wrapper key that holds a list."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(row_schema))
    shell = T.StructType([T.StructField(w, T.ArrayType(row_schema)) for w in wrappers])
    wrapped = F.from_json("value", shell)
    first = F.coalesce(*[wrapped.getField(w) for w in wrappers])
    is_list = F.ltrim(F.col("value")).startswith("[")
    return text.select(F.explode(F.when(is_list, listed).otherwise(first)).alias("r")).select("r.*")


RECORD_NAME_KEYS = ["recommended_place_name", "place_name", "name", "title"]
RECORD_AREA_KEYS = ["district_normalized", "recommended_district", "district", "district_name", "region"]
RECORD_TYPE_KEYS = ["recommended_place_type", "place_type", "type", "category"]


def flatten_json_records(df: DataFrame, column: str) -> DataFrame:
    """Every object in nested JSON that has a name and an area, at any depth.

    The deepest nesting is taken from the data (most brackets open at once, an
    upper bound); each level explodes the variant one step, and leaves drop out
    as they are met.
    """
    fields = T.StructType([T.StructField(k, T.StringType()) for k in
                           RECORD_NAME_KEYS + RECORD_AREA_KEYS + RECORD_TYPE_KEYS + ["address", "lat", "lng", "score"]])
    brackets = F.split(F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\\\]|\\\\.)*"', ""), r"[^\[\]{}]", ""), "")
    open_ = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda d, c: F.struct(
        (d["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
        F.greatest(d["most"], d["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")))
    depth = df.agg(F.max(open_["most"])).first()[0] or 0
    level = df.select(F.parse_json(F.col(column)).alias("v"))
    levels = [level]
    for _ in range(depth):
        level = level.lateralJoin(
            level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("child"))
        ).select(F.col("child").alias("v"))
        level = level.filter(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        levels.append(level)
    every = reduce(lambda a, b: a.unionByName(b), levels)
    # Exploded, so that the filters below read the parsed record instead of parsing it again for each field that they name.
    record = every.select(F.explode(F.array(F.from_json(F.to_json("v"), fields))).alias("r")).filter("r is not null")
    pick = lambda keys: F.coalesce(*[F.nullif(F.trim(F.col(f"r.{k}")), F.lit("")) for k in keys])
    out = record.select(
        pick(RECORD_NAME_KEYS).alias("place_name"), pick(RECORD_AREA_KEYS).alias("area"),
        pick(RECORD_TYPE_KEYS).alias("place_type"), F.col("r.address").alias("address"),
        F.col("r.lat").try_cast("double").alias("lat"), F.col("r.lng").try_cast("double").alias("lng"),
        F.col("r.score").try_cast("double").alias("score"),
    )
    return out.filter(F.col("place_name").isNotNull() & F.col("area").isNotNull())


def read_numeric_map(spark, path) -> DataFrame:
    """Flat JSON object to one map of numbers; absent file gives an empty map."""
    if not exists(spark, path):
        return spark.range(1).select(F.create_map().cast("map<string,double>").alias("summary"))
    raw = F.from_json("value", "map<string,string>")
    numbers = F.map_filter(F.transform_values(raw, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    return spark.read.text(path, wholetext=True).select(numbers.alias("summary"))


def read_optional(spark, path, schema: T.StructType, fmt="parquet") -> DataFrame:
    """A table that may be missing: empty with the contract schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def write_csv(df: DataFrame, path: str, mode="overwrite", bom=True) -> None:
    """CSV folder with headers; the mark for spreadsheets leads the first column."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    df.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_json(df: DataFrame, path: str, mode="overwrite") -> None:
    df.write.mode(mode).json(path)


def write_partitioned(df: DataFrame, path: str, by="actor", mode="overwrite", files_per_key: int | None = None) -> None:
    """One folder per key value. A hot key is written by many tasks, not one."""
    if files_per_key:
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
        df = df.repartition(F.col(by), spread)
    df.write.mode(mode).partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def page(df: DataFrame, limit: int, *order) -> DataFrame:
    """First rows in a stated order, NaN shown as null."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    shown = df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])
    return shown.orderBy(*order).limit(max(limit, 0))
