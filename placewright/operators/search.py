"""Weight search: every trial scores every frozen candidate, in one job.

Two facts keep this linear in the data. Lists depend on a request only through
its signature, so trials rank signatures, not requests. And every metric is a
sum over (gold item, best rank), so gold rows shrink to one row per (signature,
set of candidates that match it) *before* trials are applied; only that table
meets the trials.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.text import lit_array, lookup
from placewright.operators.diagnostics import best_ranks
from placewright.operators.evaluation import gold_stats, objective
from placewright.operators.matching import first_gold, match_pairs, match_picks, prepare_gold, prepare_recs
from placewright.operators.ranking import TUNED_FEATURES, diverse_rerank, final_score, in_area
from placewright.operators.shaping import first_per, hash_order
from placewright.session import cut_lineage


def grid_size(grid) -> int:
    return math.prod(len(v) for v in grid)


def grid_trials(spark: SparkSession, names, grid) -> DataFrame:
    """All combinations, decoded from the row number (last list fastest)."""
    rows = spark.range(grid_size(grid)).withColumnRenamed("id", "grid_id")
    stride, cols = grid_size(grid), {}
    for name, values in zip(names, grid):
        stride //= len(values)
        pos = F.floor(F.col("grid_id") / F.lit(stride)) % len(values)
        cols[name] = F.get(lit_array([float(v) for v in values]), pos.cast("int"))
    return rows.withColumns(cols)


def build_trials(spark, names, grid, required, mode="random", n_trials=None, seed=42) -> DataFrame:
    """Required trials, then a seeded sample (300 unless stated) or the whole grid (a prefix only if stated), without repeats."""
    every = grid_trials(spark, names, grid)
    if mode == "grid":
        picked = every.filter(F.col("grid_id") < n_trials) if n_trials else every
        picked = picked.withColumn("position", F.col("grid_id") + 1)
    else:
        picked = hash_order(every, "grid_id", seed).filter(F.col("position") <= (300 if n_trials is None else max(n_trials, 0)))
    schema = "seq long, " + ", ".join(f"{n} double" for n in names)
    first = spark.createDataFrame([(i, *[float(x) for x in row]) for i, row in enumerate(required, 1)], schema)
    rest = picked.select((F.col("position") + len(required)).alias("seq"), *names)
    unique = first.unionByName(rest).groupBy(*names).agg(F.min("seq").alias("seq"))
    # Ids follow the sequence; the table holds one row per trial.
    w = row_order("seq")
    return unique.withColumn("trial_id", w).drop("seq")


def row_order(col: str) -> Column:
    return F.row_number().over(W.orderBy(col))


def trial_array(trials: DataFrame, names) -> DataFrame:
    """All trials as one array of structs (a scalar subquery); one row per trial
    and at most a few hundred trials, so its size is the parameter n_trials."""
    return trials.agg(F.array_sort(F.collect_list(F.struct("trial_id", *names))).alias("trials"))


def label_sums(gold: DataFrame, pool: DataFrame, queries: DataFrame, ks, list_col="sig", aliases=None, areas=None) -> DataFrame:
    """(list_id, ranks, sums): gold contributions by set of matching candidates.

    A gold item is labelled by the candidates for which it is the first match.
    ``queries`` (query_id) selects the split.
    """
    g = prepare_gold(gold, list_col, areas).join(queries.select("query_id"), "query_id", "left_semi")
    r = prepare_recs(pool, list_col, rank="raw_rank", areas=areas)
    labels = first_gold(match_pairs(g, r, aliases))
    items = labels.groupBy("query_id", "list_id", "gold_item").agg(
        F.array_sort(F.collect_set("rank")).alias("ranks"), F.min_by("relevance", "rank").alias("relevance"))
    stats = gold_stats(g, ks).drop("list_id")
    gain = F.pow(F.lit(2.0), "relevance") - F.lit(1.0)
    rows = items.join(stats, "query_id")
    sums = [F.count("*").alias("hits"), F.sum(F.lit(1.0) / F.col("total_relevant")).alias("recall")]
    sums += [F.sum(F.coalesce(F.try_divide(gain, F.col(f"idcg_{k}")), F.lit(0.0))).alias(f"gain_{k}") for k in ks]
    return rows.groupBy("list_id", "ranks").agg(*sums)


def metric_sums(ks, n: Column):
    """Aggregates over rows (best position, sums) -> p_k, r_k, ndcg_k."""
    out = []
    for k in ks:
        near = F.col("best") <= k
        out += [(F.coalesce(F.sum(F.when(near, F.col("hits"))), F.lit(0)) / F.lit(float(k)) / n).alias(f"p_{k}"),
                (F.coalesce(F.sum(F.when(near, F.col("recall"))), F.lit(0.0)) / n).alias(f"r_{k}"),
                (F.coalesce(F.sum(F.when(near, F.col(f"gain_{k}") / F.log2(F.col("best") + F.lit(1.0)))), F.lit(0.0)) / n).alias(f"ndcg_{k}")]
    return out


def best_position(top: Column, ranks: Column) -> Column:
    """Best 1-based position in ``top`` of any rank in ``ranks``; null if none."""
    return F.array_min(F.transform(ranks, lambda r: F.nullif(F.array_position(top, r), F.lit(0).cast("long"))))


def search_weights(features: DataFrame, pool: DataFrame, gold: DataFrame, splits: DataFrame, trials: DataFrame, ks=None, k=10,
                   list_col="sig", aliases=None, areas=None) -> DataFrame:
    """Train metrics and objective of every trial.

    ``features`` are tuned features per (signature, candidate); ``pool`` the
    frozen candidates per signature; ``gold`` carries query_id and ``list_col``.
    """
    ks = sorted(set(ks or fv.EVAL_KS))
    train = splits.filter("split = 'train'")
    n = train.agg(F.count("*").cast("double").alias("n"))
    labels = label_sums(gold, pool, train, ks, list_col, aliases, areas)
    rows = labelled_candidates(in_area(features, list_col, areas), labels, ["base_score", *TUNED_FEATURES], list_col)
    rows = rows.withColumn("t", F.explode(trial_array(trials, fv.TUNED_WEIGHTS).scalar()))
    score = None
    for f, w in zip(TUNED_FEATURES, fv.TUNED_WEIGHTS):
        term = F.col(f).cast("double") * F.col(f"t.{w}")
        score = term if score is None else score + term
    rows = rows.select("list_id", F.col("t.trial_id").alias("trial_id"), "raw_rank", "base_score", "labels", F.round(score, 6).alias("score"))
    order = W.partitionBy("list_id", "trial_id").orderBy(F.desc("score"), F.desc("base_score"), "raw_rank")
    top = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    sums = label_metrics(top, ks)
    rows = trials.join(sums, "trial_id", "left")
    names = [f"{m}_{x}" for x in ks for m in ("p", "r", "ndcg")]
    total = n.scalar()
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) / total for c in names})
    return rows.withColumn("objective", objective(fv.OBJECTIVE))


def labelled_candidates(features: DataFrame, labels: DataFrame, cols, list_col="sig") -> DataFrame:
    """Candidates of the lists that have labels, each with its labels, dealt by list.

    Everything that follows per (list, trial) keeps that partitioning, so trials
    times candidates is never shuffled.
    """
    sums = [c for c in labels.columns if c not in ("list_id", "ranks")]
    each = labels.withColumn("label", F.array_join("ranks", ",")).withColumn("raw_rank", F.explode("ranks"))
    each = each.groupBy("list_id", "raw_rank").agg(F.collect_list(F.struct("label", *sums)).alias("labels"))
    rows = features.select(F.col(list_col).alias("list_id"), F.col("raw_rank").cast("int").alias("raw_rank"), *dict.fromkeys(c for c in cols))
    rows = rows.join(labels.select("list_id").distinct(), "list_id", "left_semi").join(each, ["list_id", "raw_rank"], "left")
    return rows.repartition("list_id")


def label_metrics(top: DataFrame, ks) -> DataFrame:
    """Metric sums of each trial from its top candidates (list_id, trial_id, position, labels)."""
    met = top.select("list_id", "trial_id", "position", F.inline("labels"))
    sums = [c for c in met.columns if c not in ("list_id", "trial_id", "position", "label")]
    best = met.groupBy("list_id", "trial_id", "label").agg(F.min("position").alias("best"), *[F.first(c).alias(c) for c in sums])
    return best.groupBy("trial_id").agg(*metric_sums(ks, F.lit(1.0)))


def best_trials(results: DataFrame, criteria) -> DataFrame:
    """Arg-max trial per criterion; the first trial wins ties."""
    picks = [F.struct(F.lit(name).alias("criterion"), F.max_by("trial_id", F.struct(F.col(c), -F.col("trial_id"))).alias("trial_id"),
                      F.max(c).alias("value")) for name, c in criteria.items()]
    return results.agg(F.array(*picks).alias("_b")).select(F.inline("_b"))


def trial_weights(trials: DataFrame, results: DataFrame, names, metric="objective") -> DataFrame:
    """Weights of the best trial as a one-row table."""
    best = results.agg(F.max_by("trial_id", F.struct(F.col(metric), -F.col("trial_id"))).alias("t"))
    return trials.filter(F.col("trial_id") == best.scalar()).select(*names)


# --- final model search ---------------------------------------------------------
FINAL_MEANS = {"area_10": "area_match", "type_10": "type_match", "time_10": "time_match", "context_10": "context_match", "composite_10": "composite"}


def with_trials(rows: DataFrame, trials: DataFrame, key="trial_id") -> DataFrame:
    """Rows times trials as an equi-join: numbers of trials are exploded, their weights looked up.

    Trial ids are 1, 2, 3 ...; the table has one row per trial, as many as the caller asked for.
    """
    last = trials.agg(F.max(key).alias("n")).scalar()
    each = rows.withColumn(key, F.explode(F.sequence(F.lit(1), last.cast("int"))))
    return each.join(F.broadcast(trials.withColumn(key, F.col(key).cast("int"))), key)


def diverse_lists(features: DataFrame, trials: DataFrame, k: int = 10, list_col="sig") -> DataFrame:
    """(list_id, trial_id, raw_rank, position): greedy diverse top k of every list under every trial.

    A pick costs every later row of its type 0.70 weights, and of its area 0.30 from
    the third on; so within a (type, area) class rows leave by score, and the first
    k of each are enough. In a list of one area all rows pay the same for the area,
    and the j-th row of a type always pays for the j - 1 before it: its price is
    known in advance, and merging the classes greedily is one sort. Lists of several
    areas (a request whose own area has no place) go through the step by step form.
    """
    rows = features.withColumn("list_id", F.col(list_col))
    areas = rows.groupBy("list_id").agg((F.min("rec_area").eqNullSafe(F.max("rec_area"))).alias("one_area"))
    scored = with_trials(rows.join(areas, "list_id").repartition("list_id"), trials)
    scored = scored.withColumn("score", final_score([F.col(w) for w in fv.FINAL_WEIGHTS]))
    scored = scored.select("list_id", "trial_id", "one_area", F.col("raw_rank").cast("int").alias("raw_rank"), "rec_type", "rec_area", "base_score", "score", "diversity_weight")
    best = [F.desc("score"), F.desc("base_score"), F.col("raw_rank")]
    kind = F.row_number().over(W.partitionBy("list_id", "trial_id", "rec_type").orderBy(*best))
    one = scored.filter("one_area").withColumn("_nth", kind).filter(F.col("_nth") <= k)
    price = F.round(F.col("score") - F.col("diversity_weight") * F.lit(0.70) * (F.col("_nth") - 1), 9)
    position = F.row_number().over(W.partitionBy("list_id", "trial_id").orderBy(F.desc(price), *best))
    one = one.withColumn("position", position).filter(F.col("position") <= k)
    several = diverse_rerank(scored.filter("not one_area"), ("list_id", "trial_id"), k, F.col("diversity_weight"), "score").withColumn("position", F.col("rank"))
    cols = ["list_id", "trial_id", "raw_rank", "position"]
    return one.select(*cols).unionByName(several.select(*cols))


def match_options(pairs: DataFrame, k: int) -> DataFrame:
    """One row per query with matches: its lists and its options (raw_rank, pos, gold_item ...), under no trial yet.

    A candidate loses at most k-1 gold rows to better ranks, so its k best are enough.
    """
    level = lookup(F.col("method"), fv.MATCH_PRIORITY, 0)
    best = first_per(pairs, ["query_id", "list_id", "raw_rank"], [F.desc(level), F.desc("relevance"), "ord", "gold_item"], k, "pos")
    item = F.struct("raw_rank", "pos", "list_id", "gold_item", "relevance", "ord", "gold_id", "method")
    return best.groupBy("query_id").agg(F.min("list_id").alias("list_id"), F.max("list_id").alias("_other"), F.array_sort(F.collect_list(item)).alias("options"))


def match_parts(options: DataFrame) -> DataFrame:
    """(query_id, list_id, part, gain): options of a query that share candidates or gold rows, in a form that queries share.

    Options of different parts never compete, so each part is matched on its own.
    Gold rows are numbered by their first option. Where all options of a part gain
    the same, the gain stands beside the part, which then holds 1. A query that
    matches in several lists has no part; ``alone`` and ``options`` hold it whole.
    """
    gain = lambda o: F.coalesce(F.pow(F.lit(2.0), o["relevance"]) - F.lit(1.0), F.lit(0.0))
    kind = "array<struct<raw_rank:int,pos:int,gold_item:string,gain:double>>"
    plain = F.transform("options", lambda o: F.struct(o["raw_rank"].alias("raw_rank"), o["pos"].alias("pos"), o["gold_item"].alias("gold_item"), gain(o).alias("gain")))

    def join(parts, o):
        meets = lambda part: F.exists(part, lambda e: (e["raw_rank"] == o["raw_rank"]) | (e["gold_item"] == o["gold_item"]))
        return F.concat(F.filter(parts, lambda part: ~meets(part)), F.array(F.concat(F.flatten(F.filter(parts, meets)), F.array(o))))

    several = F.col("list_id") != F.col("_other")
    none = F.array(F.lit(None).cast(kind))
    parts = F.when(several, none).when(F.size("options") == 1, F.array(plain)).otherwise(F.aggregate(plain, F.array().cast(f"array<{kind}>"), join))
    rows = options.select("query_id", "list_id", F.when(several, F.col("query_id")).alias("alone"), F.when(several, F.col("options")).alias("options"), F.explode(parts).alias("_part"))
    rows = rows.withColumn("_part", F.array_sort("_part"))
    items, gains = F.transform("_part", lambda e: e["gold_item"]), F.transform("_part", lambda e: e["gain"])
    alike = F.array_min(gains) == F.array_max(gains)
    part = F.transform("_part", lambda e: F.struct(e["raw_rank"].alias("raw_rank"), e["pos"].alias("pos"), F.array_position(items, e["gold_item"]).alias("item"),
                                                  F.when(alike, 1.0).otherwise(e["gain"]).alias("gain")))
    return rows.select("query_id", "list_id", "alone", "options", part.alias("part"), F.when(alike, F.get(gains, F.lit(0))).otherwise(1.0).alias("gain"))


def part_picks(top: Column, part: Column) -> Column:
    """(rank, item, gain) of the candidates of a part that stand in a list, by rank; each takes its first gold row that is free, or none."""
    at = F.transform(top, lambda r, i: F.struct((i + 1).cast("long").alias("rank"), r.alias("raw_rank")))
    at = F.filter(at, lambda x: F.exists(part, lambda e: e["raw_rank"] == x["raw_rank"]))

    def take(done, x):
        free = F.filter(part, lambda e: (e["raw_rank"] == x["raw_rank"]) & ~F.exists(done, lambda d: d["item"].eqNullSafe(e["item"])))
        first = F.get(free, F.lit(0))
        return F.concat(done, F.array(F.struct(x["rank"].alias("rank"), first["item"].alias("item"), first["gain"].alias("gain"))))

    return F.aggregate(at, F.array().cast("array<struct<rank:bigint,item:bigint,gain:double>>"), take)


def pick_sums(pairs: DataFrame, top: DataFrame, stats: DataFrame, ks, k: int) -> DataFrame:
    """Metric sums and hits by trial and split, without queries times trials.

    pairs: matches of gold rows with the candidates of their list (raw_rank); stats:
    (query_id, split) with lists, recall and ideal gains. How a query is matched
    depends on its list and on which candidates its gold rows share, so queries
    shrink to weights per (list, part) before they meet the trials. A query that
    matches in several lists is matched as it is.
    """
    weights = {"picks": F.col("lists").cast("double"), "hits": F.lit(1.0), "recall": F.col("recall")} | {
        f"gain_{x}": F.coalesce(F.try_divide(F.col("gain"), F.col(f"idcg_{x}")), F.lit(0.0)) for x in ks}
    keys = ["list_id", "split", "part", "alone", "options"]
    rows = match_parts(match_options(pairs, k)).join(stats, "query_id")
    rows = cut_lineage(rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in weights.items()]))
    parts = rows.filter("alone is null")
    # A candidate on its own takes the first option; a gold row met twice tells that the list may hold the candidate twice.
    ranks, items = (F.array_distinct(F.transform("part", lambda e: e[c])) for c in ("raw_rank", "item"))
    single = (F.size(ranks) == 1) & (F.size(items) == F.size("part"))
    cols = ["trial_id", "split", "rank", "item", "pick_gain", *weights]
    first = F.get("part", F.lit(0))
    one = parts.filter(single).withColumns({"raw_rank": first["raw_rank"], "item": first["item"], "pick_gain": first["gain"]}).join(
        top.withColumnRenamed("position", "rank"), ["list_id", "raw_rank"]).select(*cols)
    # Lists of ten, one row per (list, trial), meet the parts that hold several candidates.
    many = parts.filter(~single)
    tops = top.join(many.select("list_id").distinct(), "list_id", "left_semi").groupBy("list_id", "trial_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "raw_rank"))), lambda x: x["raw_rank"]).alias("top"))
    many = many.join(tops, "list_id").withColumn("_p", F.explode(part_picks(F.col("top"), F.col("part"))))
    many = many.withColumns({"rank": F.col("_p.rank").cast("int"), "item": F.col("_p.item"), "pick_gain": F.col("_p.gain")}).select(*cols)
    whole = rows.filter("alone is not null").withColumnRenamed("alone", "query_id")
    placed = whole.select("query_id", F.inline("options")).distinct().join(top.withColumnRenamed("position", "rank"), ["list_id", "raw_rank"])
    taken = match_picks(placed, k, ["trial_id"]).select("trial_id", "query_id", F.inline("picks")).select("trial_id", "query_id", "rank", F.lit(1).cast("long").alias("item"), "relevance")
    mixed = placed.select("trial_id", "query_id", "rank").distinct().join(taken, ["trial_id", "query_id", "rank"], "left").join(whole.select("query_id", "split", *weights), "query_id")
    mixed = mixed.withColumn("pick_gain", F.coalesce(F.pow(F.lit(2.0), "relevance") - F.lit(1.0), F.lit(0.0))).select(*cols)
    every = one.unionByName(many).unionByName(mixed)
    sums = [F.sum("hits").alias("hits")]
    for x in ks:
        near = F.col("item").isNotNull() & (F.col("rank") <= x)
        got = F.col(f"gain_{x}") * F.col("pick_gain") / F.log2(F.col("rank") + F.lit(1.0))
        sums += [F.sum(F.when(near, F.col("picks")).otherwise(0.0) / F.lit(float(x))).alias(f"p_{x}"), F.sum(F.when(near, F.col("recall")).otherwise(0.0)).alias(f"r_{x}"),
                 F.sum(F.when(near, got).otherwise(0.0)).alias(f"ndcg_{x}")]
    return every.groupBy("trial_id", "split").agg(*sums)


def final_metrics(features: DataFrame, gold: DataFrame, groups: DataFrame, trials: DataFrame, ks=None, k: int = 10, list_col="sig", aliases=None, areas=None) -> DataFrame:
    """Metrics of every trial over every group of queries, with the objective of the final model.

    groups: (query_id, split); a query may be in several. features follow the
    in-area-or-all rule already. A gold row and a candidate that match do so under
    every trial: pairs are made once, shrink to weights per list and meet the trials
    through the positions of their candidates. Matching is one to one, by rank. Means
    over the top k count a list once for each query of the group that it serves.
    """
    ks = sorted(set(ks or fv.EVAL_KS))
    top = cut_lineage(diverse_lists(features, trials, k, list_col))
    groups = cut_lineage(groups.select("query_id", "split"))
    g = prepare_gold(gold, list_col, areas)
    pairs = match_pairs(g, prepare_recs(features, list_col, "raw_rank", areas=areas), aliases).withColumnRenamed("rank", "raw_rank")
    stats = gold_stats(g, ks).groupBy("query_id").agg(F.count("*").alias("lists"), F.sum(F.lit(1.0) / F.col("total_relevant")).alias("recall"),
                                                      *[F.max(f"idcg_{x}").alias(f"idcg_{x}") for x in ks])
    met = pick_sums(pairs, top, stats.join(groups, "query_id"), ks, k)
    served = gold.select("query_id", F.col(list_col).alias("list_id")).distinct().join(groups, "query_id").groupBy("list_id", "split").agg(F.count("*").alias("queries"))
    values = features.select(F.col(list_col).alias("list_id"), F.col("raw_rank").cast("int").alias("raw_rank"), *[F.col(c).cast("double").alias(c) for c in FINAL_MEANS.values()])
    lists = top.join(values, ["list_id", "raw_rank"]).groupBy("trial_id", "list_id").agg(F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in FINAL_MEANS.items()])
    times = lambda c: F.sum(F.col(c) * F.col("queries"))
    means = lists.join(served, "list_id").groupBy("trial_id", "split").agg(times("rows").alias("rows"), *[(times(c) / times("rows")).alias(c) for c in FINAL_MEANS])
    sizes = groups.groupBy("split").agg(F.count("*").alias("queries"))
    every = with_trials(sizes, trials.select("trial_id"))
    out = every.join(met, ["trial_id", "split"], "left").join(means, ["trial_id", "split"], "left")
    names = [f"{m}_{x}" for x in ks for m in ("p", "r", "ndcg")]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("queries") for c in names} | {c: F.coalesce(c, F.lit(0.0)) for c in FINAL_MEANS}
                          | {"hit_10": F.coalesce(F.try_divide("hits", "rows"), F.lit(0.0))})
    out = out.withColumn("objective", objective(fv.FINAL_OBJECTIVE))
    return out.select("trial_id", "split", "queries", *names, *FINAL_MEANS, "hit_10", "objective")


def search_final(features: DataFrame, gold: DataFrame, splits: DataFrame, trials: DataFrame, **options) -> DataFrame:
    """One row per trial: weights, and the metrics of train and validation queries side by side."""
    long = final_metrics(features, gold, splits, trials, **options)
    names = [c for c in long.columns if c not in ("trial_id", "split")]
    wide = long.groupBy("trial_id").agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "validation") for c in names])
    return trials.withColumn("trial_id", F.col("trial_id").cast("int")).join(wide, "trial_id")


def final_models(spark: SparkSession, best: DataFrame) -> DataFrame:
    """The five compared models as trials: trial_id, model and weights; ``best`` holds the weights that the search found in one row."""
    names = fv.FINAL_WEIGHTS
    fixed = spark.createDataFrame([(i, m, *map(float, fv.FINAL_MODEL_WEIGHTS[m])) for i, m in enumerate(("baseline", "context", "profile"), 1)], "trial_id int, model string, " + ", ".join(f"{n} double" for n in names))
    plain = {"profile_weight", "diversity_weight"}
    found = lambda i, m, without: best.select(F.lit(i).alias("trial_id"), F.lit(m).alias("model"), *[(F.lit(0.0) if n in without else F.col(n)).alias(n) for n in names])
    return fixed.unionByName(found(4, "similarity_optimized", plain)).unionByName(found(5, "final_proposed", set()))


def compare_final(features: DataFrame, gold: DataFrame, models: DataFrame, pool: DataFrame, list_col="sig", areas=None, **options) -> DataFrame:
    """Metrics of each model over all queries, with the share of gold rows that the first 50 and 100 candidates hold."""
    everyone = gold.select("query_id").distinct().withColumn("split", F.lit("full"))
    rows = final_metrics(features, gold, everyone, models.drop("model"), list_col=list_col, areas=areas, **options)
    total = gold.agg(F.count("*").alias("n")).scalar()
    found = best_ranks(gold, pool, "raw_rank", "best", list_col, areas=areas)
    recall = found.agg(F.struct(*[F.try_divide(F.count_if(F.col("best") <= x), total).alias(f"raw_recall_{x}") for x in (50, 100)]).alias("r"))
    rows = rows.join(models.select("trial_id", "model"), "trial_id").withColumn("_raw", recall.scalar())
    return rows.select("model", *[c for c in rows.columns if c not in ("trial_id", "split", "model", "_raw")], "_raw.*")
