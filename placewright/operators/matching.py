"""Matching recommended places to observed (gold) places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import standard_area
from placewright.functions.text import clean, lit_array, lookup, partial_match, place_key, ratio, relaxed_key
from placewright.operators.shaping import first_per, salted_join
from placewright.session import cut_lineage

DETECTION = ["exact", "normalized", "alias", "partial"]


def _std(c: str, areas) -> Column:
    return standard_area(c, fv.ALIAS_LANDMARK_AREAS, areas)


def prepare_gold(gold: DataFrame, list_col="query_id", areas=None) -> DataFrame:
    """Item ids and raw texts; ``ord`` states the file order.

    Keys and areas are made in ``match_pairs``, once per distinct text of a list;
    the known areas travel as metadata of g_area.
    """
    listed, name, given, area = gold_text(gold, list_col)
    order = F.col("ord") if "ord" in gold.columns else F.col("gold_id")
    return gold.select(
        F.col("query_id"), listed.alias("list_id"), gold_item(gold).alias("gold_item"), F.col("gold_id").cast("string").alias("gold_id"),
        name.alias("g_name"), given.alias("g_given"), area.alias("g_area", metadata={"areas": list(areas or [])}),
        F.col("relevance").cast("double").alias("relevance"), order.alias("ord"))


def gold_text(gold: DataFrame, list_col="query_id") -> list[Column]:
    """List, name, given key and area of each gold row: what a text is made of."""
    given = F.col("place_key").cast("string") if "place_key" in gold.columns else F.lit(None).cast("string")
    return [F.col(list_col), F.col("place_name"), given, F.col("area")]


def gold_item(gold: DataFrame) -> Column:
    order = F.col("ord") if "ord" in gold.columns else F.col("gold_id")
    return F.coalesce(F.nullif(clean(F.col("gold_id").cast("string")), F.lit("")),
                      F.concat_ws("|", F.col("query_id").cast("string"), "place_name", order.cast("string")))


TEXT = ["g_name", "g_given", "g_area"]
#: Most hashes of matched texts that are sent to every task, 8 bytes each.
MARKS = 1_000_000


def gold_texts(gold: DataFrame) -> DataFrame:
    """Distinct texts of each list (list_id, t_name, t_given, t_area) with name, key, bare key and standard area.

    Many gold rows of a list share a text, and a text costs far more to normalise
    than a row to read.
    """
    areas = gold.schema["g_area"].metadata.get("areas") or None
    texts = gold.select("list_id", *[F.col(c).alias(c.replace("g_", "t_")) for c in TEXT]).distinct()
    keyed = texts.select("*", clean("t_name").alias("g_name"), F.coalesce(F.nullif(clean("t_given"), F.lit("")), place_key("t_name")).alias("g_key"),
                         _std("t_area", areas).alias("g_area"))
    return _with_bare(keyed, "g")


def prepare_recs(recs: DataFrame, list_col="query_id", rank="rank", most=None, by=(), areas=None) -> DataFrame:
    rows = recs if most is None else recs.filter(F.col(rank) <= most)
    area = "rec_area" if "rec_area" in recs.columns else None
    return rows.select(*by, F.col(list_col).alias("list_id"), F.col(rank).cast("int").alias("rank"), clean("rec_name").alias("r_name"),
                       place_key("rec_name").alias("r_key"), (_std(area, areas) if area else F.lit("")).alias("r_area"))


def _with_bare(df: DataFrame, side: str) -> DataFrame:
    key = F.col(f"{side}_key")
    return df.withColumn(f"{side}_bare", F.nullif(relaxed_key(key), key))


def method_of() -> Column:
    """exact / normalized / partial on prepared columns; null when none holds.

    r_bare and g_bare are the keys without generic tokens, made once per row, or
    null where that is the key itself.
    """
    bare = lambda side: F.coalesce(f"{side}_bare", f"{side}_key")
    keys = (F.col("r_key") != "") & (F.col("g_key") != "")
    return (F.when(F.col("r_name") == F.col("g_name"), "exact").when(keys & (F.col("r_key") == F.col("g_key")), "normalized")
            .when(keys & partial_match(F.col("r_key"), F.col("g_key"), bare("r"), bare("g")), "partial"))


def _guard() -> Column:
    same_area = (F.col("r_area") == "") | (F.col("g_area") == "") | (F.col("r_area") == F.col("g_area"))
    return (F.col("r_name") != "") & (F.col("g_name") != "") & same_area


def alias_edges(aliases: DataFrame) -> DataFrame:
    """(scope, from_key, to_key): one hop, both directions, self excluded."""
    rows = aliases.select(F.col("std_area").alias("scope"), "canonical_key", "alias_key")
    pair = lambda a, b: rows.select("scope", F.col(a).alias("from_key"), F.col(b).alias("to_key"))
    both = pair("canonical_key", "alias_key").unionByName(pair("alias_key", "canonical_key"))
    return both.filter("from_key <> to_key and from_key <> '' and to_key <> ''").distinct()


def alias_hits(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Those of the distinct (g_key, r_key, where) whose one-hop key sets meet, by equi-joins on keys and areas.

    An alias holds in its own area, or everywhere where it names none, so a key
    meets only the aliases of the area it is compared in.
    """
    edges = alias_edges(aliases)
    triple = ["g_key", "r_key", "where"]
    scoped = lambda df: df.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit(""), F.col("where")))))
    one = salted_join(scoped(names).withColumn("from_key", F.col("g_key")), edges, ["scope", "from_key"]).select(*triple, "to_key").distinct()
    back = edges.select("scope", F.col("from_key").alias("r_key"), "to_key")
    met = scoped(one).join(back, ["scope", "r_key", "to_key"], "left_semi").select(*triple)
    return one.filter("to_key = r_key").select(*triple).unionByName(met).distinct()


def text_pairs(texts: DataFrame, recs: DataFrame, aliases: DataFrame | None = None, by=()) -> DataFrame:
    """Matching (text, recommendation) pairs of the same list with the method: *by, list_id, t_name, t_given, t_area, rank, method.

    With aliases each pair stands once, with the first method in detection order.
    """
    cols = [*by, "list_id", "t_name", "t_given", "t_area", "rank", "method"]
    met = texts.join(_with_bare(recs, "r"), "list_id").filter(_guard()).withColumn("method", method_of())
    if aliases is None:
        return met.filter("method is not null").select(*cols)
    met = cut_lineage(met.select(*cols, "g_key", "r_key", F.coalesce(F.nullif("r_area", F.lit("")), "g_area").alias("where")))
    names = met.filter("method is null or method = 'partial'").select("g_key", "r_key", "where").distinct()
    hits = alias_hits(names, aliases).withColumn("hit", F.lit("alias"))
    open_to = met.filter("method is null or method = 'partial'").join(hits, ["g_key", "r_key", "where"], "left")
    found = met.filter("method in ('exact', 'normalized')").select(*cols).unionByName(
        open_to.withColumn("method", F.coalesce("hit", "method")).filter("method is not null").select(*cols))
    level = F.array_position(lit_array(DETECTION), F.col("method"))
    return found.groupBy(*[c for c in cols if c != "method"]).agg(F.min(level).alias("_seq")).select(
        *[c for c in cols if c != "method"], F.element_at(lit_array(DETECTION), F.col("_seq").cast("int")).alias("method"))


def match_pairs(gold: DataFrame, recs: DataFrame, aliases: DataFrame | None = None, by=()) -> DataFrame:
    """Matching (gold, recommendation) pairs of the same list with the method.

    Texts are compared once per list; gold rows only join what their text matched,
    so keys, areas and name predicates cost by distinct text, not by gold row. With
    aliases the first method in detection order wins.
    """
    found, marks = matched_texts(gold, recs, aliases, by)
    return pairs_of(gold, found, marks, aliases, by)


def text_mark(cols) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def matched_texts(gold: DataFrame, recs: DataFrame, aliases: DataFrame | None = None, by=()) -> tuple[DataFrame, DataFrame | None]:
    """Matching (text, recommendation) pairs, and the hashes of their texts (_mark) where these are few."""
    found = cut_lineage(text_pairs(gold_texts(gold), recs, aliases, by).withColumnRenamed("list_id", "t_list"))
    marks = found.select(text_mark(["t_list", *[c.replace("g_", "t_") for c in TEXT]]).alias("_mark")).distinct()
    return found, marks if marks.limit(MARKS + 1).count() <= MARKS else None


def pairs_of(gold: DataFrame, found: DataFrame, marks: DataFrame | None, aliases: DataFrame | None = None, by=()) -> DataFrame:
    """The pairs of matched texts for the gold rows that have these texts."""
    cols = [*by, "query_id", "list_id", "rank", "gold_item", "gold_id", "relevance", "ord", "method"]
    # Few gold rows match: the hashes of matched texts, where they are few, keep the others out of the join's shuffle.
    if marks is not None:
        gold = gold.join(F.broadcast(marks), text_mark(["list_id", *TEXT]) == F.col("_mark"), "left_semi")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(c.replace("g_", "t_"))) for c in TEXT], F.col("list_id") == F.col("t_list"))
    pairs = gold.join(found, same).select(*cols)
    if aliases is None:
        return pairs
    seq = F.array_position(lit_array(DETECTION), F.col("method"))
    return first_per(pairs.withColumn("_seq", seq), [*by, "query_id", "list_id", "rank", "gold_item"], ["_seq"]).drop("_seq")


def match_picks(pairs: DataFrame, k: int, by=()) -> DataFrame:
    """Greedy one-to-one matching per query, recommendations in rank order.

    A recommendation can lose at most k-1 gold rows to better ranks, so its k
    best (priority, relevance, order) are enough: at most k*k entries per query
    are collected, however many gold rows a query has.
    """
    level = lookup(F.col("method"), fv.MATCH_PRIORITY, 0)
    best = first_per(pairs, [*by, "query_id", "rank"], [F.desc(level), F.desc("relevance"), "ord", "gold_item"], k, "pos")
    item = F.struct("rank", "pos", "gold_item", "gold_id", "relevance", "method")
    lists = best.groupBy(*by, "query_id").agg(F.array_sort(F.collect_list(item)).alias("options"))
    empty = F.array().cast("array<struct<rank:int,pos:int,gold_item:string,gold_id:string,relevance:double,method:string>>")
    take = lambda done, x: F.when(
        F.exists(done, lambda d: (d["rank"] == x["rank"]) | (d["gold_item"] == x["gold_item"])), done).otherwise(
        F.concat(done, F.array(x)))
    return lists.select(*by, "query_id", F.aggregate("options", empty, take).alias("picks"))


def first_gold(pairs: DataFrame, by=()) -> DataFrame:
    """First gold row (file order) that matches each recommendation."""
    return first_per(pairs, [*by, "query_id", "rank"], ["ord", "gold_item"])


def hit_flags(recs: DataFrame, pairs: DataFrame, key=("query_id", "rank")) -> DataFrame:
    hits = pairs.select(*key).distinct().withColumn("exact_place_hit", F.lit(True))
    return recs.join(hits, list(key), "left").na.fill(False, ["exact_place_hit"])


# --- fuzzy alias-to-gold join ---------------------------------------------------
def grams(key: Column, n: int = 2) -> Column:
    """Distinct character n-grams of a key; a shorter key is its own gram."""
    count = F.greatest(F.length(key) - n + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(key, i, n)))


def near_pairs(left: DataFrame, right: DataFrame, lk: str, rk: str, floor: float = 0.90) -> DataFrame:
    """Distinct key pairs that are equal, contained (both >= 4) or similar.

    Blocking is lossless: equality, containment and ratio are three equi-joins
    (on the key, on substrings of the lengths that occur, on intact pieces), and
    only pairs that share a piece at a nearby place reach Python.
    """
    a = left.select(F.col(lk).alias("a")).filter("a <> ''").distinct()
    b = right.select(F.col(rk).alias("b")).filter("b <> ''").distinct()
    equal = a.join(b, F.col("a") == F.col("b"))
    held = _containment(a, b, "a", "b").unionByName(_containment(b, a, "b", "a").select("a", "b"))
    similar = _piece_pairs(a, b, floor).filter(ratio("a", "b") >= floor)
    pairs = equal.unionByName(held).unionByName(similar).distinct()
    return pairs.withColumn("similarity", F.when(F.col("a") == F.col("b"), 1.0).otherwise(ratio("a", "b")))


def _containment(inner: DataFrame, outer: DataFrame, ic: str, oc: str, least: int = 4) -> DataFrame:
    """Pairs where the inner key is a substring of the outer: equi-join of inner
    keys with the outer's substrings of the lengths that occur."""
    lengths = inner.filter(F.length(ic) >= least).select(F.length(ic).alias("n")).distinct()
    sets = lengths.agg(F.array_sort(F.collect_set("n")).alias("ns"))
    subs = outer.filter(F.length(oc) >= least).withColumn("_n", F.explode(sets.scalar()))
    subs = subs.filter(F.col("_n") < F.length(oc)).withColumn("_s", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(oc) - F.col("_n") + 1), lambda i: F.substring(F.col(oc), i, F.col("_n"))))))
    return inner.join(subs.select(oc, F.col("_s").alias(ic)), ic).select("a", "b")


def _piece_pairs(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """Candidate pairs for the ratio: an intact piece, lengths within bounds.

    If M matched characters give 2M/(la+lb) >= floor, then lb <= la(2-floor)/floor
    and at most u = (la+lb)(1-floor) characters of both keys stay unmatched.
    Each unmatched character breaks at most one piece of the first key, so of
    u+1 pieces one is matched whole.
    """
    def pieces(df, c, other):
        n = F.length(c)
        longest = F.floor(n * (2 - floor) / floor)
        spare = F.floor((n + longest) * (1 - floor)).cast("int")
        parts = F.least(spare + 1, n)
        start = lambda i: F.floor(i * n / parts).cast("int")
        return df.withColumn("_spare", spare).select(c, "_spare", F.inline(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(
            F.substring(F.col(c), start(i) + 1, start(i + 1) - start(i)).alias("_p"), start(i).alias("_at")))))

    def grams_of(df, c, sizes):
        rows = df.withColumn("_n", F.explode(sizes.scalar())).filter(F.col("_n") <= F.length(c))
        return rows.select(c, F.inline(F.transform(F.sequence(F.lit(1), F.length(c) - F.col("_n") + 1), lambda i: F.struct(
            F.substring(F.col(c), i, F.col("_n")).alias("_p"), (i - 1).alias("_to")))))

    cut = pieces(a, "a", "b")
    sizes = cut.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("ns"))
    close = (F.length("a") * (2 - floor) / floor >= F.length("b")) & (F.length("b") * (2 - floor) / floor >= F.length("a"))
    # An intact piece moves by at most the unmatched characters before it.
    near = F.abs(F.col("_at") - F.col("_to")) <= F.col("_spare")
    return cut.join(grams_of(b, "b", sizes), "_p").filter(close & near & (F.col("a") != F.col("b"))).select("a", "b").distinct()
