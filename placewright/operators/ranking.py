"""Feature values and re-ranking: additive variants, tuned and final models.

Features depend on a request through its text, time and area only, so they are
computed per *signature* (distinct combination) and candidate. Functions take
rows of (signature or query columns) x (pool rows) and add columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.functions.areas import norm_area, standard_area
from placewright.functions.numbers import clamp01, overlap_ratio
from placewright.functions.text import clean, code_type, join_context, lit_array, lookup, place_key, split_tokens, sql_lit
from placewright.functions.times import hour_of, time_bucket6, time_table
from placewright.operators.blocks import block_products, token_blocks
from placewright.operators.shaping import first_per
from placewright.session import cut_lineage

SIGNATURE = ["pool_id", "area", "time", "place_type", "activity_type", "target_group", "context_tags"]


def with_signature(requests: DataFrame, cols=None) -> DataFrame:
    cols = [c for c in (cols or SIGNATURE) if c in requests.columns]
    return requests.withColumn("sig", F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def signatures(requests: DataFrame, cols=None) -> DataFrame:
    cols = [c for c in (cols or SIGNATURE) if c in requests.columns]
    return requests.select("sig", *cols).distinct()


def signature_candidates(sigs: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row per (signature, frozen candidate): at most top_k per signature."""
    return sigs.join(frozen, "pool_id")


# --- additive variants --------------------------------------------------------
def _words(words) -> str:
    return sql_lit("|".join(words))


def _word_bonus(kind: str, text: str, rules) -> Column:
    """First (type, value, words) rule that fits, on named columns."""
    arms = " ".join(f"WHEN {kind} = {sql_lit(k)} AND {text} RLIKE {_words(ws)} THEN {sql_lit(float(v))}" for k, v, ws in rules)
    return F.expr(f"CASE {arms} ELSE 0D END")


def _rule_set(text: str, rules) -> Column:
    """Every label whose words occur, on a named column."""
    arms = ", ".join(f"CASE WHEN {text} RLIKE {_words(ws)} THEN {sql_lit(n)} END" for n, ws in rules)
    return F.expr(f"array_compact(array({arms}))")


def variant_features(rows: DataFrame, online: bool = False, areas=None) -> DataFrame:
    """area/type/time/context/target bonuses.

    The online form reads more request text than the frozen-pool form.
    """
    if "_vtype" not in rows.columns:
        rows = variant_request_side(rows, online, areas)
    if "_vkind" not in rows.columns:
        rows = variant_candidate_side(rows, areas)
    out = rows.withColumns({
        "area_bonus": F.expr("CASE WHEN _vq = _vc THEN 0.18D ELSE 0D END"),
        "type_bonus": F.expr("CASE WHEN array_contains(_vtype, _vkind) THEN 0.15D WHEN _vkind = 'park' AND _vfamily THEN 0.10D ELSE 0D END"),
        "time_bonus": time_table(F.col("_vhour"), F.col("_vkind"), fv.VARIANT_TIME_BONUS, {}),
        "context_bonus": _word_bonus("_vkind", "_vcontext", fv.VARIANT_CONTEXT_BONUS),
        "target_bonus": _word_bonus("_vkind", "_vtarget", fv.VARIANT_TARGET_BONUS)})
    return out.drop("_vtype", "_vfamily", "_vcontext", "_vtarget", "_vq", "_vhour", "_vkind", "_vc")


def variant_request_side(rows: DataFrame, online: bool = False, areas=None) -> DataFrame:
    """Columns of the variants that read the request only: one row each, before
    candidates are joined."""
    type_text = ["place_type", "target_group", "context_tags"]
    context_text = ["target_group", "context_tags"]
    if online:
        type_text = ["place_type", "activity_type", "target_group", "context_tags", "evaluation_context"]
        context_text = ["activity_type", *context_text]
    have = lambda cols: [c for c in cols if c in rows.columns]
    # The online rule list lacks one senior word that the frozen one has.
    rules = [(k, [w for w in ws if not (online and k == "senior_friendly" and w == "노년")]) for k, ws in fv.EXPECTED_TYPE_RULES]
    named = rows.withColumns({"_text": join_context(*have(type_text)), "_own": clean("place_type"), "_vcontext": join_context(*have(context_text)),
                              "_vtarget": clean("target_group"), "_vq": norm_area("area", areas), "_vhour": hour_of("time")})
    return named.withColumns({"_vtype": _rule_set("_text", rules), "_vfamily": F.expr(f"_own RLIKE {_words(['체육', '어린이', '가족'])}")}).drop("_text", "_own")


def variant_candidate_side(rows: DataFrame, areas=None) -> DataFrame:
    return rows.withColumns({"_vkind": clean("rec_type"), "_vc": norm_area("rec_area", areas)})


def in_area(rows: DataFrame, key: str, areas=None) -> DataFrame:
    """Rows whose area equals the query's; a query without an area keeps all."""
    q = norm_area("area", areas)
    return rows.filter(q.isNull() | (q == F.coalesce(norm_area("rec_area", areas), F.lit("\0"))))


RANK_ORDER = ["-score", "-base_score", "raw_rank"]


def rerank_variants(rows: DataFrame, models=None, k: int = 10, key="sig", areas=None) -> DataFrame:
    """All variants in one pass: models become a column, not a loop."""
    chosen = models or fv.MODEL_VARIANTS
    scored = in_area(rows, key, areas).withColumn("model", F.explode(lit_array(chosen)))
    on = lambda *m: F.when(F.col("model").isin(*m, "combined"), 1.0).otherwise(0.0)
    bonus = {"area_bonus": on("area_weighted"), "type_bonus": on("type_weighted"), "time_bonus": on("time_weighted"),
             "context_bonus": on(), "target_bonus": on()}
    scored = scored.withColumns({c: F.col(c) * w for c, w in bonus.items()})
    total = F.col("base_score")
    for c in bonus:
        total = total + F.col(c)
    return first_per(scored.withColumn("score", F.round(total, 4)), ["model", key], RANK_ORDER, k, "rank")


# --- tuned 0-1 features -------------------------------------------------------
def categories(text_key: str, words: dict) -> Column:
    """Categories whose (normalised) keywords occur in a named key column."""
    drop = lambda ws: sorted({"".join(ch for ch in w.lower() if ch.isalnum()) for w in ws})
    return _rule_set(text_key, [(c, drop(ws)) for c, ws in words.items()])


def relatedness(cats: str, kind: str, pairs) -> Column:
    """1 for membership, else the largest pair weight, else 0 (named columns)."""
    best = ", ".join(f"CASE WHEN {kind} = {sql_lit(c)} AND array_contains({cats}, {sql_lit(q)}) THEN {sql_lit(w)} ELSE 0D END" for q, c, w in pairs)
    return F.expr(f"CASE WHEN array_contains({cats}, {kind}) THEN 1D ELSE greatest({best}) END")


def context_tag_score(tags: Column, candidate_key: Column, area_key: Column) -> Column:
    """Per tag: +.18 when contained, else +.08 when its first or last three are."""
    def add(acc, tag):
        key = F.regexp_replace(F.lower(tag), fv.KEY_DROP_PATTERN, "")
        skip = (key == "") | (key == area_key) | key.isin(fv.TUNED_STOP_TAGS)
        ends = F.contains(candidate_key, F.substring(key, 1, 3)) | F.contains(candidate_key, F.right(key, F.lit(3)))
        return (F.when(skip, acc).when(F.contains(candidate_key, key), acc + F.lit(0.18))
                .when((F.length(key) >= 3) & ends, acc + F.lit(0.08)).otherwise(acc))
    return F.aggregate(tags, F.lit(0.0), add)


def tuned_features(rows: DataFrame, areas=None) -> DataFrame:
    """Six normalised features; names match the tuned weights."""
    if "_asked" not in rows.columns:
        rows = tuned_request_side(rows, areas)
    if "_kind" not in rows.columns:
        rows = tuned_candidate_side(rows, areas)
    named = rows.withColumns({
        "_listed": context_tag_score(F.col("_tags"), F.col("_own"), F.col("_akey")), "_related": relatedness("_meant", "_kind", fv.TUNED_RELATEDNESS),
        "_goal": _word_bonus("_kind", "_target", fv.TUNED_TARGET)})
    out = named.withColumns({
        "area_bonus": F.expr("CASE WHEN _q <> '' AND _c <> '' AND _q = _c THEN 1D ELSE 0D END"),
        "type_bonus": relatedness("_asked", "_kind", fv.TUNED_RELATEDNESS),
        "time_bonus": time_table(F.col("_hour"), F.col("_kind"), fv.TUNED_TIME_TABLE, fv.TUNED_TIME_OTHER),
        "context_bonus": F.expr("CASE WHEN size(_tags) = 0 THEN 0D ELSE least(_listed + CASE WHEN array_contains(_meant, _kind) THEN 0.35D WHEN _related > 0 THEN 0.12D ELSE 0D END, 1D) END"),
        "target_bonus": F.expr("CASE WHEN _goal > 0 THEN _goal WHEN contains(_target, '일반시민') THEN 0.25D ELSE 0D END"),
        "rank_bonus": F.expr("coalesce(round(1D - (least(greatest(cast(raw_rank AS double), 1D), 50D) - 1D) / 49D, 6), 0D)")})
    return out.drop("_kind", "_own", "_akey", "_target", "_tags", "_hour", "_q", "_c", "_asked", "_meant", "_listed", "_related", "_goal")


def tuned_request_side(rows: DataFrame, areas=None) -> DataFrame:
    text = lambda *cols: place_key(join_context(*[c for c in cols if c in rows.columns]))
    named = rows.withColumns({
        "_ask": text("place_type", "target_group", "context_tags"), "_mean": text("context_tags", "target_group"), "_akey": place_key("area"),
        "_target": place_key("target_group"), "_tags": split_tokens("context_tags"), "_hour": hour_of("time"),
        "_q": standard_area("area", fv.RANK_LANDMARK_AREAS, areas)})
    return named.withColumns({"_asked": categories("_ask", fv.TUNED_CATEGORY_WORDS), "_meant": categories("_mean", fv.TUNED_CATEGORY_WORDS)}).drop("_ask", "_mean")


def tuned_candidate_side(rows: DataFrame, areas=None) -> DataFrame:
    own = place_key(join_context(*[c for c in ("rec_name", "rec_area", "rec_type", "place_id", "candidate_source") if c in rows.columns]))
    return rows.withColumns({"_kind": code_type("rec_type"), "_own": own, "_c": standard_area("rec_area", fv.RANK_LANDMARK_AREAS, areas)})


TUNED_FEATURES = ["base_score", "area_bonus", "type_bonus", "time_bonus", "context_bonus", "target_bonus", "rank_bonus"]


def weighted(features, weights) -> Column:
    total = None
    for f, w in zip(features, weights):
        term = F.col(f) * (w if isinstance(w, Column) else F.lit(float(w)))
        total = term if total is None else total + term
    return total


def rerank_tuned(rows: DataFrame, weights, k: int = 10, key="sig", areas=None) -> DataFrame:
    """Linear score, area filter, top k; queries with nothing in area drop out."""
    scored = in_area(rows, key, areas).withColumn("score", F.round(weighted(TUNED_FEATURES, weights), 6))
    return first_per(scored, [key], RANK_ORDER, k, "rank")


# --- final features -----------------------------------------------------------
def final_features(rows: DataFrame, areas=None, key="sig") -> DataFrame:
    """Thirteen expression features; style and semantic are joined separately."""
    if "_asked" not in rows.columns:
        rows = final_request_side(rows, areas)
    if "_kind" not in rows.columns:
        rows = final_candidate_side(rows, areas)
    named = rows.withColumns({"_fit": _word_bonus("_kind", "_goal", fv.FINAL_TARGET), "_related": relatedness("_meant", "_kind", fv.FINAL_RELATEDNESS),
                              "_overlap": overlap_ratio(F.col("_tags"), F.col("_ownc"))})
    kind, bucket = F.col("_kind"), F.col("_bucket")
    slot_table = {f"{b}>{k}": v for b, t in fv.FINAL_TIME_TABLE.items() for k, v in t.items()}
    footfall = F.least(F.lit(1.0), F.lit(0.55) * F.col("base_score") + F.lit(0.25) * lookup(kind, fv.FOOTFALL_TYPE, fv.FOOTFALL_TYPE_OTHER)
                       + F.lit(0.20) * lookup(bucket, fv.FOOTFALL_SLOT, fv.FOOTFALL_SLOT_OTHER))
    sizes = F.count("*").over(W.partitionBy(key, "rec_type"))
    out = named.withColumns({
        "area_match": F.expr("CASE WHEN _q <> '' AND _c <> '' AND _q = _c THEN 1D ELSE 0D END"),
        "type_match": relatedness("_asked", "_kind", fv.FINAL_RELATEDNESS), "time_match": lookup(F.concat_ws(">", "_bucket", "_kind"), slot_table, 0.0),
        "target_match": F.expr(f"CASE WHEN _fit > 0 THEN _fit WHEN _goal RLIKE {_words(['일반시민', '지역주민'])} THEN 0.30D ELSE 0D END"),
        "footfall": footfall,
        "worker": F.expr(f"least(1D, CASE WHEN _work RLIKE {_words(fv.WORKER_WORDS)} THEN 0.45D ELSE 0D END + CASE WHEN _bucket IN ('morning_commute', 'evening_commute') "
                         "THEN 0.30D ELSE 0D END + CASE _kind WHEN 'subway' THEN 0.25D WHEN 'market' THEN 0.10D ELSE 0D END)"),
        "transit": F.expr(f"CASE WHEN _kind = 'subway' OR contains(_source, 'subway') THEN 1D WHEN _name RLIKE {_words(fv.TRANSIT_NAME_WORDS)} THEN 0.65D WHEN _kind = 'market' THEN 0.25D ELSE 0.10D END"),
        "market": F.expr(f"CASE WHEN _kind = 'market' THEN 1D WHEN _name RLIKE {_words(fv.MARKET_NAME_WORDS)} THEN 0.75D WHEN _kind = 'subway' THEN 0.20D ELSE 0.05D END"),
        "welfare": F.expr(f"least(1D, CASE WHEN _welfare RLIKE {_words(fv.WELFARE_WORDS)} THEN 0.45D ELSE 0D END + CASE WHEN _kind = 'senior_friendly' THEN 0.45D ELSE 0D END "
                          f"+ CASE WHEN _kind = 'park' AND _welfare RLIKE {_words(fv.WELFARE_PARK_WORDS)} THEN 0.20D ELSE 0D END)"),
        "context_match": F.expr("least(1D, 0.75D * _related + 0.25D * _overlap)"),
        "rank_score": F.expr("greatest(0D, 1D - (cast(raw_rank AS double) - 1D) / 99D)"),
        "diversity": F.lit(1.0) / F.greatest(sizes, F.lit(1)).cast("double")})
    return out.drop("_kind", "_bucket", "_q", "_c", "_goal", "_work", "_name", "_source", "_welfare", "_tags", "_asked", "_meant", "_ownc", "_fit", "_related", "_overlap")


def final_request_side(rows: DataFrame, areas=None) -> DataFrame:
    text = lambda *cols: place_key(join_context(*[c for c in cols if c in rows.columns]))
    key_of = lambda t: F.regexp_replace(F.lower(t), fv.KEY_DROP_PATTERN, "")
    named = rows.withColumns({
        "_bucket": time_bucket6("time"), "_q": F.coalesce(norm_area("area", areas), clean("area")),
        "_ask": text("place_type", "activity_type", "target_group", "context_tags", "evaluation_context"),
        "_mean": text("place_type", "activity_type", "target_group", "context_tags"), "_goal": F.concat(place_key("target_group"), place_key("context_tags")),
        "_work": text("target_group", "context_tags"), "_welfare": text("place_type", "activity_type", "context_tags"),
        "_tags": F.array_distinct(F.transform(split_tokens("context_tags"), key_of))})
    return named.withColumns({"_asked": categories("_ask", fv.FINAL_CATEGORY_WORDS), "_meant": categories("_mean", fv.FINAL_CATEGORY_WORDS)}).drop("_ask", "_mean")


def final_candidate_side(rows: DataFrame, areas=None) -> DataFrame:
    named = rows.withColumns({
        "_kind": code_type("rec_type"), "_c": F.coalesce(norm_area("rec_area", areas), clean("rec_area")), "_name": place_key("rec_name"),
        "_source": place_key("candidate_source"), "_own": place_key(join_context("rec_type", "candidate_source"))})
    own = F.concat(F.array(place_key("rec_type"), F.col("_source"), place_key("rec_area")), categories("_own", fv.FINAL_CATEGORY_WORDS))
    return named.withColumn("_ownc", own).drop("_own")


def composite(rows: DataFrame) -> DataFrame:
    total = F.lit(0.0)
    for f, w in fv.COMPOSITE.items():
        total = total + F.lit(w) * F.col(f)
    return rows.withColumn("composite", clamp01(total))


def final_score(weights) -> Column:
    """Twelve weights (diversity acts in the greedy step) plus the rank term."""
    w = [x if isinstance(x, Column) else F.lit(float(x)) for x in weights]
    c = F.col
    return (c("base_score") * w[0] + c("area_match") * w[1] + c("type_match") * w[2] + c("time_match") * w[3]
            + c("context_match") * w[4] + c("target_match") * w[5] + (c("footfall") + c("worker")) / F.lit(2.0) * w[6]
            + c("transit") * w[7] + c("market") * w[8] + c("welfare") * w[9] + c("style") * w[10]
            + c("rank_score") * F.lit(fv.FINAL_RANK_WEIGHT))


def area_or_all(rows: DataFrame, key="sig", areas=None) -> DataFrame:
    """In-area rows; a query with none keeps its unfiltered rows."""
    q = norm_area("area", areas)
    match = q.isNull() | F.coalesce(q == norm_area("rec_area", areas), F.lit(False))
    flagged = rows.withColumn("_in", match)
    any_in = F.max("_in").over(W.partitionBy(key))
    return flagged.withColumn("_any", any_in).filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def diverse_rerank(rows: DataFrame, keys=("sig",), k: int = 10, weight: Column | float = 0.0, score="base_final") -> DataFrame:
    """Greedy top k with penalties for repeated types and areas.

    Within one (type, area) the penalty is equal, so rows leave in score order:
    the first k per (type, area) are enough, which bounds the collected array
    exactly. The state (picks and what is left) folds over 1..k; with weight 0
    the result is the plain top k.
    """
    order = [F.desc(score), F.desc("base_score"), "raw_rank"]
    bounded = first_per(rows, [*keys, "rec_type", "rec_area"], order, k)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    item = F.struct((-F.col(score)).alias("neg"), (-F.col("base_score")).alias("nb"), F.col("raw_rank").cast("int").alias("raw_rank"),
                    F.col("rec_type").alias("t"), F.col("rec_area").alias("a"))
    lists = bounded.withColumn("_w", w).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_left"), F.max("_w").alias("_w"))

    def count(done, field, value):
        return F.size(F.filter(done, lambda d: d[field] == value)).cast("double")

    def step(done, _):
        left = F.filter(F.col("_left"), lambda c: ~F.exists(done, lambda d: d["raw_rank"] == c["raw_rank"]))
        scored = F.transform(left, lambda c, i: F.struct(
            (c["neg"] + F.col("_w") * (count(done, "t", c["t"]) * F.lit(0.70)
             + F.greatest(F.lit(0.0), count(done, "a", c["a"]) - F.lit(2.0)) * F.lit(0.30))).alias("neg"),
            i.alias("pos"), c["raw_rank"].alias("raw_rank"), c["t"].alias("t"), c["a"].alias("a")))
        best = F.array_min(scored)
        return F.when(F.size(left) == 0, done).otherwise(F.concat(done, F.array(best)))

    empty = F.array().cast("array<struct<neg:double,pos:int,raw_rank:int,t:string,a:string>>")
    picked = lists.withColumn("_picks", F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step))
    ranks = picked.select(*keys, F.posexplode("_picks").alias("_p", "_c")).select(
        *keys, (F.col("_p") + 1).alias("rank"), F.col("_c.raw_rank").alias("raw_rank"), F.round(-F.col("_c.neg"), 6).alias("score"))
    return rows.join(ranks, [*keys, "raw_rank"])


def explanation() -> Column:
    """Up to four reasons by threshold."""
    c = F.col
    parts = F.array_compact(F.array(
        F.when(c("area_match") >= 0.9, F.concat(clean("rec_area"), F.lit(" 자치구 조건과 일치"))),
        F.when(c("type_match") >= 0.7, F.concat(clean("rec_type"), F.lit(" 유형이 일정 문맥과 유사"))),
        F.when(c("time_match") >= 0.7, F.lit("입력 시간대의 유동·접촉 가능성이 높음")),
        F.when(c("target_match") >= 0.7, F.lit("목표 유권자 조건과 부합")),
        F.when(c("style") >= 0.2, F.lit("후보 일정 profile과 유사한 장소 유형")),
        F.when(c("transit") >= 0.8, F.lit("교통 접근성이 높은 후보지")),
        F.when(c("market") >= 0.8, F.lit("시장·상권 접촉에 적합")),
        F.when(c("welfare") >= 0.7, F.lit("복지·정책 현장 맥락과 연결"))))
    used = F.when(F.size(parts) == 0, F.array(F.lit("기존 공공데이터 기반 baseline 점수가 높음"))).otherwise(F.slice(parts, 1, 4))
    return F.concat(F.lit("이 장소는 "), F.array_join(used, ", "), F.lit("으로 평가되어 상위 추천에 배치되었다."))


# --- actor profiles and text similarity ---------------------------------------
def actor_profiles(gold: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Long table (actor, dim, key, p): shares of categories, areas, times, activities.

    ``priors`` has (actor, key, p): blended as max(share, 0.35 p), and used as
    they are for actors without history.
    """
    # Requests share few texts: their keys are made once per distinct row.
    told = [c for c in ["actor", "place_type", "activity_type", "target_group", "context_tags", "area", "time"] if c in gold.columns]
    gold = gold.groupBy(*told).agg(F.count("*").alias("_n"))
    gold = gold.withColumn("_key", place_key(join_context("place_type", "activity_type", "target_group", "context_tags")))
    cats = categories("_key", fv.FINAL_CATEGORY_WORDS)
    cats = F.when(F.size(cats) == 0, F.array(F.lit("unknown"))).otherwise(cats)
    dims = F.concat(
        F.transform(cats, lambda c: F.struct(F.lit("category").alias("dim"), c.alias("key"))),
        F.array(F.struct(F.lit("area").alias("dim"), clean("area").alias("key")),
                F.struct(F.lit("time").alias("dim"), time_bucket6("time").alias("key")),
                F.struct(F.lit("activity").alias("dim"), clean("activity_type").alias("key"))))
    counted = gold.select("actor", "_n", F.inline(dims)).groupBy("actor", "dim", "key").agg(F.sum("_n").alias("n"))
    total = F.sum("n").over(W.partitionBy("actor", "dim"))
    shares = counted.select("actor", "dim", "key", (F.col("n") / total).alias("p"))
    if priors is None:
        return shares
    prior = priors.select("actor", F.lit("category").alias("dim"), "key", F.col("p").alias("prior"))
    seen = shares.select("actor", F.lit(True).alias("_seen")).distinct()
    joined = shares.join(prior, ["actor", "dim", "key"], "full").join(seen, "actor", "left")
    blended = F.greatest(F.coalesce("p", F.lit(0.0)), F.coalesce("prior", F.lit(0.0)) * F.lit(fv.PRIOR_DISCOUNT))
    return joined.select("actor", "dim", "key", F.when(F.col("_seen").isNull(), F.col("prior")).otherwise(blended).alias("p"))


def with_style(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Actor style: .70 p(type) + .15 p(area) + .15 p(time), capped at 1.

    Profiles shrink to one row per actor: maps bounded by the dictionaries.
    """
    maps = profiles.filter("dim <> 'activity'").groupBy("actor").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "dim", "key"), "p"))).alias("_profile"))
    joined = rows.join(maps, "actor", "left")
    get = lambda dim, c: F.coalesce(F.try_element_at("_profile", F.concat_ws(":", F.lit(dim), c)), F.lit(0.0))
    style = (F.lit(0.70) * get("category", code_type("rec_type")) + F.lit(0.15) * get("area", clean("area"))
             + F.lit(0.15) * get("time", time_bucket6("time")))
    return joined.withColumn("style", F.least(F.lit(1.0), style)).drop("_profile")


def top_shares_text(profiles: DataFrame, n: int = 4) -> DataFrame:
    """``key:0.000`` of the largest shares per (actor, dim), joined."""
    top = first_per(profiles, ["actor", "dim"], [F.desc("p"), "key"], n, "_r")
    item = F.struct("_r", F.concat(F.col("key"), F.lit(":"), F.format_string("%.3f", "p")).alias("t"))
    return top.groupBy("actor", "dim").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("top"))


#: Texts of these characters only have no character that NFKC changes or joins.
_SETTLED = "^[\\x00-\\x7F\\u00C0-\\u00FF\\u0152\\u0153가-힣]*$"


def document_tokens(c) -> Column:
    """Comparison keys of a text's tokens, those of two characters or more; each token is normalised (NFKC) on its own."""
    short = F.transform(split_tokens(c), lambda t: F.regexp_replace(F.lower(t), fv.KEY_DROP_PATTERN, ""))
    keys = F.when(clean(c).rlike(_SETTLED), short).otherwise(F.transform(split_tokens(c), place_key))
    return F.filter(keys, lambda k: F.length(k) >= 2)


def token_idf(weighted_docs: DataFrame, tokens="tokens", weight="copies") -> DataFrame:
    """(token, idf, n): idf = ln((N+1)/(df+1)) + 1 where documents count ``weight`` times.

    A row may stand for a block of ``weight`` documents; its counts then say how many of them hold each token.
    """
    n = weighted_docs.agg(F.sum(weight).alias("n"))
    own = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.col(weight).cast("long").alias("w")))
    if "counts" in weighted_docs.columns:
        own = F.when(F.col("counts").isNull(), own).otherwise(F.zip_with(tokens, "counts", lambda t, c: F.struct(t.alias("token"), c.alias("w"))))
    rows = weighted_docs.select(F.inline(own))
    df = rows.groupBy("token").agg(F.sum("w").alias("df"))
    return df.select("token", "df", (F.ln((n.scalar() + 1) / (F.col("df") + 1)) + F.lit(1.0)).alias("idf"))


def doc_vectors(docs: DataFrame, idf: DataFrame, key="doc", tokens="tokens", salts: int = 16) -> DataFrame:
    """(doc, token, w): tf/len x idf. A frequent token is a hot join key, so the
    token rows are salted by document and the idf table is copied per salt.

    Blocks of documents (``token_blocks``) stay blocks: block, docs, tokens, body,
    and known, the idf of each token by its place. A block deals out each of its
    tokens once, however many documents hold it. A vector there is tf x idf, which
    has the same cosine."""
    from placewright.operators.shaping import salted_join

    if "body" in docs.columns:
        words = docs.select("block", F.posexplode(tokens).alias("at", "token")).join(idf.select("token", "idf"), "token")
        known = words.groupBy("block").agg(F.collect_list(F.struct("at", "idf")).alias("known"))
        return cut_lineage(docs.select("block", "docs", tokens, "body").join(known, "block", "left"))
    flat = docs.select(key, F.size(tokens).alias("len"), F.explode(tokens).alias("token"))
    tf = flat.groupBy(key, "token").agg(F.count("*").alias("n"), F.first("len").alias("len"))
    joined = salted_join(tf, idf.select("token", "idf"), ["token"], "inner", salts, [key])
    return joined.select(key, "token", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, lk="left_doc", rk="right_doc") -> DataFrame:
    """Cosine of given document pairs; never forms pairs that were not asked for.

    The left vectors may be blocks (``doc_vectors``): then the right vectors that a block's documents are paired with go to the block."""
    asked = pairs.select(lk, rk).distinct()
    if "body" in left.columns:
        sums = _block_sums(asked, left, right, lk, rk)
    else:
        l = left.select(F.col("doc").alias(lk), "token", F.col("w").alias("lw"))
        r = right.select(F.col("doc").alias(rk), "token", F.col("w").alias("rw"))
        # One pass over the left vectors gives their products and their norms.
        met = asked.join(l, lk).join(r, [rk, "token"], "left")
        sums = met.groupBy(lk, rk).agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"), F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("ln"))
    rn = right.groupBy(F.col("doc").alias(rk)).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    out = asked.join(sums, [lk, rk], "left").join(rn, rk, "left")
    sim = F.coalesce(F.try_divide(F.col("dot"), F.col("ln") * F.col("rn")), F.lit(0.0))
    return out.select(lk, rk, sim.alias("semantic"))


def _block_sums(asked: DataFrame, left: DataFrame, right: DataFrame, lk: str, rk: str) -> DataFrame:
    places = left.select("block", F.posexplode("docs").alias("at", lk)).join(asked, lk)
    wanted = places.groupBy("block").agg(F.collect_list(F.struct("at", F.col(rk).alias("right"))).alias("asked"))
    vectors = right.groupBy(F.col("doc").alias(rk)).agg(F.collect_list(F.struct("token", "w")).alias("vector"))
    items = places.select("block", rk).distinct().join(vectors, rk).groupBy("block").agg(F.collect_list(F.struct(F.col(rk).alias("right"), "vector")).alias("items"))
    return block_products(left.join(wanted, "block").join(items, "block", "left"), lk, rk)


def with_semantic(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """TF-IDF cosine between request text and candidate text, per row.

    The corpus holds a request document and a candidate document per row, so
    document frequencies count rows. Rows share few distinct documents: those
    are vectorised once, with their row counts as weights. ``copies`` names a
    column with the number of original rows behind each given row.
    """
    have = [c for c in ["place_type", "activity_type", "target_group", "context_tags", "area", "time"] if c in rows.columns]
    ask = F.concat_ws(" ", *[clean(c) for c in have])
    rows = rows.withColumn("_own", place_key(join_context("rec_type", "candidate_source")))
    derived = F.array_join(F.array_sort(categories("_own", fv.FINAL_CATEGORY_WORDS)), ";")
    own = F.concat_ws(" ", clean("rec_type"), clean("candidate_source"), clean("rec_area"), derived, time_bucket6("time"))
    # Read eight times below: cut here, so that the features are computed once.
    told = cut_lineage(rows.withColumns({"left_doc": ask, "right_doc": own}).drop("_own"))
    weight = F.col(copies) if copies else F.lit(1)
    count = lambda c: told.groupBy(F.col(c).alias("doc")).agg(F.sum(weight).alias("copies")).withColumn("tokens", document_tokens("doc"))
    asks, owns = count("left_doc"), count("right_doc")
    idf = token_idf(asks.unionByName(owns))
    sims = pair_cosine(told, doc_vectors(asks, idf), doc_vectors(owns, idf))
    return told.join(sims, ["left_doc", "right_doc"], "left").drop("left_doc", "right_doc")
