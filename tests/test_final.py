"""Final-model lists and metrics, relaxation, fillers and traces, next to plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from placewright import fixed_values as fv
from placewright.operators import evaluation, quality, routes, search

NAMES = fv.FINAL_WEIGHTS
USED = ["base_score", "area_match", "type_match", "time_match", "context_match", "target_match", "footfall", "worker", "transit", "market", "welfare", "style", "rank_score", "composite"]


@pytest.fixture(scope="module")
def features(spark):
    """Lists of one area and of several, with ties."""
    rng = random.Random(2)
    rows = []
    for n, areas in enumerate([["a"], ["a"], ["a", "b"], ["a", "b", "c"], ["c"]]):
        for rank in range(1, 26):
            value = lambda: rng.choice([0.0, 0.2, 0.5, 0.9])  # noqa: B023, E731
            rows.append((f"s{n}", rank, f"name {rng.randint(0, 30)}", rng.choice(areas), rng.choice(["park", "market", "subway"]), *[value() for _ in USED]))
    return rows, spark.createDataFrame(rows, "sig string, raw_rank int, rec_name string, rec_area string, rec_type string, " + ", ".join(f"{c} double" for c in USED)).repartition(3)


@pytest.fixture(scope="module")
def trials(spark):
    rng = random.Random(4)
    values = [(i, *[float(rng.choice(g)) for g in fv.FINAL_GRID[:-1]], d) for i, d in enumerate((0.0, 0.05, 0.1, 1.0, 0.3), 1)]
    return values, spark.createDataFrame(values, "trial_id int, " + ", ".join(f"{n} double" for n in NAMES))


def score(row, w):
    f = dict(zip(USED, row[5:]))
    pairs = [f["base_score"], f["area_match"], f["type_match"], f["time_match"], f["context_match"], f["target_match"], (f["footfall"] + f["worker"]) / 2, f["transit"], f["market"], f["welfare"], f["style"]]
    return sum(a * b for a, b in zip(pairs, w)) + f["rank_score"] * fv.FINAL_RANK_WEIGHT


def greedy(rows, w, k):
    """Pick by pick, every row that is left priced by what is picked."""
    left = sorted(((score(r, w), r) for r in rows), key=lambda x: (-round(x[0], 9), -x[1][5], x[1][1]))
    done = []
    while left and len(done) < k:
        price = lambda r: w[11] * (0.7 * sum(d[4] == r[4] for d in done) + 0.3 * max(0, sum(d[3] == r[3] for d in done) - 2))  # noqa: B023, E731
        best = min(range(len(left)), key=lambda i: (round(price(left[i][1]) - left[i][0], 9), i))  # noqa: B023
        done.append(left.pop(best)[1])
    return [d[1] for d in done]


def test_diverse_lists_equal_step_by_step(spark, features, trials):
    (rows, df), (values, table) = features, trials
    got = {}
    for r in search.diverse_lists(df, table, 6).orderBy("position").collect():
        got.setdefault((r.list_id, r.trial_id), []).append(r.raw_rank)
    want = {(s, t[0]): greedy([r for r in rows if r[0] == s], t[1:], 6) for s in {r[0] for r in rows} for t in values}
    assert got == want


def test_search_final_metrics(spark, features, trials):
    """Plain metrics of each trial: one-to-one matching by rank, means over what is shown."""
    (rows, df), (values, table) = features, trials
    rng = random.Random(6)
    gold = [(f"q{q}", f"g{q}-{i}", rng.choice([r for r in rows if r[0] == f"s{q % 5}"])[2], "", rng.randint(1, 3), f"s{q % 5}") for q in range(9) for i in range(3)]
    g = spark.createDataFrame(gold, "query_id string, gold_id string, place_name string, area string, relevance int, sig string")
    split = {f"q{q}": "train" if q < 6 else "validation" for q in range(9)}
    splits = spark.createDataFrame(list(split.items()), "query_id string, split string")
    got = {r.trial_id: r for r in search.search_final(df, g, splits, table, ks=[1, 3, 10], k=3).collect()}
    import math

    by_name = {(r[0], r[1]): r for r in rows}
    for t in values:
        lists = {s: [by_name[s, n] for n in greedy([r for r in rows if r[0] == s], t[1:], 3)] for s in {r[0] for r in rows}}
        sums, shown = {"p_3": 0.0, "ndcg_3": 0.0}, []
        for q in [q for q, s in split.items() if s == "train"]:
            mine = [x for x in gold if x[0] == q]
            used, dcg, hits = set(), 0.0, 0
            for rank, row in enumerate(lists[mine[0][5]], 1):
                shown.append(row)
                same = [x for x in mine if x[1] not in used and (x[2] in row[2] or row[2] in x[2] or x[2].replace(" ", "") in row[2].replace(" ", "") or row[2].replace(" ", "") in x[2].replace(" ", ""))]
                if same:
                    best = min(same, key=lambda x: (x[2] != row[2], -x[4], x[1]))
                    used.add(best[1])
                    hits, dcg = hits + 1, dcg + (2 ** best[4] - 1) / math.log2(rank + 1)
            ideal = sum((2 ** r - 1) / math.log2(i + 1) for i, r in enumerate(sorted((x[4] for x in mine), reverse=True)[:3], 1))
            sums["p_3"] += hits / 3 / 6
            sums["ndcg_3"] += dcg / ideal / 6
        assert got[t[0]].train_p_3 == pytest.approx(sums["p_3"]) and got[t[0]].train_ndcg_3 == pytest.approx(sums["ndcg_3"])
        assert got[t[0]].train_composite_10 == pytest.approx(sum(r[-1] for r in shown) / len(shown))
        assert got[t[0]].train_queries == 6 and got[t[0]].validation_queries == 3


def test_pick_sums_equal_row_by_row_matching(spark):
    """Weights per (list, part) give what matching every query under every trial gives; alike queries share one row."""
    rng = random.Random(9)
    pairs = []
    for q in range(60):
        lists = ["a", "b"] if q % 20 == 7 else ["ab"[q % 2]]
        for i in range(rng.randint(1, 5)):
            for sig in lists:
                for r in rng.sample(range(1, 9), rng.randint(1, 2)):
                    pairs += [(f"q{q}", sig, r, f"g{i}", f"g{i}", float(rng.randint(1, 3)), f"g{i}", rng.choice(["exact", "partial"]))] * (1 + (q % 10 == 3)) * (1 + (sig == "b" and r == 2))
    df = spark.createDataFrame(pairs, "query_id string, list_id string, raw_rank int, gold_item string, gold_id string, relevance double, ord string, method string")
    tops = [(s, t, r, p) for s in "ab" for t in (1, 2, 3) for p, r in enumerate(rng.sample([1, 3, 4, 5, 6, 7, 8], 4) + ([2, 2] if s == "b" else [2]), 1)]
    top = spark.createDataFrame(tops, "list_id string, trial_id int, raw_rank int, position int")
    stats = spark.createDataFrame([(f"q{q}", s, 1, 0.25, 2.0 + q % 3) for q in range(60) for s in ("train", "validation")[: 1 + (q % 4 == 0)]], "query_id string, split string, lists int, recall double, idcg_6 double")
    got = {(r.trial_id, r.split): r for r in search.pick_sums(df, top, stats, [6], 6).collect()}
    from placewright.operators.matching import match_picks

    placed = df.join(top.withColumnRenamed("position", "rank"), ["list_id", "raw_rank"])
    picks = match_picks(placed, 6, ["trial_id"]).select("trial_id", "query_id", F.inline("picks")).join(stats, "query_id")
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1) / F.col("idcg_6")
    want = picks.groupBy("trial_id", "split").agg(F.count("*").alias("n"), F.sum("recall").alias("r"), F.sum(gain).alias("d")).collect()
    hits = {(r.trial_id, r.split): r["count"] for r in placed.select("trial_id", "query_id", "rank").distinct().join(stats, "query_id").groupBy("trial_id", "split").count().collect()}
    assert len(want) == len(got) == 6
    for w in want:
        g = got[w.trial_id, w.split]
        assert (g.p_6 * 6, g.r_6, g.ndcg_6) == pytest.approx((w.n, w.r, w.d)) and g.hits == hits[w.trial_id, w.split]
    alike = spark.createDataFrame([(f"q{q}", "a", 3, f"g{q}", f"g{q}", 2.0, f"g{q}", "exact") for q in range(50)], df.schema)
    assert search.match_parts(search.match_options(alike, 6)).select("list_id", "part").distinct().count() == 1


def test_relaxation_ladder(spark):
    pool = spark.createDataFrame([("a", "공원"), ("a", "공원"), ("a", "전통시장"), ("b", "공원")], "area string, place_type string").withColumn("is_fallback", F.lit(False))
    asks = spark.createDataFrame([(1, 2, ["a"], ["공원"]), (2, 3, ["a"], ["공원"]), (3, 9, ["a", "b"], []), (4, 4, [], ["전통시장"]), (5, 1, ["z"], [])],
                                 "route_id int, num_visits int, areas array<string>, preferred_types array<string>")
    got = {r.route_id: (r.rung_1, r.rung_4, r.rung, r.short_by) for r in routes.relaxation_ladder(asks, pool).collect()}
    assert got == {1: (2, 3, 1, 0), 2: (2, 3, 2, 0), 3: (4, 4, None, 5), 4: (1, 4, 2, 0), 5: (0, 0, None, 1)}


def test_filler_breaks_lists_every_row(spark):
    rows = spark.createDataFrame([("x", 1, False), ("x", 2, True), ("x", 3, False), ("x", 4, True), ("x", 5, False), ("y", 1, False), ("y", 2, True)], "route_id string, order int, is_fallback boolean")
    assert sorted((r.order, r.first_filler) for r in quality.filler_breaks(rows).collect()) == [(3, 2), (5, 2)]


def test_trace_sample_order_and_cap(spark):
    actors = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "query_id int, actor string")
    run = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "query_id int, rank int")
    turned = evaluation.transitions(run([4]), run([4, 7, 8]), actors)
    assert sorted(map(tuple, turned.collect())) == [(7, "b", 1), (8, "a", 1)]
    got = [tuple(r) for r in evaluation.trace_sample(actors, turned, 2, 7).orderBy("query_id").collect()]
    assert got == [(0, "a", "head"), (1, "b", "head"), (2, "a", "head"), (3, "b", "head"), (4, "a", "fill"), (5, "b", "fill"), (7, "b", "miss_to_hit")]


def test_document_tokens_are_normalised(spark):
    import unicodedata

    from placewright.operators.ranking import document_tokens

    texts = ["강남역 ①번출구, ２층홀", "café café Ünter|ab", "plain text", "Ｆｕｌｌ/Width ﬁne x", None, "가 각"]
    key = lambda t: "".join(ch for ch in unicodedata.normalize("NFKC", t).lower() if ch.isascii() and ch.isalnum() or "가" <= ch <= "힣")
    want = [[key(t) for t in __import__("re").split(r"[;,/|()\s]+", (x or "").strip()) if len(key(t)) >= 2] for x in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", document_tokens("t").alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == want
