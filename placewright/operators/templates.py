"""Template routes: four fixed slots, best combination of three candidates each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.functions.numbers import clamp01
from placewright.functions.text import score_from_reasons
from placewright.operators.shaping import first_by_score, first_per

SLOTS = 4
TRAVEL = 0.05


def fill_area(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Missing areas from a (place_type, name) -> area table."""
    named = lookup.select("place_type", "name", F.col("area").alias("_area"))
    out = rows.join(named, ["place_type", "name"], "left")
    return out.withColumn("area", F.coalesce(F.nullif("area", F.lit("")), F.when(F.col("place_type") != "subway", F.col("_area")))).drop("_area")


def slot_lists(scored: DataFrame, templates=None, top: int = 3) -> DataFrame:
    """One row per (age group, template): an array of candidates per slot.

    Only the top three per (slot, type, age group) enter, so rows are tiny and
    their number is the number of templates.
    """
    best = first_by_score(scored, ["slot", "age_group", "place_type"], "raw_score", ["name", "place_id"], top, "pick")
    item = F.struct("pick", "name", F.coalesce("area", F.lit("")).alias("area"), "place_type", "score", score_from_reasons(F.col("reasons")).alias("interaction"))
    lists = best.groupBy("slot", "age_group", "place_type").agg(F.array_sort(F.collect_list(item)).alias("items"))
    chosen = templates or fv.ROUTE_TEMPLATES
    plan = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(i).alias("step"), F.lit(time).alias("time"), F.lit(slot).alias("slot"), F.lit(kind).alias("place_type"))
                     for t, steps in chosen.items() for i, (time, slot, kind) in enumerate(steps, 1)])
    ages = scored.select("age_group").distinct()
    steps = ages.select("age_group", F.inline(plan)).join(lists, ["slot", "age_group", "place_type"], "left")
    return steps.groupBy("age_group", "template").agg(*[F.first(F.when(F.col("step") == i, F.col("items")), True).alias(f"s{i}") for i in range(1, SLOTS + 1)])


def _moved(previous: Column, area: Column) -> Column:
    return F.when((previous != "") & (area != "") & (previous != area), TRAVEL).otherwise(0.0)


def combinations(lists: DataFrame) -> DataFrame:
    """Every combination without a repeated name, with adjusted scores."""
    rows = lists
    for i in range(1, SLOTS + 1):
        rows = rows.withColumn(f"c{i}", F.explode(f"s{i}"))
    c = [F.col(f"c{i}") for i in range(1, SLOTS + 1)]
    names = F.array(*[x["name"] for x in c])
    rows = rows.filter(F.size(F.array_distinct(names)) == SLOTS)
    before = [F.lit("")] + [x["area"] for x in c[:-1]]
    adjusted = [F.round(F.greatest(F.lit(0.0), x["score"] - _moved(p, x["area"])), 4) for p, x in zip(before, c)]
    return rows.withColumns({f"a{i}": a for i, a in enumerate(adjusted, 1)})


def components(rows: DataFrame) -> DataFrame:
    """Route score and its parts for one combination per row."""
    c = [F.col(f"c{i}") for i in range(1, SLOTS + 1)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    mean = total([F.col(f"a{i}") for i in range(1, SLOTS + 1)]) / F.lit(float(SLOTS))
    seen = [x["interaction"] for x in c]
    count = total([F.when(s.isNotNull(), 1).otherwise(0) for s in seen])
    interaction = F.coalesce(F.try_divide(total([F.coalesce(s, F.lit(0.0)) for s in seen]), count.cast("double")), F.lit(0.0))
    types = F.array(*[x["place_type"] for x in c])
    areas = F.filter(F.array(*[x["area"] for x in c]), lambda a: a != "")
    cover = F.lit(0.0)
    for age, table in fv.TARGET_COVERAGE.items():
        for kind, value in table.items():
            cover = cover + F.when((F.col("age_group") == age) & F.array_contains(types, kind), value).otherwise(0.0)
    pairs = [(a["area"], b["area"]) for a, b in zip(c, c[1:])]
    known = total([F.when((a != "") & (b != ""), 1).otherwise(0) for a, b in pairs])
    same = total([F.when((a != "") & (a == b), 1).otherwise(0) for a, b in pairs])
    continuity = F.coalesce(F.try_divide(same.cast("double"), known.cast("double")), F.lit(0.0)) * F.lit(0.03)
    repeats = lambda arr, free: F.aggregate(F.array_distinct(arr), F.lit(0), lambda acc, v: acc + F.greatest(
        F.size(F.filter(arr, lambda x: x == v)) - F.lit(free), F.lit(0)))
    rows = rows.withColumns({
        "mean_place_score": mean, "average_interaction": interaction, "interaction_bonus": interaction * F.lit(0.04),
        "coverage_bonus": F.least(cover, F.lit(0.05)), "continuity_bonus": continuity,
        "diversity_bonus": F.size(F.array_distinct(types)) / F.lit(float(SLOTS)) * F.lit(0.03),
        "area_penalty": repeats(areas, 2) * F.lit(0.02), "type_penalty": repeats(types, 1) * F.lit(0.015)})
    score = clamp01(F.col("mean_place_score") * F.lit(0.78) + F.col("interaction_bonus") + F.col("coverage_bonus") + F.col("continuity_bonus")
                    + F.col("diversity_bonus") - F.col("area_penalty") - F.col("type_penalty"))
    return rows.withColumn("route_score", F.round(score, 4))


def score_reasons() -> Column:
    parts = [("mean_place_score", "mean place score prioritized as the primary route quality signal"),
             ("interaction_bonus", "interaction-aware route fit applied"), ("coverage_bonus", "target-aligned route structure"),
             ("continuity_bonus", "district continuity bonus applied"), ("diversity_bonus", "route diversity bonus applied"),
             ("area_penalty", "district repeat penalty applied"), ("type_penalty", "place-type repeat penalty applied")]
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(t)) for c, t in parts]))
    return F.when(F.size(found) == 0, F.array(F.lit("baseline route quality calculated"))).otherwise(found)


def best_template_routes(scored: DataFrame, templates=None, top: int = 3) -> DataFrame:
    """Best combination per (age group, template); first in slot order on ties.

    Where no combination avoids a repeated name, the greedy route is used.
    """
    lists = slot_lists(scored, templates, top)
    rows = components(combinations(lists))
    order = [F.desc("route_score"), F.desc("mean_place_score"), F.desc("average_interaction"), *[F.col(f"c{i}.pick") for i in range(1, SLOTS + 1)]]
    best = first_per(rows, ["age_group", "template"], order)
    left = lists.join(best.select("age_group", "template"), ["age_group", "template"], "left_anti")
    greedy = components(greedy_routes(left))
    return best.unionByName(greedy, allowMissingColumns=True).withColumn("route_reasons", score_reasons())


def greedy_routes(lists: DataFrame) -> DataFrame:
    """Per slot the best unused candidate after the travel penalty; a repeated
    name only where nothing else is left."""
    rows = lists
    for i in range(1, SLOTS + 1):
        used = F.array(*[F.col(f"c{j}.name") for j in range(1, i)]) if i > 1 else F.array().cast("array<string>")
        previous = F.col(f"c{i - 1}.area") if i > 1 else F.lit("")
        best = _best_option(F.col(f"s{i}"), used, previous)
        rows = rows.withColumn(f"c{i}", best)
        rows = rows.withColumn(f"a{i}", F.round(F.greatest(F.lit(0.0), F.col(f"c{i}.score") - _moved(previous, F.col(f"c{i}.area"))), 4))
    return rows


def _best_option(items: Column, used: Column, previous: Column) -> Column:
    fresh = F.filter(items, lambda c: ~F.array_contains(used, c["name"]))
    options = F.when(F.size(fresh) > 0, fresh).otherwise(items)
    ranked = F.transform(options, lambda c: F.struct(
        (-F.greatest(F.lit(0.0), c["score"] - _moved(previous, c["area"]))).alias("n"), (-c["score"]).alias("b"), c["name"].alias("nm"), c.alias("c")))
    return F.array_min(ranked)["c"]
