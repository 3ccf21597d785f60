"""Final model: weight search with diverse lists, and the comparison of the five models."""

from __future__ import annotations

from placewright.plans.oracle import FINAL_SCORE
from placewright.plans.queries import *  # noqa: F403
from placewright.plans.queries_rank import trials_sql

NAMES = fv.FINAL_WEIGHTS
REQUIRED = [fv.FINAL_MODEL_WEIGHTS["context"], fv.FINAL_MODEL_WEIGHTS["profile"], fv.FINAL_EXTRA_TRIAL]
METRICS = [f"{m}_{k}" for k in fv.EVAL_KS for m in ("p", "r", "ndcg")] + ["area_10", "type_10", "time_10", "context_10", "composite_10", "hit_10", "objective"]
#: Seeded trials of the two searches, beside the required ones.
TRIALS, MORE_TRIALS = 80, 300


def _metrics_sql(trials, split):
    """Metrics by trial and split; one-to-one matching unrolled over the ten ranks.

    Every list of these data has one area, so its penalty is the same for all rows
    of a list and no part of the order.
    """
    steps, before = [], None
    for r in range(1, 11):
        free = "" if before is None else f" AND NOT EXISTS (SELECT 1 FROM {before} a WHERE a.query_id = p.query_id AND a.gold_id = p.gold_id AND a.trial_id = p.trial_id)"
        pick = (f"SELECT trial_id, query_id, {r} AS rank, arg_min(gold_id, (-prio, -relevance, gold_id)) AS gold_id, arg_min(relevance, (-prio, -relevance, gold_id)) AS relevance "
                f"FROM prs p WHERE rank = {r}{free} GROUP BY trial_id, query_id")
        steps.append(f"a{r} AS MATERIALIZED ({pick}{'' if before is None else f' UNION ALL SELECT * FROM {before}'})")
        before = f"a{r}"
    means = {"area_10": "area_match", "type_10": "type_match", "time_10": "time_match", "context_10": "context_match", "composite_10": "composite"}
    weighted = FINAL_SCORE([f"t.{n}" for n in NAMES])
    objective = " + ".join(f"{w} * {c}" for c, w in fv.FINAL_OBJECTIVE.items())
    return f"""{trials},
 sp AS MATERIALIZED ({split}),
 c AS (SELECT t.trial_id, sig, raw_rank, rec_type, base_score, diversity_weight AS dw, {weighted} AS s FROM r_whole, trials t WHERE sig IN (SELECT sig FROM r_goldsig)),
 o AS (SELECT *, row_number() OVER (PARTITION BY trial_id, sig, rec_type ORDER BY s DESC, base_score DESC, raw_rank) AS nth FROM c QUALIFY nth <= 10),
 top AS MATERIALIZED (SELECT trial_id, sig, raw_rank, row_number() OVER (PARTITION BY trial_id, sig ORDER BY round(s - dw * 0.70 * (nth - 1), 9) DESC, s DESC, base_score DESC, raw_rank) AS rank
   FROM o QUALIFY rank <= 10),
 lab AS MATERIALIZED (SELECT g.query_id, g.sig, g.gold_id, g.relevance, l.raw_rank, CASE WHEN l.rec_name = g.place_name THEN 4 ELSE 1 END AS prio FROM r_goldsig g JOIN r_lists l ON l.sig = g.sig
   AND (contains(l.rec_name, g.place_name) OR contains(g.place_name, l.rec_name)) AND (g.area = '' OR g.area = l.rec_area)),
 prs AS MATERIALIZED (SELECT trial_id, query_id, gold_id, relevance, prio, rank FROM lab JOIN top USING (sig, raw_rank)),
 {', '.join(steps)},
 ideal AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos, count(*) OVER (PARTITION BY query_id) AS total FROM r_goldsig),
 ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
 st AS (SELECT query_id, k, max(total) AS total, sum(CASE WHEN pos <= k THEN (pow(2.0, relevance) - 1.0) / log2(pos + 1.0) ELSE 0.0 END) AS idcg FROM ideal, ks GROUP BY query_id, k),
 n AS (SELECT split, count(*)::DOUBLE AS n FROM sp GROUP BY split),
 m AS (SELECT trial_id, split, k, count(*) / k::DOUBLE AS p, sum(1.0 / total) AS r, sum((pow(2.0, relevance) - 1.0) / log2(rank + 1.0) / idcg) AS nd
   FROM a10 JOIN st USING (query_id) JOIN sp USING (query_id) WHERE rank <= k GROUP BY trial_id, split, k),
 f AS (SELECT t.trial_id, n.split, {', '.join(f"coalesce(max(CASE WHEN k = {k} THEN {c} END), 0.0) / max(n) AS {a}_{k}" for k in fv.EVAL_KS for c, a in (('p', 'p'), ('r', 'r'), ('nd', 'ndcg')))}
   FROM trials t CROSS JOIN n LEFT JOIN m ON m.trial_id = t.trial_id AND m.split = n.split GROUP BY t.trial_id, n.split),
 sv AS (SELECT sig, split, count(*) AS q FROM (SELECT DISTINCT query_id, sig FROM r_goldsig) JOIN sp USING (query_id) GROUP BY sig, split),
 ls AS (SELECT trial_id, sig, count(*) AS rows, {', '.join(f'sum({c}) AS {a}' for a, c in means.items())} FROM top JOIN r_whole USING (sig, raw_rank) GROUP BY trial_id, sig),
 mn AS (SELECT trial_id, split, sum(rows * q) AS rows, {', '.join(f'sum({a} * q) / sum(rows * q) AS {a}' for a in means)} FROM ls JOIN sv USING (sig) GROUP BY trial_id, split),
 ht AS (SELECT trial_id, split, count(*) AS hits FROM (SELECT DISTINCT trial_id, query_id, rank FROM prs) JOIN sp USING (query_id) GROUP BY trial_id, split),
 res AS (SELECT *, {objective} AS objective FROM (SELECT f.*, mn.* EXCLUDE (trial_id, split, rows), coalesce(hits / rows::DOUBLE, 0.0) AS hit_10
   FROM f JOIN mn USING (trial_id, split) LEFT JOIN ht USING (trial_id, split)))"""


def _search_sql(n_trials):
    trials = trials_sql(NAMES, fv.FINAL_GRID, REQUIRED, n_trials)
    wide = ", ".join(f"round(max(CASE WHEN split = '{s}' THEN {c} END), 6) AS {s}_{c}" for s in ("train", "validation") for c in METRICS)
    return f"WITH {_metrics_sql(trials, 'SELECT query_id, split FROM r_split')} SELECT trial_id, {', '.join(NAMES)}, {wide} FROM res JOIN trials USING (trial_id) GROUP BY trial_id, {', '.join(NAMES)}"


def _trials(spark, n):
    return search.build_trials(spark, NAMES, fv.FINAL_GRID, REQUIRED, "random", n)


def _search(spark, sf, n):
    gold = pipe.gold(spark, sf)
    return search.search_final(pipe.final_lists(spark, sf), gold, ev.train_split(gold), _trials(spark, n), areas=roles.AREAS)


def _shown(rows):
    return rows.select("trial_id", *NAMES, *R6(*[f"{s}_{c}" for s in ("train", "validation") for c in METRICS]))


@query("final_search", _search_sql(TRIALS))
def final_search(spark, sf):
    """83 trials of the final model, train and validation metrics side by side."""
    return _shown(_search(spark, sf, TRIALS))


@query("final_search_wide", _search_sql(MORE_TRIALS))
def final_search_wide(spark, sf):
    """The same over 303 trials."""
    return _shown(_search(spark, sf, MORE_TRIALS))


_FIXED = ", ".join(f"({i}, '{m}', {', '.join(map(str, map(float, fv.FINAL_MODEL_WEIGHTS[m])))})" for i, m in enumerate(("baseline", "context", "profile"), 1))
_LESS = ", ".join("0.0" if n in ("profile_weight", "diversity_weight") else n for n in NAMES)


@query("final_model_comparison", f"""
WITH best AS MATERIALIZED (WITH {_metrics_sql(trials_sql(NAMES, fv.FINAL_GRID, REQUIRED, TRIALS), 'SELECT query_id, split FROM r_split')}
  SELECT t.* FROM trials t JOIN res USING (trial_id) WHERE split = 'train' ORDER BY objective DESC, trial_id LIMIT 1),
 out AS (WITH {_metrics_sql(f"models AS MATERIALIZED (SELECT * FROM (VALUES {_FIXED}) v(trial_id, model, {', '.join(NAMES)}) UNION ALL SELECT 4, 'similarity_optimized', {_LESS} FROM best UNION ALL SELECT 5, 'final_proposed', {', '.join(NAMES)} FROM best), trials AS MATERIALIZED (SELECT * EXCLUDE (model) FROM models)", "SELECT DISTINCT query_id, 'full' AS split FROM r_goldsig")}
  SELECT model, res.*, n FROM res JOIN models USING (trial_id) JOIN n USING (split)),
 raw AS (SELECT {', '.join(f'count_if(in_raw_top{x}) / count(*)::DOUBLE AS raw_recall_{x}' for x in (50, 100))} FROM r_coverage)
SELECT model, n::BIGINT AS queries, {', '.join(f'round({c}, 6) AS {c}' for c in [*METRICS, 'raw_recall_50', 'raw_recall_100'])} FROM out, raw""")
def final_model_comparison(spark, sf):
    """The five final models over all queries; the last two take the weights of the best trial by train objective."""
    found = _search(spark, sf, TRIALS)
    best = search.trial_weights(_trials(spark, TRIALS), found, NAMES, "train_objective")
    rows = search.compare_final(pipe.final_lists(spark, sf), pipe.gold(spark, sf), search.final_models(spark, best), pipe.lists(spark, sf), areas=roles.AREAS)
    return rows.select("model", "queries", *R6(*METRICS, "raw_recall_50", "raw_recall_100"))
