"""Composed stages shared by the registered queries.

Each stage is written once per application and input folder, as Parquet in the
folder that all machines share, and read from there by every query that builds
on it. No query plans or computes a stage a second time.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, functions as F

from placewright import fixed_values as fv
from placewright.operators import candidates as cand, cleaning, diagnostics as diag, ranking as rank, scoring
from placewright.plans import roles
from placewright.session import release, shared_folder

#: Stages whose shuffles are as large as the gold rows; their files go as soon as the stage is written.
LARGE = {"_gold_rows", "coverage", "covered"}
_FOLDERS: dict[str, str] = {}


def _folder(spark) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/stages-{app}-{uuid.uuid4().hex[:8]}"
    return _FOLDERS[app]


def stage(fn):
    written: dict = {}

    @functools.wraps(fn)
    def once(spark, sf, *args):
        key = (spark.sparkContext.applicationId, sf, *args)
        if key not in written:
            path = f"{_folder(spark)}/{fn.__name__}-{len(written)}"
            fn(spark, sf, *args).write.parquet(path)
            written[key] = spark.read.parquet(path)
            if fn.__name__ in LARGE:
                release(spark)
        return written[key]

    return once


@stage
def aux(spark, sf) -> DataFrame:
    c = cleaning.clean_commercial(roles.commercial(spark, sf), ["commercial_code"])
    w = cleaning.clean_workers(roles.workers(spark, sf), ["commercial_code"])
    l = cleaning.daypart_sums(roles.living(spark, sf), ["area_id"])
    return cleaning.aux_summary(c, w, l)


@stage
def scored(spark, sf) -> DataFrame:
    return scoring.score_places(roles.place_tables(spark, sf), aux(spark, sf), known_areas=roles.KNOWN_AREAS, areas=roles.AREAS)


@stage
def asked(spark, sf) -> DataFrame:
    """Requests with their context, pool and signature."""
    return rank.with_signature(cand.with_request_context(roles.requests(spark, sf), roles.AREAS))


@stage
def alias_table(spark, sf) -> DataFrame:
    return cand.alias_table(roles.aliases(spark, sf), ["ord"], roles.AREAS)


@stage
def candidates(spark, sf) -> DataFrame:
    return cand.pool_candidates(cand.pools_of(asked(spark, sf)), cand.context_pool(scored(spark, sf), roles.CANDIDATE_POOL))


@stage
def frozen(spark, sf, with_alias=False) -> DataFrame:
    pools = cand.pools_of(asked(spark, sf))
    extra = cand.alias_candidates(pools, alias_table(spark, sf), roles.AREAS) if with_alias else None
    return cand.freeze_pools(candidates(spark, sf), 50, extra)


@stage
def lists(spark, sf, with_alias=False) -> DataFrame:
    """(signature, candidate) rows, at most 50 per signature.

    Feature stages below compute request columns per signature and candidate
    columns per frozen row, before the two are joined.
    """
    return rank.signature_candidates(rank.signatures(asked(spark, sf)), frozen(spark, sf, with_alias))


@stage
def _gold_rows(spark, sf) -> DataFrame:
    return roles.gold(spark, sf).drop("ord").join(asked(spark, sf).select("query_id", "sig", "place_type", "activity_type", "actor"), "query_id")


def gold(spark, sf) -> DataFrame:
    """Gold rows with the signature of their request; they stand in the order of their ids, which is written once."""
    rows = _gold_rows(spark, sf).withColumn("ord", F.col("gold_id"))
    return rows.select("query_id", "gold_id", "place_name", "area", "relevance", "ord", "sig", "place_type", "activity_type", "actor")


@stage
def variants(spark, sf, *models) -> DataFrame:
    asks = rank.variant_request_side(rank.signatures(asked(spark, sf)), areas=roles.AREAS)
    rows = rank.signature_candidates(asks, rank.variant_candidate_side(frozen(spark, sf), roles.AREAS))
    rows = rank.variant_features(rows, areas=roles.AREAS)
    return rank.rerank_variants(rows, list(models) or None, areas=roles.AREAS)


@stage
def tuned(spark, sf, with_alias=False) -> DataFrame:
    asks = rank.tuned_request_side(rank.signatures(asked(spark, sf)), roles.AREAS)
    rows = rank.signature_candidates(asks, rank.tuned_candidate_side(frozen(spark, sf, with_alias), roles.AREAS))
    return rank.tuned_features(rows, roles.AREAS)


@stage
def tuned_recs(spark, sf, with_alias=False) -> DataFrame:
    return rank.rerank_tuned(tuned(spark, sf, with_alias), fv.TUNED_REQUIRED[2], areas=roles.AREAS)


def _coverage(spark, sf, with_alias) -> DataFrame:
    return diag.coverage(gold(spark, sf), tuned(spark, sf, with_alias), tuned_recs(spark, sf, with_alias), "sig", areas=roles.AREAS)


@stage
def coverage(spark, sf, with_alias=False) -> DataFrame:
    return _coverage(spark, sf, with_alias)


@stage
def covered(spark, sf, with_alias=False) -> DataFrame:
    """Coverage of every gold row without its names and ids, for sums over two settings: these are most of its bytes."""
    return _coverage(spark, sf, with_alias).select("place_type", "in_raw_top50", "in_top10")


@stage
def final_base(spark, sf) -> DataFrame:
    """Final features without text similarity, before the area rule."""
    cols = [c for c in rank.SIGNATURE if c in asked(spark, sf).columns]
    counts = asked(spark, sf).groupBy("sig", "actor", *cols).agg(F.count("*").alias("queries"))
    asks = rank.final_request_side(counts, roles.AREAS)
    rows = rank.signature_candidates(asks, rank.final_candidate_side(frozen(spark, sf), roles.AREAS))
    rows = rank.final_features(rows, roles.AREAS)
    return rank.with_style(rows, rank.actor_profiles(asked(spark, sf)))


@stage
def final(spark, sf) -> DataFrame:
    """All final features, with text similarity and the composite."""
    return rank.composite(rank.with_semantic(final_base(spark, sf), "queries"))


@stage
def final_lists(spark, sf) -> DataFrame:
    """Final features of the rows that a request may be served: those of its area, or all where it has none."""
    return rank.area_or_all(final(spark, sf), areas=roles.AREAS)
