"""Registered queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from placewright import fixed_values as fv
from placewright.operators import (
    ablation, candidates as cand, cleaning, coords, diagnostics as diag, evaluation as ev, forecast as fc, goldset, matching as match,
    quality, ranking as rank, routes, scoring, search, shaping, templates)
from placewright.plans import pipeline as pipe, roles
from placewright.plans.oracle import register

QUERIES = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            register(name, sql)
        return fn
    return wrap


R4 = lambda *cols: [F.round(c, 4).alias(c) for c in cols]
R6 = lambda *cols: [F.round(c, 6).alias(c) for c in cols]
