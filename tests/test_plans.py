"""Registered queries on the smallest tables, against plain loops."""

import collections

from pyspark.sql import functions as F

from placewright.plans import registered, roles

SMALL = "/root/testdata/sf0.001"


def test_alias_audit_reads_all_public_sources(spark):
    names = {"market": "market", "park": "park", "senior_friendly": "senior", "subway": "subway"}
    keys = collections.defaultdict(set)
    for r in roles.places(spark, SMALL).select("kind", F.regexp_replace("name", " ", "").alias("key")).collect():
        keys[r.key].add(names[r.kind])
    want = collections.Counter()
    for r in roles.aliases(spark, SMALL).collect():
        found = keys.get(r.canonical_name.replace(" ", ""), set()) | keys.get(r.alias_name.replace(" ", ""), set())
        want[";".join(sorted(found))] += 1
    got = collections.Counter()
    for r in registered.QUERIES["alias_audit"](spark, SMALL).collect():
        got[r.public_source_matches] += r.aliases
    assert got == want
    assert {s for k in got for s in k.split(";")} == set(names.values())
