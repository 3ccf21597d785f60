"""Resampling, ranked search and license scans next to plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from placewright.llm import importance, license_scan, ranked_search

SCHEMA = "doc_id long, text string, place int, score string, words int, n int, m int, shard string, rank int, block string"
ITEMS = "item_id long, text string, term string, side int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_DOWN = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(_DOWN))


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "y", 5, "z") for i, t in rows], SCHEMA).repartition(parts)


def targets(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ITEMS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["the", "of", "Größe", "naïve", "漢字", "x1", "CC", "by", "MIT", "License", "apache", "gnu", "general", "public", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    out = [(i, text(rng.choice([0, 1, 5, 19, 20, 21, 40, 200]))) for i in range(150)]
    out += [(200 + i, "the of the of w1 " * 5) for i in range(40)]  # ties
    out += [(300, None), (301, ""), (302, "!?\n"), (303, "z" * 70_000 + " w1 " * 30), (304, "w2 w3 " * 20_000), (304, "w2 another text of the same id w3 " * 4)]
    out += [(200, "the of the of w1 " * 5)] * 2 + [(None, "w5 w6 w7 " * 9), (None, None)]
    return out


# --- resampling -------------------------------------------------------------------
def drawn(rows, target, percent=25, buckets=10_000):
    def features(text):
        w = words(text)
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [0, 25, 40, 100])
def test_resample(spark, rows, percent):
    target = ["w1 w2 of", "Größe the GNU-general", None, ""]
    settings = importance.Settings(percent=percent, finish=3)
    got = importance.resample(documents(spark, rows), targets(spark, enumerate(target)), settings=settings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, percent)


def test_resample_empty(spark, rows):
    assert importance.resample(documents(spark, []), targets(spark, [(1, "a b")])).collect() == []
    got = importance.resample(documents(spark, rows[:60]), targets(spark, []))
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows[:60], [])


@pytest.mark.parametrize("kind", ["spread", "sorted", "one partition", "equal"])
def test_cutoff_key(spark, kind):
    rng = random.Random(3)
    keys = [(rng.randint(-50, 50), -i) for i in range(700)]
    if kind == "equal":
        keys = [(5, -1)] * 300 + keys[:20]
    if kind == "sorted":
        keys.sort()
    df = spark.createDataFrame(keys, "score long, place long").repartition(1 if kind == "one partition" else 5)
    order = sorted(keys, reverse=True)
    for k in (1, 2, len(keys) // 4, len(keys) - 1, len(keys)):
        assert importance.cutoff_key(df, k, finish=1) == order[k - 1]
    assert importance.cutoff_key(df, len(keys) + 1) is None and importance.cutoff_key(df, 0) is None


# --- search -------------------------------------------------------------------------
def ranked(rows, items, top):
    docs = [(i, words(t)) for i, t in rows]
    n_docs, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(x for _, w in docs for x in set(w))
    out = []
    for item, text in items:
        found = []
        for i, w in docs:
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in set(words(text)) if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_bytes, shard, pairs", [(1 << 20, 4096, 1 << 21), (200, 7, 64)])
def test_search(spark, rows, query_bytes, shard, pairs):
    items = [(1, "w1 w2 the THE"), (2, None), (3, ""), (4, "no such term here"), (5, "Größe naïve w59 of"), (5, "w3"), (None, "w7 w8"), (6, "apache " * 50 + "w4"), (6, "apache " * 50 + "w4")]
    settings = ranked_search.Settings(top=9, shard=shard, query_bytes=query_bytes, seeds=1, pairs=pairs)
    got = ranked_search.search(documents(spark, rows), targets(spark, items), settings=settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, 9)


def test_search_empty(spark):
    search = lambda docs, items: ranked_search.search(documents(spark, docs), targets(spark, items)).collect()
    assert search([], [(1, "a")]) == search([(1, "a")], []) == search([(1, None)], [(1, "a")]) == search([(1, "a")], [(1, None)]) == []


def test_bounds_hold():
    """No score passes the bound of its index row."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(20)) for _ in range(40)]
    block = ranked_search.Block([1, 2, 3], ["w1 w2 w3", "w4", "w30 w29 w28 w1"])
    names, groups = {f"w{i}": t for i in range(31) for t in block_numbers(block, f"w{i}")}, Counter()
    for place, text in enumerate(texts):
        for word, tf in Counter(text.split()).items():
            if names.get(word, -1) >= 0:
                groups[names[word], tf, place] += 1
    keys = sorted({g[:2] for g in groups})
    pack = lambda values, kind: b"".join(int(v).to_bytes(kind, "little") for v in values)
    places = [[p for t, f, p in sorted(groups) if (t, f) == key] for key in keys]
    row = {"shard": b"", "m": 100, "docs": pack(range(40), 8), "terms": pack([k[0] for k in keys], 4), "tfs": pack([k[1] for k in keys], 4), "sizes": pack(map(len, places), 4), "places": pack(sum(places, []), 2)}
    import numpy as np

    shard = ranked_search.Shard(row, np.arange(1, len(block.hashes) + 1) * 100)
    bounds, scores = shard.bounds(block), shard.scores(block, np.arange(3), 5)
    assert (scores.max(axis=1) <= bounds).all() and (scores == shard.scores(block, np.arange(3), 1 << 20)).all() and scores.sum() > 0


def block_numbers(block, word):
    import numpy as np

    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return block.numbers(data, np.array([0]), np.array([len(data)])).tolist()


# --- license scans --------------------------------------------------------------------
def licensed(text, settings):
    w, places, base, labels, score = words(text), [], set(), set(), 0.0
    for t in license_scan.templates(settings):
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
            places += at
            if at:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
        else:
            for start in range(0, len(w), settings.block):
                held = len(set(t.words) & set(w[start : start + settings.block + settings.overlap]))
                if held >= t.needed:
                    labels.add(t.label)
                    score = max(score, held / len(set(t.words)))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


@pytest.mark.parametrize("settings", [license_scan.Settings(), license_scan.Settings(block=5, overlap=4, percent=50), license_scan.Settings(phrases=[], block=40, percent=30)])
def test_scan(spark, rows, settings):
    near = " ".join(license_scan.NOTICES[0][1].split()[2:]).upper()
    rows = rows + [
        (400, "mit license " * 3000), (401, "the " * 95 + "gnu General\npublic -license- cc by by cc CC-BY"), (402, "w " * 90 + near), (403, near.replace("SOFTWARE", "SOFT WARE")),
        (404, "license mit apache, license"), (404, "mit license"), (404, "mit license"), (405, "permission " * 400), (406, "Redistribution in source forms"), (None, "cc by"),
    ]
    got = license_scan.scan(documents(spark, rows), settings=settings)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *licensed(t, settings)) for i, t in rows), key=str)


def test_scan_is_native_and_bounded(spark, rows):
    plan = license_scan.scan(documents(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LogicalRDD", ""))
    assert license_scan.scan(documents(spark, [])).collect() == []
    for wrong in (license_scan.Settings(most_words=10), license_scan.Settings(overlap=2), license_scan.Settings(notices=[("x", "!?")])):
        with pytest.raises(ValueError):
            license_scan.templates(wrong)
