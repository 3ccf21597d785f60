"""Near duplicates: lines, documents, passages; components."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import components as components_module, line_dedup
from placewright.llm.components import DEALT, components, stars
from placewright.llm.jaccard_join import linked_components, one_of_each, signatures
from placewright.llm.line_dedup import Settings, band_values, duplicate_lines, normal, shingle_hashes, without_duplicate_lines
from placewright.llm.repeats import repeated_passages, shared, without_repeats
from tests.llm.test_tokens import frame


def sets_of(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 400, 1) if i % 37]
    pairs = chain + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(80)] + [(5, 5)]
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(5), "a", "b").collect()
    assert {r.node: r.root for r in got} == sets_of([p for p in pairs if p[0] != p[1]])
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def star_roots(spark, pairs):
    """Roots of (band, key, need), one pair to a row, all dealt to one place."""
    rows = [(0, *(bytearray(np.array([x], kind).tobytes()) for x, kind in zip(p, ("<i8", "<i8", "<u2"), strict=True))) for p in pairs]
    return {r.node: r.root for r in components(stars(spark.createDataFrame(rows, DEALT).coalesce(1)), "a", "b").collect()}


def test_stars_link_keys_of_different_parts(spark, monkeypatch):
    monkeypatch.setattr(components_module, "HELD", 4)
    # 1 and 2 are the first keys of the bands that 3 and 4 share, and 4 comes when these have been reduced.
    roots = star_roots(spark, [(101, 1, 2), (101, 3, 2), (102, 2, 2), (102, 3, 2), (101, 4, 2), (102, 4, 2), (103, 5, 2), (103, 6, 2)])
    assert roots == {3: 3, 4: 3}


@pytest.mark.parametrize("held", [3, 16, 100, 1 << 20])
def test_stars_keep_every_link(spark, monkeypatch, held):
    monkeypatch.setattr(components_module, "HELD", held)
    rng = random.Random(held)
    pairs = []
    for group in range(40):
        own = [group * 100 + i for i in range(rng.randint(2, 30))]
        for band in range(rng.randint(1, 6)):
            pairs += [(group * 10 + band, k, 3) for k in rng.sample(own, rng.randint(1, len(own)))]
    rng.shuffle(pairs)
    bands = collections.defaultdict(set)
    for band, key, _ in pairs:
        bands[band].add(key)
    shared = collections.Counter(p for keys in bands.values() for p in itertools.combinations(sorted(keys), 2))
    wide = [p for keys in bands.values() if len(keys) > components_module.FEW for p in itertools.combinations(sorted(keys), 2)]
    want = sets_of([p for p, n in shared.items() if n >= 3] + wide)
    assert star_roots(spark, pairs) == want


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(90))
    docs, texts = [], []
    for n in (0, 1, 2, 3, 5, 9, 20, 60, 200, 600):
        for _ in range(4):
            texts.append([word() for _ in range(n)])
    for base in texts[20:]:
        for changes in (0, 1, 2, 6):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(t) for t in texts]
    docs += [" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(k))]) for k in range(6)]
    docs += ["UPPER Case Words here", "upper case\twords\n\nhere", "é É x", "a" * 3000, "ab" * 1500, "", "   "]
    big = [word() for _ in range(120)]  # a large group of near copies, more than one group holds
    for _ in range(150):
        copy = list(big)
        for _ in range(rng.choice([1, 2, 3, 9])):
            copy[rng.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    return [(i * 3 + 1, t) for i, t in enumerate(docs)] + [(4, docs[1]), (4, docs[1]), (None, docs[5]), (None, None), (10_001, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    pairs = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            pairs.append((a, b))
    part = sets_of(pairs)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[part.get(k, k)].append(i)
    return [(i, len(sets[k]), min((x for x in least[part.get(k, k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_linked_components(spark, rows, n, percent):
    got = linked_components(frame(spark, rows), words=n, percent=percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(brute_components(rows, n, percent), key=str)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 333, 2000):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                most = n * (100 - percent) // percent
                out = rng.integers(0, most + 1)
                b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, rng.integers(0, most - out + 1), dtype=np.uint64)]))
                a = np.unique(a)
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    (x, p), (y, q) = signatures(a, percent), signatures(b, percent)
                    shared = set(x.tolist()) & set(y.tolist())
                    needs = [min(p[np.flatnonzero(x == v)[0]], q[np.flatnonzero(y == v)[0]]) for v in shared]
                    assert len(shared) >= min(needs, default=1)


def test_one_of_each(spark, rows):
    got = one_of_each(frame(spark, rows), words=5, percent=80)
    assert got.columns == frame(spark, rows).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    want = [(i, t) for (i, t), (_, n, c) in zip(rows, brute_components(rows, 5, 80), strict=True) if not n or i == c]
    assert sorted(set(kept), key=str) == sorted(set(want), key=str)
    assert all(n == 1 for (_, t), n in collections.Counter(kept).items() if t and t.strip())


def test_one_of_each_without_ids(spark):
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, "one two three four five six"), (2, "a b c d e f g"), (1, "a b c d e f g"), (1, "q r s t u v")]
    kept = sorted([(r.doc_id, r.text) for r in one_of_each(frame(spark, rows)).collect()], key=str)
    assert kept == sorted([(None, rows[0][1]), (None, rows[1][1]), (1, "a b c d e f g"), (1, "q r s t u v")], key=str)


def line_sets(rows, settings):
    lines = sorted({normal(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    sets = {x: {x[i : i + settings.width] for i in range(max(1, len(x) - settings.width + 1))} for x in lines}
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if 100 * (n := len(sets[a] & sets[b])) >= settings.percent * (len(sets[a]) + len(sets[b]) - n)]
    return sets_of(pairs)


def line_rows():
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 25)))
    base = [line() for _ in range(60)]
    docs = []
    for i in range(60):
        own = [rng.choice(base) for _ in range(rng.randint(0, 4))] + [line() for _ in range(rng.randint(0, 3))]
        near = rng.choice(base).split()
        if len(near) > 14:
            near[3] = "changed"
        docs.append((i, "\n".join([*own, " ".join(near).upper(), "", "  "])))
    return docs + [(70, None), (71, ""), (72, "\n\n"), (73, "ab"), (74, "AB "), (None, base[0]), (75, "x" * 20_000), (7, docs[7][1]), (76, "é\né")]


def test_duplicate_lines(spark):
    rows = line_rows()
    got = duplicate_lines(frame(spark, rows)).collect()
    part = line_sets(rows, Settings())
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    places = [(i, k, part.get(normal(x), normal(x))) for i, t in rows for k, x in enumerate((t or "").split("\n")) if normal(x)]
    first = {}
    for i, k, c in sorted(places, key=order):
        first.setdefault(c, (i, k))
    want = [(i, k, *first[c], (i, k) == first[c]) for i, k, c in places]
    assert sorted([(r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no, r.kept) for r in got], key=str) == sorted(want, key=str)
    kept = without_duplicate_lines(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    texts = {(i, t) for i, t in [(r.doc_id, r.text) for r in kept.collect()]}
    stay = collections.defaultdict(set)
    for i, k, *_, flag in want:
        stay[i].add(k) if flag else None
    for i, t in rows:
        lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if not normal(x) or k in stay[i])
        had = any(normal(x) for x in lines)
        assert ((i, left if had and left != t else t) in texts) == (not had or bool(left.strip()))


def test_unlike_lines_of_a_chained_cluster_never_meet(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, bases = word(40), [word(300) for _ in range(3)]
    lines = [common + (b[:k] + "#" + b[k + 1 :]) for b in bases for k in rng.sample(range(300), 70)]
    seen, real = [], line_dedup.link_clusters
    monkeypatch.setattr(line_dedup, "link_clusters", lambda sets, *rest: seen.append(sets) or real(sets, *rest))
    settings = Settings(bands=40, rows=1)  # a common beginning is enough to share a band
    got = duplicate_lines(frame(spark, list(enumerate(lines))), settings=settings).collect()
    assert sorted(r["count"] for r in seen[0].groupBy("cluster").count().collect()) == [70, 70, 70]
    group = {r.doc_id: r.component_id for r in got}
    assert [len({group[i] for i in range(low, low + 70)}) for low in (0, 70, 140)] == [1, 1, 1] and len(set(group.values())) == 3


def test_bands_find_similar_lines():
    rng = random.Random(11)
    found = n = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 300)))
        b = list(a)
        for _ in range(max(1, len(a) // 100)):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b)
        x, y = ({s[i : i + 8] for i in range(len(s) - 7)} for s in (a, b))
        if len(x & y) / len(x | y) >= 0.8:
            n += 1
            va, vb = band_values([a, b], Settings())
            found += bool(set(va.tolist()) & set(vb.tolist()))
    assert n > 100 and found / n > 0.99


def test_shingle_hashes_depend_on_content_only():
    points = np.array([ord(c) for c in "abcdeXabcde"], dtype="<u4")
    for width in (1, 2, 3, 5):
        h = shingle_hashes(points, width)
        assert len(h) == len(points) - width + 1 and h[0] == h[6]


def brute_removed(rows, width, unit):
    def units(t):
        data = (t or "").encode()
        if unit == "byte":
            return data, [data[i : i + 1] for i in range(len(data))], [(i, i + 1) for i in range(len(data))]
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        return data, [data[a:b] for a, b in spans], spans

    seen = collections.Counter()
    parts = [units(t) for _, t in rows]
    for _, us, _ in parts:
        seen.update(tuple(us[p : p + width]) for p in range(len(us) - width + 1))
    out = []
    for (i, _), (data, us, spans) in zip(rows, parts, strict=True):
        mask = [False] * len(us)
        for p in range(len(us) - width + 1):
            if seen[tuple(us[p : p + width])] > 1:
                mask[p : p + width] = [True] * width
        cuts = []
        for k, gone in enumerate(mask):
            if gone and k and mask[k - 1]:
                cuts[-1][1] = spans[k][1]
            elif gone:
                cuts.append(list(spans[k]))
        kept, last = b"", 0
        for a, b in cuts:
            kept, last = kept + data[last:a], b
        kept += data[last:]
        out.append((i, len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return out


@pytest.mark.parametrize(("width", "unit"), [(60, "byte"), (20, "byte"), (3, "byte"), (12, "word"), (1, "word")])
def test_repeated_passages(spark, rows, width, unit):
    rows = [r for k, r in enumerate(rows) if k % 3 == 0 or not r[1] or len(r[1]) < 40]
    got = repeated_passages(frame(spark, rows), width=width, unit=unit).collect()
    want = brute_removed(rows, width, unit)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got], key=str) == sorted(want, key=str)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_removed for r in got)


def test_shared_deals_a_frequent_key_to_several_tasks(spark):
    small = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # Half of the rows have the key 0, a tenth has a key twice, the others stand alone; one has no key.
        rows = spark.range(0, 40_000, 1, 16).selectExpr("CASE WHEN id % 2 = 0 THEN 0 WHEN id % 10 = 1 THEN (id - id % 20) DIV 20 + 1 ELSE id + 1000000 END AS gram", "id").unionByName(spark.sql("SELECT CAST(null AS bigint) AS gram, -1L AS id"))
        held = shared(rows, "gram").select("id", F.spark_partition_id().alias("task")).collect()
        assert sorted(r.id for r in held) == sorted(i for i in range(40_000) if i % 2 == 0 or i % 10 == 1)
        assert max(collections.Counter(r.task for r in held).values()) < 8_000  # 20 000 rows have the key 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_without_repeats(spark, rows):
    got = without_repeats(frame(spark, rows), width=12, unit="word")
    assert got.columns == frame(spark, rows).columns
    want = [(i, w[5] if w[2] else t) for (i, t), w in zip(rows, brute_removed(rows, 12, "word"), strict=True)]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).filter("doc_id > 1")
    assert linked_components(none).count() == 0
    assert one_of_each(none).count() == 0
    assert duplicate_lines(none).count() == 0
    assert without_duplicate_lines(none).count() == 0
    assert repeated_passages(none).count() == 0
    assert without_repeats(none).count() == 0
