"""The pipeline against stages done by brute force."""

import collections
import random

import numpy as np

import corpus_pipeline
from placewright.llm.line_dedup import Settings, normal
from placewright.llm.quality import score
from placewright.llm.tokens import load
from tests.llm.test_near import brute_components, brute_removed, line_sets


def documents():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, passage = line(18), line(70)
    rows = []
    for i in range(240):
        bad = i >= 60
        lines = [line(rng.randint(8, 40)) for _ in range(rng.randint(1, 5))]
        if bad:
            lines = [" ".join(w + "!!" for w in x.split()) for x in lines]
        if i % 5 == 0:
            lines.insert(0, shared)
        if i % 7 == 0:
            lines.append(line(50) + " " + passage + " " + line(50))
        rows.append((i, "\n".join(lines), bad))
    rows += [(1000, rows[1][1], False), (1001, rows[2][1] + "\n" + line(3), False), (1002, None, False), (1003, "", False)]
    near = rows[3][1].split(" ")
    near[5] = "zzz"
    return [*rows, (1004, " ".join(near), False)]


def expected(docs):
    part = line_sets(docs, Settings())
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k, x in enumerate((t or "").split("\n")):
            if normal(x):
                first.setdefault(part.get(normal(x), normal(x)), (i, k))
    lines = []
    for i, t in docs:
        had = [k for k, x in enumerate((t or "").split("\n")) if normal(x)]
        gone = {k for k in had if first[part.get(normal(t.split("\n")[k]), normal(t.split("\n")[k]))] != (i, k)}
        if had and gone == set(had):
            continue
        lines.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t))
    one = [r for r, (_, n, c) in zip(lines, brute_components(lines, 5, 80), strict=True) if not n or r[0] == c]
    return lines, one, [(i, w[5] if w[2] else t) for (i, t), w in zip(one, brute_removed(one, 50, "word"), strict=True)]


def test_run_equals_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = {r.doc_id for r in score(docs, labels).collect() if r.predicted}
    assert 50 < len(good) < 110 and {1, 2, 3, 4} <= good
    lines, one, last = expected([(i, t) for i, t, _ in rows if i in good])
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"step{k}"))
        step = spark.read.parquet(str(tmp_path / f"step{k}"))
        assert step.columns == docs.columns, name
        seen.append({(r.doc_id, r.text) for r in step.collect()})
        assert all(r.n_chars == len(r.text) for r in step.collect() if r.text is not None)
    assert {i for i, _ in seen[0]} == good
    assert seen[1] == set(lines) and seen[2] == set(one) and seen[3] == set(last)
    assert len(last) < len(one) + 1 and any(t != dict(one)[i] for i, t in last)
    lib = load("byte_bpe_50k.json")
    packed = collections.defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in last}


def test_names_and_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "repeated_passages", "packing"]
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Repeated rows, null ids and texts, one very long text, no n_chars, and columns whose names the stages use inside."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4000))
    plain = "\n".join(" ".join(word() for _ in range(12)) for _ in range(6))
    rows = [(1, plain), (1, plain), (2, None), (2, None), (3, ""), (None, " ".join(word() for _ in range(40))), (4, long), (5, plain.replace(" ", "  "))]
    docs = spark.createDataFrame([(i, t, 1, "g", 2, "k") for i, t in rows], "doc_id long, text string, row int, gone string, runs int, text_id string").repartition(3)
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}"))
        step = spark.read.parquet(str(tmp_path / f"odd{k}"))
        assert step.columns == docs.columns, name
    kept = sorted(((r.doc_id, r.text) for r in step.collect()), key=str)
    assert [i for i, _ in kept].count(1) == 1 and (2, None) in kept and (3, "") in kept and (4, long) in kept and any(i is None for i, _ in kept) and 5 not in {i for i, _ in kept}
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).columns == docs.columns
    pieces = corpus_pipeline.sequences(spark, step, str(tmp_path)).collect()
    assert all(r.length <= 1024 for r in pieces) and sum(r.doc_id == 4 for r in pieces) > 10
