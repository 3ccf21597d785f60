"""Operators on tokens: BPE, counts, packing; and exact duplicates."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm.bpe import Coder, encode_decode
from placewright.llm.exact_dedup import exact_duplicates
from placewright.llm.packing import best_fill, bin_plan, pack
from placewright.llm.token_counts import count_tokens
from placewright.llm.tokens import encode, load

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
# Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, digest int, copy string, block long, row long, key int, runs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "y") for i, t in rows], SCHEMA).repartition(3)


def odd_texts():
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)]))
    return [
        None, "", " ", "\n\t ", "Hello   world, don't WE'LL", "<|endoftext|>a<|startoftext|> <|endoftext|>", "İstanbul ΣΑΣ ﬁ é é", "x" * 30_000, "ab " * 4000, " " * 5000,
        "１２３ ½ 漢字 \x1c \x85 \xa0 z", "\x00\x01\x02", *("".join(pick() for _ in range(rng.randint(1, 80))) for _ in range(60)),
    ]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(odd_texts()))
    return rows + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]


def test_bpe_equals_library(spark, texts):
    lib = load(WORD)
    got = encode_decode(frame(spark, texts), WORD).collect()
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    digests = encode_decode(frame(spark, texts), WORD, digests=True)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.ids_sha256 for r in digests.collect()} == {hashlib.sha256(w[2].encode()).hexdigest() for w in want}


def test_bpe_forgets_words():
    coder = Coder(WORD)
    import placewright.llm.bpe as bpe

    memory, bpe.MEMORY = bpe.MEMORY, 3
    try:
        assert coder.encode(["one two three", "four five two"])[1][0] == coder.encode(["four five two"])[0][0]
    finally:
        bpe.MEMORY = memory


def test_counts_equal_library(spark, texts):
    lib = load(BYTE)
    got = count_tokens(frame(spark, texts), BYTE, limit=10)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for i, t in texts:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_fill_is_best_possible():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(6)}
        room = rng.randint(1, 60)
        chosen = best_fill(counts, room)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_each_piece_once():
    counts = {7: 100, 300: 41, 512: 9, 1023: 2, 600: 5}
    used = {}
    for times, fill in bin_plan(counts, 1024):
        assert sum(k * n for k, n in fill.items()) <= 1024
        for k, n in fill.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


def test_pack(spark, texts):
    got = pack(frame(spark, texts), BYTE).toPandas()
    lib = load(BYTE)
    whole = {}
    for i, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        whole.setdefault(i, []).append(ids)
    pieces = [(i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for i, many in whole.items() for ids in many for s in range(0, len(ids), 1024)]
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(pieces, key=str)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert list(bin_.offset) == [0, *np.cumsum(bin_.length)[:-1]]
        assert bin_.length.sum() <= 1024


def test_pack_pads_little(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 1500)))) for i in range(300)])
    got = pack(docs, BYTE).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert got.n.sum() / (1024 * len(got)) > 0.98


def test_long_runs_equal_library():
    for text in ("a" * 5000 + " b", " " * 3000 + "x", "ab" * 4000):
        assert encode(BYTE, text) == load(BYTE).encode(text, add_special_tokens=False).ids


def test_exact_duplicates(spark, texts):
    rows = texts + [(100, "HELLO   world, DON'T we'll"), (101, "É"), (102, "é"), (103, ""), (103, "")]
    got = exact_duplicates(frame(spark, rows)).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(lower), []).append(i)
    known = lambda ids: max((i for i in ids if i is not None), default=None)
    want = [(i, known(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).filter("doc_id > 1")
    assert encode_decode(none, WORD).count() == 0
    assert count_tokens(none, BYTE).count() == 0
    assert pack(none, BYTE).count() == 0
    assert exact_duplicates(none).count() == 0
