"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of a lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are looked for word by word, and notices that are compared as sets of words.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by", "Licensed under CC BY NC 4.0"),
]


@dataclass(frozen=True)
class Settings:
    """Parameters of the scan.

    phrases, notices: (label, text) pairs; percent: part of a notice's distinct
    words that a block must hold; block: words between the starts of blocks. A block
    reaches `overlap` words into the next one, so a phrase or a notice of that
    many words lies whole in one block. All templates together may have `most_words`
    words (they are broadcast) and 63 labels.
    """

    phrases: list[tuple[str, str]] = field(default_factory=lambda: PHRASES)
    notices: list[tuple[str, str]] = field(default_factory=lambda: NOTICES)
    percent: int = 80
    block: int = 96
    overlap: int = 32
    most_words: int = 10_000


@dataclass(frozen=True)
class Template:
    """A phrase (all words, in this order) or a notice (at least `needed` of its distinct words)."""

    label: str
    words: list[str]
    needed: int
    phrase: bool

    @property
    def tokens(self) -> list[str]:
        return list(dict.fromkeys(self.words))


def templates(settings: Settings) -> list[Template]:
    found = []
    for phrase, pairs in ((True, settings.phrases), (False, settings.notices)):
        for label, text in pairs:
            words = [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]
            if not words:
                raise ValueError(f"no words in the template of {label}")
            n = len(set(words))
            found.append(Template(label, words, n if phrase else ceil(n * settings.percent / 100), phrase))
    if max((len(t.words) for t in found if t.phrase), default=0) > settings.overlap + 1:
        raise ValueError("overlap is too short for the longest phrase")
    if sum(len(t.words) for t in found) > settings.most_words or len({t.label for t in found}) > 63:
        raise ValueError("too many templates")
    return found


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def words_of(text: Column) -> Column:
    """All words of a text in order, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, rarest first; equal ones by name.

    Tokens of no template never meet one, so they need no place in the order. At most
    `most_words` counts come to the driver.
    """
    held = words.select(F.explode(F.array_intersect(_strings(tokens), "words")).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _prefixes(spark, found: list[Template], order: list[str]) -> DataFrame:
    """One row per template and prefix token: what the join and its filters need.

    A block with `needed` tokens of a template holds one of the template's
    size - needed + 1 first tokens in the global order. `lead` numbers the rows of a token.
    """
    place = {t: i for i, t in enumerate(order)}
    labels, rows, met = label_order(found), [], Counter()
    for t in found:
        ordered = sorted(t.tokens, key=place.__getitem__)
        for at, token in enumerate(ordered[: len(ordered) - t.needed + 1]):
            phrase = _strings(t.words) if t.phrase else F.lit(None).cast("array<string>")
            values = {"token": F.lit(token), "lead": F.lit(met[token]), "at": F.lit(at), "size": F.lit(len(ordered)), "needed": F.lit(t.needed), "tokens": _strings(ordered), "phrase": phrase, "bit": F.lit(1 << labels.index(t.label)).cast("long")}
            rows.append(F.struct(*[c.alias(name) for name, c in values.items()]))
            met[token] += 1
    return spark.range(1).select(F.inline(F.array(*rows)))


def label_order(found: list[Template]) -> list[str]:
    return sorted({t.label for t in found})


def matches(docs: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """Blocks that meet a template; one row more for a document whose first block meets none.

    docs: keys and words. Adds n_words, start (of the block, in words), first (true
    in exactly one row of a document), meets, overlap, size and bit of the template,
    and places (where a phrase begins in the document; null for notices).

    1. Texts are cut into blocks; `shared` is a block's tokens that any template has,
       in the global order.
    2. Prefix filter: a block probes with its tokens among the templates' prefixes.
    3. Length filter: a block with fewer than `needed` shared tokens is out.
       Positional filter: so is one with too few shared tokens after the first one.
    4. What is left is verified by the whole overlap, and a phrase word by word.
    """
    found = templates(settings)
    order = token_order(docs, sorted({w for t in found for w in t.tokens}))
    prefixes = _prefixes(docs.sparkSession, found, order)
    place = {t: i for i, t in enumerate(order)}
    probing = sorted({w for t in found for w in sorted(t.tokens, key=place.__getitem__)[: len(t.tokens) - t.needed + 1]}, key=place.__getitem__)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(settings.block))
    blocks = docs.select(*keys, F.size("words").alias("n_words"), "words", F.explode(starts).alias("start"))
    blocks = blocks.select(*keys, "n_words", "start", F.slice("words", F.col("start") + 1, settings.block + settings.overlap).alias("block"))
    blocks = blocks.withColumn("shared", F.array_intersect(_strings(order), "block"))
    probes = blocks.withColumn("probes", F.array_intersect(_strings(probing), "shared")).filter((F.size("probes") > 0) | (F.col("start") == 0))
    probes = probes.select(*keys, "n_words", "start", "block", "shared", F.posexplode_outer("probes").alias("probe", "token"))
    pairs = probes.join(F.broadcast(prefixes), "token", "left")
    at_block = F.array_position("shared", F.col("token")).cast("int") - 1
    after = 1 + F.least(F.col("size") - F.col("at") - 1, F.size("shared") - at_block - 1)
    common = F.array_intersect("tokens", "shared")
    # A pair meets at each of its common prefix tokens; the first of them counts.
    meets = (F.size("shared") >= F.col("needed")) & (after >= F.col("needed")) & (F.size(common) >= F.col("needed")) & (F.get(common, F.lit(0)) == F.col("token"))
    own = F.sequence(F.lit(1), F.least(F.size("block"), F.lit(settings.block)))
    places = F.transform(F.filter(own, lambda p: F.slice("block", p, F.size("phrase")) == F.col("phrase")), lambda p: F.col("start") + p - 1)
    first = (F.col("start") == 0) & (F.coalesce("probe", F.lit(0)) == 0) & (F.coalesce("lead", F.lit(0)) == 0)
    pairs = pairs.select(*keys, "n_words", "start", first.alias("first"), F.coalesce(meets, F.lit(False)).alias("meets"), F.size(common).alias("overlap"), "size", "bit", F.when(meets & F.col("phrase").isNotNull(), places).alias("places"), F.col("phrase").isNotNull().alias("is_phrase"))
    return pairs.withColumn("meets", F.col("meets") & (~F.col("is_phrase") | (F.size("places") > 0))).filter("first or meets").drop("is_phrase")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where the words of a phrase stand consecutively, over
    all phrases; first_word and last_word are the smallest and largest of them.
    labels adds those of notices of which a block holds at least `percent` of the
    distinct words. score is the largest part of a template that was found: 1 with a
    phrase, 0 without any match.

    A document's rows stay in the task that reads it until they are summed, so what
    is shuffled is one short row per document. Null and empty texts have no words
    and no labels (empty strings), score 0, first_word and last_word null. Rows equal
    in id and text are each returned; rows with one id and different texts are kept
    apart. Empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_id"), words_of(F.col(text_col)).alias("words"))
    met = matches(rows, ["doc_id", "text_id"], settings)
    labels = label_order(templates(settings))
    bit, places = F.when(F.col("meets"), F.col("bit")), F.col("places")
    found = met.groupBy("doc_id", "text_id", "n_words").agg(
        F.sum(F.col("first").cast("long")).alias("copies"),
        F.coalesce(F.sum(F.when(places.isNotNull(), F.size(places))), F.lit(0)).alias("n_base"),
        F.min(F.array_min(places)).alias("first_word"), F.max(F.array_max(places)).alias("last_word"),
        F.bit_or(F.when(F.size(places) > 0, bit)).alias("base"), F.bit_or(bit).alias("all"),
        F.coalesce(F.max(F.when(F.col("meets"), F.col("overlap") / F.col("size"))), F.lit(0.0)).alias("score"),
    )
    named = lambda bits: F.concat_ws(",", *[F.when(F.col(bits).bitwiseAND(1 << i) != 0, F.lit(label)) for i, label in enumerate(labels)])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.expr("n_base div copies").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), named("base").alias("base_labels"), named("all").alias("labels"), "score")
