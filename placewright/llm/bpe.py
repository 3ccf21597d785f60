"""Byte-pair encoding of whole texts, each word merged through a segment tree over its adjacent pairs."""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placewright.llm.common import plain_texts, slices
from placewright.llm.tokens import byte_symbols, load, specials, words

#: Words that a task remembers; the least that keeps memory bounded on endless vocabularies.
MEMORY = 250_000
NEVER = np.int64(1) << 62


class Merges:
    """Vocabulary and merge ranks of a tokenizers file of kind BPE."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name)) as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: t for t, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        pairs = np.array([[self.vocab[a], self.vocab[b], self.vocab[a + b]] for a, b in model["merges"]], dtype=np.int64)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        # A pair listed twice keeps its last rank, as a dictionary of merges does.
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.ranks = last[np.argsort(keys[last], kind="stable")]
        self.keys = keys[self.ranks]
        self.merged = pairs[:, 2]
        self.symbols = {b: c for b, c in byte_symbols().items()}
        self.bytes = np.array([self.vocab[self.symbols[b]] for b in range(256)])
        self.last_bytes = np.array([self.vocab[self.symbols[b] + self.end] for b in range(256)])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER for pairs that do not merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NEVER)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each (non-empty) word."""
        out: list[list[int] | None] = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            step = max(1, (1 << 19) // int(width))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], int(width)), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[list[int]]:
        """All words at once, one merge of each a step.

        tree[r] is the segment tree of word r: leaf width + i holds rank and place
        of the pair that begins at symbol i, an inner node the smaller of its two,
        so node 1 is the leftmost pair of lowest rank. A merge changes three
        leaves and their ancestors.
        """
        n = len(words)
        lengths = np.array([len(w) for w in words])
        place = np.arange(width)
        there = place < lengths[:, None]
        raw = np.zeros((n, width), dtype=np.uint8)
        raw[there] = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # column `width` stands for no symbol
        ids[:, :width] = np.where(there, self.bytes[raw], -1)
        ids[np.arange(n), lengths - 1] = self.last_bytes[raw[np.arange(n), lengths - 1]]
        after = np.where(place + 1 < lengths[:, None], place + 1, width)
        before = np.tile(np.append(np.where(place > 0, place - 1, width), width), (n, 1))
        after = np.concatenate([after, np.full((n, 1), width)], axis=1)
        tree = np.full((n, 2 * width), NEVER, dtype=np.int64)
        rank = self.rank(ids[:, :width], np.take_along_axis(ids, after[:, :width], axis=1))
        tree[:, width:] = np.where(rank < NEVER, rank * width + place, NEVER)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        alive = there
        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            root = tree[rows, 1]
            at, which = root % width, root // width
            gone = after[rows, at]
            then, prior = after[rows, gone], before[rows, at]
            new = self.merged[which]
            ids[rows, at], after[rows, at], before[rows, then] = new, then, at
            alive[rows, gone] = False
            leaves = np.stack([gone, at, prior])
            ranks = self.rank(np.concatenate([new, ids[rows, prior]]), np.concatenate([ids[rows, then], new])).reshape(2, -1)
            tree[rows, width + gone] = NEVER
            tree[rows, width + at] = np.where(ranks[0] < NEVER, ranks[0] * width + at, NEVER)
            led = prior < width
            tree[rows[led], width + prior[led]] = np.where(ranks[1] < NEVER, ranks[1] * width + prior, NEVER)[led]
            nodes = np.where(leaves < width, leaves + width, width + at)
            while True:
                nodes = nodes >> 1
                if not nodes[0, 0]:
                    break
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            rows = rows[tree[rows, 1] < NEVER]
        flat, ends = ids[:, :width][alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


@functools.cache
def merges(name: str) -> Merges:
    return Merges(name)


def _split_pattern(name: str) -> regex.Pattern:
    """Pattern of the file's words; what lies between them is left out."""
    with open(public_tokenizers.path(name)) as f:
        steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
    return regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))


#: Texts of these characters only are the same after composing (NFC), are lower-cased one by one, and have no white space but tab, line ends and space.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]*")
#: Longer pieces are forgotten after their batch.
LONG = 64


class Coder:
    """Encodes and decodes texts; remembers pieces and words for the length of a task."""

    def __init__(self, name: str):
        self.name, self.merges, self.normal, self.special = name, merges(name), load(name).normalizer, specials(name)
        # Both map to (number of ids, decimal ids, tokens): words, and pieces between white space.
        self.pattern, self.known, self.pieces, self.longest = _split_pattern(name), {}, {}, 0

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special strings stand for themselves and are cut out before normalisation."""
        found = []
        for i, part in enumerate(self.special.split(text)):
            found += [part] if i % 2 else words(self.name, self.pattern, self.normal.normalize_str(part))
        return found

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        self.longest = max(self.longest, max(map(len, fresh), default=0))
        strings, special = self.merges.strings, self.merges.specials
        plain = [w for w in fresh if w not in special]
        for word, ids in zip(plain, self.merges.encode([w.encode("utf-8") for w in plain]) if plain else [], strict=True):
            self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join([strings[i] for i in ids]))
        for word in special.keys() & fresh:
            self.known[word] = (1, str(special[word]), word)

    def learn_pieces(self, pieces: set[str]) -> None:
        """No word of a plain text reaches beyond white space, so a piece has the same words wherever it stands."""
        fresh = [p for p in pieces if p not in self.pieces]
        found = [(p,) if p.isalpha() else self.pattern.findall(p) for p in fresh]
        self.learn({w for some in found for w in some})
        known = self.known
        for piece, some in zip(fresh, found, strict=True):
            if len(some) == 1:
                self.pieces[piece] = known[some[0]]
            elif len(some) == 2:
                (n, ids, tokens), (m, more, others) = known[some[0]], known[some[1]]
                self.pieces[piece] = n + m, f"{ids} {more}", f"{tokens} {others}"
            else:
                self.pieces[piece] = self._joined(some, known)

    @staticmethod
    def _joined(parts: list[str], table: dict[str, tuple[int, str, str]]) -> tuple[int, str, str]:
        if not parts:
            return 0, "", ""
        n, ids, tokens = zip(*map(table.__getitem__, parts), strict=True)
        return sum(n), " ".join(ids), " ".join(tokens)

    def forget(self, pieces: set[str]) -> None:
        """Keeps memory bounded: long pieces go after each batch, and all but those of the last batch when there are too many."""
        for part in [p for p in pieces if len(p) > LONG]:
            del self.pieces[part]
        if len(self.pieces) > MEMORY:
            self.pieces = {p: self.pieces[p] for p in pieces if p in self.pieces}
        if len(self.known) > MEMORY:
            self.known = {}
        elif self.longest > LONG:
            self.known = {w: v for w, v in self.known.items() if len(w) <= LONG}
        self.longest = 0

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, decimal ids and decoded text (tokens joined by a space, as a file without a decoder has it)."""
        special = list(self.merges.specials)
        plain = [PLAIN.fullmatch(t) is not None and not any(s in t for s in special) for t in texts]
        split = [t.lower().split() if p else self.words(t) for t, p in zip(texts, plain, strict=True)]
        pieces = set().union(*(s for s, p in zip(split, plain, strict=True) if p))
        self.learn_pieces(pieces)
        self.learn({w for s, p in zip(split, plain, strict=True) if not p for w in s})
        out = [self._joined(s, self.pieces if p else self.known) for s, p in zip(split, plain, strict=True)]
        self.forget(pieces)
        return out


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimal, joined by spaces), decoded; with digests their SHA-256 instead.

    Words are merged through segment trees: the root names the leftmost pair of
    lowest rank, and a merge updates three leaves in logarithmic time, until no
    pair can merge. All distinct words of a batch go through the steps together.

    Null text counts as empty: no ids, empty strings. Repeated rows are encoded
    each on their own. Empty input gives an empty result.
    """

    def task(batches):
        coder = Coder(tokenizer)
        digest = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for batch in batches:
            for low, high, texts in slices(batch.column("text"), 2 << 20):
                found = coder.encode([texts.bytes(i).decode("utf-8") for i in range(high - low)])
                n, ids, decoded = zip(*found, strict=True)
                if digests:
                    ids, decoded = map(digest, ids), map(digest, decoded)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n, pa.int64()), pa.array(list(ids), pa.string()), pa.array(list(decoded), pa.string())], names=names)

    docs = plain_texts(docs, id_col, text_col)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    return docs.mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, {names[2]} string, {names[3]} string")
