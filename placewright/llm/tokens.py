"""Public tokenizer files as seen by the operators: loading, special strings, ids."""

from __future__ import annotations

import functools
import json

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters on whose class (letter, number, space) not every Unicode version agrees, or may not; texts that
#: hold one are split by the tokenizers library itself, all others by the same patterns elsewhere.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]")
#: Runs this long go to the tokenizers library, whose merge queue does not slow down on one huge piece.
LONG_RUN = regex.compile(r"\S{2000}|\s{2000}")


@functools.cache
def load(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def specials(name: str) -> regex.Pattern | None:
    """Pattern of the special strings that the file's library takes out of a text before anything else."""
    with open(public_tokenizers.path(name)) as f:
        names = [t["content"] for t in json.load(f)["added_tokens"] if t["special"]]
    return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None


@functools.cache
def byte_symbols() -> dict[int, str]:
    """Printable character that byte-level vocabularies use for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@functools.cache
def ranked(name: str) -> tiktoken.Encoding:
    """The same vocabulary as merge ranks: in byte-level files without word ends, a token's id is the order of its merge."""
    with open(public_tokenizers.path(name)) as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_symbols().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


def encode(name: str, text: str) -> list[int]:
    """Ids as the tokenizers library gives them without added special tokens."""
    if LONG_RUN.search(text) or UNUSUAL.search(text):
        return load(name).encode(text, add_special_tokens=False).ids
    return ranked(name).encode(text, allowed_special="all")


@functools.cache
def _symbol_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_symbols().items()}


def library_words(name: str, text: str) -> list[str]:
    """Words of a normalised text as the file's own pre-tokenizer gives them."""
    back = _symbol_bytes()
    return [bytes(back[c] for c in word).decode("utf-8") for word, _ in load(name).pre_tokenizer.pre_tokenize_str(text)]


def words(name: str, pattern: regex.Pattern, text: str) -> list[str]:
    """Words of a normalised text; pattern is the file's own."""
    return library_words(name, text) if UNUSUAL.search(text) else pattern.findall(text)
