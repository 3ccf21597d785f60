"""Text expressions. All stay in the JVM except ``nfkc`` and ``ratio``."""

from __future__ import annotations

import re
import sys
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from placewright import fixed_values as fv

# Full-width ASCII (U+FF01..U+FF5E) folds onto ASCII by a constant offset.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_PLAIN = "^[ -~가-힣\\s！-～]*$"


def sql_lit(v) -> str:
    """SQL literal of a Python value; numbers are doubles unless int."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_lit(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lit_array(values) -> Column:
    """Literal array as one expression."""
    return F.expr(sql_lit(list(values)))


def lit_map(table: dict) -> Column:
    """Literal map as one expression."""
    return F.expr("map(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in table.items()) + ")")


def lookup(c: Column, table: dict, other) -> Column:
    """Value of a fixed table, else ``other``."""
    return F.coalesce(F.try_element_at(lit_map(table), c), other if isinstance(other, Column) else F.lit(other))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two already-blocked keys."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def clean(c) -> Column:
    """Trimmed text; null becomes the empty string."""
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def clean_nullish(c) -> Column:
    """``clean`` that also blanks the words nan and none."""
    t = clean(c)
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def _fold_tables() -> tuple[dict, dict, str]:
    """What NFKC makes of single characters, as far as keys can see it, by rule.

    Characters that become one key character or one conjoining jamo; characters
    that become several; and a pattern of the letters that a following mark turns
    into another, accented letter (which keys drop).
    """
    drop = re.compile(fv.KEY_DROP_PATTERN)
    one, many, marked = {}, {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "가" <= c <= "힣":
            continue
        full = unicodedata.normalize("NFKC", c)
        kept = drop.sub("", full.lower())
        if len(kept) == 1 or len(full) == 1 and "\u1100" <= full <= "\u11ff" and full != c:
            one[c] = kept or full
        elif kept:
            many[c] = kept
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalnum() and unicodedata.normalize("NFC", parts) == c:
            marked.setdefault(parts[1], []).append(parts[0])
    return one, many, "|".join(f"[{''.join(bases)}]{mark}" for mark, bases in marked.items())


_ONE, _MANY, _MARKED = _fold_tables()


def _ranges(chars) -> str:
    """Regular-expression class of a few ranges that hold all the characters, and others between them."""
    out = []
    for c in sorted(map(ord, chars)):
        if out and c - out[-1][1] <= (8 if c < 0x2000 else 0x1000):
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_SPELT = _ranges(_MANY)


def _composed(chars: Column) -> Column:
    """Text of an array of characters with conjoining jamo joined to syllables."""
    code = lambda x: F.ascii(x)
    syllable = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")

    def step(done, c):
        last = F.right(done, F.lit(1))
        head = F.left(done, F.length(done) - 1)
        vowel = code(c).between(0x1161, 0x1175) & code(last).between(0x1100, 0x1112)
        tail = code(c).between(0x11A8, 0x11C2) & code(last).between(0xAC00, 0xD7A3) & ((code(last) - 0xAC00) % 28 == 0)
        return (F.when(vowel, F.concat(head, syllable(0xAC00 + ((code(last) - 0x1100) * 21 + code(c) - 0x1161) * 28)))
                .when(tail, F.concat(head, syllable(code(last) + code(c) - 0x11A7))).otherwise(F.concat(done, c)))

    return F.aggregate(chars, F.lit(""), step)


def place_key(c) -> Column:
    """Comparison key: NFKC, lower case, then digits, a-z and Hangul syllables only.

    Plain text takes a short path; the rest is folded by tables and its jamo are
    composed, all in the JVM.
    """
    text = clean(c)
    many = F.expr("map_from_arrays(split({}, ','), split({}, ','))".format(sql_lit(",".join(_MANY)), sql_lit(",".join(_MANY.values()))))
    spelt = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    # Each of these steps is rare, and runs only where a text has what it is for.
    spelt = F.when(spelt.rlike(_SPELT), F.array_join(F.transform(F.split(spelt, ""), lambda x: F.coalesce(F.try_element_at(many, x), x)), "")).otherwise(spelt)
    spelt = F.when(spelt.rlike(r"\p{M}"), F.regexp_replace(spelt, _MARKED, "")).otherwise(spelt)
    words = F.transform(F.split(spelt, r"\s+"), lambda w: _composed(F.split(w, "")))
    folded = F.when(spelt.rlike("[\u1161-\u1175\u11a8-\u11c2]"), F.array_join(words, "")).otherwise(spelt)
    plain = F.translate(text, _WIDE, _NARROW)
    return F.regexp_replace(F.lower(F.when(text.rlike(_PLAIN), plain).otherwise(folded)), fv.KEY_DROP_PATTERN, "")


#: The key is the true NFKC key for any text.
place_key_nfkc = place_key


def relaxed_key(key: Column) -> Column:
    for token in fv.RELAXED_TOKENS:
        key = F.replace(key, F.lit(token), F.lit(""))
    return key


def _contained(a: Column, b: Column, least: int) -> Column:
    return (F.length(a) >= least) & (F.length(b) >= least) & (a.contains(b) | b.contains(a))


def partial_match(a: Column, b: Column, bare_a: Column | None = None, bare_b: Column | None = None) -> Column:
    """Either key contains the other, as given or without generic tokens (which callers may have dropped before)."""
    return _contained(a, b, 3) | _contained(relaxed_key(a) if bare_a is None else bare_a, relaxed_key(b) if bare_b is None else bare_b, 3)


def near_same_native(a: Column, b: Column) -> Column:
    """The part of near-sameness that needs no ratio: equality or containment."""
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | _contained(a, b, 4))


def contains_any(text: Column, words) -> Column:
    """True when any word occurs; words are literals, so one alternation scan."""
    escaped = [w.replace("\\", "\\\\").replace(".", "\\.").replace("+", "\\+") for w in words]
    return F.coalesce(text.rlike("|".join(escaped)), F.lit(False))


def matched_keywords(text: Column, words) -> Column:
    return F.filter(lit_array(words), lambda w: F.contains(text, w))


def first_rule(text: Column, rules, default: str) -> Column:
    """First label whose word list matches: an ordered cascade."""
    out = None
    for label, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def all_rules(text: Column, rules) -> Column:
    """Every label whose word list matches, in rule order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules]))


def split_tokens(c) -> Column:
    return F.filter(F.split(clean(c), r"[;,/|()\s]+"), lambda t: t != "")


def join_context(*cols) -> Column:
    return F.concat_ws(" ", *[clean(c) for c in cols])


def collapse_spaces(c) -> Column:
    return F.trim(F.regexp_replace(clean(c), r"\s+", " "))


def clean_place_name(c, exact: bool = False) -> Column:
    """Normalised name without its leading label ("장소:" and the like)."""
    text = clean_nullish(c)
    if exact:
        text = F.when(~text.rlike(_PLAIN), nfkc(F.when(~text.rlike(_PLAIN), text))).otherwise(
            F.translate(text, _WIDE, _NARROW))
    else:
        text = F.translate(text, _WIDE, _NARROW)
    text = F.regexp_replace(text, r"\s+", " ")
    return F.trim(F.regexp_replace(text, r"^(장소|방문지|위치)\s*[:：]\s*", ""))


def loose_name(c) -> Column:
    """Lower-cased name without spaces and generic place words."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"\s+", "")
    return F.regexp_replace(squeezed, fv.LOOSE_NAME_PATTERN, "")


def slug(c) -> Column:
    return F.translate(clean(c), " /", "__")


def leading_number(c) -> Column:
    """Leading number of a text with thousands separators, else 0."""
    digits = F.regexp_extract(F.trim(F.replace(clean(c), F.lit(","), F.lit(""))), r"^([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def label_map(c: Column, mapping: dict, other: Column) -> Column:
    """Value of a small fixed dictionary, else ``other``."""
    return lookup(c, mapping, other)


def route_type(c) -> Column:
    text = clean_nullish(c)
    return label_map(text, fv.ROUTE_TYPE_LABELS, F.when(text == "", fv.ROUTE_TYPE_OTHER).otherwise(text))


def code_type(c) -> Column:
    """Place-type code: senior folds into senior_friendly."""
    return F.when(clean(c) == "senior", "senior_friendly").otherwise(clean(c))


def normalise_actor(c, names: dict) -> Column:
    """Canonical actor; ``names`` maps canonical name -> list of other spellings."""
    text = clean_nullish(c)
    out = None
    for canonical, others in names.items():
        hit = text.contains(canonical) | F.lower(text).isin([o.lower() for o in others])
        out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
    return text if out is None else out.otherwise(text)


def actor_from_text(text: Column, patterns) -> Column:
    """First actor whose id token or name occurs in ids, source or context."""
    out = None
    for actor, token, name in patterns:
        hit = F.upper(text).contains(token) | text.contains(name)
        out = F.when(hit, actor) if out is None else out.when(hit, actor)
    return out.otherwise("unknown") if out is not None else F.lit("unknown")


def normalise_address(c) -> Column:
    text = clean_nullish(c)
    return F.when(text.isin(fv.ADDRESS_PLACEHOLDERS), fv.ADDRESS_UNKNOWN).otherwise(text)


def display_name(name, place_type, areas=None) -> Column:
    """Presentable place name: overrides, bare areas, stations, markets."""
    text = collapse_spaces(clean_nullish(name))
    compact = F.regexp_replace(text, r"\s+", "")
    kind = route_type(place_type)
    names = list(areas or fv.AREAS)
    stems = [a.replace(fv.AREA_SUFFIX, "") for a in names]
    stem = F.regexp_replace(compact, fv.AREA_SUFFIX + "$", "")
    full = label_map(compact, dict(zip(stems, names)), compact)
    override = F.try_element_at(lit_map(fv.NAME_OVERRIDES), compact)
    is_area = compact.isin(names + stems)
    transit = kind == "교통거점"
    return (
        F.when(text.isin(fv.ADDRESS_PLACEHOLDERS), "장소 확인 필요")
        .when(override.isNotNull(), override)
        .when(is_area & transit, F.concat(F.replace(full, F.lit(fv.AREA_SUFFIX), F.lit("")), F.lit("역 일대")))
        .when(is_area, F.concat(full, F.lit(" 주요 유세 거점")))
        .when(transit & compact.isin(fv.SQUARE_STATIONS), F.concat(compact, F.lit(" 광장")))
        .when(transit & compact.endswith("역") & ~contains_any(compact, ["출구", "광장", "앞", "일대"]),
              F.concat(compact, F.lit(" 출구 앞")))
        .when(transit & (F.length(compact) <= 5) & ~contains_any(compact, ["역", "시장", "공원", "복지"]),
              F.concat(compact, F.lit("역 일대")))
        .when(kind.isin("전통시장", "골목상권") & compact.contains("시장")
              & ~contains_any(compact, ["입구", "앞", "일대", "남문", "북문"]), F.concat(text, F.lit(" 입구")))
        .otherwise(text)
    )


def reason(name: str, value: Column, tail) -> Column:
    """``name=0.00 tail`` with two decimals."""
    tail = tail if isinstance(tail, Column) else F.lit(tail)
    return F.concat(F.lit(name + "="), F.format_string("%.2f", value), F.lit(" "), tail)


def score_from_reasons(reasons: Column, name: str = "interaction_score") -> Column:
    """Number parsed back out of a reason array, clamped; null when absent."""
    found = F.regexp_extract(F.array_join(reasons, "\n"), name + r"=([0-9.]+)", 1)
    return F.least(F.greatest(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0)), F.lit(1.0))


def first_non_blank(*cols) -> Column:
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols], F.lit(""))
