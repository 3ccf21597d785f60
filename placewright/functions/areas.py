"""Area (administrative district) expressions built from a small dimension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placewright import fixed_values as fv
from placewright.functions.text import clean, clean_nullish, lit_array, lit_map as _map


def _strip_city(text: Column) -> Column:
    for prefix in fv.CITY_PREFIXES:
        text = F.replace(text, F.lit(prefix), F.lit(""))
    return F.trim(text)


def _first_contained(text: Column, names) -> Column:
    return F.get(F.filter(lit_array(names), lambda n: F.contains(text, n)), F.lit(0))


def norm_area(c, areas=None, aliases=None) -> Column:
    """Canonical area of a text: token, whole text, containment, else the text.

    Null for null-like text. ``aliases`` maps other spellings to an area.
    """
    names = list(areas or fv.AREAS)
    stems = {n[: -len(fv.AREA_SUFFIX)]: n for n in names if n.endswith(fv.AREA_SUFFIX)}
    spelled = {**stems, **(aliases or {})}
    lookup = _map({**spelled, **{n: n for n in names}})
    text = _strip_city(clean(c))
    token = lambda t: F.try_element_at(lookup, F.trim(t, F.lit(",.;:()[]{}")))
    by_token = F.get(F.filter(F.transform(F.split(text, r"\s+"), token), lambda v: v.isNotNull()), F.lit(0))
    compact = F.replace(text, F.lit(" "), F.lit(""))
    by_alias = F.try_element_at(_map(spelled), _first_contained(compact, list(spelled))) if spelled else F.lit(None)
    out = F.coalesce(by_token, token(text), _first_contained(compact, names), by_alias, text)
    plain = F.col(c) if isinstance(c, str) else c
    # Canonical values, the usual case, take the first branch and stay cheap.
    return (F.when(plain.isin(names), plain)
            .when(F.lower(clean(c)).isin(fv.NULL_WORDS) | (text == ""), F.lit(None)).otherwise(out))


def standard_area(c, landmarks: dict, areas=None) -> Column:
    """``norm_area`` (or the raw text), then a landmark lookup on the result."""
    text = F.coalesce(norm_area(c, areas), clean(c))
    return F.coalesce(F.try_element_at(_map(landmarks), text), text)


def area_from_context(c, *context, areas=None, landmarks=None) -> Column:
    """First canonical area named in any text, then a landmark, else the value."""
    names = list(areas or fv.AREAS)
    marks = landmarks if landmarks is not None else fv.GOLD_LANDMARK_AREAS
    text = F.concat_ws(" ", *[F.nullif(clean_nullish(x), F.lit("")) for x in (c, *context)])
    by_mark = F.try_element_at(_map(marks), _first_contained(text, list(marks))) if marks else F.lit(None)
    return F.coalesce(_first_contained(text, names), by_mark, clean_nullish(c))


def first_area(cols, areas=None, aliases=None) -> Column:
    """First column that normalises to an area."""
    return F.coalesce(*[norm_area(c, areas, aliases) for c in cols])


def extract_area(*cols, pattern: str = fv.AREA_WORD_PATTERN) -> Column:
    """First area-like word over several texts; null when none has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(clean(c), pattern, 1), F.lit("")) for c in cols])


def area_from_name(c, known=None, pattern: str = fv.AREA_WORD_PATTERN) -> Column:
    """Area of a station-like name: exact, area word, then name without (...)."""
    table = _map(known or fv.STATION_AREAS)
    name = clean(c)
    bare = F.trim(F.regexp_replace(name, r"\(.*?\)", ""))
    return F.coalesce(F.try_element_at(table, name), extract_area(name, pattern=pattern),
                      F.try_element_at(table, bare))


def start_area(c, areas=None) -> Column:
    """Area of a free-text start location; blank when unknown.

    An area counts when its name occurs, or its stem of two or more letters.
    """
    names = sorted(areas or fv.AREAS)
    text = clean_nullish(c)
    compact = F.replace(_strip_city(text), F.lit(" "), F.lit(""))
    parts = F.split(text, r"[\s,.;:()\-_/]+")
    hits = []
    for name in names:
        stem = name.replace(fv.AREA_SUFFIX, "")
        hit = F.array_contains(parts, name) | compact.contains(name)
        if len(stem) >= 2:
            hit = hit | F.array_contains(parts, stem) | compact.contains(stem)
        hits.append(F.when(hit, F.lit(name)))
    marks = fv.START_LANDMARK_AREAS
    by_mark = F.try_element_at(_map(marks), _first_contained(text, list(marks)))
    last = [F.when(text.contains(n.replace(fv.AREA_SUFFIX, "")), F.lit(n)) for n in names]
    return F.coalesce(*hits, by_mark, *last, F.lit(""))


def relation(a: Column, b: Column, adjacency: dict | None = None) -> Column:
    """same / adjacent (listed in either direction) / far."""
    edges = adjacency if adjacency is not None else fv.ROUTE_ADJACENCY
    both: dict[str, list[str]] = {}
    for x, ys in edges.items():
        for y in ys:
            both.setdefault(x, []).append(y)
            both.setdefault(y, []).append(x)
    if both:
        table = _map({x: sorted(set(ys)) for x, ys in both.items()})
        near = F.coalesce(F.array_contains(F.try_element_at(table, a), b), F.lit(False))
    else:
        near = F.lit(False)
    same = (a != "") & (b != "") & (a == b)
    return F.when(same, "same").when(near, "adjacent").otherwise("far")
