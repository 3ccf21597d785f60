"""Date and time-of-day expressions. Times of day are ``HH:MM`` text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placewright import fixed_values as fv
from placewright.functions.text import clean, clean_nullish, lit_array, lookup


def _hhmm(hour: Column, minute: Column, fallback: Column) -> Column:
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(ok, F.format_string("%02d:%02d", hour, minute)).otherwise(fallback)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i).try_cast("int")


def norm_time(c) -> Column:
    """``H:MM`` and ``HMM`` to ``HH:MM``; anything else unchanged."""
    text = clean(c)
    colon, compact = r"^(\d{1,2}):(\d{1,2})$", r"^(\d{1,2})(\d{2})$"
    return (
        F.when(text.rlike(colon), _hhmm(_group(text, colon, 1), _group(text, colon, 2), text))
        .when(text.rlike(compact), _hhmm(_group(text, compact, 1), _group(text, compact, 2), text))
        .otherwise(text)
    )


def norm_time_locale(c) -> Column:
    """``norm_time`` that also reads AM/PM words, dots and ``N시 M분``."""
    raw = F.replace(F.replace(clean_nullish(c), F.lit("："), F.lit(":")), F.lit("."), F.lit(":"))
    pm = raw.rlike("오후|PM|pm")
    am = raw.rlike("오전|AM|am") & ~pm
    text = F.trim(F.regexp_replace(raw, "(오전|오후|AM|PM|am|pm)", ""))
    forms = [r"(\d{1,2})\s*:\s*(\d{1,2})", r"(?<!\d)(\d{1,2})(\d{2})(?!\d)", r"(?<!\d)(\d{1,2})시(?:\s*(\d{1,2})분?)?"]
    out = None
    for form in forms:
        hour = _group(text, form, 1)
        hour = F.when(pm & (hour < 12), hour + 12).when(am & (hour == 12), F.lit(0)).otherwise(hour)
        value = _hhmm(hour, F.coalesce(_group(text, form, 2), F.lit(0)), text)
        out = F.when(text.rlike(form), value) if out is None else out.when(text.rlike(form), value)
    return out.otherwise(text)


def norm_date(c) -> Column:
    """Dates in the known layouts to ``YYYY-MM-DD`` text, else the raw text."""
    text = F.regexp_replace(clean_nullish(c), "[./]", "-")
    layouts = ["yyyyMMdd", "yyyy-M-d", "M-d-yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m"]
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in layouts])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), text)


def date_from_name(c, year: int = 2026) -> Column:
    """Date in a file name: ``20YYMMDD`` or a lone ``MMDD``; blank if none."""
    text = clean_nullish(c)
    full = F.nullif(F.regexp_extract(text, r"(20\d{6})", 1), F.lit(""))
    short = F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1), F.lit(""))
    code = F.coalesce(full, F.concat(F.lit(str(year)), short))
    return F.coalesce(F.date_format(F.try_to_timestamp(code, F.lit("yyyyMMdd")), "yyyy-MM-dd"), F.lit(""))


def as_date(c) -> Column:
    return F.try_to_timestamp(F.substring(clean(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def day_of_week(c) -> Column:
    """Monday-first weekday label; blank for a bad date."""
    day = F.weekday(as_date(c))
    return F.coalesce(F.get(lit_array(fv.WEEKDAYS), day), F.lit(""))


def d_day(c, reference: str = fv.REFERENCE_DAY) -> Column:
    gap = F.datediff(F.lit(reference).cast("date"), as_date(c))
    return F.coalesce(F.concat(F.lit("D-"), gap.cast("string")), F.lit(""))


def hour_of(c) -> Column:
    """Hour before the colon when 0..23, else null."""
    hour = F.try_element_at(F.split(clean(c), ":"), F.lit(1)).try_cast("int")
    return F.when(hour.between(0, 23), hour)


def time_slot4(c) -> Column:
    hour = F.when(clean(c).rlike(r"^\d{2}:\d{2}$"), F.substring(clean(c), 1, 2).try_cast("int"))
    return (F.when(hour.isNull(), "unknown").when(hour.between(5, 11), "morning")
            .when(hour.between(12, 17), "afternoon").when(hour.between(18, 21), "evening").otherwise("night"))


def time_slot2(c) -> Column:
    hour = F.try_element_at(F.split(clean(c), ":"), F.lit(1)).try_cast("int")
    return F.when(hour.between(5, 11), "morning").otherwise("afternoon")


def time_bucket6(c) -> Column:
    hour = hour_of(c)
    out = F.when(hour.isNull(), "unknown")
    for low, high, name in fv.TIME_BUCKETS:
        out = out.when((hour >= low) & (hour < high), name)
    return out.otherwise("evening")


def minutes(c) -> Column:
    """Minute of day; null unless ``HH:MM``."""
    form = r"^(\d{1,2}):(\d{2})$"
    hour, minute = _group(clean(c), form, 1), _group(clean(c), form, 2)
    return F.when(hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)


def format_minutes(m: Column) -> Column:
    m = F.least(F.greatest(m.cast("int"), F.lit(0)), F.lit(23 * 60 + 59))
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def time_slots(start, end, n) -> Column:
    """Evenly spaced ``HH:MM`` array; n is clamped to 1..8."""
    lo, hi = minutes(start), minutes(end)
    count = F.least(F.greatest(F.col(n) if isinstance(n, str) else n, F.lit(1)), F.lit(8))
    step = (hi - lo) / F.greatest(count - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: format_minutes(F.bround(lo + step * i)))


def time_table(hour: Column, kind: Column, bands, other) -> Column:
    """Value of (hour band, type) in a fixed table; ``other`` outside bands."""
    def pick(table):
        return lookup(kind, table, 0.0) if table else F.lit(0.0)

    out = F.when(hour.isNull(), 0.0)
    for low, high, table in bands:
        out = out.when((hour >= low) & (hour < high), pick(table))
    return out.otherwise(pick(other))
