"""Scalar parsing, formatting and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_number(text: Column) -> Column:
    """A number after dropping $ , % and blanks; null for ranges, approximations and other text."""
    bare = F.regexp_replace(text, "[$,%\\s]", "")
    return F.when(bare.rlike("^-?\\d+(\\.\\d+)?$"), bare.try_cast("double"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def padded_id(number: Column, width: int = 6) -> Column:
    """Zero-padded; a longer id is kept whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def safe_rate(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """n / d; null for a denominator of 0 or less, a negative numerator or a rate above 1."""
    rate = F.when((denominator > 0) & (numerator >= 0), numerator / denominator)
    return F.round(F.when(rate <= 1, rate), digits)


def half_up(value: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(value + 0.5)


def event_id(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by |, null as empty."""
    joined = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *joined), 256), 1, 32)


def shaped_uuid(key: Column) -> Column:
    h = F.sha2(key, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 3958.8) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(a))


def interpolated_percentile(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Piecewise linear through the quartiles, carried on beyond them, kept in 5 to 95.

    Null for quartiles out of order or all equal. A quartile range under 1 counts as 1.
    """
    below = 25 + (value - p25) / F.greatest(F.lit(1.0), p50 - p25) * 25
    upper = F.greatest(F.lit(1.0), p75 - p50)
    at = F.when(value <= p25, F.greatest(F.lit(5.0), below)).when(value <= p50, F.least(F.lit(50.0), below))
    at = at.when(value <= p75, F.least(F.lit(75.0), 50 + (value - p50) / upper * 25)).otherwise(F.least(F.lit(95.0), 75 + (value - p75) / upper * 25))
    return F.when((p25 <= p50) & (p50 <= p75) & (p25 < p75) & value.isNotNull(), at)


def academic_fit(score: Column, p25: Column, p75: Column, margin: float) -> Column:
    """Where a score stands against the middle half; null for missing or unordered quartiles."""
    fit = F.when(score >= p75 + margin, "above_range").when(score >= p75, "strong_academic_fit").when(score >= p25, "in_range").otherwise("below_range")
    return F.when((p25 < p75) & score.isNotNull(), fit)


def admissions_outlook(rate: Column) -> Column:
    return F.when(rate.isNull(), "unknown").when(rate < 0.1, "high_reach").when(rate < 0.25, "reach").when(rate < 0.5, "possible").otherwise("likely")


def academic_year(text: Column) -> Column:
    """The first academic year named in a text, as 2024-25; null if none.

    Spans are looked for as 2024-2025, then 2024-25, 24-25 and 2425 (four digits start with 20);
    the second year must follow the first, and years run from 1990 to 2035. Of two digits, 80 to 89 are in the
    1900s and so are 90 to 99 where the second year is 00 to 09; 19 and 20 never start 2425.
    """
    # What may stand between the years of a span, and the forms of a span in the order in which they are tried.
    gap = "[\\s_\\-\u2013\u2014]+"
    forms = [
        (f"(20\\d{{2}}){gap}(20\\d{{2}})", None),
        (f"(20\\d{{2}}){gap}(\\d{{2}})(?=\\D|$)", None),
        (f"(?:^|[^0-9])(\\d{{2}}){gap}(\\d{{2}})(?=\\D|$)", ()),
        ("(?:^|[^0-9])(\\d{2})(\\d{2})(?=\\D|$)", ("19", "20")),
    ]

    def spans(pattern: str, barred: tuple[str, ...] | None) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))

        def year(x: Column) -> Column:
            a, b = x["a"].cast("int"), x["b"].cast("int") % 100
            first = a if barred is None else F.when((a.between(80, 89)) | ((a >= 90) & (b <= 9)), 1900 + a).otherwise(2000 + a)
            fits = ((first + 1) % 100 == b) & first.between(1990, 2035)
            return F.when(fits & ~x["a"].isin(*barred) if barred else fits, F.concat_ws("-", first.cast("string"), F.lpad(b.cast("string"), 2, "0")))

        return F.get(F.filter(F.transform(both, year), lambda y: y.isNotNull()), F.lit(0))

    return F.coalesce(*[spans(*f) for f in forms])


def version_parts(version: Column) -> Column:
    """A dotted version as integers, other parts as 0: arrays compare part by part, so 1.10 follows 1.9."""
    return F.transform(F.split(version, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def natural_key(identifier: Column, width: int = 12) -> Column:
    """A sort key that orders runs of digits by value: C.9 before C.10."""
    padded = F.regexp_replace(identifier, "(\\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, f"0*(\\d{{{width}}})(?!\\d)", "$1")


def truth(text: Column) -> Column:
    """Yes and no words and ticked or empty boxes as booleans; null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "y", "x", "1", "\u2612", "\u2611", "\u2713"), True).when(low.isin("false", "no", "n", "0", "\u2610"), False)


def fraction(number: Column, text: Column) -> Column:
    """A percentage as a fraction: divided by 100 if the text has a % or the number is above 1."""
    return F.when(text.contains("%") | (number > 1), number / 100).otherwise(number)


def host(url: Column) -> Column:
    """The lower-case host without port and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), "^www\\.", "")


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def merged_maps(base: Column, over: Column) -> Column:
    """The union of two maps; ``over`` wins where both have a key, a null map counts as empty."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(F.map_concat(kept, over))
