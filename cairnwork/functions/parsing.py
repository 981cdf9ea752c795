"""Parsing and normalising of published text: numbers, kinds, labels, names, dates, evidence, display strings and save codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for a value that doesn't apply, marks of a box, and terms that are written in one way.
NOT_APPLICABLE = ("n/a", "na", "not applicable", "not-applicable", "not required", "not offered")
BOXES = ("☒", "☑", "✓", "x", "/yes", "/x", "checked", "unchecked", "☐")
TERMS = (
    ("\\bmales?\\b", "men"), ("\\bfemales?\\b", "women"), ("\\b(?:another gender|unknown gender|unknown sex)\\b", "unknown"),
    ("\\bnonresident aliens?\\b", "nonresidents"), ("\\bfreshm[ae]n\\b", "first-year"),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def lenient_number(text: Column) -> Column:
    """A number after dropping $ , % and blanks, in any notation; null for other text."""
    number = F.regexp_replace(text, "[$,%\\s]", "").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def grouped_number(text: Column) -> Column:
    """A number as a spreadsheet may take it: thousands grouped by commas or not at all; codes with a leading zero are no numbers."""
    bare = F.regexp_replace(F.trim(text), "[$,%\\s]", "")
    shaped = F.trim(text).rlike("^\\$?\\s?(\\d{1,3}(,\\d{3})*|\\d+)(\\.\\d+)?%?$")
    return F.when(shaped & ~bare.rlike("^0\\d"), bare.try_cast("double"))


def numbers_match(expected: Column, actual: Column) -> Column:
    """Whether two texts say the same: equal, or equal whole parts where a whole number is expected, or within 0.005."""
    e, a = F.trim(expected), F.trim(actual)
    x, y = e.try_cast("double"), a.try_cast("double")
    near = F.when(~e.contains("."), y.cast("bigint") == x.cast("bigint")).otherwise(F.abs(x - y) < 0.005)
    return (e == a) | F.coalesce(near, F.lit(False))


def value_kind(text: Column, hint: Column) -> Column:
    """What kind of value a field holds, by its text and the words about the field (lower case)."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hint = F.coalesce(hint, F.lit(""))
    rated = hint.rlike("\\b(percent|percentage|rate)\\b") & ~hint.contains("percentile")
    return (
        F.when(low.isin(*NOT_APPLICABLE), "not_applicable").when(rated | low.contains("%"), "percent")
        .when(hint.rlike("currency|dollar") | low.startswith("$"), "currency").when(hint.rlike("yes/?no") | low.isin("yes", "no", "true", "false"), "yesno")
        .when(low.isin(*BOXES), "checkbox").when(hint.rlike("number|nearest tenth"), "number").when(text.isNull(), "unknown").otherwise("text")
    )


def normalised_label(text: Column, terms: bool = True) -> Column:
    """Lower case, terms of sex, cohort and residence in one spelling if asked, signs between words as one blank."""
    low = F.lower(text)
    for pattern, word in TERMS if terms else ():
        low = F.regexp_replace(low, pattern, word)
    return F.trim(F.regexp_replace(low, "[,\\-–—:;/()\\s]+", " "))


def normalised_name(text: Column, dropped: Sequence[str] = ()) -> Column:
    """Lower case, & as and, letters and digits only, without the words ``dropped``."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*dropped)) if dropped else words, " ")


def question_number(code: Column) -> Column:
    """A101, a.101 or C9 as A.101, A.101 and C.009; a number with a letter is not padded; null for anything else."""
    pattern = "(?i)^\\s*([a-j])\\.?(\\d{1,3}[a-z]?)\\s*$"
    part = F.upper(F.regexp_extract(code, pattern, 2))
    return F.when(code.rlike(pattern), F.concat(F.upper(F.regexp_extract(code, pattern, 1)), F.lit("."), F.when(part.rlike("^\\d+$"), F.lpad(part, 3, "0")).otherwise(part)))


def clean_token(text: Column, most: int = 120) -> Column:
    """At most ``most`` characters of a token, unusual ones as one dash; null for an empty one."""
    cut = F.regexp_replace(F.substring(F.trim(text), 1, most), "[^a-zA-Z0-9._:/@+-]", "-")
    return F.nullif(F.regexp_replace(cut, "-+", "-"), F.lit(""))


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """The template with {names} filled in; null if one is left over or a value is null."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.when(~out.rlike("\\{[a-z_]+\\}"), out)


def trimmed_number(value: Column, digits: int) -> Column:
    """A number with up to ``digits`` decimals, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), "0+$", ""), "\\.$", "")


def fact_display(label: Column, text: Column, number: Column, unit: Column) -> Column:
    """What is shown of a fact: its label, else its text, else its number, with % for percentages."""
    return F.coalesce(label, text, F.when(unit == "percent", F.concat(trimmed_number(number, 3), F.lit("%"))).otherwise(trimmed_number(number, 6)))


def normalised_value(number: Column, flag: Column, text: Column) -> Column:
    """A value as text: the number, else the flag, else the text."""
    return F.coalesce(number.cast("string"), flag.cast("string"), text)


def percent_text(rate: Column) -> Column:
    """A rate as a percentage, with one decimal below 10%."""
    share = rate * 100
    return F.concat(F.when(share < 10, share.cast("decimal(20,1)").cast("string")).otherwise(share.cast("decimal(20,0)").cast("string")), F.lit("%"))


def money_text(amount: Column) -> Column:
    """Whole dollars with grouped thousands."""
    return F.concat(F.when(amount <= -0.5, "-").otherwise(""), F.lit("$"), F.format_number(F.round(F.abs(amount)), 0))


def delta_text(change: Column, kind: str) -> Column:
    """A change with its sign: rates in points with one decimal, other values whole or with two."""
    if kind == "rate":
        number = F.concat((change * 100).cast("decimal(20,1)").cast("string"), F.lit(" pts"))
    else:
        number = F.when(change == F.floor(change), change.cast("bigint").cast("string")).otherwise(change.cast("decimal(20,2)").cast("string"))
    return F.when(change > 0, F.concat(F.lit("+"), number)).otherwise(number)


def named_year(text: Column, latest: int = 2035) -> Column:
    """The academic year that a text names after Common Data Set or, failing that, after CDS; the second year must follow the first."""
    dash = "[-‐-—−/]"

    def after(words: str, end: str) -> Column:
        pattern = f"(?i){words}\\s*[,:]?\\s*(20\\d{{2}})\\s*{dash}\\s*(20\\d{{2}}|\\d{{2}}){end}"
        a, b = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int") for k in (1, 2))
        return F.when(((a + 1) % 100 == b % 100) & (a <= latest), F.concat(a.cast("string"), F.lit("-"), F.lpad((b % 100).cast("string"), 2, "0")))

    return F.coalesce(after("Common\\s+Data\\s+Set", ""), after("\\bCDS", "\\b"))


def year_start(span: Column) -> Column:
    """The first year of a span such as 2024-25."""
    return F.nullif(F.regexp_extract(span, "^((?:19|20)\\d{2})-\\d{2}$", 1), F.lit("")).cast("int")


def pdf_timestamp(text: Column) -> Column:
    """The UTC time of a PDF date such as D:20240131120000-05'00'; parts after the year may be missing; null if it isn't one.

    Years run from 1900 to 2200. A date without offset counts as UTC.
    """
    pattern = "^(?:D:)?(\\d{4})(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(?:Z|([+-])(\\d{2})'?(\\d{2})?'?)?"

    def part(k: int, default: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(F.trim(text), pattern, k), F.lit("")).cast("int"), F.lit(default))

    year = part(1, 0)
    local = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0)), F.lit("yyyy-MM-dd HH:mm:ss"))
    minutes = F.when(F.regexp_extract(F.trim(text), pattern, 7) == "-", -1).otherwise(1) * (part(8, 0) * 60 + part(9, 0))
    return F.when(F.trim(text).rlike(pattern) & year.between(1900, 2200), local - F.make_dt_interval(mins=minutes))


def release_date(text: Column) -> Column:
    """struct(day, precision) of a release date: March 4, 2026 and 2026-03-04 by the day, March 2026 by the month (its first); null otherwise."""
    low = F.lower(F.trim(text))
    names = "|".join(MONTHS)
    number = F.lpad(F.array_position(F.lit(list(MONTHS)), F.regexp_extract(low, f"^({names})\\b", 1)).cast("string"), 2, "0")
    by_day, by_month = f"^({names})\\s+(\\d{{1,2}}),\\s*(\\d{{4}})$", f"^({names})\\s+(\\d{{4}})$"
    day = F.concat_ws("-", F.regexp_extract(low, by_day, 3), number, F.lpad(F.regexp_extract(low, by_day, 2), 2, "0"))
    month = F.concat_ws("-", F.regexp_extract(low, by_month, 2), number, F.lit("01"))

    def made(value: Column, precision: str) -> Column:
        return F.struct(value.alias("day"), F.lit(precision).alias("precision"))

    return F.when(low.rlike(by_day), made(day, "day")).when(low.rlike(by_month), made(month, "month")).when(low.rlike("^\\d{4}-\\d{2}-\\d{2}$"), made(low, "day"))


def hours_since(then: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now) / 3600


def age_bucket(hours: Column) -> Column:
    return F.when(hours.isNull(), "unknown").when(hours < 1, "under an hour").when(hours < 24, "under a day").when(hours < 168, "under a week").otherwise("older")


def half_away(value: Column, digits: int = 0) -> Column:
    """Rounds halves away from zero, in decimals so that 2.675 is what it says."""
    return F.round(value.cast("string").cast("decimal(38,12)"), digits)


def evidence_present(evidence: Column, text: Column) -> Column:
    """Whether the evidence stands in the text, as it is or with white space as single blanks; blank evidence doesn't."""
    one_blank = [F.regexp_replace(x, "\\s+", " ") for x in (evidence, text)]
    return F.coalesce((F.trim(evidence) != "") & (text.contains(evidence) | one_blank[1].contains(F.trim(one_blank[0]))), F.lit(False))


def labels_in(evidence: Column, labels: Column, least: int = 15) -> Column:
    """How many different normalised labels of ``least`` letters or more stand in the evidence; two or more suggest merged rows."""
    own = normalised_label(evidence)
    return F.size(F.filter(F.array_distinct(labels), lambda x: (F.length(x) >= least) & own.contains(x)))


def typed_value(text: Column, kind: Column) -> Column:
    """The canonical text of a value of the declared kind (Number, Nearest $1, MM, DD, YesNo, x, others as they are); null if it isn't one."""
    bare = F.trim(text)
    number = F.trim(F.regexp_replace(bare, "[$%,]", ""))
    numeric = number.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$")
    whole = F.when(numeric, F.floor(number.try_cast("double")).cast("int"))
    low = F.lower(bare)

    def within(most: int) -> Column:
        return F.when(whole.between(1, most), whole.cast("string"))

    yes_no = F.when(low.isin("yes", "y", "true", "1"), "Yes").when(low.isin("no", "n", "false", "0"), "No")
    box = F.when(low.isin("x", "checked", "yes", "true", "1", "☒"), "x")
    out = F.when(kind.isin("Number", "Nearest $1"), F.when(numeric, number)).when(kind == "MM", within(12)).when(kind == "DD", within(31))
    return F.when(bare != "", out.when(kind == "YesNo", yes_no).when(kind == "x", box).otherwise(bare))


def sane(value: Column, kind: Column, question: Column) -> Column:
    """Null if a typed value is plausible, else the reason why not."""
    number = value.try_cast("double")
    share = F.lower(question).rlike("percent|%")
    return F.when(share & ~number.between(0, 100), "percent_out_of_range").when((kind == "Number") & (number < 0), "negative_count").when((kind == "Nearest $1") & (number < 0), "negative_currency")


def first_issue(issues: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first issue whose condition holds, null conditions counting as false; null if none does."""
    return reduce(lambda out, x: F.when(F.coalesce(x[0], F.lit(False)), x[1]).otherwise(out), reversed(issues), F.lit(None).cast("string"))


# Digits of save codes, bits and empty marks of their fields from the lowest, and the version in the highest bits.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
GPA_NONE, SAT_NONE, ACT_NONE, CODE_VERSION = 511, 127, 0, 1


def save_code(gpa: Column, sat: Column, act: Column, scale: Column) -> Column:
    """A profile as six digits of base 32 in two groups: grade average (9 bits), SAT (7), ACT (6), scale (2) and version (2).

    Values outside their range count as missing.
    """

    def field(value: Column, low: float, high: float, coded: Column, none: int) -> Column:
        return F.coalesce(F.when(value.between(low, high), F.floor(coded + 0.5)), F.lit(none)).cast("bigint")

    packed = (
        F.lit(CODE_VERSION << 24).cast("bigint") + F.shiftleft(F.coalesce(scale, F.lit(0)).cast("bigint"), 22) + F.shiftleft(field(act, 1, 36, act, ACT_NONE), 16)
        + F.shiftleft(field(sat, 400, 1600, (sat - 400) / 10, SAT_NONE), 9) + field(gpa, 0, 5, gpa * 100, GPA_NONE)
    )
    digits = [F.substring(F.lit(DIGITS), F.shiftright(packed, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(5, -1, -1)]
    return F.concat(*digits[:3], F.lit("-"), *digits[3:])


def profile_of(code: Column) -> Column:
    """struct(gpa, sat, act, scale) of a save code; null for a wrong length, digit or version."""
    bare = F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")
    packed = F.lit(0).cast("bigint")
    for k in range(6):
        packed = packed * 32 + (F.instr(F.lit(DIGITS), F.substring(bare, k + 1, 1)) - 1)

    def bits(at: int, width: int) -> Column:
        return F.shiftright(packed, at).bitwiseAND(F.lit((1 << width) - 1))

    valid = bare.rlike(f"^[{DIGITS}]{{6}}$") & (bits(24, 2) == CODE_VERSION)
    return F.when(valid, F.struct(
        F.when(bits(0, 9) != GPA_NONE, bits(0, 9) / 100).alias("gpa"), F.when(bits(9, 7) != SAT_NONE, 400 + bits(9, 7) * 10).alias("sat"),
        F.when(bits(16, 6) != ACT_NONE, bits(16, 6)).alias("act"), bits(22, 2).alias("scale"),
    ))
