"""Text -> number / boolean / timestamp expressions, all null on failure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts a delimited file uses for a missing entry.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"
BOOLEAN_TEXT = ["True", "TRUE", "true", "False", "FALSE", "false"]

# English month names; the first three letters are their short forms.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

_CLOCK = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?\s*$"
_ISO = r"^\s*\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?)?\s*$"
_ISO_ZONED = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"
_YEAR_FIRST = r"^\s*(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _CLOCK
_YEAR_LAST = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + _CLOCK
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})" + _CLOCK
_NAME = "(" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]}{'|t' if m == 'september' else ''})?" for m in MONTHS) + ")"
_DAY_NAME = r"(?i)^\s*(\d{1,2})[ -]" + _NAME + r"\.?,?[ -]+(\d{4})" + _CLOCK
_NAME_DAY = r"(?i)^\s*" + _NAME + r"\.? +(\d{1,2}),? +(\d{4})" + _CLOCK
_HALF_DAY = r"(?i)^\s*(\d{1,2}/\d{1,2}/\d{4}) +(\d{1,2}:\d{2}(?::\d{2})?) *([AP]M)\s*$"
_SHORT_YEAR = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})" + _CLOCK
_SHORT_YEAR_NAMED = r"(?i)^\s*(\d{1,2})[ -]" + _NAME + r"\.?,?[ -]+(\d{2})" + _CLOCK
_MONTH_YEAR = r"(?i)^\s*" + _NAME + r"\.?,? +(\d{4})\s*$"
_COMPACT_CLOCK = r"^\s*(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?\s*$"
_ISO_HALF_DAY = r"(?i)^\s*(\d{4}-\d{1,2}-\d{1,2})[ T]+(\d{1,2}:\d{2}(?::\d{2})?) *([AP]M)\s*$"
# A leading day of the week says nothing more; a trailing zone makes the text a zoned one.
_WEEKDAY = r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +"
_MAIL_ZONE = r"(?i)^\s*(\d{1,2}) " + _NAME + r" (\d{4}) (\d{1,2}:\d{2}(?::\d{2})?) *(?:(GMT|UTC|Z)|([+-]\d{2}):?(\d{2}))\s*$"
# Two-digit years: from this one on they belong to the 1900s, before it to the 2000s.
CENTURY_TURN = 69


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def is_integer_text(c: Column) -> Column:
    return c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("bigint").isNotNull()


def to_number(c: Column) -> Column:
    """Double, for plain decimal notation and signed infinities only."""
    return F.when(c.rlike(DECIMAL_TEXT), F.trim(c).try_cast("double")).when(
        c.rlike(INFINITY_TEXT),
        F.when(F.ltrim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )


def to_boolean(c: Column) -> Column:
    return F.when(c.isin(BOOLEAN_TEXT), F.lower(c) == "true")


def to_timestamp(c: Column) -> Column:
    """timestamp_ntz for the formats listed above; month first where both readings are valid.

    Zoned texts become UTC wall-clock time. Two-digit years lie between 1969 and 2068.
    A month with a year is its first day. Texts that hold only a clock time or a bare
    number are rejected, as their date would depend on the day of the run.
    """
    text = F.regexp_replace(c, _WEEKDAY, "")

    def reordered(pattern: str, order: str) -> Column:
        return F.trim(F.regexp_replace(text, pattern, order))

    def cast(value: Column) -> Column:
        return value.try_cast("timestamp_ntz")

    def utc(value: Column) -> Column:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz"))

    short_names = F.lit("".join(m[:3] for m in MONTHS))

    def named(value: Column) -> Column:
        """"name year-#-day clock": # gives way to the number of the named month."""
        month = ((F.position(F.lower(F.substring(value, 1, 3)), short_names) + 2) / 3).cast("int").cast("string")
        return F.replace(F.regexp_replace(value, "^[A-Za-z]+ ", ""), F.lit("#"), month)

    def century(pattern: str, group: int) -> Column:
        year = F.regexp_extract(text, pattern, group)
        return F.concat(F.when(year.try_cast("int") >= CENTURY_TURN, "19").otherwise("20"), year)

    def short_year(order: str) -> Column:
        return cast(F.concat(century(_SHORT_YEAR, 3), F.lit("-"), reordered(_SHORT_YEAR, order)))

    def half_day(pattern: str, order: str, *formats: str) -> Column:
        value = F.upper(reordered(pattern, order))
        return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats]).cast("timestamp_ntz")

    mail_zone = F.regexp_replace(text, _MAIL_ZONE, "$6:$7")
    mail = F.concat(named(reordered(_MAIL_ZONE, "$2 $3-#-$1 $4")), F.when(mail_zone == ":", "Z").otherwise(mail_zone))
    return (
        F.when(text.rlike(_ISO), cast(F.trim(text)))
        .when(text.rlike(_ISO_ZONED), utc(F.trim(text)))
        .when(
            text.rlike(_YEAR_LAST),
            F.coalesce(cast(reordered(_YEAR_LAST, "$3-$1-$2 $4")), cast(reordered(_YEAR_LAST, "$3-$2-$1 $4"))),
        )
        .when(text.rlike(_YEAR_FIRST), cast(reordered(_YEAR_FIRST, "$1-$2-$3 $4")))
        .when(text.rlike(_COMPACT), cast(reordered(_COMPACT, "$1-$2-$3 $4")))
        .when(text.rlike(_COMPACT_CLOCK), cast(F.regexp_replace(reordered(_COMPACT_CLOCK, "$1-$2-$3 $4:$5:$6"), ":$", "")))
        .when(text.rlike(_DAY_NAME), cast(named(reordered(_DAY_NAME, "$2 $3-#-$1 $4"))))
        .when(text.rlike(_NAME_DAY), cast(named(reordered(_NAME_DAY, "$1 $3-#-$2 $4"))))
        .when(text.rlike(_MONTH_YEAR), cast(named(reordered(_MONTH_YEAR, "$1 $2-#-1"))))
        .when(text.rlike(_SHORT_YEAR), F.coalesce(short_year("$1-$2 $4"), short_year("$2-$1 $4")))
        .when(
            text.rlike(_SHORT_YEAR_NAMED),
            cast(F.replace(named(reordered(_SHORT_YEAR_NAMED, "$2 @-#-$1 $4")), F.lit("@"), century(_SHORT_YEAR_NAMED, 3))),
        )
        .when(text.rlike(_MAIL_ZONE), utc(mail))
        .when(text.rlike(_HALF_DAY), half_day(_HALF_DAY, "$1 $2 $3", "M/d/yyyy h:mm[:ss] a", "d/M/yyyy h:mm[:ss] a"))
        .when(text.rlike(_ISO_HALF_DAY), half_day(_ISO_HALF_DAY, "$1 $2 $3", "yyyy-M-d h:mm[:ss] a"))
    )
