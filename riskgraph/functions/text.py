"""Text expressions: cutting, signatures, screens, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .base import (
    ascii_lower, col, collapse, contains_any_folded, digits, literal_pattern, lookup, non_empty,
    strip,
)


def collapse_truncate(c, n: int) -> Column:
    """Collapse white space, keep the first n characters, mark a cut with '...'."""
    c = col(c)
    # the start decides alone if it has more than n characters; the rest of a long text isn't looked at
    start, whole = collapse(F.substring(c, 1, 2 * n)), collapse(c)

    def cut(t: Column) -> Column:
        return F.concat(F.substring(t, 1, n), F.lit("..."))

    return (F.when(F.length(start) > n, cut(start)).when(F.length(c) <= 2 * n, start)
            .when(F.length(whole) > n, cut(whole)).otherwise(whole))


def truncate(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def text_signature(c, n: int = 24) -> Column:
    """First n runs of ASCII letters and digits; everything else separates."""
    c = col(c)

    def words(t: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(ascii_lower(t), "[^a-z0-9]+", " ")), " ")

    # with one word more behind them, the first n of the start are whole
    start = words(F.substring(c, 1, 32 * n))
    found = F.when((F.length(c) <= 32 * n) | (F.size(start) > n), start).otherwise(words(c))
    return F.array_join(F.slice(found, 1, n), " ")


def is_schema_leak(c) -> Column:
    # nothing but white space is empty once stripped; the markers have none at their ends
    return ~col(c).rlike(r"(?U)\S") | contains_any_folded(c, V.SCHEMA_FIELD_MARKERS)


def has_technical_noise(c) -> Column:
    return contains_any_folded(c, V.TECHNICAL_MARKERS)


def clean_text(c) -> Column:
    return collapse(c)


def normalize_org(c) -> Column:
    """Drop the impersonation prefix; NULL when nothing is left."""
    t = clean_text(c)
    return non_empty(
        strip(
            F.when(t.startswith(V.ORG_PREFIX), F.substring(t, len(V.ORG_PREFIX) + 1, 2**31 - 1))
            .otherwise(col(c))
        )
    )


def is_known_org(c) -> Column:
    t = strip(c)
    return F.coalesce((t != "") & (t != V.ORG_UNKNOWN), F.lit(False))


def slugify(c) -> Column:
    t = F.regexp_replace(F.lower(col(c)), r"[^\p{IsAlphabetic}\p{N}]", "-")
    return F.replace(F.regexp_replace(t, "^-+|-+$", ""), F.lit("--"), F.lit("-"))


def digits_to_number(c) -> Column:
    return F.coalesce(digits(c).try_cast("bigint"), F.lit(0))


def strip_embedded_noise(c) -> Column:
    """Cut at the first script or JSON marker, then trim white space, ',' and '.'."""
    head = F.regexp_replace(col(c), "(?s)(" + literal_pattern(V.EMBEDDED_NOISE_MARKERS) + ").*", "")
    return F.regexp_replace(head, r"(?U)^[\s,.]+|[\s,.]+$", "")


def _numeric_entity(part: Column) -> Column:
    """Text after '&#': decode a leading code, keep the rest."""
    hexa = F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,6});", 1)
    deci = F.regexp_extract(part, "^([0-9]{1,7});", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("int")
    ok = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    rest = F.regexp_replace(part, "^[xX]?[0-9a-fA-F]+;", "")
    return F.when(ok, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))


def decode_entities(c) -> Column:
    """Six named entities, then numeric ones (decimal and hexadecimal)."""
    t = col(c)
    for name, value in V.HTML_NAMED_ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(value))
    parts = F.split(t, "&#")
    decoded = F.concat(
        F.element_at(parts, 1),
        F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _numeric_entity), ""),
    )
    return F.when(F.instr(t, "&#") > 0, decoded).otherwise(t)


def parse_verdict_footer(markdown) -> Column:
    """First 'RISK_LEVEL: ' and 'CONFIDENCE: ' lines; neither is validated."""
    md = col(markdown)
    has_level = md.rlike("(?m)^RISK_LEVEL: ")
    level = F.when(has_level, strip(F.regexp_extract(md, "(?m)^RISK_LEVEL: (.*)$", 1)))
    conf = strip(F.regexp_extract(md, "(?m)^CONFIDENCE: (.*)$", 1)).try_cast("double")
    return F.struct(
        F.coalesce(level, F.lit("unknown")).alias("level"),
        F.coalesce(conf, F.lit(0.5)).alias("confidence"),
    )


def strip_footer(markdown) -> Column:
    """Drop the footer lines, turn two bold labels into headings, squeeze blank lines."""
    t = F.regexp_replace(col(markdown), r"(?imU)^\s*(RISK_LEVEL|CONFIDENCE)\s*:\s*.+$", "")
    t = F.regexp_replace(t, r"(?imu)^\*\*(Kết luận|Khuyến nghị):\*\*[ \t]*(\S.*?)[ \t]*$", "## $1\n$2")
    t = F.regexp_replace(t, r"(?imu)^\*\*(Kết luận|Khuyến nghị):\*\*[ \t]*$", "## $1")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def carrier(c) -> Column:
    found = F.regexp_extract(col(c), "(" + "|".join(V.CARRIERS) + ")", 1)
    return F.coalesce(non_empty(found), F.lit("Unknown"))


def incident_fields(text) -> Column:
    """Captures of one incident post; the quick summary wins over single labels."""
    t = col(text)

    def capture(pattern: str, group: int = 1) -> Column:
        return strip(F.regexp_extract(t, pattern, group))

    # the summary's lazy pattern is only tried on the few texts that can hold one
    summarised = t.contains(V.QUICK_SUMMARY_START)

    def first(group: int, pattern: str, dots: bool = False) -> Column:
        quick = F.when(summarised, capture(V.QUICK_SUMMARY, group)).otherwise(F.lit(""))
        single = capture(pattern)
        if dots:
            quick = F.regexp_replace(quick, r"^\.+|\.+$", "")
            single = F.regexp_replace(single, r"^\.+|\.+$", "")
        return F.coalesce(non_empty(quick), non_empty(single))

    return F.struct(
        first(1, V.OWNER_PATTERN, dots=True).alias("owner"),
        first(2, V.PHONE_PATTERN).alias("phone"),
        first(3, V.ACCOUNT_PATTERN).alias("account"),
        first(4, V.BANK_PATTERN).alias("bank"),
        first(5, V.WARNING_PATTERN).alias("warning"),
        non_empty(F.regexp_extract(t, V.COUNT_PATTERN, 1)).alias("report_count"),
    )


def risk_label(level) -> Column:
    return lookup(level, V.RISK_LABELS, V.RISK_LABEL_UNKNOWN)


def query_label(query_type) -> Column:
    return lookup(query_type, V.QUERY_LABELS)


def confidence_text(confidence) -> Column:
    c = col(confidence)
    percent = F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))
    out = F.lit(V.CONFIDENCE_TEXT_LOW)
    for bound, text in reversed(V.CONFIDENCE_TEXTS):
        out = F.when(c >= bound, F.lit(text)).otherwise(out)
    return F.replace(out, F.lit("%s"), percent)


def join_or_none(items) -> Column:
    c = col(items)
    return F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise(F.lit(V.NOTHING))
