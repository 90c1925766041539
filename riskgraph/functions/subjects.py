"""Subject values: normalisation, classification, ids, reporters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import WS, ascii_lower, col, digits, non_empty, strip
from .fixed_values import SUBJECT_TYPES


def normalize_subject(value, subject_type) -> Column:
    """phone: digits; bank: no white space; url: no trailing '/', ASCII lower; else trimmed."""
    v, t = col(value), col(subject_type)
    return (
        F.when(t == "phone", digits(v))
        .when(t == "bank", F.regexp_replace(v, WS, ""))
        .when(t == "url", ascii_lower(F.regexp_replace(strip(v), "/+$", "")))
        .otherwise(strip(v))
    )


def normalize_subject_crawl(value, subject_type) -> Column:
    """As above, but a bank account keeps its digits only."""
    v, t = col(value), col(subject_type)
    return F.when(t.isin("phone", "bank"), digits(v)).otherwise(strip(v))


def classify_value(value) -> Column:
    """url / phone / bank by prefix and digit count, NULL when none fits."""
    v = col(value)
    d = digits(v)
    n = F.length(d)
    return (
        F.when(v.startswith("http://") | v.startswith("https://"), "url")
        .when(n.between(10, 12) & (d.startswith("0") | d.startswith("84")), "phone")
        .when(n.between(8, 20), "bank")
    )


def infer_subject_type(value) -> Column:
    d = digits(value)
    return F.when((F.length(d) >= 9) & d.startswith("0"), "phone").otherwise("bank")


def parse_mention(value) -> Column:
    """'phone:…' / 'bank:…' -> (type, value); anything else keeps the whole text."""
    v = col(value)
    prefix = F.regexp_extract(v, "(?s)^(phone|bank):", 1)
    known = prefix != ""
    return F.struct(
        F.when(known, prefix).otherwise(infer_subject_type(v)).alias("subject_type"),
        F.when(known, F.regexp_replace(v, "^(phone|bank):", "")).otherwise(v).alias("value"),
    )


def default_subject_type(subject_type) -> Column:
    return F.coalesce(col(subject_type), F.lit("phone"))


def valid_subject_type(subject_type) -> Column:
    return F.coalesce(col(subject_type).isin(SUBJECT_TYPES), F.lit(False))


def subject_id(subject_type, value) -> Column:
    """Deterministic id, so that an upsert can be repeated."""
    return F.sha2(F.concat_ws("|", col(subject_type), col(value)), 256)


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


def combined_hash(hashes) -> Column:
    """One hash for a set of hashes, independent of their order."""
    return F.sha2(F.array_join(F.array_sort(col(hashes)), "|"), 256)


def trusted_peer(peer) -> Column:
    """Loopback or private IPv4, or IPv6 loopback."""
    p = col(peer)
    return p.rlike(r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | (p == "::1")


def reporter_address(peer, forwarded) -> Column:
    """First forwarded entry when the peer is a trusted proxy, else the peer."""
    first = non_empty(strip(F.split_part(col(forwarded), F.lit(","), F.lit(1))))
    return F.when(trusted_peer(peer), F.coalesce(first, col(peer))).otherwise(col(peer))


def plain_number_query(query) -> Column:
    q = strip(query)
    return F.when(q.rlike("^[0-9]{8,}$"), F.array(q)).otherwise(
        F.array().cast("array<string>")
    )
