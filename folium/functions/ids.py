"""Identifiers and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"


def sha256(*parts: Column) -> Column:
    """SHA-256 (hex) of the parts joined by the unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of a row as JSON; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def is_sha256_hex(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9a-f]{64}$"))


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes in hex. Two 32-bit halves keep every product within a long; the prime is 2**40 + 435."""
    hx = F.hex(F.encode(text, "UTF-8"))
    octets = F.filter(F.split(hx, "(?<=\\G..)"), lambda x: x != "")
    values = F.transform(octets, lambda x: F.conv(x, 16, 10).cast("bigint"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    mask = F.lit(0xFFFFFFFF)

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        high = acc["hi"] * 435 + F.shiftrightunsigned(x * 435, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), (x * 435).bitwiseAND(mask).alias("lo"))

    half = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.aggregate(values, start, step, lambda acc: F.lower(F.concat(half(acc["hi"]), half(acc["lo"]))))


def stable_id(namespace: Column, value: Column) -> Column:
    """``seed-`` and the FNV-1a hash of namespace, NUL and value."""
    return F.concat(F.lit("seed-"), fnv1a64(F.concat(namespace, F.lit("\x00"), value)))


def ordinal(label: Column) -> Column:
    """``[para-3]`` and ``paragraph-3`` become ``para-3``; anything else, and number 0, is null."""
    n = F.regexp_extract(F.trim(label), r"^\[?(?:para|paragraph)-(\d{1,9})\]?$", 1)
    return F.when((n != "") & (F.try_to_number(n, F.lit("999999999")) > 0), F.concat(F.lit("para-"), F.regexp_replace(n, "^0+", "")))


def file_stem(title: Column, index: Column | None = None) -> Column:
    """Letters and digits with underscores between; ``index`` puts a three-digit number before."""
    stem = F.regexp_replace(F.regexp_replace(title, r"[^\p{IsAlphabetic}\p{N}]+", "_"), "^_+|_+$", "")
    return stem if index is None else F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("-"), stem)


# Fields whose names tell that they hold text or secrets, and marks of secrets in a value.
SENSITIVE_FIELDS = ("text", "content", "manuscript", "translation", "api_key", "token", "secret")
SECRET_MARKS = ("sk-", "api_key", "secret", "token")


def sanitize_label(label: Column) -> Column:
    """ASCII letters, digits, underscores and hyphens, 64 at most."""
    return F.left(F.regexp_replace(label, r"[^A-Za-z0-9_-]", ""), F.lit(64))


def _holds_any(value: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])


def is_sensitive_field(name: Column) -> Column:
    """Whether a field of this name may not go into telemetry."""
    return _holds_any(name, SENSITIVE_FIELDS)


def looks_secret(text: Column) -> Column:
    return _holds_any(text, SECRET_MARKS)


def confidence(evidence: Column) -> Column:
    return F.when(evidence >= 5, "high").when(evidence >= 2, "moderate").otherwise("low")
