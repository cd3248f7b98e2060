"""Values of filter columns: strict numbers, dates and times, canonical texts. Columns unless said otherwise."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = re.compile(r"-?[0-9]+")
NUMBER = re.compile(r"-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
OFFSET = re.compile(r"([+-])([01][0-9]):([0-5][0-9])")
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = "([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?"
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def integer(text: str, kind: T.DataType | None = None) -> int | None:
    """A Python number from ASCII digits with at most a minus before them, if it lies in the type's range (a long's by default)."""
    if not INTEGER.fullmatch(text):
        return None
    half = 1 << (BITS.get(type(kind), 64) - 1)
    return int(text) if -half <= int(text) < half else None


def number(text: str) -> float | None:
    """A Python float from decimal digits, with a point and an exponent if need be; no infinities, no NaN."""
    value = float(text) if NUMBER.fullmatch(text) else None
    return value if value is not None and abs(value) != float("inf") else None


def decimal(text: str, kind: T.DecimalType) -> Decimal | None:
    """A Python decimal that the type can hold; it isn't rounded."""
    if not NUMBER.fullmatch(text):
        return None
    value = Decimal(text)
    fits = value == round(value, kind.scale) and abs(value) < Decimal(10) ** (kind.precision - kind.scale)
    return value if fits else None


def offset_seconds(offset: str) -> int:
    """Of "+09:00" and the like, 14 hours at most."""
    m = OFFSET.fullmatch(offset)
    if not m or (seconds := int(m[2]) * 3600 + int(m[3]) * 60) > 14 * 3600:
        raise ValueError(f"no offset from UTC: {offset}")
    return -seconds if m[1] == "-" else seconds


def epoch(text: Column, offset: str = "+00:00") -> Column:
    """Seconds since 1970 of "YYYY-MM-DD", with "HH:MM:SS" and a fraction after a space or T if need be, or of seconds themselves; else null."""
    day = F.expr("date '1970-01-01'")
    when = F.when(text.rlike(DATE), F.datediff(F.substring(text, 1, 10).try_cast("date"), day))
    clock = F.when(text.rlike(f"{DATE}[ T]{CLOCK}$"), _seconds(F.substring(text, 12, 8))).when(text.rlike(f"{DATE}$"), F.lit(0))
    return F.coalesce(when * 86400 + clock - offset_seconds(offset), F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")))


def _seconds(clock: Column) -> Column:
    parts = [F.split_part(clock, F.lit(":"), F.lit(k)).try_cast("long") for k in (1, 2, 3)]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def time_seconds(text: Column) -> Column:
    """Seconds of a duration "[-]H:MM:SS" of at most 838 hours, its fraction cut off; else null."""
    ok = text.rlike("^-?[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?$")
    plain = F.regexp_replace(text, "^-|[.][0-9]+$", "")
    total = F.when(ok & (F.split_part(plain, F.lit(":"), F.lit(1)).try_cast("int") <= 838), _seconds(plain))
    return F.when(text.startswith("-"), -total).otherwise(total)


def typed(text: Column, kind: str, offset: str = "+00:00") -> Column:
    """A text as a filter value of a type (int, bigint, double, boolean, string, datetime, time, decimal(p,s)); null where it is none.

    Texts that aren't such a number are null, never rounded or trimmed.
    """
    if kind == "string":
        return text
    if kind in ("datetime", "timestamp", "date"):
        return epoch(text, offset)
    if kind == "time":
        return time_seconds(text)
    if kind == "boolean":
        return F.when(text.isNotNull(), text.isin("1", "true"))
    pattern = NUMBER.pattern if kind.startswith(("double", "float", "decimal")) else INTEGER.pattern
    return F.when(text.rlike(f"^(?:{pattern})$"), text.try_cast(kind))


def canonical(text: Column, kind: str) -> Column:
    """One text for each value: bytes that aren't UTF-8 replaced, fractions of seconds of six digits, decimals without leading zeros, no minus zero."""
    if kind == "string":
        return F.make_valid_utf8(text)
    if kind == "datetime":
        fraction = F.coalesce(F.nullif(F.regexp_extract(text, "[.]([0-9]+)$", 1), F.lit("")), F.lit(""))
        return F.concat(F.regexp_replace(text, "[.][0-9]*$", ""), F.lit("."), F.rpad(fraction, 6, "0"))
    if kind == "decimal":
        plain = F.regexp_replace(text, "^(-?)0+(?=[0-9])", "$1")
        return F.when(plain.rlike("^-0([.]0*)?$"), F.substring(plain, 2, 64)).otherwise(plain)
    value = text.try_cast("double")
    return F.when(value == 0, F.lit("0")).otherwise(value.cast("string"))


def like(text: Column, pattern: str) -> Column:
    """% and _ as in SQL, in any case."""
    return text.ilike(pattern)


def shown_bytes(n: int) -> str:
    """A number of bytes for people."""
    size, units = float(n), ["B", "KB", "MB", "GB", "TB"]
    while size >= 1024 and len(units) > 1:
        size, units = size / 1024, units[1:]
    return f"{n}B" if units[0] == "B" else f"{size:.2f}{units[0]}"
