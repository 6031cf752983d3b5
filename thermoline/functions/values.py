"""Tolerant parsing of numbers, times and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


LARGEST_DOUBLE = 1.7976931348623157e308


def finite(number: Column) -> Column:
    """The double, or null for NaN and infinities."""
    return F.when((number >= -LARGEST_DOUBLE) & (number <= LARGEST_DOUBLE), number)


def to_number(value: Column, default: float | None) -> Column:
    """Double, or `default` where the text is missing or no finite number."""
    text = F.trim(value.cast("string"))
    # Java also reads "1d" and "1f" as numbers; those are not.
    number = F.when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), text.try_cast("double"))
    known = finite(number)
    return known if default is None else F.coalesce(known, F.lit(float(default)))


def to_decimal(number: Column, kind: DecimalType) -> Column:
    """Rounded decimal. A number beyond the type's range is no value of it: null."""
    return number.try_cast(kind)


def parse_timestamp(value: Column) -> Column:
    """UTC timestamp from ISO text: with `T` or blank, fraction, `Z`, offset, or date only
    (midnight). Null for anything else. Needs the session time zone UTC."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d|$)"), text.try_cast("timestamp"))


def machine_number(machine_id: Column) -> Column:
    """Number after the three-character prefix: leading digits, none → 0. A number that is too
    long for a bigint is the largest one, and so out of any range."""
    digits = F.regexp_extract(F.substr(machine_id, F.lit(4)), r"^\s*0*([0-9]+)", 1)
    number = F.when(digits == "", F.lit(0)).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(2 ** 63 - 1)))
    return F.when(machine_id.isNotNull(), number)


def hash_id(*parts: Column) -> Column:
    """Repeatable id for a reading that came without one."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def hash_bucket(key: Column, buckets: int, seed: int) -> Column:
    """Uniform bucket 0..buckets-1 of a key; the same on every run and partitioning."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"),
                  F.lit(buckets)).cast("int")
