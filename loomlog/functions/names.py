"""Event names, message identifiers and payload numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.scratch import free_name


def type_key(name: Column | str) -> Column:
    """Lower case, letters and digits only, without the digits at the end."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.lower(c), r"(?<![^\p{L}])[^\p{L}]++$|[^\p{L}\p{Nd}]++", "")


def with_event_type(events: DataFrame, types: DataFrame, name: str = "event_name", to: str = "event_type") -> DataFrame:
    """Add the event type that a spelling belongs to; null where none matches.

    A column of the name ``to`` that is there already is replaced.
    ``types`` is a dimension table; Catalyst broadcasts it if its size on disk
    is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    known = types.select(F.col("event_type").alias(to)).where(F.col(to).isNotNull()).distinct()
    events = events.drop(to)
    key = free_name(events, "_type_key")
    keyed = events.withColumn(key, type_key(name))
    return keyed.join(known, F.col(key) == F.col(to), "left").drop(key)


def uuid_key(text: Column | str) -> Column:
    """32 lower-case hex digits for any accepted text form of a UUID.

    Accepted, after trimming white space: hyphenated, 32 digits, hyphenated in
    braces, hyphenated after ``urn:uuid:``. Other texts stand for themselves
    (prefixed ``text:``), so equal texts still meet; null stays null.
    """
    c = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)^\s++|(?<!\s)\s++$", "")
    bare = F.when(F.length(c) == 45, F.regexp_replace(c, "^urn:uuid:", "")).when(
        (F.length(c) == 38) & c.startswith("{") & c.endswith("}"), F.substring(c, 2, 36)
    ).otherwise(c)
    digits = F.lower(F.when(bare.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.translate(bare, "-", "")).when(
        c.rlike("^[0-9A-Fa-f]{32}$"), c
    ))
    return F.coalesce(digits, F.concat(F.lit("text:"), c))


def payload_number(payload: Column | str, field: str = "amount") -> Column:
    """A number, or a quoted number, of a JSON payload as DECIMAL(28,6); else null.

    A payload that is empty, cut off, not UTF-8 or not JSON gives null. Decimals
    make sums independent of the order of rows.
    """
    c = F.col(payload) if isinstance(payload, str) else payload
    text = F.get_json_object(F.try_validate_utf8(c.cast("string")), f"$.{field}")
    return text.try_cast("decimal(28,6)")
