"""Hashes, JSON, dates and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GAIN, DAY_FACTOR, FLOOR = 0.1, 0.98, 1e-6


def canonical_json(json: Column) -> Column:
    """JSON with the keys of all its objects in order, so that equal arguments have equal signatures: a variant keeps
    them sorted. Null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def tagged_payload(tag: Column, value: Column) -> Column:
    """A payload as JSON under its type tag."""
    return F.to_json(F.struct(tag.alias("type"), value.alias("data")))


def payload_of(json: Column, tag: str, schema: str) -> Column:
    """The data of a payload of this type; null for another type, and where it cannot be decoded."""
    p = payload(json, schema)
    return F.when(p["type"] == tag, p["data"])


def payload(json: Column, schema: str) -> Column:
    """type and data of a payload, parsed once where several types share a schema; null where it cannot be decoded."""
    return F.from_json(json, f"type string, data {schema}")


def day_relative(at: Column, now: Column, yesterday: str = "Yesterday") -> Column:
    """The time for today's, Yesterday and the time for the day before, else date and time."""
    time = F.date_format(at, "HH:mm:ss")
    days = F.datediff(now, at)
    return F.when(days == 0, time).when(days == 1, F.concat(F.lit(yesterday + " "), time)).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def signature(name: Column, json: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, canonical_json(json)), 256)


def id_list(json: Column) -> Column:
    """Ids of a JSON array; what is no id is dropped."""
    return F.filter(F.transform(F.from_json(json, "array<string>"), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def recovered(energy: Column, days: Column, step: int = 100, most: int = 200) -> Column:
    return F.when(days > 0, F.least(F.lit(most), energy + step * days)).otherwise(energy)


def backoff_minutes(n: Column, first: int = 30, most: int = 360, shifts: int = 8) -> Column:
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.least(F.greatest(n - 1, F.lit(0)), F.lit(shifts)))).cast("int")


def gained(importance: Column) -> Column:
    return importance + F.lit(GAIN) * (F.lit(1.0) - importance)


def decayed(importance: Column, days: Column) -> Column:
    """importance * 0.98 a day while it is above the floor."""
    steps = F.ceil(F.log(F.lit(FLOOR) / importance) / F.lit(math.log(DAY_FACTOR)))
    return F.when(importance <= FLOOR, importance).otherwise(importance * F.pow(F.lit(DAY_FACTOR), F.least(F.greatest(days, F.lit(0)), F.greatest(steps, F.lit(0))).cast("double")))


def composite_score(similarity: Column, importance: Column, days: Column) -> Column:
    return F.when(importance > 0, 0.7 * similarity + 0.2 * importance + 0.1 / (1 + days))


def version_key(version: Column, parts: int = 3) -> Column:
    """Comparable numbers; a missing part is 0."""
    numbers = F.split(F.regexp_replace(version, "^v", ""), r"\.")
    return F.array(*[F.coalesce(F.get(numbers, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(parts)])


def age(seconds: Column) -> Column:
    day = 86400
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < day, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .when(seconds < 30 * day, F.concat(F.floor(seconds / day).cast("string"), F.lit("d")))
        .when(seconds < 360 * day, F.concat(F.floor(seconds / (30 * day)).cast("string"), F.lit("mo")))
        .otherwise(F.concat(F.floor(seconds / (360 * day)).cast("string"), F.lit("y")))
    )


def future_timestamp(text: Column, now: Column) -> Column:
    """A timestamp in the one layout that is accepted; null if it has another or lies in the past."""
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(at > now, at)
