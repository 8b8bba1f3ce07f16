"""Pages, members, counts, cursors and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[str | Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """Always in an order, so that pages don't overlap."""
    return df.orderBy(*order).offset(skip).limit(limit)


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """An empty list gives no rows."""
    return df.where(F.col(column).isin(values)) if values else df.limit(0)


def id_range(df: DataFrame, column: str, after: int | Column, until: int | Column | None = None) -> DataFrame:
    """after < id <= until; without `until`, or with one that is not positive, there is no upper bound."""
    out = df.where(F.col(column) > after)
    if until is None or (isinstance(until, int) and until <= 0):
        return out
    return out.where(F.col(column) <= until)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the largest version for each key; one aggregate, partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sequence(df: DataFrame, key: str, order: str, name: str = "seq") -> DataFrame:
    """1-based place within the key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def members(links: DataFrame, people: DataFrame, group: str, person: str, name: str) -> DataFrame:
    """For each group its members as one ordered list. Join sides are left to the optimizer's sizes."""
    rows = links.join(people, person).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(person, name))).alias("members"))
    return rows


def participation(df: DataFrame, mine: DataFrame, key: str, name: str = "participating") -> DataFrame:
    own = mine.select(key).distinct().withColumn("_own", F.lit(True))
    return df.join(own, key, "left").withColumn(name, F.col("_own").isNotNull()).drop("_own")


def with_names(df: DataFrame, people: DataFrame, key: str, name: str, prefix: str = "person_") -> DataFrame:
    """A missing name becomes the prefix and the id."""
    return df.join(people.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(prefix), F.col(key).cast("string"))))


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The next snapshot: rows of the delta replace those of equal keys. Of a delta's rows of one key the last by `order`
    counts (columns of the delta, which need not be in the base), or without an order the greatest row. Write it to a
    new folder, never over the base."""
    rest = [c for c in base.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*(order or rest)))
    new = delta.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(new)


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids (a frame with the key), each once however often it is asked for; an id without a row gives none."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def any_of(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One whole row for each key: that of the least `by`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def first_seen(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "values") -> DataFrame:
    """For each key its distinct values, as a list in the order in which they came first."""
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias(name))


def mark(df: DataFrame, ids: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """A flag set on the rows of some ids (a frame with the key): soft deletes."""
    own = ids.select(key).distinct().withColumn("_own", F.lit(True))
    return df.join(own, key, "left").withColumn(column, F.when(F.col("_own"), F.lit(value)).otherwise(F.col(column))).select(df.columns)


def advance(base: DataFrame, delta: DataFrame, key: str, column: str) -> DataFrame:
    """A cursor moves forward only."""
    new = delta.groupBy(key).agg(F.max(column).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.greatest(column, "_new")).drop("_new")


def compare_and_set(base: DataFrame, condition: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The next snapshot and the number of rows that changed."""
    out = base.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})
    return out, base.agg(F.count_if(condition).alias("affected"))


def nested_semi(df: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """The rows of df that lead to a row of the last frame. Each step (frame, from, to) goes on from a column of what was
    reached, by `from`, to the rows of its frame with that value in `to`; e.g. observations, events, messages of a session."""
    wanted = None
    for k in range(len(steps) - 1, -1, -1):
        frame, source, target = steps[k]
        kept = frame if wanted is None else frame.join(wanted, wanted.columns[0], "left_semi")
        wanted = kept.select(F.col(target).alias(source)).distinct()
    return df if wanted is None else df.join(wanted, wanted.columns[0], "left_semi")


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table (frame, foreign key) without the rows of the deleted ids (column id)."""
    return {n: t.join(ids.select(F.col("id").alias(k)).distinct(), k, "left_anti") for n, (t, k) in tables.items()}


def remove_from_lists(df: DataFrame, column: str, value: int) -> DataFrame:
    """An id taken out of the JSON lists of a column."""
    return df.withColumn(column, F.to_json(F.array_remove(F.from_json(column, "array<bigint>"), F.lit(value).cast("long"))))
