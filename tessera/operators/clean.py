"""Projection, filtering, repair and profiling operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.parse import parse_py_list


def select_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """B1: keep and rename columns (``{old: new}``), in mapping order."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def filter_equal(df: DataFrame, col: str, value) -> DataFrame:
    """B2: typed equality filter (the literal takes the column's type, so the
    predicate can be pushed to the scan)."""
    dtype = dict(df.dtypes)[col]
    return df.filter(F.col(col) == F.lit(value).cast(dtype))


def replace_values(df: DataFrame, col: str, mapping: Mapping | DataFrame,
                   key: str = "old", value: str = "new") -> DataFrame:
    """Replace values of ``col`` by a mapping, others unchanged.

    A small Python mapping becomes one CASE expression (no join). A mapping
    DataFrame ``(old, new)`` is left-joined; AQE broadcasts it when it is
    small, otherwise it is an ordinary shuffle join.
    """
    if isinstance(mapping, Mapping):
        expr: Column | None = None
        for old, new in mapping.items():
            cond = F.col(col) == F.lit(old)
            expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
        if expr is None:
            return df
        return df.withColumn(col, expr.otherwise(F.col(col)).cast(dict(df.dtypes)[col]))
    m = mapping.select(F.col(key).alias("__old"), F.col(value).alias("__new"))
    return (df.join(m, F.col(col) == F.col("__old"), "left")
            .withColumn(col, F.coalesce(F.col("__new"), F.col(col)))
            .drop("__old", "__new"))


def missing_keys(probe: DataFrame, reference: DataFrame, col: str) -> DataFrame:
    """G1: distinct values of ``col`` in ``probe`` absent from ``reference``
    (EXCEPT DISTINCT as a left-anti join of the two distinct projections)."""
    return probe.select(col).distinct().join(reference.select(col).distinct(), col, "left_anti")


def pick_known_items(ratings: DataFrame, wanted: DataFrame, salt: str = "pick",
                     user: str = "user_id", item: str = "item_id") -> DataFrame:
    """For each ``(user, n)`` in ``wanted``, the user's first ``n`` rated
    items in a salted-hash order. Returns ``(user, pick, item)`` with
    ``pick`` in 1..n.

    The per-user rank uses ``row_number() <= n_max``, which Spark plans as a
    partial window-group limit before the shuffle, so a user with a huge
    history contributes only ``n_max`` rows per task.
    """
    n_max = wanted.agg(F.max("n")).collect()[0][0] or 0
    if n_max == 0:
        return ratings.sparkSession.createDataFrame([], f"{user} bigint, pick int, {item} bigint")
    h = F.md5(F.concat_ws("|", F.lit(salt), F.col(user).cast("string"), F.col(item).cast("string")))
    w = Window.partitionBy(user).orderBy(h, item)
    ranked = (ratings.join(wanted.select(user).distinct(), user, "left_semi")
              .select(user, item, F.row_number().over(w).alias("pick"))
              .filter(F.col("pick") <= n_max))
    return ranked.join(wanted, user).filter(F.col("pick") <= F.col("n")).select(user, "pick", item)


def repair_unknown(pairs: DataFrame, ratings: DataFrame, salt: str = "pick",
                   user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Replace items of ``pairs`` that never occur in ``ratings``.

    Each unknown item is owned by the smallest id among the users asking for
    it that have training ratings; that user's unknown items (in item order) take that user's known items in
    salted-hash order (B4); the replacement then applies to every row with
    the item, whoever the user (as in the reference). Unknown items without
    such a user, or whose owner has too few known items, stay as they are.
    """
    unknown = missing_keys(pairs, ratings, item)
    raters = ratings.select(user).distinct()
    owners = (pairs.join(unknown, item, "left_semi").join(raters, user, "left_semi")
              .groupBy(item).agg(F.min(user).alias(user)))
    # one row an unknown item; read for the wanted numbers, the picks and the mapping
    ranked = owners.withColumn("pick", F.row_number().over(Window.partitionBy(user).orderBy(item))).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = ranked.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    picks = pick_known_items(ratings, wanted, salt, user, item)
    mapping = (ranked.join(picks.withColumnRenamed(item, "new"), [user, "pick"])
               .select(F.col(item).alias("old"), "new"))
    return replace_values(pairs, item, mapping)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (of the given) column(s)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def null_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """``(column, null_pct)`` = round(100 * nulls / rows, 2), half-even.

    One aggregate pass over the data, then an unpivot of the single result row.
    """
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"__n{i}") for i, c in enumerate(cols)])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("nulls"))
                                  for i, c in enumerate(cols)]))
    return (agg.select("__rows", stacked.alias("s"))
            .select(F.col("s.column").alias("column"),
                    F.bround(100.0 * F.col("s.nulls") / F.col("__rows"), digits).alias("null_pct")))


def column_info(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, non_null, rows)`` in one aggregate pass."""
    types = dict(df.dtypes)
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(cols)])
    stacked = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"),
                                           F.lit(types[c]).alias("dtype"), F.col(f"__c{i}").alias("non_null"))
                                  for i, c in enumerate(cols)]))
    return agg.select("rows", stacked.alias("s")).select("s.position", "s.column", "s.dtype", "s.non_null", "rows")


def coerce_numeric(df: DataFrame, col: str, to: str = "double") -> DataFrame:
    """Text to number, null where the text is not a number."""
    return df.withColumn(col, F.col(col).try_cast(to))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order (``row_number() = 1``, planned
    as a window-group limit that keeps one row per key per task before the
    shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def flag_malformed(df: DataFrame, col: str, schema: str = "array<struct<iso_3166_1:string,name:string>>",
                   flag: str = "parsed_ok") -> DataFrame:
    """Parse a list-of-dict text column; rows that do not parse keep their
    text and get ``parsed_ok = false``."""
    parsed = parse_py_list(col, schema)
    return df.withColumn("__parsed", parsed).withColumn(flag, F.col("__parsed").isNotNull()).drop("__parsed")


def distinct_tokens(tokens: str | Column) -> Column:
    """Set of a document's tokens (first occurrence order)."""
    return F.array_distinct(F.col(tokens) if isinstance(tokens, str) else tokens)
