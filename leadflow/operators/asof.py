"""As-of joins: the last event of a key before each row, in ranges of time.

Both sides are put together, sorted by time within ranges, and the last event is carried forward; what stands at the end of a range is
carried over its border from a table of one row per key and range. A range with many rows is dealt over ``salts`` tasks, each with a copy of
the range's few events. Nothing is listed by day, and no row meets more than one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def fill_forward(rows: DataFrame, events: DataFrame, by: list[str], values: list[str], width: int = 30 * DAY, salts: int = 4) -> DataFrame:
    """``rows`` with the last non-null of each of ``values`` among the events of the same ``by`` before them.

    Both sides have ``_t`` (microseconds) and ``_o`` (order at the same time). Nulls are a key like others; rows before the first event have
    nulls."""
    keep = [c for c in rows.columns if c not in (*by, "_t", "_o")]
    range_of = F.floor(F.col("_t") / F.lit(width)).cast("long").alias("_range")
    null = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if not dict(rows.dtypes)[c].startswith("map")]), F.lit(salts)).cast("int").alias("_salt")
    one = rows.select(*by, "_t", "_o", range_of, spread, F.struct(*keep).alias("_row"), *[null(events, v) for v in values])
    many = events.select(*by, "_t", "_o", range_of, F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("_salt"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), *values)
    inside = Window.partitionBy(*by, "_range", "_salt").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = one.unionByName(many).select("*", *[F.last(v, True).over(inside).alias(f"_in_{v}") for v in values]).filter("_row IS NOT NULL")
    at = F.struct("_t", "_o")
    ends = (events.withColumn("_range", range_of).groupBy(*by, "_range").agg(*[F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values])
            .unionByName(rows.select(*by, range_of).distinct(), allowMissingColumns=True).groupBy(*by, "_range").agg(*[F.max(v).alias(v) for v in values]))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(b).alias(f"_of_{b}") for b in (*by, "_range")], *[F.last(v, True).over(before).alias(f"_over_{v}") for v in values])
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in (*by, "_range")]
    return filled.join(carried, same, "left").select(*by, "_t", "_o", "_row.*", *[F.coalesce(f"_in_{v}", f"_over_{v}").alias(v) for v in values])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], strict: bool = False, width: int = 30 * DAY, salts: int = 4) -> DataFrame:
    """Every row of ``left`` with ``take`` from the last row of ``right`` of its key at or before its time (before it, if ``strict``).

    Of several rows of a key at one time the greatest counts. Rows without a time, or without an earlier row on the right, get nulls."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = right.filter(F.col(right_time).isNotNull()).groupBy(*by, micros(right_time).alias("_t")).agg(F.max(F.struct(*take)).alias("_hit")).withColumn("_o", F.lit(1))
    dated = left.withColumn("_t", micros(left_time)).withColumn("_o", F.lit(0 if strict else 2))
    out = fill_forward(dated.filter("_t IS NOT NULL"), events, by, ["_hit"], width, salts)
    taken = [F.col(f"_hit.{c}").alias(c) for c in take]
    undated = dated.filter("_t IS NULL").select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return out.select(*left.columns, *taken).unionByName(undated)


def prev_weekday(day: Column) -> Column:
    """The last weekday before a day."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))
