"""Summaries of listings that roll up without the rows: counts, distinct addresses and price quantiles as stored sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.staging import stage

#: Sizes of the sketches: relative errors of about 1.04 / sqrt(2^LOG) of a distinct count, and about 1.4 % of a rank.
LOG, RANKS = 12, 200


def sketched(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """rows -> a row for each group of by: rows, values, their least and largest, and two sketches (HLL of distinct, KLL of value).

    Nulls in distinct or value are not counted by the sketches. The result is what is stored, a day at a time.
    """
    number = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count(number).alias("values"), F.min(number).alias("least"), F.max(number).alias("largest"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LOG)).alias("distinct_sketch"), F.kll_sketch_agg_double(number, F.lit(RANKS)).alias("value_sketch"),
    )


def rolled_up(stored: DataFrame, by: list[str], sets: list[list[str]]) -> DataFrame:
    """Stored sketches merged by each of these sets of columns: by (null if not in the set), level (the set's columns), and sketched()'s columns.

    Each set is one of the columns in by. Sums, extremes and sketches of groups are those of their rows, so a month
    comes from its days and the city from its districts, and no row is read again.
    """
    made = [
        F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    ]
    return _by_sets(stored, by, sets, made)


def _by_sets(rows: DataFrame, by: list[str], sets: list[list[str]], made: list[Column]) -> DataFrame:
    level = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in by)).alias("level")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by)).agg(level, *made)


def estimates(rolled: DataFrame, shares: list[float]) -> DataFrame:
    """rolled_up() with its sketches read: distinct (about), and q<percent> for each share; null where a group has no value."""

    def quantile(share: float) -> Column:
        return F.when(F.col("values") > 0, F.kll_sketch_get_quantile_double("value_sketch", F.lit(share))).alias(f"q{round(100 * share)}")

    return rolled.select("*", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *map(quantile, shares)).drop("distinct_sketch", "value_sketch")


def distinct_counts(rows: DataFrame, by: list[str], sets: list[list[str]], distinct: str) -> DataFrame:
    """The exact number of different non-null values of a column for each of these sets: by, level, distinct.

    Rows are first brought to one for each value and columns of by. Nothing but counts is grouped with the values: a sketch or
    quantiles beside them would be made anew for each value.
    """
    once = rows.select(*by, distinct).distinct()
    return _by_sets(once, by, sets, [F.countDistinct(distinct).alias("distinct")])


def shares(rows: DataFrame, by: list[str], sets: list[list[str]], marks: DataFrame, value: str, mark: str) -> DataFrame:
    """How many values of each group are below its mark and up to it: by, level, below, up_to.

    marks has a row for each group (by, level, mark), as rolled_up() names them, and is broadcast. The share of values
    below an estimated quantile tells how near it is, exactly and by counting only. Rows are gone through once, for all sets.
    """
    counts = []
    for k, s in enumerate(sets):
        own = marks.where(F.col("level") == _level(by, s)).select(*(F.col(c).alias(f"_{c}") for c in s), F.col(mark).alias(f"_mark{k}"))
        same = reduce(lambda found, c: found & F.col(c).eqNullSafe(F.col(f"_{c}")), s, F.lit(True))
        rows = rows.join(F.broadcast(own), same, "left").drop(*(f"_{c}" for c in s))
        counts += [F.count_if(F.col(value) < F.col(f"_mark{k}")).alias(f"below{k}"), F.count_if(F.col(value) <= F.col(f"_mark{k}")).alias(f"up_to{k}")]
    finest = stage(rows.groupBy(*by).agg(*counts), "shares")
    made = []
    for k, s in enumerate(sets):
        grouped = finest.groupBy(*s).agg(F.sum(f"below{k}").alias("below"), F.sum(f"up_to{k}").alias("up_to"))
        keys = [F.col(c) if c in s else F.lit(None).cast(finest.schema[c].dataType).alias(c) for c in by]
        made.append(grouped.select(*keys, F.lit(_level(by, s)).alias("level"), "below", "up_to"))
    return reduce(DataFrame.union, made)


def _level(by: list[str], own: list[str]) -> str:
    return ",".join(c for c in by if c in own)
