"""Joins along time: the last known row before a moment, and pairs of periods that overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthframe.operators.joins import HOT, join_split, small_side
from hearthframe.staging import stage, tidy

#: Rows of one key, at least, whose time is cut into stretches.
MANY = 50_000
#: Rows of one key whose periods are compared with each other at once.
FEW = 256


def _cuts(events: DataFrame, keys: list[str], many: int) -> DataFrame:
    """(keys, _cuts): for each key of more than many rows, and of more than HOT of all, moments that part its rows about evenly."""
    counts = stage(events.groupBy(*keys).agg(F.count("*").alias("n")), "counts")
    found = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    most = max(many, int((found.n or 0) * HOT))
    if (found.most or 0) <= most:
        return stage(counts.select(*keys, F.array().cast("array<double>").alias("_cuts")).limit(0), "cuts")
    shares = [k / -(-found.most // most) for k in range(1, -(-found.most // most))]
    hot = F.broadcast(counts.where(F.col("n") > most).select(*keys))
    return stage(events.join(hot, keys).groupBy(*keys).agg(F.percentile_approx("_ticks", shares, 10_000).alias("_cuts")), "cuts")


def _ticks(time: Column, kind: str) -> Column:
    """A moment as a double, for cutting time only."""
    return (F.unix_micros(time.cast("timestamp")) if kind.startswith(("date", "timestamp")) else time).cast("double")


def _same(keys: list[str]) -> str:
    return " AND ".join(f"`{k}` IS NOT NULL" for k in keys)


@tidy
def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, many: int = MANY) -> DataFrame:
    """left with the other columns of the last row of right that has the same keys and isn't later than left_time.

    Columns of right must be named otherwise than those of left, but for keys. Of several last rows of one moment the
    greatest by its other columns is taken. Rows without such a row, or with a null key or time, get nulls; repeated
    rows of left stay.

    Both sides become one sequence of events, in which the last value is carried on. The events of a key with very many
    are cut into stretches of time, each of which is carried through by itself; what a stretch begins with is the
    last value of those before it, one row for each. So no key is one task, but events of one key and one moment
    stay together.
    """
    kind, names = dict(left.dtypes)[left_time], [c for c in right.columns if c not in keys]
    row, value = left.schema, right.select(*names).schema
    given = [F.lit(None).cast(row).alias("_row"), F.struct(*names).alias("_value")]
    known = right.where(f"{_same(keys)} AND `{right_time}` IS NOT NULL").select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_asks"), *given)
    asked = left.where(f"{_same(keys)} AND `{left_time}` IS NOT NULL").select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_asks"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(value).alias("_value"))
    events = known.union(asked).withColumn("_ticks", _ticks(F.col("_time"), kind))
    cuts = _cuts(events.select(*keys, "_ticks"), keys, many)
    part = F.coalesce(F.aggregate("_cuts", F.lit(0), lambda n, cut: n + (cut < F.col("_ticks")).cast("int")), F.lit(0))
    events = events.join(F.broadcast(cuts), keys, "left").withColumn("_part", part)
    order = Window.partitionBy(*keys, "_part").orderBy("_time", "_asks", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = events.withColumn("_last", F.last("_value", ignorenulls=True).over(order))
    # what the stretches before hold last; only cut keys have any
    ends = events.join(F.broadcast(cuts.select(*keys)), keys, "left_semi").where("_asks = 0").groupBy(*keys, "_part").agg(F.max(F.struct("_time", "_value")).alias("_end"))
    seen = stage(ends, "ends")
    parts = seen.select(*keys).distinct().join(F.broadcast(cuts), keys).select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.join(seen, [*keys, "_part"], "left").withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(*keys, "_part", F.col("_before._value").alias("_before"))
    found = carried.where("_asks = 1").join(F.broadcast(before), [*keys, "_part"], "left").select("_row.*", F.coalesce("_last", "_before").alias("_value"))
    nothing = left.where(f"NOT ({_same(keys)} AND `{left_time}` IS NOT NULL)").withColumn("_value", F.lit(None).cast(value))
    return found.union(nothing).select(*left.columns, *(F.col(f"_value.`{n}`").alias(n) for n in names))


def _laid(rows: DataFrame, begin: str, end: str, levels: list[int] | None) -> DataFrame:
    """rows with the cells of the lattice that each period lies in: at its own level, and at those of levels above it.

    A cell of level L is 2^L long, and a period's own level is the least at which it lies in two cells at most.
    """
    size = F.col(end) - F.col(begin)
    own = F.greatest(F.ceil(F.log2(size.cast("double"))), F.lit(-40)).cast("int")
    out = rows.withColumn("_own", own)
    if levels is None:
        return out
    at = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    out = out.withColumn("_level", F.explode(F.array_distinct(F.concat(F.array("_own"), F.filter(at, lambda x: x > F.col("_own"))))))
    cell = lambda c: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level")))
    return out.withColumn("_cell", F.explode(F.sequence(cell(begin), cell(end))))


@tidy
def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_period: tuple[str, str], b_period: tuple[str, str], few: int = FEW) -> DataFrame:
    """Pairs of rows of a and b with the same keys whose periods [begin, end) overlap, each once; columns of a, then those of b.

    Columns must differ in name but for keys. Begins and ends are whole numbers or doubles (days, seconds). Periods
    that end before they begin or are empty, and null keys or ends, meet nothing; repeated rows meet as often as they are there.

    A period lies in at most two cells of its own level of a lattice, whatever its length, and at each coarser level
    that the other side uses. A pair meets at the coarser of its own two levels, and counts in the cell in which the
    overlap begins. Crowded cells are dealt out over tasks. Keys of at most few rows, on both sides together, need no lattice.
    """
    held = []
    for rows, (begin, end), name in ((a, a_period, "_a"), (b, b_period, "_b")):
        fine = rows.where(f"{_same(keys)} AND `{begin}` < `{end}`")
        held.append(fine.select(*keys, F.col(begin).alias(f"{name}0"), F.col(end).alias(f"{name}1"), F.struct(*rows.columns).alias(name)))
    # a key of few rows is joined as it is: its rows are shuffled once, and not once for each cell
    every = held[0].select(*keys).union(held[1].select(*keys))
    crowded = stage(every.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*keys), "crowded")
    meet = (F.col("_a0") < F.col("_b1")) & (F.col("_b0") < F.col("_a1"))
    columns = ["_a.*", *(F.col(f"_b.`{c}`").alias(c) for c in b.columns if c not in keys)]
    if crowded.isEmpty():
        return held[0].join(held[1], keys).where(meet).select(*columns)
    small = small_side(crowded, written=True)
    direct = held[0].join(small, keys, "left_anti").join(held[1].join(small, keys, "left_anti"), keys).where(meet).select(*columns)
    held = [h.join(small, keys, "left_semi") for h in held]
    levels = [sorted(r[0] for r in _laid(h, f"{n}0", f"{n}1", None).select("_own").distinct().collect()) for h, n in zip(held, ("_a", "_b"), strict=True)]
    laid = [_laid(h, f"{n}0", f"{n}1", other).withColumnRenamed("_own", f"{n}_own") for h, n, other in zip(held, ("_a", "_b"), levels[::-1], strict=True)]
    met = join_split(laid[0], stage(laid[1], "periods"), [*keys, "_level", "_cell"], "_a")
    same = (F.greatest("_a_own", "_b_own") == F.col("_level")) & meet
    once = F.floor(F.greatest("_a0", "_b0").cast("double") / F.pow(F.lit(2.0), F.col("_level"))) == F.col("_cell")
    return direct.union(met.where(same & once).select(*columns))


# --- differences of dated snapshots -------------------------------------------------------------------

#: Ranges of keys, by a hash, whose digests are compared; each group of them has a digest of its own.
RANGES, GROUPS = 4_096, 64


def keep_snapshot(df: DataFrame, keys: list[str], path: str, ranges: int = RANGES) -> None:
    """Writes a snapshot in ranges of its keys' hashes below path/rows, with the digest of each range below path/digests.

    A digest is the number of rows and two sums of hashes of them, so it doesn't depend on their order and knows repeated rows.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")
    df.withColumn("_range", at).repartition(F.col("_range")).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    rows = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(f"{path}/rows")
    # halves of 32 bits: sums can't overflow
    whole, other = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    sums = [F.sum(F.shiftright(h, s).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"s{k}{s}") for k, h in enumerate((whole, other)) for s in (0, 32)]
    made = rows.groupBy(F.col("_range").alias("range")).agg(F.count("*").alias("n"), *sums)
    made.select("range", F.xxhash64("n", "s00", "s032").alias("a"), F.xxhash64("n", "s10", "s132").alias("b")).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def unequal_ranges(spark, old: str, new: str) -> list[int]:
    """The ranges in which two kept snapshots differ: groups of ranges first, and ranges only of unequal groups."""
    x, y = (spark.read.parquet(f"{p}/digests") for p in (old, new))
    group = F.pmod("range", F.lit(GROUPS)).alias("group")
    tops = [d.groupBy(group).agg(F.bit_xor(F.xxhash64("range", "a", "b")).alias("d")) for d in (x, y)]
    apart = tops[0].join(tops[1].withColumnRenamed("d", "e"), "group", "full").where("NOT d <=> e").select("group")
    left, right = (d.withColumn("group", group).join(F.broadcast(apart), "group", "left_semi").drop("group") for d in (x, y))
    both = left.join(right.toDF("range", "c", "d"), "range", "full").where("NOT (a <=> c AND b <=> d)")
    return sorted(r.range for r in both.select("range").collect())


@tidy
def snapshot_changes(spark, old: str, new: str, keys: list[str]) -> DataFrame:
    """What became of a kept snapshot: keys, change, fields, n, and old and new as the rows themselves.

    change is changed, where a key is on both sides with one unequal row each (fields names what is unequal); else gone or
    new, for every row that one side has n times more often than the other, as EXCEPT ALL counts. Equal ranges aren't
    read. Nulls are equal to nulls. Both sides must have the same columns.
    """
    at = unequal_ranges(spark, old, new)
    held = [[r.range for r in spark.read.parquet(f"{p}/digests").where(F.col("range").isin(at)).select("range").collect()] for p in (old, new)]
    kinds = spark.read.parquet(f"{old}/schema").schema
    sides = [spark.read.schema(kinds).parquet(*(f"{p}/rows/_range={k}" for k in own)) if own else spark.createDataFrame([], kinds) for p, own in zip((old, new), held, strict=True)]
    names = kinds.names
    each = reduce(DataFrame.union, (s.withColumn("_by", F.lit(k)) for s, k in zip(sides, (-1, 1), strict=True)))
    # rows as often as one side has more of them
    surplus = each.groupBy(*names).agg(F.sum("_by").alias("_more")).where("_more <> 0")
    surplus = stage(surplus.select(*keys, F.col("_more"), F.struct(*names).alias("_row")), "surplus")
    by_key = surplus.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("_more").alias("_sum"), F.max(F.abs("_more")).alias("_most"), F.max(F.when(F.col("_more") < 0, F.col("_row"))).alias("_old"), F.max(F.when(F.col("_more") > 0, F.col("_row"))).alias("_new"))
    pairs = stage(by_key.where("_rows = 2 AND _sum = 0 AND _most = 1"), "pairs")
    fields = F.filter(F.array(*(F.when(~F.col(f"_old.`{n}`").eqNullSafe(F.col(f"_new.`{n}`")), F.lit(n)) for n in names if n not in keys)), lambda x: x.isNotNull())
    changed = pairs.select(*keys, F.lit("changed").alias("change"), fields.alias("fields"), F.lit(1).cast("long").alias("n"), F.col("_old").alias("old"), F.col("_new").alias("new"))
    own = pairs.select(*(F.col(k).alias(f"_{k}") for k in keys))
    rest = surplus.join(own, reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys[1:], F.col(keys[0]).eqNullSafe(F.col(f"_{keys[0]}"))), "left_anti")
    one = rest.select(*keys, F.when(F.col("_more") < 0, F.lit("gone")).otherwise(F.lit("new")).alias("change"), F.array().cast("array<string>").alias("fields"), F.abs("_more").alias("n"), F.when(F.col("_more") < 0, F.col("_row")).alias("old"), F.when(F.col("_more") > 0, F.col("_row")).alias("new"))
    return changed.union(one)
