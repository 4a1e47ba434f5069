"""Ranking, quantiles and running totals that never put an unbounded group into one task.

A window that orders one whole group, or an exact percentile that keeps all values of a group in one buffer, stops
scaling when a key holds a large share of the rows. The helpers here first count (map-side combined), then order only
bounded pieces: value bins, time slices or range partitions.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.session import cut_lineage

BINS_PER_OCTAVE = 512
RADIX_BITS = (26, 50)  # leading bits by which values are counted, round by round; a round has at most 2^26 counters
SLICE_ROWS = 200_000  # rows of one key that a window orders at once


def with_scalars(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """The fields of a one-row frame as a struct column on each row: one scalar subquery however often it is used."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns).alias("s")).scalar())


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet; the key columns are the left side's.

    No not-null filters are inferred, so a frame that feeds both sides keeps one common plan and its shuffle is reused.
    """
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def value_bin(c: Column) -> Column:
    """Order-preserving bin of equal relative width at any magnitude: zero is bin 0, the least double is in bin 1.

    A value range that doubles spans ``BINS_PER_OCTAVE`` bins, be it around a million or a millionth.
    """
    v = c.cast("double")
    octaves = F.floor((F.log2(F.abs(v)) + 1075) * BINS_PER_OCTAVE) + 1
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * octaves)


def ordered_bits(c: Column) -> Column:
    """The bits of a double as a whole number that is ordered as the doubles are; both zeros are 0, NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double")).cast("bigint")
    return F.when(c.cast("double") < 0, -bits.bitwiseAND(F.lit((1 << 63) - 1))).when(c.cast("double") == 0, F.lit(0)).otherwise(bits)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per group: (keys, prob, value), by radix selection.

    Equal values are counted first, in one pass over the frame; all rounds read that shuffle. Each round counts by some
    more leading bits and keeps the values whose bits hold a wanted rank. After the last round a group of equal leading bits
    has at most 2^14 different values, so ordering them is bounded however dense the values are.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_bits", ordered_bits(F.col("_v")))
    held = (lambda left, right, on: join_null_safe(left, right, [*keys, on])) if keys else (
        lambda left, right, on: left.join(F.broadcast(right), on))  # a row per probability and side
    found = None
    for length in RADIX_BITS:
        prefix = f"_p{length}"
        rows = rows.withColumn(prefix, F.shiftright("_bits", 64 - length))
        counted = rows.groupBy(*keys, *([] if found is None else [last]), prefix).agg(F.sum("_n").alias("_in"))
        group = W.partitionBy(*keys, *([] if found is None else [last]))
        placed = counted.withColumn("_first", F.coalesce(F.sum("_in").over(group.orderBy(prefix).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        if found is None:
            ranks = (
                placed.withColumn("_all", F.sum("_in").over(group))
                .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
                .withColumn("_pos", F.col("prob") * (F.col("_all") - 1))
                .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
            )
            before = F.col("_first")
        else:
            ranks = held(placed, found, last)
            before = F.col("_before") + F.col("_first")
        found = ranks.where((before <= F.col("_rank")) & (F.col("_rank") < before + F.col("_in"))).select(
            *keys, prefix, "prob", "_pos", "_rank", before.alias("_before"))
        rows = held(rows, found.select(*keys, prefix).distinct(), prefix)
        last = prefix
    each = rows.groupBy(*keys, last, "_v").agg(F.sum("_n").alias("_n"))
    inside = W.partitionBy(*keys, last).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ends = held(each.withColumn("_end", F.sum("_n").over(inside)), found, last)
    start = F.col("_before") + F.col("_end") - F.col("_n")
    hit = ends.where((start <= F.col("_rank")) & (F.col("_rank") < start + F.col("_n")))
    low, high = F.min("_v"), F.max("_v")
    return hit.groupBy(*keys, "prob", "_pos").agg(
        (low + (F.col("_pos") - F.floor("_pos")) * (high - low)).alias("value")).select(*keys, "prob", "value")


def wide_percentiles(df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, float]) -> DataFrame:
    """Percentiles as one named column each."""
    long = percentiles(df, keys, value, list(names.values()))
    picks = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in names.items()]
    return long.groupBy(*keys).agg(*picks)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, measures: Mapping[str, str], *,
                   descending: bool = False, bin_of: Column | None = None) -> DataFrame:
    """Running totals in two levels: totals of bins first, then rows inside one bin.

    ``measures`` maps new column to summed column. ``order`` must be unique per group (count first).
    """
    keys = list(keys)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    binned = df.withColumn("_bin", value_bin(F.col(order)) if bin_of is None else bin_of)
    earlier = W.partitionBy(*keys).orderBy(way("_bin")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(f"_sum_{new}") for new, m in measures.items()])
        .select(*keys, "_bin", *[F.coalesce(F.sum(f"_sum_{new}").over(earlier), F.lit(0)).alias(f"_off_{new}")
                                 for new in measures])
    )
    inside = W.partitionBy(*keys, "_bin").orderBy(way(order)).rowsBetween(W.unboundedPreceding, 0)
    return (
        join_null_safe(binned, offsets, [*keys, "_bin"])
        .withColumns({new: F.col(f"_off_{new}") + F.sum(m).over(inside) for new, m in measures.items()})
        .drop("_bin", *[f"_off_{new}" for new in measures])
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", total: str = "total") -> DataFrame:
    """1-based rank over the whole frame and the row count, from a distributed sort.

    Range partitions are sorted by themselves and written once (checkpoint), so that the partition sizes and the rows
    read later belong to the same split. The offsets frame has one row per partition.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_size").over(W.partitionBy()).alias(total))
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inner + 1).drop("_part", "_at", "_before")
    )


def cut_rows(df: DataFrame, order: Sequence[str], ranks: Callable[[int], Sequence[int]], small: int = SLICE_ROWS, splits: int = 64) -> DataFrame:
    """The rows at some 1-based ranks of the order over these columns, as one row of structs ``cut0``, ``cut1``, …

    ``ranks`` gives the wanted ranks from the row count. Selection instead of a sort: rows of the range that holds a rank
    are counted between splitters drawn from that range, and the range shrinks to one gap, round by round, until it has at
    most ``small`` rows. A splitter that holds the rank ends it at once, so equal rows do no harm. The jobs run here;
    ``splits`` rows and their counts come to the driver per round, and of the frame only the columns of the order are kept
    meanwhile. An empty frame gives NULLs.
    """
    spark = df.sparkSession
    slim = df.select(*order).persist()
    row = F.struct(*order)

    def as_scalar(rows: list) -> Column:
        listed = spark.createDataFrame(rows, slim.schema).agg(F.array_sort(F.collect_list(row)).alias("a"))
        return listed.scalar()

    def found(rank: int):
        low = high = None   # the rank lies strictly between these rows
        before, size = 0, count
        while True:
            inside = slim
            if low is not None:
                inside = inside.where(row > F.get(as_scalar([low]), 0))
            if high is not None:
                inside = inside.where(row < F.get(as_scalar([high]), 0))
            if size <= small:
                numbered = inside.withColumn("_r", F.row_number().over(W.orderBy(*order)))
                return numbered.where(F.col("_r") == rank - before).drop("_r").first()
            drawn = inside.orderBy(F.xxhash64(*order), *order).limit(splits).distinct().orderBy(*order).collect()
            place = F.size(F.filter("_marks", lambda m: m < row)) + F.size(F.filter("_marks", lambda m: m <= row))
            marked = inside.withColumn("_marks", as_scalar(drawn))
            for at, n in sorted(marked.groupBy(place.alias("at")).count().collect()):
                if rank <= before + n:
                    break
                before += n
            if at % 2:
                return drawn[at // 2]
            low, high, size = drawn[at // 2 - 1] if at else low, drawn[at // 2] if at // 2 < len(drawn) else high, n

    count = slim.count()
    cuts = [found(r) for r in ranks(count)] if count else []
    slim.unpersist()
    if not count:
        return spark.range(1).select(*[F.lit(None).alias(f"cut{i}") for i, _ in enumerate(ranks(0))])
    return spark.range(1).select(*[F.get(as_scalar([c]), 0).alias(f"cut{i}") for i, c in enumerate(cuts)])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. The rank filter is applied before the shuffle too (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """The k most frequent values of each group as an array; equal counts go by value."""
    ranked = top_per_key(value_counts(df, keys, value), keys, [F.col("n").desc(), F.col(value).asc()], k, "_rank")
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda s: s["v"]).alias(name))


def heaviest_value(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, smallest on ties, as one combinable aggregate."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))
    return value_counts(df, keys, value).groupBy(*keys).agg(best["v"].alias(name), (-best["m"]).alias(f"{name}_count"))


def time_slices(df: DataFrame, key: str, stamp: str, order: Sequence[str], look_back: int,
                slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, list[str]]:
    """Cut the rows of each key into slices of whole hours with about ``slice_rows`` rows: (frame, partition columns).

    Most keys have one slice. A later slice also gets copies (``_copy``) of the ``look_back`` rows before it, so any
    window of that many preceding rows is exact for every key alike. Rows without time come first, in one hour of their
    own; a NULL key is a key. Drop the copies with ``own_rows`` after the window.
    """
    columns = list(df.columns)
    hourly = df.withColumn("_hour", F.date_trunc("hour", stamp))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_hour").rowsBetween(W.unboundedPreceding, -1))
    slices = hourly.groupBy(key, "_hour").agg(F.count("*").alias("_n")).select(
        key, "_hour", F.floor(F.coalesce(before, F.lit(0)) / slice_rows).alias("_slice"))
    slices = slices.withColumn("_split", F.max("_slice").over(W.partitionBy(key)) > 0)
    marked = join_null_safe(hourly, slices, [key, "_hour"])
    row = F.struct(*order, *[c for c in columns if c not in order])
    tails = (
        top_per_key(marked.where("_split"), [key, "_slice"], [F.col(c).desc() for c in order], look_back, "_r")
        .groupBy(key, "_slice").agg(F.collect_list(row).alias("_tail"))
    )
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(-look_back, -1)
    carried = tails.select("_slice", F.slice(F.reverse(F.array_sort(
        F.flatten(F.collect_list("_tail").over(earlier)))), 1, look_back).alias("_rows"))
    copies = carried.select("_slice", F.explode("_rows").alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns], "_slice", F.lit(True).alias("_copy"))
    return marked.select(*columns, "_slice", F.lit(False).alias("_copy")).unionByName(copies), [key, "_slice"]


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_copy")).drop("_copy", "_slice")
