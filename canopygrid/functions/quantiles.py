"""Exact grouped percentiles that survive hot groups and very many groups.

``binned`` selects by histograms: counts per bin, combined before their
shuffle, name the bins that hold a wanted rank, two per percentile and group at
most. The rows are then read once more and only those of these bins are
shuffled. With more than one number in ``bins`` this is repeated: the wanted
bins are divided again, and only their rows counted, before values move.

Which rows lie in wanted bins tells a table of bits addressed by hash, the only
thing that is broadcast: ``MARKS`` bits, however many groups there are. Bits that
meet by chance let a few rows more through, which the join with the wanted bins
then drops; that join sees what was let through and no other row. Nothing is
collected, and nothing runs before the result is asked for. Equal values are
counted before they move and rows spread over (group, bin, value), so a group
holding a large share of all rows is worked on by every executor.

Strata that contain each other share one histogram: rows carry the finest part
they belong to, counts of parts add up to those of the strata, and a row moves
once however many strata it counts for.

A bin should hold few distinct values: ratios of whole raw numbers below 10,000
take at most some 400,000 different values in 1/1024 of [-1, 1]. For other data
choose ``value_range`` and ``bins`` so that a bin stays a small part of a group.

``hash`` is Spark's own ``percentile``: one shuffle and one read, but it keeps
all distinct values of a group in one task's memory. Use it for groups known to
be small.

Both interpolate linearly between the neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = (1024,)
# Bits of the table that is broadcast, 64 to a row: 262,144 rows at most.
MARKS = 1 << 24
PART, STRATUM = "__part", "stratum"


def percentile_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def _enough(n: Column, minimum: int, inclusive: bool) -> Column:
    return n >= minimum if inclusive else n > minimum


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number that never falls as the value grows; outliers share the end bins."""
    place = (value - F.lit(low)) * F.lit(bins / (high - low))
    return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(bins - 1.0))).cast("int")


def _place(columns: Sequence[str]) -> tuple[Column, Column]:
    """Row of the table of bits, and bit in it."""
    at = F.xxhash64(*columns).bitwiseAND(F.lit(MARKS - 1))
    return F.shiftright(at, 6).alias("__word"), at.bitwiseAND(F.lit(63)).cast("int")


def marked(rows: DataFrame, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` occur in ``wanted``, and by chance some others; rows themselves are not shuffled."""
    word, bit = _place(columns)
    table = wanted.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__one"))
    table = table.groupBy("__word").agg(F.bit_or("__one").alias("__bits"))
    held = rows.withColumn("__word", word).join(F.broadcast(table), "__word")
    return held.filter(F.getbit("__bits", bit) == 1).drop("__word", "__bits")


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    percentiles: Sequence[float] = (95, 99, 100),
    *,
    min_count: int = 1,
    inclusive: bool = True,
    method: str = "binned",
    value_range: tuple[float, float] = (-1.0, 1.0),
    bins: Sequence[int] = BINS,
    part: str | None = None,
    strata: Mapping[str, Sequence[str] | None] | None = None,
) -> DataFrame:
    """Columns ``keys``, ``n`` and one ``pNN`` per percentile.

    Null and NaN values are left out. Groups with fewer than ``min_count``
    values (or not more, when not ``inclusive``) are dropped. ``value_range``
    only spreads the bins; values outside it are still ranked exactly.

    ``strata`` names sets of values of the column ``part`` (null for all of
    them), and a column ``stratum`` comes behind the keys: each row counts in
    every stratum that its part belongs to.
    """
    if method not in ("binned", "hash"):
        raise ValueError(f"unknown method {method!r}")
    v = F.col(value).cast("double")
    # One key column that is never null. All uses of the rows then plan the
    # same, with no null test inferred for one of them only, and share what
    # exchanges lie below.
    key = F.struct(*keys) if keys else F.struct(F.lit(1))
    own = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    rows = df.select(key.alias("__key"), own.alias(PART), v.alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    out_keys = [F.col("__key")[k].alias(k) for k in keys] + ([F.col(STRATUM)] if strata else [])
    # Taken from an aggregate, the keys let no later filter through to one use of the rows alone.
    # Filter cells before, not percentiles after.
    group = ["__key", STRATUM] if strata else ["__key"]

    def opened(counts: DataFrame) -> DataFrame:
        """Counts of parts as counts of the strata they belong to."""
        if not strata:
            return counts.drop(PART)
        names = [
            F.lit(name) if parts is None else F.when(F.col(PART).isin(*parts), F.lit(name)) for name, parts in strata.items()
        ]
        spread = counts.withColumn(STRATUM, F.explode(F.array_compact(F.array(*names)))).drop(PART)
        return spread.groupBy(*[c for c in spread.columns if c != "__c"]).agg(F.sum("__c").alias("__c"))

    def parts_of(wanted: DataFrame) -> DataFrame:
        """Wanted bins by the parts whose rows fall in them."""
        if not strata:
            return wanted.withColumn(PART, F.lit(""))
        every = [p for parts in strata.values() for p in parts or ()]
        named = F.create_map(*[x for n, ps in strata.items() if ps is not None for x in (F.lit(n), F.array(*map(F.lit, ps)))])
        # A stratum of all parts is marked by the empty part as well, for those that no other names.
        everything = F.array(*map(F.lit, dict.fromkeys([*every, ""])))
        parts = F.coalesce(F.try_element_at(named, F.col(STRATUM)), everything) if every else everything
        return wanted.withColumn(PART, F.explode(parts))

    if method == "hash":
        if strata:
            names = [F.lit(n) if ps is None else F.when(F.col(PART).isin(*ps), F.lit(n)) for n, ps in strata.items()]
            rows = rows.withColumn(STRATUM, F.explode(F.array_compact(F.array(*names))))
        out = rows.groupBy(*group).agg(
            F.count("*").alias("n"), F.percentile("__v", [p / 100.0 for p in percentiles]).alias("__p")
        )
        return out.filter(_enough(F.col("n"), min_count, inclusive)).select(
            *out_keys, "n", *[F.col("__p")[i].alias(percentile_name(p)) for i, p in enumerate(percentiles)]
        )

    if strata:
        known = [p for parts in strata.values() for p in parts or ()]
        named = F.when(F.col(PART).isin(*known), F.col(PART)).otherwise(F.lit("")) if known else F.lit("")
        rows = rows.withColumn(PART, named)
    finest = prod(bins)
    fine = F.coalesce(bin_of(F.col("__v"), *value_range, finest), F.lit(0))
    rows = rows.withColumn("__fine", fine)
    places = [(F.col("n") - 1) * F.lit(p / 100.0) for p in percentiles]

    def holds(rank: Column, start: Column, end: Column) -> Column:
        return (rank >= start) & (rank < end)

    ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
    wanted_rank = reduce(lambda a, b: a | b, [holds(rank, F.col("__before"), F.col("__to")) for rank in ranks])

    wanted, width = None, finest
    for size in bins:
        parent = width
        width //= size
        number = lambda w: F.floor(F.col("__fine") / w).cast("int")
        if wanted is None:
            counts = rows.withColumn("__bin", number(width)).groupBy("__key", PART, "__bin").agg(F.count("*").alias("__c"))
            counts = opened(counts).withColumn("__before", F.lit(0).cast("long"))
            within = group
            counts = counts.withColumn("n", F.sum("__c").over(Window.partitionBy(*group)))
            counts = counts.filter(_enough(F.col("n"), min_count, inclusive))
        else:
            near = marked(rows.withColumn("__up", number(parent)), parts_of(wanted), ["__key", PART, "__up"])
            counts = near.withColumn("__bin", number(width)).groupBy("__key", PART, "__up", "__bin").agg(F.count("*").alias("__c"))
            counts = opened(counts).join(wanted, [*group, "__up"])
            within = [*group, "__up"]
        running = Window.partitionBy(*within).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wanted = (
            counts.withColumn("__to", F.col("__before") + F.sum("__c").over(running))
            .withColumn("__before", F.col("__to") - F.col("__c"))
            .filter(wanted_rank)
            .select(*group, F.col("__bin").alias("__up"), "__before", "n")
        )

    near = marked(rows.withColumn("__up", F.col("__fine")), parts_of(wanted), ["__key", PART, "__up"])
    counted = near.groupBy("__key", PART, "__up", "__v").agg(F.count("*").alias("__c"))
    in_bin = (
        Window.partitionBy(*group, "__up").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        opened(counted)
        .join(wanted, [*group, "__up"])
        .withColumn("__end", F.col("__before") + F.sum("__c").over(in_bin))
        .withColumn("__start", F.col("__end") - F.col("__c"))
    )
    picks = []
    for i, place in enumerate(places):
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = holds(rank, F.col("__start"), F.col("__end"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{i}"))
    picked = ranked.groupBy(*group).agg(F.first("__key").alias("__held"), F.max("n").alias("n"), *picks)

    def between(i: int, place: Column) -> Column:
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # Equal ends also when infinite.
        return F.when(low == high, low).otherwise(low + (place - F.floor(place)) * (high - low))

    out = [
        between(i, place).alias(percentile_name(p))
        for i, (p, place) in enumerate(zip(percentiles, places))
    ]
    held = [F.col("__held")[k].alias(k) for k in keys] + ([F.col(STRATUM)] if strata else [])
    return picked.select(*held, "n", *out)
