"""Ordered operators whose tasks stay bounded when one key owns most rows.

``last(...) over (partition by source order by line)`` sends a whole source to one task.  Here rows are placed once, sorted
by range of (key, order), so that a large key lies in many places of about equal size, however sparse its ordinals are.
Windows run inside a place, and only one summary row per key and place is ordered per key: as many as there are partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.session import cut_lineage

#: The column that tells a row's place.
PLACE = "_place"
#: Ordinals in a block of neighbours: the size of the largest window there.
BLOCK = 65536


def place(df: DataFrame, keys: Sequence[str], order: Sequence[str], places: int | None = None) -> DataFrame:
    """The rows sorted by range of (keys, order) and written, with the number of the partition each lies in.

    A frame that has been placed only has what was added since written.  ``places`` is the number of partitions, the session's
    number of shuffle partitions unless given.
    """
    if PLACE in df.columns:
        return cut_lineage(df)
    columns = [*keys, *order]
    ranged = df.repartitionByRange(places, *columns) if places else df.repartitionByRange(*columns)
    return cut_lineage(ranged.sortWithinPartitions(*columns).withColumn(PLACE, F.spark_partition_id()))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys that also match where both are null; the keys of the left side stay."""
    rest = [c for c in right.columns if c not in keys]
    return left.withColumn("_jk", F.struct(*keys)).join(right.select(F.struct(*keys).alias("_jk"), *rest), "_jk", how).drop("_jk")


def _unit(keys: Sequence[str]) -> Column:
    """A row's key and place as one value: as a join key it is equal also where a key is null."""
    return F.struct(*keys, PLACE)


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], places: int | None = None) -> DataFrame:
    """Carry the last non-null value of each column down the rows of a key, null keys included.  A frame that was placed keeps its places."""
    keys, order, cols = list(keys), list(order), list(cols)
    placed = place(df, keys, order, places).withColumn("_u", _unit(keys))
    tails = placed.groupBy("_u").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_t_{c}") for c in cols])
    across = Window.partitionBy(*[f"_u.{k}" for k in keys]).orderBy(f"_u.{PLACE}").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_u", *[F.last(f"_t_{c}", ignorenulls=True).over(across).alias(f"_c_{c}") for c in cols])
    inside = Window.partitionBy("_u").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.select(*[c for c in placed.columns if c not in cols], *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in cols])
    out = filled.join(carry, "_u", "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def dense_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal", places: int | None = None) -> DataFrame:
    """Zero-based position of each row inside its key, a null key included, or in the whole frame without keys.  A frame that was placed keeps its places."""
    keys, order = list(keys), list(order)
    placed = place(df, keys, order, places).withColumn("_u", _unit(keys))
    counts = placed.groupBy("_u").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[f"_u.{k}" for k in keys]).orderBy(f"_u.{PLACE}").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_u", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_u").orderBy(*order)))
    return ranked.join(offsets, "_u").select(*df.columns, (F.col("_off") + F.col("_rn") - 1).cast("long").alias(name))


def switch_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], move: Column, ends: Callable[[Column], Column], places: int | None = None) -> DataFrame:
    """Run a switch, off at first, down the rows of each key; adds ``before``, ``group`` and ``ordinal``.

    ``move`` says what a row does to it: ``on``, ``off``, ``flip`` or null for nothing.  ``before`` is its state before the row,
    ``ends`` tells from that whether the row is the last of a group, ``group`` numbers these, ``ordinal`` all rows, both from 0.

    What the rows of a place do to the switch is a map from the state that enters to the one that leaves: a constant, the
    identity or the exchange of the two.  Such maps compose, and so do the counts of ends for either state; each place is
    one row of them per key, put together in order.  So a key's rows are read once, in as many places as they lie in.
    """
    keys, order = list(keys), list(order)
    placed = place(df, keys, order, places).withColumn("_u", _unit(keys)).withColumn("_m", move)
    inside = Window.partitionBy("_u").orderBy(*order)
    upto, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.coalesce(F.col("_m"), F.lit("")) == "flip").cast("long")
    counted = placed.withColumn("_f", F.sum(flip).over(upto)).withColumn("_fb", F.col("_f") - flip)
    fixed = F.when(F.col("_m").isin("on", "off"), F.struct((F.col("_m") == "on").alias("on"), F.col("_f").alias("at")))
    counted = counted.withColumn("_s", fixed).withColumn("_sb", F.last("_s", ignorenulls=True).over(ahead))

    def state(last: Column, flips: Column, enters: Column) -> Column:
        odd = lambda n: n % 2 == 1
        return F.when(last.isNull(), enters != odd(flips)).otherwise(last["on"] != odd(flips - last["at"]))

    for name, enters in (("0", False), ("1", True)):
        counted = counted.withColumn(f"_b{name}", state(F.col("_sb"), F.col("_fb"), F.lit(enters)))
        end = ends(F.col(f"_b{name}")).cast("long")
        counted = counted.withColumn(f"_e{name}", end).withColumn(f"_n{name}", F.coalesce(F.sum(end).over(ahead), F.lit(0)))
    counted = counted.withColumn("_rn", F.row_number().over(inside) - 1)
    latest = F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct(*order)))
    units = counted.groupBy("_u").agg(latest.alias("s"), F.sum(flip).alias("f"), F.sum("_e0").alias("e0"), F.sum("_e1").alias("e1"), F.count(F.lit(1)).alias("n"))
    # the same over places: one that fixes the state does so for good, the others flip it or leave it
    along = Window.partitionBy(*[f"_u.{k}" for k in keys]).orderBy(f"_u.{PLACE}")
    earlier, so_far = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("flips", F.sum("f").over(so_far))
    leaves = F.when(F.col("s").isNotNull(), F.struct((F.col("s.on") != ((F.col("f") - F.col("s.at")) % 2 == 1)).alias("on"), F.col("flips").alias("at")))
    units = units.withColumn("_leaves", leaves).withColumn("_entered", F.last("_leaves", ignorenulls=True).over(earlier))
    units = units.withColumn("_on", state(F.col("_entered"), F.col("flips") - F.col("f"), F.lit(False)))
    own = F.when(F.col("_on"), F.col("e1")).otherwise(F.col("e0"))
    units = units.withColumn("_own", own).select(
        "_u", "_on", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_ends"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_rows")
    )
    out = counted.join(units, "_u")
    pick = lambda c: F.when(F.col("_on"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    return out.select(*df.columns, pick("_b").alias("before"), (F.col("_ends") + pick("_n")).alias("group"), (F.col("_rows") + F.col("_rn")).cast("long").alias("ordinal"))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    exprs: dict[str, tuple[str, int]],
    size: int = BLOCK,
) -> DataFrame:
    """Add ``lag``/``lead`` columns over a dense ordinal; blocks carry a halo of their neighbours.

    ``exprs`` maps a new column to ``(column, offset)``; a negative offset looks back.
    """
    keys = list(keys)
    back = max([0, *[-o for _, o in exprs.values()]])
    ahead = max([0, *[o for _, o in exprs.values()]])
    home = F.floor(F.col(ordinal) / size).cast("long")
    pos = F.pmod(F.col(ordinal), F.lit(size))
    targets = F.array(
        home,
        F.when(pos >= size - back, home + 1) if back else F.lit(None).cast("long"),
        F.when(pos < ahead, home - 1) if ahead else F.lit(None).cast("long"),
    )
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(F.array_compact(targets)))
    w = Window.partitionBy(*keys, "_blk").orderBy(ordinal)
    for new, (col, off) in exprs.items():
        fn = F.lag(col, -off) if off < 0 else F.lead(col, off)
        spread = spread.withColumn(new, fn.over(w))
    return spread.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def within_distance(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    low: int,
    high: int,
) -> DataFrame:
    """Pairs of one key with ``low <= right_pos - left_pos <= high``, as an equi join on buckets.

    The right side is copied to at most ``ceil(width / bucket) + 1`` buckets, never to all of a key.
    """
    bucket = max(1, high - low + 1)
    l_side = left.withColumn("_bk", F.floor((F.col(left_pos) + low) / bucket).cast("long"))
    l_side = l_side.withColumn("_b", F.explode(F.array(F.col("_bk"), F.col("_bk") + 1))).withColumn("_bk", F.struct(*keys, "_b")).drop("_b")
    r_side = right.withColumn("_bk", F.struct(*keys, F.floor(F.col(right_pos) / bucket).cast("long").alias("_b"))).drop(*keys)
    joined = l_side.join(r_side, "_bk")
    gap = F.col(right_pos) - F.col(left_pos)
    return joined.where((gap >= low) & (gap <= high)).drop("_bk")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order``: an aggregate with map-side combine, not a window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key.  The filter on row_number limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
