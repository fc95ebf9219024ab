"""Operators that hold when one key owns a large part of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions.identity import POINT_BITS, hash_point
from threadloom.session import materialize

# A group counts as large above 1/100,000 of all rows, so there are at most 100,000 large
# groups and 200,000 slices of them: the two tables broadcast below never outgrow that.
MAX_LARGE_GROUPS = 100_000
LARGE_GROUP_FLOOR = 100_000
PIECE_ROWS = 200_000  # rows of a key that one task scans


def first_per_key(rows, keys, order):
    """One row per key, the first in ``order``.

    ``row_number() = 1`` makes Spark keep one row per key before the shuffle as well, so
    copies of a hot key are thinned out where they are read.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(by_key)).filter("_rank = 1").drop("_rank")


def top_per_key(rows, keys, order, k):
    """The first ``k`` rows per key; at most ``k`` per key and map task are shuffled."""
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by_key)).filter(F.col("rank") <= k)


def left_join_many(left, right, key):
    """Left outer join whose right side may hold very many rows of one key.

    Adaptive execution splits a skewed right side for inner joins but not for left outer
    ones, so matched and unmatched rows are joined apart. ``key`` is the primary key of
    ``left``, unique and never null; saying so gives both joins the same shuffle of it.
    """
    left = left.filter(F.col(key).isNotNull())
    matched = left.join(right, key)
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def with_group_positions(rows, key, order_hash, tie, floor=LARGE_GROUP_FLOOR):
    """Add ``position`` (1, 2, ...) and ``groupRows`` within each group of ``key``.

    Rows are ordered by the hex digest ``order_hash``, then ``tie``. A large group is cut
    into slices of that order, each slice numbered in its own task and shifted by the row
    count of the slices before it, so the numbers are those of one window over the whole
    group. ``key`` must not be null. ``rows`` is read three times: pass a stored table.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size"))
    total = rows.agg(F.count("*")).scalar()
    limit = F.greatest(F.lit(floor), F.ceil(total / MAX_LARGE_GROUPS))
    large = sizes.filter(F.col("_size") > limit).withColumn(
        "_slices", F.ceil(F.col("_size") / limit)
    )
    sliced = rows.join(F.broadcast(large), key, "left").withColumn(
        "_slice",
        F.coalesce(
            F.shiftright(hash_point(F.col(order_hash)) * F.col("_slices"), POINT_BITS),
            F.lit(0),
        ),
    )
    before = (
        sliced.filter(F.col("_slices").isNotNull())
        .groupBy(key, "_slice")
        .agg(F.count("*").alias("_rows"))
        .select(
            key,
            "_slice",
            F.sum("_rows")
            .over(
                Window.partitionBy(key)
                .orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            .alias("_before"),
        )
    )
    whole = Window.partitionBy(key, "_slice")
    return (
        sliced.withColumn("_local", F.row_number().over(whole.orderBy(order_hash, tie)))
        .withColumn("_sliceRows", F.count("*").over(whole))
        .join(F.broadcast(before), [key, "_slice"], "left")
        .withColumn("position", F.col("_local") + F.coalesce("_before", F.lit(0)))
        .withColumn("groupRows", F.coalesce("_size", "_sliceRows"))
        .drop("_size", "_slices", "_slice", "_local", "_sliceRows", "_before")
    )


def chunk_rows(rows, key, order_hash, tie, size, floor=LARGE_GROUP_FLOOR):
    """Cut every group into consecutive runs of ``size`` rows: adds ``chunk`` and ``pos``."""
    numbered = with_group_positions(rows, key, order_hash, tie, floor)
    return numbered.withColumn("chunk", F.floor((F.col("position") - 1) / size)).withColumn(
        "pos", ((F.col("position") - 1) % size + 1).cast("int")
    )


def in_pieces(rows, keys, order, size=PIECE_ROWS):
    """``rows`` stored in pieces of about ``size`` rows: adds ``piece``.

    Pieces are ranges of (keys, order), so a key of any size is spread over as many pieces as
    it needs, and within a key a later piece holds later rows. Their limits come from a sample
    that Spark takes; a piece is off by a small share of its size.
    """
    stored = materialize(rows, "scan")
    count = max(1, -(-stored.count() // size))
    ranged = stored.repartitionByRange(count, *[F.col(c) for c in (*keys, *order)])
    return materialize(ranged.withColumn("piece", F.spark_partition_id()), "pieces")


def scan_pieces(pieces, keys, order, inside, across, backward=False):
    """A running value over each key's rows in ``order``, carried from piece to piece.

    ``inside`` and ``across`` map names to (column, aggregate): the aggregate runs over a
    piece's rows up to the current one, and over the results of the pieces before it (after it
    with ``backward``), which are one row a piece. Both are added, null where there is nothing.
    """
    turn = (lambda c: F.col(c).desc()) if backward else F.col
    within = Window.partitionBy(*keys, "piece").orderBy(*[turn(c) for c in order])
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(turn("piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole = pieces.groupBy(*keys, "piece").agg(*[function(column).alias(name) for name, (column, function) in across.items()])
    carried = whole.select(
        *keys, "piece", *[function(F.col(name)).over(before).alias(name) for name, (_, function) in across.items()]
    )
    local = pieces.withColumns({name: function(column).over(so_far) for name, (column, function) in inside.items()})
    return local.join(carried, [*keys, "piece"])
