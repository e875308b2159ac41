"""Ordered work over one key without ever sorting that key in one task.

A transcript is an ordered sequence, so neighbours, running totals and runs are
naturally ``Window.partitionBy(video_id).orderBy(pos)``. That plan puts a whole
recording into one task, and one recording may hold a large share of the table.
Here every ordered step is cut into *blocks* of consecutive positions:

* the block is a pure function of the row (``pos div size``), so a retried or
  speculated task always sees the same rows;
* each (key, block) is sorted on its own, bounded by ``size`` rows;
* what crosses a block edge travels either as halo rows (a neighbour's copy) or
  as one carry row per block, which is ``size`` times smaller than the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16


def block_of(pos: str, size: int = BLOCK_ROWS) -> Column:
    """The block number of an integer position."""
    return F.expr(f"{pos} div {size}")


def with_halo(
    df: DataFrame,
    pos: str,
    *,
    before: int = 0,
    after: int = 0,
    size: int = BLOCK_ROWS,
    block: str = "block",
) -> DataFrame:
    """Give each row its block, and copy rows near an edge to the next block.

    ``before`` rows preceding a block and ``after`` rows following it become
    visible inside it. Copies are recognised by ``pos div size <> block``.
    """
    home = f"{pos} div {size}"
    places = [home]
    if before:
        places.append(f"if({pos} % {size} >= {size - before}, {home} + 1, null)")
    if after:
        places.append(f"if({pos} % {size} < {after} and {pos} >= {size}, {home} - 1, null)")
    return df.withColumn(
        block, F.explode(F.expr(f"array_compact(array({', '.join(places)}))"))
    )


def with_neighbours(
    df: DataFrame,
    key: str,
    pos: str,
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    beyond: int = 0,
    size: int = BLOCK_ROWS,
    block: str = "block",
) -> DataFrame:
    """Add columns of the row before / after, by dense integer position.

    ``previous`` and ``following`` map a new column name to a source expression.
    ``beyond`` rows after its end stay visible in each block, complete with their
    neighbours, for work that looks further ahead. The output is hash partitioned
    on (key, block): a following join or grouping that starts with those columns
    needs no further exchange.
    """
    previous, following = dict(previous or {}), dict(following or {})
    spread = with_halo(
        df, pos, before=1 if previous else 0, after=beyond + (1 if following else 0),
        size=size, block=block,
    )
    window = Window.partitionBy(key, block).orderBy(pos)
    added = {n: F.lag(F.expr(e)).over(window) for n, e in previous.items()}
    added |= {n: F.lead(F.expr(e)).over(window) for n, e in following.items()}
    return spread.withColumns(added).where(
        F.expr(f"{pos} >= {block} * {size} and {pos} < ({block} + 1) * {size} + {beyond}")
    )


def with_running_totals(
    df: DataFrame,
    key: str,
    block: str,
    order: Sequence[Column | str],
    amounts: Mapping[str, Column],
) -> DataFrame:
    """Add exclusive running totals per key, in ``order``, block by block.

    ``block`` must not decrease along ``order``. Per-block totals are combined
    map-side, summed over the earlier blocks, and joined back on the
    partitioning the block windows already have.
    """
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = df.groupBy(key, block).agg(
        *[F.sum(c).alias(f"_total_{n}") for n, c in amounts.items()]
    )
    carry = totals.select(
        key,
        block,
        *[
            F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}")
            for n in amounts
        ],
    )
    local = df.withColumns(
        {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in amounts.items()}
    )
    return (
        local.join(carry, [key, block], "left")
        .withColumns({n: F.col(n) + F.coalesce(f"_carry_{n}", F.lit(0)) for n in amounts})
        .drop(*[f"_carry_{n}" for n in amounts])
    )


def with_dense_positions(df: DataFrame, key: str, pos: str, name: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Add the 0-based rank of integer position ``pos``, which may have gaps, per key."""
    counted = with_running_totals(
        df.withColumn("_dense", block_of(pos, size)), key, "_dense", (pos,),
        {name: F.lit(1).cast("bigint")},
    )
    return counted.drop("_dense")


def with_run_start(
    df: DataFrame,
    key: str,
    pos: str,
    starts: str,
    *,
    block: str = "block",
    name: str = "run_start",
) -> DataFrame:
    """Add the position at which the current run began.

    ``starts`` names a boolean column that is true on the first row of each run.
    ``df`` must already carry ``block`` (see :func:`with_neighbours`). A run that
    entered a block from an earlier one takes its start from the block carry.
    """
    inside = Window.partitionBy(key, block).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(
        Window.unboundedPreceding, -1
    )
    opened = F.when(F.col(starts), F.col(pos))
    carry = (
        df.groupBy(key, block)
        .agg(F.max(opened).alias("_last"))
        .select(key, block, F.max("_last").over(earlier).alias("_carried"))
    )
    return (
        df.withColumn(name, F.max(opened).over(inside))
        .join(carry, [key, block], "left")
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_carried")
    )


def lengths_of(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, length) of each sequence, from its last position."""
    return rows.groupBy(key).agg((F.max(pos) + 1).alias("length"))


def blocks_in_use(
    lengths: DataFrame, key: str, *, size: int = BLOCK_ROWS, block: str = "block"
) -> DataFrame:
    """The (key, block) pairs of sequences of known ``length``."""
    numbers = F.expr(f"sequence(0L, (length - 1) div {size})")
    return lengths.where("length > 0").select(key, F.explode(numbers).alias(block))


def attach_by_block(
    df: DataFrame,
    small: DataFrame,
    in_use: DataFrame,
    key: str,
    *,
    block: str = "block",
    how: str = "left",
) -> DataFrame:
    """Join ``small`` (one row per key) to a ``df`` partitioned on (key, block).

    ``small`` is repeated for each block of its key (``in_use``, see
    :func:`blocks_in_use`), which splits a hot key into its blocks, and the long
    side keeps its partitioning and is not shuffled again.
    """
    return df.join(in_use.join(small, key), [key, block], how)
