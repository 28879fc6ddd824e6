"""Ordered-row operators that survive a hot key.

A window over a bare key sends every row of that key to one task. Here each key
is first cut into chunks of its order column, the window runs inside a chunk,
and what must cross a chunk border (the last rows, a running total) travels in
a summary with one row per chunk. The summary is smaller than the data by the
chunk length and comes from partial aggregates, so even a key holding a third
of all rows is spread over the cluster.

Keys that are known to be small, such as one tracklet, pass ``span=None`` and
get the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
SPAN = 1 << 16


def _chunk(order: Sequence[str], span: int) -> Column:
    return F.floor(F.col(order[0]) / F.lit(span)).cast("long")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    depth: int = 1,
    span: int | None = SPAN,
) -> DataFrame:
    """Add ``prev1 .. prev<depth>``: structs of ``cols`` of the rows before.

    ``order[0]`` must be numeric; it also cuts the chunks.
    """
    row = F.struct(*cols)
    if span is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(row, k).over(whole).alias(f"prev{k}") for k in range(1, depth + 1)])

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    chunked = df.withColumn(CHUNK, _chunk(order, span))
    base = chunked.select("*", *[F.lag(row, k).over(inside).alias(f"_p{k}") for k in range(1, depth + 1)])

    source = chunked if depth == 1 else base
    last = F.array(row, *[F.col(f"_p{k}") for k in range(1, depth)])
    tails = source.groupBy(*keys, CHUNK).agg(F.max_by(last, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = F.concat(*[
        F.coalesce(F.lag("_tail", k).over(across), F.slice("_tail", 1, 0)) for k in range(1, depth + 1)
    ])
    carry = tails.select(*keys, CHUNK, F.filter(earlier, lambda r: r.isNotNull()).alias("_carry"))

    joined = base.join(carry, [*keys, CHUNK])
    if depth == 1:
        seen = [F.coalesce(F.col("_p1"), F.get("_carry", F.lit(0)))]
    else:
        both = F.concat(F.array(*[F.col(f"_p{k}") for k in range(1, depth + 1)]), F.col("_carry"))
        joined = joined.withColumn("_seen", F.filter(both, lambda r: r.isNotNull()))
        seen = [F.get("_seen", F.lit(k)) for k in range(depth)]
    return joined.select(df.columns + [c.alias(f"prev{k + 1}") for k, c in enumerate(seen)])


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add running totals and running maxima, the current row included."""
    sums, maxima = sums or {}, maxima or {}
    rows = (Window.unboundedPreceding, Window.currentRow)
    if span is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*rows)
        return df.select("*", *[F.sum(c).over(whole).alias(n) for n, c in sums.items()],
                         *[F.max(c).over(whole).alias(n) for n, c in maxima.items()])

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*rows)
    chunked = df.withColumn(CHUNK, _chunk(order, span))
    totals = chunked.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, CHUNK,
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima],
    )
    base = chunked.select(
        "*",
        *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()],
        *[F.max(c).over(inside).alias(f"_in_{n}") for n, c in maxima.items()],
    )
    zero = F.lit(0)
    return base.join(offsets, [*keys, CHUNK]).select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in sums],
        *[F.greatest(f"_in_{n}", f"_o_{n}").alias(n) for n in maxima],
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                  span: int | None = SPAN) -> DataFrame:
    """1-based rank of each row within its key."""
    return with_running(df, keys, order, sums={name: F.lit(1)}, span=span)


def with_sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_gap: int, name: str = "session",
                  count: str = "count_in_session", span: int = SPAN) -> DataFrame:
    """Number the runs of rows whose steps in ``order[0]`` never exceed ``max_gap``,
    and the rows inside each run. One shuffle of the rows, one of their keys and axis, one of the chunk summary."""
    axis = F.col(order[0])
    chunked = df.withColumn(CHUNK, _chunk(order, span))

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        by_order = Window.partitionBy(*keys, CHUNK).orderBy(*by)
        so_far = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select(
            "*", F.row_number().over(by_order).alias("_pos"),
            F.coalesce(axis - F.lag(axis).over(by_order) > max_gap, F.lit(False)).alias("_break"),
        )
        return rows.select(
            "*", F.sum(F.col("_break").cast("int")).over(so_far).alias("_breaks"),
            F.max(F.when(F.col("_break"), F.col("_pos"))).over(so_far).alias("_since"),
        )

    base = counted(chunked, *order)
    # rows at one place of the axis have no break between them, so a summary is the same in any order of theirs
    chunks = counted(chunked.select(*keys, order[0], CHUNK), order[0]).groupBy(*keys, CHUNK).agg(
        F.min(axis).alias("_first"), F.max(axis).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.max("_breaks").alias("_b"), F.max("_since").alias("_s"),
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *keys, CHUNK, "_b", "_s",
        F.coalesce(F.col("_first") - F.lag("_last").over(across) > max_gap, F.lit(True)).alias("_opens"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
    )
    opened = F.when(F.col("_opens"), F.col("_rows") + 1)
    started = F.coalesce(F.col("_rows") + F.col("_s"), opened)
    chunks = chunks.select(
        *keys, CHUNK, "_rows",
        (F.coalesce(F.sum(F.col("_b") + F.col("_opens").cast("int")).over(before), F.lit(0))
         + F.col("_opens").cast("int")).alias("_sessions"),
        F.coalesce(opened, F.max(started).over(before)).alias("_open_at"),
    )
    at = F.col("_rows") + F.col("_pos")
    return base.join(chunks, [*keys, CHUNK]).select(
        *[F.col(c) for c in df.columns], (F.col("_sessions") + F.col("_breaks")).alias(name),
        (at - F.coalesce(F.col("_rows") + F.col("_since"), F.col("_open_at")) + 1).alias(count),
    )
