"""Distributed ordering primitives.

* ``global_rank``      consecutive 1-based ranks over a total order without a
                       single-partition window: range-partitioned sort, then
                       per-partition offsets (one row per partition, so the
                       broadcast is bounded by the partition count).
* ``ordered_positions`` per-key positions/length/previous value that stay
                       balanced when one key holds a third of all rows: most
                       keys are numbered by a window, those of full hash slots
                       by a sort range-partitioned on (key, order...), so a hot
                       key is spread across many partitions, and each partition's
                       slice of a key ("block") gets its offset from a small
                       block table.
* ``prefix_join``      user x global-ranking prefix of per-user length,
                       expressed as an equi-join on rank blocks (no cross join).
* ``exact_quantiles``  pandas-style linear-interpolated quantiles from the
                       global rank (no holistic single-task aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rectide.session import stored

_PID = "_rt_pid"
_MID = "_rt_mid"

#: Rows that one task sorts or groups.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` over so many tasks that one gets about ``task_rows``.

    The number of tasks follows the rows, so what a task sorts does not grow with
    them.  What one task can hold stays as it is."""
    if rows <= task_rows:
        return df
    return df.repartition(task_count(df, rows, task_rows), *keys)


def task_count(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


def _tag_sorted(df: DataFrame, order: Sequence[Column], rows: int = 0) -> DataFrame:
    """``df`` in ``order``, with the ids of its tasks and rows; ``rows``: their number, if known, to size the tasks."""
    if rows > TASK_ROWS:
        ordered = df.repartitionByRange(task_count(df, rows), *order).sortWithinPartitions(*order)
    else:
        ordered = df.orderBy(*order)
    tagged = ordered.select(
        "*",
        F.spark_partition_id().alias(_PID),
        F.monotonically_increasing_id().alias(_MID),
    )
    # The ids depend on the physical layout: freeze them once.
    return stored(tagged)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "grank") -> DataFrame:
    """Add a consecutive 1-based rank ``name`` following ``order`` (must be total)."""
    tagged = _tag_sorted(df, order)
    per_part = tagged.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("_rt_n"), F.min(_MID).alias("_rt_m0")
    )
    # One row per partition: this window and the broadcast are bounded by the
    # number of partitions, not by the data.
    offsets = per_part.select(
        _PID,
        "_rt_m0",
        F.coalesce(
            F.sum("_rt_n").over(
                Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_rt_off"),
    )
    return tagged.join(F.broadcast(offsets), _PID).select(
        *[F.col(c) for c in df.columns],
        (F.col("_rt_off") + F.col(_MID) - F.col("_rt_m0") + 1).cast("long").alias(name),
    )


#: Slots that keys are hashed to, and rows of a slot from which its keys are spread over tasks.
KEY_SLOTS = 1 << 16
SLOT_ROWS = 1 << 17


def ordered_positions(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    lag_cols: Sequence[str] = (),
    pos: str = "pos",
    length: str = "n",
    is_stored: bool = False,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Per-``key`` 1-based position and group length in ``order``; for each column
    in ``lag_cols`` also ``prev_<col>`` (value of the previous row of the key).
    Rows without a key have no position and are left out.

    Keys are counted by hash slot, one small row a slot and task; those of a slot
    of at most ``slot_rows`` rows are numbered by a window of one shuffle, the
    others block by block.  ``df`` is read several times: it is written once
    unless it ``is_stored``."""
    rows = df.where(F.col(key).isNotNull())
    rows = rows if is_stored else stored(rows)
    slot = F.pmod(F.xxhash64(key), F.lit(KEY_SLOTS))
    # at most KEY_SLOTS rows, and no more than the rows / slot_rows
    full = {r["slot"]: r["count"] for r in rows.groupBy(slot.alias("slot")).count().where(F.col("count") > slot_rows).collect()}
    n, n_hot = rows.count(), sum(full.values())
    if not full:
        return _window_positions(dealt(rows, n, key), key, order, lag_cols, pos, length)
    hot = slot.isin(list(full))
    few = _window_positions(dealt(rows.where(~hot), n - n_hot, key), key, order, lag_cols, pos, length)
    return few.unionByName(_block_positions(rows.where(hot), key, order, lag_cols, pos, length, n_hot))


def _window_positions(
    rows: DataFrame, key: str, order: Sequence[Column], lag_cols: Sequence[str], pos: str, length: str
) -> DataFrame:
    by_key = Window.partitionBy(key).orderBy(*order)
    every = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "*",
        F.row_number().over(by_key).alias(pos),
        F.count(F.lit(1)).over(every).cast("int").alias(length),
        *[F.lag(c).over(by_key).alias(f"prev_{c}") for c in lag_cols],
    )


def _block_positions(
    df: DataFrame, key: str, order: Sequence[Column], lag_cols: Sequence[str], pos: str, length: str, n: int
) -> DataFrame:
    """The ``n`` rows are sorted over all tasks; a task's slice of a key is a block."""
    tagged = _tag_sorted(df, [F.col(key).asc(), *order], n)
    block_aggs = [F.count(F.lit(1)).alias("_rt_bn"), F.min(_MID).alias("_rt_b0")]
    block_aggs += [F.max_by(F.col(c), F.col(_MID)).alias(f"_rt_last_{c}") for c in lag_cols]
    blocks = tagged.groupBy(_PID, key).agg(*block_aggs)
    # A key owns at most one block per partition, so this window is bounded
    # by the partition count even for the hottest key.
    w_key = Window.partitionBy(key).orderBy(_PID)
    bstats = blocks.select(
        _PID,
        key,
        "_rt_b0",
        F.coalesce(
            F.sum("_rt_bn").over(w_key.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_rt_boff"),
        F.sum("_rt_bn").over(Window.partitionBy(key)).alias("_rt_len"),
        *[F.lag(f"_rt_last_{c}").over(w_key).alias(f"_rt_bprev_{c}") for c in lag_cols],
    )
    joined = dealt(tagged, n, _PID, key).join(bstats, [_PID, key])
    first_in_block = F.col(_MID) == F.col("_rt_b0")
    w_block = Window.partitionBy(_PID, key).orderBy(_MID)
    out = [F.col(c) for c in df.columns]
    out.append((F.col("_rt_boff") + F.col(_MID) - F.col("_rt_b0") + 1).cast("int").alias(pos))
    out.append(F.col("_rt_len").cast("int").alias(length))
    for c in lag_cols:
        out.append(
            F.when(first_in_block, F.col(f"_rt_bprev_{c}"))
            .otherwise(F.lag(c).over(w_block))
            .alias(f"prev_{c}")
        )
    return joined.select(*out)


#: Salts that a rank block's needs-rows are spread over.
SALTS = 8


def prefix_join(
    needs: DataFrame,
    ranked: DataFrame,
    need_col: str = "need",
    rank_col: str = "grank",
    block: int = 64,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``ranked`` with ``rank <= need`` for every row of ``needs``.

    Equivalent to the theta join ``needs JOIN ranked ON rank <= need`` but runs
    as an equi-join on rank blocks: each needs-row is replicated once per block
    it reaches, so output is linear in sum(need).  Every needs-row reaches block
    0, so the rows are salted and the ranking is replicated ``SALTS`` times.
    ``keys`` are extra equi-join columns (a ranking per key, e.g. per source id).
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in needs.columns]), F.lit(SALTS)).cast("int")
    last_block = F.floor((F.col(need_col) - 1) / F.lit(block)).cast("int")
    expanded = needs.select(
        "*",
        salt.alias("_rt_salt"),
        F.explode(
            F.when(F.col(need_col) > 0, F.sequence(F.lit(0), last_block)).otherwise(
                F.array().cast("array<int>")
            )
        ).alias("_rt_blk"),
    )
    blocked = ranked.withColumn(
        "_rt_blk", F.floor((F.col(rank_col) - 1) / F.lit(block)).cast("int")
    ).withColumn("_rt_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the size estimate does not know of the copies: never a broadcast of them
    return (
        expanded.join(blocked.hint("merge"), [*keys, "_rt_blk", "_rt_salt"])
        .where(F.col(rank_col) <= F.col(need_col))
        .drop("_rt_blk", "_rt_salt")
    )


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """``row_number() <= k`` per group; Spark plans this as WindowGroupLimit,
    which trims each map partition to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def exact_quantiles(df: DataFrame, value_col: str, quantiles: Sequence[float]) -> DataFrame:
    """One-row DataFrame with ``q_<i>`` columns: linear-interpolated quantiles
    (pandas default) of ``value_col``; NULLs should be filled by the caller."""
    ranked = global_rank(
        df.select(F.col(value_col).cast("double").alias("_rt_v"), F.monotonically_increasing_id().alias("_rt_tie")),
        [F.col("_rt_v").asc(), F.col("_rt_tie").asc()],
        "_rt_r",
    )
    n = ranked.agg(F.count(F.lit(1)).alias("_rt_cnt"))
    wanted = []
    for i, q in enumerate(quantiles):
        pos = (F.col("_rt_cnt") - 1) * F.lit(float(q))
        wanted.append(
            F.struct(
                F.lit(i).alias("qi"),
                (F.floor(pos) + 1).cast("long").alias("lo"),
                (F.least(F.floor(pos) + 2, F.col("_rt_cnt"))).cast("long").alias("hi"),
                (pos - F.floor(pos)).alias("frac"),
            )
        )
    picks = n.select(F.explode(F.array(*wanted)).alias("p")).select("p.*")
    lo = picks.join(ranked, ranked["_rt_r"] == picks["lo"]).select("qi", "frac", F.col("_rt_v").alias("vlo"))
    hi = picks.join(ranked, ranked["_rt_r"] == picks["hi"]).select("qi", F.col("_rt_v").alias("vhi"))
    vals = lo.join(hi, "qi").select(
        "qi", (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("v")
    )
    return vals.groupBy().pivot("qi", list(range(len(quantiles)))).agg(F.first("v")).select(
        *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"q_{i}") for i in range(len(quantiles))]
    )


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row of ``df``.

    ``scalars`` must be a global aggregate (exactly one row), so the broadcast
    is one row by construction.
    """
    return df.join(F.broadcast(scalars), how="cross")
