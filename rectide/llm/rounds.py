"""Blocks of documents that question hash-partitioned shards and read the answers.

Operators that compare every window or n-gram of the corpus would shuffle one
row per item.  Here documents are dealt once into blocks of bounded size (by a
hash of id and text, so copies and hot sources spread); each block sends each
shard ONE compressed message about the distinct items it holds there, which is
the map-side combine, and gets ONE answer back.  A hot item costs a shard one
entry per block, never one per occurrence.  The dealt documents are one
exchange that all rounds of a plan reuse; nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.llm.words import mix, pack, pack_bits, unpack, unpack_bits

#: Bytes of text that one block holds on average.
BLOCK_BYTES = 8 << 20

LETTER = "blk int, shard int, part int, data binary"
_SCHEMA = pa.schema([("blk", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
#: Rows without an id come after all others.
LAST_ID = np.iinfo(np.int64).max


class Block:
    """Documents of one block in order of (doc_id, text), nulls last; text null is empty."""

    def __init__(self, number: int, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        rows = sorted(
            zip(ids, texts), key=lambda r: (LAST_ID if r[0] is None else r[0], r[0] is None, r[1] or b"")
        )
        self.number = number
        self.ids: list[int | None] = [r[0] for r in rows]
        self.texts: list[bytes] = [r[1] or b"" for r in rows]
        self.order = np.array([LAST_ID if x is None else x for x in self.ids], dtype=np.int64)


def deal(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(documents with their block number, number of blocks, total bytes)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total, held = slim.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size + 64), F.lit(0))).first()
    n = max(1, -(-held // block_bytes))
    return slim.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n, total


def shard_bounds(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Offsets at which sorted 64-bit hashes split into ``shards`` equal ranges."""
    edges = [((s << 64) // shards) for s in range(1, shards)]
    return np.concatenate(
        [[0], np.searchsorted(sorted_hashes, np.array(edges, dtype=np.uint64)), [len(sorted_hashes)]]
    ).astype(np.int64)


def _letters(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """part -> shard -> data."""
    out: dict[int, dict[int, bytes]] = {}
    for part, shard, data in zip(
        table.column("part").to_pylist(), table.column("shard").to_pylist(), table.column("data").to_pylist()
    ):
        out.setdefault(part, {})[shard] = data
    return out


def ask(blocks: DataFrame, replies: DataFrame | None, fn: Callable) -> DataFrame:
    """fn(Block, replies) yields (shard, part, data); gives the letters to all shards."""

    def first(key, table):
        block = Block(key[0].as_py(), table)
        return _letters((block.number, s, p, d) for s, p, d in fn(block, {}))

    def later(key, left, right):
        if not left.num_rows:
            return _letters([])
        block = Block(key[0].as_py(), left)
        return _letters((block.number, s, p, d) for s, p, d in fn(block, _replies(right)))

    if replies is None:
        return blocks.groupBy("blk").applyInArrow(first, LETTER)
    return blocks.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(later, LETTER)


def answer(letters: DataFrame, fn: Callable) -> DataFrame:
    """fn(shard, [(blk, part, data)]) yields (blk, part, data); gives the replies to the blocks."""

    def shard(key, table):
        number = key[0].as_py()
        rows = sorted(
            zip(
                table.column("blk").to_pylist(), table.column("part").to_pylist(), table.column("data").to_pylist()
            ),
            key=lambda r: r[:2],
        )
        return _letters((b, number, p, d) for b, p, d in fn(number, rows))

    return letters.groupBy("shard").applyInArrow(shard, LETTER)


def finish(blocks: DataFrame, replies: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(Block, replies) returns an Arrow table of ``schema``."""

    def last(key, left, right):
        return fn(Block(key[0].as_py(), left), _replies(right))

    return blocks.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(last, schema)


# -- count-min prefilter -----------------------------------------------------------------


def sketch_bits(items_at_most: int, load: int = 8) -> int:
    """Bits of a sketch row with ``load`` cells for each item."""
    return min(60, max(10, int(np.ceil(np.log2(max(1, items_at_most) * load)))))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes, row + 11) >> np.uint64(64 - bits)


def sketch_letters(hashes: np.ndarray, depth: int, bits: int, shards: int):
    """One block's count-min sketch, sparse: the distinct cells of each row, by shard."""
    for row in range(depth):
        cells = np.unique(_cells(hashes, row, bits))
        at = shard_bounds(cells << np.uint64(64 - bits), shards)
        for s in range(shards):
            if at[s] < at[s + 1]:
                yield s, row, pack(cells[at[s] : at[s + 1]], increasing=True)


def merge_sketches(_shard: int, rows: list[tuple[int, int, bytes]]):
    """Sum the blocks' cells; answer each block which of its cells hold two or more."""
    for part in sorted({r[1] for r in rows}):
        held = [(b, unpack(d, increasing=True)) for b, p, d in rows if p == part]
        cells = np.sort(np.concatenate([c for _, c in held]))
        shared = np.unique(cells[1:][cells[1:] == cells[:-1]])
        for b, c in held:
            at = np.searchsorted(shared, c)
            at[at == len(shared)] = 0
            yield b, part, pack_bits(shared[at] == c if len(shared) else np.zeros(len(c), bool))


def estimated_repeats(
    hashes: np.ndarray, replies: dict[int, dict[int, bytes]], depth: int, bits: int, shards: int
) -> np.ndarray:
    """Mask of the items whose smallest cell count over the merged sketch is two or more."""
    alive = np.arange(len(hashes))
    for row in range(depth):
        own = _cells(hashes, row, bits)
        cells, counts = np.unique(own, return_counts=True)
        at = shard_bounds(cells << np.uint64(64 - bits), shards)
        shared = np.zeros(len(cells), dtype=bool)
        for s, data in replies.get(row, {}).items():
            shared[at[s] : at[s + 1]] = unpack_bits(data, at[s + 1] - at[s])
        hot = cells[shared | (counts > 1)]
        if not len(hot):
            return np.zeros(len(hashes), dtype=bool)
        mine = own[alive]
        found = np.searchsorted(hot, mine)
        found[found == len(hot)] = 0
        alive = alive[hot[found] == mine]
    mask = np.zeros(len(hashes), dtype=bool)
    mask[alive] = True
    return mask
