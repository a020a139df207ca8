"""Substring dedup by word windows with a count-min prefilter."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rectide.llm import rounds
from rectide.llm.words import (
    SPACE,
    covered,
    join_parts,
    pack,
    pack_bits,
    split_parts,
    unpack,
    unpack_bits,
    word_table,
)

#: Letter part of the exact answers; the sketch rows use 0, 1, ...
EXACT = 100

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _windows(block: rounds.Block, size: int):
    """Word table, window starts and their 64-bit hashes of a block."""
    table = word_table(block.texts, SPACE)
    starts = table.window_starts(size)
    return table, starts, table.window_hash(starts, size)


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by pair, in no order within a pair; places in it at which a new pair begins).

    Sorted by the first hash alone, unless it is equal for different second ones.
    """
    order = np.argsort(one)
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(one) else np.zeros(0, dtype=np.int64)


def _first_of_each(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first occurrence of each distinct pair, sorted by pair; pair number of each)."""
    order, begin = _grouped(one, two)
    if not len(one):
        return order, order
    number = np.empty(len(one), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(one))))
    return np.minimum.reduceat(order, begin), number


def window_dedup(
    docs: DataFrame,
    window: int = 20,
    depth: int = 2,
    cells_per_word: int = 8,
    block_bytes: int = rounds.BLOCK_BYTES,
) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier.

    Words are runs of bytes other than space and \\x09-\\x0D, unchanged; earlier
    means a smaller doc_id, or the same document and an earlier start, judged on
    the input.  Gives doc_id, n_words, n_removed, kept_sha256 (kept words joined
    by one space) and kept_text.

    Pass 1: every block of documents sketches its windows (``depth`` rows of
    cells, the width grown with the corpus); the block sketches are merged cell
    range by cell range, so no task holds the whole sketch and nothing is
    broadcast.  Pass 2: only windows whose smallest count is two or more are
    grouped by 128 bits, two hashes each over its own non-linear digests of the
    words; estimates are never too low, so none is lost.  A window that one block holds several times is sent once.

    Null or blank text: no words, the hash of the empty string.  Null doc_id:
    after all other ids.  Rows with one doc_id are separate documents in a fixed
    order; repeated rows keep one copy.  An empty table gives no rows; other
    columns are not read.
    """
    blocks, shards, total = rounds.deal(docs, block_bytes)
    bits = rounds.sketch_bits(total // 4 + 1, cells_per_word)

    def sketch(block, _):
        _, _, one = _windows(block, window)
        return rounds.sketch_letters(one, depth, bits, shards)

    def groups(block, replies):
        """Estimated repeats of a block: (indexes of first occurrences, sorted by hash; ...)."""
        table, starts, one = _windows(block, window)
        hot = np.flatnonzero(rounds.estimated_repeats(one, replies, depth, bits, shards))
        two = table.second_hash(starts[hot], window)
        first, number = _first_of_each(one[hot], two)
        return table, starts, one, two, hot, first, number

    def repeats(block, replies):
        table, starts, one, two, hot, first, _ = groups(block, replies)
        at = hot[first]
        owner = block.order[np.searchsorted(table.first, starts[at], side="right") - 1]
        bounds = rounds.shard_bounds(one[at], shards)
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                yield s, 0, join_parts(
                    pack(one[at[a:b]], True), pack(two[first[a:b]]), pack(owner[a:b].view(np.uint64))
                )

    def group_exactly(_shard, rows):
        blks, parts = [r[0] for r in rows], [split_parts(r[2]) for r in rows]
        one = np.concatenate([unpack(p[0], True) for p in parts])
        two = np.concatenate([unpack(p[1]) for p in parts])
        owner = np.concatenate([unpack(p[2]).view(np.int64) for p in parts])
        sizes = [int.from_bytes(p[0][:8], "little") for p in parts]
        blk = np.repeat(np.arange(len(blks)), sizes)
        order, begin = _grouped(one, two)
        size = np.diff(np.append(begin, len(one)))
        least = np.repeat(np.minimum.reduceat(owner[order], begin), size)  # the earliest owner of each pair,
        rank = np.where(owner[order] == least, blk[order], len(blks))
        late = np.empty(len(one), dtype=bool)
        late[order] = rank != np.repeat(np.minimum.reduceat(rank, begin), size)  # and its first block
        for b, piece in zip(blks, np.split(late, np.cumsum(sizes)[:-1])):
            yield b, EXACT, pack_bits(piece)

    def remove(block, replies):
        table, starts, one, two, hot, first, number = groups(block, replies)
        bounds = rounds.shard_bounds(one[hot[first]], shards)
        late = np.zeros(len(first), dtype=bool)
        for s, data in replies.get(EXACT, {}).items():
            late[bounds[s] : bounds[s + 1]] = unpack_bits(data, bounds[s + 1] - bounds[s])
        dup = late[number]
        repeat = np.ones(len(hot), dtype=bool)
        repeat[first] = False
        gone = covered(len(table.hashes), starts[hot[dup | repeat]], window)
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[table.first[1:]] - removed[table.first[:-1]]
        kept = []
        for d in range(len(block.ids)):
            a, b = table.first[d], table.first[d + 1]
            keep = np.flatnonzero(~gone[a:b]) + a
            kept.append(
                b" ".join(
                    [table.raw[x:y] for x, y in zip(table.starts[keep].tolist(), table.ends[keep].tolist())]
                )
            )
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "n_words": pa.array(table.counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    sketches = rounds.answer(rounds.ask(blocks, None, sketch), rounds.merge_sketches)
    exact = rounds.answer(rounds.ask(blocks, sketches, repeats), group_exactly)
    return rounds.finish(blocks, sketches.unionByName(exact), remove, SCHEMA)

