"""Substring dedup by bytes with logarithmic families of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from rectide.llm import rounds
from rectide.llm.words import (
    _CODES,
    covered,
    join_parts,
    mix,
    pack,
    pack_bits,
    powers,
    split_parts,
    unpack,
    unpack_bits,
)

SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
    "spans array<struct<begin: long, end: long>>"
)
#: Parts of a reply besides the sketch rows, and of a letter to the sketch.
EXACT, HOT, HEAVY = 100, 101, 102
#: Bytes of suffixes from which the runs of one anchor are split over the shards.
ANCHOR_BYTES = 16 << 20
#: A shard holds up to ``length`` bytes for each distinct suffix, so blocks and shards are smaller here.
BLOCK_BYTES = 4 << 20
_SLICE = 1 << 20


class SuffixFamily:
    """Suffix arrays of text cut at ``length`` bytes, in levels of doubling size.

    ``add`` sorts the suffixes of a batch, merge-scans them against every level
    for matches of the whole length, keeps the ones not seen before as a new
    level and merges levels of equal rank; every suffix is merged at most
    log2(batches) times.
    """

    def __init__(self, length: int):
        self.kind = f"S{length}"
        self.length = length
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mask of the suffixes at ``starts`` (in order of precedence) that were seen before."""
        rows = sliding_window_view(text, self.length)[starts]
        suffixes = np.ascontiguousarray(rows).view(self.kind).ravel()
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        seen = np.zeros(len(array), dtype=bool)
        seen[1:] = array[1:] == array[:-1]
        for _, level in self.levels:
            at = np.searchsorted(level, array)
            at[at == len(level)] = 0
            seen |= level[at] == array
        rank, fresh = 0, array[~seen]
        if len(fresh):
            while self.levels and self.levels[-1][0] <= rank:
                fresh = np.concatenate([self.levels.pop()[1], fresh])
                fresh.sort(kind="stable")
                rank += 1
            self.levels.append((rank, fresh))
        out = np.empty(len(seen), dtype=bool)
        out[order] = seen
        return out


def _anchored_runs(text: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, length: int):
    """Cut the possible match starts of a block into runs that share an anchor.

    The anchor of a start is the smallest hashed (length // 2)-byte string within
    its ``length`` bytes, leftmost among equals; it depends on those bytes only,
    so equal strings have equal anchors.  Gives (low, high, hash of the anchor).
    """
    seed = length // 2
    span = length - seed + 1
    low, high, keys = [], [], []
    up, down = powers(_SLICE + length + 1)
    valid = np.zeros(len(text) + 1, dtype=np.int8)
    long = doc_end - doc_start >= length
    np.add.at(valid, doc_start[long], 1)
    np.add.at(valid, doc_end[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for begin in range(0, max(0, len(text) - length + 1), _SLICE):
        part = text[begin : begin + _SLICE + length - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_CODES[part] * down[: len(part)], out=total[1:])
        n = len(part) - seed + 1
        hashed = mix((total[seed:] - total[:-seed]) * up[:n])
        best = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(valid[begin : begin + len(anchor)])
        if not len(at):
            continue
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor[at]) != 0)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(at)]]) - 1
        low.append(at[first] + begin)
        high.append(at[last] + begin)
        keys.append(mix(hashed[anchor[at[first]]], 7))  # anchors are minima: spread them anew
    if not low:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(low), np.concatenate(high), np.concatenate(keys)


def _single_windows(
    text: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray, split: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs in order, those of ``split`` as runs of one start, keyed by a hash of its own ``length`` bytes."""
    n = np.where(split, high - low + 1, 1)
    run = np.repeat(np.arange(len(low)), n)
    start = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    alone = split[run]
    out = keys[run]
    own, (up, _) = start[alone], powers(length)
    hashed = np.zeros(len(own), dtype=np.uint64)
    for i in range(length):
        hashed += _CODES[text[own + i]] * up[i]
    out[alone] = mix(hashed, 7)
    return start, np.where(alone, start, high[run]), out


def suffix_dedup(
    docs: DataFrame,
    length: int = 100,
    depth: int = 1,
    cells_per_byte: int = 1,
    batch_suffixes: int = 1 << 16,
    block_bytes: int = BLOCK_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier.

    Texts are UTF-8 bytes, matches never cross documents, earlier means a
    smaller doc_id, or the same document and an earlier start, judged on the
    input.  Gives doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (remaining bytes) and spans.

    Starts are cut into runs sharing a content-defined anchor (see
    ``_anchored_runs``); a prefilter keeps the runs whose anchor may occur
    twice.  Each such run sends its bytes, once per block, to the shard of its
    anchor, so all equal strings meet in one shard.  An anchor that holds
    ``anchor_bytes`` of suffixes or more over all blocks (a passage with many
    different surroundings) is split: each window goes to a shard by a hash of
    its own bytes, so equal strings still meet.  The shards' number grows with
    the corpus, and no anchor fills one.  A shard takes its
    runs in document order, in batches of ``batch_suffixes`` suffixes: a batch
    gets a suffix array, is merge-scanned against the shard's ``SuffixFamily``
    and joins it.  Matches are decided on bytes, never on hashes.

    Null or empty text: zero bytes, nothing removed.  Null doc_id: after all
    other ids.  Rows with one doc_id are separate documents in a fixed order;
    repeated rows keep one copy.  An empty table gives no rows; other columns
    are not read.
    """
    blocks, sketches, letters, scan, remove = _plan(
        docs, length, depth, cells_per_byte, batch_suffixes, block_bytes, anchor_bytes
    )
    return rounds.finish(blocks, sketches.unionByName(rounds.answer(letters, scan)), remove, SCHEMA)


def _plan(
    docs: DataFrame,
    length: int,
    depth: int,
    cells_per_byte: int,
    batch_suffixes: int,
    block_bytes: int,
    anchor_bytes: int,
):
    """Blocks, replies of the sketch, letters with the runs, and the functions of the last two steps."""
    blocks, shards, total = rounds.deal(docs, block_bytes)
    bits = rounds.sketch_bits(total // 2 + 1, cells_per_byte)
    #: What the blocks leave out is less than half of ``anchor_bytes`` together.
    least = max(1, anchor_bytes // (2 * shards))

    def runs(block):
        sizes = np.fromiter(map(len, block.texts), dtype=np.int64, count=len(block.texts))
        end = np.cumsum(sizes)
        raw = b"".join(block.texts)
        text = np.frombuffer(raw, dtype=np.uint8)
        return raw, text, end - sizes, end, *_anchored_runs(text, end - sizes, end, length)

    def sketch(block, _):
        """The sketch, and the cells of its first row that hold ``least`` bytes of suffixes of distinct runs."""
        raw, _, _, _, low, high, keys = runs(block)
        yield from rounds.sketch_letters(keys, depth, bits, shards)
        cells, cell = np.unique(rounds._cells(keys, 0, bits), return_inverse=True)
        size = (high - low + 1) * length
        many = np.bincount(cell, weights=size, minlength=len(cells)) >= least
        held, weight = set(), np.zeros(len(cells), dtype=np.int64)
        for i in np.flatnonzero(many[cell]).tolist():
            piece = raw[low[i] : high[i] + length]
            if piece not in held:
                held.add(piece)
                weight[cell[i]] += size[i]
        at = rounds.shard_bounds(cells << np.uint64(64 - bits), shards)
        for s in range(shards):
            mine = at[s] + np.flatnonzero(weight[at[s] : at[s + 1]] >= least)
            if len(mine):
                yield s, HEAVY, join_parts(pack(cells[mine], increasing=True), pack(weight[mine]))

    def merge(shard, rows):
        """The merged sketch, and for each block which cells of its first row are hot."""
        yield from rounds.merge_sketches(shard, [r for r in rows if r[1] != HEAVY])
        heavy = [split_parts(d) for _, p, d in rows if p == HEAVY]
        if not heavy:
            return
        cells, cell = np.unique(np.concatenate([unpack(c, increasing=True) for c, _ in heavy]), return_inverse=True)
        weight = np.bincount(cell, weights=np.concatenate([unpack(w) for _, w in heavy]).astype(np.float64))
        hot = cells[weight * 2 >= anchor_bytes]
        for b, p, data in rows:
            if p == 0 and len(hot):
                mask = np.isin(unpack(data, increasing=True), hot)
                if mask.any():
                    yield b, HOT, pack_bits(mask)

    def in_hot_cells(keys, replies):
        cells, cell = np.unique(rounds._cells(keys, 0, bits), return_inverse=True)
        at = rounds.shard_bounds(cells << np.uint64(64 - bits), shards)
        hot = np.zeros(len(cells), dtype=bool)
        for s, data in replies.get(HOT, {}).items():
            hot[at[s] : at[s + 1]] = unpack_bits(data, at[s + 1] - at[s])
        return hot[cell]

    def candidates(block, replies):
        """Runs with a repeated anchor; of those with equal bytes the first is ``own``."""
        raw, text, begin, end, low, high, keys = found = runs(block)
        hot = np.flatnonzero(rounds.estimated_repeats(keys, replies, depth, bits, shards))
        if HOT in replies:
            split = in_hot_cells(keys, replies)[hot]
            low, high, keys = _single_windows(text, low[hot], high[hot], keys[hot], split, length)
            hot = np.arange(len(low))
            found = raw, text, begin, end, low, high, keys
        held, own = set(), np.zeros(len(hot), dtype=bool)
        for i, (a, b) in enumerate(zip(low[hot].tolist(), high[hot].tolist())):
            piece = raw[a : b + length]
            if piece not in held:
                held.add(piece)
                own[i] = True
        sent = hot[own]
        sent = sent[np.argsort(keys[sent], kind="stable")]
        return found, hot, own, sent, rounds.shard_bounds(keys[sent], shards)

    def repeats(block, replies):
        (raw, _, begin, end, low, high, _), _, _, sent, bounds = candidates(block, replies)
        for s in range(shards):
            mine = np.sort(sent[bounds[s] : bounds[s + 1]])
            if len(mine):
                doc = np.searchsorted(end, low[mine], side="right")
                pieces = b"".join([raw[a : b + length] for a, b in zip(low[mine].tolist(), high[mine].tolist())])
                yield s, 0, join_parts(
                    pack(high[mine] - low[mine] + length),
                    pack(block.order[doc].view(np.uint64)),
                    pa.compress(pieces, codec="zstd", asbytes=True),
                )

    def scan(_shard, rows):
        blks, sizes, owners, texts, counts = [], [], [], [], []
        for b, _, data in rows:
            size, owner, text = split_parts(data)
            size = unpack(size).astype(np.int64)
            blks.append(b)
            counts.append(len(size))
            sizes.append(size)
            owners.append(unpack(owner).view(np.int64))
            texts.append(pa.decompress(text, decompressed_size=int(size.sum()), codec="zstd", asbytes=True))
        raw, size = b"".join(texts), np.concatenate(sizes)
        text = np.frombuffer(raw, dtype=np.uint8)
        at = np.cumsum(size) - size
        windows = size - length + 1
        out_at = np.cumsum(windows) - windows
        late = np.zeros(int(windows.sum()), dtype=bool)
        family, held = SuffixFamily(length), set()
        batch: list[int] = []
        pending = 0

        def flush():
            runs_ = np.array(batch, dtype=np.int64)
            n = windows[runs_]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            late[np.repeat(out_at[runs_], n) + inner] = family.add(text, np.repeat(at[runs_], n) + inner)

        for i in np.argsort(np.concatenate(owners), kind="stable").tolist():
            piece = raw[at[i] : at[i] + size[i]]
            if piece in held:
                late[out_at[i] : out_at[i] + windows[i]] = True
                continue
            held.add(piece)
            batch.append(i)
            pending += int(windows[i])
            if pending >= batch_suffixes:
                flush()
                batch, pending = [], 0
        if batch:
            flush()
        cuts = np.concatenate([out_at, [len(late)]])[np.cumsum([0, *counts])]
        for b, x, y in zip(blks, cuts[:-1], cuts[1:]):
            yield b, EXACT, pack_bits(late[x:y])

    def remove(block, replies):
        (raw, text, begin, end, low, high, _), hot, own, sent, bounds = candidates(block, replies)
        gone = [_starts(low[hot[~own]], high[hot[~own]])]
        for s, data in replies.get(EXACT, {}).items():
            mine = np.sort(sent[bounds[s] : bounds[s + 1]])
            starts = _starts(low[mine], high[mine])
            gone.append(starts[unpack_bits(data, len(starts))])
        mask = covered(len(text), np.concatenate(gone), length)
        removed = np.concatenate([[0], np.cumsum(mask)])
        kept, spans = [], []
        for a, b in zip(begin.tolist(), end.tolist()):
            own_mask = mask[a:b]
            edge = np.flatnonzero(np.diff(own_mask, prepend=False, append=False))
            spans.append([{"begin": x, "end": y} for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist())])
            kept.append(text[a:b][~own_mask].tobytes() if len(edge) else raw[a:b])
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "n_bytes": pa.array(end - begin, pa.int64()),
                "n_removed": pa.array(removed[end] - removed[begin], pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(
                    spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                ),
            }
        )

    sketches = rounds.answer(rounds.ask(blocks, None, sketch), merge)
    return blocks, sketches, rounds.ask(blocks, sketches, repeats), scan, remove


def _starts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All starts of the runs [low, high]."""
    n = high - low + 1
    return np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
