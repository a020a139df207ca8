"""Language-model scoring with a weighted backoff automaton."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.llm import rounds
from rectide.llm.words import SPACE, join_parts, mix, pack, pack_bits, split_parts, unpack, unpack_bits, word_table

SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
#: Letter parts: arcs of the automaton, its states, and the totals of the corpus.
ARCS, STATES, TOTALS = 0, 1, 2
_START, _END = (mix(np.array([x], dtype=np.uint64), 99)[0] for x in (1, 2))


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _tokens(block: rounds.Block, folds: int, fold: int):
    """Tokens of a block in order, with the token before each, its document, and whether it trains."""
    table = word_table(block.texts, SPACE, lower=True)
    counts = table.counts + 1
    last = np.cumsum(counts) - 1
    token = np.empty(int(counts.sum()), dtype=np.uint64)
    word = np.ones(len(token), dtype=bool)
    word[last] = False
    token[word] = table.hashes
    token[last] = _END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last - counts + 1] = _START
    out = np.array([held_out(x, folds, fold) for x in block.ids], dtype=bool)
    doc = np.repeat(np.arange(len(counts)), counts)
    return token, before, doc, counts, out, ~out[doc]


class BackoffAutomaton:
    """The part of the backoff automaton that one block's tokens can reach.

    A state is a seen history (one token, or the start); its arcs are the seen
    bigrams with Witten-Bell interpolated probabilities (c + t * P(w)) / (n + t),
    n tokens and t distinct tokens having followed the history.  A token without
    an arc takes the failure arc, weight t / (n + t), to the root, whose arcs
    are the tokens with add-one probabilities (c + 1) / (N + V + 1); any other
    token takes 1 / (N + V + 1) there.  A history never seen has no state, the
    traversal stays at the root.
    """

    def __init__(self, states, arcs, tokens_total: int, distinct: int):
        self.codes, self.count, self.followed, self.followers = states
        self.arc_codes, self.arc_count = arcs
        self.root = tokens_total + distinct + 1

    def root_probability(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[np.searchsorted(self.codes, token)]
        return count, (count + 1.0) / self.root

    def traverse(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each token when read left to right from the start.

        The state in which a token is read is that of the token before it, so
        carrying it along the sequence is reading ``before``.
        """
        _, root = self.root_probability(token)
        state = np.searchsorted(self.codes, before)
        n, t = self.followed[state].astype(np.float64), self.followers[state].astype(np.float64)
        arc = self.arc_count[np.searchsorted(self.arc_codes, _arc(before, token))].astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            step = np.where(arc > 0, (arc + t * root) / (n + t), t / (n + t) * root)
        return np.log10(np.where(n > 0, step, root))


def _arc(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before, 3) + token, 4)


def backoff_lm(
    docs: DataFrame, folds: int = 7, fold: int = 2, block_bytes: int = rounds.BLOCK_BYTES
) -> DataFrame:
    """Score every document with a bigram backoff model of the documents of the other folds.

    Tokens: words (other than space and \\x09-\\x0D) lowered in A-Z, then one end
    token.  A document is held out of training if crc32 of its id as text modulo
    ``folds`` is ``fold``; a null id is not held out.  Gives n_tokens, n_known
    (tokens that training holds), train_tokens (N), base_score (sum of
    log10((c + 1) / (N + V + 1))) and score (log10 probability that the
    ``BackoffAutomaton`` gives the text).

    All bigrams and tokens of the training documents count, none is cut.  Each
    block of documents sends its distinct bigrams with their training counts to
    their shards, hears the totals and which of them it stands for, so that the
    followers of each history are counted once, in the second round, with the
    tokens; from the answers it builds the part of the automaton that its own
    documents reach.  Bigrams and tokens are known by
    64-bit digests that are not linear in the bytes.

    Null or empty text: the end token alone.  Repeated rows count and are scored
    each; an empty table gives no rows; other columns are not read.
    """
    blocks, shards, _ = rounds.deal(docs, block_bytes)

    def arcs(block):
        token, before, doc, counts, out, trains = _tokens(block, folds, fold)
        code, at, number = np.unique(_arc(before, token), return_index=True, return_inverse=True)
        count = np.bincount(number[trains], minlength=len(code)).astype(np.uint64)
        return token, before, doc, counts, out, trains, code, at, count

    def states(token, before):
        return np.unique(np.concatenate([token, before]))

    def send_arcs(block, _):
        *_, code, _, count = arcs(block)
        at = rounds.shard_bounds(code, shards)
        for s in range(shards):
            a, b = at[s], at[s + 1]
            if a < b:
                yield s, ARCS, join_parts(pack(code[a:b], True), pack(count[a:b]))

    def merge_arcs(_shard, rows):
        parts = [split_parts(r[2]) for r in rows]
        codes = [unpack(p[0], True) for p in parts]
        count = np.concatenate([unpack(p[1]) for p in parts])
        code, number = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(number, weights=count, minlength=len(code)).astype(np.uint64)
        stands = np.zeros(len(number), dtype=bool)
        trained = np.flatnonzero(count > 0)
        stands[trained[np.unique(number[trained], return_index=True)[1]]] = True
        cut = np.cumsum([len(c) for c in codes])[:-1]
        for (b, _, _), t, own in zip(rows, np.split(total[number], cut), np.split(stands, cut)):
            yield b, ARCS, join_parts(pack(t), pack_bits(own))

    def heard(replies, part, bounds, columns):
        """Aligned answers of all shards: unsigned columns."""
        out = [np.zeros(bounds[-1], dtype=np.uint64) for _ in range(columns)]
        for s, data in replies.get(part, {}).items():
            for column, piece in zip(out, split_parts(data)):
                column[bounds[s] : bounds[s + 1]] = unpack(piece)
        return out

    def send_states(block, replies):
        token, before, _, _, _, trains, code, at, _ = arcs(block)
        bounds = rounds.shard_bounds(code, shards)
        stands = np.zeros(len(code), dtype=bool)
        for s, data in replies.get(ARCS, {}).items():
            stands[bounds[s] : bounds[s + 1]] = unpack_bits(split_parts(data)[1], bounds[s + 1] - bounds[s])
        held = states(token, before)
        n = len(held)
        count = np.bincount(np.searchsorted(held, token[trains]), minlength=n)
        followed = np.bincount(np.searchsorted(held, before[trains]), minlength=n)
        followers = np.bincount(np.searchsorted(held, before[at[stands]]), minlength=n)
        bounds = rounds.shard_bounds(held, shards)
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                yield s, STATES, join_parts(
                    pack(held[a:b], True), pack(count[a:b]), pack(followed[a:b]), pack(followers[a:b])
                )

    def merge_states(_shard, rows):
        parts = [split_parts(r[2]) for r in rows]
        codes = [unpack(p[0], True) for p in parts]
        code, number = np.unique(np.concatenate(codes), return_inverse=True)
        totals = [
            np.bincount(number, weights=np.concatenate([unpack(p[k]) for p in parts]), minlength=len(code)).astype(
                np.uint64
            )
            for k in (1, 2, 3)
        ]
        cut = np.cumsum([len(c) for c in codes])[:-1]
        for (b, _, _), *answers in zip(rows, *[np.split(t[number], cut) for t in totals]):
            yield b, STATES, join_parts(*[pack(a) for a in answers])
        # token total and distinct tokens of this shard, summed over the shards below
        yield -1, TOTALS, b"%d %d" % (int(totals[0].sum()), int((totals[0] > 0).sum()))

    def score(block, replies):
        token, before, doc, counts, out, _, code, _, _ = arcs(block)
        held = states(token, before)
        total, distinct = map(int, replies[TOTALS][-1].split())
        arc_bounds = rounds.shard_bounds(code, shards)
        arc_count = np.zeros(len(code), dtype=np.uint64)
        for s, data in replies.get(ARCS, {}).items():
            arc_count[arc_bounds[s] : arc_bounds[s + 1]] = unpack(split_parts(data)[0])
        automaton = BackoffAutomaton(
            (held, *heard(replies, STATES, rounds.shard_bounds(held, shards), 3)), (code, arc_count), total, distinct
        )
        known, base = automaton.root_probability(token)
        n = len(counts)
        base, whole = np.log10(base), automaton.traverse(token, before)
        # bincount gives whole numbers where a block has no documents
        sums = [np.bincount(doc, x, minlength=n).astype(np.float64) for x in (base, whole)]
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "held_out": pa.array(out),
                "n_tokens": pa.array(counts, pa.int64()),
                "n_known": pa.array(np.bincount(doc[known > 0], minlength=n), pa.int64()),
                "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": pa.array(sums[0]),
                "score": pa.array(sums[1]),
            }
        )

    arc_replies = rounds.answer(rounds.ask(blocks, None, send_arcs), merge_arcs)
    state_replies = rounds.answer(rounds.ask(blocks, arc_replies, send_states), merge_states)
    text = F.col("data").cast("string")
    corpus = (
        state_replies.filter(F.col("blk") == -1)
        .select(F.split(text, " ").cast("array<bigint>").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n")[0]), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n")[1]), F.lit(0)).alias("distinct"))
    )
    totals = (
        docs.sparkSession.range(shards)
        .crossJoin(F.broadcast(corpus))  # one row
        .select(
            F.col("id").cast("int").alias("blk"),
            F.lit(-1).alias("shard"),
            F.lit(TOTALS).alias("part"),
            F.concat_ws(" ", "total", "distinct").cast("binary").alias("data"),
        )
    )
    replies = arc_replies.unionByName(state_replies.filter(F.col("blk") >= 0)).unionByName(totals)
    return rounds.finish(blocks, replies, score, SCHEMA)
