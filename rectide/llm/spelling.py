"""Spelling variants: words one edit apart by search schemes over an FM-index of the vocabulary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.session import cut_lineage

#: Vocabulary words that one index holds on average.
SHARD_WORDS = 20_000
#: A half shared by more words than this has its words dealt over several indexes.
CELL_WORDS = 40_000
#: Search states that are extended at once.
_STATES = 1 << 18


def vocabulary(docs: DataFrame, noise: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words of ``docs``: see ``spelling_variants``."""
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # runs below the length are no words: passed over by the pattern, which still takes whole runs
    run = F.explode(F.regexp_extract_all(lowered, F.lit(f"([A-Za-zÀ-ÿ]{{{min_length},}})"), 1)).alias("run")
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id")
    runs = docs.select(doc_id, run).withColumn("size", F.length("run"))
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    runs = runs.withColumn("h", h).withColumn("cut", (F.col("h") % F.col("size")).cast("int"))
    word = F.when(F.col("h") % noise != 0, F.col("run")).otherwise(F.expr("concat(substring(run, 1, cut), substring(run, cut + 2))"))
    return (
        runs.filter((F.col("size") > min_length) | (F.col("h") % noise != 0))
        .groupBy(word.alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


class WordIndex:
    """FM-index of a delimited vocabulary: extends a pattern to the left by intervals of suffix ranks.

    Every word ends in its own delimiter, code 0, so that all suffixes differ; the
    first ranks are those of the delimiters alone.  ``keys`` holds code * size +
    rank of every character before a suffix, in order: the place of code * size +
    r among them is the rank to which r goes when the character is put in front.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: the words' characters (above 0), each word followed by a 0; ``ends``: places of the zeros."""
        n = self.size = len(codes)
        self.words = len(ends)
        rank = codes.astype(np.int64) + self.words  # delimiters are told apart by their word
        rank[ends] = np.arange(self.words)
        width = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (max(int(rank.max()), n) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            width *= 2
        before = codes[order - 1].astype(np.int64)  # place 0 has the last delimiter before it
        self.before = before
        self.keys = np.sort(before * n + np.arange(n))
        self.starts = np.searchsorted(self.keys, np.arange(int(codes.max()) + 2) * n)
        word_of = np.searchsorted(ends, order)
        self.word_of = word_of[self.keys[: self.words] % n]  # ranks of whole words, in the order of their keys

    def extend(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``code`` put in front; empty where there is none."""
        base = code * self.size
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the interval, code, low, high) of every character before the given intervals, each once."""
        width = high - low
        codes = len(self.starts) - 1
        wide = np.flatnonzero(width > codes)
        slim = np.flatnonzero(width <= codes)
        at = np.repeat(slim, width[slim])
        rows = np.arange(len(at)) - np.repeat(np.cumsum(width[slim]) - width[slim], width[slim]) + low[at]
        pair = np.unique(at * codes + self.before[rows])
        pair = np.concatenate([pair, (wide[:, None] * codes + np.arange(codes)).ravel()])
        pair.sort()
        at, code = pair // codes, pair % codes
        keep = code > 0
        at, code = at[keep], code[keep]
        first, last = self.extend(low[at], high[at], code)
        keep = first < last
        return at[keep], code[keep], first[keep], last[keep]

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, word) of the words that equal a pattern with its delimiter."""
        first, last = self.extend(low, high, np.zeros(len(low), dtype=np.int64))
        found = np.flatnonzero(first < last)
        return found, self.word_of[first[found]]


def search(index: WordIndex, queries: np.ndarray, size: np.ndarray, half: np.ndarray):
    """(query, word) with exactly one edit left of the exact half.

    ``queries``: codes by row from the last character on, ``size`` of them; the
    first ``half`` of a row match exactly, one edit follows among the rest or at
    its borders, the remainder matches exactly.  Queries in one state share its
    expansion; the states that have their edit move on together, a character at
    a time.
    """
    n = len(queries)
    low = np.zeros(n, dtype=np.int64)
    high = np.full(n, index.words, dtype=np.int64)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    edited = np.zeros((4, 0), dtype=np.int64)  # query, place to go on from, interval
    alive, at = np.arange(n), 0

    def advance(states):
        """One character further; complete ones go to ``found``, dead ones away."""
        who, place, first, last = states
        done = place >= size[who]
        if done.any():
            k, word = index.whole(first[done], last[done])
            found.append((who[done][k], word))
            who, place, first, last = states[:, ~done]
        first, last = index.extend(first, last, queries[who, place])
        return np.stack([who, place + 1, first, last])[:, first < last]

    while len(alive) or edited.shape[1]:
        grown = [advance(edited)]
        turn = alive[half[alive] <= at]
        if len(turn):
            state, member = np.unique(low[turn] * (index.size + 1) + high[turn], return_inverse=True)
            node, code, first, last = index.children(state // (index.size + 1), state % (index.size + 1))
            begin = np.searchsorted(node, np.arange(len(state) + 1))
            fan = begin[member + 1] - begin[member]
            for piece in _pieces(fan):
                n_new = fan[piece]
                who = np.repeat(turn[piece], n_new)
                child = np.arange(len(who)) + np.repeat(begin[member[piece]] - np.cumsum(n_new) + n_new, n_new)
                inserted = np.stack([who, np.full(len(who), at), first[child], last[child]])
                inside = at < size[who]
                replaced = inserted[:, inside][:, code[child[inside]] != queries[who[inside], at]] if inside.any() else inserted[:, :0]
                replaced[1] += 1
                grown += [advance(inserted), advance(replaced)]
            turn = turn[at < size[turn]]
            grown.append(advance(np.stack([turn, np.full(len(turn), at + 1), low[turn], high[turn]])))
        edited = np.concatenate(grown, axis=1)
        alive = alive[size[alive] > at]
        if len(alive):
            low[alive], high[alive] = index.extend(low[alive], high[alive], queries[alive, at])
            alive = alive[low[alive] < high[alive]]
        at += 1
    return found


def _pieces(fan: np.ndarray):
    """Slices of consecutive members whose children are about ``_STATES`` together."""
    total = np.cumsum(fan)
    begin = 0
    while begin < len(fan):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + _STATES)))
        yield slice(begin, end)
        begin = end


def _codes(words: list[str], letters: np.ndarray) -> list[np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    codes = np.searchsorted(letters, flat) + 1
    return np.split(codes, np.cumsum([len(w) for w in words])[:-1])


def one_edit_pairs(words: list[str], queries: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the pairs one edit apart whose exact half is the first (``left``) or the second.

    The halves of a query of L code points have L // 2 and L - L // 2.  The first
    half is matched on the index of the reversed words, extended to the right in
    the text; the second on the index of the words, extended to the left.
    """
    letters = np.unique(np.frombuffer("".join(words + queries).encode("utf-32-le"), dtype="<u4"))
    text = _codes(words, letters)
    if left:
        text = [t[::-1] for t in text]
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    flat = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    place = np.ones(len(flat), dtype=bool)
    place[ends] = False
    flat[place] = np.concatenate(text)
    index = WordIndex(flat, ends)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    begin = 0
    while begin < len(order):  # rows of a matrix have one width: bounded slices of similar lengths
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * len(queries[order[end]]) <= _STATES:
            end += 1
        part = np.array(order[begin:end])
        rows = _codes([queries[i] for i in part], letters)
        length = np.array([len(r) for r in rows])
        matrix = np.zeros((len(rows), int(length.max())), dtype=np.int64)
        for k, r in enumerate(rows):
            matrix[k, : len(r)] = r if left else r[::-1]
        half = length // 2 if left else length - length // 2
        found += [(part[q], w) for q, w in search(index, matrix, length, half)]
        begin = end
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
    return pairs[0], pairs[1]


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, near, near_n), once for each ordered pair of words one edit apart, of (word, n).

    A word as query goes, for each side, to the place of its exact half; as a text
    it goes to the places of the halves that a query one edit away may have.
    Places are hashed into shards of about ``shard_words`` words, each an FM-index
    of its own.  Places above ``cell_words`` words are cells of a grid: the words
    are dealt into parts, and every part of the queries meets every part of the
    texts, each pair of parts in an index of its own.
    """
    spark = words.sparkSession
    length = F.length("word")
    count = words.count()
    shards = max(1, -(-count * 4 // shard_words))
    sides = []
    for left in (True, False):
        own = F.floor(length / 2) if left else length - F.floor(length / 2)
        halves = F.array_distinct(
            F.array(*[F.floor((length + d) / 2) if left else length + d - F.floor((length + d) / 2) for d in (-1, 0, 1)])
        )
        half = F.expr("substring(word, 1, size)" if left else "substring(word, -size)")
        sides.append(
            words.select("word", "n", own.cast("int").alias("own"), F.explode(halves).alias("size"))
            .withColumn("size", F.col("size").cast("int"))
            .select("word", "n", F.lit(left).alias("left"), (F.col("own") == F.col("size")).alias("query"), "size", half.alias("half"))
        )
    placed = sides[0].unionByName(sides[1])
    place = ["left", "size", "half"]
    hot = (
        placed.groupBy(*place).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > cell_words)
        .withColumn("parts", F.ceil(F.col("held") / cell_words).cast("int")).drop("held")
    )
    # at most 4 * words / cell_words places
    placed = placed.join(F.broadcast(hot), place, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word", F.lit(1)), F.col("parts"))
    cells = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    as_text = placed.withColumn("row", cells).withColumn("column", part).withColumn("query", F.lit(False))
    as_query = placed.filter("query").withColumn("row", part).withColumn("column", cells)
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64(*place), F.lit(shards))).otherwise(F.xxhash64(*place, "row", "column"))
    dealt = as_text.unionByName(as_query).select("left", shard.alias("shard"), "query", "word", "n")

    def match(key, table):
        text = {w: n for w, n, q in zip(*[table.column(c).to_pylist() for c in ("word", "n", "query")]) if not q}
        queries = sorted({w for w, q in zip(table.column("word").to_pylist(), table.column("query").to_pylist()) if q})
        held = sorted(text)
        q, w = one_edit_pairs(held, queries, key[0].as_py()) if held and queries else ([], [])
        near = [held[i] for i in w]
        return pa.table(
            {
                "word": pa.array([queries[i] for i in q], pa.string()),
                "near": pa.array(near, pa.string()),
                "near_n": pa.array([text[x] for x in near], pa.int64()),
            }
        )

    found = dealt.groupBy("left", "shard").applyInArrow(match, "word string, near string, near_n long")
    return found.dropDuplicates(["word", "near"])


def spelling_variants(
    docs: DataFrame, ratio: int = 10, noise: int = 31, min_length: int = 7, min_count: int = 2, **sizes
) -> DataFrame:
    """Words with their more frequent spelling: word, n, n_near, form, form_n, root.

    Runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the texts are lowered in A-Z; where the
    crc32 of ``<doc_id>:<run>`` is divisible by ``noise``, the code point crc32 %
    length is deleted.  Words: the results of at least ``min_length`` code points
    and ``min_count`` occurrences (n).  Near: one inserted, deleted or replaced
    code point.  form: the near word of largest n (ties: smallest) if that n is at
    least ``ratio`` * n, else null; root: the last word reached by following forms.

    Words are counted with partial sums before the shuffle; near words come from
    bidirectional search schemes over sharded FM-indexes (``near_words``).  A form
    is ``ratio`` times as frequent as its word, so a chain has at most
    log(largest n / min_count) / log(ratio) links and is followed in so many joins.

    Null texts have no words; a null doc_id counts as ``null``.  Repeated rows
    count each.  Empty tables give no rows; other columns are not read.  Words of
    any length take part.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or chains of forms may not end")
    words = cut_lineage(vocabulary(docs, noise, min_length, min_count))
    best = F.struct((-F.col("near_n")).alias("order"), "near")
    near = near_words(words, **sizes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    variants = cut_lineage(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
            F.when(-F.col("best.order") >= ratio * F.col("n"), -F.col("best.order")).alias("form_n"),
        )
    )
    links = variants.filter("form IS NOT NULL").select(F.col("word").alias("root"), F.col("form").alias("next"))
    largest = variants.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    out = variants.withColumn("root", F.coalesce("form", "word"))
    for _ in range(int(math.log(max(1, largest / min_count), ratio) + 1e-9) - 1):
        out = out.join(links, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")
    return out.select("word", "n", "n_near", "form", "form_n", "root")
