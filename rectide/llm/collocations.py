"""Phrase collocations from a vertically partitioned, depth-truncated suffix tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.llm.words import Words, join_parts, mix, pack, span_hash, split_parts, text_slices, unpack, word_digest, word_table
from rectide.session import cut_lineage

#: Words are runs of class 1; of the bytes between them those of ``_BREAK`` also end a piece.
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 0
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_CLASS[_BREAK] = 0

#: Words in the dictionary that every task holds, 24 bytes each: the most frequent ones.
DICTIONARY = 1 << 20
#: Suffixes that one group of prefixes may hold.
GROUP_SUFFIXES = 2 << 20
#: Bytes of text from which one message per group is made.
SLICE_BYTES = 3 << 20
#: Codes from here on are digests of words that are not in the dictionary.
_UNLISTED = np.uint64(1 << 62)


def _batches(batches):
    """(lang, word table, number of the piece of each word) of bounded slices of documents of one language."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang):
        texts = held.pop(lang)
        size.pop(lang)
        table = word_table(texts, _CLASS, lower=True)
        breaks = np.flatnonzero(_BREAK[np.frombuffer(table.raw, np.uint8)])  # fewer than the bytes by far
        piece = np.searchsorted(breaks, table.starts) + np.repeat(np.arange(len(texts)), table.counts)  # a new text is a new piece
        return lang, table, piece

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for begin, end, texts in text_slices(batch.column("text"), SLICE_BYTES):
            for lang, text in zip(langs[begin:end], texts):
                lang = "und" if lang is None else lang
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= SLICE_BYTES:
                    yield flush(lang)
            if sum(size.values()) >= 4 * SLICE_BYTES:  # many languages
                for lang in list(held):
                    yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of all documents; null lang is ``und``."""

    def count(batches):
        for lang, table, _ in _batches(batches):
            if not len(table.hashes):
                continue
            one, two = table.hashes, table.digest(1)
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            first = order[new]
            words = [table.raw[a:b] for a, b in zip(table.starts[first].tolist(), table.ends[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(np.diff(np.append(new, len(one))), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )

    return _slim(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _lang_seed(lang: str) -> tuple[np.uint64, np.uint64]:
    raw = lang.encode()
    ends = np.array([len(raw)])
    return tuple(word_digest(raw, np.zeros(1, np.int64), ends, salt)[0] for salt in (5, 6))


class Dictionary:
    """Codes of the most frequent words of all languages, by two digests of lang and word.

    A listed word's code is its place in the order of the digests plus 1, 0 is no
    word.  If the dictionary is complete, any other word is known to be rarer
    than ``min_count`` and ends a phrase; if not, its code is a 62-bit digest.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray, counts: np.ndarray, complete: bool):
        order = np.argsort(one)
        self.one, self.two, self.counts, self.complete = one[order], two[order], counts[order], complete

    @staticmethod
    def keys(lang: str, table: Words) -> tuple[np.ndarray, np.ndarray]:
        a, b = _lang_seed(lang)
        return mix(table.hashes + a, 1), mix(table.digest(1) + b, 2)

    def codes(self, lang: str, table: Words) -> np.ndarray:
        return self.look_up(*self.keys(lang, table))

    def look_up(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), dtype=np.uint64) if self.complete else _UNLISTED | (two >> np.uint64(2))
        if len(self.one):
            at = np.searchsorted(self.one, one)
            at[at == len(self.one)] = 0
            found = (self.one[at] == one) & (self.two[at] == two)
            out[found] = at[found].astype(np.uint64) + np.uint64(1)
        return out


def _keyed(counts: DataFrame) -> DataFrame:
    """(lang, word, n, one, two): the words with the digests of ``Dictionary.keys``."""

    def keyed(batches):
        for batch in batches:
            words = [w.encode() for w in batch.column("word").to_pylist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            raw, ends = b"".join(words), np.cumsum(size)
            langs = batch.column("lang").to_pylist()
            seeds = {lang: _lang_seed(lang) for lang in set(langs)}
            one, two = (
                mix(word_digest(raw, ends - size, ends, i) + np.array([seeds[x][i] for x in langs], np.uint64), i + 1)
                for i in (0, 1)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=["lang", "word", "n", "one", "two"],
            )

    return counts.select("lang", "word", "n").mapInArrow(keyed, "lang string, word string, n long, one long, two long")


def _dictionary(frequent: DataFrame, size: int) -> Dictionary:
    """The ``size`` most frequent words; no more rows reach the driver."""
    table = frequent.orderBy(F.desc("n"), "one", "two").limit(size + 1).select("one", "two", "n").toArrow()
    one, two, n = (np.array(table.column(i), dtype=np.int64)[:size] for i in range(3))
    return Dictionary(one.view(np.uint64), two.view(np.uint64), n, table.num_rows <= size)


def _coded(frequent: DataFrame, dictionary) -> DataFrame:
    """(lang, word, code): the code as it is in a path."""

    def coded(batches):
        for batch in batches:
            one, two = (np.array(batch.column(c), dtype=np.int64).view(np.uint64) for c in ("one", "two"))
            code = [x.tobytes() for x in dictionary.value.look_up(one, two).astype(">u8").reshape(-1, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("word"), pa.array(code, pa.binary())], names=["lang", "word", "code"]
            )

    return frequent.mapInArrow(coded, "lang string, word string, code binary")


def _paths(codes: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """The suffix at each word, cut at ``depth`` words, the end of its piece and words of code 0."""
    # four bytes a word where the codes fit, as those of a complete dictionary do
    out = np.zeros((len(codes), depth), dtype=np.uint32 if int(codes.max(initial=0)) < 1 << 32 else np.uint64)
    alive = codes > 0
    out[:, 0] = codes
    for k in range(1, depth):
        n = len(codes) - k
        if n <= 0:
            break
        alive = alive[:n] & (piece[k:] == piece[:n]) & (codes[k:] > 0)
        out[:n, k] = np.where(alive, codes[k:], 0)
    return out[codes > 0]


def _sorted(paths: np.ndarray) -> np.ndarray:
    """Order of the rows; several columns are sorted as one where their bits fit."""
    width = max(1, int(paths.max()).bit_length())
    each = max(1, 63 // width)
    keys = []
    for begin in range(0, paths.shape[1], each):
        key = paths[:, begin].astype(np.uint64)
        for k in range(begin + 1, min(begin + each, paths.shape[1])):
            key <<= np.uint64(width)
            key |= paths[:, k]
        keys.append(key)
    return np.lexsort(keys[::-1])


def _collapse(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and how often each occurs."""
    paths = paths[_sorted(paths)]
    differs = np.ones(len(paths), dtype=bool)
    differs[1:] = paths[1:, 0] != paths[:-1, 0]
    for k in range(1, paths.shape[1]):
        differs[1:] |= paths[1:, k] != paths[:-1, k]
    new = np.flatnonzero(differs)
    return paths[new], np.diff(np.append(new, len(paths)))


def _prefix_hash(paths: np.ndarray, depth: int) -> np.ndarray:
    flat = np.ascontiguousarray(paths[:, :depth], dtype=np.uint64).ravel()
    starts = np.arange(len(paths)) * depth
    return mix(span_hash(mix(flat, 9), starts, starts + depth), depth)


class Partition:
    """Vertical partition: word prefixes grouped so that no group holds much over ``budget`` suffixes.

    One-word prefixes are grouped in dictionary order by their counts (unlisted
    words by digest).  A prefix above the budget is extended by a word, again and
    again up to the depth, and its extensions are spread by digest over as many
    groups as its count asks for.  ``hot[d]`` holds the digests of the prefixes of
    d + 1 words above the budget with their counts: at most total / budget each.
    """

    def __init__(self, counts: np.ndarray, total: int, budget: int):
        self.budget = budget
        self.groups = max(1, -(-total // budget))
        self.group = np.cumsum(np.minimum(counts, budget)) // budget
        self.hot: list[tuple[np.ndarray, np.ndarray]] = []

    def assign(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, length of the prefix that the group was chosen by) of each suffix."""
        first = paths[:, 0].astype(np.uint64)
        listed = first < _UNLISTED
        group = (mix(first, 21) % np.uint64(self.groups)).astype(np.int64)
        group[listed] = self.group[first[listed].astype(np.int64) - 1]
        length = np.ones(len(paths), dtype=np.int64)
        live = np.arange(len(paths))
        for d, (codes, counts) in enumerate(self.hot, 1):
            if not len(codes) or not len(live):
                break
            own = _prefix_hash(paths[live], d)
            at = np.searchsorted(codes, own)
            at[at == len(codes)] = 0
            is_hot = codes[at] == own
            live, at, own = live[is_hot], at[is_hot], own[is_hot]
            fan = (counts[at] // self.budget + 1).astype(np.uint64)
            longer = _prefix_hash(paths[live], d + 1)
            base = mix(own, 22) % np.uint64(self.groups)
            group[live] = ((base + mix(longer, 23) % fan) % np.uint64(self.groups)).astype(np.int64)
            length[live] = d + 1
        return group, length


def _hot_prefixes(docs: DataFrame, dictionary, partition: Partition) -> tuple[np.ndarray, np.ndarray]:
    """Digests and counts of the extensions by one word of the longest hot prefixes that are above the budget too."""
    depth = len(partition.hot) + 1
    known = partition.hot[-1][0]

    def count(batches):
        for lang, table, piece in _batches(batches):
            paths = _paths(dictionary.value.codes(lang, table), piece, depth)
            own = _prefix_hash(paths, depth - 1)
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            codes, n = np.unique(_prefix_hash(paths[known[at] == own], depth), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], names=["code", "n"])

    found = _slim(docs).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = found.filter(F.col("n") > partition.budget).toArrow()  # at most total / budget rows
    codes = np.array(table.column("code"), dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], np.array(table.column("n"), dtype=np.int64)[order]


def partition_prefixes(docs: DataFrame, dictionary, total: int, budget: int, depth: int) -> Partition:
    partition = Partition(dictionary.value.counts, total, budget)
    hot = np.flatnonzero(dictionary.value.counts > budget)
    codes, counts = _prefix_hash((hot + 1).astype(np.uint64).reshape(-1, 1), 1), dictionary.value.counts[hot]
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    while len(codes):
        partition.hot.append((codes, counts))
        if len(partition.hot) == depth - 1:
            break
        codes, counts = _hot_prefixes(docs, dictionary, partition)
    return partition


def subtree_counts(paths: np.ndarray, counts: np.ndarray, length: np.ndarray, min_count: int):
    """(path, n) of the nodes of the suffix subtree over ``paths``, by leaf totals.

    A node of fewer words than the prefix of its group has leaves elsewhere too:
    its part is given whatever its size; any other node if it has ``min_count``.
    """
    order = _sorted(paths)
    paths, counts, length = paths[order], counts[order], length[order]
    differs = np.zeros(len(paths), dtype=bool)
    differs[0] = True
    for depth in range(1, paths.shape[1] + 1):
        differs[1:] |= paths[1:, depth - 1] != paths[:-1, depth - 1]
        first = np.flatnonzero(differs)
        total = np.add.reduceat(counts, first)
        part = np.maximum.reduceat(length, first) > depth
        keep = (paths[first, depth - 1] > 0) & (part | (total >= min_count))
        yield np.ascontiguousarray(paths[first[keep], :depth]), total[keep]


def phrase_counts(docs: DataFrame, dictionary, partition: Partition, depth: int, min_count: int) -> DataFrame:
    """(path, n) of all phrases of up to ``depth`` words with ``min_count`` occurrences.

    ``path`` holds the codes of the words, 8 bytes each; a code belongs to one
    language.  Every slice of documents sends each group its distinct suffixes
    once; every group's subtree is built by itself; the parts of nodes above the
    prefix of a group are summed.
    """

    code_type = np.uint32 if dictionary.value.complete and len(dictionary.value.one) < 1 << 32 else np.uint64

    def send(batches):
        for lang, table, piece in _batches(batches):
            codes = dictionary.value.codes(lang, table)
            if not codes.any():
                continue
            paths, counts = _collapse(_paths(codes, piece, depth))  # freed there once it is sorted
            group, length = partition.assign(paths)
            order = np.argsort(group, kind="stable")
            rows = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
            data = [
                join_parts(pack(counts[r]), pack(length[r]), *[pack(paths[r, k]) for k in range(depth)]) for r in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(group[r[0]]) for r in rows], pa.int64()), pa.array(data, pa.binary())], names=["grp", "data"]
            )

    def build(table):
        parts = [split_parts(data) for data in table.column("data").to_pylist()]
        size = [int.from_bytes(p[0][:8], "little") for p in parts]  # ``pack`` begins with it
        at = np.cumsum([0, *size])
        counts, length = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        paths = np.empty((at[-1], depth), code_type)  # filled in place: no second copy of a group
        for p, a, b in zip(parts, at[:-1], at[1:]):
            counts[a:b], length[a:b] = unpack(p[0]), unpack(p[1])
            for k in range(depth):
                paths[a:b, k] = unpack(p[k + 2])
        nodes = subtree_counts(paths, counts, length, min_count)
        del parts, paths, counts, length  # the sorted copies are enough
        found = []
        for rows, n in nodes:
            width = 8 * rows.shape[1]
            offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
            path = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.astype(">u8").tobytes())])
            found.append(pa.table({"path": path, "n": pa.array(n, pa.int64())}))
        return pa.concat_tables(found)

    nodes = _slim(docs).mapInArrow(send, "grp long, data binary").groupBy("grp").applyInArrow(build, "path binary, n long")
    return nodes.groupBy("path").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _scored(nodes: DataFrame, words: DataFrame, totals: DataFrame, scale: int, cover: int) -> DataFrame:
    """Candidates that no longer one covers, with language, phrase, parts and score of the weakest cut."""
    size = (F.octet_length("path") / 8).cast("int")
    candidates = nodes.filter(F.octet_length("path") > 8).withColumn("size", size).withColumnRenamed("n", "a")
    inner = F.array(F.expr("substring(path, 1, 8 * size - 8)"), F.expr("substring(path, 9)"))
    longer = (
        candidates.filter("size > 2").select(F.explode(inner).alias("path"), F.col("a").alias("longer"))
        .groupBy("path").agg(F.max("longer").alias("longer"))
    )
    kept = candidates.join(longer, "path", "left").filter(f"longer IS NULL OR 100 * longer < {cover} * a").drop("longer")
    spelled = (
        kept.select("path", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
        .withColumn("code", F.expr("substring(path, 8 * at + 1, 8)"))
        .join(words.select("code", "lang", "word"), "code")
        .groupBy("path")
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("path", "lang", F.array_join(F.col("w.word"), " ").alias("phrase"))
    )
    cuts = (
        kept.select("path", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .withColumn("first", F.expr("substring(path, 1, 8 * k)"))
        .withColumn("rest", F.expr("substring(path, 8 * k + 1)"))
        .join(nodes.select(F.col("path").alias("first"), F.col("n").alias("l")), "first")
        .join(nodes.select(F.col("path").alias("rest"), F.col("n").alias("r")), "rest")
    )
    whole = "cast({} as decimal(19, 0))".format
    score = f"({whole(f'{scale} * a')} * {whole('n')}) div ({whole('l')} * {whole('r')})"
    return (
        cuts.join(spelled, "path").join(totals, "lang")
        .withColumn("score", F.expr(score))
        .groupBy("path")
        .agg(
            F.min(F.struct("score", "k", "l", "r")).alias("cut"),
            *[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")],
        )
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def collocations(
    docs: DataFrame,
    max_words: int = 5,
    min_count: int = 100,
    scale: int = 1000,
    cover: int = 100,
    top: int | None = 2000,
    dictionary_words: int = DICTIONARY,
    group_suffixes: int = GROUP_SUFFIXES,
) -> DataFrame:
    """Phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
    those into words ``[^\\x20\\x09]+``.  n: word occurrences of the language; f:
    contiguous occurrences within pieces, overlaps included.  A candidate has 2 to
    ``max_words`` words and a = f >= ``min_count``; cut after k words into parts of
    l and r occurrences it scores floor(scale * a * n / (l * r)); the lowest cut
    counts, ties to the smallest k.  Candidates contained in a longer one with
    100 * f >= cover * a are dropped (a part occurs at least as often as the
    whole, so the candidates one word longer decide).  The first ``top`` of each
    language by score and a (descending) and phrase (bytes) are given; None: all.

    Counting: (1) words are counted and the ``dictionary_words`` most frequent get
    codes; (2) word prefixes are grouped by the budget ``group_suffixes``, those
    above it extended word by word after counting them (``Partition``); (3) every
    slice of documents sends each group its distinct suffixes of ``max_words``
    words; (4) each group sorts its suffixes, the leaves of its subtree, and reads
    the counts of all nodes from the leaf totals.  Words rarer than ``min_count``
    are in no candidate and end a suffix if the dictionary holds all others; else
    unlisted words are carried by a 62-bit digest, to the same result.

    Null lang: ``und``.  Null or empty texts have no words; words of any length
    count.  Repeated rows count each.  An empty table, or one without candidates,
    gives no rows; other columns are not read.  Products are decimals of 38 digits.
    """
    spark = docs.sparkSession
    counted = cut_lineage(word_counts(docs))
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = _keyed(counted.filter(F.col("n") >= min_count))
    dictionary = spark.sparkContext.broadcast(_dictionary(frequent, dictionary_words))  # 24 bytes a word at most
    total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    partition = partition_prefixes(docs, dictionary, total, group_suffixes, max_words)
    nodes = cut_lineage(phrase_counts(docs, dictionary, partition, max_words, min_count))
    scored = _scored(nodes, _coded(frequent, dictionary), totals, scale, cover)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
