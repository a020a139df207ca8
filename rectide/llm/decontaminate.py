"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.llm.keys import row_key
from rectide.llm.words import ALNUM, Words, mix, text_slices, word_table
from rectide.session import cut_lineage

#: Cells of the shingle filter that document tasks hold (4 MB), whatever the benchmark's size.
FILTER_BITS = 25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window_text, n) distinct, and (window_text, item): the windows of each item."""
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(f"({_WORD})"), F.lit(1))
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")
    ).filter("size(w) > 0")
    held = (
        items.withColumn(
            "window",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))),
                    lambda i: F.slice("w", i, F.least(F.size("w"), F.lit(window))),
                )
            ),
        )
        .select(F.array_join("window", " ").alias("window_text"), F.size("window").alias("n"), "item")
        .distinct()
    )
    held = cut_lineage(held)
    return held.select("window_text", "n").distinct(), held.select("window_text", "item")


def _shingles(table: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts = table.window_starts(size)
    return starts, table.window_hash(starts, size, salt=size)


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_text, n, offset, size, code): the word shingles of each window."""

    def emit(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column("window_text")):
                table = word_table(texts, ALNUM)
                lengths = np.array(batch.column("n").slice(begin, end - begin))
                for size in range(1, shingle + 1):
                    starts, codes = _shingles(table, size)
                    doc = np.searchsorted(table.first, starts, side="right") - 1
                    use = np.minimum(lengths[doc], shingle) == size
                    doc, starts, codes = doc[use], starts[use], codes[use]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([texts[d] for d in doc], pa.binary()).cast(pa.string()),
                            pa.array(lengths[doc], pa.int32()),
                            pa.array(starts - table.first[doc], pa.int32()),
                            pa.array(np.full(len(doc), size), pa.int32()),
                            pa.array(codes.view(np.int64)),
                        ],
                        names=["window_text", "n", "offset", "size", "code"],
                    )

    return windows.mapInArrow(emit, "window_text string, n int, offset int, size int, code long")


def _filter(codes: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bit set of the cells of shingle codes, of a fixed size, and the shingle sizes in use."""
    cell = F.shiftrightunsigned("code", 64 - FILTER_BITS)
    words = (
        codes.groupBy(F.shiftright(cell, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
        .toArrow()  # at most 2**FILTER_BITS / 64 rows
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[np.array(words.column("word"), dtype=np.int64)] = np.array(words.column("bits"), dtype=np.int64).view(np.uint64)
    return out, sorted(r[0] for r in codes.select("size").distinct().collect())  # at most ``shingle`` rows


def _passing(codes: np.ndarray, held: np.ndarray) -> np.ndarray:
    cell = codes >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero(held[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1))


def shingle_counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(code, size, occurrences) in the whole corpus of the shingles that pass the benchmark's filter."""
    held, sizes = _filter(shingles)

    def count(batches):
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                table = word_table(texts, ALNUM, lower=True)
                for size in sizes:
                    _, codes = _shingles(table, size)
                    codes, number = np.unique(codes[_passing(codes, held)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.view(np.int64)), pa.array(np.full(len(codes), size), pa.int32()), pa.array(number)],
                        names=["code", "size", "occurrences"],
                    )

    return (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(count, "code long, size int, occurrences long")
        .groupBy("code", "size")
        .agg(F.sum("occurrences").alias("occurrences"))
    )


def prefix_tokens(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """(code, size, offset, window_text, n): the rarest shingle of each window that can occur.

    A contained window has all its shingles in the document, so one necessary
    prefix token is enough: the first in the order of corpus rarity (ties: the
    smallest offset).  A window with a shingle that no document holds cannot
    occur and is left out.
    """
    shingles = cut_lineage(window_shingles(windows, shingle))
    counts = shingle_counts(docs, shingles)
    ranked = (
        shingles.join(counts, ["code", "size"], "left")
        .groupBy("window_text", "n")
        .agg(
            F.min(F.struct(F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "offset", "code", "size")).alias("t")
        )
    )
    return cut_lineage(ranked.filter("t.occurrences > 0").select("t.code", "t.size", "t.offset", "window_text", "n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Find the benchmark's windows in documents.

    Texts are lowered in A-Z; words are runs of digits, a-z and non-ASCII
    characters.  A window is ``window`` consecutive words of an item, or all
    words of a shorter one; a document word inside any occurrence of a window is
    hit.  Set join: each window is looked for by its rarest ``shingle``-word
    shingle alone (``prefix_tokens``); an occurrence of that token at word p
    implies the window at p - offset, which must lie within the document
    (position and length bounds) and is then verified word by word.  Document
    tasks hold only a bit set of fixed size for the tokens; the tokens
    themselves are joined.

    Gives doc_id, row_key (digest of id and text), n_words, n_hit, n_items (items
    with occurring windows), items_sha256 (of their ids as strings, sorted,
    comma-joined; none: of the empty string), contaminated.  Null, empty and
    wordless texts have no words; items without words have no windows; a null
    item_id counts as the empty string.  One row for each input row, repeated
    ones too; an empty documents table gives no rows, an empty benchmark hits
    nothing; other columns are not read.
    """
    windows, items = benchmark_windows(benchmark, window)
    tokens = prefix_tokens(docs, windows, shingle)
    held, sizes = _filter(tokens)

    def find(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column("text")):
                table = word_table(texts, ALNUM, lower=True)
                rows: list[list[dict]] = [[] for _ in texts]
                for size in sizes:
                    starts, codes = _shingles(table, size)
                    for i in _passing(codes, held).tolist():
                        at = int(starts[i])
                        d = int(np.searchsorted(table.first, at, side="right")) - 1
                        low, high = max(int(table.first[d]), at - window), min(int(table.first[d + 1]), at + window)
                        near = [table.raw[table.starts[j] : table.ends[j]].decode("utf-8", "replace") for j in range(low, high)]
                        first = int(table.first[d])
                        rows[d].append(
                            {"code": int(codes[i].view(np.int64)), "size": size, "at": at - first, "low": low - first, "near": near}
                        )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, end - begin),
                        batch.column("row_key").slice(begin, end - begin),
                        pa.array(table.counts, pa.int64()),
                        pa.array(rows, _HITS),
                    ],
                    names=["doc_id", "row_key", "n_words", "hits"],
                )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("row_key", row_key("doc_id", "text"))
    found = cut_lineage(
        slim.mapInArrow(
            find,
            "doc_id long, row_key string, n_words long, "
            "hits array<struct<code: long, size: int, at: int, low: int, near: array<string>>>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    start = (F.col("at") - F.col("offset")).alias("start")
    occurrences = cut_lineage(
        found.select("row", "n_words", F.explode("hits").alias("h"))
        .select("row", "n_words", "h.*")
        .join(tokens, ["code", "size"])
        .select("row", "n_words", start, "n", "low", "near", "window_text")
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
        .filter(F.array_join(F.slice("near", F.col("start") - F.col("low") + 1, F.col("n")), " ") == F.col("window_text"))
        .select("row", "start", "n", "window_text")
        .distinct()
    )
    hit = (
        occurrences.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("word"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    named = (
        occurrences.select("row", "window_text")
        .distinct()
        .join(items, "window_text")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.select("doc_id", "row_key", "n_words", "row")
        .join(hit, "row", "left")
        .join(named, "row", "left")
        .select(
            "doc_id",
            "row_key",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


_HITS = pa.list_(
    pa.struct(
        [("code", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("near", pa.list_(pa.string()))]
    )
)
