"""Quality rules of documents and, with an empirical beta prior, of their hosts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectide.llm.words import text_slices
from rectide.session import cut_lineage

_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = re.compile("[#*$%&|<>]")

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        number = Counter(windows)
        if len(number) < len(windows):
            end = 0
            for i, window in enumerate(windows):
                if number[window] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup_lines, repeated


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the five counts of every document."""

    def count(batches):
        for batch in batches:
            text = batch.column("text")
            for begin, end, texts in text_slices(text):
                rows = [rule_counts(t.decode("utf-8", "replace")) for t in texts]
                columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), batch.column("source").slice(begin, end - begin)]
                    + [pa.array(c) for c in columns],
                    names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
                )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    return slim.mapInArrow(count, "doc_id long, source string, " + COUNTS)


def host_rates(documents: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_shrunk, prior_mean, prior_sd) from rows (source, base_failed).

    The prior Beta(a, b) has the mean of the hosts' rates and their variance
    between hosts, by the method of moments; with fewer than two hosts, or no
    spread beyond what a binomial gives, its weight a + b is the mean number of
    documents of a host.  A host's rate is shrunk to (failed + a) / (docs + a + b).
    """
    hosts = (
        documents.groupBy(F.col("source").alias("host"))
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
        .withColumn("host_rate", F.col("host_failed") / F.col("host_docs"))
    )
    prior = hosts.agg(
        F.avg("host_rate").alias("m"),
        F.var_pop("host_rate").alias("v"),
        F.avg(1 / F.col("host_docs")).alias("per_doc"),
        F.avg("host_docs").alias("mean_docs"),
    ).select(
        "m",
        # variance of the rates less the binomial part that small hosts add to it
        F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("per_doc"), F.lit(0.0)).alias("between"),
        "mean_docs",
    ).select(
        "m",
        F.when(F.col("between") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("between") - 1, F.lit(1e-6)))
        .otherwise(F.col("mean_docs"))
        .alias("strength"),
    )
    return hosts.crossJoin(F.broadcast(prior)).select(  # one row
        "host",
        "host_docs",
        "host_failed",
        "host_rate",
        ((F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))).alias(
            "host_shrunk"
        ),
        F.col("m").alias("prior_mean"),
        F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("strength") + 1)).alias("prior_sd"),
    )


def host_rules(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_host_rate: float | None = None,
    deviations: float = 3.0,
) -> DataFrame:
    """Judge documents by their own counts and by their host's shrunk failure rate.

    The host of a document is its ``source``; null is a host.  ``base_failed``:
    fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent
    of the words in 3-word windows that the text holds twice or more.  Hosts
    whose shrunk failure rate (``host_rates``) exceeds ``max_host_rate`` lose all
    their documents; the others keep those that did not fail themselves.  Without
    a ``max_host_rate`` the limit comes from the fitted prior: its mean and
    ``deviations`` times its standard deviation, so that a host is judged against
    what hosts of this corpus are like.

    Gives doc_id, n_words, word_chars (code points), n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, host, host_shrunk.  Null or empty text:
    all counts zero, failed.  Rows are judged one by one, also repeated ones; an
    empty table gives no rows; other columns are not read.  The failures of a
    host are summed before the shuffle; counts are read once and checkpointed.
    """
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    counted = cut_lineage(document_counts(docs).withColumn("base_failed", failed))
    hosts = host_rates(counted)
    limit = F.col("prior_mean") + deviations * F.col("prior_sd") if max_host_rate is None else F.lit(max_host_rate)
    return counted.join(
        hosts.select("host", "host_shrunk", limit.alias("host_limit")), F.col("source").eqNullSafe(F.col("host"))
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("host_shrunk") <= F.col("host_limit"))).alias("kept"),
        F.col("source").alias("host"),
        "host_shrunk",
    )
