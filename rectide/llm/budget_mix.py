"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.llm.keys import row_key
from rectide.session import cut_lineage

#: Largest remaining budget that the exact dynamic programme takes over (words),
#: unless a single document is longer.
DP_WORDS = 1 << 16
BIN_BITS = 12


def fit_budget(lengths: Iterable[tuple[int, int]], budget: int, dp_words: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come nearest to ``budget`` (ties: below).

    ``lengths`` holds (length, documents).  Of a budget beyond ``dp_words`` (or
    the longest length, if that is more) each length first gives its even share
    of the excess, and whole documents, the longest first, what rounding leaves
    of it.  A bounded knapsack over bit sets fits the remaining budget with the
    remaining documents, exactly where some subset does.
    """
    stock = {int(n): int(c) for n, c in lengths if n > 0 and c > 0}
    total = sum(n * c for n, c in stock.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return stock
    reach = max(dp_words, max(stock))
    taken = {n: c * max(0, budget - reach) // total for n, c in stock.items()}
    left = budget - sum(n * k for n, k in taken.items())
    for n in sorted(stock, reverse=True):
        if left <= reach:
            break
        k = min(stock[n] - taken[n], -(-(left - reach) // n))
        taken[n] += k
        left -= n * k

    items: list[tuple[int, int]] = []
    above = left + max(stock)  # one document may overshoot, where that is nearer
    full = (1 << (above + 1)) - 1
    states = [1]
    for n in sorted(stock):
        spare, step = min(stock[n] - taken[n], above // n), 1
        while spare > 0 and not states[-1] >> left & 1:
            k = min(step, spare)
            items.append((n, k))
            states.append((states[-1] | states[-1] << (n * k)) & full)
            spare -= k
            step *= 2
        if states[-1] >> left & 1:
            break
    at = (states[-1] & ((1 << (left + 1)) - 1)).bit_length() - 1
    over = states[-1] >> (left + 1)
    if over and (more := (over & -over).bit_length()) < left - at:
        at = left + more
    for (n, k), before in zip(reversed(items), reversed(states[:-1])):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken


def source_targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size): weights 1, 2, 3, 1, ... by code point, null last.

    The targets share the total in proportion to the weights, none above
    ``repeats`` times its source's size: with the sources in order of that cap
    per weight, the common level is where the rest first fits under the caps.
    One row per source; the only single-task windows run over these.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_per_weight", "place")
    whole = Window.partitionBy()
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", (F.col("place") - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped_before", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn("weight_after", F.sum("weight").over(whole) - F.sum("weight").over(by_cap) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_after"))
        .withColumn("level", F.max("level").over(whole))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def budget_mix(docs: DataFrame, repeats: int = 3, seed: int = 42, dp_words: int = DP_WORDS) -> DataFrame:
    """How many words of each document a mix of the sources to their targets takes.

    A source whose target is w times its size and some more takes all its
    documents w times and fits the remaining budget with one more copy of some:
    ``fit_budget`` decides on the counts per exact length (one row per source
    and length), a seeded hash decides which documents of a length.

    Gives doc_id, row_key (digest of id, text and source), size (words, runs other than space and \\x09-\\x0D; null text:
    0), source_size, target, copies, taken (copies * size).  A null source is a
    source, the last one.  Empty texts take no words and have no copies.  The
    choice within one length orders by a hash of the whole row in hash bins, so a length
    that a third of all documents share is split; repeated rows are separate
    documents.  An empty table gives no rows; other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size.cast("long").alias("size"),
            row_key("doc_id", "text", "source").alias("row_key"),
        )
        .withColumn("order", F.xxhash64(F.lit(seed), "row_key"))
        .withColumn("bin", F.shiftrightunsigned("order", 64 - BIN_BITS).cast("int"))
    )
    targets = source_targets(rows, repeats).withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0),
    ).withColumn(
        "budget", F.greatest(F.lit(0.0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
    )
    targets = cut_lineage(targets)
    bins = rows.filter("size > 0").groupBy("source", "size", "bin").agg(F.count("*").alias("n"))
    lengths = bins.groupBy("source", "size").agg(F.sum("n").alias("n"))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        chosen = fit_budget(zip(part["size"], part["n"]), int(part["budget"].iloc[0]), dp_words)
        return pd.DataFrame(
            {"source": part["source"], "size": part["size"], "extra": [chosen.get(int(s), 0) for s in part["size"]]}
        )

    # one row per exact length of a source, never one per document
    budgets = targets.filter("budget > 0").select(F.col("source").alias("of"), "budget")
    extra = (
        lengths.join(budgets, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .groupBy("source")
        .applyInPandas(fit, "source string, size long, extra long")
        .filter("extra > 0")
        .select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), "extra")
    )
    in_length = Window.partitionBy("source", "size").orderBy("bin")
    quota = (
        bins.join(extra, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")))
        .withColumn("before", F.sum("n").over(in_length) - F.col("n"))
        .select(
            F.col("source").alias("q_source"),
            F.col("size").alias("q_size"),
            F.col("bin").alias("q_bin"),
            F.least(F.col("n"), F.col("extra") - F.col("before")).alias("quota"),
        )
        .filter("quota > 0")
    )
    in_bin = Window.partitionBy("source", "size", "bin").orderBy("order", "row_key")
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole")
    return (
        rows.withColumn("place", F.row_number().over(in_bin))
        .join(
            quota,
            F.col("source").eqNullSafe(F.col("q_source"))
            & (F.col("size") == F.col("q_size"))
            & (F.col("bin") == F.col("q_bin")),
            "left",
        )
        .join(named, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn(
            "copies",
            F.when(F.col("size") > 0, F.col("whole") + (F.col("place") <= F.coalesce("quota", F.lit(0))).cast("long")).otherwise(0),
        )
        .select(
            "doc_id",
            "row_key",
            "size",
            "source_size",
            "target",
            F.col("copies").cast("long").alias("copies"),
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )
