"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.llm.components import components
from rectide.llm.keys import row_key
from rectide.llm.words import text_slices
from rectide.session import cut_lineage

SEED = 42


def simhash(text: bytes, shingle: int = 4) -> int:
    """64-bit majority fingerprint of the XXH64 hashes of the word shingles; no words: 0."""
    words = text.lower().split()  # bytes: A-Z only; splits at space and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        end = np.cumsum(sizes + 1) - 1
        begin = (end - sizes)[: n - shingle + 1].tolist()
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(begin, end[shingle - 1 :].tolist())]
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype=np.uint64).astype(">u8")
        votes += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row_key, fp): fp is the fingerprint as a signed long, row_key a digest of id and text."""

    def compute(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column("text")):
                fp = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
                n = end - begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, n), batch.column("row_key").slice(begin, n), pa.array(fp)],
                    names=["doc_id", "row_key", "fp"],
                )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("row_key", row_key("doc_id", "text"))
    return slim.mapInArrow(compute, "doc_id long, row_key string, fp long")


def _flips(bits: int, radius: int, shift: int = 0) -> list[int]:
    """Signed masks with at most ``radius`` of ``bits`` bits set."""
    masks = [sum(1 << (b + shift) for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variants(fps: DataFrame, distance: int, parts: int) -> DataFrame:
    """(part, variant, fp): each part of each fingerprint with all variants within half its radius."""
    width = 64 // parts
    rows = []
    for part in range(parts):
        keep = ((1 << width) - 1) << (part * width)
        keep = keep - (1 << 64) if keep >> 63 else keep
        flips = F.array(*[F.lit(m) for m in _flips(width, (distance // parts + 1) // 2, part * width)])
        rows.append(
            fps.select(
                F.lit(part).alias("part"),
                F.explode(flips).alias("flip"),
                "fp",
            ).select("part", F.col("fp").bitwiseAND(F.lit(keep)).bitwiseXOR(F.col("flip")).alias("variant"), "fp")
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _forests(batches, distance: int):
    """Verify all pairs of each list and give a spanning forest of those within ``distance`` bits."""
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for fps in batch.column("fps").to_pylist():
            held = np.sort(np.array(fps, dtype=np.int64))
            near = np.bitwise_count((held[:, None] ^ held[None, :]).view(np.uint64)) <= distance
            unseen = np.ones(len(held), dtype=bool)
            while unseen.any():
                todo = [int(np.argmax(unseen))]
                unseen[todo[0]] = False
                while todo:
                    at = todo.pop()
                    found = np.flatnonzero(near[at] & unseen)
                    unseen[found] = False
                    todo.extend(found[::-1].tolist())
                    edges.extend((int(held[at]), int(held[x])) for x in found)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(fps: DataFrame, distance: int = 4, parts: int = 2, bucket: int = 512) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``distance`` bits, directly or in chains.

    A fingerprint is cut into ``parts``; two within ``distance`` bits agree up to
    distance // parts bits in some part.  There each emits all variants within
    half that radius (rounded up), so both emit one in common; the rows are
    shuffled on the variant and colliding pairs are verified on all 64 bits.  Of
    the verified pairs of a variant a spanning forest is kept, fewer edges than
    members, so that a dense group gives no square of edges.
    With ``parts`` 1 this is the ball of half the whole radius.

    A variant with more than ``bucket`` fingerprints is not paired: its members
    emit the whole ball of half the whole radius instead, where any two that
    meet are within ``distance`` of each other, so each links to the smallest.
    """
    whole = (distance + 1) // 2

    def stars(members: DataFrame) -> DataFrame:
        by_variant = Window.partitionBy("variant").orderBy("fp")
        return (
            _variants(members, distance, 1)
            .withColumn("a", F.min("fp").over(by_variant.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .filter("a <> fp")
            .select("a", F.col("fp").alias("b"))
            .filter(_near("a", "b", distance))
            .distinct()
        )

    if parts == 1 and 2 * whole == distance:
        return stars(fps)
    by_variant = Window.partitionBy("part", "variant").orderBy("fp")
    shared = cut_lineage(
        _variants(fps, distance, parts)
        .withColumn("place", F.row_number().over(by_variant))
        .withColumn("alone", F.lead("fp").over(by_variant).isNull() & (F.col("place") == 1))
        .filter("not alone")
        .drop("alone")
    )
    crowded = shared.filter(F.col("place") == bucket + 1).select("part", "variant")
    small = shared.join(crowded, ["part", "variant"], "left_anti")
    lists = small.groupBy("part", "variant").agg(F.collect_list("fp").alias("fps"))  # at most ``bucket``
    pairs = lists.select("fps").mapInArrow(lambda batches: _forests(batches, distance), "a long, b long").distinct()
    members = shared.join(crowded, ["part", "variant"], "left_semi").select("fp").distinct()
    return pairs.unionByName(stars(members)).distinct()


def simhash_dedup(
    docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int = 2, bucket: int = 512
) -> DataFrame:
    """Components of documents whose SimHash fingerprints chain within ``distance`` bits.

    Texts are lowered in A-Z and cut into words (other than space and
    \\x09-\\x0D); a fingerprint bit is set if it is set in over half of the
    XXH64 hashes (seed 42) of the ``shingle``-word shingles, repeats included;
    fewer words make one shingle.  Links: see ``links``; only distinct
    fingerprints take part, so copies cost one row.

    Gives doc_id, row_key (digest of id and text), fingerprint (16 hex digits),
    component_id (smallest doc_id of the component; null ids are passed over)
    and root (smallest fingerprint of the component, as a signed long).
    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  One row for each input row; an empty table gives no rows; other
    columns are not read.
    """
    if distance % 2:
        raise ValueError("distance must be even: two balls of half the radius have to meet")
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), distance, parts, bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("named_fp"), "component_id", "root")
    return prints.join(named, F.col("fp") == F.col("named_fp")).select(
        "doc_id",
        "row_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
    )
