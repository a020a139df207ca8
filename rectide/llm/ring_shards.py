"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectide.session import cut_lineage

#: Ring positions are 63-bit; the top BIN_BITS of one name its bin.
BIN_BITS = 16
RANK_BLOCKS = 4096


def ring_points(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """(pos, shard) of every virtual node; a shard's points do not depend on the others."""
    return spark.range(shards * virtual_nodes).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), (F.col("id") / virtual_nodes).cast("long"), F.col("id") % virtual_nodes), 1).alias("pos"),
        (F.col("id") / virtual_nodes).cast("long").alias("shard"),
    )


def ring_shards(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Place documents on shards 0..shards-1 by a hash ring with bounded loads.

    A document's ring position is a hash of its doc_id; it belongs to the next
    virtual node clockwise.  Documents arrive in ring order; one that finds its
    shard full goes on clockwise to the next node whose shard has room.  With
    ``slack`` 0 the capacities are the total dealt out evenly (the first
    ``total mod shards`` shards hold one more), so row counts differ by at most
    one; with a positive slack every shard holds ceil((1 + slack) * total /
    shards) and fewer documents move when a shard is added.

    As overflow keeps arrival order, every node accepts a run of consecutive
    ring ranks: the walk needs only the number of documents before each node
    (shards * virtual_nodes rows, a parameter, in one array), and documents look
    their rank up.  Ranks come from counts of 2**16 ring bins plus a row number
    inside a bin.

    Gives doc_id, size (UTF-8 bytes of the text plus 16; null text: 16),
    text_crc32 (null text: that of the empty text), law ('rows'), shard, slot
    (gapless from 0 in each shard, in ring order), grown_shard (null: under this
    law other rows decide too), moved (whether it overflowed).  Null ids share
    one position; repeated rows are counted once with their number, so one
    repeated key is no hot group.  An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
        .withColumn("pos", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    )
    keys = cut_lineage(keys)
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if slack:
        caps = F.array_repeat(F.lit(int(-(-total * (1 + slack) // shards))).cast("long"), shards)
    else:
        caps = F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.lit(total // shards).cast("long") + F.when(s < total % shards, 1).otherwise(0),
        )

    bin_of = F.shiftright(F.col("pos"), 63 - BIN_BITS).cast("int").alias("bin")
    points = ring_points(spark, shards, virtual_nodes)
    both = keys.select(bin_of, "pos", F.lit(0).alias("node"), "doc_id", "size", "text_crc32", "n", F.lit(None).cast("long").alias("owner")).unionByName(
        points.select(bin_of, "pos", F.lit(1).alias("node"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("text_crc32"), F.lit(0).cast("long").alias("n"), F.col("shard").alias("owner"))
    )
    in_bin = (
        Window.partitionBy("bin")
        .orderBy("pos", "node", "owner", "doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # at most 2**BIN_BITS rows
    before = (
        both.groupBy("bin")
        .agg(F.sum("n").alias("held"))
        .withColumn("before", F.sum("held").over(Window.orderBy("bin")) - F.col("held"))
        .drop("held")
    )
    ranked = both.withColumn("upto", F.sum("n").over(in_bin)).join(before, "bin").withColumn(
        "upto", F.col("upto") + F.col("before")
    )

    nodes = ranked.filter("node = 1").agg(
        F.array_sort(F.collect_list(F.struct("pos", "owner", "upto"))).alias("nodes")
    )
    runs = (
        nodes.select(_walk(F.col("nodes"), caps, total).alias("run"))
        .select(F.explode("run").alias("run"))
        .select("run.*")
        .filter("count > 0")
    )
    width = max(1, -(-total // RANK_BLOCKS))
    lookup = runs.withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("count") - 1) / width))),
    )
    placed = (
        ranked.filter("node = 0")
        .withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)))
        .withColumn("block", F.floor(F.col("rank") / width))
    )
    return (
        placed.join(lookup, "block")
        .filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("count")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("slot") + F.col("rank") - F.col("start")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            (F.col("rank") < F.col("local")).alias("moved"),
        )
    )


def _walk(nodes, caps, total: int):
    """Runs (start, count, shard, slot, local) that the nodes accept over two rounds of the ring.

    Ranks below ``local`` come from earlier nodes.  The documents behind the
    last node belong to the first one, in the second round.
    """
    size = F.size(nodes)
    first = F.transform(
        nodes,
        lambda node, i: F.struct(
            node["owner"].alias("shard"),
            F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(nodes, F.greatest(i, F.lit(1)))["upto"]).alias("local"),
            node["upto"].alias("arrived"),
        ),
    )
    behind = F.element_at(nodes, size)["upto"]
    second = F.transform(
        nodes,
        lambda node, i: F.struct(
            node["owner"].alias("shard"),
            F.when(i == 0, behind).otherwise(F.lit(total).cast("long")).alias("local"),
            F.lit(total).cast("long").alias("arrived"),
        ),
    )
    kind = "array<struct<start: bigint, count: bigint, shard: bigint, slot: bigint, local: bigint>>"

    def accept(state, node):
        index = (node["shard"] + 1).cast("int")
        room = F.element_at(state["room"], index)
        taken = F.least(room, node["arrived"] - state["rank"])
        return F.struct(
            F.transform(
                state["room"], lambda x, i: F.when(i == node["shard"], x - taken).otherwise(x)
            ).alias("room"),
            (state["rank"] + taken).alias("rank"),
            F.when(taken <= 0, state["out"])
            .otherwise(
                F.concat(
                    state["out"],
                    F.array(
                        F.struct(
                            state["rank"].alias("start"),
                            taken.alias("count"),
                            node["shard"].alias("shard"),
                            (F.element_at(caps, index) - room).alias("slot"),
                            node["local"].alias("local"),
                        )
                    ),
                )
            )
            .cast(kind)
            .alias("out"),
        )

    start = F.struct(
        caps.cast("array<bigint>").alias("room"), F.lit(0).cast("long").alias("rank"), F.array().cast(kind).alias("out")
    )
    return F.aggregate(F.concat(first, second), start, accept, lambda state: state["out"])
