"""The prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Conversations are put in lexicographic
order (by the digests of their turns, a sequence before those that it starts), so each node's members are an interval of that order, and the
nodes in the order of their first member's rank and depth are in preorder: a subtree is a run of nodes that ends with the last node of its last
member. What a subtree holds is then a difference of two prefix sums over all nodes.

No step gathers a conversation, a node's members or a subtree in one task: turns are numbered and prefixes digested by scans over ranges of the whole table (scans.py),
where a prefix's digest is the parity of the digests of (place, turn), conversations are ranked by blocks of `block` turns, then blocks of
blocks' ranks, and the ends of a node are joined into pieces of text in ranges before one hash runs over the pieces.

Defined results: rows without a conv_id belong to no conversation; null roles and texts are empty; rows of one turn number, repeated rows too, are all turns, in the order
of the digest of role and text; an empty table has no nodes, not even a root; very long texts are only digested and measured; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import ranked, running
from .store import lean, text_of, written


@dataclass(frozen=True)
class TrieRules:
    #: Conversation c continues the first crc32(c) % `most` turns of conversation c - c % `family`; family = 1 leaves all as they are.
    family: int = 5
    most: int = 9
    #: Turns, or ranks of blocks, that one block holds.
    block: int = 32
    #: Bytes of a node's joined ends in one piece.
    piece: int = 1 << 16


def turns_of(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, digest (16 bytes), n_bytes."""
    r, t = text_of(role), text_of(text)
    whole = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    return rows.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes")
    )


def borrowed(conv: Column, rules: TrieRules) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % rules.most


def rebuilt(rows: DataFrame, rules: TrieRules) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, q from 0, digest, n_bytes, last) and conversations (conv, m turns) as the family rule makes them."""
    own = rows.withColumn("apart", F.monotonically_increasing_id())
    own = running(own, ["conv", "turn", "digest", "apart"], "conv").select("conv", "place", "digest", "n_bytes")
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("h", borrowed(F.col("conv"), rules)).withColumn("base", F.col("conv") - F.col("conv") % rules.family)
    held = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    kept = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = written(sizes.join(held, "base", "left").select("conv", "base", "h", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("m")), "convs")
    mine = own.join(convs, "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("kept")).alias("q"), "digest", "n_bytes", "m")
    first = own.filter(F.col("place") < rules.most - 1).withColumnRenamed("conv", "base")
    lent = first.join(convs.filter("kept > 0"), "base").filter("place < kept").select("conv", F.col("place").alias("q"), "digest", "n_bytes", "m")
    return mine.unionByName(lent).withColumn("last", F.col("q") == F.col("m") - 1), convs.select("conv", "m")


def _wide(x: Column) -> Column:
    """A rank as 8 bytes in the order of ranks."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def conversation_ranks(turns: DataFrame, rules: TrieRules) -> DataFrame:
    """conv, rank from 1: equal for equal sequences of turns, smaller for lexicographically smaller ones."""
    items = turns.select("conv", "q", "digest")
    while True:
        block = F.call_function("div", F.col("q"), F.lit(rules.block))
        blocks = items.groupBy("conv", block.alias("q")).agg(F.array_sort(F.collect_list(F.struct("q", "digest"))).alias("parts"))
        key = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["digest"]))
        blocks = ranked(blocks.select("conv", "q", key.alias("key")), "key", ["conv", "q"], "rank")
        if not blocks.agg(F.max("q")).first()[0]:
            return blocks.select("conv", (F.col("rank") + 1).alias("rank"))
        items = blocks.select("conv", "q", _wide(F.col("rank")).alias("digest"))


def end_digests(ranks: DataFrame, rules: TrieRules) -> DataFrame:
    """rank, ends_sha256: of the conversations of a rank, ascending, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, first, held, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["rank", "first", "piece"])

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r != rank or size > rules.piece:
                    if held:
                        done.append(out())
                    rank, first, held, size = r, c, [], 0
                word = str(c)
                held.append(word)
                size += len(word) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, sha = None, None
        for batch in batches:
            ranks_, digests = [], []
            for r, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if r != rank:
                    if sha is not None:
                        ranks_.append(rank)
                        digests.append(sha.hexdigest())
                    rank, sha = r, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ranks_, pa.int64()), pa.array(digests, pa.string())], ["rank", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([sha.hexdigest()])], ["rank", "ends_sha256"])

    pieces = ranks.select("rank", "conv").repartitionByRange("rank", "conv").sortWithinPartitions("rank", "conv").mapInArrow(lean(join), "rank long, first long, piece string")
    return pieces.repartition("rank").sortWithinPartitions("rank", "first").mapInArrow(lean(digest), "rank long, ends_sha256 string")


def conversation_trie(rows: DataFrame, rules: TrieRules = TrieRules(), *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end (places of the node and of its subtree's last node)."""
    turns, convs = rebuilt(turns_of(rows, conv_id, turn, role, text), rules)
    mixed = turns.withColumn("k1", F.xxhash64("digest", "q")).withColumn("k2", F.xxhash64(F.lit("second"), "q", "digest"))
    chained = running(mixed, ["conv", "q"], "conv", xor=("k1", "k2"))
    ranks = convs.join(conversation_ranks(chained, rules), "conv", "left").select("conv", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), "m")
    ranks = written(ranks, "ranks")

    zero = F.lit(0).cast("long")
    members = chained.select("conv", (F.col("q") + 1).alias("depth"), F.col("upto_k1").alias("x1"), F.col("upto_k2").alias("x2"), "k1", "k2", "n_bytes", "last")
    members = members.join(ranks.select("conv", "rank"), "conv")
    top = ranks.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("k1"), zero.alias("k2"), zero.alias("n_bytes"), (F.col("m") == 0).alias("last"), "rank")
    # equal in all members: what belongs to the sequence itself
    nodes = members.unionByName(top).groupBy("depth", "x1", "x2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("last").alias("ends"),
        F.min("n_bytes").alias("n_bytes"), F.min("k1").alias("k1"), F.min("k2").alias("k2"),
    )
    above = {"depth": F.col("depth") - 1, "x1": F.col("x1").bitwiseXOR(F.col("k1")), "x2": F.col("x2").bitwiseXOR(F.col("k2"))}
    nodes = written(nodes.select("*", *[c.alias(f"p_{k}") for k, c in above.items()]), "nodes")
    key = ["depth", "x1", "x2"]
    children = nodes.filter("depth > 0").groupBy(*[F.col(f"p_{k}").alias(k) for k in key]).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(f"p_{k}") for k in key], F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, key, "left").join(parents, [f"p_{k}" for k in key], "left").fillna(0, ["n_children"])
    full = full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "low", "high", "ends", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))

    order = running(full, ["low", "depth"], add=("leaf", "saved"))
    upto = order.groupBy(F.col("low").alias("high")).agg(F.max("place").alias("subtree_end"), F.max("upto_leaf").alias("end_leaf"), F.max("upto_saved").alias("end_saved"))
    found = order.join(upto, "high").join(end_digests(ranks, rules).select(F.col("rank").alias("low"), F.col("ends_sha256").alias("sha"), F.lit(True).alias("ends")), ["low", "ends"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end_leaf") - F.col("upto_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end_saved") - F.col("upto_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("place").alias("preorder"), "subtree_end",
    )
