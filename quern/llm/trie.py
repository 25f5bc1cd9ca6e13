"""Prefix trie of conversations from partial tries that are merged by node."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.tables import written

GROUP, HEADS = 5, 9  # op12: conversations that share a source, and more than the turns taken from it at most
FAN = 8  # partial tables that one round merges into one
NODES = 100_000  # nodes and ended conversations that a task holds before it gives out its table
LIST = 10_000  # conversations of an end list over which it isn't joined with others
ROOT = b""
TRIE = "node binary, parent binary, depth bigint, first bigint, n bigint, size bigint, ends array<bigint>, part bigint"
_ARROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64())), ("part", pa.int64())])
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns numbered from 1 by turn (null first; ties by role and text). Null role and text are empty; rows without conv_id are of no conversation."""
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return own.select("conv_id", F.row_number().over(by).cast("bigint").alias("pos"), "role", "text")


def heads(conv_id: Column) -> Column:
    """Turns that a conversation takes from its source."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of op12: the source's first turns, then the conversation's own after as many; a row with pos 0 for each conversation.

    A source is asked by GROUP conversations at most, and for its first turns only.
    """
    each = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"), heads(F.col("conv_id")).alias("h"))
    lent = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "k")
    taken = each.join(lent, (F.col("source") == F.col("k")) & (F.col("pos") <= F.col("h"))).select("conv_id", "pos", "role", "text")
    kept = turns.where(F.col("pos") > heads(F.col("conv_id")))
    tops = each.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return tops.unionByName(taken).unionByName(kept)


def child(node: bytes, role: str, text: str) -> bytes:
    """The name of the node below `node` by a turn: 128 bits of a cryptographic hash of the whole way."""
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(node + b"%d:" % len(r) + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def partial_tries(batches, limit: int = NODES):
    """Node tables of the conversations that come by, sorted by (conv_id, pos): one table for `limit` nodes and ended conversations."""
    part, nodes, held = TaskContext.get().partitionId(), {}, 0
    conv = parent = None
    node, depth, size = ROOT, 0, 0

    def entry():
        return nodes.setdefault(node, [parent, depth, conv, 0, size, []])

    def table():
        rows = [[k, *v, part] for k, v in nodes.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for batch in batches:
        for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "pos", "role", "text")), strict=True):
            if pos == 0:
                if conv is not None:
                    entry()[5].append(conv)
                    held += 1
                conv, node, parent, depth, size = c, ROOT, None, 0, 0
            else:
                node, parent, depth, size = child(node, role, text), node, depth + 1, len(text.encode("utf-8", "surrogatepass"))
            own = entry()
            own[2], own[3] = min(own[2], conv), own[3] + 1
            if len(nodes) + held >= limit:
                yield table()
                nodes.clear()
                held = 0
    if conv is not None:
        entry()[5].append(conv)
        yield table()


def _sums() -> list[Column]:
    return [F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("first").alias("first"), F.sum("n").alias("n"), F.max("size").alias("size")]


def merged(tries: DataFrame, parts: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(node, parent, depth, first, n, size) of all partial tables, each node once, and (node, conv_id), where conversations end.

    A round merges the tables of `fan` tasks by node, adding members and joining end lists; a list of over LIST conversations
    goes on as it is, so no row grows with the input. The last round adds members only.
    """
    while parts > fan:
        parts = -(-parts // fan)
        alone = F.when(F.size("ends") > LIST, F.get("ends", F.lit(0)))
        groups = tries.groupBy("node", F.floor(F.col("part") / fan).alias("part"), alone.alias("alone"))
        tries = groups.agg(*_sums(), F.flatten(F.collect_list("ends")).alias("ends")).drop("alone")
    tries = written(tries, "tries")
    return written(tries.groupBy("node").agg(*_sums()), "nodes"), tries.select("node", F.explode("ends").alias("conv_id"))


def digests(batches):
    """(node, ends_sha256) of (node, conv_id) sorted so; a node's conversations stream by."""
    schema, last, sha = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]), None, None
    for batch in batches:
        out = []
        for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if node != last:
                if sha:
                    out.append((last, sha.hexdigest()))
                last, sha = node, hashlib.sha256(b"%d" % conv)
            else:
                sha.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)


def subtree_sums(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved) summed over each chain and all below it. chains: chain, above (null at the top), leaves, saved.

    Pointer doubling: after round i a chain has the sums of those less than 2 ** i steps below, and knows the one 2 ** i steps above;
    so the rounds are the logarithm of the tree's height, not its height.
    """
    now = written(chains, "chains")
    while not now.where("above IS NOT NULL").isEmpty():
        more = now.where("above IS NOT NULL").groupBy(F.col("above").alias("k")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = now.select(F.col("chain").alias("u"), F.col("above").alias("next"))
        both = now.join(more, F.col("chain") == F.col("k"), "left").join(up, F.col("above") == F.col("u"), "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = written(both.select("chain", F.col("next").alias("above"), plus("leaves"), plus("saved")), "chains")
    return now.drop("above")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of merged nodes.

    conv_id, the smallest member, and depth name a node. Nodes of one conv_id hang below one another: a chain. Sums go up from
    chain to chain (see `subtree_sums`), then along each chain.
    """
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_children"))
    names = nodes.select(F.col("node").alias("p"), F.col("first").alias("parent_conv_id"))
    own = nodes.join(kids, F.col("node") == F.col("k"), "left").join(names, F.col("parent") == F.col("p"), "left")
    tree = written(own.select("node", F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n") - 1) * F.col("size")).alias("saved")), "tree")
    leaf = (F.col("n_children") == 0).cast("bigint")
    chains = written(tree.groupBy(F.col("conv_id").alias("chain")).agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("above"), F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved")), "tops")
    sums = subtree_sums(chains.select("chain", "above", "leaves", "saved"))
    hung = chains.where("above IS NOT NULL").select("chain", "above", (F.col("top") - 1).alias("at")).join(sums, "chain")
    hung = hung.groupBy(F.col("above").alias("c"), "at").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    up = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    below = lambda own, more: F.sum(own + F.coalesce(more, F.lit(0))).over(up)
    return tree.join(hung, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("at")), "left").select(
        "node", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", below(leaf, "more_leaves").alias("n_leaves"), below(F.col("saved"), "more_saved").alias("saved_tokens")
    )


def trie(turns: DataFrame, fan: int = FAN, limit: int = NODES) -> DataFrame:
    """The nodes of the prefix trie of conversations. turns: conv_id, pos (0 once for each conversation, then rising), role, text.

    One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the UTF-8 bytes of
    the last text), ends_sha256 (of the decimal conv_ids of those that end there, ascending, comma-joined). No conversation: no row.
    A task walks a conversation turn by turn and holds `limit` nodes at most, however long the conversation.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pos")
    nodes, ends = merged(walked.mapInArrow(lambda b: partial_tries(b, limit), TRIE), parts, fan)
    ended = ends.repartition(parts, "node").sortWithinPartitions("node", "conv_id").mapInArrow(digests, "node binary, ends_sha256 string").withColumnRenamed("node", "k")
    return rolled_up(nodes).join(ended, F.col("node") == F.col("k"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of op12 (see `ordered`, `rebuilt`, `trie`).

    Null turns come first, equal turns stand by role and text; null roles and texts are empty; repeated rows are turns of their own; rows without
    conv_id are left out; other columns are ignored; an empty table has no node.
    """
    return trie(rebuilt(written(ordered(conversations), "turns")))
