"""Conversation prefix trie, rolled up by depth bands.

A conversation's turns, in order of turn (nulls first), then role, then text digest, are a path from the root; each
distinct sequence of first turns is a node, and the conversations that start with it are its members.

A node is known by its depth and a 128-bit sum over its turns of hashes of (depth, role, text): sums of a part of a
conversation add up, so a long conversation is cut into blocks of ``BLOCK`` turns that are summed apart, and a node's
parent is its own sum less its last turn.  Turns enter by the SHA-256 of role and text; no text is shuffled.

Subtree totals go by bands of ``height`` depths: a node's values explode only to its ancestors in its own band.  The
bands' top nodes form a tree that is ``height`` times less deep, whose totals are found in the same way; each of them then
goes to the ancestors in the band above.  So a node is copied at most ``height`` times a level, and there are
log(depth) / log(height) levels, however deep the trie.

Hot nodes (a first turn that a third of all conversations share) are only ever the key of sums that combine before the
shuffle; where a node's row goes to its children, nodes with over a thousandth of all children are broadcast, of
which there are fewer than a thousand.  The ids that end at a node are joined in chunks of 2**``CHUNK_BITS`` consecutive ids
and then digested in order, chunk by chunk: SHA-256 is sequential, but holds no more than one chunk.

Null roles and texts are empty.  Ids are integers; rows with a null id are one conversation, which comes after all others and is
written ``null``; a null id's conversation has no other one's turns put before it.  Equal rows are turns of their own.  Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityhop.llm.scratch import heavy_join, written

#: Depths of a band; turns of a conversation that are summed in one go; consecutive ids in a chunk of a digest.
HEIGHT = 4
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
CHUNK_BITS = 14
#: Turns of another conversation that ``rebuilt`` can put before the own ones.
LONGEST_HEAD = 8

_LANES = ["s0", "s1", "s2", "s3"]
_KEY = ["depth", "k0", "k1"]
_LOW = 0xFFFFFFFF


def numbered_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv, pos (from 0, in order), turn_hash, n_bytes (of the text): one row per turn, without its text.

    Turns are ordered over the whole table by ranges, numbered inside each range, and a conversation that goes on in a
    further range counts on from the ranges before: at most one conversation crosses each border.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), said.alias("turn_hash"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    ranged = written(turns.repartitionByRange("conv", "turn", "role", "turn_hash").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy(F.col("conv").alias("c")).agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("c")
    crossing = counts.join(F.broadcast(several), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = crossing.select(F.col("conv").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("conv", "range").orderBy("turn", "role", "turn_hash")
    placed = ranged.withColumn("pos", F.row_number().over(inside) - 1)
    joined = placed.join(F.broadcast(carry), F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    return joined.select("conv", (F.col("pos") + F.coalesce("carried", F.lit(0))).cast("long").alias("pos"), "turn_hash", "n_bytes")


def _blocks(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.shiftright(n - 1, BLOCK_BITS))


def rebuilt(turns: DataFrame, source: Column, head: Column) -> DataFrame:
    """conv, depth (from 0), turn_hash, n_bytes, ends: the paths after putting heads of other conversations first.

    Conversation ``conv`` gets the first ``head`` (at most ``LONGEST_HEAD``) turns of conversation ``source``, both expressions of ``conv``,
    all if it has fewer and none if there is none, and then its own turns after its first ``head``.  Depth 0 is the root.
    """
    turns = written(turns)
    convs = turns.groupBy("conv").agg((F.max("pos") + 1).alias("n")).withColumns({"source": source, "head": F.coalesce(head, F.lit(0)).cast("long")})
    firsts = turns.where(F.col("pos") < LONGEST_HEAD).groupBy(F.col("conv").alias("source"))
    heads = firsts.agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "n_bytes"))).alias("first"))
    convs = convs.join(heads, "source", "left")
    given = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.least(F.col("head"), F.size("first"))).cast("long")
    convs = convs.withColumn("given", given)
    convs = written(convs.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))))

    path = [F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("turn_hash"), F.lit(0).cast("long").alias("n_bytes")]
    root = convs.select("conv", "length", *path)
    lent = convs.where("given > 0").select("conv", "length", F.explode(F.slice("first", 1, F.col("given").cast("int"))).alias("t"))
    lent = lent.select("conv", "length", (F.col("t.pos") + 1).alias("depth"), "t.turn_hash", "t.n_bytes")
    per_block = convs.where("n > head").select(F.col("conv").alias("c"), "head", "given", "length", F.explode(_blocks(F.col("n"))).alias("b"))
    own = turns.join(per_block, F.col("conv").eqNullSafe(F.col("c")) & (F.shiftright("pos", BLOCK_BITS) == F.col("b"))).where("pos >= head")
    own = own.select("conv", "length", (F.col("pos") - F.col("head") + F.col("given") + 1).alias("depth"), "turn_hash", "n_bytes")
    return root.unionByName(lent).unionByName(own).withColumn("ends", F.col("depth") == F.col("length"))


def _key(lanes: list[Column]) -> list[Column]:
    low = [lane.bitwiseAND(F.lit(_LOW)) for lane in lanes]
    return [F.shiftleft(low[2 * i], 32).bitwiseOR(low[2 * i + 1]).alias(k) for i, k in enumerate(("k0", "k1"))]


def paths(rows: DataFrame) -> DataFrame:
    """conv, depth, k0, k1 (the node), p0, p1 (its parent), n_bytes, ends: one row per conversation and depth."""
    halves = [F.xxhash64(F.lit(i), "depth", "turn_hash") for i in (1, 2)]
    root = F.col("depth") == 0
    lanes = [F.when(root, F.lit(0)).otherwise(part).cast("long") for h in halves for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW)))]
    rows = rows.withColumns(dict(zip(_LANES, lanes))).withColumn("block", F.shiftright("depth", BLOCK_BITS))
    rows = written(rows.select("conv", "depth", "block", "length", *_LANES, "n_bytes", "ends"))
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("conv", "depth", "block", *_LANES, "n_bytes", "ends", *[F.sum(s).over(upto).alias(f"u{s}") for s in _LANES])
    # only conversations of several blocks carry sums from one block to the next
    totals = rows.where(F.col("length") >= BLOCK).groupBy("conv", "block").agg(*[F.sum(s).alias(s) for s in _LANES])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("conv").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"c{s}") for s in _LANES])
    joined = summed.join(carry, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    here = [F.col(f"u{s}") + F.coalesce(F.col(f"c{s}"), F.lit(0)) for s in _LANES]
    parent = [up - F.col(s) for up, s in zip(here, _LANES)]
    return joined.select("conv", "depth", *_key(here), *[c.alias(p) for c, p in zip(_key(parent), ("p0", "p1"))], "n_bytes", "ends")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node: its key, parent's key, smallest member, n_convs, n_bytes, n_children."""
    # all members of a node have the same parent and last turn
    same = [F.min(c).alias(c) for c in ("p0", "p1", "n_bytes")]
    nodes = rows.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *same)
    nodes = written(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def subtree_totals(rows: DataFrame, nodes: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """depth, k0, k1 and the sums of ``values`` over each node's subtree.

    ``rows`` hold conv, depth, k0, k1 for every conversation and depth, ``nodes`` the key, a member ``conv`` and ``values`` of each node.
    """
    band = F.floor(F.col("depth") / height)
    stretch = rows.groupBy("conv", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct(*_KEY))).alias("above"))
    stretch = written(stretch.withColumnRenamed("conv", "c").withColumnRenamed("band", "b"))

    def explode(from_nodes: DataFrame, band: Column, last: Column) -> DataFrame:
        at = from_nodes.withColumns({"band": band, "last": last}).join(stretch, F.col("conv").eqNullSafe(F.col("c")) & (F.col("band") == F.col("b")))
        up = at.select(F.explode(F.slice("above", F.lit(1), F.col("last").cast("int"))).alias("a"), *values)
        return up.select("a.*", *values)

    total = [F.sum(v).alias(v) for v in values]
    inside = explode(nodes.select(*_KEY, "conv", *values), band, F.col("depth") % height + 1).groupBy(*_KEY).agg(*total)
    if nodes.where(F.col("depth") >= height).isEmpty():
        return inside
    inside = written(inside)
    tops = F.col("depth") % height == 0
    up = (F.col("depth") / height).cast("long")
    top_rows = rows.where(tops).select("conv", up.alias("depth"), "k0", "k1")
    top_nodes = nodes.where(tops).select(*_KEY, "conv").join(inside, _KEY).withColumn("depth", up)
    done = written(subtree_totals(top_rows, written(top_nodes), values, height)).where("depth > 0")
    below = done.join(top_nodes.select(*_KEY, "conv"), _KEY)
    outside = explode(below, F.col("depth") - 1, F.lit(height))
    return inside.unionByName(outside).groupBy(*_KEY).agg(*total)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the chunks of each key, which follow one another; the last key of a batch stays open."""
    key, said = None, None
    for batch in batches:
        keys, digests = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if row[:3] != key:
                if key is not None:
                    keys.append(key)
                    digests.append(said.hexdigest())
                key, said = row[:3], hashlib.sha256()
            else:
                said.update(b",")
            said.update(row[3].encode())
        yield _digests(keys, digests)
    if key is not None:
        yield _digests([key], [said.hexdigest()])


def _digests(keys: list[tuple], digests: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=[*_KEY, "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end at a node, in order, for each node at which one ends."""
    chunk = F.coalesce(F.shiftright("conv", CHUNK_BITS), F.lit(2**62))
    ends = rows.where("ends").groupBy(*_KEY, chunk.alias("chunk"))
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    chunks = ends.agg(F.when(F.first("conv").isNull(), F.lit("null")).otherwise(F.array_join(ids, ",")).alias("ids"))
    chunks = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
    return chunks.mapInArrow(_digest, "depth long, k0 long, k1 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie over ``rows`` (as of ``rebuilt``): id of the smallest member, depth, parent's id, n_convs,
    n_children, n_leaves, saved_tokens (bytes of last texts that sharing saves in the subtree), ends_sha256."""
    rows = written(paths(rows))
    nodes = written(nodes_of(rows))
    worth = nodes.select(
        *_KEY, "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")
    )
    totals = subtree_totals(rows.select("conv", *_KEY), worth, ["n_leaves", "saved_tokens"], height)
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(totals, _KEY).join(end_digests(rows), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv").alias("parent"), "n_children"
    )
    out = heavy_join(full, parents.withColumnRenamed("n_children", "weight"), ["depth", "p0", "p1"], "weight", ["k0", "k1"])
    return out.select(
        F.col("conv").alias(id_col),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias(f"parent_{id_col}"),
        *["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    )
