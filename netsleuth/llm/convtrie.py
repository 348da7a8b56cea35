"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns.  Its name is a chained digest, so
equal prefixes have equal names whatever the conversation.

1. *Blocks.*  Turns are read in order, one conversation after the other, in
   constant memory.  Every ``BLOCK`` turns (and at the end) one row leaves: the
   digest before the block, the digest after each of its turns, their words.
2. *Groups.*  Conversations are grouped by the digest after the block.  Only
   where different blocks follow the same prefix can their first turns be
   shared: those are taken apart turn by turn and grouped again.  All turns of
   a block without siblings have its members.
3. *Subtrees.*  Sums go up in steps of 1, ``BLOCK``, ``BLOCK``^2, ... turns:
   first to the next multiple above, then down again to all depths between.
   A node takes part ``BLOCK`` times a level, however long the conversation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth.llm.util import join_counted, joined_sha256, settle

#: Turns of a block.
BLOCK = 8
#: Conversations whose number is a multiple of this give the next ones their first turns.
FAMILY = 20
#: First turns that may be taken over, and one more.
TAKEN = 4

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
_DDL = ("conv_id long, k int, n int, start binary, end binary, states array<binary>, words array<long>, ended boolean, "
        "trails array<array<binary>>")


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """``(conv_id, rn, digest, words)``: turns numbered from 1 in the order of
    ``turn`` (null first; equal ones by digest, so repeated rows all stay).
    Null roles and texts count as empty; rows without a conversation id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("rn"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, taken: int = TAKEN) -> DataFrame:
    """``(conv_id, part, rn, digest, words)`` in the order of (part, rn): a mark
    for each conversation c, the first h turns of conversation c - c % family,
    then its own after its first h; h = crc32(c) % taken."""
    turns = settle(turns, "trie-turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(taken)).cast("int")
    convs = turns.where("rn = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("rn") < taken)).withColumnRenamed("conv_id", "base")
    head = convs.join(first, "base").where("rn <= h").select("conv_id", F.lit(1).alias("part"), "rn", "digest", "words")
    own = turns.where(F.col("rn") > h).select("conv_id", F.lit(2).alias("part"), "rn", "digest", "words")
    mark = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("rn"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("long").alias("words"))
    return mark.unionByName(head).unionByName(own)


class _Path:
    """The turns read of one conversation."""

    def __init__(self, conv: int, block: int):
        self.conv, self.block, self.depth, self.state, self.rows = conv, block, 0, ROOT, []
        #: per level, the states at the multiples of block^level since the last multiple of block^(level + 1)
        self.marks = [[ROOT]]
        self.open()

    def open(self):
        self.start, self.states, self.words = self.state, [], []

    def add(self, digest: bytes, words: int):
        from hashlib import blake2b
        if len(self.states) == self.block:
            self.close(False)
        self.state = blake2b(self.state + digest, digest_size=16).digest()
        self.states.append(self.state)
        self.words.append(words)
        self.depth += 1

    def close(self, ended: bool):
        trails, level, unit = [], 0, self.block
        if self.states and len(self.states) == self.block:
            while self.depth % unit == 0:
                if level == len(self.marks):
                    self.marks.append([ROOT])
                trails.append(list(self.marks[level]))
                deeper = self.depth % (unit * self.block) == 0
                self.marks[level] = [self.state] if deeper else self.marks[level] + [self.state]
                level, unit = level + 1, unit * self.block
        self.rows.append((self.conv, (self.depth - 1) // self.block if self.depth else 0, len(self.states), self.start, self.state, self.states,
                          self.words, ended, trails))
        self.open()


def conversation_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of each conversation of ``rebuilt``'s rows; one
    without turns gives an empty block."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_(),
             pa.list_(pa.list_(pa.binary()))]
    names = ["conv_id", "k", "n", "start", "end", "states", "words", "ended", "trails"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)

    def go(batches):
        path = None
        for b in batches:
            done = []
            for conv, part, digest, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "digest", "words"))):
                if part == 0:
                    if path is not None:
                        path.close(True)
                        done += path.rows
                    path = _Path(conv, block)
                else:
                    path.add(digest, words)
            if path is not None:
                done += path.rows
                path.rows = []
            yield out(done)
        if path is not None:
            path.close(True)
            yield out(path.rows)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "rn").mapInArrow(go, _DDL)


def trie_nodes(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(digest, parent, depth, words, n_convs, conv_id, ends, trail,
    trails)``, one row per node; ``trail``: its ancestors since the last
    multiple of ``block``, ``trails``: those at the multiples, level by level."""
    each = settle(blocks.groupBy("end", "k", "n").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("ended").cast("long")).alias("ends"),
        *[F.first(c).alias(c) for c in ("start", "states", "words", "trails")]), "trie-blocks")
    follow = settle(each.where("n > 0").groupBy("start").agg(F.count(F.lit(1)).alias("follow")), "trie-siblings")
    known = join_counted(each.where("n > 0"), follow.select("start", "follow", (F.col("follow") > 1).alias("split")), "start", "follow")
    none = F.array().cast("array<array<binary>>")
    turns = known.select("*", F.posexplode(F.arrays_zip("states", F.col("words").alias("w"))).alias("j", "turn")).select(
        "split", F.col("turn.states").alias("digest"), F.when(F.col("j") > 0, F.expr("states[greatest(j - 1, 0)]")).otherwise(F.col("start")).alias("parent"),
        (F.col("k").cast("long") * block + F.col("j") + 1).alias("depth"), F.col("turn.w").alias("words"), "n_convs", "conv_id",
        F.when(F.col("j") + 1 == F.col("n"), F.col("ends")).otherwise(0).alias("ends"),
        F.concat(F.array("start"), F.expr("slice(states, 1, j)")).alias("trail"),
        F.when((F.col("j") + 1 == F.col("n")) & (F.col("n") == block), F.col("trails")).alias("trails"))
    cols = ["digest", "parent", "depth", "words", "n_convs", "conv_id", "ends", "trail", "trails"]
    shared = turns.where("split").groupBy("digest").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("ends").alias("ends"),
        *[F.first(c).alias(c) for c in ("parent", "depth", "words", "trail")], F.first("trails", ignorenulls=True).alias("trails"))
    root = each.where("k = 0").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                   F.sum(F.when(F.col("n") == 0, F.col("ends")).otherwise(0)).alias("ends")).where("n_convs > 0") \
        .select(F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                F.lit(0).cast("long").alias("words"), "n_convs", "conv_id", "ends", F.array().cast("array<binary>").alias("trail"), none.alias("trails"))
    return shared.select(cols).unionByName(turns.where("not split").select(cols)).unionByName(root.select(cols))


def subtree_sums(nodes: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """``(digest, *values)``: each value summed over the node and all below."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    def gather(rows: DataFrame, name: str) -> DataFrame:
        return settle(rows.groupBy("digest").agg(*[F.sum(v).alias(v) for v in values]), name)
    level, unit, units = 0, 1, [nodes.select("digest", "depth", "trail", *values)]
    while unit * block <= deepest:
        unit, level = unit * block, level + 1
        top = F.when(F.col("depth") % unit == 0, F.col("digest")).otherwise(F.col("trail")[0])
        up = gather(units[-1].withColumn("digest", top), f"trie-up-{level}")
        here = nodes.where(F.col("depth") % unit == 0).select("digest", "depth", F.when(F.col("depth") > 0, F.col("trails")[level - 1])
                                                              .otherwise(F.array().cast("array<binary>")).alias("trail"))
        units.append(settle(here.join(up, "digest"), f"trie-unit-{level}"))
    sums = gather(units[-1].withColumn("digest", F.lit(ROOT)), "trie-total")
    for rows in units[::-1]:
        unit *= block
        high = rows.where(F.col("depth") % unit == 0).drop(*values).join(sums, "digest")
        rest = rows.where(F.col("depth") % unit != 0).unionByName(high)
        to = F.concat(F.array("digest"), F.expr("slice(trail, 2, greatest(size(trail) - 1, 0))"))
        sums = gather(rest.withColumn("digest", F.explode(to)), f"trie-sums-{level}")
        unit, level = unit // block // block, level - 1
    return sums


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, digest)``, one row per node of the trie of
    ``rebuilt``'s (or such) rows.

    Conversations without turns end at the root; equal conversations end at one
    node; an empty table gives no node, not even the root."""
    blocks = settle(conversation_blocks(turns, block), "trie-paths")
    nodes = settle(trie_nodes(blocks, block), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(nodes.join(children, "digest", "left").fillna(0, ["n_children"])
                   .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "trie-children")
    parents = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("_n"))
    cols = ["digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    below = join_counted(nodes.where("depth > 0").drop("trail", "trails"), parents, "parent", "_n").select(cols)
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(cols)
    ends = settle(blocks.where("ended").select(F.col("end").alias("digest"), "conv_id", F.col("conv_id").cast("string").alias("text")), "trie-ends")
    ended = joined_sha256(ends, "digest", "conv_id").select("digest", F.col("sha256").alias("ends_sha256"))
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], block)
    return below.unionByName(top).join(sums, "digest").join(ended, "digest", "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "digest")
