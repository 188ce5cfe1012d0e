"""The trie of conversation prefixes, as flat node tables addressed by minimal perfect hashes.

A node is a distinct sequence of first turns. Each (conversation, depth) has a digest of its prefix: running sums of
the turns' hashes, each mixed with its place, taken in blocks of turns, so that no task holds a conversation. A node
below which there are more rows than ``light_rows`` is heavy; these are few (the root, and first turns that very many
conversations share), and they are rows of a DataFrame whose sums are carried up by doubling. All other nodes lie in
light subtrees, which are dealt over shards whole. A shard enumerates its distinct digests, gives each a slot by a
minimal perfect hash, holds every row against what its slot has, scatters counts into flat arrays by slot, and adds
them up through the array of parent slots, from the deepest level to the top.

The hash of a node's ends is taken over their ids in order: ranges of ids are sorted and joined to short texts side
by side, and only these pass the task that hashes them one after another.

Defined results: null roles and texts are empty; turns of one number are in the order of role, then of the text's md5;
rows that repeat whole are turns each; rows without conv_id belong to no conversation; very long texts are hashed and
their words counted whole; columns other than conv_id, turn, role and text may have any name; a table without
conversations has no node. Two different prefixes whose digests agree (126 bits) would stop the run with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lecturelake.llm._spark import hinted, materialize, read_table, table_columns
from lecturelake.llm._words import U64, mix

_SUM_BITS = 44
_NO_ENDS = sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieParams:
    light_rows: int = 4_000
    """(conversation, depth) rows in a subtree up to which one task reads it whole."""
    batch_rows: int = 200_000
    """Rows of light subtrees that a task holds at once."""
    block: int = 4_096
    """Turns of a conversation whose hashes one task adds up in order."""
    ids: int = 1_000
    """Ids of a node's ends that are joined to one text."""


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, pos from 1, h1, h2, h3, words) in their order, and the pieces (conv_id, part, n_turns) that they lie in.

    The table is sorted by ranges of (conversation, turn); places come from the sizes of the pieces that ranges cut a
    conversation into, so that a conversation of any length is sorted by many tasks.
    """
    rows = table_columns(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    h = [F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2, 3)]
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("tie"), *h, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ("conv_id", "turn", "role", "tie")
    ranged = rows.repartitionByRange(_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "h1", "h2", "h3", "words")
    ranged = materialize(ranged, "turns-ordered")
    pieces = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    pieces = pieces.withColumn("before", F.sum("n").over(whole.orderBy("part")) - F.col("n")).withColumn("n_turns", F.sum("n").over(whole))
    pieces = materialize(pieces, "turn-pieces")
    placed = ranged.join(pieces.select("conv_id", "part", "first", "before"), ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "h1", "h2", "h3", "words"), pieces


def grafted(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, length, h1, h2, h3, words) and members (conv_id, length) of conversations whose first turns are those of another.

    Conversation c takes the first h turns of c - c % every, and its own after its first h; h is the crc32 of c modulo ``most``.
    """
    turns, pieces = ordered_turns(conversations)
    own = pieces.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"))
    stems = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("stem"), F.col("n_turns").alias("stem_turns"))
    asked = own.withColumn("stem", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("long"))
    members = asked.join(stems, "stem", "left").withColumn("k", F.least(F.col("h"), F.coalesce("stem_turns", F.lit(0))))
    members = materialize(members.select("conv_id", "stem", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n_turns") - F.col("h"))).alias("length")), "conversations")
    # by (conversation, piece), so that a long conversation's turns don't meet in one task
    held = pieces.select("conv_id", "part").join(members, "conv_id")
    tail = turns.join(held, ["conv_id", "part"]).filter("pos > h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "length", "h1", "h2", "h3", "words")
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("stem"), "pos", "h1", "h2", "h3", "words")
    head = heads.join(members, "stem").filter("pos <= k").select("conv_id", F.col("pos").alias("d"), "length", "h1", "h2", "h3", "words")
    return head.unionByName(tail), members.select("conv_id", "length")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members, as ``grafted`` gives them, of conversations as they are."""
    turns, pieces = ordered_turns(conversations)
    held = pieces.select("conv_id", "part", F.col("n_turns").alias("length"))
    return turns.join(held, ["conv_id", "part"]).select("conv_id", F.col("pos").alias("d"), "length", "h1", "h2", "h3", "words"), held.select("conv_id", "length").distinct()


def _digest(d: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(11), d, *sums), F.xxhash64(F.lit(12), *reversed(sums), d)]


def prefixes(turns: DataFrame, params: TrieParams) -> DataFrame:
    """conv_id, d, length, k1, k2 (digest of the prefix), p1, p2 (of the one before), mark (of the last turn), words."""
    mask = F.lit(2**_SUM_BITS - 1).cast("long")
    size = F.lit(2**_SUM_BITS).cast("long")
    d = F.col("d").cast("long")
    terms = [F.xxhash64(F.lit(i), h, d).bitwiseAND(mask).alias(f"m{i}") for i, h in ((1, "h1"), (2, "h2"), (3, "h3"))]
    rows = turns.select("conv_id", d.alias("d"), "length", F.floor((d - 1) / params.block).alias("block"), *terms, F.xxhash64("h1", "h3").alias("mark"), "words")
    rows = materialize(rows, "turn-terms")
    names = ("m1", "m2", "m3")
    blocks = rows.groupBy("conv_id", "block").agg(*[F.pmod(F.sum(m), size).alias(m) for m in names])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in names])
    inside = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({f"in_{m}": F.sum(m).over(inside) for m in names}).join(blocks, ["conv_id", "block"])
    here = [F.pmod(F.col(f"before_{m}") + F.col(f"in_{m}"), size) for m in names]
    above = [F.pmod(F.col(f"before_{m}") + F.col(f"in_{m}") - F.col(m), size) for m in names]
    (k1, k2), (p1, p2) = _digest(F.col("d"), here), _digest(F.col("d") - 1, above)
    return materialize(summed.select("conv_id", "d", "length", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "mark", "words"), "prefixes")


def _root(rows: DataFrame) -> DataFrame:
    k1, k2 = _digest(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 3)
    return rows.withColumns({"k1": k1, "k2": k2})


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: at each level keys that are alone in their cell keep it, the others go to the next one; slots count the kept cells."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, base = np.arange(len(k1)), 0
        while len(left):
            size = max(1, 2 * len(left))
            cell = self._cell(k1[left], k2[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + base, -1)
            self.levels.append((rank, size))
            base += int(alone.sum())
            left = left[~alone[cell]]
        self.size = base

    @staticmethod
    def _cell(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(k1 ^ mix(k2 + U64((level * 0x9E3779B97F4A7C15 + 1) % 2**64))) % U64(size)).astype(np.int64)

    def slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that isn't in the table any slot, or -1."""
        out = np.full(len(k1), -1)
        left = np.arange(len(k1))
        for level, (rank, size) in enumerate(self.levels):
            if not len(left):
                break
            out[left] = rank[self._cell(k1[left], k2[left], level, size)]
            left = left[out[left] < 0]
        return out


NODE = "k1 long, k2 long, conv_id long, depth long, parent_conv_id long, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
_NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]


def node_table(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes of whole light subtrees from their rows (conv_id, d, k1, k2, p1, p2, mark, words, and t1, t2: the digest of the subtree's top)."""
    k1, k2, p1, p2 = (rows[k].view(np.uint64) for k in ("k1", "k2", "p1", "p2"))
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
    distinct = order[new]
    table = PerfectHash(k1[distinct], k2[distinct])
    slot = table.slots(k1, k2)
    at = np.empty(table.size, np.int64)  # a row of each slot's node
    at[slot] = np.arange(len(slot))
    held = at[slot]
    same = (k1[held] == k1) & (k2[held] == k2)
    for name in ("d", "p1", "p2", "mark", "words", "t1", "t2"):
        same &= rows[name][held] == rows[name]
    if table.size != len(distinct) or not same.all():
        raise ValueError("two different prefixes have one digest")
    n = np.bincount(slot, minlength=table.size)
    first = np.full(table.size, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, rows["conv_id"])
    top = (rows["k1"][at] == rows["t1"][at]) & (rows["k2"][at] == rows["t2"][at])
    depth = rows["d"][at]
    parent = np.where(top, -1, table.slots(p1[at], p2[at]))
    inner = np.flatnonzero(~top)
    if (parent[inner] < 0).any() or (k1[at[parent[inner]]] != p1[at[inner]]).any() or (k2[at[parent[inner]]] != p2[at[inner]]).any():
        raise ValueError("a prefix lacks the one before it")
    children = np.bincount(parent[inner], minlength=table.size)
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * rows["words"][at]
    by_depth = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = np.where(top, 0, first[parent])
    return dict(zip(_NODE_NAMES, (rows["k1"][at], rows["k2"][at], first, depth, above, rows["p1"][at], rows["p2"][at], n, children, leaves, saved, top), strict=True))


def light_nodes(rows: DataFrame, params: TrieParams) -> DataFrame:
    """Nodes (as NODE) of light subtrees; parent_conv_id is null at their tops."""
    names = ["conv_id", "d", "k1", "k2", "p1", "p2", "mark", "words", "t1", "t2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def made(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            found = node_table(rows)
            columns = [pa.array(found[n]) for n in _NODE_NAMES]
            columns[4] = pa.array(found["parent_conv_id"], mask=found["top"])
            return pa.record_batch(columns, names=_NODE_NAMES)

        for b in batches:
            part = {n: b.column(i).to_numpy() for i, n in enumerate(names)}
            held.append(part)
            size += b.num_rows
            if size >= params.batch_rows:
                rows = {n: np.concatenate([h[n] for h in held]) for n in names}
                last = np.flatnonzero((rows["t1"] != rows["t1"][-1]) | (rows["t2"] != rows["t2"][-1]))
                end = int(last[-1]) + 1 if len(last) else 0  # rows of the last top may still come
                if end:
                    yield made({n: v[:end] for n, v in rows.items()})
                held = [{n: v[end:] for n, v in rows.items()}]
                size -= end
        if size:
            yield made({n: np.concatenate([h[n] for h in held]) for n in names})

    return rows.select(*names).repartition(_parts(rows.sparkSession), "t1").sortWithinPartitions("t1", "t2").mapInArrow(run, NODE)


def _heavy_sums(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """Heavy nodes (k1, k2, p1, p2, conv_id, depth, n_convs, own) with n_children, n_leaves, saved_tokens; ``tops``: the light subtrees below them."""
    below = tops.groupBy("p1", "p2").agg(F.count("*").alias("light"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = heavy.filter("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("inner"))
    to_key = lambda t: t.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    rows = heavy.join(to_key(below), ["k1", "k2"], "left").join(to_key(inner), ["k1", "k2"], "left").fillna(0, ["light", "leaves", "saved", "inner"])
    children = F.col("light") + F.col("inner")
    state = materialize(rows.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", children.alias("n_children"), (F.col("leaves") + (children == 0).cast("long")).alias("n_leaves"), (F.col("own") + F.col("saved")).alias("saved_tokens"), F.col("p1").alias("a1"), F.col("p2").alias("a2")), "heavy-nodes")
    # n_leaves and saved_tokens cover the levels passed so far; a1, a2 is the ancestor that many levels above
    while not state.filter("a1 is not null").isEmpty():
        up = state.filter("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        far = state.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        next_ = state.join(up, ["k1", "k2"], "left").fillna(0, ["more_leaves", "more_saved"]).join(hinted(far), ["a1", "a2"], "left")
        state = materialize(next_.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"), F.col("b1").alias("a1"), F.col("b2").alias("a2")), "heavy-nodes")
    return state


def ends(rows: DataFrame, params: TrieParams) -> DataFrame:
    """k1, k2, ends_sha256 of nodes at which conversations (conv_id, k1, k2) end."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = (b.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts = [a for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True) for a in range(x, y, params.ids)]
            stops = [*starts[1:], len(ids)]
            joined = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(starts, stops, strict=True)]
            yield pa.record_batch([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], names=["k1", "k2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if (k1, k2) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (k1, k2), sha256(ids.as_buffer())
                else:
                    state.update(b",")
                    state.update(ids.as_buffer())
            yield _ended(done)
        if now:
            yield _ended([(*now, state.hexdigest())])

    parts = _parts(rows.sparkSession)
    ranged = rows.select("k1", "k2", "conv_id").repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = ranged.mapInArrow(texts, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])


def trie(turns: DataFrame, members: DataFrame, params: TrieParams | None = None) -> DataFrame:
    """A row for each node: conv_id (its smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    params = params or TrieParams()
    rows = prefixes(turns, params)
    sums = rows.groupBy("k1", "k2").agg(
        F.sum(F.col("length") - F.col("d") + 1).alias("weight"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max(F.col("p1")).alias("high"), F.min("mark").alias("mark"), F.max("mark").alias("high_mark"),
    )
    alike = F.when((F.col("p1") != F.col("high")) | (F.col("mark") != F.col("high_mark")), F.raise_error(F.lit("two different prefixes have one digest")).cast("long")).otherwise(F.col("n_convs"))
    root = _root(members.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0"))
    no = F.lit(None).cast("long")
    heavy = sums.filter(F.col("weight") > params.light_rows).select("k1", "k2", "p1", "p2", "conv_id", "depth", alike.alias("n_convs"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    heavy = heavy.unionByName(root.select("k1", "k2", no.alias("p1"), no.alias("p2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("own")))
    heavy = materialize(heavy, "heavy")
    # a light subtree's top is the child of a heavy node that isn't heavy itself
    named = hinted(heavy.select("k1", "k2", F.lit(True).alias("held")))
    light = rows.join(named, ["k1", "k2"], "left_anti")
    above = hinted(heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")))
    tops = materialize(light.join(above, ["p1", "p2"], "left_semi").select("conv_id", F.col("d").alias("top_d"), F.col("k1").alias("t1"), F.col("k2").alias("t2")), "light-tops")
    found = materialize(light_nodes(rows.join(tops.hint("shuffle_hash"), "conv_id").filter("d >= top_d"), params), "light-nodes")
    summed = _heavy_sums(heavy, found.filter("top"))
    parents = hinted(materialize(summed.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of_parent")), "heavy-parents"))
    columns = ("k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    upper = summed.withColumn("parent_conv_id", no).unionByName(found.filter("top"), allowMissingColumns=True).drop("parent_conv_id")
    upper = upper.join(parents, ["p1", "p2"], "left").withColumnRenamed("of_parent", "parent_conv_id")
    nodes = found.filter("not top").select(*columns).unionByName(upper.select(*columns))
    last = rows.filter("d = length").select("conv_id", "k1", "k2").unionByName(_root(members.filter("length = 0").select("conv_id")))
    out = nodes.join(ends(last, params), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    return out.select(*columns[2:], "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*grafted(read_table(spark, sf_dir, "conversations")))
