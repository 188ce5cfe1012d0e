"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one atomic group; groups are ordered by a digest of their text. The
smallest capacity that lets a greedy left-to-right fill reach the end with the given number of shards is
found by binary search, and the groups are cut there. The driver never sees all groups: it holds sums of
hash blocks (a fixed number of them), brackets the answer with them, and then reads the groups of the few
blocks in which a cut can still fall, splitting blocks further while those are too many.

Defined results: null texts are a group of their own with size 1 each; equal texts always share a shard; a shard's
slots go by doc_id modulo the cells, then doc_id, size and checksum, with a null doc_id first in the first
cell; rows that repeat whole take neighbouring slots; a very long text counts as one group like any other and
may fill a shard alone; columns other than doc_id and text may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lecturelake.llm._spark import materialize, read_table, table_columns


@dataclass(frozen=True)
class ShardParams:
    n_shards: int = 16
    block_bits: int = 12
    """Hash blocks in a first pass: 2**block_bits sums reach the driver."""
    refine_bits: int = 8
    """A block that must be looked into is split into 2**refine_bits parts."""
    detail_groups: int = 200_000
    """Groups that the driver may read one by one in the last step."""
    cells: int = 256
    """Parts of a shard that are numbered on their own, so that no task sorts a whole shard."""


#: Stands for a null text where groups are put in order.
NULL_TEXT = "\x00null"


def _order_key(text: Column) -> Column:
    """Place of a text's group on the line: a signed 64-bit number from the first 60 bits of a digest."""
    digits = F.substring(F.md5(F.coalesce(text, F.lit(NULL_TEXT)).cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") - F.lit(1 << 59)) * 16


class _Line:
    """Ordered pieces (key, size) of the whole line; a piece is a group or a block of them, and ``atomic`` says which."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.sizes, self.atomic = keys[order], sizes[order], counts[order] <= 1
        self.ends = np.cumsum(self.sizes)
        self.total = int(self.ends[-1]) if len(keys) else 0
        self._ends = self.ends.tolist()

    def reach(self, start: int, capacity: int) -> tuple[int, int, int]:
        """Least and most that a shard from ``start`` can end at, and the piece that the cut falls into (or -1)."""
        goal = start + capacity
        i = bisect_right(self._ends, goal)
        low = self._ends[i - 1] if i else 0
        if i == len(self._ends):
            return self.total, self.total, -1
        return (low, low, -1) if self.atomic[i] else (low, goal, i)

    def fill(self, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether ``capacity`` suffices (None: the sums don't tell), and the pieces that leave it open."""
        low = high = 0
        open_pieces: set[int] = set()
        for _ in range(shards):
            low_a, _, piece_a = self.reach(low, capacity)
            _, high_b, piece_b = self.reach(high, capacity)
            first, last = bisect_right(self._ends, low + capacity), min(bisect_right(self._ends, high + capacity), len(self._ends) - 1)
            if piece_a >= 0 or piece_b >= 0 or low != high:
                open_pieces.update(i for i in range(first, last + 1) if not self.atomic[i])
            low, high = low_a, max(low_a, high_b)
        if low >= self.total:
            return True, open_pieces
        return (False if high < self.total else None), open_pieces


def _cuts(groups: DataFrame, params: ShardParams) -> list[int]:
    """Largest key of each shard but the last; groups: key long (ordered as signed), size long."""
    bits = params.block_bits
    block = lambda b: F.shiftright("key", 64 - b)
    coarse = groups.groupBy(block(bits).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"), F.max("key").alias("key")).collect()
    if not coarse:
        return []
    pieces = {r.b: (r.key, int(r["size"]), r.n) for r in coarse}
    largest = max(int(r.most) for r in coarse)
    groups_of = {b: (bits, b) for b in pieces}
    total = sum(p[1] for p in pieces.values())
    low, high = max(largest, -(-total // params.n_shards)) - 1, total
    while True:
        names = list(pieces)
        line = _Line(*(np.array([pieces[x][i] for x in names], dtype=np.int64) for i in range(3)))
        ordered = [names[i] for i in np.argsort(np.array([pieces[x][0] for x in names], dtype=np.int64), kind="stable")]
        unknown: set[int] = set()
        lo, hi = low, high
        while hi - lo > 1:  # lo fails, hi suffices
            middle = (lo + hi) // 2
            enough, pieces_open = line.fill(middle, params.n_shards)
            if enough is None:
                unknown = pieces_open
                break
            lo, hi = (lo, middle) if enough else (middle, hi)
        low, high = lo, hi
        if not unknown:
            _, unknown = line.fill(high, params.n_shards)
        if not unknown:
            return _greedy(line, high, params.n_shards)
        wanted = [ordered[i] for i in sorted(unknown)]
        few = sum(pieces[x][2] for x in wanted) <= params.detail_groups
        by_bits: dict[int, list[int]] = {}
        for x in wanted:
            by_bits.setdefault(groups_of[x][0], []).append(groups_of[x][1])
        for depth, blocks in by_bits.items():
            part = groups.filter(block(depth).isin(blocks))
            if few:
                rows = [((depth, r.key), r.key, int(r["size"]), 1, 64, r.key) for r in part.select("key", "size").collect()]
            else:
                finer = min(64, depth + params.refine_bits)
                sums = part.groupBy(block(finer).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("key").alias("key")).collect()
                rows = [((finer, r.b), r.key, int(r["size"]), r.n, finer, r.b) for r in sums]
            for x in [x for x in wanted if groups_of[x][0] == depth]:
                del pieces[x]
            for name, key, size, n, d, b in rows:
                pieces[name], groups_of[name] = (key, size, n), (d, b)


def _greedy(line: _Line, capacity: int, shards: int) -> list[int]:
    cuts, start = [], 0
    for _ in range(shards - 1):
        end, _, _ = line.reach(start, capacity)
        at = bisect_left(line._ends, end) if end else -1
        cuts.append(int(line.keys[at]) if at >= 0 else -(2**63))
        start = end
    return cuts


def minimax_shards(docs: DataFrame, params: ShardParams | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document.

    The law is ``bytes``: the largest shard is as small as whole groups in hash order allow.
    """
    params = params or ShardParams()
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        table_columns(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            _order_key(F.col("text")).alias("key"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = _cuts(groups, params)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") > F.lit(cut)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("cell", F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(params.cells)), F.lit(0)).cast("int"))
    counts = placed.groupBy("shard", "cell").count().withColumnRenamed("count", "n")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).select(
        F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce("before", F.lit(0)).alias("before")
    )
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(before), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))  # n_shards * cells rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(read_table(spark, sf_dir, "documents"))
