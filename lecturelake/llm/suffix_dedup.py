"""Suffix-array deduplication of byte strings by merging the Burrows-Wheeler transforms of shards.

Segments that can share a window are brought together by content (see ``repeats``). What meets in a task is
split into shards; each shard's suffixes are sorted on their own, and its transform is kept: for every suffix
in order, the block of bytes in front of it. The transforms are merged without sorting suffixes again. The
interleave of the shards starts as one block; in each round it is read in order, every suffix hands its shard's
bit to the place of the suffix that starts one block earlier, and stable counting by those blocks refines the
interleave by one block of bytes. Places where neighbours part are written down with the round, which gives
their common prefix; after width / block rounds the intervals left are the repeats of ``width`` bytes.

Defined results: null texts are empty; matches never cross documents; strings are judged on the input; a
text shorter than the width stays; rows that repeat whole repeat each other; what is kept of a text need not
be valid UTF-8, so it is binary; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import chunks, read_table
from lecturelake.llm.repeats import RepeatParams, covered, keyed, mask, split_documents


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values, from 1."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64) + 1


class Collection:
    """Suffixes of some byte strings, compared block by block; each string ends in a mark of its own."""

    def __init__(self, strings: list[np.ndarray], block: int):
        lengths = np.array([len(s) for s in strings])
        self.block, self.ends = block, np.cumsum(lengths)
        self.string = np.repeat(np.arange(len(strings)), lengths)
        data = np.concatenate(strings) if len(strings) else np.zeros(0, np.uint8)
        n = len(data)
        self.left = self.ends[self.string] - np.arange(n)  # bytes from here to the string's end
        self.offset = lengths[self.string] - self.left
        key = np.zeros(n, np.uint64)
        for i in range(block):
            key = key * np.uint64(256)
            key[: n - i] += data[i:]
        whole = self.left >= block
        self.rank = np.zeros(n, np.int64)
        self.rank[whole] = _dense(key[whole])
        top = int(self.rank.max(initial=0))
        self.rank[~whole] = top + 1 + np.arange(int((~whole).sum()))  # a block that holds the end mark is like no other
        self.small = top + int((~whole).sum()) < 2**16

    def sort(self, begin: int, end: int) -> np.ndarray:
        """Suffix array of the strings in positions begin to end, by doubling."""
        n, h = end - begin, self.block
        rank, left = self.rank[begin:end].copy(), self.left[begin:end]
        while True:
            order = np.argsort(rank)  # equal ones are told apart later
            ordered = rank[order]
            if n < 2 or (ordered[1:] != ordered[:-1]).all():
                return order + begin
            dense = np.zeros(n, np.int64)
            dense[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
            ahead = self.string[begin:end].copy()  # where a string ends just there, its mark: before all bytes, in order of strings
            some = np.flatnonzero(left > h)
            ahead[some] = dense[some + h] + int(ahead.max()) + 1
            rank, h = dense * (2 * int(ahead.max()) + 2) + ahead, 2 * h

    def transform(self, suffixes: np.ndarray) -> np.ndarray:
        """For each suffix in order the rank of the block in front of it, or 0 at a string's start."""
        before = np.zeros(len(suffixes), np.int64)
        some = self.offset[suffixes] >= self.block
        before[some] = self.rank[suffixes[some] - self.block]
        return before


def merge(collection: Collection, shards: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleaves sorted shards on their first rounds * block bytes.

    Gives suffixes in merged order, the number of the interval of equal beginnings that each is in, and
    the common prefix with the one before, in blocks (``rounds`` where it reaches that far).
    """
    kind = np.uint16 if collection.small else np.int64
    total = sum(map(len, shards))
    # transforms end to end; ``at`` holds the place in them of each suffix of the interleave
    front_of = np.concatenate([collection.transform(s) for s in shards]).astype(kind)
    starts = np.cumsum([0] + [len(s) for s in shards])
    short = [np.sort(collection.rank[s[collection.left[s] <= collection.block]]).astype(kind) for s in shards]
    edge = np.concatenate(short)
    bits = len(shards).bit_length()  # an interval's number and the shard travel in one number
    edge_tag = np.repeat(np.arange(len(shards)), [len(x) for x in short]).astype(np.int64)
    marks = (total + np.arange(len(edge)) << bits) | edge_tag
    tag = np.repeat(np.arange(len(shards)), [len(s) for s in shards]).astype(np.int64)
    at, shard = np.arange(total), tag
    common = np.full(total, rounds, np.int32)
    parts = np.ones(total, bool)
    for n in range(rounds):
        front = front_of[at]
        go = np.flatnonzero(front)
        symbols = np.concatenate([edge, front[go]])
        order = np.argsort(symbols, kind="stable") if collection.small else np.argsort(symbols * total + np.arange(total))
        # beyond its one block each suffix in ``edge`` meets a mark of its own
        tag = np.concatenate([marks if n else edge_tag, tag[go]])[order]
        symbols, before, shard = symbols[order], tag >> bits, tag & ((1 << bits) - 1)
        np.not_equal(symbols[1:], symbols[:-1], out=parts[1:])
        parts[1:] |= before[1:] != before[:-1]
        common[parts & (common == rounds)] = n
        interval = np.cumsum(parts)
        tag = interval << bits | shard
        for i in range(len(shards)):
            at[shard == i] = np.arange(starts[i], starts[i + 1])
    merged = np.empty(total, np.int64)
    for i, s in enumerate(shards):
        merged[shard == i] = s
    return merged, interval, common


def transform_engine(segments: list[np.ndarray], times: np.ndarray, width: int, shards: int = 2) -> list[np.ndarray]:
    """Repeated windows of each segment: intervals of equal beginnings in the merged transforms with two places or more."""
    block = max(b for b in range(1, 9) if width % b == 0)
    collection = Collection(segments, block)
    total = len(collection.string)
    cuts = np.unique(np.concatenate(([0], collection.ends[np.searchsorted(collection.ends, np.arange(1, shards) * total / shards)], [total])))
    sorted_shards = [collection.sort(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    suffixes, interval, _ = merge(collection, sorted_shards, width // block)
    places = np.bincount(interval, np.minimum(times, 2)[collection.string[suffixes]])
    often = np.zeros(total, bool)
    often[suffixes] = places[interval] > 1
    return [often[end - len(s) : end - width + 1] for s, end in zip(segments, collection.ends.tolist(), strict=True)]


PARAMS = RepeatParams(width=200, grams=(64, 110, 155, 190, 200), words=False, engine=transform_engine, batch_units=60_000, most_segments=400)


def remove_repeats(docs: DataFrame, params: RepeatParams = PARAMS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept (binary) for each document."""
    rows = keyed(docs)
    touched, clean = split_documents(rows, covered(rows, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4_000_000):
            counts, removed, runs, kept = [], [], [], []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                text = text or b""
                counts.append(len(text))
                if not spans:
                    removed.append(0)
                    runs.append([])
                    kept.append(text)
                    continue
                gone = mask(len(text), spans)
                change = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                runs.append([{"from": a, "to": b} for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)])
                removed.append(int(gone.sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.record_batch(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return touched.unionByName(clean).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<from:int,to:int>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
