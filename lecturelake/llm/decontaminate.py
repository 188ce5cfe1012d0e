"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

``build_index`` stores the postings of every token of the corpus once, by document shards: a row of the index
holds some documents, their distinct tokens in order, and each token's sorted positions. Any number of
searches read it; where one block of windows is all there is to search for, each task searches the shards that it
has just built, which then aren't stored. The windows of the test items are made and counted in Spark, and reach
the shards in blocks of a bounded size, one broadcast each, however long the benchmark is. A search walks each shard's posting
lists: a phrase starts with its rarest term, whose positions minus the term's offset are the candidate
starts, and every further list, shifted by its own offset, is intersected with them. With ``slack`` > 0 the
same walk gives proximity matches, where every term lies within ``slack`` tokens of its place in the phrase.

Words are told apart by 64-bit hashes.

Defined results: null and empty texts have no words, n_words 0 and no items; null item texts and null item_ids
have no windows; equal items are all reported, once each; item_ids sort as strings; an empty benchmark leaves
all clean; repeated rows and rows that share a doc_id or have none come out as they went in, judged by their
own text; very long texts are index rows of their own, in memory of some tens of bytes a byte; columns other
than those named may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import byte_view, chunks, content_key, list_array, materialize, read_table, table_columns, without
from lecturelake.llm._words import PLAIN_WORDS, signed, split_words, word_codes


@dataclass(frozen=True)
class PhraseParams:
    window: int = 10
    slack: int = 0
    """0: exact phrases; more: proximity matches."""
    gap: int = 64
    """Free positions between two documents of a shard: searches of this index may have window + slack below it."""
    shard_bytes: int = 1_000_000
    """Text bytes of one index row (or one longer document)."""
    block_windows: int = 200_000
    """Windows of one broadcast (some 40 MB), about."""


INDEX = "doc_ids array<long>, keys array<long>, n_words array<int>, terms array<long>, ends array<int>, positions array<int>"
HITS = "doc_id long, key long, n_words long, runs array<int>, items array<string>"


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _indexer(params: PhraseParams) -> Batches:
    """From batches of doc_id, text, key to rows of the index."""
    limit, gap = params.shard_bytes, params.gap

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", limit):
            data, off = byte_view(part.column(1))
            starts, ends, first = split_words(data, off, PLAIN_WORDS)
            codes = signed(word_codes(data, starts, ends, lower=True))
            n_words = np.diff(first)
            order = np.argsort(codes, kind="stable")
            position = order + np.repeat(np.arange(len(n_words)), n_words)[order] * gap
            ordered = codes[order]
            begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
            lists = (part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(), n_words, ordered[begins], np.append(begins[1:], len(ordered))[: len(begins)], position)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            columns = [list_array(x, np.array([0, len(x)]), t) for x, t in zip(lists[1:], kinds[1:], strict=True)]
            yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *columns], names=["doc_ids", "keys", "n_words", "terms", "ends", "positions"])

    return index


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", content_key(F.col("text")).alias("key"))


def build_index(docs: DataFrame, params: PhraseParams) -> DataFrame:
    """Posting lists of every word of every document."""
    return _texts(docs).mapInArrow(_indexer(params), INDEX)


def item_windows(benchmark: DataFrame, params: PhraseParams) -> DataFrame:
    """terms (word codes in order), items (ids as strings, sorted), block for each different window of the items."""
    width = params.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1_000_000):
            data, off = byte_view(part.column(1))
            starts, ends, first = split_words(data, off, PLAIN_WORDS)
            codes = signed(word_codes(data, starts, ends, lower=True))
            rows = [(item, codes[i : min(i + width, b)]) for item, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True) for i in range(a, max(b - width, a if b > a else a - 1) + 1)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["item", "terms"])

    items = table_columns(benchmark, "item_id", "text").filter("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    found = items.mapInArrow(cut, "item string, terms array<long>").groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = materialize(found, "item-windows")
    return found.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(max(1, -(-found.count() // params.block_windows)))))


Block = tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]


def _block(windows: DataFrame, width: int) -> Block:
    """Some windows as arrays: their different terms, a matrix of places in these (the last place fills short ones), lengths and items."""
    table = windows.select("terms", "items").toArrow()
    lists = table.column("terms").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    terms, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    matrix = np.full((len(lengths), width), len(terms))
    matrix[np.arange(width) < lengths[:, None]] = place
    return terms, matrix, lengths, table.column("items").to_pylist()


def _near(values: np.ndarray, places: np.ndarray, slack: int) -> np.ndarray:
    """For each value, whether a place lies within ``slack`` of it."""
    i = np.searchsorted(places, values - slack)
    ok = i < len(places)
    ok[ok] = places[i[ok]] <= values[ok] + slack
    return ok


def _searcher(spark: SparkSession, block: Block, params: PhraseParams) -> Batches:
    """From rows of the index to hits."""
    shared = spark.sparkContext.broadcast(block)  # block_windows windows, about
    slack, gap = params.slack, params.gap
    if params.window + slack >= gap:
        raise ValueError(f"a window of {params.window} words with a slack of {slack} needs an index with a gap over {params.window + slack}")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, matrix, lengths, names = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, keys = (batch.column(i)[r].values for i in range(2))
                n_words, known, ends, positions = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(2, 6))
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                counts, slot = np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, np.int64)
                counts[-1] = np.iinfo(np.int64).max  # where a short window has no term
                if len(known) and len(terms):
                    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
                    both = np.flatnonzero(terms[at] == known)
                    slot[at[both]], counts[at[both]] = both, (ends - begins)[both]
                offsets = np.concatenate(([0], np.cumsum(n_words + gap)))
                span, hits_of = np.zeros(int(offsets[-1]) + 1, np.int32), {}
                may = np.arange(len(lengths))
                for column in matrix.T:
                    may = may[counts[column[may]] > 0]
                for w in may:
                    mine = matrix[w]
                    first, *rest = np.argsort(counts[mine], kind="stable")[: lengths[w]].tolist()
                    s = slot[mine[first]]
                    at = positions[begins[s] : ends[s]] - first
                    for j in rest:
                        if not len(at):
                            break
                        s = slot[mine[j]]
                        at = at[_near(at + j, positions[begins[s] : ends[s]], slack)]
                    if slack and len(at):
                        document = np.searchsorted(offsets, at + first, side="right") - 1
                        at = np.maximum(at - slack, offsets[document])
                    if len(at):
                        np.add.at(span, at, 1)
                        np.add.at(span, np.minimum(at + lengths[w] + 2 * slack * (slack > 0), len(span) - 1), -1)
                        for d in np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist():
                            hits_of.setdefault(d, set()).update(names[w])
                covered = np.cumsum(span)[:-1] > 0
                runs, items = [], []
                for d in range(len(n_words)):
                    if d in hits_of:
                        mine = np.diff(np.concatenate(([0], covered[offsets[d] : offsets[d] + n_words[d]].view(np.int8), [0])))
                        runs.append(np.stack([np.flatnonzero(mine == 1), np.flatnonzero(mine == -1)], 1).ravel().tolist())
                        items.append(sorted(hits_of[d]))
                    else:
                        runs.append([])
                        items.append([])
                yield pa.record_batch([doc_ids, keys, pa.array(n_words.astype(np.int64)), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "runs", "items"])

    return walk


def search(index: DataFrame, block: Block, params: PhraseParams) -> DataFrame:
    """Hits of some windows in the index: for each document its covered token runs (start, end, start, ...) and items."""
    return index.mapInArrow(_searcher(index.sparkSession, block, params), HITS)


def search_once(docs: DataFrame, block: Block, params: PhraseParams) -> DataFrame:
    """The same for an index that is read once: each shard is searched by the task that has built it, and isn't stored."""
    index, walk = _indexer(params), _searcher(docs.sparkSession, block, params)
    return _texts(docs).mapInArrow(lambda batches: walk(index(batches)), HITS)


def _joined_runs(parts: DataFrame, blocks: int) -> DataFrame:
    """Unites what several blocks of windows found in the same document; rows that repeat whole come out as often."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column(3).to_pylist():
                merged: list[int] = []
                for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                out.append(merged)
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.list_(pa.int32())), batch.column(4)], names=["doc_id", "key", "n_words", "runs", "items"])

    grouped = parts.groupBy("doc_id", "key", "n_words").agg(
        F.collect_set("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies")
    )
    again = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "key", "n_words", "runs", "items")
    return again.mapInArrow(unite, HITS)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, params: PhraseParams | None = None) -> DataFrame:
    """doc_id, key, n_words, runs (covered token spans, flat) and items (ids as strings, sorted) of every document."""
    params = params or PhraseParams()
    windows = item_windows(benchmark, params)
    blocks = _blocks(windows)
    if len(blocks) == 1:
        return search_once(docs, _block(windows, params.window), params)
    return search_all(materialize(build_index(docs, params), "positions"), windows, params)


def _blocks(windows: DataFrame) -> list[int]:
    return [r.block for r in windows.select("block").distinct().orderBy("block").collect()] or [0]


def search_all(index: DataFrame, windows: DataFrame, params: PhraseParams) -> DataFrame:
    """Hits of all windows, block by block, in an index that is there already."""
    blocks = _blocks(windows)
    found = None
    for block in blocks:
        part = search(index, _block(windows.filter(F.col("block") == block), params.window), params)
        if len(blocks) > 1:
            part = materialize(part, "phrases")  # so that the driver lets a block go before it reads the next
        found = part if found is None else found.unionByName(part)
    return found if len(blocks) == 1 else _joined_runs(found, len(blocks))


def contamination(docs: DataFrame, benchmark: DataFrame, params: PhraseParams | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = phrase_matches(docs, benchmark, params)
    n_hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: PhraseParams | None = None) -> DataFrame:
    """Documents in which no benchmark phrase occurs, all columns kept."""
    found = phrase_matches(docs, benchmark, params).filter(F.size("runs") > 0).select("doc_id", "key").distinct()
    return without(docs, materialize(found, "contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
