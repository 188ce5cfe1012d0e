"""Substring deduplication with suffix automata and matching statistics.

The reference is the corpus itself. Broadcasting automata of all of it would grow with the data, so its
stretches are first dealt by content (see ``repeats``): a shard is the set of segments that can share a
window at all, and only segments that aren't decided by being copies as a whole reach one. Each shard builds
a generalised suffix automaton over its segments, with the number of places of every state; the segments
stream through it, and where the state of the last ``width`` words has two places or more, the window is
repeated. Maximal covered spans go.

A reference that is small and fixed can be given instead: ``remove_reference`` broadcasts its automata in
shards of a bounded size and removes spans of at least ``width`` words that match it.

Defined results: null texts have no words; windows are judged on the input; a text shorter than a window
stays; rows that repeat whole repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import chunks, read_table
from lecturelake.llm.repeats import RepeatParams, covered, keyed, mask, split_documents


class SuffixAutomaton:
    """All substrings of some sequences: transitions, suffix links, lengths and numbers of places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.next) - 1

    def _extend(self, last: int, c) -> int:
        nexts, length, link = self.next, self.length, self.link
        have = nexts[last].get(c)
        if have is not None:  # another sequence came this way
            if length[have] == length[last] + 1:
                return have
            return self._clone(last, c, have)
        new = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence, times: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.places[last] += times

    def count(self) -> SuffixAutomaton:
        """Adds each state's places to the state of its longest other suffix, longest first."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]
        return self

    def statistics(self, sequence) -> Iterator[tuple[int, int]]:
        """For each end in the sequence: the state and length of the longest match that ends there."""
        state = size = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            yield state, size

    def suffix(self, state: int, width: int) -> int:
        """State of the last ``width`` symbols of a match that is at least as long."""
        while self.length[self.link[state]] >= width:
            state = self.link[state]
        return state


def automaton_engine(segments: list[np.ndarray], times: np.ndarray, width: int) -> list[np.ndarray]:
    """Repeated windows of the segments that occur once, by matching statistics against all of them."""
    sequences = [s.tolist() for s in segments]
    automaton = SuffixAutomaton()
    for s, n in zip(sequences, times.tolist(), strict=True):
        automaton.add(s, min(n, 2))
    automaton.count()
    out = []
    for s, n in zip(sequences, times.tolist(), strict=True):
        hit = np.full(max(0, len(s) - width + 1), n > 1)
        if n == 1:
            for end, (state, size) in enumerate(automaton.statistics(s)):
                if size >= width and end >= width - 1:
                    hit[end - width + 1] = automaton.places[automaton.suffix(state, width)] > 1
        out.append(hit)
    return out


PARAMS = RepeatParams(width=35, grams=(8, 17, 26, 32, 35), words=True, engine=automaton_engine, batch_units=20_000)


def remove_repeats(docs: DataFrame, params: RepeatParams = PARAMS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each document."""
    rows = keyed(docs)
    touched, clean = split_documents(rows, covered(rows, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 4_000_000):
            counts, removed, kept = [], [], []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = mask(len(words), spans)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, (~gone).tolist()) if spans else words))
            yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return touched.unionByName(clean).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_reference(docs: DataFrame, reference: list[str], width: int = 35, shard_words: int = 50_000) -> DataFrame:
    """doc_id, n_removed, kept: spans of at least ``width`` words that occur in the reference go.

    The reference is a list on the driver; its automata are broadcast one shard of ``shard_words`` words at a time.
    """
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for text in reference:
        words = text.encode().split()
        if held and held + len(words) > shard_words:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    out = docs.select(F.col("doc_id").cast("long"), "text", F.expr("cast(array() as array<struct<from:int,to:int>>)").alias("spans"))
    for shard in shards:
        automaton = SuffixAutomaton()
        for words in shard:
            automaton.add(words)
        shared = docs.sparkSession.sparkContext.broadcast((automaton.next, automaton.link, automaton.length))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reader = SuffixAutomaton()
            reader.next, reader.link, reader.length = shared.value
            for b in batches:
                found = []
                for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    ends = [(end, size) for end, (_, size) in enumerate(reader.statistics((text or b"").split())) if size >= width]
                    found.append(spans + [{"from": end - size + 1, "to": end + 1} for end, size in ends])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], names=["doc_id", "text", "spans"])

        out = out.mapInArrow(match, "doc_id long, text string, spans array<struct<from:int,to:int>>")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = mask(len(words), spans)
                removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, (~gone).tolist())))
            yield pa.record_batch([b.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_removed", "kept"])

    return out.mapInArrow(drop, "doc_id long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
