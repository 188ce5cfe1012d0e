"""Exact repeats of fixed-width windows over a whole corpus: the routing that substring and suffix dedup share.

A window's anchor is the smallest hash among the short grams inside it, so equal windows have equal anchors.
Each document is cut into segments, maximal runs of windows with one anchor. Only segments whose anchor
occurs again anywhere can hold a repeated window; of these, segments that occur whole at least twice are
repeated throughout. What is left (a segment that is alone but shares its anchor with others, or holds its
anchor twice) must also share the stretch of half the other units to the left or to the right of its anchor,
as any repeated window does. An engine reads the distinct segments of one anchor side by side and tells the
repeated windows. Anchors are dealt over the cluster. An anchor with more distinct segments than a task should
read, such as the edge of a passage that countless documents hold, is split: its segments are cut again by the
next longer gram, and what that leaves goes to the same engine.

Identities of segments are 64-bit hashes, compared only among segments of one anchor.

Defined results: nulls are empty texts; very long texts are cut like others, in memory of some tens of bytes a
byte of the longest; repeated rows repeat each other; ties don't arise; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.llm._spark import ROWS_A_PART, byte_view, chunks, hinted, materialize, spread_join
from lecturelake.llm._words import BYTE_CODES, SPACE_WORDS, Rolling, signed, sliding_min, split_words, stretches, word_codes

Engine = Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]
"""(distinct segments, occurrences of each, width) -> for each segment, which of its windows occur twice or more."""


@dataclass(frozen=True)
class RepeatParams:
    width: int
    grams: tuple[int, ...]
    """Lengths of the grams that anchors are taken from: the first for all windows, each further one for the segments of anchors that are still too many for a task."""
    words: bool
    engine: Engine
    batch_units: int
    """Words or bytes that an engine reads at once (or one larger anchor)."""
    most_segments: int = 150
    """Distinct segments of an anchor that one task reads side by side."""
    chunk_bytes: int = 1_000_000

    def units(self, part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words (64 bits) or bytes of each text, and the offsets of the texts."""
        data, off = byte_view(part.column(column))
        if not self.words:
            return data, off
        starts, ends, first = split_words(data, off, SPACE_WORDS)
        return word_codes(data, starts, ends, lower=False), first


def keyed(docs: DataFrame) -> DataFrame:
    """doc, key, doc_id, text: doc and key name a row; rows that repeat whole share them."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def cut(codes: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments: text, start (in the text), windows, anchor, identity of the content, whether the anchor occurs twice in it, and
    32-bit hashes of the stretches to the left and to the right of the anchor that a window with most of its other units there holds (0: none)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool, np.int64, np.int64))
    if len(codes) < width:
        return none
    counts = np.diff(first)
    rolling = Rolling(BYTE_CODES[codes] if codes.dtype == np.uint8 else codes)
    span = width - gram + 1  # grams in a window
    grams = rolling.windows(gram)
    least = sliding_min(grams, span)
    valid = np.zeros(len(least) + 1, np.int8)  # windows inside one text
    long = np.flatnonzero(counts >= width)
    np.add.at(valid, first[long], 1)
    np.add.at(valid, first[long + 1] - width + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    least[~valid] = 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[first[long]] = True
    starts = np.flatnonzero(new)
    if not len(starts):
        return none
    last = np.zeros(len(least) + 1, bool)
    last[starts] = True
    last[np.flatnonzero(valid[:-1] & ~valid[1:]) + 1] = True
    last[-1] = True
    stops = np.flatnonzero(last)
    windows = stops[np.searchsorted(stops, starts) + 1] - starts
    # places whose gram is the smallest of some window; equal neighbours among them are an anchor that a segment holds twice
    most = ~sliding_min(~np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64))), span)
    places = np.flatnonzero(grams == most)
    twice = np.zeros(len(places), np.int64)
    twice[1:] = np.cumsum(grams[places[1:]] == grams[places[:-1]])
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, starts + windows + span - 1) - 1
    anchor, ends = least[starts], starts + windows + width - 1
    at = lo.copy()
    while len(wrong := np.flatnonzero(grams[places[at]] != anchor)):
        at[wrong] += 1
    place, half = places[at], -(-(width - gram) // 2)
    sides = []
    for begin, end, inside in ((place - half, place, place - half >= starts), (place + gram, place + gram + half, place + gram + half <= ends)):
        side = np.zeros(len(starts), np.uint64)
        side[inside] = rolling.of(begin[inside], end[inside]) | np.uint64(1)
        sides.append((side >> np.uint64(33)).astype(np.int64) + (side > 0))
    text = np.searchsorted(first, starts, side="right") - 1
    return text, starts - first[text], windows, anchor, stretches(codes, starts, ends), twice[np.maximum(hi, lo)] > twice[lo], sides[0], sides[1]


SEGMENT = "anchor long, seg long, n int, doc long, key long, start int, windows int, twice boolean, left long, right long"


def _segment_batch(found: tuple[np.ndarray, ...], n: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    _, _, windows, anchor, seg, twice, left, right = found
    columns = [signed(anchor), signed(seg), n.astype(np.int32), doc, key, start.astype(np.int32), windows.astype(np.int32), twice, left, right]
    return pa.record_batch([pa.array(c) for c in columns], names=[x.split()[0] for x in SEGMENT.split(", ")])


def segments(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """Every segment of every document by the first gram, each occurring once (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", params.chunk_bytes):
            codes, first = params.units(part, 3)
            found = cut(codes, first, params.width, params.grams[0])
            doc, key = (part.column(i).to_numpy(zero_copy_only=False)[found[0]] for i in range(2))
            yield _segment_batch(found, np.ones(len(doc)), doc, key, found[1])

    return docs.mapInArrow(run, SEGMENT)


def cut_again(contents: DataFrame, params: RepeatParams, gram: int) -> DataFrame:
    """Segments by a longer gram of segments whose contents are given; n and places come from those."""
    unit = np.uint64 if params.words else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "content", params.chunk_bytes):
            data, off = byte_view(part.column(5))
            codes, first = (np.frombuffer(data.tobytes(), unit), off // np.dtype(unit).itemsize)
            found = cut(codes, first, params.width, gram)
            n, doc, key, start = (part.column(i).to_numpy(zero_copy_only=False)[found[0]] for i in range(1, 5))
            yield _segment_batch(found, n, doc, key, start + found[1])

    return contents.select("anchor", "n", "doc", "key", "start", "content").mapInArrow(run, SEGMENT)


def covered(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """doc, key, spans (array of from, to in words or bytes) of every document with a repeated window. docs: as keyed() gives."""
    made = materialize(segments(docs, params), "segments")
    out, crowded = _settled(docs, made, params)
    for gram in params.grams[1:]:
        if crowded.isEmpty():
            break
        # at the last gram, the width itself, a segment is one window and the segments of an anchor are one
        more, crowded = _settled(docs, materialize(cut_again(crowded, params, gram), "segments-again"), params, gram == params.width)
        out = out.unionByName(more)
    return out.groupBy("doc", "key").agg(F.collect_set("span").alias("spans"))


def _settled(docs: DataFrame, made: DataFrame, params: RepeatParams, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, key, span) of repeated windows of the segments, and contents of those whose anchor is still crowded."""
    again = made.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("twice").alias("twice"))
    rows = F.ceil(F.col("n") / ROWS_A_PART).cast("int").alias("parts")
    again = materialize(again.filter("n > 1 or twice").select("anchor", (F.col("twice") | (F.col("low") != F.col("high"))).alias("mixed"), F.col("twice").alias("keep"), rows), "anchors-again")
    alive = materialize(_of_anchors(made.drop("twice"), again), "segments-alive")
    whole = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("windows") + params.width - 1).alias("to"))
    plain = alive.filter("not mixed").select("doc", "key", whole.alias("span"))

    place = F.struct("doc", "key", "start", "windows")
    distinct = alive.filter("mixed").groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.min(place).alias("at"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("keep").alias("keep"))
    distinct = materialize(distinct, "segments-distinct")
    copied = spread_join(alive.filter("mixed"), distinct.filter("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select("doc", "key", whole.alias("span"))

    sides = distinct.select("anchor", "keep", F.explode(F.array(F.col("left"), -F.col("right"))).alias("side")).filter("side <> 0 and not keep").groupBy("anchor", "side").count().filter("count > 1")
    sides = materialize(sides.select("anchor", "side"), "segment-sides")
    left, right = (sides.select(F.col("anchor"), (F.col("side") * sign).alias(name), F.lit(True).alias(f"by_{name}")) for name, sign in (("left", 1), ("right", -1)))
    near = spread_join(spread_join(distinct, left, ["anchor", "left"], "left"), right, ["anchor", "right"], "left")
    near = materialize(near.filter("keep or by_left or by_right").select("anchor", "seg", "n", "at"), "segments-near")
    asked = near.groupBy("anchor").agg(F.count("*").alias("segments"), F.min("n").alias("least")).filter("least = 1")
    asked = materialize(asked.select("anchor", (F.lit(not last) & (F.col("segments") > params.most_segments)).alias("crowded")), "anchors-asked")
    contents = materialize(_contents(docs, spread_join(near, asked, ["anchor"]), params), "segment-contents")
    judged = _judged(contents.filter("not crowded"), params).select("doc", "key", F.explode("spans").alias("span"))
    return plain.unionByName(copied).unionByName(judged), contents.filter("crowded")


def _of_anchors(made: DataFrame, again: DataFrame) -> DataFrame:
    """Segments of the given anchors. Both sides grow with the corpus, so they shuffle at every size; an anchor of many segments is dealt in parts."""
    hot = hinted(again.filter("parts > 1").select("anchor", "parts"))
    dealt = made.join(hot, "anchor", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc", "key", "start"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(copies.hint("shuffle_hash"), ["anchor", "part"]).drop("part")


def _contents(docs: DataFrame, open_segments: DataFrame, params: RepeatParams) -> DataFrame:
    """The words' codes or bytes of one place of each open segment."""
    where = open_segments.select("at.doc", "at.key", F.struct("anchor", "seg", "n", "crowded", F.col("at.start").alias("start"), F.col("at.windows").alias("windows")).alias("s"))
    lists = materialize(where.groupBy("doc", "key").agg(F.collect_list("s").alias("s")), "segment-places")
    some = docs.join(hinted(lists.select("doc", "key")), ["doc", "key"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", params.chunk_bytes):
            codes, first = params.units(part, 2)
            rows = []
            for i, found in enumerate(part.column(3).to_pylist()):
                for s in found:
                    a = first[i] + s["start"]
                    rows.append((s["anchor"], s["seg"], s["n"], s["crowded"], part.column(0)[i].as_py(), part.column(1)[i].as_py(), s["start"], s["windows"], codes[a : a + s["windows"] + params.width - 1].tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "seg", "n", "crowded", "doc", "key", "start", "windows", "content"])

    # rows that repeat whole have one content: the first of them is enough
    joined = some.join(lists, ["doc", "key"]).select("doc", "key", "text", "s").dropDuplicates(["doc", "key"])
    return joined.mapInArrow(run, "anchor long, seg long, n long, crowded boolean, doc long, key long, start int, windows int, content binary")


JUDGED = "doc long, key long, spans array<struct<from:int,to:int>>"


def _spans(hit: np.ndarray, start: int, width: int) -> list[dict]:
    """Covered stretches from the repeated windows of one segment."""
    if not hit.any():
        return []
    cover = np.zeros(len(hit) + width, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    inside = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
    return [{"from": int(a) + start, "to": int(b) + start} for a, b in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1), strict=True)]


def _judged(contents: DataFrame, params: RepeatParams) -> DataFrame:
    """Runs the engine over anchors, some at a time; gives the spans of segments that are alone."""
    unit = np.uint64 if params.words else np.uint8
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judge() -> pa.RecordBatch:
            marks = params.engine([np.frombuffer(r[7], unit) for r in held], np.array([r[2] for r in held]), params.width)
            rows = [(r[3], r[4], _spans(m[: r[6]], r[5], params.width)) for r, m in zip(held, marks, strict=True) if r[2] == 1]
            rows = [r for r in rows if r[2]]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc", "key", "spans"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if size >= params.batch_units and row[0] != held[-1][0]:
                    yield judge()
                    held, size = [], 0
                held.append(row)
                size += row[6] + params.width
        if held:
            yield judge()

    dealt = contents.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "seg", "n", "doc", "key", "start", "windows", "content").mapInArrow(run, JUDGED)


def split_documents(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, spans) of documents with spans, and those without (spans null); texts shuffle only where there are many."""
    spans = materialize(spans, "covered")
    keys = spans.select("doc", "key")
    touched = docs.join(hinted(keys), ["doc", "key"], "left_semi").join(spans, ["doc", "key"]).select("doc_id", "text", "spans")
    clean = docs.join(hinted(keys), ["doc", "key"], "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<from:int,to:int>>").alias("spans"))
    return touched, clean


def mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units are covered."""
    if not spans:
        return np.zeros(n, bool)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, [s["from"] for s in spans], 1)
    np.add.at(cover, [s["to"] for s in spans], -1)
    return np.cumsum(cover[:-1]) > 0
