"""N-gram Jaccard join by prefixes of token combinations, and the components of its links.

A document is the set of its distinct k-word shingles. Tokens (shingles) have one global order: those in
few documents first, the frequent class after them by document frequency. A set's prefix holds rare tokens,
each an index entry of its own, until one more than a partner may miss; a set with too few rare tokens
extends its prefix into its frequent ones, and there each entry is a combination of two neighbours in the
order. With m = n - ceil(J n) tokens that a set can miss, d the most by which the two sets can differ in
all, and r < m + 1 rare tokens, d + m - 2 r + 2 frequent tokens suffice: a missed token breaks at most two
neighbouring pairs and a foreign one breaks at most one, so a pair of linked sets shares an entry. Frequent
tokens are those whose count over all documents reaches a bound; counts are exact up to hash collisions of
38 bits or more, which can only move a token into the frequent class, alike for all documents.

Equal sets are joined first and stand for each other. Members of an entry are compared with one pivot, then
with ever more of them, and only across components and where sizes and rare tokens let them be alike; an
entry is done once it lies in one component or all its members have been pivots, so that no link between
different texts is lost. An entry of combinations with a crowd of members that don't link, such as pages put together
from the same blocks, gives way to finer ones of its members (see ``crowd_bands``), of which any two sets that link
share one, whatever their hashes are. Pairs that small parity maps of their sets don't rule out are verified on the
whole sets of 64-bit token hashes.

Identities of words and shingles are 64-bit hashes, those of sets 128-bit ones.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer than k words
is one shingle; rows that repeat whole are one document for links, and of them one stays in ``drop_near_copies``
unless they have no words; rows that share a doc_id but not the text, or have none, are documents of their own;
a component without any doc_id has a null component_id; of documents that could stay, the smallest doc_id does;
very long texts are shingled whole, in memory of some tens of bytes a byte; columns other than doc_id and text
may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lecturelake.llm._spark import ROWS_A_PART, chunks, content_key, hinted, materialize, one_of_each, read_table, spread_join, without
from lecturelake.llm._words import U64, joined, mix, signed
from lecturelake.llm.graph import components
from lecturelake.llm.sketch import document_sets, shared_entries


@dataclass(frozen=True)
class LinkParams:
    """What any near-copy operator has: which sets link, and how entries are compared."""

    words: int = 5
    num: int = 80
    den: int = 100
    """Sets link when den * intersection >= num * union."""
    pivots: int = 64
    """Members of each entry that its other members are compared with in the second round; each round has so many times more than the one before."""
    crowd: int = 64
    """Members of an entry from which it gives way to finer ones."""
    finer: tuple[tuple[int, int, int], ...] = ((1, 1, 4), (48, 2, 6))
    """For the finer entries of a crowd's members (see token_bands): from how many tokens on that two sets may differ in, cells that an entry leaves out, and cells of a group. More cells left out of more make more and finer entries, which large sets need."""
    first_entries: int = 32
    """Of each document's open entries, the first so many tell that a pair meets in an earlier one already."""
    chunk_bytes: int = 700_000
    frequent: int = 16
    """Document frequency from which a token is of the frequent class."""
    frequent_tokens: int = 1_000_000
    """Most tokens of the frequent class (it is broadcast: 16 bytes each); beyond it the frequency bound doubles."""


class JaccardParams(LinkParams):
    """Those of the join by prefixes."""


def set_digests(docs: DataFrame, params: LinkParams) -> DataFrame:
    """doc_id, key (see content_key), n (set size), s1, s2 (128-bit digest of the set), map (parities, see parity_map)."""
    k, limit = params.words, params.chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", limit):
            codes, off = document_sets(part, k)
            maps = [parity_map(codes[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            sums = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes ^ U64(salt)))))
                sums.append(signed(total[off[1:]] - total[off[:-1]]))
            yield pa.record_batch([part.column(0), part.column(2), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(sums[1]), pa.array(maps, pa.binary())], names=["doc_id", "key", "n", "s1", "s2", "map"])

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, n long, s1 long, s2 long, map binary")


def parity_map(tokens: np.ndarray) -> bytes:
    """A bit for each cell of a table of some 2 n cells: whether an odd number of tokens fall there."""
    size = max(64, 1 << int(2 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens >> U64(7) & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Tokens that two sets differ in, at least: cells with different parities. The longer map is folded to the shorter's size."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bits(spark: SparkSession) -> int:
    """Bits of the token space's parts: some parts for each shuffle partition."""
    return max(6, min(16, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))


def frequent_tokens(docs: DataFrame, params: LinkParams) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted token prefixes of the frequent class, their document frequencies, and the bits of a prefix."""
    spark = docs.sparkSession
    bits, k, limit, least = _bits(spark), params.words, params.chunk_bytes, params.frequent
    shift = 32 - bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", limit):
            codes, _ = document_sets(part, k)
            cells, n = np.unique(codes >> U64(shift), return_counts=True)
            edges = np.searchsorted(cells, np.arange(2**bits + 1, dtype=np.uint64) << U64(32))
            used = np.flatnonzero(np.diff(edges))
            low, n = (cells & U64(0xFFFFFFFF)).astype(np.uint32), n.astype(np.uint32)
            blobs = [(low[edges[b] : edges[b + 1]].tobytes(), n[edges[b] : edges[b + 1]].tobytes()) for b in used]
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array([x[0] for x in blobs], pa.binary()), pa.array([x[1] for x in blobs], pa.binary())], names=["bucket", "cells", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for bucket, cells, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(bucket, []).append((np.frombuffer(cells, np.uint32), np.frombuffer(n, np.uint32)))
        for bucket, parts in held.items():
            cells, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(cells, kind="stable")
            cells, n = cells[order], n[order].astype(np.int64)
            begins = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            df = np.add.reduceat(n, begins)
            keep = df >= least
            yield pa.record_batch([pa.array((cells[begins][keep].astype(np.int64)) | (bucket << 32)), pa.array(df[keep])], names=["cell", "df"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.mapInArrow(count, "bucket int, cells binary, n binary").repartition(parts, "bucket").mapInArrow(total, "cell long, df long")
    counted = materialize(counted, "token-frequencies")
    bound = least
    while counted.filter(F.col("df") >= bound).count() > params.frequent_tokens:
        bound *= 2
    table = counted.filter(F.col("df") >= bound).toArrow()  # as columns, not a Python object for each number
    cell, df = (table.column(name).to_numpy() for name in ("cell", "df"))
    order = np.argsort(cell, kind="stable")
    return cell[order].astype(np.uint64), df[order], shift


ENTRY = "sig long, doc long, n int, rare int, many boolean"


def entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, int], params: LinkParams) -> DataFrame:
    """Index entries: sig, doc, n, rare (tokens of the rare class), many (whether the entry is a combination of frequent tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # frequent_tokens rows at most
    k, limit, num, den = params.words, params.chunk_bytes, params.num, params.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, df, shift = shared.value
        for part in chunks(batches, "text", limit):
            codes, off = document_sets(part, k)
            n = np.diff(off)
            owner = np.repeat(np.arange(len(n)), n)
            known = np.zeros(len(codes), np.int64)
            if len(cells):
                mine = codes >> U64(shift)
                at = np.searchsorted(cells, mine)
                at[at == len(cells)] = 0
                known = np.where(cells[at] == mine, df[at], 0)
            order = np.lexsort((codes, known, owner))
            codes, known = codes[order], known[order]
            rare = np.bincount(owner, known == 0, len(n)).astype(np.int64)
            miss, differ = n - -(-num * n // den), (den - num) * n // num
            singles = np.minimum(rare, miss + 1)
            wanted = np.where(rare > miss, 0, np.minimum(n - rare, differ + miss - 2 * rare + 2))
            dead = differ == 0  # only an equal set links
            singles[dead], wanted[dead] = 0, 0
            place = np.arange(len(codes)) - off[:-1][owner]
            one = np.flatnonzero(place < singles[owner])
            two = np.flatnonzero((place >= rare[owner]) & (place < rare[owner] + wanted[owner] - 1))
            sig = np.concatenate([mix(codes[one] ^ U64(0x51)), joined(codes[two], codes[np.minimum(two + 1, len(codes) - 1)])]) if len(codes) else codes
            owners = np.concatenate([owner[one], owner[two]])
            ids = part.column(0).to_numpy(zero_copy_only=False)
            many = np.zeros(len(sig), bool)
            many[len(one) :] = True
            yield pa.record_batch([pa.array(signed(sig)), pa.array(ids[owners].astype(np.int64)), pa.array(n[owners].astype(np.int32)), pa.array(rare[owners].astype(np.int32)), pa.array(many)], names=["sig", "doc", "n", "rare", "many"])

    return docs.mapInArrow(run, ENTRY)


def live_entries(docs: DataFrame, params: LinkParams) -> DataFrame:
    """Entries that several documents share, as far as a task sees them: rare ones exactly, combinations all."""
    made = entries(docs, frequent_tokens(docs, params), params)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            many = b.column(4).to_numpy(zero_copy_only=False)
            if many.any():
                yield b.filter(b.column(4))
            rest = ~many
            held.append([b.column(i).to_numpy()[rest] for i in range(4)])
        if not held:
            return
        sig, doc, n, rare = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(sig, kind="stable")
        sig, doc, n, rare = sig[order], doc[order], n[order], rare[order]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        keep = same[1:] | same[:-1]
        for at in range(0, int(keep.sum()), 100_000):
            part = np.flatnonzero(keep)[at : at + 100_000]
            yield pa.record_batch([pa.array(sig[part]), pa.array(doc[part]), pa.array(n[part]), pa.array(rare[part]), pa.array(np.zeros(len(part), bool))], names=["sig", "doc", "n", "rare", "many"])

    # a combination may lie in a third of all documents, so its documents are dealt by themselves
    deal = F.when(F.col("many"), F.xxhash64("sig", "doc")).otherwise(F.col("sig"))
    return materialize(made.repartition(parts, deal).mapInArrow(shared, ENTRY), "jaccard-entries")


def stored_sets(docs: DataFrame, ids: DataFrame, params: LinkParams) -> DataFrame:
    """doc, tokens (sorted 64-bit hashes, packed) of the documents whose ids are given."""
    k, limit = params.words, params.chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", limit):
            codes, off = document_sets(part, k)
            packed = [codes[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.binary())], names=["doc", "tokens"])

    some = docs.join(hinted(ids.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi").select("doc_id", "text")
    return materialize(some.mapInArrow(run, "doc long, tokens binary"), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame, params: LinkParams) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    num, den = params.num, params.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum()) if len(q) else 0
                keep[i] = both > 0 and den * both >= num * (len(p) + len(q) - both)
            yield pa.record_batch([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])

    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    return _both_sides(pairs, left, right).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _both_sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) with what ``left`` has of a and ``right`` of b; a pivot, which may be in very many pairs, is dealt over several tasks."""
    hot = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").count().filter(F.col("count") > ROWS_A_PART), "hot-documents")
    if hot.isEmpty():
        return pairs.join(left, "a").join(right, "b")
    parts = hot.select("doc", F.ceil(F.col("count") / ROWS_A_PART).cast("int").alias("parts"))

    def dealt(rows: DataFrame, table: DataFrame, name: str, other: str) -> DataFrame:
        some = parts.withColumnRenamed("doc", name)
        one = F.coalesce("parts", F.lit(1))
        many = rows.join(hinted(some), name, "left").withColumn("part", F.pmod(F.xxhash64(other), one).cast("int")).drop("parts")
        copies = table.join(hinted(some), name, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
        return many.join(copies, [name, "part"]).drop("part")

    return dealt(dealt(pairs, left, "a", "b"), right, "b", "a")


def possible(pairs: DataFrame, maps: DataFrame, params: LinkParams) -> DataFrame:
    """Pairs (a, b) whose parity maps (doc, n, map) don't rule them out; a map is a few hundredths of its set."""
    num, den = params.num, params.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            apart = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            both = (n - apart) // 2  # shared tokens at most
            keep = pa.array(den * both >= num * (n - both))
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left = maps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("map").alias("x"))
    right = maps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y"))
    return _both_sides(pairs, left, right).select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _fit(params: LinkParams) -> Column:
    """Whether an entry's documents p and doc can be alike by their sizes.

    Two that meet in a combination of frequent tokens share no rare token unless they meet in that one too, as
    all their rare tokens are entries; so here each one's rare tokens count as missed.
    """
    fit = (F.col("size_p") * params.num <= F.col("n") * params.den) & (F.col("n") * params.num <= F.col("size_p") * params.den)
    both = F.least(F.col("size_p") - F.col("rare_p"), F.col("n") - F.col("rare"))
    return fit & (~F.col("many") | (both * params.den >= (F.col("size_p") + F.col("n") - both) * params.num))


def links(docs: DataFrame, maps: DataFrame, params: LinkParams) -> DataFrame:
    """id, component of all documents that link with another.

    ``docs`` (doc_id, text) has one document for each different set, ``maps`` (doc, n, map) their parity maps.
    """
    return settled(docs, maps, live_entries(docs, params), params, [(crowd_bands, False)])


Finer = Callable[[DataFrame, DataFrame, "LinkParams"], DataFrame]
"""(documents of crowded entries with their component and rare, params) -> entries, with component, of which each two of them that link share one."""


def size_bands(largest: int, num: int, den: int) -> np.ndarray:
    """The sizes at which bands of sizes begin, two beyond that of ``largest``; sets that link are of one band or of neighbouring ones."""
    begins = [1]
    while begins[-1] <= largest:
        begins.append(begins[-1] * den // num + 1)
    for _ in range(2):
        begins.append(begins[-1] * den // num + 1)
    return np.array(begins, np.int64)


def token_bands(codes: np.ndarray, off: np.ndarray, params: LinkParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (``codes`` from off[i] to off[i + 1]), the number of the set of each, and whether it is one of the set's own band of sizes.

    Any two sets that link and aren't equal share one, which is of the larger one's own band.

    Two sets that link, the larger one in a band of sizes that ends at m, differ in at most d = 2 m (den - num) / (den + num)
    tokens. Hashes deal all tokens over d // (out + 1) + 1 groups, so in some group the two differ in ``out`` tokens at most. A
    group is dealt over cells, and there is a signature of its tokens but those of ``out`` cells, for each choice of these: one
    leaves out all that differ. A set goes by its own band of sizes and, for larger partners, by the next one.
    """
    num, den = params.num, params.den
    n = np.diff(off)
    begins = size_bands(int(n.max(initial=0)), num, den)
    band = np.searchsorted(begins, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    sigs, owners, own_band = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for more in (0, 1):
        most = begins[np.maximum(band, 0) + more + 1] - 1
        differ = 2 * most * (den - num) // (den + num)
        salt = mix((band + more + 1).astype(np.uint64) * U64(0xE7037ED1A0B428DB))
        ends = [least for least, _, _ in params.finer[1:]] + [2**62]
        for (least, out, cells), end in zip(params.finer, ends, strict=True):
            groups = np.where((n > 0) & (differ >= least) & (differ < end), differ // (out + 1) + 1, 0)
            base = np.concatenate((np.zeros(1, np.int64), np.cumsum(groups)))
            used = groups[owner] > 0
            own = owner[used]
            token = mix(codes[used] ^ salt[own])
            cell = base[own] * cells + ((token >> U64(32)) * (groups[own] * cells).astype(np.uint64) >> U64(32)).astype(np.int64)
            held = np.zeros(base[-1] * cells, np.uint64)
            np.add.at(held, cell, mix(token ^ U64(0x589965CC75374CC3)))
            held = held.reshape(-1, cells)
            of = np.repeat(np.arange(len(n)), groups)
            place = (np.arange(base[-1]) - base[of]).astype(np.uint64)
            for choice, kept in enumerate(itertools.combinations(range(cells), cells - out)):
                sigs.append(joined(held[:, kept].sum(axis=1, dtype=np.uint64), mix(salt[of] + (place << U64(8)) + U64(choice))))
                owners.append(of)
                own_band.append(np.full(len(of), more == 0))
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(own_band)


def crowd_bands(docs: DataFrame, params: LinkParams) -> DataFrame:
    """Entries of parts of the members' sets, of which any two that link share one (see token_bands). Members keep their numbers of rare tokens, as those are entries of their own still."""
    k, limit = params.words, params.chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", limit):
            codes, off = document_sets(part, k)
            sig, of, own = token_bands(codes, off, params)
            at = pa.array(of)
            size = pa.array(np.diff(off).astype(np.int32))
            yield pa.record_batch([pa.array(signed(sig)), *[c.take(at) for c in (part.column(0), size, part.column(2), part.column(3))], pa.array(own)], names=["sig", "doc", "n", "component", "rare", "own"])

    made = docs.select("doc_id", "text", "component", "rare").mapInArrow(run, "sig long, doc long, n int, component long, rare int, own boolean")
    return shared_entries(made, F.bool_or("own")).select("sig", "doc", "n", "rare", F.lit(True).alias("many"), "component")


def settled(docs: DataFrame, maps: DataFrame, live: DataFrame, params: LinkParams, finer: list[tuple[Finer, bool]]) -> DataFrame:
    """id, component from entries (as ENTRY; a written table) of which each two documents that link share one at least.

    Each entry first is a star: its members meet its centre. Entries that still span several components are compared
    with more members, or, where they are crowded, give way to ``finer`` entries of their members, one kind after
    another, which again are stars first. So the pairs of a round grow with the entries' members, not with their squares.
    """
    state = _State(docs, maps, live, params)
    state.compare(state.centres())
    for make, whole in finer:
        if not state.done and state.scatter(make, whole):
            state.compare(state.centres())
    many, before = params.pivots, 0
    while not state.done:
        # ``many`` members by chance; entries that have no more are compared whole, and are done. Those of the round before have met all members
        state.order()
        state.compare(materialize(state.open.filter(_chosen(many) & ~_chosen(before)).select("sig", "doc", "n", "rare", "component", "first"), "jaccard-pivots"), many, before)
        many, before = many * params.pivots, many
    return state.labels


def _chosen(many: int) -> Column:
    """Whether a member of an entry is one of its ``many`` pivots (all are, where it has no more members)."""
    return F.pmod(F.xxhash64("sig", "doc"), F.col("members")) < many


class _State:
    """What is known between rounds: links, compared pairs, components, and entries that span several components."""

    def __init__(self, docs: DataFrame, maps: DataFrame, live: DataFrame, params: LinkParams):
        self.docs, self.maps, self.live, self.params = docs, maps, live, params
        self.open, self.done = live.withColumn("component", F.col("doc")), False
        self.found = self.compared = self.labels = None

    def centres(self) -> DataFrame:
        """Of each open entry the member with the fewest tokens of its own, which is most like the others, so most pairs that link do so with it."""
        return materialize(self.open.groupBy("sig").agg(F.min_by(F.struct("doc", "n", "rare", "component"), F.struct("rare", "doc")).alias("p")).select("sig", "p.*"), "jaccard-pivots")

    def scatter(self, make: Finer, whole: bool) -> bool:
        """Replaces crowded entries by finer ones of their members; whether there were any. Entries of rare tokens stay, of any size, unless the finer ones have their own (``whole``)."""
        crowd = F.col("members") > max(self.params.crowd, self.params.frequent)
        crowd = crowd if whole else crowd & F.col("many")
        crowded = self.open.filter(crowd)
        if crowded.isEmpty():
            return False
        missed = F.min(F.when(F.col("many"), F.col("rare")).otherwise(0)).alias("missed")
        members = materialize(crowded.groupBy("doc").agg(F.first("component").alias("component"), F.max("rare").alias("rare"), F.first("n").alias("n"), missed), "jaccard-members")
        # what is known of a member goes with its text, so that it isn't joined with each of its many entries
        likely = materialize(self._with_partners(members).select(F.col("doc").alias("doc_id"), "component", "rare"), "jaccard-crowd")
        some = self.docs.select("doc_id", "text").join(hinted(likely), "doc_id")
        made = make(some, self.params)
        kept = self.open.filter(~crowd).drop("members")
        # pairs of crowd members are left to the finer entries, so other entries stay for their other documents only
        inside = kept.join(members.select("doc", F.lit(True).alias("inside")), "doc", "left")
        mixed = inside.groupBy("sig").agg(F.count_if(F.col("inside").isNull()).alias("others")).filter("others > 0").select("sig")
        kept = (kept if whole else kept.filter("many")).join(mixed.hint("shuffle_hash"), "sig", "left_semi").unionByName(kept.filter("false" if whole else "not many"))
        self.open = materialize(kept.unionByName(made), "jaccard-open")
        self.live, self.done = self.open.drop("component"), self.open.isEmpty()
        return True

    def _with_partners(self, members: DataFrame) -> DataFrame:
        """Members (n, missed: tokens that no partner in a crowd has) to which the size of some member can be alike; the others link with none.

        Sets a and b need den * both >= num * (n_a + n_b - both), where both is n - missed of either at most. Of the
        members of one size that with the fewest missed ones tells for all; a band has a number for each of its sizes.
        """
        num, den = self.params.num, self.params.den
        spare = (F.col("n") - F.col("missed")).cast("long") * (num + den) - F.col("n").cast("long") * num  # at least num times the partner's size
        known = members.withColumn("spare", spare).withColumn("band", self._band(F.col("n")))
        sizes = known.groupBy("band", "n").agg(F.max("spare").alias("most"))
        sizes = sizes.select(F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("n").alias("of"), "most")
        sizes = materialize(sizes.groupBy("band").agg(F.collect_list(F.struct("of", "most")).alias("sizes")), "jaccard-sizes")
        partner = F.exists("sizes", lambda x: (F.col("spare") >= x["of"] * num) & (x["most"] >= F.col("n") * num))
        return known.join(hinted(sizes), "band").filter(partner)

    def _band(self, n: Column) -> Column:
        """Sets that link are in the same band of sizes or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / max(1e-6, math.log(self.params.den / self.params.num) * (1 + 1e-9))).cast("int")

    def order(self) -> None:
        """Gives each member the first of its document's open entries (of one kind, see _fit), by their number.

        The first entry that two documents share stays so until it is done, which settles the pair. So a pair may be
        left to it, and needn't meet in all the others that they share.
        """
        mine = Window.partitionBy("doc", "many")
        placed = self.open.drop("first").withColumn("place", F.row_number().over(mine.orderBy("sig")))
        first = F.collect_list(F.when(F.col("place") <= self.params.first_entries, F.col("sig"))).over(mine)
        self.open = materialize(placed.withColumn("first", first).drop("place"), "jaccard-open")

    def _met(self, pivots: DataFrame, whole: int, before: int) -> DataFrame:
        """Members of open entries with a pivot of the entry that they can be like and aren't in one component with; two pivots meet once, and those of the round before don't meet again, nor do pairs in entries after one that they share (see order)."""
        ordered = "first" in pivots.columns
        p = pivots.select("sig", *[F.col("first").alias("first_p")] * ordered, F.explode(F.array(*[self._band(F.col("n")) + d for d in (-1, 0, 1)])).alias("band"), F.col("doc").alias("p"), F.col("n").alias("size_p"), F.col("rare").alias("rare_p"), F.col("component").alias("of_p"))
        rest = self.open.filter(~_chosen(before)) if before else self.open
        members = rest.withColumn("band", self._band(F.col("n"))).withColumn("chosen", _chosen(whole) if whole > 1 else F.lit(False))
        # entries and pivots grow with the corpus, so they shuffle at every size
        once = ~F.col("chosen") | (F.col("doc") > F.col("p"))
        alike = (F.col("component") != F.col("of_p")) & once & _fit(self.params)
        if ordered:
            alike = alike & (F.coalesce(F.array_min(F.array_intersect("first", "first_p")), F.col("sig")) >= F.col("sig"))
        return members.join(p.hint("shuffle_hash"), ["sig", "band"]).filter(alike)

    def compare(self, pivots: DataFrame, whole: int = 1, before: int = 0) -> None:
        """Verifies members against pivots and brings components up to date; entries of ``whole`` members are done. ``before``: pivots of each entry that have met all of its members."""
        pairs = self._met(pivots, whole, before).select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b")).distinct()
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        likely = materialize(possible(pairs, self.maps, self.params), "jaccard-likely")
        if likely.isEmpty():
            new = likely
        else:
            ids = materialize(likely.select(F.col("a").alias("doc")).unionByName(likely.select(F.col("b").alias("doc"))).distinct(), "jaccard-ids")
            new = materialize(verified(likely, stored_sets(self.docs, ids, self.params), self.params), "jaccard-links")
        self.found = new if self.found is None else self.found.unionByName(new)
        self.compared = pairs if self.compared is None else self.compared.unionByName(pairs)
        if self.labels is not None and "members" in self.open.columns and new.isEmpty():
            self.open = materialize(self.open.filter(F.col("members") > whole), "jaccard-open")
        else:
            self._relabel(new)
            labelled = spread_join(self.live, self.labels.withColumnRenamed("id", "doc"), ["doc"], "left").withColumn("component", F.coalesce("component", "doc"))
            same = [F.bit_xor(F.xxhash64("doc", F.lit(salt))).alias(f"set{salt}") for salt in (0, 1)]
            spans = labelled.groupBy("sig", "many").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), *same).filter((F.col("low") != F.col("high")) & (F.col("members") > whole))
            # entries of the same documents, such as the combinations of one passage, hold the same pairs: one of them stays
            spans = spans.groupBy("many", "members", "set0", "set1").agg(F.min("sig").alias("sig"))
            self.open = materialize(spread_join(labelled.drop("members"), materialize(spans.select("sig", "members"), "jaccard-spans"), ["sig"]), "jaccard-open")
        self.live = self.open.drop("component", "first")
        self.done = self.open.isEmpty()

    def _relabel(self, new: DataFrame) -> None:
        """Brings components up to date: new links join components that are known, so only these are put together."""
        if self.labels is None:
            self.labels = components(new)
            return
        ends = new.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        fresh = ends.join(self.labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
        known = materialize(self.labels.unionByName(fresh), "jaccard-labels")
        some = materialize(known.join(ends, "id", "left_semi"), "jaccard-ends")
        a, b = (some.select(F.col("id").alias(n), F.col("component").alias(f"of_{n}")) for n in ("a", "b"))
        up = components(spread_join(spread_join(new, a, ["a"]), b, ["b"]).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        moved = spread_join(known, up.select(F.col("id").alias("component"), F.col("component").alias("now")), ["component"], "left")
        self.labels = materialize(moved.select("id", F.coalesce("now", "component").alias("component")), "jaccard-labels")


Link = Callable[[DataFrame, DataFrame, LinkParams], DataFrame]

#: Numbers of documents that their doc_id doesn't name begin here, above any doc_id that counts from 0.
NAMELESS = 1 << 62


def near_rows(docs: DataFrame, params: LinkParams | None = None, link: Link | None = None) -> DataFrame:
    """doc_id, key, n, doc, component for each document: doc names a row's doc_id and text, component is the smallest doc it reaches. ``link``: what finds the links, as ``links`` does."""
    params, link = params or JaccardParams(), link or links
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", content_key(F.col("text")).alias("key"))
    digests = materialize(set_digests(rows, params), "set-digests")
    shared = digests.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("doc_id is not null and low <> high")
    shared = materialize(shared.select("doc_id", F.lit(True).alias("several")), "doc-ids-shared")

    def named(table: DataFrame) -> DataFrame:
        own = F.col("doc_id").isNotNull()
        if not shared.isEmpty():
            table = table.join(hinted(shared), "doc_id", "left")
            own = own & F.col("several").isNull()
        number = F.lit(NAMELESS) + F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "key").bitwiseAND(F.lit(NAMELESS - 1))
        return table.withColumn("doc", F.when(own, F.col("doc_id")).otherwise(number)).drop("several")

    sets = named(digests)
    equal = sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("all")).filter("all > 1")
    equal = materialize(equal.select("n", "s1", "s2", "rep"), "sets-equal")
    marked = spread_join(sets.drop("map"), equal, ["n", "s1", "s2"], "left").select("doc_id", "key", "n", "doc", F.coalesce("rep", "doc").alias("rep"))
    marked = materialize(marked, "set-representatives")
    spare = materialize(marked.filter("n = 0 or rep <> doc").select("doc").distinct(), "set-copies")
    one_each = named(rows).join(hinted(spare), "doc", "left_anti").select(F.col("doc").alias("doc_id"), "text")
    maps = sets.filter("n > 0").join(hinted(spare), "doc", "left_anti").select("doc", "n", "map").dropDuplicates(["doc"])
    labels = link(one_each, maps, params)
    out = spread_join(marked, labels.select(F.col("id").alias("rep"), "component"), ["rep"], "left")
    return out.select("doc_id", "key", "n", "doc", F.coalesce("component", "rep").alias("component"))


def near_groups(docs: DataFrame, params: LinkParams | None = None, link: Link | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    found = materialize(near_rows(docs, params, link), "near-rows")
    plain = found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    if found.filter(F.col("doc") >= NAMELESS).isEmpty():
        return plain
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-least")
    return spread_join(found, least, ["component"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, params: LinkParams | None = None, link: Link | None = None) -> DataFrame:
    """One document of each group of near copies, all columns kept."""
    found = materialize(near_rows(docs, params, link), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "doc")
    stay = found.filter("n > 0").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("all")).filter("all > 1")
    stay = materialize(stay.select("component", F.col("first.doc").alias("stays")), "near-stay")
    several = materialize(spread_join(found.filter("n > 0"), stay, ["component"]), "near-several")
    gone = materialize(several.filter("doc <> stays").select("doc_id", "key").distinct(), "near-copies")
    again = materialize(several.filter("doc = stays").groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key"), "near-again")
    return one_of_each(without(docs, gone), again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), JaccardParams(words=4, num=85, den=100))
