"""Sets of word shingles and their min-wise sketches: one permutation, densified, in bands.

A set's tokens are dealt over ``rows * bands`` bins by one hash; a bin keeps its smallest token. An empty bin borrows
from another one: it looks at ATTEMPTS bins, in an order drawn for it alone that is the same for all sets, and takes
the first that isn't empty (optimal densification); if there is none, it takes the bin that a hash of both ranks first
among all that aren't. Either way two sets agree in a bin with the probability of their Jaccard similarity J, and
bins borrow independently, so that small sets are told apart as well as large ones. A band is a hash of ``rows`` bins:
two sets share none of their bands with a probability of (1 - J^rows)^bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelake.llm._spark import byte_view, chunks, materialize
from lecturelake.llm._words import SPACE_WORDS, U64, folded, joined, mix, signed, split_words, windows, word_codes

ATTEMPTS = 64
_EMPTY = U64(2**64 - 1)


@dataclass(frozen=True)
class SketchParams:
    words: int
    rows: int
    bands: int
    chunk_bytes: int = 700_000
    least_size: int = 1
    """Sets of fewer tokens have no bands."""
    cells: int = 4_000_000
    """Bins that a task holds at once."""


def document_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a batch, in order of (text, hash), and their offsets."""
    data, off = byte_view(part.column(1))
    starts, ends, first = split_words(data, off, SPACE_WORDS)
    words = word_codes(data, starts, ends, lower=True)
    counts = np.diff(first)
    document = np.repeat(np.arange(len(counts)), counts)
    all_windows = windows(words, k)
    whole = np.flatnonzero(document[: len(all_windows)] == document[k - 1 :]) if len(all_windows) else np.zeros(0, np.int64)
    codes, owner = [all_windows[whole]], [document[whole]]
    for n in range(1, k):  # texts of fewer words are one shingle
        short = np.flatnonzero(counts == n)
        codes.append(folded(words[first[short][:, None] + np.arange(n)]))
        owner.append(short)
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[new], owner[new]
    return codes, np.searchsorted(owner, np.arange(len(counts) + 1))


def sketches(codes: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """A row of densified bins for each set; ``codes`` are the sets' tokens in order, none of the sets is empty."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    cell = owner * bins + ((codes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)  # grows with the token
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else cell
    out = np.full(n * bins, _EMPTY)
    out[cell[first]] = codes[first]
    held = out != _EMPTY
    left = np.flatnonzero(~held)
    for t in range(ATTEMPTS):
        if not len(left):
            break
        b = left % bins
        other = left - b + (mix((b * ATTEMPTS + t + 1).astype(np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(bins)).astype(np.int64)
        found = held[other]
        out[left[found]] = out[other[found]]
        left = left[~found]
    if len(left):
        full = np.flatnonzero(held)
        begins = np.searchsorted(full, np.arange(n + 1) * bins)
        of = left // bins
        for i in np.unique(of).tolist():
            mine, own = left[of == i], full[begins[i] : begins[i + 1]]
            rank = mix(((mine % bins)[:, None] * bins + own % bins).astype(np.uint64) * U64(0xD1342543DE82EF95) + U64(1))
            out[mine] = out[own[np.argmin(rank, axis=1)]]
    return out.reshape(n, bins)


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of each sketch; equal ones are of one band."""
    bands = sketch.shape[1] // rows
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F)), (len(sketch), bands))
    for r in range(rows):
        out = joined(out, sketch[:, r::rows])
    return out


def bands(docs: DataFrame, params: SketchParams, also: dict[str, str] | None = None) -> DataFrame:
    """Index entries sig, doc, n of documents (doc_id, text): one for each band. ``also``: names and types of columns of ``docs`` that go with them."""
    also = also or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = params.rows * params.bands
        for part in chunks(batches, "text", params.chunk_bytes):
            codes, off = document_sets(part, params.words)
            size = np.diff(off)
            some = np.flatnonzero(size >= max(1, params.least_size))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(some), max(1, params.cells // width)):
                mine = some[at : at + max(1, params.cells // width)]
                own = np.concatenate([codes[off[i] : off[i + 1]] for i in mine])
                sig = bands_of(sketches(own, np.concatenate(([0], np.cumsum(size[mine]))), width), params.rows)
                doc, n = np.repeat(ids[mine].astype(np.int64), params.bands), np.repeat(size[mine].astype(np.int32), params.bands)
                more = [part.column(2 + i).take(pa.array(np.repeat(mine, params.bands))) for i in range(len(also))]
                yield pa.record_batch([pa.array(signed(sig.ravel())), pa.array(doc), pa.array(n), *more], names=["sig", "doc", "n", *also])

    return docs.select("doc_id", "text", *also).mapInArrow(run, ", ".join(["sig long, doc long, n int", *[f"{name} {kind}" for name, kind in also.items()]]))


def shared_bands(docs: DataFrame, params: SketchParams, also: dict[str, str] | None = None) -> DataFrame:
    """The entries of bands that several documents share, as a written table."""
    return shared_entries(bands(docs, params, also))


def shared_entries(made: DataFrame, needed: Column | None = None) -> DataFrame:
    """Of index entries those that several documents share, and of which ``needed`` holds, as a written table. An entry may be that of a third of all documents: it is counted before the shuffle, and the join deals its rows."""
    made = materialize(made, "bands")
    needed = F.lit(True) if needed is None else needed
    several = made.groupBy("sig").agg(F.count("*").alias("all"), needed.alias("needed")).filter("all > 1 and needed").select("sig")
    return materialize(made.join(several.hint("shuffle_hash"), "sig"), "bands-shared")
