"""Spelling variants: words of a corpus that are one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so that a word becomes a reduced word. Two words that are one edit apart have
reduced words that are equal or one edit apart. Each word generates its reduced word's one-edit neighbourhood: the
reduced word itself, each symbol deleted, each symbol replaced. A pair of words needs to meet from one side only, so
the longer word generates the deletion (which is the shorter one's insertion), and of two equally long words the one
with the smaller symbol generates the replacement. Neighbours are joined with the vocabulary's reduced words by a
64-bit key, and each pair that meets is verified on its original words, so keys that collide cost time only.

Counting keeps one task's words together before the shuffle; no word, however common, is more than one row of a task.
Chains of forms are followed by doubling: a form has at least ten times the occurrences of its word, so they are short.

Defined results: null texts have no words; a row without doc_id loses no letters; rows that repeat whole count each;
equally frequent near words give the smallest in code-point order; very long texts are read whole; columns other than
doc_id and text may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import materialize, read_table, table_columns
from lecturelake.llm._words import U64, mix, signed

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


@dataclass(frozen=True)
class SpellingParams:
    least_letters: int = 7
    least_count: int = 2
    slips: int | None = None
    """Where a number: a word of a document loses a letter if the crc32 of '<doc_id>:<word>' is divisible by it (it makes misspellings to look for)."""
    factor: int = 10
    """A word's form occurs at least so many times as often."""
    symbols: int = 8
    """Size of the reduced alphabet: a larger one gives longer neighbourhoods and fewer pairs to verify."""
    held_words: int = 200_000
    """Distinct words that a task counts before it hands them on."""


def word_counts(docs: DataFrame, params: SpellingParams) -> DataFrame:
    """word, n: the corpus's words of enough letters and occurrences, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            long = [(w, n) for w, n in held.items() if len(w) >= params.least_letters]
            words = [(w.decode(), n) for w, n in long]
            words = [(w, n) for w, n in words if len(w) >= params.least_letters]
            return pa.record_batch([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(b"%d:" % doc) if params.slips and doc is not None else None
                for word, n in Counter(RUNS.findall(text.as_py())).items():
                    w = word.encode().lower()  # of bytes: A-Z only
                    if seed is not None and (h := zlib.crc32(w, seed)) % params.slips == 0:
                        at = h % len(word)
                        low = w.decode()
                        w = (low[:at] + low[at + 1 :]).encode()
                    held[w] += n
                if len(held) >= params.held_words:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    found = table_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= params.least_count)


def reduced(letters: np.ndarray, symbols: int) -> np.ndarray:
    """A symbol from 1 on for each code point."""
    return (mix(letters.astype(np.uint64) + U64(0x51ED2701)) % U64(symbols)).astype(np.int64) + 1


def _keys(words: list[str], symbols: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(index of the word, key, whether it is that of its own reduced word), words of one length at a time: the reduced word alone (``whole``), or with all neighbours that the word generates."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(at), size)
        sym = reduced(letters, symbols)
        place = mix(np.arange(size + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(7))
        # a reduced word's key: its symbols, each mixed with its place, added up, and mixed with their number
        terms = np.zeros((symbols + 1, size + 1), np.uint64)
        for s in range(1, symbols + 1):
            terms[s] = mix(place + U64(s * 0xA0761D6478BD642F % 2**64))
        here = terms[sym, np.arange(size)]
        total = here.sum(axis=1, dtype=np.uint64)
        end = lambda sums, n: mix(sums ^ U64(n * 0xD6E8FEB86659FD93 % 2**64))
        yield at, end(total, size), True
        if whole:
            continue
        for i in range(size):
            for s in range(2, symbols + 1):
                some = np.flatnonzero(sym[:, i] < s)
                yield at[some], end(total[some] - here[some, i] + terms[s, i], size), False
        if size > 1:
            before = np.zeros((len(at), size + 1), np.uint64)
            np.cumsum(here, axis=1, out=before[:, 1:])
            moved = np.zeros((len(at), size + 1), np.uint64)  # symbols that follow the deleted one stand a place earlier
            np.cumsum(terms[sym[:, 1:], np.arange(size - 1)], axis=1, out=moved[:, 1:size])
            for i in range(size):
                fresh = np.flatnonzero(sym[:, i] != sym[:, i - 1]) if i else np.arange(len(at))  # in a run of equal symbols each deletion gives the same
                yield at[fresh], end(before[fresh, i] + moved[fresh, size - 1] - moved[fresh, i], size - 1), False


def neighbour_keys(vocabulary: DataFrame, params: SpellingParams, whole: bool) -> DataFrame:
    """key, word, n, own: the vocabulary by its reduced words, or by all neighbours that each word generates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                found = list(_keys(part.column(0).to_pylist(), params.symbols, whole))
                at, key = (np.concatenate([f[i] for f in found]) for i in range(2))
                own = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
                order = np.argsort(at, kind="stable")  # a word's keys side by side: what a shuffle writes of them is compressed
                rows = pa.array(at[order])
                yield pa.record_batch([pa.array(signed(key[order])), part.column(0).take(rows), part.column(1).take(rows), pa.array(own[order])], names=["key", "word", "n", "own"])

    return vocabulary.select("word", "n").mapInArrow(run, "key long, word string, n long, own boolean")


def near_pairs(vocabulary: DataFrame, params: SpellingParams) -> DataFrame:
    """a, b, a_n, b_n: each two words of the vocabulary (word, n; a written table) that are one edit apart, once."""
    asks = neighbour_keys(vocabulary, params, whole=False).withColumnsRenamed({"word": "a", "n": "a_n"})
    homes = neighbour_keys(vocabulary, params, whole=True).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = ~F.col("own") | (F.col("a") < F.col("b"))  # equal reduced words meet from both sides, all others from one
    # both sides grow with the vocabulary, so they shuffle at every size
    met = asks.join(homes.hint("shuffle_hash"), "key").filter(once & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1))
    return met.select("a", "b", "a_n", "b_n")


def forms(pairs: DataFrame, factor: int) -> DataFrame:
    """word, form, form_n: of a word's near words that are so many times as frequent, the most frequent one."""
    both = pairs.select("a", "a_n", "b", "b_n").unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.filter(F.col("b_n") >= factor * F.col("a_n")).groupBy("a").agg(F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("f"))
    return best.select(F.col("a").alias("word"), F.col("f.form").alias("form"), (-F.col("f.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form; a written table). A round follows twice as many steps as the one before."""
    far = found.select("word", F.col("form").alias("root"))
    while True:
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = materialize(far.join(ahead.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if far.filter("moved").isEmpty():
            return far.select("word", "root")
        far = far.drop("moved")


def variants(docs: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    params = params or SpellingParams()
    vocabulary = materialize(word_counts(docs, params), "vocabulary")
    pairs = materialize(near_pairs(vocabulary, params), "spelling-pairs")
    found = materialize(forms(pairs, params.factor), "spelling-forms")
    near = pairs.select(F.explode(F.array("a", "b")).alias("word")).groupBy("word").agg(F.count("*").alias("n_near"))
    out = vocabulary.join(near, "word", "left").join(found, "word", "left").join(roots(found), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"), SpellingParams(slips=31))
