import dataclasses
import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import repeats, substring_dedup, suffix_dedup
from lecturelake.llm._words import BYTE_CODES


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "key", "spans", "anchor", "start")})


def texts(seed):
    """Texts of few words that share stretches, hold periods, repeat whole, and are null or empty."""
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 30)) for _ in range(60)) for _ in range(3)]
    out = [None, "", " \n", "x " * 90, "ab " * 70 + "c", "x " * 20 + "y", "one two", "ü" * 150]
    for i in range(25):
        own = " ".join(f"o{r.randint(0, 10**6)}" for _ in range(r.randint(0, 50)))
        a = r.randint(0, 100)
        out.append(f"{own} {r.choice(shared)[a : a + r.randint(0, 400)]} tail{i} {r.choice(shared)[r.randint(0, 200):]}")
    out += [out[10], out[12], out[12]]
    docs = list(enumerate(out))
    r.shuffle(docs)
    return docs


def check(spark, module, params, docs, want, columns):
    for chunk in (700, 100_000):
        p = dataclasses.replace(params, chunk_bytes=chunk)
        got = module.remove_repeats(frame(spark, docs), p).withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)).select(*columns, "sha").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("width,grams,most", [(7, (3, 5, 7), 400), (7, (3, 5, 7), 1), (12, (12,), 400), (12, (4, 9, 12), 2)])
def test_word_repeats_match_brute_force(spark, width, grams, most):
    docs = texts(width)
    params = dataclasses.replace(substring_dedup.PARAMS, width=width, grams=grams, most_segments=most, batch_units=300)
    check(spark, substring_dedup, params, docs, brute.word_repeats(docs, width), ["doc_id", "n_words", "n_removed"])


@pytest.mark.parametrize("width,grams,most", [(40, (9, 25, 40), 200), (40, (9, 25, 40), 1), (35, (12, 35), 200)])
def test_byte_repeats_match_brute_force(spark, width, grams, most):
    docs = texts(width)
    params = dataclasses.replace(suffix_dedup.PARAMS, width=width, grams=grams, most_segments=most, batch_units=900)
    check(spark, suffix_dedup, params, docs, brute.byte_repeats(docs, width), ["doc_id", "n_bytes", "n_removed", "n_spans"])


def test_production_widths_on_real_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    check(spark, substring_dedup, substring_dedup.PARAMS, docs, brute.word_repeats(docs), ["doc_id", "n_words", "n_removed"])
    want = brute.byte_repeats(docs)
    check(spark, suffix_dedup, suffix_dedup.PARAMS, docs, want, ["doc_id", "n_bytes", "n_removed", "n_spans"])
    assert sum(x[2] > 0 for x in want) > 3


def test_rows_that_repeat_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring_dedup.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, "short")])).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in rows) == [(0, 60), (1, 60), (1, 60), (2, 0)]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_texts_whose_polynomial_hashes_collide(spark):
    tail = " ".join(f"w{i}" for i in range(34))
    docs = [(i, f"{brute.thue_morse(swap=bool(i))} {tail}") for i in range(2)]
    check(spark, substring_dedup, substring_dedup.PARAMS, docs, brute.word_repeats(docs), ["doc_id", "n_words", "n_removed"])
    check(spark, suffix_dedup, suffix_dedup.PARAMS, docs, brute.byte_repeats(docs), ["doc_id", "n_bytes", "n_removed", "n_spans"])


@pytest.mark.parametrize("engine", [substring_dedup.automaton_engine, suffix_dedup.transform_engine])
def test_engines_match_counting(engine):
    r = random.Random(3)
    for _ in range(60):
        width = r.choice([2, 3, 6, 8, 16])
        alphabet = r.choice(["ab", "abcdefgh"])
        strings = list({"".join(r.choice(alphabet) for _ in range(r.randint(width, 40))) for _ in range(r.randint(1, 9))})
        times = [r.choice([1, 1, 2, 5]) for _ in strings]
        seen = {}
        for s, n in zip(strings, times):
            for i in range(len(s) - width + 1):
                seen[s[i : i + width]] = seen.get(s[i : i + width], 0) + n
        marks = engine([np.frombuffer(s.encode(), np.uint8) for s in strings], np.array(times), width)
        for s, m in zip(strings, marks):
            assert m.tolist() == [seen[s[i : i + width]] > 1 for i in range(len(s) - width + 1)]


def test_merged_transforms_are_a_sorted_suffix_array():
    r = random.Random(8)
    strings = [np.frombuffer("".join(r.choice("ab") for _ in range(r.randint(1, 30))).encode(), np.uint8) for _ in range(8)]
    c = suffix_dedup.Collection(strings, 2)
    half = int(c.ends[3])
    shards = [c.sort(0, half), c.sort(half, int(c.ends[-1]))]
    merged, _, common = suffix_dedup.merge(c, shards, 20)
    data = b"".join(s.tobytes() for s in strings)
    rests = [data[p : p + c.left[p]] for p in merged]
    for i in range(1, len(rests)):
        k = 0
        while rests[i][k : k + 1] == rests[i - 1][k : k + 1] != b"":
            k += 1
        assert common[i] == k // 2
        before, after = (x[2 * (k // 2) :][:2] for x in (rests[i - 1], rests[i]))
        assert len(before) == len(after) == 1 or (len(before) == 1, before) <= (len(after) == 1, after)  # blocks cut short by the end come last


def test_segments_cover_each_window_once():
    r = np.random.default_rng(1)
    codes = BYTE_CODES[r.integers(97, 100, 500)]
    first = np.array([0, 0, 30, 31, 200, 500])
    text, start, windows, *_ = repeats.cut(codes, first, 10, 4)
    got = sorted((t, s + i) for t, s, n in zip(text, start, windows) for i in range(n))
    assert got == [(t, i) for t in range(5) for i in range(max(0, first[t + 1] - first[t] - 9))]


def test_reference_is_removed_by_shards(spark):
    reference = [" ".join(f"r{i}" for i in range(80)), " ".join(f"q{i}" for i in range(80))]
    text = "a b " + " ".join(f"r{i}" for i in range(10, 60)) + " c " + " ".join(f"q{i}" for i in range(20))
    rows = substring_dedup.remove_reference(frame(spark, [(1, text), (2, None)]), reference, shard_words=90).collect()
    assert {(r.doc_id, r.n_removed, r.kept) for r in rows} == {(1, 50, "a b c " + " ".join(f"q{i}" for i in range(20))), (2, 0, "")}
