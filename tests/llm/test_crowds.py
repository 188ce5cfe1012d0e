"""No link of a crowd is lost, by chance or by a crowd's size."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import near_join, sketch


def without_some(words, rows, bands):
    """``words`` without one word of each band of a sketch of 1-word shingles, so that no band stays as it is."""
    left = list(words)
    while True:
        texts = pa.record_batch([pa.array([1]), pa.array([" ".join(words)])], names=["doc_id", "text"]), pa.record_batch([pa.array([1]), pa.array([" ".join(left)])], names=["doc_id", "text"])
        (codes, off), (less, less_off) = (sketch.document_sets(t, 1) for t in texts)
        whole, now = (sketch.sketches(c, o, rows * bands)[0] for c, o in ((codes, off), (less, less_off)))
        same = np.flatnonzero((whole.reshape(bands, rows) == now.reshape(bands, rows)).all(axis=1))
        if not len(same):
            return left
        one = pa.record_batch([pa.array(range(len(left))), pa.array(left)], names=["doc_id", "text"])
        of = dict(zip(sketch.document_sets(one, 1)[0].tolist(), left, strict=True))
        gone = {of[int(whole[band * rows])] for band in same}
        left = [w for w in left if w not in gone]


def test_no_choice_of_words_parts_two_members_that_link(spark):
    words = [f"w{i}" for i in range(2500)]
    fewer = without_some(words, 8, 128)
    assert 85 * len(words) <= 100 * len(fewer) < 100 * len(words)
    docs = spark.createDataFrame([(1, " ".join(words), 1, 0), (2, " ".join(fewer), 2, 0), (3, "a b c d e f g h", 3, 0)], "doc_id long, text string, component long, rare int")
    found = near_join.crowd_bands(docs, near_join.JaccardParams(words=1, num=85, den=100))
    assert {r.doc for r in found.collect()} == {1, 2}


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (1, 2), (99, 100), (100, 100)])
def test_sets_that_link_share_a_signature(num, den):
    r, params = random.Random(3), near_join.JaccardParams(num=num, den=den)
    for size in [*range(1, 30), 100, 700]:
        sets = []
        for _ in range(12):
            a = {r.getrandbits(64) for _ in range(size)}
            b, gone, more = set(a), sorted(a), 0
            r.shuffle(gone)
            take = r.randint(0, size)
            while True:  # as far apart as they may be, some by what one lacks, some by what it has besides
                c = b - {gone[more]} if more < take else b | {r.getrandbits(64)}
                if not c or den * len(a & c) < num * len(a | c):
                    break
                b, more = c, more + 1
            sets += [a, b]
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        sig, of, own = near_join.token_bands(np.concatenate([np.array(sorted(s), np.uint64) for s in sets]), off, params)
        for i in range(0, len(sets), 2):
            assert sets[i] == sets[i + 1] or set(sig[of == i].tolist()) & set(sig[of == i + 1].tolist()) & set(sig[own].tolist())
        assert num < den or not len(sig)


def test_entries_of_rare_tokens_stay_in_a_crowd(spark):
    # 12 texts share rare words, which the bound on frequent ones leaves rare; the others share the common ones only
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(common + [f"r{i // 12}x{j}" for j in range(8)] + [f"u{i}x{j}" for j in range(i % 3)])) for i in range(48)]
    params = near_join.JaccardParams(words=1, num=85, den=100, frequent=3, frequent_tokens=30, crowd=4, pivots=2)
    found = near_join.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), params)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()} == brute.near(docs, 1)


def test_rare_entries_of_any_size_stay_open(spark, monkeypatch):
    rows = [(1, d, 10, 4, False) for d in range(6)] + [(2, d, 10, 4, True) for d in range(6)]
    live = spark.createDataFrame(rows, near_join.ENTRY)
    docs = spark.createDataFrame([(d, f"a b c d{d}") for d in range(6)], "doc_id long, text string")
    state = near_join._State(docs, docs, live, near_join.JaccardParams(words=1, crowd=2, frequent=2))
    state.open = state.open.withColumn("members", F.lit(6))
    made = spark.createDataFrame([], "sig long, doc long, n int, rare int, many boolean, component long")
    assert state.scatter(lambda some, params: made, False)
    assert {(r.sig, r.doc, r.many) for r in state.open.collect()} == {(1, d, False) for d in range(6)}
