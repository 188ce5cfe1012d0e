import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import decontaminate, exact_dedup, sharding

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc"), (6, "a  b c"), (7, "abc"), (8, "ß x"), (9, "x" * 5000), (10, "the quick brown fox jumps over the lazy dog again and again")]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("digest", "n", "key", "row", "shard", "n_words")}) if extra else df


def documents(n=200):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))[:n]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_bytes, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_groups_match_brute_force(spark, digest):
    docs = EDGES + [(100 + a, b) for a, b in documents()]
    got = exact_dedup.exact_groups(frame(spark, docs, extra=True), digest).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {x[:4] for x in brute.exact(docs)}
    assert len(got) == len(docs)


def test_drop_copies_keeps_one_row_of_rows_that_repeat_whole(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, "c"), (None, "d")], extra=True)
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(docs).collect() if r.text != "c") == [(0, "d"), (1, "a b")]


def test_exact_on_an_empty_table_and_a_probe(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    index = exact_dedup.DigestIndex()
    index.flush(frame(spark, [(1, "a b"), (2, "c")]))
    index.flush(frame(spark, [(0, "ab"), (9, "d")]))
    index.compact()
    assert {(r.doc_id, r.keep_id) for r in index.probe(frame(spark, [(50, " a b"), (51, "zz")])).collect()} == {(50, 1), (51, None)}


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    by_text, of = defaultdict(set), dict(docs)
    for r in rows:
        by_text[of[r.doc_id]].add(r.shard)
        assert r["size"] == len((of[r.doc_id] or "").encode()) + 1
    assert all(len(x) == 1 for x in by_text.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return Counter({s: sum(r["size"] for r in rows if r.shard == s) for s in range(shards)})


@pytest.mark.parametrize("params", [sharding.ShardParams(), sharding.ShardParams(n_shards=5, block_bits=2, refine_bits=2, detail_groups=10, cells=3)])
def test_shards_are_the_minimax_partition(spark, params):
    docs = documents()
    rows = sharding.minimax_shards(frame(spark, docs, extra=True), params).collect()
    load = check_shards(rows, docs, params.n_shards)
    sizes = defaultdict(int)
    for _, text in docs:
        sizes[hashlib.md5(text.encode()).hexdigest()[:15]] += len(text.encode()) + 1
    line = [sizes[k] for k in sorted(sizes)]
    best = np.full(len(line) + 1, np.inf)
    best[0], sums = 0, np.concatenate(([0], np.cumsum(line)))
    for _ in range(params.n_shards):
        best = np.array([0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, len(line) + 1)])
    assert max(load.values()) == best[-1]


def test_shards_of_edge_cases(spark):
    check_shards(sharding.minimax_shards(frame(spark, EDGES)).collect(), EDGES, 16)
    same = [(i, "copy") for i in range(50)] + [(99, None)]
    check_shards(sharding.minimax_shards(frame(spark, same)).collect(), same, 16)
    assert sharding.minimax_shards(frame(spark, [])).count() == 0


ITEMS = [(1, None), (2, ""), (3, "fox jumps"), (4, "one two three four five six seven eight nine ten eleven"), (5, "fox jumps"), (6, "...")]


@pytest.mark.parametrize("block", [200_000, 30])
def test_phrases_match_brute_force(spark, block):
    t = pq.read_table(f"{SF}/benchmark.parquet")
    items = ITEMS + list(zip([100 + x for x in t["item_id"].to_pylist()], t["text"].to_pylist()))
    docs = [(1000 + a, b) for a, b in EDGES] + documents() + [(5000, "x ONE two. three four five six seven eight nine ten! eleven fox"), (5001, "fox"), (5002, "jumps")]
    params = decontaminate.PhraseParams(shard_bytes=20_000, block_windows=block)
    got = decontaminate.contamination(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"), params).collect()
    want = brute.phrases(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(docs)
    assert sum(x[5] for x in want) > 2


def test_phrases_with_slack_and_without_items(spark):
    docs = frame(spark, [(1, "alpha x beta gamma"), (2, "alpha beta x x x x gamma"), (3, None)])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = decontaminate.phrase_matches(docs, items, decontaminate.PhraseParams(slack=1)).collect()
    assert {r.doc_id for r in near if r["items"]} == {1}
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == 3 and not any(r.contaminated for r in none)
    repeated = frame(spark, [(1, "alpha beta gamma")] * 3)
    assert decontaminate.contamination(repeated, items).count() == 3


def test_phrases_whose_polynomial_hashes_collide(spark):
    docs = spark.createDataFrame([(1, brute.thue_morse()), (2, brute.thue_morse(swap=True))], "doc_id long, text string")
    items = spark.createDataFrame([(9, brute.thue_morse(swap=True))], "item_id long, text string")
    assert {(r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, items).collect()} == {(1, False), (2, True)}


def test_an_index_serves_several_blocks_and_searches(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(40))) for i in range(9)] + [(None, "w1 w2 w3"), (3, "w5"), (3, "w5")]
    params = decontaminate.PhraseParams(window=3, block_windows=5, shard_bytes=300)
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), params)
    for texts in (["w1 w2 w3 w4", "w5", "w9 w11"], [f"w{i} w{i + 1} w{i + 2}" for i in range(20)]):
        items = [(i, t) for i, t in enumerate(texts)] + [(None, "w1"), (77, None), (78, "")]
        found = decontaminate.search_all(index, decontaminate.item_windows(spark.createDataFrame(items, "item_id long, text string"), params), params).collect()
        want = {(None if d < 0 else d, n, hit) for d, n, hit, *_ in brute.phrases([(-1 if d is None else d, t) for d, t in docs], [x for x in items if x[0] is not None], 3)}
        assert {(r.doc_id, r.n_words, sum(r.runs[1::2]) - sum(r.runs[::2])) for r in found} == want and len(found) == len(docs)


def test_rows_are_told_apart_without_doc_ids(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, key string, row int")
    same = frame([(None, "a b", "x", 1), (None, "a b", "x", 2), (None, "ab", "x", 3), (1, "c", "x", 4), (1, "c  d", "x", 5), (2, "cd", "x", 6)])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(same).collect()) == [(0, "a b"), (1, "c"), (1, "c  d")]
    docs = frame([(None, "one two bad", "x", 1), (1, "bad", "x", 2), (1, "clean", "x", 3), (None, "fine", "x", 4), (2, None, "x", 5)])
    items = spark.createDataFrame([(1, "bad")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.drop_contaminated(docs, items).collect()) == [(0, "fine"), (1, "clean"), (2, "")]


def test_one_block_of_windows_is_searched_where_the_index_is_built(spark, monkeypatch):
    stored, write = [], decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name, *more: stored.append(name) or write(df, name, *more))
    docs = [(i, f"a{i} the words of item {i % 7} stand here in order x y z {i}") for i in range(60)] + [(60, None), (61, "")]
    items = [(k, f"the words of item {k} stand here in order x y") for k in range(3)]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = {b: sorted((r.doc_id, r.n_words, r.runs, r.items) for r in decontaminate.phrase_matches(*made, decontaminate.PhraseParams(shard_bytes=200, block_windows=b)).collect()) for b in (1, 200_000)}
    assert found[1] == found[200_000] and sum(bool(x[3]) for x in found[1]) == 27
    assert stored.count("positions") == 1
