import itertools
import random

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import near_join
from lecturelake.llm.graph import components

EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "a b c d"), (8, "a b c d"), (9, "x " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "rep", "doc", "component")})


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def family(seed, members, words, edits):
    """Texts that drift away from a common one, from each other, and along a chain."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out, last = [], base
    for i in range(members):
        text = list(last if i % 3 == 0 else base)
        for _ in range(r.randint(0, edits)):
            text[r.randrange(len(text))] = f"e{r.randint(0, 9)}"
        if i % 4 == 0:
            text = text[: len(text) - r.randint(0, max(1, len(text) // 8))]
        last = text
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("k,num,frequent", [(4, 85, 16), (4, 85, 2), (5, 80, 3)])
def test_groups_match_brute_force(spark, k, num, frequent):
    texts = [t for s in range(8) for t in family(s, 12, 20 + 25 * s, 1 + s)]
    common = " ".join(f"license{i}" for i in range(40))
    texts += [f"{common} own{i} tail{i} end{i % 3}" for i in range(12)] + [f"only{i} {common[:60]} x{i}" for i in range(6)]
    docs = EDGES + [(100 + i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(docs)
    params = near_join.JaccardParams(words=k, num=num, den=100, frequent=frequent, chunk_bytes=3000)
    assert got(near_join.near_groups(frame(spark, docs), params)) == brute.near(docs, k, num, 100)


def test_groups_of_real_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    want = brute.near(docs)
    assert got(near_join.near_groups(frame(spark, docs), near_join.JaccardParams(4, 85, 100))) == want
    assert sum(c != d for d, _, c in want) > 3


def test_empty_null_and_repeated_rows(spark):
    assert near_join.near_groups(frame(spark, [])).count() == 0
    assert near_join.drop_near_copies(frame(spark, [])).count() == 0
    rows = near_join.near_groups(frame(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "A b c"), (None, "z"), (5, "y"), (5, "a b C")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 2), (2, 2), (3, 2), (3, 2), (5, 2), (5, 5)]
    kept = near_join.drop_near_copies(frame(spark, [(3, "a b c"), (2, "A b c"), (4, "z"), (None, "a b C"), (3, "other"), (None, "q"), (None, "q"), (7, None), (7, None)]))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "q"), (2, "A b c"), (3, "other"), (4, "z"), (7, ""), (7, "")]


def test_texts_whose_polynomial_hashes_collide(spark):
    docs = [(1, brute.thue_morse()), (2, brute.thue_morse(swap=True))]
    assert got(near_join.near_groups(frame(spark, docs), near_join.JaccardParams(4, 85, 100))) == brute.near(docs)


def test_a_crowded_entry_is_compared_by_many_pivots(spark):
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(common[: 20 + i % 10] + [f"u{i}x{j}" for j in range(i % 7)])) for i in range(40)]
    params = near_join.JaccardParams(words=2, num=85, den=100, frequent=3, pivots=4)
    assert got(near_join.near_groups(frame(spark, docs), params)) == brute.near(docs, 2)


def test_entries_of_the_same_documents_are_compared_once(spark, monkeypatch):
    blocks = [" ".join(f"b{i}x{j}" for j in range(20)) for i in range(6)]
    docs = list(enumerate(" ".join(x) for x in itertools.combinations(blocks, 3))) + [(90, " ".join(blocks[:3]) + " end")]
    meet, seen, again, earlier = near_join._State._met, [], [], set()

    def met(state, pivots, whole, before):
        out = meet(state, pivots, whole, before)
        if whole > 1:
            seen.append(([tuple(sorted((r.p, r.doc))) + (r.sig,) for r in out.collect()], [frozenset(r.d) for r in state.open.groupBy("sig", "many").agg(F.collect_set("doc").alias("d")).collect()]))
            again.extend(pairs for pairs in seen[-1][0] if pairs in earlier)
            earlier.update(seen[-1][0])
        return out

    monkeypatch.setattr(near_join._State, "_met", met)
    params = near_join.JaccardParams(words=2, num=85, den=100, frequent=3, pivots=4)
    assert got(near_join.near_groups(frame(spark, docs), params)) == brute.near(docs, 2)
    assert len(seen) > 1 and all(pairs for pairs, _ in seen) and not again
    for pairs, members in seen:
        assert len(pairs) == len(set(pairs)) and len(members) == len(set(members))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(55, 54), (54, 55)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 120)} == {100} and found[55] == 54
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_pair_of_a_crowd_meets_in_one_of_its_entries(spark, monkeypatch):
    blocks = [" ".join(f"b{i}x{j}" for j in range(20)) for i in range(6)]
    docs = list(enumerate(" ".join(x) for x in itertools.combinations(blocks, 3))) + [(90, " ".join(blocks[:3]) + " end")]
    meet, seen = near_join._State._met, []

    def met(state, pivots, whole, before):
        out = meet(state, pivots, whole, before)
        if whole > 1:
            seen.append([(r.many, *sorted((r.p, r.doc))) for r in out.collect()])
        return out

    monkeypatch.setattr(near_join._State, "_met", met)
    params = near_join.JaccardParams(words=2, num=80, den=100, frequent=3, pivots=4)
    assert got(near_join.near_groups(frame(spark, docs), params)) == brute.near(docs, 2, 80, 100)
    assert sum(map(len, seen)) > 20
    for pairs in seen:
        assert len(pairs) == len(set(pairs))


def test_what_is_known_of_a_crowd_goes_with_its_texts(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 1, 5), (2, text + " end", 1, 6), (3, "a b c d e", 3, 0)], "doc_id long, text string, component long, rare int")
    found = near_join.crowd_bands(docs, near_join.JaccardParams(words=2))
    assert {(r.doc, r.component, r.rare, r.many) for r in found.collect()} == {(1, 1, 5, True), (2, 1, 6, True)}
    assert found.groupBy("sig", "doc").count().filter("count > 1").isEmpty() and found.count() % 2 == 0


def test_members_of_a_crowd_without_a_partner_have_no_bands(spark, monkeypatch):
    common = [f"c{i}" for i in range(40)]
    docs = [(i, " ".join(common + [f"u{i}x{j}" for j in range(6 if i < 20 else 3)])) for i in range(40)]
    made, bands = [], near_join.crowd_bands

    def counted(some, params):
        made.append({r.doc_id for r in some.collect()})
        return bands(some, params)

    monkeypatch.setattr(near_join, "crowd_bands", counted)
    params = near_join.JaccardParams(words=2, num=85, den=100, frequent=3, crowd=4, pivots=4)
    assert got(near_join.near_groups(frame(spark, docs), params)) == brute.near(docs, 2)
    # with six tokens of its own a set shares 39 at most, too few with 42 and more; those with three may be alike
    assert made == [set(range(20, 40))]
