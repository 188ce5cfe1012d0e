"""Spelling variants, min-hash groups and the prefix trie against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lecturelake.llm import minhash, near_join, prefix_trie, sketch, spelling


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("n", "word", "key", "d", "length", "rep")})


# --- spelling variants
def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(docs, slips=31, least=7, factor=10):
    total = Counter()
    for doc, text in docs:
        for run in spelling.RUNS.findall(text or ""):
            low = brute.lower(run)
            h = zlib.crc32(f"{doc}:{low}".encode())
            if slips and doc is not None and h % slips == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            total[low] += 1
    words = {w: n for w, n in total.items() if len(w) >= least and n >= 2}
    near = {w: [v for v in words if near_words(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def variants(spark, docs, **more):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, docs), spelling.SpellingParams(**more)).collect()}


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_variants_match_brute_force(spark, symbols):
    r = random.Random(symbols)
    docs, stems = [], ["aabbaabb", "letters", "Étéretéré", "ÿzÿzÿzÿ", "aaaaaaaa", "neighbour"]
    for i in range(120):
        words = []
        for _ in range(30):
            w = list(r.choice(stems))
            for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at : at + (kind != 2)] = r.choice(("a", "b", "é", "")) if kind else ""
            words.append("".join(w))
        docs.append((i, r.choice((" ", "-", "1")).join(words)))
    want = spelled(docs)
    assert variants(spark, docs, slips=31, symbols=symbols) == want
    assert sum(w[1] is not None for w in want) > 5 and max(w[4] for w in want) > 10


def test_chains_ties_and_odd_rows(spark):
    chain = [("aaaaaaaaa", 6000), ("aaaaaaaab", 600), ("aaaaaaabb", 60), ("aaaaaabbb", 3), ("cccccccx", 40), ("cccccccy", 40), ("ccccccc", 4)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)] + [(None, "aaaaaabbb 1 ÀÉÎÕÜaZ ÀÉÎÕÜaz ×÷×÷×÷×"), (50, None), (51, ""), (52, "×÷×÷×÷× x" + "y" * 3000)]
    docs += [(60, "aaaaaabbb")] * 2
    got = variants(spark, docs)
    assert got == spelled(docs, slips=None)
    by = {g[0]: g for g in got}
    assert by["aaaaaabbb"][1:3] == ("aaaaaaabb", "aaaaaaaaa") and by["ccccccc"][1] == "cccccccx" and by["×÷×÷×÷×"][3] == 2
    assert variants(spark, []) == set()


# --- min-hash groups
def grouped(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def drifting(seed, members, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out, last = [], base
    for i in range(members):
        text = list(last if i % 3 == 0 else base)
        for _ in range(r.randint(0, edits)):
            text[r.randrange(len(text))] = f"e{r.randint(0, 9)}"
        last = text
        out.append(" ".join(text))
    return out


def test_min_hash_groups_match_brute_force(spark):
    texts = [t for s in range(10) for t in drifting(s, 14, 6 + 25 * s, 1 + s)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, "a b c d"), (8, "x " * 3000)] + [(100 + i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(docs)
    want = brute.near(docs, 4, 80, 100)
    assert grouped(minhash.near_groups(frame(spark, docs), minhash.MinHashParams(words=4, chunk_bytes=3000))) == want
    assert sum(c != d for d, _, c in want) > 30
    assert minhash.near_groups(frame(spark, [])).count() == 0
    kept = minhash.drop_near_copies(frame(spark, [(3, "a b c"), (2, "A b c"), (4, "z"), (None, "a b C"), (7, None), (7, None)]))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, "A b c"), (4, "z"), (7, ""), (7, "")]


def test_bins_agree_as_often_as_sets_are_alike():
    for n, bins in ((5, 256), (40, 256), (900, 256), (12, 4096)):
        share = []
        for seed in range(30):
            tokens = np.sort(np.random.default_rng(seed).integers(0, 2**64, n + n // 4, dtype=np.uint64))
            order = np.random.default_rng(seed + 999).permutation(len(tokens))
            a, b = np.sort(tokens[order[:n]]), np.sort(tokens[order])
            s = sketch.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), bins)
            share.append((s[0] == s[1]).mean())
        assert abs(np.mean(share) - n / (n + n // 4)) < 0.04


@pytest.mark.parametrize("find", ["prefixes", "sketches"])
def test_a_crowd_of_unlike_pages_from_the_same_blocks(spark, find, monkeypatch):
    r = random.Random(7)
    blocks = [" ".join(f"p{b}x{i}" for i in range(40)) for b in range(30)]
    pages = [" ".join(r.sample(blocks, 15)) for _ in range(300)]
    pages += [p.replace("x7 ", "x ", 1) for p in pages[:5]]
    docs = list(enumerate(pages))
    counted = []
    plain = near_join.possible
    monkeypatch.setattr(near_join, "possible", lambda pairs, *more: counted.append(pairs.count()) or plain(pairs, *more))
    if find == "prefixes":
        got = near_join.near_groups(frame(spark, docs), near_join.JaccardParams(words=4, num=85, den=100, crowd=16))
    else:
        got = minhash.near_groups(frame(spark, docs), minhash.MinHashParams(words=4, num=85, den=100, crowd=16))
    assert grouped(got) == brute.near(docs, 4, 85, 100)
    assert sum(counted) < 50 * len(docs), counted  # of 46,360 pairs


# --- prefix trie
def trie(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", brute.hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        stem = c - (abs(c) % every) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(stem, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(q != p and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(brute.WORDS.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children, leaves, saved, sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n, variety):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c - 15, t if t else None, r.choice(("user", "bot", None)) if t % 2 else "user", r.choice((None, "", "two words", *[f"say {i}" for i in range(variety)]))))
    r.shuffle(rows)
    return rows


TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("light,batch,block", [(4000, 200_000, 4096), (3, 10, 2), (25, 40, 3)])
def test_trie_matches_brute_force(spark, light, batch, block):
    rows = conversations(light, 160, 2) + [(None, 1, "user", "lost"), (500, 1, "user", "same"), (500, 1, "user", "same"), (777, 2, "user", "short")]
    rows += [(900, t, "user", f"turn {t % 3}") for t in range(40)] + [(c, t, "user", "hello") for c in range(1000, 1040) for t in range(4)]
    params = prefix_trie.TrieParams(light_rows=light, batch_rows=batch, block=block, ids=3)
    got = prefix_trie.trie(*prefix_trie.grafted(frame(spark, rows, TURN)), params)
    assert {tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()} == trie(rows)


def test_trie_of_plain_and_of_no_conversations(spark):
    rows = conversations(3, 40, 1)
    got = {tuple(r) for r in prefix_trie.trie(*prefix_trie.plain(frame(spark, rows, TURN))).collect()}
    assert got == trie(rows, most=1)
    assert prefix_trie.trie(*prefix_trie.grafted(frame(spark, [], TURN))).count() == 0


def test_perfect_hash_is_minimal():
    k = np.random.default_rng(1).integers(0, 2**63, (2, 5000)).astype(np.uint64)
    k[0, :100] = 7
    table = prefix_trie.PerfectHash(*k)
    assert table.size == 5000 and sorted(table.slots(*k).tolist()) == list(range(5000))


def test_digests_that_collide_stop_the_run():
    row = {n: np.array([1, 2], np.int64) for n in ("conv_id", "mark")} | {n: np.array([1, 1], np.int64) for n in ("d", "k1", "k2", "p1", "p2", "words", "t1", "t2")}
    with pytest.raises(ValueError, match="one digest"):
        prefix_trie.node_table(row)
