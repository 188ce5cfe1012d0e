import dataclasses
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lecturelake.llm import chat, pieces, quality, url_filter

SF = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "chars", "ids", "n", "label", "features")})


# --- urls
PAGES = [
    (1, "http://a.org/x", '<a href="http://b.net/q">'),
    (2, "http://B.net/", '<a href="//c.net">'),
    (3, "http://c.net/p?u=/fr/", None),
    (4, "https://www.bad.com/de/1#top", '<a href="http://c.net/">'),
    (5, "http://evil.net/", '<a href=http://www.bad.com/de/1>'),
    (6, None, "x"),
    (7, "no scheme", ""),
    (8, "http://m.example.org/en/12", None),
    (9, "http://example.org/en", None),
    (10, "ftp://Org/", None),
    (11, "http://x.com/fr/de/", None),
    (12, "http://a.org", None),
    (13, "http://lone.net/", None),
    (14, "http://www.shop.evil.net/", None),
    (15, "http://shop.evil.net/", "<A HREF='https://www.BAD.com/de/'>"),
    (1, "http://a.org/x", None),
]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "rule", "rank", "src", "dst")})


def test_rules_and_parts(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages_frame(spark, PAGES)).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][:3] == ("b.net", "/", None) and got[3][:3] == ("c.net", "/p", None)
    assert got[4] == ("www.bad.com", "/de/1", "com/de/", "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("org/", "allow") and got[10] == ("org", "/", "org/", "allow")
    assert got[11][2:] == ("com/fr/", "allow") and got[12][2] is None and got[13][3] == "allow"
    assert url_filter.url_verdicts(pages_frame(spark, PAGES)).count() == len(PAGES)
    assert url_filter.url_verdicts(pages_frame(spark, [])).count() == 0


def test_trust_and_distrust_match_a_plain_walk(spark):
    p = url_filter.UrlParams(tolerance=1e-2, rounds=20)
    edges = {("a.org", "b.net"): 1, ("b.net", "c.net"): 1, ("www.bad.com", "c.net"): 1, ("evil.net", "www.bad.com"): 1}
    edges |= {("www.shop.evil.net", "shop.evil.net"): 1, ("shop.evil.net", "www.shop.evil.net"): 1, ("shop.evil.net", "www.bad.com"): 1}

    def walk(pairs, seeds):
        out = dict(seeds)
        total = {}
        for (a, _), w in pairs.items():
            total[a] = total.get(a, 0) + w
        for _ in range(p.rounds):
            new = {h: s * (1 - p.damping) for h, s in seeds.items()}
            for (a, b), w in pairs.items():
                if a in out:
                    new[b] = new.get(b, 0) + out[a] * w / total[a] * p.damping
            out = new
        return out

    trust = walk(edges, {"a.org": 1.0, "example.org": 1.0, "org": 1.0, "x.com": 1.0})
    distrust = walk({(b, a): w for (a, b), w in edges.items()}, {"www.bad.com": 1.0, "m.example.org": 1.0})
    blocked = {h for h, d in distrust.items() if d > p.factor * trust.get(h, 0) and d > p.floor}
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages_frame(spark, PAGES), p).collect()}
    assert {"evil.net", "www.shop.evil.net"} <= blocked
    assert all((got[i] == "block") == (h in blocked) for i, h in ((2, "b.net"), (3, "c.net"), (5, "evil.net"), (13, "lone.net"), (14, "www.shop.evil.net"), (15, "shop.evil.net")))


def test_hubs_that_are_split_keep_their_ranks(spark):
    pairs = [("hub.net", f"h{i}.net") for i in range(12)] + [(f"h{i}.net", "hub.net") for i in range(12)] + [("h1.net", "h2.net")]
    out = Counter(a for a, _ in pairs)
    edges = spark.createDataFrame([("good", a, b, 1 / out[a]) for a, b in pairs], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("good", "h1.net", 1.0), ("good", "alone.net", 0.5)], "kind string, host string, seed double")
    whole, split = ({r.host: r["rank"] for r in url_filter.personalised(edges, seeds, url_filter.UrlParams(tolerance=1e-3, edges_a_part=n)).collect()} for n in (100, 4))
    assert whole.keys() == split.keys() and all(abs(whole[h] - split[h]) < 1e-12 for h in whole)
    assert abs(sum(whole.values()) - 1.075) < 2e-3 and abs(whole["alone.net"] - 0.075) < 1e-3


def test_bonds_reach_every_domain_above_and_link_siblings(spark):
    urls = ["http://www.bad.com/de/1", "http://bad.com/", "http://shop.bad.com/", "http://x.y.bad.com/", "http://good.com/fr/", "http://www.good.com/", "http://other.com/", "http://1.2.3.4/", "http://9.2.3.4:80/", "http://a..com/", "http://b.bad.com./"]
    got = {u: r.verdict for r in url_filter.url_verdicts(pages_frame(spark, [(i, u, None) for i, u in enumerate(urls)]), url_filter.UrlParams(tolerance=1e-2)).collect() for u in [urls[r.page_id]]}
    assert [got[u] for u in urls] == ["block"] * 4 + ["allow"] * 7
    hosts = spark.createDataFrame([(h, None) for h in ("a.b.c.d", "a.b.c.d", "b.c.d", "c.d", "1.2.3.4", "9.2.3.4:80", "a..com", "b.bad.com.")], "host string, html string")
    edges = {(r.src, r.dst): r.weight for r in url_filter.host_edges(hosts).collect()}
    up = {("a.b.c.d", "b.c.d"): 0.5, ("a.b.c.d", "c.d"): 0.5, ("b.c.d", "c.d"): 1.0}
    assert edges == up | {(b, a): w for (a, b), w in up.items()}


def test_scores_reach_the_end_of_a_long_chain_and_equal_the_solved_ranks(spark):
    n = 60
    chain = [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}.net/">' if i else '<a href="http://h1.net/">') for i in range(n)]
    p = url_filter.UrlParams(rules=(("block", "h0.net/"), ("allow", "a.net/")))
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages_frame(spark, [*chain, (n, "http://a.net/", None)]), p).collect()}
    assert got == dict.fromkeys(range(n), "block") | {n: "allow"}
    hosts = spark.createDataFrame([(f"h{i}.net", html, "block" if i == 0 else None) for i, _, html in chain], "host string, html string, by_rule string")
    ranks = {r.host: r.distrust for r in url_filter.host_verdicts(hosts, p).collect()}
    step = np.zeros((n, n))
    for i in range(n):
        step[i, i - 1 if i else 1] = 1.0
    into = step.sum(0)
    solved = np.linalg.solve(np.eye(n) - p.damping * (step / np.where(into, into, 1)[None, :]), (1 - p.damping) * np.eye(n)[0])
    assert all(abs(ranks[f"h{i}.net"] - solved[i]) < 1e-9 for i in range(n))
    with pytest.raises(ValueError):
        url_filter.host_verdicts(hosts, dataclasses.replace(p, damping=1.0))


# --- pieces
def test_pieces_equal_the_tokenizers_own(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))[:80]
    r = random.Random(2)
    docs += [(1000 + i, "".join(r.choice("aabeeththin  \n\tzq.,'漢é01=-_😀") for _ in range(r.randint(0, 40)))) for i in range(150)]
    docs += [(2000, None), (2001, ""), (2002, " "), (2003, "   x"), (2004, "word " * 3000), (2005, "abc" * 4000), (2005, "abc" * 4000)]
    rows = pieces.encode(docs_frame(spark, docs), batch_bytes=30_000).collect()
    assert len(rows) == len(docs)
    of = dict(docs)
    for x in rows:
        text = of[x.doc_id]
        assert (x.ids is None and x.round_trip is None) if text is None else (x.ids == model.encode(text) and x.round_trip and x.n_ids == len(x.ids))
    back = {x.doc_id: x.text for x in pieces.decode(pieces.encode(docs_frame(spark, docs))).collect()}
    assert back == of
    assert pieces.encode(docs_frame(spark, [])).count() == 0
    assert not pieces.encode(docs_frame(spark, [(1, "a▁b")])).first().round_trip


# --- quality
def test_paths_of_a_printed_tree():
    text = "Model\n  If (feature 3 <= 0.5)\n   Predict: 1.0\n  Else (feature 3 > 0.5)\n   If (feature 0 <= 2.0E-4)\n    Predict: 0.0\n   Else (feature 0 > 2.0E-4)\n    Predict: 1.0\n"
    a, b = (3, False, 0.5), (3, True, 0.5)
    assert quality.paths(text) == {(a,), (b,), (b, (0, False, 2e-4)), (b, (0, True, 2e-4))}


def test_held_out_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 100_000), (-3, "x" * 100_000), (None, "a b")], "doc_id long, text string"))
    rows = quality.scores(extra, labels.withColumn("label", F.lit(3)), dataclasses.replace(quality.QualityParams(), n_trees=6)).collect()
    assert len(rows) == 1005 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93 and len(held) > 40


def test_labels_of_one_class_or_none(spark):
    docs = docs_frame(spark, [(1, "a"), (2, "b")])
    for rows, score in (([], 0.5), ([(i, 1) for i in range(3)], 1.0), ([(1, None)], 0.5)):
        got = quality.scores(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(got) == 2 and all(abs(r.score - score) < 1e-6 for r in got)
    assert quality.scores(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# --- chats
TALK = [(c, t, ("system" if c % 4 == 0 and t == 0 else "user" if (t + (c % 4 == 0)) % 2 == 0 else "assistant"), None) for c in range(60) for t in range(5)]


def talks(spark):
    r = random.Random(1)
    rows = []
    for c, t, role, _ in TALK:
        n = {"system": 3, "user": 6, "assistant": 30}[role]
        text = "\n".join(" ".join("w" * r.randint(1, 5) for _ in range(r.randint(max(1, n // 2), n))) for _ in range(1 if role != "assistant" else r.randint(1, 4)))
        rows.append((c, t, role, text + ("?" if role == "user" and r.random() < 0.7 else "")))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("piece", "part", "n", "row")})


def test_roles_are_recovered_alike_in_pieces_of_any_size(spark):
    df = talks(spark)
    whole = chat.format_chats(df)
    held = whole.filter("not learned").withColumnRenamed("role", "got").join(df, ["conv_id", "turn"])
    assert held.filter("got = role").count() / held.count() > 0.9
    parts = chat.format_chats(df, chat.ChatParams(piece_turns=2))
    key = lambda d: {(r.conv_id, r.turn, r.role, r.rendered) for r in d.collect()}
    assert key(parts) == key(whole)


def test_viterbi_finds_the_best_path(spark):
    df = talks(spark)
    params = chat.ChatParams(piece_turns=2)
    model = chat.fit(df, params)
    small = df.filter("conv_id < 3 and turn < 4")
    got = {}
    for r in chat.recover(small, model, params).collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.role
    for conv, roles in got.items():
        texts = [r.text for r in small.filter(F.col("conv_id") == conv).orderBy("turn").collect()]
        weights = model.weights(texts, True)
        firsts = [0, *itertools.accumulate(len(t.split("\n")) for t in texts[:-1])]
        best = max(itertools.product(range(3), repeat=len(texts)), key=lambda p: _score(p, weights, firsts))
        assert [roles[t] for t in sorted(roles)] == [model.roles[i] for i in best]


def _score(path, weights, firsts):
    """A role per turn; inside a turn it stays."""
    total, before, turn = 0.0, 0, -1
    for i, w in enumerate(weights):
        turn += i in firsts
        total += w[before, path[turn]]
        before = path[turn]
    return total


def test_markers_nulls_and_rendering(spark):
    model = chat.fit(talks(spark), chat.ChatParams())
    rows = [(1, 0, None, "Human: hello\nmore"), (1, 1, None, "Assistant: hi  "), (1, 2, None, None), (None, 0, None, "[User] x: y"), (None, 0, None, "[User] x: y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.recover(df, model, chat.ChatParams()).collect()
    assert len(out) == 5
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 0].role == "user" and got[1, 0].rendered == "<|user|>\nhello\nmore\n<|end|>"
    assert got[1, 1].role == "assistant" and got[1, 1].rendered == "<|assistant|>\nhi\n<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_several_speakers_in_one_text_give_a_turn_each(spark):
    model = chat.fit(talks(spark), chat.ChatParams())
    rows = [(1, 0, None, "User: a\nAssistant: b\nmore\nHuman: c\nUser: d"), (1, 1, None, "Assistant: e"), (2, 0, None, "System: s\nUser: q?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {(1, 0, 0, "user", "a"), (1, 0, 1, "assistant", "b\nmore"), (1, 0, 2, "user", "c\nd"), (1, 1, 0, "assistant", "e"), (2, 0, 0, "system", "s"), (2, 0, 1, "user", "q?")}
    for params in (chat.ChatParams(), chat.ChatParams(piece_turns=1)):
        got = {tuple(r) for r in chat.recover(df, model, params).select("conv_id", "turn", "sub", "role", "rendered").collect()}
        assert got == {(c, t, n, role, f"<|{role}|>\n{body}\n<|end|>") for c, t, n, role, body in want}


def test_long_runs_of_spaces_merge_as_the_tokenizer_does():
    import sentencepiece

    own, theirs = pieces.Vocabulary.read(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [" " * n + "end" for n in (1, 2, 3, 7, 17, 100, 2001)] + ["a" + " " * 60_000 + "b" + " " * 5]
    ids, offsets = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [theirs.encode(t) for t in texts]


def test_encoding_holds_a_small_part_of_a_batch_and_of_a_long_text():
    import tracemalloc

    own, r = pieces.Vocabulary.read(), random.Random(5)
    words = ["".join(r.choice("abeinrst") for _ in range(5)) for _ in range(500)]
    short = [" ".join(r.choices(words, k=200)) for _ in range(2000)]
    own.encode([" ".join(words)])
    for texts in (short, [" ".join(short)]):
        tracemalloc.start()
        ids, offsets = own.encode(texts)
        assert [own.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == texts
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 15 * sum(map(len, texts))


def test_spans_and_forgotten_words_change_no_ids(monkeypatch):
    own, theirs, r = pieces.Vocabulary.read(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), random.Random(6)
    monkeypatch.setattr(pieces, "SPAN", 7)
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 5)
    texts = ["".join(r.choice("aabeeththin   \nzq.,'漢é01😀▁") for _ in range(n)) for n in range(120)] + [None, "", " " * 30, "x" * 40]
    own.learn_texts(texts[:60])
    ids, offsets = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [theirs.encode(t or "") for t in texts]
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert own.decode(ids[a:b]) == own.decode(ids[a:b].tolist()) == (t or "").replace("▁", " ")
