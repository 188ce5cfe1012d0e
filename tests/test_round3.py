"""Work of lecture queries grows with their input."""

import random

from base_rows import recorded
from pyspark.sql import functions as F

from lecturelake.functions import text
from lecturelake.operators import assemble, lines, models
from lecturelake.plans import frame_queries
from lecturelake.sources import media
from lecturelake.streaming import stateful


def board(spark, texts):
    return spark.createDataFrame([("a", i, 0, t) for i, t in enumerate(texts)], "lesson_id string, frame_index long, line_no long, line string")


def test_lines_with_the_same_frequent_words_are_not_paired(spark, monkeypatch):
    texts = [f"w{i:02d} x the y {i:02d}z" for i in range(60)] + [f"bb w{i:02d} x the y {i:02d}z cc" for i in range(0, 60, 20)] + ["aq7 the and of r7 b", "q7 the and of r7", "q8 an on", "and q8 an on b8", "a the b c d e", "x a the b c d ef"]
    seen = recorded(monkeypatch, lines)
    left = {r.frame_index for r in lines.substring_dedupe(board(spark, texts)).collect()}
    keep = {i for i, t in enumerate(texts) if not (len(t) >= 8 and any(len(o) > len(t) and t in o for o in texts))}
    assert left == keep and 0 not in keep and 1 in keep
    assert seen["board-pairs"] <= len(texts)


def test_short_and_long_lines_are_found_in_longer_ones(spark):
    r = random.Random(5)
    words = ["a", "b", "the", "an", "onion", "ß", "longerword", "", "x=1", "thing"]
    texts = list(dict.fromkeys(" ".join(r.choice(words) for _ in range(r.randint(1, 8))).strip() for _ in range(150)))
    texts += [t[r.randint(0, 4) : r.randint(8, 30)].strip() for t in texts]
    keys = [t.lower().replace("ß", "ss") for t in texts]
    keep = {i for i, k in enumerate(keys) if not (len(k) >= 8 and any(len(o) > len(k) and k in o for o in keys))}
    assert {x.frame_index for x in lines.substring_dedupe(board(spark, texts)).collect()} == keep


def test_report_of_rows_equals_that_of_arrays(spark):
    kind = "lesson_id string, board_lines array<string>, transcript string, clarity string, score string, suggestion string, laplacian_variance string, stroke_width_variance string, similarity string, overlap string, verdict string, errors map<string,string>"
    more = ("fair", "1", "x", "2", "3", "0.1", "0.2")
    whole = spark.createDataFrame([("a", [f"line {i}" for i in range(130)], "word " * 1000, *more, "v", {"m": "no"}), ("b", None, None, None, *more[1:], None, None), ("c", [], "", *more, "v", {})], kind)
    from lecturelake.functions.text import text_chunks

    board = whole.selectExpr("lesson_id", "posexplode(board_lines) as (ordinal, line)")
    speech = whole.select("lesson_id", F.posexplode(text_chunks(F.col("transcript"))).alias("ordinal", "text"))
    rows = {tuple(r) for r in assemble.report_lines(whole).collect()}
    assert rows == {tuple(r) for r in assemble.report_lines(whole.drop("board_lines", "transcript"), board, speech).collect()}
    assert sorted(r[1] for r in rows if r[0] == "a") == list(range(1 + 1 + 130 + 1 + 3 + 1 + 56 + 1 + 3 + 2)) and ("b", 2, 1, 751.89, 10, "(no text recognized)") in rows


def test_streams_call_python_once_a_bucket(spark, tmp_path):
    rows = [("a", i, 0, f"Line {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lesson_id string, frame_index long, line_no long, line string")
    df.write.parquet(str(tmp_path / "in"))
    stream = stateful.stream_line_union(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), buckets=16)
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert stateful.settled_lines(spark.read.parquet(out)).count() == 3000
    # a state a bucket, not a state a line
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 16


def test_words_stay_where_they_are_with_a_small_model(spark):
    texts = spark.createDataFrame([(1, "a b a b"), (2, "c"), (3, "")], "doc_id long, text string")
    scored = models.paragraph_perplexity(texts, texts.limit(2), "doc_id")
    assert "hashpartitioning(before" not in scored._jdf.queryExecution().toString() and "word#" in scored._jdf.queryExecution().toString()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "word" in x]
    assert scored.filter("perplexity = double('inf')").count() == 1


def test_packed_dumps_are_few_files(spark):
    rows = spark.range(200).selectExpr("id as video_id", "concat('packet,', id, '.5,K__') as value")
    folder = frame_queries.dumped(rows, "dump")
    assert len(spark.read.option("recursiveFileLookup", True).text(folder).inputFiles()) <= 8
    assert {(int(r.video_id), r.ts) for r in media.scan_probe_csv(spark, folder).collect()} == {(i, i + 0.5) for i in range(200)}


def old_refined(text, ascii, singletons):
    """The rules, token by token."""
    import re

    space = re.compile(r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    out = re.sub(r"[^\x00-\x7f]", " ", text) if ascii else text
    tokens = [t for t in space.sub(" ", out).strip(" ").split(" ")]
    if singletons:
        letters = [re.sub("[^A-Za-z]", "", t) for t in tokens]
        digit = [bool(re.search("[0-9]", t)) for t in tokens]
        tokens = [t for t, x, d in zip(tokens, letters, digit, strict=True) if d or not (len(x) == 1 and x not in ("a", "I") or not x and len(t) <= 1)]
    return " ".join(tokens)


def test_refined_lines_keep_their_rules(spark):
    r = random.Random(11)
    signs = ["a", "I", "b", "Z", "ab", "7", "-", "+", "é", "\U0001f600", "\u3000", "\x85", "\x1c", "\t", "\n", "\r", " ", " ", " ", "  ", "b7", "(x)", "--", "$", "\u2028"]
    texts = ["", " ", "\n", "b", " b c ", "a b I c", "b\n"] + ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    for ascii in (True, False):
        for singletons in (True, False):
            found = {x.i: x.r for x in rows.select("i", text.refined_line(F.col("t"), ascii, singletons).alias("r")).collect()}
            assert found.pop(-1) is None
            assert found == {i: old_refined(t, ascii, singletons) for i, t in enumerate(texts)}
    dropped = {x.i: x.r for x in rows.filter("i >= 0").select("i", text.drop_singleton_tokens(F.col("t")).alias("r")).collect()}
    assert dropped == {i: old_refined(t, False, True) for i, t in enumerate(texts)}


def test_refining_is_no_walk_over_tokens(spark):
    rows = spark.createDataFrame([("a", 0, 0, "b it")], "lesson_id string, frame_index long, line_no long, line string")
    plan = lines.refine_kept_lines(rows)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("regexp_replace(line") == 1  # over texts, and once
