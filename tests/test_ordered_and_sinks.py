"""Numbers and joined texts of lessons that lie in many parts, and sinks that are cut off and repeated."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lecturelake.operators import assemble, lines, ordered
from lecturelake.sources import sinks

LINE = "lesson_id string, frame_index long, line_no long, line string"


def board(spark, seed=1, many=700):
    """One lesson holds most rows; texts are empty, null, of one letter, long, and of several bytes a letter."""
    r = random.Random(seed)
    texts = ["", "x", "é漢", "word " * 9, "0123456789" * 5]
    rows = [("big" if r.random() < 0.8 else r.choice(["a", "b", None]), i // 7, i % 7, r.choice(texts)) for i in range(many)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, LINE)


def test_numbers_are_those_of_a_sort(spark):
    rows, df = board(spark)
    got = {(x.lesson_id, x.frame_index, x.line_no): x.ordinal for x in lines.rank_within_lesson(df.repartition(5)).collect()}
    want = {}
    for key in {x[0] for x in rows}:
        for n, x in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1:3])):
            want[x[:3]] = n
    assert got == want


def test_no_window_sorts_a_lesson(spark):
    _, df = board(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lines.rank_within_lesson(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for window in re.findall(r"Window \[.*", plan):
        assert "_part#" in window  # either it is of one part, or it is over the sums of parts
    assert len(re.findall(r"\[lesson_id#\d+\], \[frame_index#", plan)) == 0


@pytest.mark.parametrize("size,by", [(1, "\n"), (7, "\n"), (50, ", "), (10**6, "\n"), (13, "")])
def test_chunks_put_together_are_the_joined_text(spark, size, by):
    rows, df = board(spark, 3, 300)
    chunks = ordered.joined_chunks(df, lines.ORDER, by, size)
    cut = {}
    for x in chunks.collect():
        assert len(x.text) <= size
        cut.setdefault(x.lesson_id, {})[x.chunk_no] = x.text
    want = {k: by.join(x[3] for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:3])) for k in {x[0] for x in rows}}
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in cut.items()} == want
    for k, v in cut.items():
        assert sorted(v) == list(range(max(1, -(-len(want[k]) // size))))
        assert all(len(v[i]) == size for i in sorted(v)[:-1])
    assert {x.lesson_id: x.text for x in ordered.whole_text(chunks).collect()} == want


def test_chunks_of_nothing(spark):
    none = spark.createDataFrame([], LINE)
    assert ordered.joined_chunks(none, lines.ORDER).count() == 0
    assert lines.rank_within_lesson(none).count() == 0
    blank = spark.createDataFrame([("a", 0, 0, ""), ("b", 0, 0, None)], LINE)
    assert [(x.lesson_id, x.chunk_no, x.text) for x in ordered.joined_chunks(blank, lines.ORDER).collect()] == [("a", 0, "")]
    with pytest.raises(ValueError):
        ordered.joined_chunks(none, lines.ORDER, size=0)


def lessons(spark, *rows):
    return spark.createDataFrame(rows, "lesson_id string, note string")


def test_an_attempt_that_was_cut_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.read_batches(spark, path).count() == 0
    sinks.write_attempt(assemble.lesson_json(lessons(spark, ("a", "half"))), path, 0)
    assert sinks.read_batches(spark, path).count() == 0
    whole = lessons(spark, ("a", "new\nline"), ("b", "é"))
    for _ in range(3):
        assemble.sink_lesson_json(whole, path, 0)
    assert sorted(json.loads(x.document)["note"] for x in sinks.read_batches(spark, path).collect()) == ["new\nline", "é"]
    assemble.sink_lesson_json(lessons(spark, ("a", "later")), path, 1)
    got = {x.lesson_id: json.loads(x.document)["note"] for x in sinks.latest(sinks.read_batches(spark, path)).collect()}
    assert got == {"a": "later", "b": "é"}


def test_of_two_attempts_one_counts(spark, tmp_path):
    path = str(tmp_path / "out")
    tries = [sinks.write_attempt(assemble.lesson_json(lessons(spark, ("a", str(i)))), path, 4) for i in range(2)]
    for x in tries:
        sinks.commit(spark, path, 4, x)
    assert [json.loads(x.document)["note"] for x in sinks.read_batches(spark, path).collect()] == [str(tries.index(min(tries)))]


def test_a_stream_that_repeats_its_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).select(F.col("id").cast("string").alias("lesson_id"), F.lit("n").alias("note")).write.parquet(source)
    stream = lambda: assemble.lesson_json(spark.readStream.schema("lesson_id string, note string").parquet(source))
    for state in ("one", "one", "other"):  # the third run has lost what was done and starts anew
        sinks.stream_batches(stream(), path, str(tmp_path / state)).awaitTermination()
    assert sinks.read_batches(spark, path).count() == 40
