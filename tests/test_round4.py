"""What a report shuffles, and that sieves, first lines and numbers keep their rules."""

from pyspark.sql import functions as F

from lecturelake import storage
from lecturelake.operators import lines, ordered

KIND = "lesson_id string, frame_index long, line_no long, line string"


def rows(df, *names):
    return sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


def test_a_sieve_lets_all_its_keys_through(spark):
    numbers = spark.range(20_000).select("id", F.xxhash64("id").alias("key"))
    wanted = numbers.filter("id % 10 = 0")
    table = storage.sieve(wanted, F.col("key"), "some")
    inside, outside = (storage.sieved(numbers, F.col("key"), table, x) for x in (False, True))
    found = {r.id for r in inside.collect()}
    assert found >= set(range(0, 20_000, 10)) and len(found) < 2_100
    assert found.isdisjoint(others := {r.id for r in outside.collect()}) and len(found | others) == 20_000
    assert table.count() <= 1 << storage.SIEVE_BITS and inside.columns == outside.columns == ["id", "key"]
    none = storage.sieve(wanted.limit(0), F.col("key"), "none")
    assert storage.sieved(numbers, F.col("key"), none).count() == 0 and storage.sieved(numbers, F.col("key"), none, True).count() == 20_000


def test_lines_that_no_other_can_hold_are_not_shuffled(spark, monkeypatch):
    texts = [" ".join(f"word{i}x{j}" for j in range(12)) for i in range(300)]
    texts += [f"{t} end" for t in texts[:5]] + [texts[10].split(" ")[3], "d7x2 word7x3 wor"]
    df = spark.createDataFrame([("a", i, 0, t) for i, t in enumerate(texts)], KIND)
    through, sieved = [], lines.sieved

    def counted(rows, key, table, outside=False):
        out = sieved(rows, key, table, outside)
        if not outside:
            through.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(lines, "sieved", counted)
    left = {r.frame_index for r in lines.substring_dedupe(df).collect()}
    assert left == {i for i, t in enumerate(texts) if not any(len(o) > len(t) and t in o for o in texts)} and len(texts) - len(left) == 7
    # of some 3,700 rows of neighbouring words each line asks by one; of whole lines only those that a join may meet
    assert max(n for n, _ in through) > 2_000 and max(n for _, n in through) < 400


def test_first_lines_by_a_sieve_are_those_of_the_plain_rule(spark):
    texts = ["One line", "one LINE ", "　two", "", None, " ", "Straße", "STRASSE", "alone", "Über", "über"]
    df = spark.createDataFrame([(lesson, i, k, t) for lesson in ("a", "b", None) for i in range(3) for k, t in enumerate(texts[i:])] + [("c", 1, 1, "alone"), ("c", None, None, "none")], KIND)
    names = ("lesson_id", "frame_index", "line_no", "line", "key")
    assert rows(lines.sieved_line_union(df), *names) == rows(lines.line_union(df), *names)
    assert lines.sieved_line_union(df.limit(0)).count() == 0


def test_numbers_in_blocks_are_those_of_all_rows(spark):
    df = spark.createDataFrame([(lesson, f, n, "x") for lesson in ("a", "b", None) for f in (None, -7, 0, 3, 999, 1000, 25_000) for n in range(4)], KIND)
    names = ("lesson_id", "frame_index", "line_no", "ordinal")
    found = ordered.numbered_in_blocks(df.repartition(5), F.floor(F.col("frame_index") / 1000), lines.ORDER)
    assert rows(found, *names) == rows(lines.rank_within_lesson(df), *names)
    assert found.columns == [*df.columns, "ordinal"]
