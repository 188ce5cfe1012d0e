"""Operators on board lines: lines(lesson_id, frame_index, line_no, line), one row a line, order made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelake.functions import text as T
from lecturelake.operators.ordered import joined_chunks, numbered
from lecturelake.params import LineParams
from lecturelake.storage import sieve, sieved, written

ORDER = ("frame_index", "line_no")


def line_union(lines: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Lines of a lesson in order of first sight; lines that differ in case or outer space are one, blanks go.

    The first of each key is found by an aggregation, which combines before its shuffle, so that a line that
    a third of all frames show costs no more than any other.
    """
    keyed = lines.withColumn("key", T.casefold_key(F.col("line"))).filter("key <> ''")
    first = keyed.groupBy("lesson_id", "key").agg(F.min(F.struct(*order, "line")).alias("first"))
    return first.select("lesson_id", *[F.col(f"first.{c}").alias(c) for c in order], F.trim(T.trimmed(F.col("first.line"))).alias("line"), "key")


def sieved_line_union(lines: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What ``line_union`` gives. Only lines whose key may occur again are shuffled, by a look at a number for each key before; ``lines`` are read twice."""
    keyed = lines.withColumn("key", T.casefold_key(F.col("line"))).filter("key <> ''")
    mark = F.xxhash64("lesson_id", "key")
    again = sieve(keyed.groupBy(mark.alias("mark")).count().filter("count > 1"), F.col("mark"), "board-repeats")
    alone = sieved(keyed, mark, again, outside=True).select("lesson_id", *order, F.trim(T.trimmed(F.col("line"))).alias("line"), "key")
    return alone.unionByName(line_union(sieved(keyed, mark, again).drop("key"), order))


def rank_within_lesson(rows: DataFrame, order: tuple[str, ...] = ORDER, name: str = "ordinal") -> DataFrame:
    """Numbers the rows of each lesson from 0; ranges of rows are numbered side by side, so that no task sorts a lesson."""
    return numbered(rows, order, name)


def noise_line_filter(lines: DataFrame, p: LineParams | None = None, count: Column | None = None) -> DataFrame:
    """Lines with enough characters and letters."""
    p = p or LineParams()
    text = T.trimmed(F.col("line"))
    return lines.filter((F.length(text) >= max(1, p.min_chars)) & ((T.letter_count(text) if count is None else count) >= max(1, p.min_letters)))


def noise_line_filter_math(lines: DataFrame, p: LineParams | None = None) -> DataFrame:
    """The same, where mathematical signs count as letters do."""
    return noise_line_filter(lines, p, T.math_or_letter_count(T.trimmed(F.col("line"))))


#: Characters by which candidates of one word look for the tokens that may hold them, and those of two for their longer word.
GRAM, AFFIX = 8, 4
#: Long candidates ask by a key below this part of all keys where they have one, so that a sieve drops most of the other keys.
LOW_BITS = 3


def _windows(lines: DataFrame, names: list[str], width: int) -> DataFrame:
    """A row for each word of ``lines`` (which have an array ``words``), with its place ``at`` and it and those after it as columns ``w0`` and so on, null past the end."""
    after = [F.slice("words", F.lit(k + 1), F.greatest(F.size("words") - k, F.lit(0))).alias(f"w{k}") for k in range(width)]
    return lines.select(*names, F.posexplode(F.arrays_zip(*after)).alias("at", "w")).select(*names, "at", *[F.col(f"w.w{k}") for k in range(width)])


def _probe(kind: int, before: Column, middle: list[Column], after: Column, x: int, y: int) -> Column:
    """The key of whole words between the last ``x`` characters of the word before them and the first ``y`` of the one after."""
    return F.xxhash64(F.lit(kind), "lesson_id", F.right(before, F.lit(x)), *middle, F.left(after, F.lit(y)))


def _short_probes(before: Column, middle: list[Column], after: Column) -> list[tuple[Column, Column]]:
    """(whether a candidate of just these words asks by it, key) for each key of a short candidate; a holder has all of them."""
    a, b = F.length(before), F.length(after)
    key = lambda kind, x, y: _probe(10 * len(middle) + kind, before, middle, after, x, y)
    if not middle:
        leads = a >= b
        return [(leads & (b > 1), key(0, AFFIX, 2)), (leads & (b < 2), key(1, AFFIX, 1)), (~leads & (a > 1), key(2, 2, AFFIX)), (~leads & (a < 2), key(3, 1, AFFIX))]
    if len(middle) == 1:
        return [((a > 1) & (b > 1), key(0, 2, 2)), ((a < 2) | (b < 2), key(1, 1, 1))]
    return [((a < 2) | (b < 2), key(1, 1, 1))]


def _held_whole(lines: DataFrame, places: list[str]) -> DataFrame:
    """Places of short candidates that a longer line holds: those of one to three words, and of up to five where the outer ones are single characters.

    Whether a line holds such a candidate shows in a few neighbouring words, so that no texts are paired.
    """
    words = F.size("words")
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    lone = lambda c: F.length(c) < 2
    few = lines.filter((words <= 3) | ((words == 4) & (lone(first) | lone(last))) | ((words == 5) & lone(first) & lone(last)))
    few = written(few.select("lesson_id", *places, "size", "key", "words"), "board-short")

    one = few.filter((words == 1) & (F.col("size") >= GRAM)).select("lesson_id", *places, F.col("size").alias("asked"), "key", F.substring("key", 1, GRAM).alias("gram"))
    tokens = lines.select("lesson_id", "size", F.explode("words").alias("token")).filter(F.length("token") >= GRAM)
    grams = tokens.select("*", F.explode(F.sequence(F.lit(1), F.length("token") - GRAM + 1)).alias("i"))
    grams = grams.select("lesson_id", "size", "token", F.substring("token", F.col("i"), F.lit(GRAM)).alias("gram"))
    gram = F.xxhash64("lesson_id", "gram")
    around = sieved(grams, gram, sieve(one, gram, "board-grams")).groupBy("lesson_id", "gram", "token").agg(F.max("size").alias("held"))
    found = one.join(around, ["lesson_id", "gram"]).filter((F.col("held") > F.col("asked")) & F.contains(F.col("token"), F.col("key")))
    found = found.select("lesson_id", *places)

    more = few.filter((words > 1) & ((words > 2) | (F.greatest(F.length(first), F.length(last)) >= AFFIX)))
    inner = lambda n: [F.element_at("words", k + 2) for k in range(n)]
    middle = F.array_join(F.slice("words", F.lit(2), F.greatest(words - 2, F.lit(0))), " ")
    probe = F.coalesce(*[F.when((words == n + 2) & asks, key) for n in range(4) for asks, key in _short_probes(first, inner(n), last)])
    asked = more.select("lesson_id", *places, F.col("size").alias("asked"), first.alias("first"), middle.alias("middle"), last.alias("last"), words.alias("n"), probe.alias("probe"))
    asked = written(asked, "board-probes")
    known = sieve(asked, F.col("probe"), "board-probe-keys")
    met = None
    for n in range(4):
        w = [F.col(f"w{k}") for k in range(n + 2)]
        keys = F.array(*[key for _, key in _short_probes(w[0], w[1:-1], w[-1])])
        held = _windows(lines, ["lesson_id", "size"], n + 2).filter(w[-1].isNotNull())
        held = sieved(held.select("lesson_id", F.col("size").alias("held"), *w, F.explode(keys).alias("probe")), F.col("probe"), known)
        inside = F.concat_ws(" ", *w[1:-1]) if n else F.lit("")
        held = held.select("probe", "lesson_id", F.lit(n + 2).alias("n"), w[0].alias("before"), inside.alias("inside"), w[-1].alias("after"), "held")
        met = held if met is None else met.unionByName(held)
    # of all lines that hold the same words, the longest tells
    held = met.groupBy("probe", "lesson_id", "n", "before", "inside", "after").agg(F.max("held").alias("held"))
    met = asked.join(held, ["probe", "lesson_id", "n"]).filter((F.col("held") > F.col("asked")) & (F.col("middle") == F.col("inside")) & F.endswith(F.col("before"), F.col("first")) & F.startswith(F.col("after"), F.col("last")))
    return found.unionByName(met.select("lesson_id", *places))


def _held_long(lines: DataFrame, places: list[str]) -> DataFrame:
    """Places of all other candidates that a longer line holds.

    Two neighbouring inner words stand as whole words in any line that holds the candidate, the words around them at least with
    two characters each. A candidate asks by the longest such pair among those with a low key, or of all if none has one; a
    line answers by each of its own that a sieve of what is asked lets through.
    """
    w = [F.col(f"w{k}") for k in range(4)]
    rows = _windows(lines.select("lesson_id", *places, "size", F.xxhash64("key").alias("text"), F.size("words").alias("n"), "words"), ["lesson_id", *places, "size", "text", "n"], 4)
    rows = rows.filter("w3 is not null").withColumn("probe", _probe(-1, w[0], w[1:3], w[3], 2, 2))
    # two characters of the words around the pair are known, unless a candidate begins or ends with a shorter one
    known = ((F.col("at") > 0) | (F.length(w[0]) > 1)) & ((F.col("at") < F.col("n") - 4) | (F.length(w[3]) > 1))
    low = F.shiftright("probe", 64 - LOW_BITS) == F.lit(-(1 << LOW_BITS - 1))
    rank = F.least(F.length(w[1]) + F.length(w[2]), F.lit(1 << 20)) + F.when(low, 1 << 21).otherwise(0)
    asked = rows.filter(known).groupBy("lesson_id", *places, "size", "text").agg(F.max_by("probe", rank).alias("probe"))
    asked = written(asked.select("lesson_id", *places, F.col("size").alias("asked"), "probe"), "board-asked")
    held = sieved(rows.select("probe", *[F.col(c).alias(f"of_{c}") for c in places], F.col("size").alias("held")), F.col("probe"), sieve(asked, F.col("probe"), "board-asked-keys"))
    # candidates are a part of all words, so they are what a task keeps in mind
    pairs = held.join(asked.hint("shuffle_hash"), "probe").filter("held > asked").select("lesson_id", *places, *[f"of_{c}" for c in places])
    pairs = written(pairs.distinct(), "board-pairs")
    line, holder = F.xxhash64("lesson_id", *places), F.xxhash64("lesson_id", *[f"of_{c}" for c in places])
    texts = sieved(lines.select("lesson_id", *places, "key"), line, sieve(pairs, line, "board-pair-lines"))
    holders = lines.select("lesson_id", *[F.col(c).alias(f"of_{c}") for c in places], F.col("key").alias("holder"))
    holders = sieved(holders, holder, sieve(pairs, holder, "board-pair-holders"))
    met = pairs.join(holders, ["lesson_id", *[f"of_{c}" for c in places]]).join(texts, ["lesson_id", *places])
    return met.filter((F.length("holder") > F.length("key")) & F.contains(F.col("holder"), F.col("key"))).select("lesson_id", *places)


def subsumed_lines(lines: DataFrame, min_len: int = 8, order: tuple[str, ...] = ORDER) -> DataFrame:
    """lesson_id and order columns of lines that a strictly longer line of their lesson contains; ``lines`` should be a written table.

    Both are cut at spaces. In a line that contains a candidate of several words, its inner words stand whole, its first one
    ends a word and its last one begins one. A candidate asks by one key of neighbouring words, each line answers by
    those of all its words; for short candidates that settles it, longer ones are compared with what they meet. So
    there is a row for each word of a line, and lines are paired only where they share four words, the outer ones in part.
    """
    places = list(order)
    key = T.casefold_key(F.col("line"))
    keyed = lines.filter("lesson_id is not null").select("lesson_id", *order, key.alias("key")).withColumn("size", F.length("key"))
    keyed = keyed.filter(F.col("size") >= min_len).withColumn("words", F.split("key", " "))
    gone = _held_whole(keyed, places).unionByName(_held_long(keyed, places))
    if min_len < GRAM:  # words too short for the looks above meet every longer line
        words = F.size("words")
        longest = F.greatest(F.length(F.element_at("words", 1)), F.length(F.element_at("words", -1)))
        tiny = keyed.filter(((words == 1) & (F.col("size") < GRAM)) | ((words == 2) & (longest < AFFIX))).select("lesson_id", *places, "key")
        met = tiny.join(keyed.select("lesson_id", F.col("key").alias("holder")), "lesson_id").filter((F.length("holder") > F.length("key")) & F.contains(F.col("holder"), F.col("key")))
        gone = gone.unionByName(met.select("lesson_id", *places))
    return gone.distinct()


def substring_dedupe(lines: DataFrame, min_len: int = 8, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Lines without those that a longer line of the lesson contains; short lines stay, equal lines both stay."""
    return without_subsumed(written(lines, "board-lines"), min_len, order)


def without_subsumed(lines: DataFrame, min_len: int = 8, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What ``substring_dedupe`` gives of a written table, which is read several times."""
    gone = written(subsumed_lines(lines, min_len, order), "board-gone")
    place = F.xxhash64("lesson_id", *order)
    some = sieve(gone, place, "board-gone-keys")
    return sieved(lines, place, some, outside=True).unionByName(sieved(lines, place, some).join(gone, ["lesson_id", *order], "left_anti"))


def paragraph_join(lines: DataFrame, order: tuple[str, ...] = ORDER, by: str = "\n") -> DataFrame:
    """lesson_id, paragraph: a lesson's lines in order, as one text (the form that the paragraph comparison needs)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy("lesson_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), by).alias("paragraph"))


def _spoken(segments: DataFrame) -> DataFrame:
    return segments.withColumn("line", T.trimmed(F.coalesce("text", F.lit("")))).filter("line <> ''")


def paragraph_chunks(lines: DataFrame, size: int = 1_000_000, order: tuple[str, ...] = ORDER, by: str = "\n") -> DataFrame:
    """lesson_id, chunk_no, text: what ``paragraph_join`` gives, in rows of ``size`` characters, for lessons of any length."""
    return joined_chunks(lines, order, by, size)


def transcript_chunks(segments: DataFrame, size: int = 1_000_000) -> DataFrame:
    """lesson_id, chunk_no, text: what ``transcript_join`` gives, in rows of ``size`` characters."""
    return joined_chunks(_spoken(segments), ("start_sec", "seg_no"), " ", size)


def transcript_join(segments: DataFrame) -> DataFrame:
    """lesson_id, transcript: the non-blank texts of a lesson's segments (lesson_id, start_sec, seg_no, text) in order."""
    joined = paragraph_join(_spoken(segments), ("start_sec", "seg_no"), " ")
    return joined.select("lesson_id", T.trimmed(F.col("paragraph")).alias("transcript"))


def merged_or_best(merged: DataFrame, best: DataFrame, mode: str = "merged") -> DataFrame:
    """Lines of the lessons by mode: merged ones, or those of the best frame, the other where a lesson has none."""
    if mode not in ("merged", "best", "best_clarity", "single", "single_frame"):
        raise ValueError(f"unknown mode {mode!r}")
    first, second = (merged, best) if mode == "merged" else (best, merged)
    return first.unionByName(second.join(first.select("lesson_id").distinct(), "lesson_id", "left_anti"))


def kept_index_join(lines: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped lines, given the kept (lesson_id, line_index)."""
    kept = kept.select("lesson_id", "line_index").distinct()
    return lines.join(kept, ["lesson_id", "line_index"], "left_semi"), lines.join(kept, ["lesson_id", "line_index"], "left_anti")


def dropped_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    return kept_index_join(lines, kept)[1]


def refine_kept_lines(lines: DataFrame, p: LineParams | None = None) -> DataFrame:
    p = p or LineParams()
    return lines.withColumn("line", F.explode(T.refined_lines(F.col("line"), p.ascii_only, p.drop_singletons)))
