"""Queries over board lines and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.functions import text as X
from lecturelake.functions.numeric import alignment_verdict, cosine_similarity
from lecturelake.operators import alignment, answers, assemble, lines, models
from lecturelake.operators.ordered import numbered_in_blocks
from lecturelake.params import AlignmentParams, LineParams
from lecturelake.plans.bindings import BOARDS, LINES, SPEECH, UNION, Tables, indexed_lines, key_sql, speech, trim_sql
from lecturelake.plans.bindings import lines as board_lines
from lecturelake.plans.registry import query
from lecturelake.storage import written

PLACE = ("lesson_id", "frame_index", "line_no")


def merged(t: Tables) -> DataFrame:
    return lines.line_union(board_lines(t))


@query("casefold_key", f"WITH {LINES} SELECT lesson_id, frame_index, line_no, {key_sql('line')} AS key FROM lines")
def casefold_key(t):
    return board_lines(t).select(*PLACE, X.casefold_key(F.col("line")).alias("key"))


@query("line_union", f"WITH {UNION} SELECT lesson_id, frame_index, line_no, line FROM merged")
def line_union(t):
    return merged(t).select(*PLACE, "line")


DEDUPED = f"""{UNION}, deduped AS (SELECT * FROM merged a WHERE NOT (length(a.key) >= 8 AND EXISTS (SELECT 1 FROM merged b
  WHERE b.lesson_id = a.lesson_id AND length(b.key) >= 8 AND length(b.key) > length(a.key) AND contains(b.key, a.key))))"""


@query("substring_dedupe", f"WITH {DEDUPED} SELECT lesson_id, frame_index, line_no, line FROM deduped")
def substring_dedupe(t):
    return lines.substring_dedupe(merged(t).select(*PLACE, "line"))


@query("noise_line_filter", rf"WITH {UNION} SELECT lesson_id, frame_index, line_no, line FROM merged WHERE length(line) >= 14 AND len(regexp_extract_all(line, '\p{{L}}')) >= 5")
def noise_line_filter(t):
    return lines.noise_line_filter(merged(t)).select(*PLACE, "line")


@query("noise_line_filter_math", rf"WITH {UNION} SELECT lesson_id, frame_index, line_no, line FROM merged WHERE length(line) >= 4 AND len(regexp_extract_all(line, '[\p{{L}}=+\-*/×÷^()\[\]{{}}<>∫∑√πΔ·.,:;%]')) >= 2")
def noise_line_filter_math(t):
    return lines.noise_line_filter_math(merged(t), LineParams(min_chars=4, min_letters=2)).select(*PLACE, "line")


@query(
    "text_low_value",
    rf"""WITH {LINES}, c AS (SELECT *, {trim_sql('line')} AS x FROM lines), n AS (SELECT *, len(regexp_extract_all(x, '\p{{L}}')) AS l, len(regexp_extract_all(x, '\p{{Nd}}')) AS d, len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]')) AS a FROM c)
SELECT lesson_id, frame_index, line_no, CASE WHEN x = '' THEN true WHEN l >= 8 THEN false WHEN a = 0 THEN true ELSE d >= l AND a <= 12 END AS low FROM n""",
)
def text_low_value(t):
    return board_lines(t).select(*PLACE, X.low_value(F.col("line")).alias("low"))


@query("useful_char_count", rf"WITH {LINES} SELECT lesson_id, frame_index, line_no, CAST(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]')) AS BIGINT) AS useful FROM lines")
def useful_char_count(t):
    return board_lines(t).select(*PLACE, X.useful_char_count(F.col("line")).cast("long").alias("useful"))


@query("paragraph_join", f"WITH {UNION}, {BOARDS} SELECT * FROM boards")
def paragraph_join(t):
    return lines.paragraph_join(merged(t))


@query("transcript_join", f"WITH {SPEECH} SELECT * FROM transcripts")
def transcript_join(t):
    return lines.transcript_join(speech(t))


CHUNK = 5000


def chunks_sql(table: str, text: str) -> str:
    return f"SELECT lesson_id, u.k AS chunk_no, length(substr({text}, u.k * {CHUNK} + 1, {CHUNK})) AS chars, md5(substr({text}, u.k * {CHUNK} + 1, {CHUNK})) AS digest FROM {table}, unnest(range(0, greatest(1, (length({text}) + {CHUNK} - 1) // {CHUNK}))) AS u(k)"


def chunk_digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("lesson_id", "chunk_no", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("paragraph_chunks", f"WITH {UNION}, {BOARDS} {chunks_sql('boards', 'paragraph')}")
def paragraph_chunks(t):
    return chunk_digests(lines.paragraph_chunks(merged(t), CHUNK))


@query("transcript_chunks", f"WITH {SPEECH} {chunks_sql('transcripts', 'transcript')}")
def transcript_chunks(t):
    return chunk_digests(lines.transcript_chunks(speech(t), CHUNK))


@query("rank_within_lesson", f"WITH {UNION} SELECT lesson_id, frame_index, line_no, row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index, line_no) - 1 AS ordinal FROM merged")
def rank_within_lesson(t):
    return lines.rank_within_lesson(merged(t)).select(*PLACE, F.col("ordinal").cast("long").alias("ordinal"))


PAIRS = f"{UNION}, {BOARDS}, {SPEECH}, pairs AS (SELECT lesson_id, paragraph AS board, transcript AS speech FROM boards JOIN transcripts USING (lesson_id))"


def pairs(t: Tables) -> DataFrame:
    return alignment.board_speech_pair(lines.paragraph_join(merged(t)), lines.transcript_join(speech(t)))


@query("board_speech_pair", f"WITH {PAIRS} SELECT lesson_id, length(board) AS board_chars, length(speech) AS speech_chars, md5(board) AS board_md5, md5(speech) AS speech_md5 FROM pairs")
def board_speech_pair(t):
    return pairs(t).select("lesson_id", F.length("board").cast("long").alias("board_chars"), F.length("speech").cast("long").alias("speech_chars"), F.md5("board").alias("board_md5"), F.md5("speech").alias("speech_md5"))


def tokens_sql(x: str) -> str:
    return rf"list_distinct(list_concat(list_concat(regexp_extract_all(lower({x}), '[a-z]+'), regexp_extract_all(lower({x}), '[\x{{4e00}}-\x{{9fff}}]')), regexp_extract_all(lower({x}), '\p{{Nd}}+')))"


@query("tokenize_mixed", f"WITH {PAIRS} SELECT lesson_id, unnest({tokens_sql('board')}) AS token FROM pairs")
def tokenize_mixed(t):
    board = merged(t)
    spoken = speech(t).filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("lesson_id").distinct()
    return alignment.line_tokens(board.join(spoken, "lesson_id", "left_semi"), "line")


SETS = f"""{PAIRS}, sets AS (SELECT lesson_id, {tokens_sql('board')} AS a, {tokens_sql('speech')} AS b FROM pairs),
 shares AS (SELECT lesson_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS joined FROM sets),
 rates AS (SELECT *, CASE WHEN joined = 0 THEN 1.0 ELSE shared / joined END AS overlap FROM shares)"""


@query("token_set_ops", f"WITH {SETS} SELECT lesson_id, CAST(shared AS BIGINT) AS shared, CAST(joined AS BIGINT) AS joined FROM rates")
def token_set_ops(t):
    return overlaps(t).select("lesson_id", "shared", "joined")


def overlaps(t: Tables, board: DataFrame | None = None) -> DataFrame:
    return alignment.line_overlap(merged(t) if board is None else board, speech(t))


@query("keyword_overlap", f"WITH {SETS} SELECT lesson_id, round(overlap, 6) AS overlap FROM rates")
def keyword_overlap(t):
    return overlaps(t).select("lesson_id", F.round("overlap", 6).alias("overlap"))


# the vectors of a lesson src<n>: the means of those with ids n modulo 20, by turns one for the board and 20 for speech
COSINE = """parts AS (SELECT 'src' || (vec_id % 20) AS lesson_id, (vec_id // 20) % 2 AS side, u.i AS i, avg(CAST(u.v AS DOUBLE)) AS m FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, i) GROUP BY ALL),
 vectors AS (SELECT lesson_id, list(m ORDER BY i) FILTER (side = 0) AS x, list(m ORDER BY i) FILTER (side = 1) AS y FROM parts GROUP BY lesson_id),
 dots AS (SELECT lesson_id, list_sum(list_transform(list_zip(x, y), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS xy,
  list_sum(list_transform(x, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))) AS xx, list_sum(list_transform(y, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))) AS yy FROM vectors),
 cosines AS (SELECT lesson_id, greatest(0.0, least(1.0, xy / (sqrt(xx) * sqrt(yy) + 1e-8))) AS similarity FROM dots)"""
VERDICT = AlignmentParams(high_sim=0.1, partial_sim=0.08, keyword_high=0.07, keyword_partial=0.085)
VERDICT_SQL = "CASE WHEN similarity >= 0.1 AND overlap >= 0.07 THEN 'highly_aligned' WHEN similarity >= 0.08 OR overlap >= 0.085 THEN 'partially_related' ELSE 'content_mismatch' END"


def vectors(t: Tables) -> DataFrame:
    """Mean vectors of a lesson's sides, over all embeddings."""
    v = t.embeddings.select(F.concat(F.lit("src"), F.col("vec_id") % 20).alias("lesson_id"), (F.floor(F.col("vec_id") / 20) % 2).alias("side"), F.posexplode("embedding").alias("i", "v"))
    means = v.groupBy("lesson_id", "side", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    side = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("i", "m")))), lambda x: x["m"])
    return means.groupBy("lesson_id").agg(side(0).alias("board_vector"), side(1).alias("speech_vector"))


@query("cosine_similarity", """WITH v AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 d AS (SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS xy, list_sum(list_transform(x, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))) AS xx,
  list_sum(list_transform(y, lambda p: CAST(p AS DOUBLE) * CAST(p AS DOUBLE))) AS yy FROM v)
SELECT vec_id, round(greatest(0.0, least(1.0, xy / (sqrt(xx) * sqrt(yy) + 1e-8))), 4) AS similarity FROM d""")
def cosine(t):
    v = t.embeddings
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return v.join(after, "vec_id").select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("y")), 4).alias("similarity"))


@query("compare_board_speech", f"WITH {SETS}, {COSINE} SELECT lesson_id, round(similarity, 4) AS similarity, round(overlap, 4) AS overlap, {VERDICT_SQL} AS verdict FROM rates JOIN cosines USING (lesson_id)")
def compare_board_speech(t):
    return alignment.compare_board_speech(overlaps(t), vectors(t), VERDICT)


@query("alignment_verdict", "SELECT l_returnflag, l_linestatus, v AS verdict, count(*) AS n FROM (SELECT *, CASE WHEN l_discount * 10 >= 0.72 AND l_tax * 10 >= 0.35 THEN 'highly_aligned' WHEN l_discount * 10 >= 0.45 OR l_tax * 10 >= 0.2 THEN 'partially_related' ELSE 'content_mismatch' END AS v FROM lineitem) GROUP BY ALL")
def verdicts(t):
    v = alignment_verdict(F.col("l_discount") * 10, F.col("l_tax") * 10)
    return t.lineitem.select("l_returnflag", "l_linestatus", v.alias("verdict")).groupBy("l_returnflag", "l_linestatus", "verdict").agg(F.count("*").alias("n"))


SQUEEZE = r"regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g')"


def squeeze_sql(x: str) -> str:
    return trim_sql(SQUEEZE.format(x))


def ascii_sql(x: str) -> str:
    return squeeze_sql(rf"regexp_replace({x}, '[^\x00-\x7F]', ' ', 'g')")


def singles_sql(x: str) -> str:
    return rf"array_to_string(list_filter(string_split({squeeze_sql(x)}, ' '), lambda w: NOT (length(regexp_replace(w, '[^A-Za-z]', '', 'g')) = 1 AND regexp_replace(w, '[^A-Za-z]', '', 'g') NOT IN ('a', 'I') AND NOT regexp_matches(w, '[0-9]')) AND NOT (NOT regexp_matches(w, '[A-Za-z0-9]') AND length(w) <= 1)), ' ')"


@query("ascii_only", f"WITH {UNION} SELECT lesson_id, frame_index, line_no, {ascii_sql('line')} AS line FROM merged")
def ascii_only(t):
    return merged(t).select(*PLACE, X.ascii_only(F.col("line")).alias("line"))


@query("drop_singleton_tokens", f"WITH {UNION} SELECT lesson_id, frame_index, line_no, {singles_sql('line')} AS line FROM merged")
def drop_singletons(t):
    return merged(t).select(*PLACE, X.drop_singleton_tokens(F.col("line")).alias("line"))


@query("refine_kept_lines", f"WITH {UNION}, r AS (SELECT lesson_id, frame_index, line_no, {squeeze_sql(singles_sql(ascii_sql('line')))} AS line FROM merged) SELECT * FROM r WHERE line <> ''")
def refine_kept_lines(t):
    return lines.refine_kept_lines(merged(t)).select(*PLACE, "line")


@query("latin1_safe", rf"WITH {LINES} SELECT lesson_id, frame_index, line_no, regexp_replace(line, '[^\x{{0}}-\x{{FF}}]', '?', 'g') AS line FROM lines")
def latin1_safe(t):
    return board_lines(t).select(*PLACE, X.latin1_safe(F.col("line")).alias("line"))


@query("text_chunks", "SELECT doc_id, u.i - 1 AS chunk_no, substr(text, CAST((u.i - 1) * 90 + 1 AS BIGINT), 90) AS chunk FROM documents, unnest(range(1, CAST(ceil(length(text) / 90.0) AS BIGINT) + 1)) AS u(i)")
def text_chunks(t):
    return t.documents.select("doc_id", F.posexplode(X.text_chunks(F.col("text"))).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


NUMBERED = "numbered AS (SELECT frame_index AS doc_id, string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY frame_index)"


@query("number_lines", f"WITH {LINES}, {NUMBERED} SELECT * FROM numbered")
def number_lines(t):
    return t.documents.select("doc_id", X.number_lines(F.split("text", "\n")).alias("body"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def side_sql(x: str) -> str:
    return f"CASE WHEN {trim_sql(f'coalesce({x}, {_sql_text(str())})')} = '' THEN '[EMPTY]' ELSE {trim_sql(x)} END"


@query("build_alignment_prompt", f"WITH {PAIRS} SELECT lesson_id, {_sql_text(X.ALIGNMENT_RULES)} AS system, 'board_text:' || chr(10) || {side_sql('board')} || chr(10) || chr(10) || 'speech_text:' || chr(10) || {side_sql('speech')} AS user FROM pairs")
def alignment_prompts(t):
    m = answers.build_alignment_prompt(pairs(t))
    return m.select("lesson_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


@query(
    "build_line_filter_prompt",
    f"""WITH {LINES}, {NUMBERED}, first AS (SELECT frame_index AS doc_id, string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no) AS body FROM lines WHERE line_no < 120 GROUP BY frame_index)
SELECT doc_id AS lesson_id, {_sql_text(X.LINE_FILTER_RULES)} AS system, 'speech_text:' || chr(10) || '[EMPTY]' || chr(10) || chr(10) || 'lines:' || chr(10) || body AS user FROM first""",
)
def line_filter_prompts(t):
    m = answers.build_line_filter_prompt(t.documents.select(F.col("doc_id").alias("lesson_id"), F.split("text", "\n").alias("lines"), F.lit(None).cast("string").alias("speech")))
    return m.select("lesson_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user"))


# lines of documents of quality 1 stand for kept lines: a lesson is a source, its lines are numbered over all of its documents
def kept_ids(t: Tables) -> DataFrame:
    good = t.labels.filter("quality = 1").select(F.col("doc_id").alias("frame_index"))
    return indexed_lines(t).join(good, "frame_index").select("lesson_id", "line_index")


def document_lines(t: Tables) -> DataFrame:
    return indexed_lines(t).select("lesson_id", "line_index", "line")


KEPT = f"{LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY frame_index, line_no) - 1 AS line_index FROM lines), doc_lines AS (SELECT lesson_id, line_index, line FROM numbered), kept AS (SELECT DISTINCT lesson_id, line_index FROM numbered JOIN labels ON doc_id = frame_index WHERE quality = 1)"


@query("kept_index_join", f"WITH {KEPT} SELECT doc_lines.* FROM doc_lines JOIN kept USING (lesson_id, line_index)")
def kept_index_join(t):
    return lines.kept_index_join(document_lines(t), kept_ids(t))[0]


@query("dropped_lines", f"WITH {KEPT} SELECT * FROM doc_lines WHERE (lesson_id, line_index) NOT IN (SELECT (lesson_id, line_index) FROM kept)")
def dropped_lines(t):
    return lines.dropped_lines(document_lines(t), kept_ids(t))


#: Lines of a lesson that the filter is asked about.
SENT = 120


def filter_answers(t: Tables) -> DataFrame:
    """An answer a source: an array of the kept ids that were sent, but none for src1, an empty one for src2, no array for src3, and nonsense for src4."""
    ids = kept_ids(t).filter(F.col("line_index") < SENT).groupBy("lesson_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("line_index")), lambda i: i.cast("string")), ",").alias("ids"))
    said = F.when(F.col("lesson_id") == "src3", '{"kept_indices": "all"}').when(F.col("lesson_id") == "src4", '{"kept_indices": [-1, null, "x"]}').when(F.col("lesson_id") == "src2", '{"kept_indices": []}')
    return ids.filter("lesson_id <> 'src1'").select("lesson_id", F.coalesce(said, F.concat(F.lit('{"kept_indices": ['), "ids", F.lit("]}"))).alias("answer"))


@query(
    "apply_kept_indices",
    f"""WITH {KEPT}, r AS (SELECT lesson_id, line_index, {squeeze_sql(singles_sql(ascii_sql('line')))} AS line,
 CASE lesson_id WHEN 'src3' THEN 'kept_indices is not an array' WHEN 'src4' THEN 'no valid index' END AS error FROM doc_lines
 WHERE line_index >= 120 OR lesson_id IN ('src1', 'src3', 'src4') OR (lesson_id <> 'src2' AND (lesson_id, line_index) IN (SELECT (lesson_id, line_index) FROM kept)))
SELECT * FROM r WHERE line <> ''""",
)
def apply_kept_indices(t):
    return answers.apply_kept_indices(document_lines(t), filter_answers(t), LineParams(filter_max_lines=SENT))


@query("llm_fallback", f"WITH {KEPT}, f AS (SELECT doc_lines.* FROM doc_lines JOIN kept USING (lesson_id, line_index) WHERE lesson_id NOT IN ('src5', 'src6')) SELECT * FROM f UNION ALL SELECT * FROM doc_lines WHERE lesson_id IN ('src5', 'src6')")
def llm_fallback(t):
    filtered = lines.kept_index_join(document_lines(t), kept_ids(t))[0].filter("lesson_id not in ('src5', 'src6')")
    return answers.llm_fallback(filtered, document_lines(t))


@query("merged_or_best", f"WITH {UNION}, m AS (SELECT lesson_id, frame_index, line_no, line FROM merged WHERE lesson_id <> 'src7') SELECT * FROM m UNION ALL SELECT lesson_id, frame_index, line_no, line FROM lines WHERE lesson_id = 'src7'")
def merged_or_best(t):
    return lines.merged_or_best(merged(t).filter("lesson_id <> 'src7'").select(*PLACE, "line"), board_lines(t).select(*PLACE, "line"))


WORDS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(
    "paragraph_perplexity",
    f"""WITH c AS (SELECT {WORDS_SQL.format('text')} AS w FROM benchmark), cp AS (SELECT CASE WHEN u.i = 1 THEN '' ELSE w[u.i - 1] END AS before, w[u.i] AS word FROM c, unnest(range(1, len(w) + 1)) AS u(i)),
 pc AS (SELECT before, word, count(*) AS n FROM cp GROUP BY ALL), bc AS (SELECT before, count(*) AS n FROM cp GROUP BY ALL), v AS (SELECT count(DISTINCT word) AS v FROM cp),
 d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents), dp AS (SELECT doc_id, CASE WHEN u.i = 1 THEN '' ELSE w[u.i - 1] END AS before, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
 s AS (SELECT doc_id, exp(avg(-ln((coalesce(pc.n, 0) + 1) / (coalesce(bc.n, 0) + v.v)))) AS p FROM dp LEFT JOIN pc USING (before, word) LEFT JOIN bc USING (before), v GROUP BY doc_id)
SELECT doc_id, round(p, 4) AS perplexity FROM s""",
)
def paragraph_perplexity(t):
    texts = t.documents.select("doc_id", "text")
    scored = models.paragraph_perplexity(texts, t.benchmark.select("item_id", "text"), "doc_id")
    return scored.filter("perplexity < double('inf')").select("doc_id", F.round("perplexity", 4).alias("perplexity"))


def report_lessons(t: Tables, board: DataFrame | None = None) -> DataFrame:
    """A lesson a source: its verdict, and made-up clarity and errors for some. ``board``: its merged lines, if they are known."""
    verdict = alignment.compare_board_speech(overlaps(t, board), vectors(t), VERDICT).select("lesson_id", "verdict").filter("lesson_id <> 'src3'")
    base = t.documents.select(F.col("source").alias("lesson_id")).distinct()
    odd = F.col("lesson_id").isin("src1", "src2")
    sides = base.select("lesson_id", F.when(~odd, "fair").alias("clarity"), F.lit("50").alias("score"), F.lit("Write larger.").alias("suggestion"), F.lit("81").alias("laplacian_variance"), F.lit("2").alias("stroke_width_variance"), F.lit("0.5").alias("similarity"), F.lit("0.25").alias("overlap"), F.when(odd, F.create_map(F.lit("module_c"), F.lit("no audio"))).alias("errors"))
    return assemble.lesson_assemble(base, verdict, sides)


def report_board(board: DataFrame) -> DataFrame:
    """lesson_id, ordinal, line: the deduplicated of the merged lines (a written table), as far as a report row shows them."""
    shown = lines.without_subsumed(board).withColumn("line", F.left("line", F.lit(assemble.LINE_WIDTH)))
    return numbered_in_blocks(shown, F.floor(F.col("frame_index") / 1000), lines.ORDER).select("lesson_id", "ordinal", "line")


def report_speech(t: Tables) -> DataFrame:
    """lesson_id, ordinal, text: a lesson's transcript in pieces of a report row."""
    return lines.transcript_chunks(speech(t), 90).withColumnRenamed("chunk_no", "ordinal")


def _report_sql() -> str:
    safe = lambda x: rf"substr(regexp_replace({x}, '[^\x{{0}}-\x{{FF}}]', '?', 'g'), 1, 120)"
    head = lambda n, x, gap=8, where="": f"SELECT lesson_id, {n} AS part, 0 AS sub, 0 AS sub2, 0 AS indent, {gap} AS gap, {_sql_text(x)} AS text FROM base {where}"
    row = lambda n, sub, x, where="": f"SELECT lesson_id, {n}, {sub}, 0, 10, 0, {safe(x)} FROM base {where}"
    fair, odd = "WHERE lesson_id NOT IN ('src1', 'src2')", "WHERE lesson_id IN ('src1', 'src2')"
    parts = [
        head(0, "Classroom blackboard analytics - teaching feedback report", 0),
        head(1, "1. Board OCR"),
        f"SELECT lesson_id, 2, frame_index, line_no, 10, 0, {safe(chr(39) + '- ' + chr(39) + ' || line')} FROM deduped",
        row(2, 0, "'(no text recognized)'", "WHERE lesson_id NOT IN (SELECT lesson_id FROM deduped)"),
        head(3, "2. Handwriting clarity"),
        row(4, 0, "'Level: fair  Score: 50'", fair),
        row(4, 1, "'Suggestion: Write larger.'", fair),
        row(4, 2, "'Laplacian variance: 81  Stroke width variance (across components): 2'", fair),
        head(5, "3. Speech summary (Whisper)"),
        f"SELECT lesson_id, 6, u.i, 0, 10, 0, {safe('substr(s, CAST((u.i - 1) * 90 + 1 AS BIGINT), 90)')} FROM said, unnest(range(1, CAST(ceil(length(s) / 90.0) AS BIGINT) + 1)) AS u(i)",
        head(7, "4. Board vs speech alignment"),
        row(8, 0, "'Semantic similarity: 0.5'", "WHERE lesson_id IN (SELECT lesson_id FROM judged)"),
        row(8, 1, "'Keyword overlap (Jaccard): 0.25'", "WHERE lesson_id IN (SELECT lesson_id FROM judged)"),
        f"SELECT lesson_id, 8, 2, 0, 10, 0, 'Verdict: ' || verdict FROM judged",
        row(8, 0, "'(skipped or unavailable)'", "WHERE lesson_id NOT IN (SELECT lesson_id FROM judged)"),
        head(9, "5. Steps that reported an error", 8, odd),
        row(9, 1, "'module_c: no audio'", odd),
    ]
    return f"""WITH RECURSIVE {DEDUPED}, {BOARDS}, {SPEECH}, pairs AS (SELECT lesson_id, paragraph AS board, transcript AS speech FROM boards JOIN transcripts USING (lesson_id)),
{SETS.split('FROM boards JOIN transcripts USING (lesson_id)),', 1)[-1].strip()}, {COSINE},
base AS (SELECT DISTINCT source AS lesson_id FROM documents), judged AS (SELECT lesson_id, {VERDICT_SQL} AS verdict FROM rates JOIN cosines USING (lesson_id) WHERE lesson_id <> 'src3'),
said AS (SELECT lesson_id, coalesce(transcript, '(missing or transcription failed)') AS s FROM base LEFT JOIN transcripts USING (lesson_id)),
body AS ({' UNION ALL '.join(parts)}), placed AS (SELECT lesson_id, row_number() OVER (PARTITION BY lesson_id ORDER BY part, sub, sub2) - 1 AS row_no, indent, gap, text FROM body),
walk AS (SELECT lesson_id, row_no, 1 AS page, 791.89::DOUBLE AS y, indent, text FROM placed WHERE row_no = 0
 UNION ALL SELECT p.lesson_id, p.row_no, CASE WHEN w.y - 16 - p.gap < 60 THEN w.page + 1 ELSE w.page END, CASE WHEN w.y - 16 - p.gap < 60 THEN 791.89 ELSE w.y - 16 - p.gap END, p.indent, p.text
 FROM walk w JOIN placed p ON p.lesson_id = w.lesson_id AND p.row_no = w.row_no + 1)
SELECT lesson_id, row_no, CAST(page AS BIGINT) AS page, round(y, 2) AS y, CAST(indent AS BIGINT) AS indent, text FROM walk"""


@query("report_lines", _report_sql())
def report_lines(t):
    board = written(lines.sieved_line_union(board_lines(t)).select(*PLACE, "line"), "board-lines")  # for the rows and for the verdict
    return assemble.report_lines(report_lessons(t, board), written(report_board(board), "report-board"), written(report_speech(t), "report-speech"))
