"""Text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that count as mathematics in a board line.
MATH_SYMBOLS = "=+-*/×÷^()[]{}<>∫∑√πΔ·.,:;%"


#: Fixed value: the characters that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Text without white space (of any script) at its ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def casefold_key(text: Column) -> Column:
    """Key under which lines that differ in case or outer space are one; ß folds to ss, which lower() leaves."""
    return F.lower(F.replace(trimmed(text), F.lit("ß"), F.lit("ss")))


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def useful_char_count(text: Column) -> Column:
    """Letters and numbers of any script."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def math_or_letter_count(text: Column) -> Column:
    quoted = "".join("\\" + c if c in r"[]^-\&" else c for c in MATH_SYMBOLS)
    return F.regexp_count(text, F.lit(r"[\p{L}" + quoted + "]"))


def low_value(text: Column) -> Column:
    """Whether the joined text of some lines tells nothing: no letters to speak of, and few or no numbers."""
    joined = F.coalesce(trimmed(text), F.lit(""))
    alnum = useful_char_count(joined)
    return (
        F.when(joined == "", True)
        .when(letter_count(joined) >= 8, False)
        .when(alnum == 0, True)
        .otherwise((digit_count(joined) >= letter_count(joined)) & (alnum <= 12))
    )


def tokenize_mixed(text: Column) -> Column:
    """Distinct lower-case Latin words, single CJK characters and digit runs."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in (r"[a-z]+", r"[\x{4e00}-\x{9fff}]", r"\p{Nd}+")]
    return F.array_distinct(F.concat(*found))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def keyword_overlap(a: Column, b: Column) -> Column:
    return jaccard(tokenize_mixed(a), tokenize_mixed(b))


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def ascii_only(text: Column) -> Column:
    """Characters beyond ASCII become spaces, and spaces are squeezed."""
    return squeezed(F.regexp_replace(text, r"[^\x{0}-\x{7F}]", " "))


#: A token of squeezed text with one Latin letter (but a and I) and no digit, or of one character that is neither, with the space before it.
_SINGLETON = r"(?: |^)(?:[^A-Za-z0-9 ]*+[A-HJ-Zb-z][^A-Za-z0-9 ]*+|[^A-Za-z0-9 ])(?![^ ])"


def _without_singletons(squeezed_text: Column) -> Column:
    return F.ltrim(F.regexp_replace(squeezed_text, _SINGLETON, ""))


def drop_singleton_tokens(text: Column) -> Column:
    """Drops tokens with one Latin letter (but a and I) and no digit, and one-character tokens with neither."""
    return _without_singletons(squeezed(text))


def refined_line(text: Column, ascii: bool = True, singletons: bool = True) -> Column:
    """A pass for each rule over the text, and none over its tokens; what a pass leaves is squeezed already."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", " "), r"[\x09-\x0D ]{2,}|[\x09-\x0D]", " ")
    out = F.trim(plain) if ascii else squeezed(text)
    return _without_singletons(out) if singletons else out


def refined_lines(text: Column, ascii: bool = True, singletons: bool = True) -> Column:
    """An array of the refined line, or of nothing where it is blank. Exploded, it is computed once; a filter on the line would compute it a second time, and before any join."""
    return F.filter(F.array(refined_line(text, ascii, singletons)), lambda x: x != "")


def latin1_safe(text: Column) -> Column:
    """Characters beyond Latin-1 become question marks."""
    return F.regexp_replace(text, r"[^\x{0}-\x{FF}]", "?")


def text_chunks(text: Column, width: int = 90) -> Column:
    """The text in pieces of ``width`` characters; none for an empty text."""
    n = F.ceil(F.length(text) / width).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def number_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)), "\n")


EMPTY_SIDE = "[EMPTY]"
ALIGNMENT_RULES = (
    "Judge how well a teacher's speech keeps to what is on the board. Answer with one JSON object and nothing else: "
    '"overall_relevance" (highly_relevant, partially_relevant, weakly_relevant or off_topic), "score" (0 to 100), "reason", "evidence" (2 to 5 short strings). '
    "Where a side is empty or short, stay cautious and invent nothing."
)
LINE_FILTER_RULES = (
    "Pick the lines of recognised board text that belong to the lesson; drop interface text, watermarks, fragments and garbage, and keep a line when in doubt. "
    'Answer with one JSON object and nothing else: "kept_indices" (ascending, 0-based, from the numbered list only) and "reason" (one sentence).'
)


def _side(name: str, text: Column) -> Column:
    body = trimmed(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(f"{name}:\n"), F.when(body == "", EMPTY_SIDE).otherwise(body))


def _messages(rules: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(rules).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def alignment_prompt(board: Column, speech: Column, rules: str = ALIGNMENT_RULES) -> Column:
    return _messages(rules, F.concat(_side("board_text", board), F.lit("\n\n"), _side("speech_text", speech)))


def line_filter_prompt(lines: Column, speech: Column, rules: str = LINE_FILTER_RULES) -> Column:
    return _messages(rules, F.concat(_side("speech_text", speech), F.lit("\n\nlines:\n"), number_lines(lines)))
