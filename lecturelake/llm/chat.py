"""Chat formatting: roles of transcript lines recovered by a hidden Markov model, then rendered as turns.

States are roles; a line's symbol joins its speaker marker ("User:", "A:", ...), whether it opens a block
of text (the first line of a text or one with a marker), and features of the line itself (length, question mark, list or code start). Emissions and the two
transition tables (into a line that opens a block, into one that goes on) are counted on labelled
conversations in Spark and smoothed. The best role sequence of a conversation is found by Viterbi.

A conversation of any length is decoded in parallel. Blocks of text are range-partitioned in order and
packed into pieces of bounded size; each piece is summed up by a small (max, +) matrix; only conversations
of several pieces send these matrices through a group, which fixes the roles at the seams; every piece is
then decoded between its seams.

Defined results: a null text is one empty line; a null role is learned from as none; rows that repeat stay,
in any order among themselves; null conv_ids form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import materialize, read_table, table_columns

# Speaker markers at the start of a line, by role.
MARKERS = {"user": "user|human|question|q", "assistant": "assistant|bot|ai|answer|a", "system": "system|instruction|instructions"}
_MARKER = re.compile(r"\s*[\[<*#]*\s*(?:" + "|".join(f"(?P<{r}>{m})" for r, m in MARKERS.items()) + r")\s*[\]>*]*\s*[:>]\s*", re.IGNORECASE)
_LIST = re.compile(r"\s*(?:[-*•]|\d+[.)])\s|\s*```")


@dataclass(frozen=True)
class ChatParams:
    roles: tuple[str, ...] = ("user", "assistant", "system")
    smoothing: float = 0.5
    piece_turns: int = 256
    piece_chars: int = 500_000


def symbol(line: str, opens: bool) -> str:
    """What the model sees of a line."""
    m = _MARKER.match(line)
    marker = m.lastgroup if m and m.end() else "-"
    size = min(6, len(line.split()).bit_length())
    return f"{marker}|{int(opens)}|{size}|{int(line.rstrip().endswith('?'))}|{int(bool(_LIST.match(line)))}"


def marked(line: str) -> str | None:
    """The role that a line's speaker marker states, if it has one."""
    m = _MARKER.match(line)
    return m.lastgroup if m else None


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass(frozen=True)
class RoleModel:
    roles: tuple[str, ...]
    start: np.ndarray
    step: np.ndarray
    """[opens][from][to] log probabilities."""
    emit: dict[str, np.ndarray]
    other: np.ndarray

    def emission(self, seen: str) -> np.ndarray:
        marker = seen.split("|")[0]
        if marker in self.roles:  # a marker states its role
            return np.where(np.array(self.roles) == marker, 0.0, math.log(1e-6))
        return self.emit.get(seen, self.other)

    def weights(self, texts: list[str | None], first: bool) -> list[np.ndarray]:
        """For each line a matrix [from][to] of step and emission; the first line of a conversation steps from anything by the start."""
        out = []
        for n, text in enumerate(texts):
            for k, line in enumerate(_lines(text)):
                opens = k == 0 or marked(line) is not None  # a marker opens a block wherever it stands
                e = self.emission(symbol(line, opens))
                if first and not out:
                    out.append(np.tile(self.start + e, (len(self.roles), 1)))
                else:
                    out.append(self.step[int(opens)] + e[None, :])
        return out


def fit(conversations: DataFrame, params: ChatParams) -> RoleModel:
    """Counts symbols and role changes in labelled turns; what reaches the driver is a count for each role and symbol."""
    rows = table_columns(conversations, "conv_id", "turn", "role", "text").filter(F.col("role").isin(*params.roles))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for role, text in zip(b.role, b.text, strict=True):
                for k, line in enumerate(_lines(text)):
                    key = (role, symbol(line, k == 0))
                    seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["role", "symbol", "n"])

    emitted = rows.select("role", "text").mapInPandas(count, "role string, symbol string, n long").groupBy("role", "symbol").agg(F.sum("n").alias("n")).collect()
    # role changes: a turn joined with the next one by number, so that no conversation has to be sorted in one task
    before = rows.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    after = before.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    changes = before.join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect()
    starts = before.filter("turn = 0").groupBy("role").count().collect()
    n, a = len(params.roles), params.smoothing
    at = {r: i for i, r in enumerate(params.roles)}
    start, opening = np.full(n, a), np.full((n, n), a)
    for r in starts:
        start[at[r["role"]]] += r["count"]
    for r in changes:
        opening[at[r["role"]], at[r["next"]]] += r["count"]
    symbols = sorted({r["symbol"] for r in emitted})
    table = {s: np.full(n, a) for s in symbols}
    for r in emitted:
        table[r["symbol"]][at[r["role"]]] += r["n"]
    totals = sum(table.values(), np.full(n, a))
    going_on = np.full((n, n), math.log(1e-9))
    np.fill_diagonal(going_on, 0.0)  # a role doesn't change inside a block of text
    step = np.stack([going_on, np.log(opening / opening.sum(1, keepdims=True))])
    emit = {s: np.log(v / totals) for s, v in table.items()}
    return RoleModel(params.roles, np.log(start / start.sum()), step, emit, np.log(a / totals))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def pack(conversations: DataFrame, params: ChatParams) -> DataFrame:
    """Pieces of conversations in order: conv_id, part, piece, first, last, turns, texts."""
    rows = table_columns(conversations, "conv_id", "turn", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    spark = conversations.sparkSession
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "row").sortWithinPartitions("conv_id", "turn", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def piece(rows: list[tuple], number: int) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([rows[0][0]], pa.int64()), pa.array([number], pa.int64()), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([[r[2] for r in rows]], pa.list_(pa.string()))], names=["conv_id", "piece", "turns", "texts"]
            )

        number = size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= params.piece_turns or size >= params.piece_chars):
                    yield piece(held, number)
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row[2] or "")
        if held:
            yield piece(held, number)

    return ordered.select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, piece long, turns array<long>, texts array<string>").withColumn("part", F.spark_partition_id())


def recover(conversations: DataFrame, model: RoleModel, params: ChatParams) -> DataFrame:
    """conv_id, turn, sub, role, rendered for each run of a role inside a row of the conversations, numbered by sub; their own roles are not looked at."""
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers
    pieces = materialize(pack(conversations, params), "chat-pieces")
    edges = pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.struct("part", "piece")).alias("head"))
    several = edges.filter("n > 1").select(F.col("conv_id").alias("c"), "head")
    many = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("first", F.struct("part", "piece") == F.col("head"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts, first in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                total = None
                for w in shared.value.weights(texts, first):
                    total = w if total is None else _times(total, w)
                out.append(total.ravel().tolist())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "part", "piece", "m"])

    def seams(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "piece"])
        k = len(shared.value.roles)
        score, back = np.zeros(k), []
        for m in pdf.m:
            paths = score[:, None] + np.array(m).reshape(k, k)
            back.append(paths.argmax(0))
            score = paths.max(0)
        state, ends = int(score.argmax()), []
        begins = []
        for b in reversed(back):
            ends.append(state)
            state = int(b[state])
            begins.append(state)
        return pd.DataFrame({"conv_id": pdf.conv_id, "part": pdf.part, "piece": pdf.piece, "enter": begins[::-1], "leave": ends[::-1]})

    summed = many.select("conv_id", "part", "piece", "texts", "first").mapInArrow(matrices, "conv_id long, part int, piece long, m array<double>")
    fixed = materialize(summed.groupBy("conv_id").applyInPandas(seams, "conv_id long, part int, piece long, enter int, leave int"), "chat-seams").drop("conv_id")
    heads = materialize(several.select(F.col("head.part").alias("part"), F.col("head.piece").alias("piece"), F.lit(True).alias("is_head")), "chat-heads")
    work = pieces.join(fixed, ["part", "piece"], "left").join(heads, ["part", "piece"], "left")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out: list[tuple] = []
            for conv, turns, texts, enter, leave, head in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                weights = model.weights(texts, enter is None or bool(head))
                score = weights[0][enter if enter is not None else 0]
                back = []
                for w in weights[1:]:
                    paths = score[:, None] + w
                    back.append(paths.argmax(0))
                    score = paths.max(0)
                state = int(score.argmax()) if leave is None else leave
                states = [state]
                for p in reversed(back):
                    state = int(p[state])
                    states.append(state)
                states.reverse()
                at = 0
                for turn, text in zip(turns, texts, strict=True):
                    lines = _lines(text)
                    runs = groupby(zip(states[at : at + len(lines)], lines, strict=True), key=lambda x: x[0])
                    at += len(lines)
                    for sub, (state, run) in enumerate(runs):
                        role = model.roles[state]
                        out.append((conv, turn, sub, role, render(role, "\n".join(x for _, x in run))))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "sub", "role", "rendered"])

    return work.select("conv_id", "turns", "texts", "enter", "leave", "is_head").mapInArrow(decode, "conv_id long, turn long, sub long, role string, rendered string")


def render(role: str, text: str | None) -> str:
    """One canonical turn; a speaker marker in front of the text goes, and those of the same role in front of later lines."""
    lines = [x[_MARKER.match(x).end() :] if (said := marked(x)) and (k == 0 or said == role) else x for k, x in enumerate(_lines(text))]
    body = "\n".join(x.rstrip() for x in lines).strip()
    return f"<|{role}|>\n{body}\n<|end|>"


def learned(column: str) -> Column:
    """Conversations that the model learns from: four of five."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


def format_chats(conversations: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """conv_id, turn, sub, role, rendered, learned; roles are recovered from the texts alone."""
    params = params or ChatParams()
    model = fit(conversations.filter(learned("conv_id")), params)
    return recover(conversations, model, params).withColumn("learned", F.coalesce(learned("conv_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))
