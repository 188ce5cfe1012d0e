"""SentencePiece encoding and decoding with shared-prefix Viterbi.

Texts are cut into marked words: each space becomes the mark U+2581, one mark is put in front of the text,
and a new word starts wherever a mark follows another character. No piece of the vocabulary has a mark
inside, so no piece spans two words. The distinct words of a batch are sorted, which lays them out as a
trie in depth-first order, and are decoded left to right: a prefix that a word shares with the one before
keeps its forward states, only the rest is computed. Beside the distinct words of a batch a worker holds the words
and ids of a small part of it only, of a long text too.

The vocabulary at hand is a byte-pair one: its scores are merge ranks, and the path with the best sum of
them isn't what the tokenizer gives. The forward step therefore ranks a path by whether it is the merge
result of its prefix: a piece may follow the last piece of a prefix if merging the two texts leaves just
this pair, and exactly one such path reaches each prefix. Words with runs of marks, whose pieces all
share one rank, are merged directly. Characters without a piece become byte pieces.

Defined results: a null text gives null ids and an empty one no ids; a text that holds U+2581 itself
decodes to a space there (round_trip is then false); repeated rows come out repeated; of pairs with equal
ranks the leftmost merges first; very long texts and runs of spaces take n log n steps; columns other than
doc_id and text may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelake.llm._spark import chunks, list_array, read_table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_WORDS = 150_000
"""Words that a Python worker remembers between batches before it starts anew from those of the batch at hand (some 30 MB)."""
CACHED_PAIRS = 400_000
"""Pairs of pieces that it remembers before it starts anew (some 50 MB)."""
SPAN = 250_000
"""Bytes of short texts that are encoded at a time, characters of a long one, and ids that are decoded at a time."""
NONE = -1
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SEAM = re.compile(f"(?<=[^{MARK}]){MARK}")


def _spans(text: str | None) -> Iterator[str]:
    """A text with its marks, cut where words meet: at the first such place after every ``SPAN`` characters."""
    marked, start = MARK + text.replace(" ", MARK) if text else "", 0
    while start < len(marked):
        seam = _SEAM.search(marked, start + SPAN)
        end = seam.start() if seam else len(marked)
        yield marked[start:end]
        start = end


@dataclass
class Vocabulary:
    """Pieces with their ids and ranks; small and fixed, read once on the driver."""

    ids: dict[str, int]
    ranks: dict[str, float]
    bytes_from: list[int]
    texts: list[bytes]
    words: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)
    ends: dict = field(default_factory=dict)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, ranks, from_byte, texts = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                from_byte[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                ids[piece], ranks[piece] = i, model.get_score(i)
                texts.append(piece.replace(MARK, " ").encode())
        return cls(ids, ranks, from_byte, texts).prepare()

    def merged(self, text: str) -> list[str]:
        """Pieces of a text by merging: the best-ranked neighbours first, the leftmost of equals; n log n steps for n characters."""
        parts, ranks = list(text), self.ranks
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                rank = ranks.get(both)
                if rank is not None:
                    heappush(waiting, (-rank, i, both))

        for i in range(len(parts)):
            offer(i)
        while waiting:
            _, i, both = heappop(waiting)
            if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue  # one of the two has been merged with another since
            gone = after[i]
            parts[i], parts[gone], after[i] = both, "", after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces leaves these two."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def prepare(self) -> Vocabulary:
        """Lays the pieces that merging their own text gives out by their characters from the last to the first."""
        for piece, i in self.ids.items():
            if len(piece) == 1 or (MARK * 2 not in piece and self.merged(piece) == [piece]):
                node = self.ends
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = i
                self.names[i] = piece
        return self

    def emit(self, parts: list[str]) -> bytes:
        """Ids of some pieces as packed 32-bit numbers."""
        out = array("i")
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.bytes_from[b] for b in p.encode())
            else:
                out.append(i)
        return out.tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Fills ``self.words`` for the given words, sorted: the trie of their prefixes in depth-first order."""
        before = ""
        starts, last = [0], [NONE]  # for each prefix of the word: where the last piece of its path starts, and which it is
        ends, pairs = self.ends, self.pairs
        for word in words:
            if MARK * 2 in word:
                self.words[word] = self.emit(self.merged(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del starts[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, start = ends, end
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        start, piece = end - 1, NONE  # no piece: its bytes, which nothing merges with
                        break
                    piece = node.get("")
                    if piece is not None:
                        left = last[start]
                        if left < 0:
                            break
                        fit = pairs.get(left << 20 | piece)
                        if fit or (fit is None and self.fits(left, piece)):
                            break  # one path reaches a prefix, so the others needn't be tried
                else:
                    start, piece = end - 1, NONE
                starts.append(start)
                last.append(piece)
            before = word
            path, end, plain = [], len(word), True
            while end:
                path.append(last[end])
                plain &= last[end] >= 0
                end = starts[end]
            if plain:
                self.words[word] = array("i", path[::-1]).tobytes()
                continue
            parts, end = [], len(word)
            while end:
                parts.append(word[starts[end] : end])
                end = starts[end]
            self.words[word] = self.emit(parts[::-1])

    def learn(self, words: set[str]) -> None:
        """Fills ``self.words`` for the given words, and forgets others where they get too many."""
        new = words.difference(self.words)
        if new and len(self.words) + len(new) > CACHED_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        self.encode_words(sorted(new))

    def learn_texts(self, texts: Iterator[str | None]) -> None:
        """The words of some texts at once: sorted together, they share more of their prefixes."""
        words: set[str] = set()
        for text in texts:
            for span in _spans(text):
                words.update(_WORD.findall(span))
        self.learn(words)

    def packed(self, span: str) -> bytes:
        """Ids of a marked span as packed 32-bit numbers."""
        words = _WORD.findall(span)
        self.learn(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and their offsets."""
        packed = [b"".join(map(self.packed, _spans(t))) for t in texts]
        offsets = np.cumsum([0] + [len(x) // 4 for x in packed])
        return np.frombuffer(b"".join(packed), np.int32), offsets

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of some ids: pieces end to end, without the space in front that encoding added."""
        spans = (ids[i : i + SPAN] for i in range(0, len(ids), SPAN))
        joined = (b"".join(map(self.texts.__getitem__, x.tolist() if isinstance(x, np.ndarray) else x)) for x in spans)
        return b"".join(joined).decode("utf-8", "replace").removeprefix(" ")


def _remembered(shared) -> Vocabulary:
    return shared.value  # one object a Python worker, so that words are remembered between its tasks


def encode(docs: DataFrame, model: str = MODEL, batch_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, n_ids, ids, round_trip (whether decoding gives the text back) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))  # a vocabulary file of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _remembered(shared)
        for batch in chunks(batches, "text", batch_bytes):
            if batch.num_rows > 1:
                vocabulary.learn_texts(t.as_py() for t in batch.column(1))
            for part in chunks(iter([batch]), "text", SPAN):
                texts = part.column(1).to_pylist()
                ids, offsets = vocabulary.encode(texts)
                spans = offsets.tolist()
                same = [None if t is None else vocabulary.decode(ids[a:b]) == t for t, a, b in zip(texts, spans, spans[1:], strict=False)]
                null = np.array([t is None for t in texts] + [False])
                marked = pa.array(np.where(null, 0, offsets).astype(np.int32), mask=null) if null.any() else pa.array(offsets.astype(np.int32))
                lists = pa.ListArray.from_arrays(marked, pa.array(ids)) if null.any() else list_array(ids, offsets, pa.int32())
                yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _remembered(shared)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
