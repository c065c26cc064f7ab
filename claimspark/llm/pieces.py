"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton is built over the pieces of a model file. A text is read once; at each position the
output links list the pieces that end there, and the best score before each of them is relaxed.
The result is the segmentation of the highest total piece score, ties to the longer last piece.
Characters outside all pieces become byte pieces. Spaces become the model's space mark and one
mark is put in front, so ``decode(encode(text)) == text``.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_PARTS = 300_000
#: Score of a character without a piece, below the worst piece.
UNKNOWN = 10.0


class Automaton:
    """Aho-Corasick states: ``goto`` per state, ``fail`` links, pieces and output links."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.goto, self.fail, self.piece, self.output = [{}], [0], [None], [0]
        for text, (number, score) in pieces.items():
            state = 0
            for letter in text:
                after = self.goto[state].get(letter)
                if after is None:
                    after = self.goto[state][letter] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(0)
                    self.piece.append(None)
                    self.output.append(0)
                state = after
            self.piece[state] = (len(text), number, score)
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for letter, after in self.goto[state].items():
                queue.append(after)
                back = self.fail[state]
                while back and letter not in self.goto[back]:
                    back = self.fail[back]
                self.fail[after] = self.goto[back].get(letter, 0)
            back = self.fail[state]  # shorter, so its own link is set
            self.output[state] = back if self.piece[back] else self.output[back]

    def best(self, text: str, unknown: float) -> list[int]:
        """Piece ids of the best segmentation; ``-1 - code point`` for a character without piece."""
        goto, fail, piece, output = self.goto, self.fail, self.piece, self.output
        scores, back, state = [0.0], [None], 0
        for at, letter in enumerate(text, 1):
            while state and letter not in goto[state]:
                state = fail[state]
            state = goto[state].get(letter, 0)
            most, how = scores[at - 1] + unknown, (1, -1 - ord(letter))
            node = state if piece[state] else output[state]
            while node:
                size, number, score = piece[node]
                if scores[at - size] + score > most:
                    most, how = scores[at - size] + score, (size, number)
                node = output[node]
            scores.append(most)
            back.append(how)
        ids, at = [], len(text)
        while at:
            size, number = back[at]
            ids.append(number)
            at -= size
        return ids[::-1]


class PieceModel:
    """Pieces and scores of a model file; the library only reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in numbers]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in numbers]
        self.byte = {int(self.text[i][3:5], 16): i for i in numbers if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unknown_id = model.unk_id()
        plain = {self.text[i]: (i, model.get_score(i)) for i in numbers if not special[i] and i not in self.of_byte}
        self.automaton = Automaton(plain)
        self.unknown = min((score for _, score in plain.values()), default=0.0) - UNKNOWN
        # Where no piece has a mark behind another character, the best path crosses every such place.
        self.cuts = all(SPACE not in t.lstrip(SPACE) for t in plain)
        self.known: dict[str, list[int]] = {}

    def _part(self, text: str) -> list[int]:
        ids = []
        for number in self.automaton.best(text, self.unknown):
            if number >= 0:
                ids.append(number)
            else:
                raw = chr(-1 - number).encode("utf-8", "surrogatepass")
                ids += [self.byte.get(b, self.unknown_id) for b in raw]
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self._part(marked)
        ids, lead = [], ""
        for word in marked.split(SPACE)[1:]:
            lead += SPACE
            if word:
                part = lead + word
                own = self.known.get(part)
                if own is None:
                    if len(self.known) >= CACHE_PARTS:
                        self.known.clear()
                    own = self.known[part] = self._part(part)
                ids += own
                lead = ""
        return ids + self._part(lead) if lead else ids

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            out += bytes([self.of_byte[i]]) if i in self.of_byte else self.text[i].encode()
        return out.decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Every column of ``docs`` and ``ids array<int>``; null and empty texts have no ids.

    A mark character in the text is read back as a space, as the format cannot tell them apart. A
    column ``ids`` is replaced; an empty table gives no rows.
    """

    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = piece_model(model)
        for texts in frames:
            yield pd.Series([np.array(own.encode(t if isinstance(t, str) else ""), np.int32) for t in texts], dtype=object)

    return docs.drop("ids").withColumn("ids", F.pandas_udf(encode, "array<int>")(F.col("text").cast("string")))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """Every column of ``rows`` and ``decoded string`` from ``ids``; null ids give the empty text."""

    def decode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = piece_model(model)
        for ids in frames:
            yield pd.Series([own.decode([] if x is None else list(x)) for x in ids], dtype=object)

    return rows.withColumn("decoded", F.pandas_udf(decode, "string")(F.col("ids")))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256`` per row: encoded, then decoded again."""

    def both(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = piece_model(model)
        for texts in frames:
            ids = [own.encode(t if isinstance(t, str) else "") for t in texts]
            crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
            yield pd.DataFrame({"n": [len(x) for x in ids], "crc": crc, "back": [own.decode(x) for x in ids]})

    done = F.pandas_udf(both, "n long, crc long, back string")(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), done.alias("p"))
    return rows.select("doc_id", F.col("p.n").alias("n_pieces"), F.col("p.crc").alias("ids_crc32"), F.sha2("p.back", 256).alias("decoded_sha256"))
