"""SentencePiece encoding and decoding with a merge-type prefix table.

The BPE result of a string is the only sequence of pieces in which every adjacent pair is *compatible*: merging the two
pieces' characters gives back just these two pieces. So the last piece of the result of every prefix is unique. The
encoder walks over the matches of an Aho-Corasick automaton, stores for each prefix the one piece that ends there and is
compatible with the last piece of the remaining prefix, and then reads the ids backwards from the end.

No piece holds a space mark after another character, or a line feed, so texts are cut into segments there; segments
repeat, and a task remembers them.

Defined results: NULL and empty texts have no ids and decode to the empty text; repeated rows keep their rows; an empty
table gives an empty table. Other input columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.common import blocks_of, texts

MARK = "▁"
NEVER = float("inf")
# What a task remembers of segments, in bytes with an allowance for each entry (longer segments are not remembered), and
# of piece pairs; a full store is emptied.
KNOWN_BYTES = 96 << 20
ENTRY_BYTES, SEGMENT_CHARS = 350, 256
KNOWN_PAIRS = 300_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids string, decoded string"


class PieceModel:
    """Encodes and decodes by a BPE model file of the sentencepiece library."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[str] = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.byte_ids = [0] * 256
        self.kind = ["plain"] * len(self.pieces)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.unknown = library.unk_id()
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                self.kind[i] = "byte"
                self.byte_ids[int(piece[3:5], 16)] = i
            elif library.is_unknown(i):
                self.kind[i] = "unknown"
            elif library.is_control(i):
                self.kind[i] = "control"
            else:
                self.ids[piece], self.rank[piece] = i, -library.get_score(i)
        # How each piece grows at its right and left edge, from one character to the whole piece.
        self.right_edge: dict[int, list[str]] = {}
        self.left_edge: dict[int, list[str]] = {}
        automaton = ahocorasick.Automaton()
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            parts = self._last_merge(piece)
            if parts is None:
                continue  # never the result of merging
            if len(piece) == 1:
                self.right_edge[i] = self.left_edge[i] = [piece]
            else:
                left, right = (self.ids[part] if part in self.ids else None for part in parts)
                self.right_edge[i] = (self.right_edge[right] if right is not None else [parts[1]]) + [piece]
                self.left_edge[i] = (self.left_edge[left] if left is not None else [parts[0]]) + [piece]
            automaton.add_word(piece, i)
        automaton.make_automaton()
        self.automaton = automaton
        self.cut_inside = any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in self.ids)
        self.pairs: dict[int, bool] = {}
        self.lengths = [len(piece) for piece in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.surface = [piece.replace(MARK, " ") for piece in self.pieces]
        self.known_ids: dict[str, str] = {}
        self.known_text: dict[str, str] = {}
        self.held = 0

    def _last_merge(self, piece: str) -> tuple[str, ...] | None:
        """The two parts that merge last when the piece is encoded alone; None if it isn't reached."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NEVER:
                return None
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging never joins anything across the border of the two pieces."""
        lefts, rights = self.right_edge[first], self.left_edge[second]
        i = j = 0
        while True:
            grows_left = self.rank[lefts[i + 1]] if i + 1 < len(lefts) else NEVER
            grows_right = self.rank[rights[j + 1]] if j + 1 < len(rights) else NEVER
            across = self.rank.get(lefts[i] + rights[j], NEVER)
            # Equal ranks: the leftmost merge comes first.
            if across < grows_left and across <= grows_right:
                return across == NEVER
            if grows_left == grows_right == NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def encode_segment(self, text: str) -> list[int]:
        last = [-1] * (len(text) + 1)
        pairs, lengths = self.pairs, self.lengths
        size = len(lengths)
        for end, piece in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            # last[i] is the piece that ends with character i; last[-1] stands for the beginning.
            before = last[end - lengths[piece]]
            if before >= 0:  # below zero: the beginning, or a character that no piece has
                key = before * size + piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, piece)
                if not fits:
                    continue
            last[end] = piece
        if len(pairs) > KNOWN_PAIRS:
            pairs.clear()
        ids, at = [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= lengths[piece]
            else:
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
                at -= 1
        ids.reverse()
        return ids

    def segments(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before space marks and around line feeds."""
        if not text:
            return []
        if self.cut_inside:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or text[0] == " " or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", marked)
        marked = MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")
        return [s for s in marked.split(" ") if s]

    def encode(self, text: str) -> list[int]:
        return [i for segment in self.segments(text) for i in self.encode_segment(segment)]

    def decode(self, ids: list[int], inner: bool = False) -> str:
        """The text of the ids; ``inner``: they are not the beginning of a text, so a leading mark is a space."""
        if inner and all(self.kind[i] == "plain" for i in ids):
            return "".join([self.surface[i] for i in ids])
        out, pending = [], bytearray()
        for i in ids:
            kind = self.kind[i]
            if kind == "byte":
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if kind == "plain":
                piece = self.pieces[i]
                if not inner and not out and piece.startswith(MARK):
                    piece = piece[1:]
                out.append(piece.replace(MARK, " "))
                inner = True
            elif kind == "unknown":
                out.append(" ⁇ ")
                inner = True
        if pending:
            out.append(_utf8(bytes(pending)))
        return "".join(out)

    def forget(self) -> None:
        """Drop what is remembered: workers live on and serve other jobs."""
        self.known_ids, self.known_text, self.pairs, self.held = {}, {}, {}, 0

    def rows(self, values: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, decoded text) of each text."""
        known_ids, known_text, decimal = self.known_ids, self.known_text, self.decimal
        if self.held > KNOWN_BYTES:
            known_ids.clear()
            known_text.clear()
            self.held = 0
        cut, long = [self.segments(value) for value in values], []
        for segment in set().union(*cut).difference(known_ids):
            ids = self.encode_segment(segment)
            known_ids[segment] = ",".join([decimal[i] for i in ids])
            known_text[segment] = self.decode(ids, inner=True)
            if len(segment) > SEGMENT_CHARS:
                long.append(segment)
            else:
                self.held += 8 * len(segment) + ENTRY_BYTES
        for segments in cut:
            ids = ",".join(map(known_ids.__getitem__, segments))
            # The first segment begins with the mark that encoding adds.
            yield ids, ids.count(",") + 1 if ids else 0, "".join(map(known_text.__getitem__, segments))[1:]
        for segment in long:
            del known_ids[segment], known_text[segment]


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for length in (1, 2, 3, 4):
                try:
                    out.append(data[at:at + length].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                length = 1
                out.append("�")
            at += length
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker and file."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by commas) and the text decoded from them.

    ``path`` names a BPE model file that all executors have installed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            column = batch.column("text")
            for a, b in blocks_of(pc.binary_length(column).to_numpy(zero_copy_only=False), 1 << 20):
                rows = list(own.rows(column.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])
        own.forget()

    return texts(docs).mapInArrow(encode, SCHEMA)


def id_array(ids: str = "ids"):
    """The ids column as array<int>."""
    return F.when(F.col(ids) == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>"))
