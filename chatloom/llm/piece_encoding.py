"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

Method: a text's spaces become U+2581, one more is put before it, and its characters are symbols. An agenda holds the
adjacent pairs of symbols that make a piece, ordered by the piece's score and of equal scores by place; the best is
merged, which makes two new pairs, until none is left. Symbols that are no piece are spelled in byte pieces. No piece of
the vocabulary has U+2581 after another character (this is checked when it is loaded), so no merge goes over such a
place: texts are parted there, a task keeps the ids of parts that it has met, and a part that it has not takes
n log n steps, however long. Decoding puts pieces and bytes together again.

Each Arrow batch is checked against the sentencepiece library: every part that was worked out in it, id by id, and every
text that is decoded; with `whole` also every text that is encoded, which takes about twice the time. A difference is an
error that names what differs, never passed over.

Vocabularies must be of merge type, take texts as they are (no normalization but the space put before) and have byte
pieces or an unknown piece; one that asks for more does not agree with the library and ends in that error.

Defined results: a null or empty text has no pieces, so only the begin and end ids, and decodes to an empty text; U+2581
in a text is a space after decoding, as with the library; texts may be of any length; rows are independent, so repeated
rows and doc_ids, null ones too, give a row each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

SPACE = "▁"
#: Characters that are encoded and checked together; a longer text goes alone.
TOGETHER = 1 << 19
#: Parts whose ids a task keeps: none of more characters, and no more of them.
KEPT_CHARS, KEPT_PARTS = 48, 1 << 18
#: Characters of a short part, and a rank below all.
SHORT, NONE = 32, 1 << 62

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))
_loaded: dict[str, Pieces] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Parts(dict):
    """The ids of parts as bytes, worked out when they are first asked for. When there are many, those not asked for since the
    last time that there were go."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part) or self.encode(part)
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Pieces:
    """A vocabulary and what it does."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.ids, self.bytes, self.texts, self.fresh = {}, {}, [], []
        for i in range(library.get_piece_size()):
            piece, said = library.id_to_piece(i), b""
            if library.is_byte(i):
                said = bytes([int(piece[3:5], 16)])
                self.bytes[said[0]] = i
            elif library.is_unknown(i):
                said = b" \xe2\x81\x87 "
            elif not library.is_control(i):
                self.ids[piece] = i
                said = piece.replace(SPACE, " ").encode()
            self.texts.append(said)
        scores = {piece: library.get_score(i) for piece, i in self.ids.items()}
        place = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.part = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        self.spaced = {i for piece, i in self.ids.items() if piece.startswith(SPACE)}
        self.parts = _Parts(self._part)

    def merged(self, part: str) -> list[str]:
        """The symbols that are left when no two neighbours make a piece. The agenda of a short part is a list of its pairs' ranks
        in their places, that of a long one a heap."""
        return self._merged_short(part) if len(part) <= SHORT else self._merged_long(part)

    def _merged_short(self, part: str) -> list[str]:
        symbols, rank = list(part), self.ranks.get
        agenda = [rank(x, NONE) for x in map(add, part, part[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            left = agenda.index(best)
            whole = symbols[left] + symbols.pop(left + 1)
            symbols[left] = whole
            del agenda[left]
            if left:
                agenda[left - 1] = rank(symbols[left - 1] + whole, NONE)
            if left < len(agenda):
                agenda[left] = rank(whole + symbols[left + 1], NONE)
        return symbols

    def _merged_long(self, part: str) -> list[str]:
        n = len(part)
        symbols: list[str] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        agenda = [(r << 64) | (i << 32) | 2 for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]  # rank, place, size
        heapq.heapify(agenda)
        while agenda:
            best = pop(agenda)
            left = (best >> 32) & 0xFFFFFFFF
            right = after[left]
            if right >= n or not symbols[left] or len(symbols[left]) + len(symbols[right]) != best & 0xFFFFFFFF:
                continue  # one of the two has been merged since
            whole = symbols[left] = symbols[left] + symbols[right]
            symbols[right] = ""
            after[left] = nxt = after[right]
            prev = before[left]
            if prev >= 0 and (r := rank(symbols[prev] + whole)) is not None:
                push(agenda, (r << 64) | (prev << 32) | (len(symbols[prev]) + len(whole)))
            if nxt < n:
                before[nxt] = left
                if (r := rank(whole + symbols[nxt])) is not None:
                    push(agenda, (r << 64) | (left << 32) | (len(whole) + len(symbols[nxt])))
        return [s for s in symbols if s]

    def _part(self, part: str) -> bytes:
        symbols = self.merged(part)
        out = list(map(self.ids.get, symbols))
        if None in out:
            known, out = out, []
            for symbol, i in zip(symbols, known, strict=True):
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in symbol.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        ids = array("I", out).tobytes()
        self.fresh.append((part, ids))
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, 32-bit little-endian, with begin and end."""
        whole = SPACE + text.replace(" ", SPACE) if text else ""
        return b"".join([_id(self.begin), *map(self.parts.__getitem__, self.part.findall(whole)), _id(self.end)])

    def check(self) -> None:
        """Compare the parts worked out since the last time with the library, which puts the U+2581 before a text that they begin with."""
        fresh = [(part, ids) for part, ids in self.fresh if part != SPACE]  # the library takes an empty text as it is
        self.fresh = []
        theirs = self.library.encode([part[1:] for part, _ in fresh], num_threads=1)
        _same([ids for _, ids in fresh], [array("I", x).tobytes() for x in theirs], [part for part, _ in fresh], "the encoding of")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that a first piece begins with; bytes that are no text become U+FFFD each."""
        said = b"".join(map(self.texts.__getitem__, ids))
        first = next((i for i in ids if self.texts[i]), None)
        return said[first in self.spaced :].decode("utf-8", "each_byte")


def _id(i: int) -> bytes:
    return i.to_bytes(4, "little") if i >= 0 else b""


def pieces(path: str) -> Pieces:
    """The vocabulary of a file, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _together(texts: list) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def _same(own: list, library: list, ids: list, what: str) -> None:
    if own != library:
        at = next(i for i, (a, b) in enumerate(zip(own, library, strict=True)) if a != b)
        raise ValueError(f"{what} {ids[at]!r} differs from the library's")


def encoded(docs: DataFrame, model: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, ids (binary: 32-bit little-endian ids, with begin and end) of docs (doc_id, text)."""
    path = model or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        doc_ids = batch.column("doc_id")
        for a, b in _together(texts):
            found = [own.encode(t) for t in texts[a:b]]
            own.check()
            if whole:
                numbers = [np.frombuffer(x, "<u4").tolist() for x in found]
                _same(numbers, own.library.encode(texts[a:b], add_bos=own.begin >= 0, add_eos=own.end >= 0, num_threads=1), doc_ids[a:b].to_pylist(), "the encoding of doc_id")
            yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text of tokens (doc_id, ids as encoded gives them; null: none)."""
    path = model or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        doc_ids, given = batch.column("doc_id"), [x or b"" for x in batch.column("ids").to_pylist()]
        for a, b in _together(given):
            numbers = [np.frombuffer(x, "<u4").tolist() for x in given[a:b]]
            texts = [own.decode(x) for x in numbers]
            _same(texts, own.library.decode(numbers), doc_ids[a:b].to_pylist(), "the text of doc_id")
            yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), batch.column("ids").slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return in_arrow(tokens.select("doc_id", "ids"), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
