"""Encoding with a piece model, each piece tied to the bytes of the source that it came from, and decoding.

The text is normalised by the model's compiled character map: at each place the longest key of the map that
the text goes on with is replaced, and each character made remembers the byte its key began at. Then pairs of
neighbours merge, best score first and leftmost on a tie; characters in no piece become their bytes.
Pieces are projected to spans of source bytes through the remembered places: spans follow each other without gaps
as the map's keys do, a piece of the dummy prefix is empty, and of the bytes of one character the last has the span.

Merging never crosses a place between two characters that no piece has next to each other. Texts are therefore cut
before runs of the space mark and around characters of no piece, and the ids of short parts are kept for reuse.
Models with pieces that hold text before a space mark are cut at unknown characters only. Models of other kinds
(unigram, user-defined or unused pieces, marks at the end) are refused with a ValueError.

Cases: a null or empty text has no pieces and decodes to an empty one; white space alone is kept as the model says; texts of
any length are read whole, in runs of about a million characters; repeated rows are encoded alike; an empty table gives an
empty result; other columns pass through, but columns with names of results are replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import CACHES, spare_name

SPACE = "▁"

#: Fixed values of the model file: numbers of fields, kinds of pieces and of models.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

#: Parts of up to CACHED_CHARS characters are kept, CACHED_PARTS of them at most.
CACHED_CHARS, CACHED_PARTS = 48, 250_000

MARKS = ".,;:!?)\"'"

#: Less than any score.
NONE = float("-inf")

#: A task gives back its pieces when they are of so many characters of text.
GIVEN_CHARS = 1 << 21

RUN_CHARS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class CharMap:
    """The compiled character map: a double array of keys and their replacements, each ended by a zero byte."""

    units: np.ndarray
    replaced: bytes
    _alone: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def read(cls, compiled: bytes) -> CharMap:
        if not compiled:
            return cls(np.zeros(0, np.uint32), b"")
        size = struct.unpack_from("<I", compiled)[0]
        return cls(np.frombuffer(compiled, "<u4", size // 4, 4), compiled[4 + size :])

    def longest(self, key: bytes) -> tuple[int, str | None, bool]:
        """Bytes of the longest key that `key` begins with and its replacement, and whether longer keys go on from all of it."""
        at, found = 0, (0, None)
        at ^= self._offset(int(self.units[0]))
        for i, b in enumerate(key):
            at ^= b
            unit = int(self.units[at]) if at < len(self.units) else 0
            if unit & 0x800000FF != b:
                return *found, False
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                start = int(self.units[at]) & 0x7FFFFFFF
                found = i + 1, self.replaced[start : self.replaced.index(0, start)].decode("utf-8")
        # what can follow here are the units one byte on whose label is that byte
        more = any(at ^ b < len(self.units) and int(self.units[at ^ b]) & 0x800000FF == b for b in range(1, 256))
        return *found, more

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def pairs(self, text: str) -> Iterator[tuple[str, int]]:
        """(replacement, source characters) from the left, longest key first; a character in no key stays."""
        at, most = 0, 64
        while at < len(text):
            c = text[at]
            if c not in self._alone:
                size, made, more = self.longest(c.encode())
                self._alone[c] = None if more else (made if size else c)
            made = self._alone[c]
            if made is not None:
                yield made, 1
                at += 1
                continue
            key = text[at : at + most].encode()
            size, made, _ = self.longest(key)
            chars = len(key[:size].decode()) if size else 1
            yield (made if size else c), chars
            at += chars


class _Parts(dict):
    """Parts and their pieces, as pairs (id, characters) of four-byte numbers; made when first asked for."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        at = len(part.rstrip(MARKS))  # a word and the marks behind it, if no merge crosses
        split = 0 < at < len(part) and part[at - 1 : at + 1] not in self.model.joined
        found = self[part[:at]] + self[part[at:]] if split else self.model.merge(part).tobytes()
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = found
        return found


@dataclass
class PieceModel:
    ids: dict[str, int]  # of normal pieces
    scores: dict[str, float]
    names: list[str]
    kinds: list[int]
    byte_ids: list[int] | None
    unknown: int
    unknown_text: str
    chars: CharMap
    prefix: bool
    squeeze: bool
    escape: bool
    parts: re.Pattern | None = None
    spaced: bool = True
    breaks: str = ""
    joined: set[str] = field(default_factory=set)  # neighbours inside any piece
    _seen: _Parts | None = None
    _shown: list[bytes] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        names, kinds, scores, trainer, rules = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == PIECES:
                piece = dict(_fields(value))
                names.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer |= dict(_fields(value))
            elif number == NORMALIZER:
                rules |= dict(_fields(value))
            elif number == DENORMALIZER and dict(_fields(value)).get(2):
                raise ValueError("a model with a denormaliser")
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only byte-pair models of normal, control and byte pieces with marks in front are read")
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        by_byte = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        surface = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        model = cls(
            {names[i]: i for i in normal}, {names[i]: scores[i] for i in normal}, names, kinds, [by_byte[b] for b in range(256)] if trainer.get(35) else None,
            kinds.index(UNKNOWN), surface, CharMap.read(rules.get(2, b"")), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)),
        )
        known = "".join(sorted({c for n in model.ids for c in n} - {SPACE}))
        inside = f"[{re.escape(known)}]" if known else r"(?!)"
        model.spaced = not any(a != SPACE and b == SPACE for n in model.ids for a, b in zip(n, n[1:]))
        model.breaks = "".join({"\n", "\t", "\r"} - set(known))
        model.joined = {n[i : i + 2] for n in model.ids for i in range(len(n) - 1)}
        model._seen = _Parts(model)
        model._shown = [_shown(n, k, model.unknown_text) for n, k in zip(names, kinds)]
        if not model.spaced:
            model.parts = re.compile(f"(?:{inside}|{SPACE})+|(?:(?!{inside}|{SPACE}).)+", re.DOTALL)
        else:
            model.parts = re.compile(f"{SPACE}*{inside}+|{SPACE}+|[^{SPACE}{re.escape(known)}]+", re.DOTALL)
        return model

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the source byte it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        mark = SPACE if self.escape else " "
        if not len(self.chars.units) and not self.squeeze:  # every character stays itself
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
            return self.prefix * mark + text.replace(" ", mark), np.concatenate([[0], at]) if self.prefix else at
        out, places, at = [], [], 0
        pairs = self.chars.pairs(text) if len(self.chars.units) else ((c, 1) for c in text)
        begun, after_space, read = False, self.squeeze, 0
        for made, chars in pairs:
            size = len(text[read : read + chars].encode())
            read += chars
            if not begun and not (self.squeeze and made == " "):
                begun = True
                if self.prefix:
                    out.append(mark)
                    places.append(at)
            if begun:
                kept = made.lstrip(" ") if after_space else made
                out.extend(mark if c == " " else c for c in kept)
                places.extend([at] * len(kept))
                if kept:
                    after_space = self.squeeze and kept.endswith(" ")
            at += size
        while self.squeeze and out and out[-1] == mark:
            out.pop()
            at = places.pop()
        return "".join(out), np.array([*places, at], np.int64)

    def merge(self, part: str) -> array:
        """Id and number of characters of each piece of a normalised part, in turn (the last byte of a character takes it)."""
        found = array("i")
        for s in self._merged_long(part) if len(part) > CACHED_CHARS else self._merged(part):
            if (known := self.ids.get(s)) is not None:
                found.append(known)
                found.append(len(s))
            elif self.byte_ids:
                for c in s.encode("utf-8"):
                    found.append(self.byte_ids[c])
                    found.append(0)
                found[-1] = 1
            else:
                found.extend((self.unknown, 1))
        return found

    def _merged(self, part: str) -> list[str]:
        """The symbols that are left of a short part: the best pair merges, again and again."""
        symbols, score = list(part), self.scores.get
        worth = [score(part[i : i + 2], NONE) for i in range(len(part) - 1)]
        while worth and (best := max(worth)) > NONE:
            i = worth.index(best)
            symbols[i] = made = symbols[i] + symbols.pop(i + 1)
            del worth[i]
            if i:
                worth[i - 1] = score(symbols[i - 1] + made, NONE)
            if i < len(worth):
                worth[i] = score(made + symbols[i + 1], NONE)
        return symbols

    def _merged_long(self, part: str) -> list[str]:
        """The same of a part of any length, with a heap."""
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        symbols, heap = list(part), []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (score := self.scores.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-score, a, b, len(symbols[a]) + len(symbols[b])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or right[a] != b or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[b] < len(part):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def _cut(self, run: str) -> list[str]:
        """The run in parts that no merge crosses."""
        if not self.spaced or "\0" in run:
            return self.parts.findall(run)
        cut = run.replace(SPACE, f"\0{SPACE}")
        while f"{SPACE}\0" in cut:
            cut = cut.replace(f"{SPACE}\0", SPACE)
        for c in self.breaks:
            cut = cut.replace(c, f"\0{c}\0")
        return cut.split("\0")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of each piece in the source."""
        normal, places = self.normalise(text)
        pairs = np.frombuffer(b"".join([b"".join(map(self._seen.__getitem__, self._cut(run))) for run in _runs(normal)]), np.int32).reshape(-1, 2)
        ids, sizes = pairs[:, 0], pairs[:, 1].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if not self.byte_ids and len(ids):  # neighbouring unknown characters are one piece
            first = np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])
            ids, starts, ends = ids[first], starts[first], np.concatenate([starts[first][1:], ends[-1:]])
        return ids, places[starts], places[ends]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters, one each."""
        ids = np.asarray(ids, np.int64)
        kinds = [self.kinds[i] for i in ids[:1]]
        if kinds == [NORMAL] and not self.squeeze:
            shown = list(map(self._shown.__getitem__, ids.tolist()))
            if self.prefix and self.names[ids[0]].startswith(SPACE):
                shown[0] = shown[0][1:]
            if shown[0]:  # else the next piece begins the text
                try:
                    return b"".join(shown).decode("utf-8")
                except UnicodeDecodeError:
                    pass
        out, held, first = [], bytearray(), True

        def flush() -> None:
            if held:
                out.append(_text_of_bytes(bytes(held)))
                held.clear()

        for i in ids:
            kind, name = self.kinds[i], self.names[i]
            if kind == BYTE:
                held.append(int(name[3:5], 16))
                continue
            flush()
            first = first and not any(out)
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            elif kind == NORMAL:
                if first and (self.prefix or self.squeeze) and name.startswith(SPACE):
                    name, first = name[1:], self.squeeze
                out.append(name.replace(SPACE, " "))
        flush()
        return "".join(out)


def _shown(name: str, kind: int, unknown: str) -> bytes:
    """What a piece adds to a decoded text; one that adds nothing but parts bytes is no UTF-8, so such texts are read piece by piece."""
    if kind == BYTE:
        return bytes([int(name[3:5], 16)])
    return {NORMAL: name.replace(SPACE, " "), UNKNOWN: unknown}[kind].encode("utf-8") if kind in (NORMAL, UNKNOWN) else b"\xff"


def _runs(text: str) -> Iterator[str]:
    """The text in runs that begin at a run of space marks, or all at once where there is none."""
    at = 0
    while len(text) - at > RUN_CHARS:
        cut = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, at + RUN_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _text_of_bytes(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[bytes, PieceModel] = {}
CACHES.append(_MODELS)


def _model(data: bytes) -> PieceModel:
    if data not in _MODELS:
        _MODELS[data] = PieceModel.parse(data)
    return _MODELS[data]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows], dtype=np.int32)))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about GIVEN_CHARS characters; nulls are empty."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= GIVEN_CHARS:
            yield held
            held, size = [], 0
    yield held


def encode(df: DataFrame, model: bytes, text: str = "text", decoded: bool = False) -> DataFrame:
    """Append ids, starts and ends (arrays; bytes of the source text) to every row, and with `decoded` the text that the ids decode to.
    `model` is the content of the file."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the file, whatever the input
    made = ["ids", "starts", "ends", *["decoded"] * decoded]

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>" + ",decoded:string" * decoded + ">")
    def pieces(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(shared.value)
        for some in (texts for part in parts for texts in _slices(part)):
            got = [m.encode(t) for t in some]
            again = [pa.array([m.decode(g[0]) for g in got], pa.string())] if decoded else []
            yield pa.StructArray.from_arrays([*(_lists([g[k] for g in got]) for k in range(3)), *again], made)

    name = spare_name(df.columns, "pieces")
    rows = df.withColumn(name, pieces(F.col(f"`{text}`")))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *(F.col(f"{name}.{c}") for c in made))


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Append decoded, the text of the ids, to every row; null ids are none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(shared.value)
        for some in parts:
            yield pa.array([m.decode(i.values.to_numpy()) if i.is_valid else "" for i in some], pa.string())

    return df.withColumn("decoded", texts(F.col(f"`{ids}`")))


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
