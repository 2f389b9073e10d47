"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here: the longest prefix that the model's compiled character map
knows is replaced, everything else is copied, and every normalised character records
the bytes of the text that it came from; user-defined symbols are copied as they are.
The pieces of the normalised text are then projected to byte spans of the original, for
every document: the rows of ``round_trip`` are digests of those ids and spans. Segmentation uses the library on the already
normalised text, with a copy of the model whose own normaliser is switched off; the
vocabulary has no piece with a space mark after another character, so the normalised
text is segmented unit by unit (space marks and what follows them) and units are
remembered. Models with such pieces or with user-defined symbols take the whole text.

Defined results: a null text is empty; an empty text has no piece but the end mark.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices

MARK = "▁"
# Units that a task remembers before it starts anew.
HELD_UNITS = 400_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _put_varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Field number, value and raw bytes of every field of a serialised message."""
    at = 0
    while at < len(message):
        begin = at
        tag, at = _varint(message, at)
        if tag & 7 == 0:
            value, at = _varint(message, at)
        elif tag & 7 == 2:
            size, at = _varint(message, at)
            value, at = message[at:at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = message[at:at + size], at + size
        yield tag >> 3, value, message[begin:at]


class CharMap:
    """The compiled map: a double-array trie of UTF-8 prefixes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size:]
        self.starts = {first for first in range(256) if self._child(0, first) is not None} if self.units else set()

    def _child(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        to = node ^ (unit >> 10) << ((unit & 1 << 9) >> 6) ^ byte
        return to if to < len(self.units) and self.units[to] & (1 << 31 | 255) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest known prefix at ``at`` and its replacement; (0, None) if there is none."""
        node, length, value = 0, 0, None
        for k in range(at, len(data)):
            node = self._child(node, data[k])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                leaf = node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)
                length, value = k + 1 - at, self.units[leaf] & 0x7FFFFFFF
        if value is None:
            return 0, None
        return length, self.replacements[value:self.replacements.index(b"\0", value)]


class Normaliser:
    """Normalised text and, per normalised character, where its source begins (one more entry: the end)."""

    def __init__(self, spec: bytes, symbols: list[bytes] = ()) -> None:
        got = {number: value for number, value, _ in _fields(spec)}
        self.map = CharMap(got.get(2, b""))
        # runs of bytes at which neither a known prefix nor a symbol can begin are copied
        self.symbols = sorted(symbols, key=len, reverse=True)
        starts = self.map.starts | {s[0] for s in self.symbols}
        self.special = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in sorted(starts)) + b"]") if starts else None
        self.dummy, self.trim, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of what is replaced at ``at``, and its replacement: a symbol, a known prefix, or one character."""
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        size, new = self.map.longest(data, at) if data[at] in self.map.starts else (0, None)
        if new is None:
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            new = data[at:at + size]
        return size, new

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        parts, begins, ends = [], [], []
        at = 0
        while at < len(data):
            found = self.special.search(data, at) if self.special else None
            stop = found.start() if found else len(data)
            if stop > at:
                begin = at + np.flatnonzero(np.frombuffer(data[at:stop], np.uint8) & 0xC0 != 0x80)
                parts.append(data[at:stop].decode())
                begins.append(begin)
                ends.append(np.append(begin[1:], stop))
                at = stop
            if at < len(data):
                size, new = self._prefix(data, at)
                parts.append(new.decode())
                begins.append(np.full(len(parts[-1]), at))
                ends.append(np.full(len(parts[-1]), at + size))
                at += size
        out = "".join(parts)
        begin, end = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begins, ends))
        if self.trim and out:
            points = np.frombuffer(out.encode("utf-32-le"), np.uint32)
            solid = points != 32
            keep = solid.copy()
            keep[1:] |= solid[:-1]  # one space after each run of other characters, but the last
            keep[len(solid) - int(np.argmax(solid[::-1])) if solid.any() else 0:] = False
            out = points[keep].tobytes().decode("utf-32-le")
            begin, end = begin[keep], end[keep]
        if not out:
            return "", np.array([len(data)], np.int64)
        mark = MARK if self.escape else " "
        out = out.replace(" ", mark)
        if self.dummy:
            return mark + out, np.concatenate([begin[:1], begin, end[-1:]])
        return out, np.concatenate([begin, end[-1:]])


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece
        with open(model, "rb") as f:
            raw = f.read()
        spec, rest, symbols = b"", [], []
        for number, value, whole in _fields(raw):
            if number == 3:
                spec = value
            else:
                rest.append(whole)
            if number == 1:
                piece = {n: v for n, v, _ in _fields(value)}
                symbols += [piece[1]] if piece.get(3, 1) == 4 else []
        self.normalise = Normaliser(spec, symbols)
        off = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + _put_varint(len(off)) + off)
        self.outer = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.outer.id_to_piece(i) for i in range(self.outer.get_piece_size())]
        self.by_unit = not symbols and self.normalise.dummy and self.normalise.escape and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.end = self.outer.eos_id()
        self.text_id = [str(i) for i in range(len(pieces))]
        # characters of the normalised text that a piece takes; a byte piece takes its character with the last byte
        self.is_byte = [self.outer.is_byte(i) for i in range(len(pieces))]
        self.width = [len(p) for p in pieces]
        # with byte pieces nothing is unknown
        self.falls_back = sum(self.is_byte) == 256
        self._forget()
        lead = [b and not 0x80 <= int(p[3:5], 16) < 0xC0 for p, b in zip(pieces, self.is_byte)]
        # characters that a piece moves on by and that it spans; all bytes of one character share its source
        self.moves = np.array([n if not b else int(x) for n, b, x in zip(self.width, self.is_byte, lead)], np.int64)
        self.covers = np.array([1 if b else n for n, b in zip(self.width, self.is_byte)], np.int64)

    def ids(self, normal: str) -> list[int]:
        """Ids of a normalised text, without the end mark."""
        if not self.by_unit:
            return self.inner.encode(normal)
        at = self.numbers(self.units(normal))
        return list(chain.from_iterable(self.flat[a:b].tolist() for a, b in zip(self.first[at], self.first[at + 1])))

    @staticmethod
    def units(normal: str) -> list[str]:
        """Units of a normalised text that begins with a space mark, each without its first mark."""
        if MARK + MARK not in normal:
            return normal.split(MARK)[1:]
        return [u[1:] for u in _UNIT.findall(normal)]

    def numbers(self, units: list[str]) -> np.ndarray:
        """Where the units stand among those remembered; new ones are segmented by the library."""
        known = self.known
        new = list(set(units).difference(known))
        if len(known) + len(new) > HELD_UNITS:
            self._forget()
            known, new = self.known, list(set(units))
        if new:
            found = self.inner.encode([MARK + u for u in new], num_threads=1)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int64)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            self.spelt = np.concatenate([self.spelt, np.array([" ".join(map(self.text_id.__getitem__, p)) for p in found], object)])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _forget(self) -> None:
        """Units remembered: number of each, their ids one behind the other and where each one's begin, and these as text."""
        self.known: dict[str, int] = {}
        self.flat, self.first, self.spelt = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, object)

    def encode(self, text: str | None) -> list[int]:
        return [*self.ids(self.normalise(text or "")[0]), self.end]

    def spans(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the begin and end byte of each piece in the original text; the end mark is empty, at the end."""
        normal, where = self.normalise(text or "")
        found = self.ids(normal)
        ids = np.array(found, np.int64)
        moves, covers = self.moves[ids], self.covers[ids]
        if not self.falls_back and (ids == self.outer.unk_id()).any():
            at = 0
            for k in range(len(ids)):
                if ids[k] == self.outer.unk_id():
                    width = 1
                    while at + width < len(normal) and self._unknown(normal[at + width]):
                        width += 1
                    moves[k] = covers[k] = width
                at += int(moves[k])
        to = np.cumsum(moves)
        return [*found, self.end], np.append(where[to - covers], where[-1]), np.append(where[to], where[-1])

    def spans_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """``spans`` of some texts: ids, begins and ends of all, where each text's begin, and its ids as text (decimal, joined by spaces)."""
        if not self.by_unit or not self.falls_back:
            got = [self.spans(t) for t in texts]
            ids, begins, ends = (np.concatenate(c).astype(np.int64) if got else np.zeros(0, np.int64) for c in (zip(*got) if got else ((), (), ())))
            return ids, begins, ends, np.cumsum([0, *(len(g[0]) for g in got)]), [" ".join(map(str, g[0])) for g in got]
        normal = [self.normalise(t or "") for t in texts]
        units = [self.units(n) for n, _ in normal]
        number, distinct = pd.factorize(np.array(list(chain.from_iterable(units)), object))
        place = self.numbers(list(distinct))[number]
        # the pieces of every unit in the order of the texts
        taken = self.first[place + 1] - self.first[place]
        ids = self.flat[np.repeat(self.first[place] - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())]
        cuts = np.cumsum([0, *map(len, units)])
        per_text = np.diff(np.append(0, np.cumsum(taken))[cuts])
        own = np.repeat(np.arange(len(texts)), per_text)
        where = np.concatenate([w for _, w in normal])
        to = np.cumsum(self.moves[ids]) + own  # each text has one place more than characters
        stops = np.cumsum([len(w) for _, w in normal]) - 1
        at = np.cumsum(per_text)
        put = lambda values, last: np.insert(values, at, last)
        spelt = self.spelt[place]
        named = [" ".join([*spelt[a:b], self.text_id[self.end]]) for a, b in zip(cuts[:-1], cuts[1:])]
        return (put(ids, self.end), put(where[to - self.covers[ids]], where[stops]), put(where[to], where[stops]),
                np.append(0, at + np.arange(1, len(texts) + 1)), named)

    def _unknown(self, char: str) -> bool:
        return self.outer.piece_to_id(char) == self.outer.unk_id()

    def decode(self, ids: list[int]) -> str:
        return self.outer.decode(ids)


SPANS = "ids array<int>, begins array<long>, ends array<long>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _slices(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    for batch in slices(batches, budget=1 << 20):
        yield batch, codec.spans_many(batch.column("text").to_pylist())


def encode_spans(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids and the byte span of every piece."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (*columns, cuts, _) in _slices(batches, Codec(model)):
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), *lists], ["doc_id", "ids", "begins", "ends"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {SPANS}")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, number of ids, and digests of the ids, of the text decoded from them and of their spans.

    The digest of the spans is over the begins of all pieces and then their ends, eight bytes each, little-endian.
    Ids and spans stay in the task that found them.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch, (ids, begins, ends, cuts, named) in _slices(batches, codec):
            rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            digests = ([sha(s.encode()) for s in named], [sha(codec.decode(ids[a:b].tolist()).encode()) for a, b in rows],
                       [sha(begins[a:b].astype("<i8").tobytes() + ends[a:b].astype("<i8").tobytes()) for a, b in rows])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), *(pa.array(c, pa.string()) for c in digests)],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {DIGEST}")
