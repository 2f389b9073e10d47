"""An FM-index over word sequences, in numpy.

Texts are sequences of 64-bit word hashes, each ended by a separator of its own. Suffixes
are sorted by their first words at once and then by doubling, separators by their place,
so that the order is total. The last column is kept as a wavelet matrix (one bit row per
bit of a word's number) and every ``SAMPLE``-th word of a text keeps its place. Phrases are
searched backwards, all at once: every step is a rank in each bit row. Places of
occurrences are found by walking back to the next sampled word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

SAMPLE = 8
_U = np.uint64


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``text`` (numbers below 2**bits, 0 ends a text) in the order of their suffixes."""
    n = len(text)
    key, depth = text.astype(np.int64), 1
    while (depth + 1) * bits <= 62:
        longer = text.astype(np.int64) << (depth * bits)
        longer[:-1] |= np.where(text[:-1] > 0, key[1:], 0)
        key, depth = longer, depth + 1
    order = np.argsort(key)
    ordered = key[order]
    # a window that meets the end of its text holds a zero digit: equal ones go by their place
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ordered[1:] != ordered[:-1]
    ended = np.zeros(n, bool)
    for i in range(min(depth, n)):
        ended[:n - i] |= text[i:] == 0
    tied = np.flatnonzero((~fresh[:-1] | ~fresh[1:]) & ended[order])
    if len(tied):
        first = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
        by_place = np.lexsort((order[tied], first[tied]))
        order[tied] = order[tied][by_place]
        fresh[tied] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:n], np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~fresh[:-1] | ~fresh[1:])
        if not len(tied):
            return order
        # the first ``depth`` words are equal and hold no end, so the place behind them exists
        both = rank[order[tied]] * n + rank[order[tied] + depth]
        sub = np.argsort(both)
        order[tied] = order[tied][sub]
        both = both[sub]
        fresh[tied[1:]] |= both[1:] != both[:-1]
        held = order[tied]
        rank[held] = tied[np.maximum.accumulate(np.where(fresh[tied], np.arange(len(tied)), 0))]
        depth *= 2


class Bits:
    """Bit rows with the number of ones before every 64-bit block."""

    def __init__(self, blocks: np.ndarray) -> None:
        self.blocks = blocks
        counts = np.bitwise_count(blocks).astype(np.int64)
        self.before = np.cumsum(counts, axis=-1) - counts

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, bitorder="little")
        # one block more, so that the rank at the end has a block to look at
        return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(_U)

    def at(self, row, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before ``i`` in a bit row, and the bit at ``i``."""
        block, shift = i >> 6, (i & 63).astype(_U)
        word = self.blocks[row][block] if row is not None else self.blocks[block]
        ones = (self.before[row] if row is not None else self.before)[block] + np.bitwise_count(word & ((_U(1) << shift) - _U(1)))
        return ones, (word >> shift & _U(1)).astype(np.int64)


class FMIndex:
    """Index of some texts; ``dump`` and ``load`` keep it as byte strings."""

    FIELDS = ("vocab", "starts", "levels", "marks", "samples", "heads")

    def __init__(self, vocab, starts, levels, marks, samples, heads) -> None:
        self.vocab, self.starts, self.samples, self.heads = vocab, starts, samples, heads
        self.n = int(starts[-1])
        self.levels, self.marks = Bits(levels), Bits(marks)
        self.zeros = [self.n - int(np.bitwise_count(row).sum()) for row in levels]
        # where the run of every word begins below the last bit row
        self.bottom = self._descend(np.arange(len(starts) - 1), np.zeros(len(starts) - 1, np.int64))

    @classmethod
    def build(cls, texts: list[np.ndarray]) -> FMIndex:
        """``texts``: word hashes of each text, none of them empty."""
        words = np.concatenate(texts)
        codes, vocab = pd.factorize(words)
        order = np.argsort(vocab)
        number = np.empty(len(vocab), np.int64)
        number[order] = np.arange(1, len(vocab) + 1)
        sizes = np.array([len(t) for t in texts])
        heads = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(len(words) + len(texts), np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)] = number[codes]
        bits = int(len(vocab)).bit_length()
        places = suffix_order(text, bits)
        column = text[places - 1].astype(np.uint32)
        column[places == 0] = 0
        levels = []
        for level in range(bits - 1, -1, -1):
            bit = (column >> np.uint32(level) & np.uint32(1)).astype(bool)
            levels.append(Bits.pack(bit))
            column = np.concatenate([column[~bit], column[bit]])
        sampled = np.zeros(len(text), bool)
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sampled[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)] = within % SAMPLE == 0
        marked = sampled[places]
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(vocab) + 1))])
        return cls(vocab[order], starts, np.stack(levels), Bits.pack(marked), places[marked], heads)

    def dump(self) -> dict[str, bytes]:
        return {"vocab": self.vocab.tobytes(), "starts": self.starts.astype(np.int64).tobytes(), "levels": self.levels.blocks.tobytes(),
                "marks": self.marks.blocks.tobytes(), "samples": self.samples.astype(np.int32).tobytes(), "heads": self.heads.astype(np.int64).tobytes()}

    @classmethod
    def load(cls, held: dict[str, bytes]) -> FMIndex:
        view = lambda name, kind: np.frombuffer(held[name], kind)
        marks = view("marks", _U)
        return cls(view("vocab", _U), view("starts", np.int64), view("levels", _U).reshape(-1, len(marks)), marks,
                   view("samples", np.int32).astype(np.int64), view("heads", np.int64))

    def _descend(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, zeros in enumerate(self.zeros):
            bit = word >> (len(self.zeros) - 1 - k) & 1
            ones, _ = self.levels.at(k, i)
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i

    def back(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row, at or behind row ``i``'s, of the suffixes that begin with ``word`` and go on like it."""
        return self._descend(word, i) - self.bottom[word] + self.starts[word]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of word hashes) that occur, with their range of rows [low, high)."""
        at = np.searchsorted(self.vocab, phrases)
        at[at == len(self.vocab)] = 0
        known = (self.vocab[at] == phrases).all(axis=1)
        live, words = np.flatnonzero(known), at[known] + 1
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            ends = self.back(np.concatenate([words[:, j]] * 2), np.concatenate([low, high]))
            low, high = ends[:len(live)], ends[len(live):]
            some = low < high
            live, words, low, high = live[some], words[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in ``rows``."""
        out, steps = np.empty(len(rows), np.int64), 0
        here = np.arange(len(rows))
        while len(here):
            before, marked = self.marks.at(None, rows)
            done = marked == 1
            out[here[done]] = self.samples[before[done]] + steps
            here, rows = here[~done], rows[~done]
            i, word = rows, np.zeros(len(rows), np.int64)
            for k, zeros in enumerate(self.zeros):
                ones, bit = self.levels.at(k, i)
                i = np.where(bit == 1, zeros + ones, i - ones)
                word = word << 1 | bit
            rows = i - self.bottom[word] + self.starts[word]
            steps += 1
        return out

    def occurrences(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, text and place in the text of every occurrence; texts are numbered as they were given."""
        live, low, high = self.count(phrases)
        sizes = high - low
        which = np.repeat(live, sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        places = self.locate(rows)
        text = np.searchsorted(self.heads, places, "right") - 1
        return which, text, places - self.heads[text]
