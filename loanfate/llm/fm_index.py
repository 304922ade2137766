"""A compressed full-text index over sequences of words, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol in a sequence: one packed bit vector for each bit of a symbol.

    A level holds its bits in 64-bit words and the number of set bits before each of them; the
    symbols with a zero bit come first on the next level, both kinds in their order.
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.zeros(len(symbols) // 64 + 1, np.uint64)
            held = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[:len(held)] = held
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((packed, before, int(len(symbols) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places lead on the last level, for each symbol: rank plus the symbol's own start."""
        for k, (packed, before, zeros) in enumerate(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols from 1, separators 0), by prefix doubling.

    Separators differ from each other, the earlier being less, so sorting ends at the longest
    stretch between two of them.
    """
    n = len(text)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    width = 1
    # The first sort takes as many symbols at once as fit into 62 bits.
    bits = max(1, int(rank.max(initial=1)).bit_length())
    fit = max(1, 62 // bits)
    if fit > 1:
        key = np.zeros(n, np.int64)
        for k in range(fit):
            key <<= bits
            key[:max(0, n - k)] |= rank[k:]
        rank, width = key, fit
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        fresh = np.empty(n, np.int64)
        different = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        fresh[order] = different
        if not n or different[-1] == n - 1:
            return order
        rank = fresh << 32
        rank[:max(0, n - width)] |= fresh[width:]
        width *= 2


class FMIndex:
    """Backward search over sequences (lists of symbols from 1), each counted by its weight.

    Holds the Burrows-Wheeler transform of the sequences, with a separator behind each, in a
    wavelet matrix, and the summed weights of the suffixes in order. The suffix array is not kept.
    """

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, symbols: int) -> None:
        sizes = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.base = ends - sizes
        self.text = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
        if len(ends):
            inside = np.ones(len(self.text), bool)
            inside[ends] = False
            self.text[inside] = np.concatenate(sequences)
        order = suffix_order(self.text, ends)
        behind = self.text[order - 1]
        behind[order == 0] = 0
        self.wavelet = WaveletMatrix(behind, max(1, int(symbols).bit_length()))
        counts = np.bincount(self.text, minlength=symbols + 1)
        all_symbols = np.arange(symbols + 1)
        # What a step adds to the place on the last level: the symbol's first suffix, less its own start there.
        self.shift = np.cumsum(counts) - counts - self.wavelet.place(all_symbols, np.zeros(symbols + 1, np.int64))
        owner = np.searchsorted(ends, order, side="left")
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner])])

    def __len__(self) -> int:
        return len(self.text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``symbol`` before what the given intervals begin with."""
        both = self.wavelet.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[:len(symbol)] + shift, both[len(symbol):] + shift

    def repeated(self, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, first, last): starts of windows in the sequences that weigh ``least`` or more in all.

        The sequences are streamed against the index from their ends. The longest match that ends at
        a place settles all windows in it; where it breaks off, no window holds both the break and
        the place. What it leaves on either side is asked again from the middle. All searches go
        on step by step together.
        """
        sizes = np.diff(np.append(self.base, len(self.text))) - 1
        unit = np.flatnonzero(sizes >= window)
        first, last = np.zeros(len(unit), np.int64), sizes[unit] - window
        asked = last
        found: list[tuple[np.ndarray, ...]] = []
        state = self._asked(unit, first, last, asked, window)
        while len(state[0]):
            unit, first, last, asked, at, low, high = state
            low, high = self.extend(self.text[at], low, high)
            held = self.weight[high] - self.weight[low] >= least
            floor = self.base[unit] + first
            ended = ~held | (at <= floor)
            reached = (at + ~held - self.base[unit])[ended]
            u, x, y, m = unit[ended], first[ended], last[ended], asked[ended]
            go = ~ended
            state = (unit[go], first[go], last[go], asked[go], at[go] - 1, low[go], high[go])
            if len(u):
                hit = reached <= m
                found.append((u[hit], reached[hit], m[hit]))
                # On the left of the match, or of the place asked; on the right of that place, or of the break.
                left = np.where(hit, reached - 1, m - 1)
                right = np.where(hit, m + 1, reached)
                new_unit = np.concatenate([u, u])
                new_first, new_last = np.concatenate([x, right]), np.concatenate([left, y])
                some = new_first <= new_last
                a, b = new_first[some], new_last[some]
                fresh = self._asked(new_unit[some], a, b, (a + b) // 2, window)
                state = tuple(np.concatenate(pair) for pair in zip(state, fresh))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _asked(self, unit, first, last, asked, window) -> tuple[np.ndarray, ...]:
        low = np.zeros(len(unit), np.int64)
        return unit, first, last, asked, self.base[unit] + asked + window - 1, low, low + len(self.text)
