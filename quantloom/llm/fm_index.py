"""A compressed FM-index over many short word sequences, searched for all streamed sequences side by side.

The Burrows-Wheeler transform of the sequences' word numbers is a wavelet matrix of packed bits; a backward step (from
the matches of a sequence to those of the sequence with one more word in front) is two ranks on each level. It holds no
suffix array and no positions: matches are counted, not located. Suffixes are told apart by `limit` words and no
further, which is all that searches for up to `limit` words need; for each smaller length one bit a suffix says where
those begin that share so many words.

Matching statistics, cut off at `limit`, come from one backward step for each word. Once a match is as long as the limit,
its last word falls away by widening the interval to all suffixes that share the first `limit` words. Where no match goes
on, the interval is widened to fewer words, whose number is halved in on.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
ALL = np.uint64(2**64 - 1)
BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


def _packed(bit: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bit) // 64 * 8 + 16, np.uint8)
    raw = np.packbits(bit, bitorder="little")
    out[: len(raw)] = raw
    return out[: len(out) // 8 * 8].view(np.uint64)


class WaveletMatrix:
    """Rank over a sequence of numbers below 2**bits, in packed bits and a count for each 64 of them."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = _packed(bit)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.before.append(counts.astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of the sequence, of so many values, ends on the last level if only `symbol` is followed."""
        for k in range(self.bits):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & BELOW[at & 63])
            at = np.where(symbol & (1 << (self.bits - 1 - k)), self.zeros[k] + ones, at - ones)
        return at


class Borders:
    """For each length up to a limit, where runs of suffixes begin that share so many words: rows of packed bits, and for
    each 64 of them the last border in front and the first one from there on."""

    def __init__(self, shared: np.ndarray, limit: int):
        """shared: words that each suffix has in common with the one before it."""
        n = len(shared)
        self.words, self.left, self.right = [], [], []
        for length in range(limit + 1):
            bit = np.ones(n + 1, bool)
            np.less(shared[1:], length, out=bit[1:n])
            words = _packed(bit)
            filled = np.flatnonzero(words)
            at = np.searchsorted(filled, np.arange(len(words)))
            before, behind = filled[np.maximum(at - 1, 0)], filled[np.minimum(at, len(filled) - 1)]
            self.words.append(words)
            self.left.append((before * 64 + _highest(words[before])).astype(np.uint32))
            self.right.append((behind * 64 + _lowest(words[behind])).astype(np.uint32))
        self.words, self.left, self.right = np.stack(self.words), np.stack(self.left), np.stack(self.right)

    def around(self, at: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share so many words with the one at a place, as [first, end)."""
        word, nth = at >> 6, (at & 63).view(np.uint64)
        bits = self.words[length, word]
        own = bits & (ALL >> (np.uint64(63) - nth))
        first = np.where(own != 0, word * 64 + _highest(own), self.left[length, word].astype(np.int64))
        own = bits & (ALL << nth << ONE)
        end = np.where(own != 0, word * 64 + _lowest(own), self.right[length, word + 1].astype(np.int64))
        return first, end


def _highest(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(k)
    return np.bitwise_count(x).astype(np.int64) - 1


def _lowest(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + ONE)) - ONE).astype(np.int64)


class FMIndex:
    """Over sequences of word numbers (0 and up); a separator that nothing equals ends each. limit: the longest search."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, limit: int):
        self.limit, count = limit, len(bounds) - 1
        lengths = np.diff(bounds)
        n = int(bounds[-1] - bounds[0]) + count
        self.known, dense = np.unique(words, return_inverse=True)
        text = np.zeros(n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(count), lengths)] = dense + count  # separators come first in the order, each its own
        text[bounds[1:] - bounds[0] + np.arange(count)] = np.arange(count)
        # suffixes in order of their first `limit` words, by doubling
        rank, size, order = text, 1, np.argsort(text, kind="stable")
        while size < limit:
            further = min(size, limit - size)  # the last step goes to `limit` words and no further
            second = np.zeros(n, np.int64)
            second[: n - further] = rank[further:] + 1
            key = rank * (n + count + len(self.known) + 2) + second
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.ones(n, bool)
            np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            size += further
        shared = np.zeros(n, np.uint8)
        pairs = np.arange(1, n)
        for k in range(limit):
            x, y = order[pairs] + k, order[pairs - 1] + k  # a separator, which ends each sequence, stops them
            pairs = pairs[text[x] == text[y]]
            shared[pairs] += 1
        self.borders = Borders(shared, limit)
        previous = text[order - 1]
        self.n = n
        self.matrix = WaveletMatrix(np.where(previous >= count, previous - count + 1, 0), max(1, int(len(self.known)).bit_length()))
        first = count + np.concatenate(([0], np.cumsum(np.bincount(dense, minlength=len(self.known)))))  # where suffixes begin with each word
        self.base = first[: len(self.known)] - self.matrix.down(np.arange(1, len(self.known) + 1), np.zeros(len(self.known), np.int64))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The index's own numbers of words, -1 for those that it doesn't have."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at, -1)

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches [low, high) with a word (its own number, 0 or more) in front."""
        k = len(low)
        both = self.matrix.down(np.tile(word + 1, 2), np.concatenate((low, high)))
        return self.base[word] + both[:k], self.base[word] + both[k:]

    def statistics(self, words: np.ndarray, bounds: np.ndarray, least: int = 1) -> np.ndarray:
        """For each word of the streamed sequences the length, up to limit, of the longest match that begins with it.

        All sequences are streamed side by side, from their ends. least: lengths below it may be given as 0; a sequence
        is left once no match of that length can begin in what is left of it.
        """
        out = np.zeros(len(words), np.int32)
        if not len(words) or not len(self.known):
            return out
        numbers, limit = self.numbers(words), self.limit
        live = np.flatnonzero(np.diff(bounds) >= least)
        # of each stream: its first word, the next word p, and the match behind that: depth words, suffixes low..high. Where
        # it doesn't go on, `good` and `bad` of its words are known to do and not to do, the first giving suffixes glow..ghigh
        start, p = bounds[:-1][live], bounds[1:][live] - 1
        z = np.zeros(len(live), np.int64)
        low, high, depth, good, bad, glow, ghigh = z, z + self.n, z.copy(), z, z, z, z
        probing = np.zeros(len(live), bool)
        while len(p):
            word = numbers[p]
            if probing.any():
                aim = (good + bad) // 2
                from_low, from_high = self.borders.around(low, np.where(probing, aim, limit))
                from_low, from_high = np.where(probing, from_low, low), np.where(probing, from_high, high)
            else:
                aim, from_low, from_high = good, low, high
            new_low, new_high = self.step(np.maximum(word, 0), from_low, from_high)
            ok = (word >= 0) & (new_high > new_low)
            on = ok & ~probing  # the match goes on
            over = np.flatnonzero(on & (depth == limit))
            if len(over):
                new_low[over], new_high[over] = self.borders.around(new_low[over], limit)
            low, high, depth = np.where(on, new_low, low), np.where(on, new_high, high), np.where(on, np.minimum(depth + 1, limit), depth)
            if not on.all():
                none = ~probing & (word < 0)  # a word that the index doesn't have
                begin = ~probing & ~ok & ~none
                good, bad = np.where(begin, -1, np.where(probing & ok, aim, good)), np.where(begin, depth, np.where(probing & ~ok, aim, bad))
                glow, ghigh = np.where(probing & ok, new_low, glow), np.where(probing & ok, new_high, ghigh)
                done = probing & (good + 1 >= bad)
                low, high = np.where(done, glow, np.where(none, 0, low)), np.where(done, ghigh, np.where(none, self.n, high))
                depth = np.where(done, good + 1, np.where(none, 0, depth))
                probing = (probing | begin) & ~done
                on |= done | none
            out[p[on]] = depth[on]
            p = np.where(on, p - 1, p)
            # the longest match that may still begin at the next word, or at this one: good + 1 or more, bad or less
            left = (p >= start) & (np.where(probing, p + bad, p + 1 + depth) - least >= start)
            if not left.all():
                start, p, low, high, depth, good, bad, glow, ghigh, probing = (x[left] for x in (start, p, low, high, depth, good, bad, glow, ghigh, probing))
        return out
