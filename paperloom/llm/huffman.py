"""Canonical length-limited Huffman codes for whole numbers, in numpy."""

from __future__ import annotations

import numpy as np

MOST_BITS = 16


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits of the code of each symbol, at most ``most_bits`` (more only where the symbols need it); 0 for
    symbols that do not occur. Package-merge, so no code within that limit is shorter."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    bits = max(most_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(bits):
        merged = np.concatenate([coins, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # whether each of the cheapest is a coin
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    found = np.zeros(n, np.int64)
    for is_coin in reversed(levels):
        coins_taken = int(is_coin[:take].sum())
        found[:coins_taken] += 1
        take = 2 * (take - coins_taken)
    lengths[order] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that belong to the lengths: by length, then by symbol."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        symbols = np.flatnonzero(lengths == length)
        code <<= length - last
        last = length
        codes[symbols] = np.arange(code, code + len(symbols), dtype=np.uint64)
        code += len(symbols)
    return codes


def pack(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the symbols, first bit highest, and the bit at which each symbol begins."""
    if not len(symbols):
        return b"", np.zeros(0, np.int64)
    size = lengths[symbols].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    code = codes[symbols]
    word, used = at >> 6, at & 63
    over = used + size - 64  # bits that belong to the next word
    left = code << np.maximum(0, -over).astype(np.uint64) >> np.maximum(0, over).astype(np.uint64)
    words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[first]] = np.bitwise_or.reduceat(left, first)
    split = np.flatnonzero(over > 0)
    words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at


class Decoder:
    """Decodes many streams side by side with one table of all windows of ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        symbols = np.flatnonzero(lengths)
        order = symbols[np.argsort(lengths[symbols], kind="stable")]  # canonical codes ascend in this order
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.int64)
        self.symbol[: spans.sum()] = np.repeat(order, spans)
        self.length[: spans.sum()] = np.repeat(lengths[order], spans)

    def __call__(self, data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbols of all streams, one after the other: each begins at a bit of ``data`` and has a number of symbols."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
        order = np.argsort(-counts, kind="stable")
        at, ends = at[order].copy(), np.cumsum(counts)
        place = (ends - counts)[order]
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        active = len(counts) - np.searchsorted(np.sort(counts), np.arange(int(counts.max(initial=0))), "right")
        for t, n in enumerate(active.tolist()):
            now = at[:n]
            code = (windows[now >> 3] << (now & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[place[:n] + t] = self.symbol[code]
            now += self.length[code]
        return out
