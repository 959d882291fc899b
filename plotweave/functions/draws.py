"""Numpy kernel for tasks: the numbers of `scenario.uniform` for many texts at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

#: Texts that are hashed at once: enough to hide the cost of a numpy call, few enough for the cache.
CHUNK = 1 << 14
# Start, constants and shifts of md5 (RFC 1321).
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = ((1, 0), (5, 1), (3, 5), (7, 0))


def _block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """What md5 adds to the state for one block of 16 words, for as many texts as the words have columns."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        k = i // 16
        if k == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += _ADD[i]
        f += words[(_WORD[k][0] * i + _WORD[k][1]) % 16]
        turn = _TURN[k][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [a, b, c, d]


def ranges(n: int, size: int) -> list[tuple[int, int]]:
    """Ranges of about equal length, `size` at most, that cover 0 to `n`."""
    ends = np.linspace(0, n, -(-n // size) + 1).astype(int)
    return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


class Heads:
    """Texts that draws begin with, as rows of bytes."""

    def __init__(self, texts: pa.Array):
        own = texts.cast(pa.large_binary())
        offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        self.sizes = np.diff(offsets)
        longest = int(self.sizes.max(initial=0))
        data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        # every text's bytes and what follows them, which is then cleared
        near = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(longest + 1, np.uint8)), longest + 1)[offsets[:-1]]
        self.bytes = np.where(np.arange(longest + 1) < self.sizes[:, None], near, np.uint8(0))

    def uniform(self, of: np.ndarray, tails: list[str], which: np.ndarray) -> np.ndarray:
        """Numbers in [0, 1) from 52 bits of the md5 of head `of[i]` and tail `which[i]`."""
        if not len(of):
            return np.empty(0)
        # md5 closes a text with a bit, and its last block with the length in 8 bytes
        closed = [t.encode() + b"\x80" for t in tails]
        spans = np.array([len(t) for t in closed])
        letters = np.array([np.frombuffer(t.ljust(spans.max(), b"\0"), np.uint8) for t in closed]).T.copy()
        width = 64 * -(-(int(self.sizes.max()) + len(letters) + 8) // 64)
        if self.bytes.shape[1] < width:
            self.bytes = np.pad(self.bytes, ((0, 0), (0, width - self.bytes.shape[1])))
        return np.concatenate([self._chunk(of[i:j], letters, spans, which[i:j]) for i, j in ranges(len(of), CHUNK)])

    def _chunk(self, of: np.ndarray, letters: np.ndarray, spans: np.ndarray, which: np.ndarray) -> np.ndarray:
        text = self.bytes.take(of, axis=0)
        n, width = text.shape
        start, flat, row = self.sizes[of], text.reshape(-1), np.arange(n) * width
        place = row + start
        for letter in letters:
            flat[place] = letter.take(which)
            place += 1
        size = start + spans[which]
        blocks = (size + 71) >> 6
        flat.view("<u8")[(row >> 3) + (blocks << 3) - 1] = (size - 1) << 3
        words = np.ascontiguousarray(text.view("<u4").T)
        state = [np.full(n, x, np.uint32) for x in _START]
        for k in range(int(blocks.max())):
            more = _block(state, words[16 * k : 16 * k + 16])
            lasts = blocks > k
            for x, y in zip(state, more, strict=True):
                np.add(x, y, out=x, where=True if lasts.all() else lasts)
        high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
        return ((high << np.uint64(20)) | (low >> np.uint64(12))) / float(1 << 52)
