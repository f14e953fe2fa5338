"""Seeded random draws, ranks of an MD5 digest, of all pairs of two lists of strings at once."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_CELLS = 1 << 16


def _compress(state: list, words: list, rows: int, columns: int, last: bool) -> list:
    """One block of MD5 for a grid of messages; states and words broadcast to the grid, a word None is 0.

    Of the last block only the first word of the digest is computed, which needs 61 of 64 steps.
    """
    a, b, c, d = (np.array(np.broadcast_to(x, (rows, columns)), np.uint32) for x in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        word = words[at]
        if word is None:
            f += np.uint32(_SINES[i])
        elif word.size < f.size:
            f += word + np.uint32(_SINES[i])
        else:
            f += word
            f += np.uint32(_SINES[i])
        f += a
        left = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(left), out=g)
        f >>= np.uint32(32 - left)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    if last:
        return [b + state[0]]  # what the next turns would move to the first place
    return [a + state[0], b + state[1], c + state[2], d + state[3]]


def _words(texts: list[bytes], at: int, blocks: int, ended: bool) -> np.ndarray:
    """(texts, 16 * blocks) words of messages that hold the texts from byte `at` on; with `ended` the end mark follows."""
    out = np.zeros((len(texts), 64 * blocks), np.uint8)
    for i, t in enumerate(texts):
        out[i, at : at + len(t)] = np.frombuffer(t, np.uint8)
        if ended:
            out[i, at + len(t)] = 0x80
    return out.view("<u4").astype(np.uint32)


def _classes(texts: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def first_words(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """(heads, tails) uint32: the first 8 hexadecimal digits of md5(head + tail) as a number, so in the order of the digests.

    Messages of equal lengths of head and of tail are computed together, word by word of the algorithm.
    """
    out = np.empty((len(heads), len(tails)), np.uint32)
    for h, rows in _classes(heads).items():
        for t, columns in _classes(tails).items():
            blocks = (h + t + 8) // 64 + 1
            head = _words([heads[i] for i in rows], 0, blocks, False)
            tail = _words([tails[i] for i in columns], h, blocks, True)
            bits = (h + t) * 8
            tail[:, -2], tail[:, -1] = bits & 0xFFFFFFFF, bits >> 32
            step = max(1, _CELLS // len(columns))
            for lo in range(0, len(rows), step):
                part = head[lo : lo + step]
                state: list = [np.uint32(x) for x in _START]
                for b in range(blocks):
                    words: list = []
                    for w in range(16 * b, 16 * b + 16):
                        x, y = part[:, w, None], tail[None, :, w]
                        some = x.any(), y.any()
                        words.append((x | y) if all(some) else x if some[0] else y if some[1] else None)
                    state = _compress(state, words, len(part), len(columns), b == blocks - 1)
                out[np.ix_(rows[lo : lo + step], columns)] = state[0].byteswap()
    return out
