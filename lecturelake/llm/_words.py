"""Word and byte sequences as numpy arrays: splitting, 64-bit identities, rolling windows."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_JOIN = 0xA0761D6478BD642F
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def _byte_set(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Bytes of words that white space parts, and of words of letters, digits and everything beyond ASCII.
SPACE_WORDS = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
PLAIN_WORDS = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps)
    return have[: n + 1]


_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a finaliser of shifts and odd multiplications)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit codes, modulo 2**64.

    Stretches that differ can be made to collide (a Thue-Morse sequence and its complement do, whatever the codes are),
    so these hashes only route: equal stretches have equal hashes, and a collision costs time, never correctness.
    Identities come from ``windows``, ``folded`` and ``stretches``.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(codes * powers(n, _BASE)[:n], out=self.sums[1:])
        self.back = powers(n, _INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.back[starts]
        h += (ends - starts).astype(np.uint64) * U64(_STEP)
        return mix(h)

    def windows(self, k: int) -> np.ndarray:
        """Hash of every stretch of k codes."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        h = self.sums[k:] - self.sums[: n - k + 1]
        h *= self.back[: n - k + 1]
        h += U64(k * _STEP % 2**64)
        return mix(h)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identity of two parts from theirs. Mixing isn't linear, so no sum of parts can cancel."""
    return mix(left * U64(_JOIN) + right)


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit identity of every stretch of k codes, put together from halves."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    whole, have = codes, 1
    for bit in bin(k)[3:]:
        whole = joined(whole[: len(whole) - have], whole[have:])
        have *= 2
        if bit == "1":
            whole = joined(whole[: n - have], codes[have:])
            have += 1
    return whole


def folded(rows: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each row of a matrix of codes."""
    out = np.full(len(rows), rows.shape[1] * _STEP % 2**64, np.uint64)
    for column in rows.T:
        out = joined(out, column)
    return out


def stretches(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identity of stretches of any length of 64-bit codes, or of bytes (eight or more each): the sum of their codes, each mixed with its place."""
    size = (ends - starts).astype(np.int64)
    if codes.dtype == np.uint8:
        held, step = eights(codes), 8
        n = -(-size // 8)
    else:
        held, step, n = codes, 1, size
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    place = np.arange(off[-1]) - np.repeat(off[:-1], n)
    at = np.repeat(starts, n) + place * step
    if step > 1:
        at = np.minimum(at, np.repeat(ends, n) - step)  # the last block ends where its stretch ends
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(held[at] ^ mix((place + 1).astype(np.uint64) * U64(_STEP))))))
    return mix(sums[off[1:]] - sums[off[:-1]] + size.astype(np.uint64) * U64(_STEP))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), "<u8", padded.data, strides=(1,))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in each text; a word never spans two texts. Third: the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit identity of each word's bytes, A-Z lower-cased on request; words of one length up to eight bytes never collide."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        data = LOWER[data]
    blocks, size = eights(data), ends - starts
    code = mix((blocks[starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * U64(_STEP)))
    done, more = 8, np.flatnonzero(size > 8)
    while len(more) and done < 64:
        code[more] = joined(code[more], blocks[starts[more] + done] & _MASKS[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    for i in more.tolist():
        code[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each stretch of ``width`` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
