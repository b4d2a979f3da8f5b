"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tomewright.llm.rolling import byte_chunks, mix

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.array([2 * k * k + 0x9E3779B97F4A7C15 for k in range(1, 65)], np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from eight bytes at a time with all bits
    mixed in between: unlike sums of powers modulo 2**64, it has no structure that
    regular texts could cancel."""
    n = (end - start).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(n * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    at, step = np.arange(len(n)), 0
    while len(at := at[n[at] > step]):
        left = n[at] - np.uint64(step)
        chunk = eight[start[at] + step]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * np.uint64(8))) - np.uint64(1)
        out[at] = mix(out[at] ^ mix(chunk + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9FB21C651E98DF25))
        step += 8
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text: of every ``words`` words in a
    row, A-Z lower-cased; of the whole where there are fewer; none without words."""
    for first, data, offsets in byte_chunks(column):
        word = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        each = word_hashes(_LOWER[data], start, end)
        n = max(len(each) - words + 1, 0)
        run = np.zeros(n, np.uint64)
        for k in range(words):
            run += each[k : k + n] * _ODD[k]
        run = mix(run + np.uint64(words))
        bounds = np.searchsorted(start, offsets)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= words:
                yield first + i, np.unique(run[a : b - words + 1])
            elif b > a:
                yield first + i, mix((each[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield first + i, run[:0]


def set_name(hashed: np.ndarray) -> tuple[int, int]:
    """A name of the set of 128 bits, as two signed numbers."""
    raw = hashlib.blake2b(hashed.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def parity_bits(hashed: np.ndarray) -> bytes:
    """Bit i: whether an odd number of hashes fall on i. Each element that two
    sets don't share turns over one bit, so the bits in which two signatures
    differ are never more than those elements. There are two to four bits for
    each element, 256 at least, a power of two."""
    bits = max(256, 1 << (2 * len(hashed) - 1).bit_length())
    odd = np.bincount((hashed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(signature: np.ndarray, size: int) -> np.ndarray:
    """A signature cut to ``size`` numbers of 64 bits: what it would be with so
    many bits. Both lengths are powers of two."""
    return signature if len(signature) == size else np.bitwise_xor.reduce(signature.reshape(-1, size))
