"""Word and shingle hashes of whole Arrow string batches, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, ASCII letters lower-cased.
A word's hash joins two polynomials over its bytes, modulo two primes of 31 bits, taken
from running sums over the batch, so no Python object is made per word. Modulo a power of two
such a sum has words that collide for every base; modulo a prime, two words
of n bytes collide for at most n bases of 2**31.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]                      # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Two primes below 2**31 with a base and its inverse for each.
_MODULI = [(2147483647, 1481840749), (2147483629, 1913547023)]
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2
#: Bytes whose products with powers can be added up without a remainder: 2**8 * 2**31 * 2**24 < 2**64.
_PLAIN = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_of(b: int, p: int, n: int) -> np.ndarray:
    """b**0 .. b**(n-1) modulo p, by doubling."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * _U(pow(b, k, p)) % _U(p)
        k += m
    return out


def _powers(n: int):
    """For each modulus, n powers at least of its base and of the inverse."""
    global _POWERS
    if len(_POWERS[0][0]) < n:
        made = [(_powers_of(b, p, n), _powers_of(pow(b, -1, p), p, n)) for p, b in _MODULI]
        if n > 1 << 22:                           # one very long text: do not keep it
            return made
        _POWERS = made
    return _POWERS


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def runs(off: np.ndarray, most: int = 1 << 20):
    """Consecutive row ranges of at most ``most`` bytes each (one row at least)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


#: Bytes that part words when punctuation is ignored: ASCII without letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(raw: np.ndarray, off: np.ndarray, parts: np.ndarray = _SPACE, cuts: np.ndarray | None = None):
    """(hash of each word, first byte, end byte, first word of each row + total).

    ``parts`` marks the bytes between words, ``cuts`` places where a word
    begins although none of those bytes is before it."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    space = parts[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True                                # a row begins here
    if cuts is not None:
        cut[cuts] = True
    solid = ~space
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    begin = np.flatnonzero(solid & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    end = np.flatnonzero(solid & (after | cut[1:])) + 1
    both = []
    value = _BYTE[raw]
    for (p, _), (up, down) in zip(_MODULI, _powers(n + 1)):
        total = np.zeros(n + 1, np.uint64)
        terms = value * up[:n]
        if n > _PLAIN:
            terms %= _U(p)
        np.cumsum(terms, out=total[1:])
        both.append((total[end] - total[begin]) % _U(p) * down[begin] % _U(p))
    h = mix(mix(both[0] << _U(31) | both[1]) + (end - begin).astype(np.uint64))
    return h, begin, end, np.searchsorted(begin, off)


def shingle_hashes(h: np.ndarray, first: np.ndarray, width: int):
    """Hashes of every ``width``-word shingle and the first shingle of each row.

    A row with fewer words (but one at least) gets its whole sequence as one.
    """
    count = np.diff(first)
    n = len(h)
    if n >= width:
        acc = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            acc += h[j:n - width + 1 + j] * _PLACE[j]
        row = np.repeat(np.arange(len(count)), count)
        whole = row[:n - width + 1] == row[width - 1:]
        full, owner = mix(acc[whole]), row[:n - width + 1][whole]
    else:
        full, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = mix(np.array([(h[first[r]:first[r + 1]] * _PLACE[:count[r]]).sum() for r in short])
                    + _PLACE[63] * count[short].astype(np.uint64))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        full = np.concatenate([full, extra])[order]
        owner = np.concatenate([owner, short])[order]
    return full, np.searchsorted(owner, np.arange(len(count) + 1))


def shingle_sets(arr: pa.Array, width: int):
    """Yield (row, sorted distinct shingle hashes) for every row of a string array."""
    raw, off = utf8(arr)
    for lo, hi in runs(off):
        o = off[lo:hi + 1]
        h, _, _, first = words(raw[o[0]:o[-1]], o - o[0])
        s, at = shingle_hashes(h, first, width)
        for r in range(hi - lo):
            yield lo + r, np.unique(s[at[r]:at[r + 1]])
