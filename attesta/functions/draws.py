"""Draws of whole numbers that any engine can repeat: products modulo the prime 2^31 - 1, which fit 64 bits.

A repetition has a multiplier and an offset of its own. Slots are mapped by them and raised to the fifth power, which
permutes the numbers below the prime; a draw of n is the part of the way to the prime that the number has come.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

PRIME = (1 << 31) - 1
#: Fixed parameters of the mapping.
REP, SEED, BASE, STEP, PART = 40692, 48271, 12345, 69621, 39373
#: Slots that are mapped in one go, so that they stay in a core's cache, and draws that are counted in one go.
CHUNK, COUNTED = 1 << 14, 1 << 20

_31, _P, _1 = np.uint64(31), np.uint64(PRIME), np.uint64(1)


def seed_of(seed) -> int:
    """A whole number for a seed of any kind."""
    return (seed if isinstance(seed, int) else zlib.crc32(str(seed).encode())) % PRIME * SEED % PRIME


def keys(rep: int, seed, part: int = 0) -> tuple[int, int]:
    """The multiplier and the offset of a repetition, and of a numbered part of it."""
    a = pow((rep * REP + seed_of(seed) + BASE) % PRIME, 5, PRIME)
    if part:
        a = pow((a + part * PART) % PRIME, 5, PRIME)
    return 1 + a % (PRIME - 1), pow((a + STEP) % PRIME, 5, PRIME)


def _fold(x: np.ndarray) -> np.ndarray:
    """Smaller by 31 bits, the same modulo the prime."""
    high = x >> _31
    x &= _P
    x += high
    return x


def numbers(m, b, slots: np.ndarray) -> np.ndarray:
    """A number below the prime for each slot (unsigned, below the prime); ``m`` and ``b`` are one pair of keys or arrays."""
    x = slots * np.asarray(m, np.uint64)
    x += np.asarray(b, np.uint64)
    x = _fold(x)
    y = _fold(_fold(x * x))
    y *= y
    y = _fold(y)
    y *= x
    y = _fold(_fold(y))
    y += _1  # what is the prime itself becomes 0
    y = _fold(y)
    y -= _1
    return y


def _counted(m: int, b: int, n: int, drawn: int) -> np.ndarray:
    """How often each of n, at most 2^32, is drawn in ``drawn`` draws with replacement."""
    out = None
    for start in range(0, drawn, COUNTED):
        found = np.empty(min(COUNTED, drawn - start), np.int64)
        for s in range(0, len(found), CHUNK):
            e = min(s + CHUNK, len(found))
            x = numbers(m, b, np.arange(start + s, start + e, dtype=np.uint64))
            x *= np.uint64(n)
            found[s:e] = x >> _31
        counts = np.bincount(found, minlength=n)
        out = counts if out is None else out + counts
    return np.zeros(n, np.int64) if out is None else out


#: Numbers of a range. A draw of more is split: binomial numbers, from the top of a tree of ranges down, say how many of
#: the draws fall into each; those of a range are then drawn by themselves, and no other range need be looked at.
BLOCK = 1 << 18


def multinomial(rep: int, seed, n: int, block: int = BLOCK) -> np.ndarray:
    """How often each of n is drawn in n draws with replacement: all ranges of ``block`` numbers, one after another."""
    totals = range_totals([rep], seed, n, 0, -(-n // block), block)[0].tolist()
    return np.concatenate([np.zeros(0, np.int64), *(range_counts(rep, seed, n, i, t, block) for i, t in enumerate(totals))])


def range_counts(rep: int, seed, n: int, i: int, total: int, block: int = BLOCK) -> np.ndarray:
    """How often each number of range ``i`` is drawn, where ``total`` of the draws fall into it."""
    return _counted(*keys(rep, seed, i), min(block, n - i * block), total)


def part_counts(rep: int, seed, n: int, begin: int, count: int) -> np.ndarray:
    """How often each of ``count`` numbers from ``begin`` on is drawn in n draws of n, none of them split: as the SQL draws."""
    m, b = keys(rep, seed)
    out, kept, held = np.zeros(count, np.int64), [], 0
    for start in range(0, n, CHUNK):
        x = numbers(m, b, np.arange(start, min(start + CHUNK, n), dtype=np.uint64))
        x *= np.uint64(n)
        x >>= _31
        x -= np.uint64(begin)  # what lies before wraps around
        x = x[x < np.uint64(count)] if count < n else x
        kept.append(x.astype(np.int64))
        held += len(x)
        if held >= COUNTED or start + CHUNK >= n:
            found = np.concatenate(kept)
            if 4 * held < count:
                np.add.at(out, found, 1)
            else:
                out += np.bincount(found, minlength=count)
            kept, held = [], 0
    return out


def range_totals(reps, seed, n: int, first: int, last: int, block: int = BLOCK) -> np.ndarray:
    """For each repetition how many of its n draws fall into each of the ranges ``first`` to ``last`` - 1."""
    out = np.zeros((len(reps), max(last - first, 0)), np.int64)
    stack = [(1, 0, -(-n // block), np.full(len(reps), n, np.int64))]
    while stack:
        node, low, high, drawn = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            out[:, low - first] = drawn
            continue
        mid = (low + high) // 2
        whole = min(high * block, n) - low * block
        of = [keys(r, seed, -node) for r in reps]
        under = binomial(drawn, (mid - low) * block / whole, np.array([k[0] for k in of], np.uint64), np.array([k[1] for k in of], np.uint64))
        stack += [(2 * node, low, mid, under), (2 * node + 1, mid, high, drawn - under)]
    return out


def uniform(m: np.ndarray, b: np.ndarray, slot: int) -> np.ndarray:
    """A number of 62 bits between 0 and 1, both left out, for each pair of keys."""
    high, low = (numbers(m, b, np.full(len(m), 2 * slot + i, np.uint64)).astype(np.float64) for i in (0, 1))
    return (high * PRIME + low + 0.5) / (float(PRIME) * PRIME)


def _tail(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves out of log x!, by its series from x = 10 on, by a table below."""
    z = 1 / (x + 1)
    series = (1 / 12 - (1 / 360 - z * z / 1260) * z * z) * z
    return np.where(x < 10, _TAILS[np.minimum(x, 10).astype(np.int64)], series)


#: log x! - (x + 1/2) log (x + 1) + (x + 1) - log(2 pi) / 2 for x up to 10.
_TAILS = np.array([math.lgamma(x + 1) - (x + 0.5) * math.log(x + 1) + (x + 1) - math.log(2 * math.pi) / 2 for x in range(11)])


def binomial(n: np.ndarray, p: float, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A binomial number for each of ``n`` trials of chance ``p``, from the uniform numbers of its keys.

    Few expected successes: the distribution is summed up to the uniform number. Many: transformed rejection with
    squeezes (Hoermann 1993), which takes about 1.2 pairs of uniform numbers at any size.
    """
    if p > 0.5:
        return n - binomial(n, 1 - p, m, b)
    out = np.zeros(len(n), np.int64)
    small = np.flatnonzero(n * p < 10)
    if len(small):
        u, k = uniform(m[small], b[small], 0), np.zeros(len(small))
        chance = np.exp(n[small] * math.log1p(-p))
        left = u - chance
        while (open_ := (left > 0) & (k < n[small])).any():
            chance = np.where(open_, chance * (n[small] - k) / (k + 1) * (p / (1 - p)), chance)
            k, left = np.where(open_, k + 1, k), np.where(open_, left - chance, left)
        out[small] = k
    todo, slot = np.flatnonzero(n * p >= 10), 0
    while len(todo):
        size = n[todo].astype(np.float64)
        spread = np.sqrt(size * p * (1 - p))
        wide = 1.15 + 2.53 * spread
        a = -0.0873 + 0.0248 * wide + 0.01 * p
        u, v = uniform(m[todo], b[todo], slot) - 0.5, uniform(m[todo], b[todo], slot + 1)
        edge = 0.5 - np.abs(u)
        k = np.floor((2 * a / edge + wide) * u + size * p + 0.5)
        inside = (k >= 0) & (k <= size)
        sure = inside & (edge >= 0.07) & (v <= 0.92 - 4.2 / wide)
        k = np.clip(k, 0, size)
        mode, odds = np.floor((size + 1) * p), p / (1 - p)
        height = np.log(v * (2.83 + 5.1 / wide) * spread / (a / (edge * edge) + wide))
        chance = (mode + 0.5) * np.log((mode + 1) / (odds * (size - mode + 1))) + (size + 1) * np.log1p((k - mode) / (size - k + 1))
        chance += (k + 0.5) * np.log(odds * (size - k + 1) / (k + 1)) + _tail(mode) + _tail(size - mode) - _tail(k) - _tail(size - k)
        taken = sure | (inside & (height <= chance))
        out[todo[taken]] = k[taken].astype(np.int64)
        todo, slot = todo[~taken], slot + 2
    return out


#: 2^31 - 1 times the chance that a Poisson number of mean 1 is at most 0, 1, 2, ...
_STEPS = (np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)])) * PRIME).astype(np.uint64)


def poisson(rep: int, seed, slots: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A Poisson weight of mean 1 for each pair of slots."""
    m, b = keys(rep, seed)
    mixed = numbers(m, b, slots.astype(np.uint64)) ^ more.astype(np.uint64)
    return np.searchsorted(_STEPS, numbers(m, b, mixed % _P), "right")


def keys_sql(reps: int, seed) -> str:
    """DuckDB: a query for (rep, m, b)."""
    fifth = lambda x, y: f"{x} * {x} % {PRIME} as {y}2, {y}2 * {y}2 % {PRIME} as {y}4, {y}4 * {x} % {PRIME} as {y}"
    return f"select rep, 1 + a % {PRIME - 1} as m, b from (select rep, (rep * {REP} + {seed_of(seed)} + {BASE}) % {PRIME} as z, {fifth('z', 'a')}, (a + {STEP}) % {PRIME} as w, {fifth('w', 'b')} from range({reps}) r(rep))"


def draws_sql(keys: str, n: str) -> str:
    """DuckDB: a query for (rep, idx), the n draws of each repetition; ``n`` is a scalar expression."""
    return f"select rep, x4 * p % {PRIME} * {n} // {PRIME + 1} as idx from (select rep, (slot * m + b) % {PRIME} as p, p * p % {PRIME} as x2, x2 * x2 % {PRIME} as x4 from ({keys}) k, range({n}) s(slot))"
