"""The Damerau-Levenshtein metric (unrestricted transpositions), for many pairs at once."""

from __future__ import annotations

import numpy as np

from seriesloom.llm.chars import mix


BUCKETS = 32  # letters are counted by code point modulo this, which keeps the letters a-z apart


def encode(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths, letter counts) of names in any script."""
    width = max([len(n) for n in names] + [1])
    codes = np.zeros((len(names), width), np.int32)
    counts = np.zeros((len(names), BUCKETS), np.int16)
    for i, n in enumerate(names):
        c = np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.int32)
        codes[i, : len(c)] = c
        np.add.at(counts[i], c % BUCKETS, 1)
    return codes, np.array([len(n) for n in names], np.int64), counts


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``: insert, delete, replace, swap; a true metric.

    The transposition may span edits between the swapped letters (Lowrance and
    Wagner), which keeps the triangle inequality that pivots rely on.
    """
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    if not n:
        return np.zeros(0, np.int32)
    letters, places = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = places[: a.size].reshape(a.shape), places[a.size :].reshape(b.shape)
    rows = np.arange(n)
    big = wa + wb
    d = np.full((n, wa + 2, wb + 2), big, np.int32)
    d[:, 1:, 1] = np.arange(wa + 1)
    d[:, 1, 1:] = np.arange(wb + 1)
    last_row = np.zeros((n, len(letters)), np.int64)
    for i in range(1, wa + 1):
        last_col = np.zeros(n, np.int64)
        for j in range(1, wb + 1):
            r = last_row[rows, b[:, j - 1]]
            same = a[:, i - 1] == b[:, j - 1]
            best = np.minimum(d[:, i, j] + (~same).astype(np.int32), np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
            swap = d[rows, r, last_col] + (i - r - 1) + 1 + (j - last_col - 1)
            d[:, i + 1, j + 1] = np.minimum(best, swap)
            last_col = np.where(same, j, last_col)
        last_row[rows, a[:, i - 1]] = i
    return d[rows, la + 1, lb + 1]


def within(a: str, b: str, radius: int) -> int:
    """The distance of two names, or ``radius + 1`` if it is more; for long names, in time proportional to their length."""
    far = radius + 1
    if abs(len(a) - len(b)) > radius:
        return far
    rows = {-1: {}, 0: {j: j for j in range(min(radius, len(b)) + 1)}}
    for i in range(1, len(a) + 1):
        row = {0: i} if i <= radius else {}
        for j in range(max(1, i - radius), min(len(b), i + radius) + 1):
            best = rows[i - 1].get(j - 1, far) + (a[i - 1] != b[j - 1])
            best = min(best, rows[i - 1].get(j, far) + 1, row.get(j - 1, far) + 1)
            k = next((k for k in range(i - 1, max(i - radius, 1) - 1, -1) if a[k - 1] == b[j - 1]), 0)
            m = next((m for m in range(j - 1, max(j - radius, 1) - 1, -1) if b[m - 1] == a[i - 1]), 0)
            if k and m:
                best = min(best, rows.get(k - 1, {}).get(m - 1, far) + (i - k) + (j - m) - 1)
            row[j] = min(best, far)
        rows[i] = row
        rows.pop(i - radius - 2, None)
    return rows[len(a)].get(len(b), far)


def lower_bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least possible distances of all rows of ``x`` to all of ``y``, by letter counts."""
    more = np.zeros((len(x), len(y)), np.int16)
    less = np.zeros((len(x), len(y)), np.int16)
    for c in range(x.shape[1]):
        diff = x[:, c][:, None] - y[:, c][None, :]
        more += np.maximum(diff, 0)
        less += np.maximum(-diff, 0)
    return np.maximum(more, less)


def sub_spellings(names: list[str], deletions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the hash of each spelling left when up to ``deletions`` (at most two) letters are left out of a name.

    Names of one length are worked on together. A name of n letters has
    1 + n + n(n-1)/2 of them at two deletions; equal ones come once per name.
    """
    rows, keys = [], []
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(names):
        by_length.setdefault(len(n), []).append(i)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    for size, at in by_length.items():
        owner = np.array(at)
        letters = np.frombuffer("".join(names[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size).astype(np.uint64)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(size - 1, 0), base)])) if size else np.zeros(0, np.uint64)
        prefix = np.zeros((len(at), size + 1), np.uint64)
        np.cumsum(mix(letters + np.uint64(1)) * power[:size], axis=1, out=prefix[:, 1:])
        cut = lambda i: prefix[:, i] + (prefix[:, size] - prefix[:, i + 1]) * inverse
        found = [prefix[:, size]]
        if deletions >= 1:
            found += [cut(i) for i in range(size)]
        if deletions >= 2:
            found += [prefix[:, i] + (prefix[:, j] - prefix[:, i + 1]) * inverse + (prefix[:, size] - prefix[:, j + 1]) * inverse * inverse for i in range(size) for j in range(i + 1, size)]
        keys.append(np.concatenate(found))
        rows.append(np.tile(owner, len(found)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, key = np.concatenate(rows), np.concatenate(keys).view(np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
    return row[first], key[first]
