"""The common-prefix interval tree of a sparse enhanced suffix array, in one task.

The array holds, for each distinct context of an anchor, the bytes from the anchor on
(``right``) and the bytes before it (``left``).  A stack scan of the sorted right parts
gives the tree's intervals: runs of contexts with a common prefix that no wider run
has.  In each interval the same scan over the left parts, read backwards, gives the
runs with a common left extension; they are diverse on the left, as the scan takes the
longest extension, and diverse on the right if they do not lie in one child.  Such a run
is a maximal repeat with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, that have na and nb bytes."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all intervals of length ``least`` or more, inner ones
    first.  ``lcp[i]``: common prefix of sorted rows i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, now in enumerate([*lcp, -1]):
        begin = i
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            if length >= least:
                yield length, begin, i
        if not stack or stack[-1][0] < now:
            stack.append((now, begin))


def sort_key(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One value for each row that sorts as its bytes; rows are filled up with zeros, so
    the size tells a zero byte from the end."""
    tail = sizes.astype(">u4").view(np.uint8).reshape(-1, 4)
    key = np.ascontiguousarray(np.concatenate([rows, tail], axis=1))
    return key.view(f"V{key.shape[1]}").ravel()


def repeats(right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, left_key: np.ndarray,
            least: int, lcp: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of ``least`` bytes or more among the contexts of one anchor, as
    (bytes before the anchor, bytes from it on, members).  Rows are sorted by ``right``;
    ``left`` is stored backwards, ``left_key`` is its sort key; ``lcp``: common prefixes of neighbours in ``right``."""
    longest = int(n_left.max())
    for length, lo, hi in intervals(lcp.tolist(), least - longest):
        need = max(0, least - length)
        members = np.arange(lo, hi + 1)
        if hi - lo == 1:
            before = int(common(left[lo:lo + 1], n_left[lo:lo + 1], left[hi:hi + 1], n_left[hi:hi + 1])[0])
            if before >= need:
                yield before, length, members
            continue
        child = np.cumsum(np.concatenate([[0], lcp[lo:hi] == length]))
        by_left = np.argsort(left_key[lo:hi + 1], kind="stable")
        members, child = members[by_left], child[by_left]
        one, two = members[:-1], members[1:]
        shared = common(left[one], n_left[one], left[two], n_left[two])
        if shared.max() < need:
            continue
        capped = length == right.shape[1]  # as long as contexts are: no longer child
        for before, a, b in intervals(shared.tolist(), need):
            if capped or (child[a:b + 1] != child[a]).any():
                yield before, length, members[a:b + 1]
