"""Deep-shallow sorting of fixed-width byte strings, with their longest common prefixes.

Multikey quicksort splits the strings by eight bytes at a time down to a shallow depth;
groups that still share a prefix there are ordered by blind tries, whose search looks
at branching bytes only and compares one string per insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Indexes of distinct strings of one width, in order.

    An inner node is [position, {byte: child}]; a leaf is the index of its string.
    """
    width = len(strings[0])
    number = [int.from_bytes(s, "big") for s in strings]
    root: list | int = 0
    for new in range(1, len(strings)):
        s, node = strings[new], root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        common = width - ((number[new] ^ number[node]).bit_length() + 7) // 8
        other = strings[node][common]
        parent, node = None, root
        while isinstance(node, list) and node[0] < common:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == common:
            node[1][s[common]] = new
            continue
        inner = [common, {other: node, s[common]: new}]
        if parent is None:
            root = inner
        else:
            parent[1][s[parent[0]]] = inner
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow_sort(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows sorted by group, then by bytes; ties in their given order.

    rows is an array of bytes whose width is a multiple of 8. lcp[i] is the common
    prefix of the i-th and the one before, -1 at the start of a group.
    """
    n, width = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    start = np.ones(n, bool)
    start[1:] = group[order][1:] != group[order][:-1]
    own_group = start.copy()
    for depth in range(min(shallow, width) // 8):
        segment = np.cumsum(start) - 1
        at = np.flatnonzero(np.bincount(segment)[segment] > 1)
        if not len(at):
            break
        members, seg = order[at], segment[at]
        key = words[members, depth]
        by = np.lexsort((key, seg))
        order[at], key = members[by], key[by]
        differs = np.zeros(len(at), bool)
        differs[1:] = (key[1:] != key[:-1]) & (seg[1:] == seg[:-1])
        start[at] |= differs
    bounds = np.append(np.flatnonzero(start), n)
    for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist(), strict=True):
        members = order[a:b]
        same: dict[bytes, list[int]] = {}
        for m in members.tolist():
            same.setdefault(rows[m].tobytes(), []).append(m)
        if len(same) > 1:
            strings = list(same)
            order[a:b] = [m for i in blind_trie_order(strings) for m in same[strings[i]]]
    lcp = np.full(n, -1, np.int64)
    for a in range(1, n, 8192):
        b = min(n, a + 8192)
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    lcp[own_group] = -1
    return order, lcp
