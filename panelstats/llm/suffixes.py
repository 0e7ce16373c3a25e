"""Deep-shallow sorting of suffixes, and which of them agree up to any depth.

Strings are sorted by multikey quicksort: three-way partitions by a few bytes at a time, down to a shallow depth.
Groups that still agree there have long common prefixes, and are put in order by a blind trie: a string is inserted
by looking at branching bytes only, compared once with the leaf it arrives at, and gets its branch where the two
differ first.  The leaves in order are the sorted group.
"""

from __future__ import annotations

import numpy as np

#: Bytes that a partition compares, and the depth at which blind tries take over.
STEP, SHALLOW = 4, 12


def common_prefix(a: bytes, b: bytes) -> int:
    """How many bytes two strings of equal length share."""
    differ = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings of equal length in a trie whose nodes know a depth and the branching bytes there."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: tuple[int, dict] | list[int] | None = None

    def add(self, at: int) -> None:
        """Insert the string at a place of the list."""
        if self.root is None:
            self.root = [at]
            return
        mine, node = self.strings[at], self.root
        while isinstance(node, tuple):  # blindly down to some leaf
            depth, children = node
            child = children.get(mine[depth])
            node = next(iter(children.values())) if child is None else child
        shared = common_prefix(mine, self.strings[node[0]])
        if shared == len(mine):
            node.append(at)
            return
        other = self.strings[node[0]][shared]
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            parent, node = node, node[1][mine[node[0]]]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][mine[shared]] = [at]
            return
        branch = (shared, {other: node, mine[shared]: [at]})
        if parent is None:
            self.root = branch
        else:
            parent[1][mine[parent[0]]] = branch

    def in_order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            elif node is not None:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], some: list[int] | None = None, depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Places of the strings (all of one length) in their order; those that agree up to ``depth`` may be given."""
    out: list[int] = []
    todo = [(list(range(len(strings))) if some is None else some, depth, False)]
    while todo:
        group, at, settled = todo.pop()
        if len(group) < 2 or settled:
            out.extend(group)
        elif at >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            out.extend(trie.in_order())
        else:
            keys = [strings[i][at : at + STEP] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, same, more = [], [], []
            for i, key in zip(group, keys, strict=True):
                (same if key == pivot else less if key < pivot else more).append(i)
            todo += [(more, at, False), (same, at + STEP, pivot == b""), (less, at, False)]
    return out


def agreement(strings: list[bytes], order: list[int]) -> np.ndarray:
    """Bytes that each string of a sorted list shares with the one before it (-1 for the first)."""
    shared = [-1, *(common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True))]
    return np.array(shared[: len(order)], np.int64)


def classes_by_depth(order: np.ndarray, shared: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For each string (row) and depth (column) a number that strings share if they agree up to the depth."""
    out = np.empty((len(order), len(depths)), np.int32)
    out[order] = np.cumsum(shared[:, None] < depths[None, :], axis=0, dtype=np.int32)
    return out
