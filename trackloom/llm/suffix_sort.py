"""Deep-shallow sorting of suffixes that are compared over a limited length.

Shallow: multikey partitioning, eight bytes a step, on all suffixes at once; suffixes alone in their
segment are finished. Deep: what still shares the first ``SHALLOW`` bytes is put in order by blind tries, which look at branching
bytes on the way down and compare a new suffix with a single leaf. A trie of two leaves is one comparison, made for all pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHALLOW = 32


class BlindTrie:
    """Suffixes of equal length below a common depth; equal ones share a leaf."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.leaves: list[list[int]] = []
        #: A leaf is ~number; an inner node is [depth, {byte: node}].
        self.root: list | int | None = None

    def add(self, k: int) -> None:
        text = self.texts[k]
        if self.root is None:
            self.root = ~0
            self.leaves.append([k])
            return
        node, path = self.root, []
        while not isinstance(node, int):
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        leaf = self.leaves[~node]
        other = self.texts[leaf[0]]
        if other == text:
            leaf.append(k)
            return
        n = len(text)
        depth = n - 1 - ((int.from_bytes(text, "big") ^ int.from_bytes(other, "big")).bit_length() - 1) // 8
        self.leaves.append([k])
        new = ~(len(self.leaves) - 1)
        above, below = None, self.root
        for step in path:
            if step[0] > depth:
                break
            above, below = step, step[1].get(text[step[0]])
            if step[0] == depth:
                step[1][text[depth]] = new
                return
        branch = [depth, {other[depth]: below, text[depth]: new}]
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def ordered(self) -> Iterator[list[int]]:
        """Leaves in lexicographic order."""
        todo = [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                yield self.leaves[~node]
            else:
                todo.extend(child for _, child in sorted(node[1].items(), reverse=True))


def equal_groups(data: bytes, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Index arrays of suffixes that agree in their first ``length`` bytes, in order; lone suffixes are left out.

    ``data`` has at least ``length`` bytes from each start; ``length`` is at least ``SHALLOW``.
    """
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    order, segment = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        keys = words[starts[order] + depth].astype(np.uint64)
        by = np.lexsort((keys, segment))
        order, segment, keys = order[by], segment[by], keys[by]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (segment[1:] != segment[:-1])
        lone = new & np.append(new[1:], True)
        segment = np.cumsum(new)
        order, segment = order[~lone], segment[~lone]
    if not len(order):
        return
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    size = np.diff(np.append(first, len(order)))
    # Tries of two leaves.
    pairs = first[size == 2]
    offsets = np.arange(SHALLOW, length)
    for at in range(0, len(pairs), 1 << 14):
        a, b = order[pairs[at:at + (1 << 14)]], order[pairs[at:at + (1 << 14)] + 1]
        same = (padded[starts[a][:, None] + offsets] == padded[starts[b][:, None] + offsets]).all(axis=1)
        yield from np.stack([a[same], b[same]], axis=1)
    for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        members = order[f:f + n]
        trie = BlindTrie([data[s + SHALLOW:s + length] for s in starts[members].tolist()])
        for k in range(n):
            trie.add(k)
        yield from (members[leaf] for leaf in trie.ordered() if len(leaf) > 1)


def repeated(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix agrees with another one in its first ``length`` bytes."""
    out = np.zeros(len(starts), bool)
    for group in equal_groups(data, starts, length):
        out[group] = True
    return out
