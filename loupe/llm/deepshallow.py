"""Deep-shallow suffix sorting of fixed-width suffixes within groups.

Multikey quicksort, over words of eight bytes and on all segments at a time,
orders the suffixes to a shallow depth. Segments that still hold different
suffixes there, which share a long prefix, go through a blind trie each: a
Patricia trie descended by single bytes, where one comparison with a leaf tells
the place of a new suffix.
"""

from __future__ import annotations

import numpy as np

from loupe.llm.common import runs


class BlindTrie:
    """Sorts distinct byte strings of one length."""

    def __init__(self) -> None:
        self._root: tuple | bytes | None = None  # inner node: (depth, children by byte)

    def add(self, s: bytes) -> None:
        if self._root is None:
            self._root = s
            return
        node = self._root
        while isinstance(node, tuple):  # blind: bytes between the depths aren't looked at
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        x = int.from_bytes(s) ^ int.from_bytes(node)
        if not x:
            return
        common = len(s) - (x.bit_length() + 7) // 8
        parent, node_in = None, self._root
        while isinstance(node_in, tuple) and node_in[0] < common:
            parent, node_in = node_in, node_in[1][s[node_in[0]]]
        if isinstance(node_in, tuple) and node_in[0] == common:
            node_in[1][s[common]] = s
            return
        new = (common, {node[common]: node_in, s[common]: s})
        if parent is None:
            self._root = new
        else:
            parent[1][s[parent[0]]] = new

    def ordered(self) -> list[bytes]:
        out, stack = [], [self._root] if self._root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.append(node)
        return out


def _words(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    padded = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    return padded.view(">u8").astype(np.uint64)


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int) -> np.ndarray:
    """The order of ``rows`` (suffixes as bytes) by group, then bytes; ``shallow``: words for the quicksort."""
    words = _words(rows)
    shallow = min(shallow, words.shape[1])
    order = np.argsort(group, kind="stable")
    starts, ends = runs(group[order])
    sizes = ends - starts
    live = sizes > 1
    at = np.flatnonzero(np.repeat(live, sizes))  # places in the order that aren't settled
    seg = np.repeat(np.arange(live.sum()), sizes[live])
    depth = np.zeros(len(at), np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    n_deep = 0
    while len(at):
        w = words[order[at], depth]
        starts, ends = runs(seg)
        three = np.stack([w[starts], w[(starts + ends) // 2], w[ends - 1]])
        pivot = np.repeat(np.sort(three, 0)[1], ends - starts)
        side = (w > pivot).astype(np.int64) + (w >= pivot)
        key = seg * 3 + side
        by = np.argsort(key, kind="stable")
        order[at] = order[at[by]]
        key, depth = key[by], depth[by] + (side[by] == 1)
        starts, ends = runs(key)
        sizes = ends - starts
        done = depth[starts] >= shallow
        if (far := done & (sizes > 1)).any():
            which = np.repeat(far, sizes)
            deep.append((at[which], np.repeat(np.arange(far.sum()), sizes[far]) + n_deep))
            n_deep += int(far.sum())
        live = ~done & (sizes > 1)
        which = np.repeat(live, sizes)
        at, depth = at[which], depth[which]
        seg = np.repeat(np.arange(live.sum()), sizes[live])
    if deep and shallow < words.shape[1]:
        _deep(order, rows, words, np.concatenate([a for a, _ in deep]), np.concatenate([s for _, s in deep]), shallow)
    return order


def _deep(order: np.ndarray, rows: np.ndarray, words: np.ndarray, at: np.ndarray, seg: np.ndarray, shallow: int) -> None:
    """Settle each segment of places ``at`` of ``order`` with a blind trie."""
    by = np.lexsort((at, seg))
    at, seg = at[by], seg[by]
    starts, ends = runs(seg)
    rest = words[order[at], shallow:]
    same = (rest == np.repeat(rest[starts], ends - starts, 0)).all(1)
    mixed = ~np.logical_and.reduceat(same, starts)
    tail = rows[:, shallow * 8 :]
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        places = at[a:b]
        items = order[places]
        equal: dict[bytes, list[int]] = {}
        for i in items.tolist():
            equal.setdefault(tail[i].tobytes(), []).append(i)
        trie = BlindTrie()
        for s in equal:
            trie.add(s)
        order[places] = [i for s in trie.ordered() for i in equal[s]]


def common_prefixes(order: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The common prefix, in bytes, of each suffix in order with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 14):
        j = min(i + (1 << 14), len(order))
        differ = rows[order[i:j]] != rows[order[i - 1 : j - 1]]
        first = differ.argmax(1)
        out[i:j] = np.where(differ[np.arange(j - i), first], first, rows.shape[1])
    return out
