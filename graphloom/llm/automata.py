"""Weighted acyclic automata over sequences of positive integers.

An automaton maps every prefix of the sequences it was built from to a weight: the number of sequences that begin
with it. It is a transducer whose arcs carry a label, the weight of the path that ends with the arc, and a target.
State 0 has no arcs, the last state is the root; equal states of one depth (same labels, weights, targets) are one.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from graphloom.llm.blocks import expand, squeeze
from graphloom.llm.words import U, mix


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Automaton:
    def __init__(self, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.sizes, self.label, self.weight, self.target = sizes, label, weight, target
        self.first = np.concatenate(([0], np.cumsum(sizes)))

    def to_bytes(self) -> bytes:
        parts = [squeeze(a) for a in (self.sizes, self.label, self.weight, self.target)]
        return struct.pack("<4q", *map(len, parts)) + b"".join(parts)

    @staticmethod
    def from_bytes(body: bytes) -> Automaton:
        at, arrays = 32, []
        for n in struct.unpack_from("<4q", body):
            arrays.append(expand(body[at : at + n]).astype(np.int64))
            at += n
        return Automaton(*arrays)

    def compose(self, asked: np.ndarray) -> np.ndarray:
        """The weight of each row of ``asked`` (sequences padded with zeros); 0 where the automaton has no such path."""
        state, out = np.full(len(asked), len(self.sizes) - 1), np.zeros(len(asked), np.int64)
        for column in asked.T:
            going = np.flatnonzero((column != 0) & (state >= 0))
            low, end = self.first[state[going]], self.first[state[going] + 1]
            high = end.copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                right = open_ & (self.label[np.minimum(mid, len(self.label) - 1)] < column[going])
                low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
            found = low < end
            found[found] = self.label[low[found]] == column[going[found]]
            out[going] = 0
            out[going[found]] = self.weight[low[found]]
            state[going] = -1
            state[going[found]] = self.target[low[found]]
        return out


def build(rows: np.ndarray, counts: np.ndarray) -> Automaton:
    """From distinct rows in ascending order, padded with zeros, and their counts.

    Prefixes begin where a row differs from the row before; from the longest to the shortest, each level's states are
    registered, so that equal ones become one before the level above refers to them.
    """
    n, m = rows.shape
    sums = np.concatenate(([0], np.cumsum(counts)))
    differs = np.zeros(n, np.int64)
    if n > 1:
        differs[1:] = np.argmax(rows[1:] != rows[:-1], axis=1)
    begins = [np.zeros(min(n, 1), np.int64)] + [np.flatnonzero((differs <= d) & (rows[:, d] != 0)) for d in range(m)]
    sizes, arcs = [np.zeros(1, np.int64)], []
    below, states = np.zeros(len(begins[m]), np.int64), 1
    for d in range(m - 1, -1, -1):
        child, parent = begins[d + 1], begins[d]
        borders = np.append(np.flatnonzero(differs <= d), n)
        weight = sums[borders[np.searchsorted(borders, child, "right")]] - sums[child] if len(child) else child
        size = np.bincount(np.searchsorted(parent, child, "right") - 1, minlength=len(parent))
        label = rows[child, d]
        state, kept = _registered(size, label, weight, below, states)
        own = ragged((np.cumsum(size) - size)[kept], size[kept])
        sizes.append(size[kept])
        arcs.append((label[own], weight[own], below[own]))
        below, states = state, states + len(kept)
    return Automaton(np.concatenate(sizes), *(np.concatenate(a) for a in zip(*arcs, strict=True)))


def _registered(size: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(state of each, those that are stored): equal ones share the first's number; those without arcs are state 0."""
    state, some = np.zeros(len(size), np.int64), np.flatnonzero(size)
    if not len(some):
        return state, some
    start = np.cumsum(size) - size
    place = ragged(np.zeros(len(size), np.int64), size).astype(U)
    arc = mix(mix(mix(label.astype(U)) + weight.astype(U)) + target.astype(U)) + place
    _, first, kind = np.unique(np.add.reduceat(mix(arc), start[some]), return_index=True, return_inverse=True)
    like = some[first[kind]]
    # a shared hash is no proof: sizes and arcs must be the same
    same = size[some] == size[like]
    mine, theirs = ragged(start[some[same]], size[some[same]]), ragged(start[like[same]], size[some[same]])
    equal = (label[mine] == label[theirs]) & (weight[mine] == weight[theirs]) & (target[mine] == target[theirs])
    same[same] = np.logical_and.reduceat(equal, np.cumsum(size[some[same]]) - size[some[same]])
    like = np.where(same, like, some)
    kept = np.unique(like)
    state[some] = base + np.searchsorted(kept, like)
    return state, kept


def union(automata: Sequence[Automaton], least: int, borders: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each length its paths (as rows of labels), their weights over all ``automata``, and whether they begin a border.

    A path below ``least`` is left with all that begins with it, unless it begins one of ``borders``, the sequences
    that part this prefix range from others: its weight here is a part only.
    """
    arcs_before = np.cumsum([0, *(len(a.label) for a in automata)])
    states_before = np.cumsum([0, *(len(a.sizes) for a in automata)])
    label, weight = (np.concatenate([getattr(a, f) for a in automata]) for f in ("label", "weight"))
    target = np.concatenate([a.target + s for a, s in zip(automata, states_before, strict=False)])
    size = np.concatenate([a.sizes for a in automata])
    first = np.concatenate([a.first[:-1] + s for a, s in zip(automata, arcs_before, strict=False)])
    state, node, prefix = states_before[1:] - 1, np.zeros(len(automata), np.int64), np.zeros((1, 0), np.int64)
    paths, weights, partial = [], [], []
    while size[state].any():
        arc, parent = ragged(first[state], size[state]), np.repeat(node, size[state])
        order = np.lexsort((label[arc], parent))
        arc, parent = arc[order], parent[order]
        fresh = np.append(True, (parent[1:] != parent[:-1]) | (label[arc[1:]] != label[arc[:-1]]))
        starts, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        total = np.add.reduceat(weight[arc], starts)
        rows = np.hstack([prefix[parent[starts]], label[arc[starts], None]])
        border = np.zeros(len(rows), bool)
        for b in borders:
            border |= (rows == b[: rows.shape[1]]).all(1)
        keep = (total >= least) | border
        renumbered = np.cumsum(keep) - 1
        prefix = rows[keep]
        paths.append(prefix)
        weights.append(total[keep])
        partial.append(border[keep])
        on = keep[number]
        state, node = target[arc[on]], renumbered[number[on]]
    return paths, weights, partial
