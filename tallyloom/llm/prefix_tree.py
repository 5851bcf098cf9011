"""A prefix tree over ordered sets, and the self-join that walks it."""

from __future__ import annotations

import numpy as np


class Node:
    """Members ``lo:hi`` of the sorted list share ``items`` at depths up to ``depth``."""

    __slots__ = ("below", "depth", "end", "hi", "items", "largest", "lo", "smallest")

    def __init__(self, lo: int, hi: int, items: np.ndarray, depth: int, smallest: int, largest: int, end: int):
        self.lo, self.hi, self.items, self.depth, self.smallest, self.largest, self.end = lo, hi, items, depth, smallest, largest, end
        self.below: list[Node] = []


def build(members: list[np.ndarray]) -> Node:
    """The tree of ``members``, ascending arrays of ranks in ascending order; a node with one branch is merged with it.

    Nodes hold views of their members' arrays, so the tree adds little to these.
    """
    sizes = [len(m) for m in members]
    root = Node(0, len(members), np.zeros(0, np.int32), 0, min(sizes), max(sizes), 0)
    todo = [root]
    while todo:
        node = todo.pop()
        lo, depth = node.lo, node.depth
        while lo < node.hi and sizes[lo] == depth:  # members that end here come first
            lo += 1
        node.end = lo
        while lo < node.hi:
            step = members[lo][depth]
            hi, top = lo + 1, node.hi
            while hi < top:  # members are sorted: find where the branch ends by halving
                mid = (hi + top) // 2
                if members[mid][depth] == step:
                    hi = mid + 1
                else:
                    top = mid
            first, last = members[lo], members[hi - 1]
            k, most = depth + 1, min(len(first), len(last))
            if hi - lo == 1:
                k = len(first)
            else:
                apart = first[k:most] != last[k:most]
                k += int(apart.argmax()) if apart.any() else most - k
            child = Node(lo, hi, first[depth:k], k, min(sizes[lo:hi]), max(sizes[lo:hi]), lo)
            node.below.append(child)
            todo.append(child)
            lo = hi
    return root


def matches(root: Node, probe: np.ndarray, present: np.ndarray, allowed: np.ndarray, need):
    """Members that share ``need(size)`` items or more with ``probe``: pairs (member, items shared), as found.

    ``present`` says of each rank whether ``probe`` holds it; ``allowed`` has, for each place in the member list, how many
    allowed members stand before it. The items shared with a common beginning are counted once for all members below it;
    a branch is left when even all that remains of the probe and of its largest member cannot reach what its smallest
    member needs.
    """
    total = len(probe)
    todo = [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if allowed[node.hi] == allowed[node.lo]:
            continue
        if len(node.items):
            shared += int(np.count_nonzero(present[node.items]))
            left = total - int(probe.searchsorted(node.items[-1], "right"))
            if shared + min(left, node.largest - node.depth) < need(node.smallest):
                continue
        for i in range(node.lo, node.end):
            if allowed[i + 1] > allowed[i] and shared >= need(node.depth):
                yield i, shared
        todo.extend((child, shared) for child in reversed(node.below))
