"""Tries as balanced parentheses: the shape of a shard's trie and what a subtree holds, and the merging of shards' spines.

A trie is written in depth-first order, `(` where a node begins and `)` where it ends.  The excess is the number of open nodes.
`findclose` finds a node's end as the first place where the excess falls below its own, over blocks with their least
and greatest excess and a tree above them; the pair delimits the subtree.  Counts of `()` pairs before a place
give leaves, and running sums over nodes in depth-first order give everything that adds up.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np

BITS = 64


class Parentheses:
    """Balanced parentheses with range min-max blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        step = np.where(self.opens, 1, -1)
        self.excess = np.cumsum(step)
        spare = -len(step) % BITS
        # past the end the excess stays at 0, the value with which everything is closed
        self.blocks = np.append(self.excess, np.zeros(spare, np.int64)).reshape(-1, BITS)
        self.low, self.high = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while len(self.low[-1]) > 1:
            for tree, join, filler in ((self.low, np.minimum, np.iinfo(np.int64).max), (self.high, np.maximum, np.iinfo(np.int64).min)):
                row = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], filler)
                tree.append(join(row[0::2], row[1::2]))
        pairs = self.opens[:-1] & ~self.opens[1:]
        self.leaves_before = np.concatenate(([0], np.cumsum(pairs), [pairs.sum()]))
        self.opens_before = np.concatenate(([0], np.cumsum(self.opens)))

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place in each block, behind `after`, whose excess is the target; -1 if there is none."""
        at = block[:, None] * BITS + np.arange(BITS)
        hit = (self.blocks[block] == target[:, None]) & (at > after[:, None])
        return np.where(hit.any(axis=1), block * BITS + hit.argmax(axis=1), -1)

    def _block_with(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (node < len(self.low[level])) & (self.low[level][np.minimum(node, len(self.low[level]) - 1)] <= target) & (
            self.high[level][np.minimum(node, len(self.high[level]) - 1)] >= target)

    def findclose(self, place: np.ndarray) -> np.ndarray:
        """The closing place of every opening one."""
        target = self.excess[place] - 1
        out = np.empty(len(place), np.int64)
        for first in range(0, len(place), 1 << 14):
            part = slice(first, first + (1 << 14))
            out[part] = self._in_block(place[part] // BITS, place[part], target[part])
        todo = np.flatnonzero(out < 0)
        node, level, found = place[todo] // BITS, 0, np.full(len(todo), -1, np.int64)
        climbing = np.arange(len(todo))
        while len(climbing):        # up to the first ancestor's right neighbour whose range has the target, and down again
            here = node[climbing]
            hit = (here % 2 == 0) & self._block_with(level, here + 1, target[todo[climbing]])
            down, at, want = here[hit] + 1, level, target[todo[climbing[hit]]]
            while at:
                at -= 1
                left = self._block_with(at, 2 * down, want)
                down = np.where(left, 2 * down, 2 * down + 1)
            found[climbing[hit]] = down
            climbing = climbing[~hit]
            node[climbing] //= 2
            level += 1
        for first in range(0, len(todo), 1 << 14):
            part = slice(first, first + (1 << 14))
            out[todo[part]] = self._in_block(found[part], np.full(len(found[part]), -1), target[todo[part]])
        return out


@dataclass
class Spine:
    """A node on a shard's first or last path, which shards around it may have as well.

    convs, least: members seen and their smallest conv_id; kids, leaves, saved: children, leaves and savings
    that hang on it and are on no spine; words: of its last turn; end, end_convs, tail: the conversation that ends here or goes on alone
    from here, its copies, and the words that follow; goes_on: whether turns follow.
    """
    key: str
    parent: str | None
    depth: int
    words: int = 0
    convs: int = 0
    least: int = np.iinfo(np.int64).max
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    end: int | None = None
    end_convs: int = 1
    tail: int = 0
    goes_on: bool = False
    left: bool = False
    right: bool = False


@dataclass
class Item:
    """A distinct conversation as far as it is shared: its turns' symbols and words, what follows, and its copies."""
    symbols: list[str]
    words: list[int]
    conv: int
    copies: int
    tail: int
    goes_on: bool


@dataclass
class Node:
    """A finished node; `parent` is the parent's conv_id, or `parent_key` names it if it is still on a spine."""
    conv_id: int
    depth: int
    n_convs: int
    n_children: int
    n_leaves: int
    saved: int
    end: int | None
    parent: int | None = None
    parent_key: str | None = None
    key: str | None = field(default=None)


def _child_key(key: str, symbol: str) -> str:
    return blake2b((key + symbol).encode(), digest_size=16).hexdigest()


def shard(items: list[Item]) -> tuple[list[Node], list[Spine]]:
    """Finished nodes and the spine of the trie over `items`, which are sorted by symbols and distinct."""
    parent, words, depth, symbol = [-1], [0], [0], [""]
    end = np.zeros(len(items), np.int64)
    closes, opens, path, held = [], [], [0], []
    for i, item in enumerate(items):
        shared, most = 0, min(len(held), len(item.symbols))
        while shared < most and held[shared] == item.symbols[shared]:
            shared += 1
        closes.append(len(held) - shared)
        opens.append(len(item.symbols) - shared)
        del path[shared + 1:]
        for d in range(shared, len(item.symbols)):
            parent.append(path[-1])
            words.append(item.words[d])
            depth.append(d + 1)
            symbol.append(item.symbols[d])
            path.append(len(parent) - 1)
        held, end[i] = item.symbols, path[-1]
        if not i:
            first_path = list(path)
    last_path = path
    runs = np.array([1, *[c for pair in zip(closes, opens) for c in pair], len(held) + 1])
    trie = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))

    n = len(parent)
    parent, words, depth = np.array(parent), np.array(words, np.int64), np.array(depth)
    begin = np.flatnonzero(trie.opens)
    close = trie.findclose(begin)
    after = trie.opens_before[close]            # nodes [i, after[i]) are the subtree of node i

    def summed(values):
        total = np.concatenate(([0], np.cumsum(values)))
        return total[after] - total[np.arange(n)]

    ends_here, tails = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends_here[end] = [i.copies for i in items]
    tails[end] = [(i.copies - 1) * i.tail for i in items]
    convs = summed(ends_here)
    least = np.full(n, np.iinfo(np.int64).max)
    least[end] = [i.conv for i in items]
    by_depth = np.argsort(-depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:-1]:
        np.minimum.at(least, parent[level], least[level])
    ending = {int(e): i for e, i in zip(end, items)}

    on_spine = np.zeros(n, bool)
    on_spine[first_path] = on_spine[last_path] = True
    own = np.where(on_spine, 0, (convs - 1) * words + tails)
    saved = summed(own)
    childless = begin + 1 == close
    leaves = trie.leaves_before[close] - trie.leaves_before[begin] - summed(childless & on_spine)
    children = np.bincount(parent[1:], minlength=n)
    free = np.bincount(parent[1:][~on_spine[1:]], minlength=n)

    nodes = []
    spine_of: dict[int, Spine] = {}
    for i in sorted({*first_path, *last_path}):
        up = spine_of.get(int(parent[i]))
        row = Spine("" if up is None else _child_key(up.key, symbol[i]), None if up is None else up.key, int(depth[i]), int(words[i]),
                    int(convs[i]), int(least[i]), int(free[i]), int(leaves[i]), int(saved[i]))
        if i in ending:
            row.end, row.end_convs, row.tail, row.goes_on = (ending[i].conv, ending[i].copies, ending[i].tail, ending[i].goes_on)
        spine_of[i] = row
    for i, row in spine_of.items():             # what hangs on a spine node itself
        if parent[i] >= 0:
            up = spine_of[int(parent[i])]
            up.leaves -= int(leaves[i])
            up.saved -= int(saved[i])
    for flag, where in (("left", first_path), ("right", last_path)):
        for i in where:
            setattr(spine_of[i], flag, True)
    for i in np.flatnonzero(~on_spine).tolist():
        up, last = int(parent[i]), ending.get(i)
        nodes.append(Node(int(least[i]), int(depth[i]), int(convs[i]), int(children[i]) or int(last is not None and last.goes_on),
                          int(leaves[i]), int(saved[i]), None if last is None or last.goes_on else last.conv,
                          None if on_spine[up] else int(least[up]), spine_of[up].key if on_spine[up] else None))
    return nodes, list(spine_of.values())


def merge(spines: list[list[Spine]], whole: bool = False) -> tuple[list[Node], list[Spine]]:
    """Finished nodes and the spine of neighbouring shards, in order; the whole trie has no spine left."""
    outer = set() if whole else {r.key for r in spines[0] if r.left} | {r.key for r in spines[-1] if r.right}
    left = {r.key for r in spines[0] if r.left}
    right = {r.key for r in spines[-1] if r.right}
    rows: dict[str, Spine] = {}
    for row in (r for spine in spines for r in spine):
        held = rows.setdefault(row.key, Spine(row.key, row.parent, row.depth, row.words))
        held.convs += row.convs
        held.least = min(held.least, row.least)
        held.kids += row.kids
        held.leaves += row.leaves
        held.saved += row.saved
        if row.end is not None:
            held.end, held.end_convs, held.tail, held.goes_on = row.end, row.end_convs, row.tail, row.goes_on
    nodes = []
    for row in sorted(rows.values(), key=lambda r: -r.depth):
        if row.key in outer:
            row.left, row.right = row.key in left, row.key in right
            continue
        leaves = row.leaves + (row.kids == 0)
        saved = row.saved + (row.convs - 1) * row.words + (row.end_convs - 1) * row.tail
        node = Node(row.least, row.depth, row.convs, row.kids or int(row.goes_on), leaves, saved, None if row.goes_on else row.end, key=row.key)
        if row.parent is not None:
            up = rows[row.parent]
            up.kids += 1
            up.leaves += leaves
            up.saved += saved
            if row.parent in outer:
                node.parent_key = row.parent
            else:
                node.parent = up.least
        nodes.append(node)
    return nodes, [r for r in rows.values() if r.key in outer]
