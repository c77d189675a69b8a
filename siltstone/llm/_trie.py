"""A prefix tree of globally ordered sets, and the components it links."""

from __future__ import annotations


class Union:
    """Disjoint sets of numbers; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


class _Node:
    __slots__ = ("run", "depth", "children", "ends", "least", "most", "longest", "member", "uniform")

    def __init__(self, run: list[int], depth: int):
        self.run, self.depth = run, depth
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.least, self.most, self.longest = 1 << 62, 0, 0
        self.member, self.uniform = -1, True


def linked(overlap: int, a: int, b: int) -> bool:
    """Jaccard similarity of at least 0.75 of sets of sizes a and b."""
    return 100 * overlap >= 75 * (a + b - overlap)


class PrefixTree:
    """Sets as paths of their shared tokens, the most frequent first.

    Sets that agree on frequent tokens share a path, and a probe counts its
    overlap with that path once. A subtree is left out if its sizes can't
    match, if the overlap so far and what may remain can't reach the
    threshold, or if all its sets already are in the probe's component.
    """

    def __init__(self, sizes: list[int], union: Union):
        self.sizes, self.union = sizes, union
        self.root = _Node([], 0)

    def insert(self, doc: int, path: list[int]) -> None:
        size, node, at = self.sizes[doc], self.root, 0
        while True:
            self._touch(node, doc, size, len(path))
            if at == len(path):
                self._end(node, doc)
                return
            child = node.children.get(path[at])
            if child is None:
                child = _Node(path[at:], len(path))
                node.children[path[at]] = child
                node, at = child, len(path)
                continue
            run = child.run
            if path[at : at + len(run)] == run:
                node, at = child, at + len(run)
                continue
            same = next((i for i, (a, b) in enumerate(zip(run, path[at:], strict=False)) if a != b), min(len(run), len(path) - at))
            upper = _Node(run[:same], at + same)
            upper.least, upper.most, upper.longest = child.least, child.most, child.longest
            upper.member, upper.uniform = child.member, child.uniform
            child.run = run[same:]
            upper.children[child.run[0]] = child
            node.children[path[at]] = upper
            node, at = upper, at + same

    def _end(self, node: _Node, doc: int) -> None:
        """Of sets with one path and component the smallest links to all that any of them links to."""
        root = self.union.find(doc)
        for i, other in enumerate(node.ends):
            if self.union.find(other) == root:
                if self.sizes[doc] < self.sizes[other]:
                    node.ends[i] = doc
                return
        node.ends.append(doc)

    def _touch(self, node: _Node, doc: int, size: int, length: int) -> None:
        node.least, node.most, node.longest = min(node.least, size), max(node.most, size), max(node.longest, length)
        if node.member < 0:
            node.member = doc
        elif node.uniform and self.union.find(node.member) != self.union.find(doc):
            node.uniform = False

    def probe(self, doc: int, path: list[int]) -> None:
        """Join the set's component with that of every set in the tree that it links to."""
        union, sizes = self.union, self.sizes
        size, mine, own = sizes[doc], set(path), len(path)
        low, high = -(-3 * size // 4), 4 * size // 3
        stack: list[tuple[_Node, int, bool]] = [(self.root, 0, False)]
        while stack:
            node, overlap, done = stack.pop()
            if done:
                if all(c.uniform for c in node.children.values()):
                    members = [c.member for c in node.children.values()] + node.ends
                    node.uniform = len(set(map(union.find, members))) == 1
                continue
            if node.member < 0 or (node.uniform and union.find(node.member) == union.find(doc)):
                continue
            if node.most < low or node.least > high:
                continue
            overlap += sum(map(mine.__contains__, node.run))
            bound = overlap + min(node.longest - node.depth, own - overlap)
            if 7 * bound < 3 * (max(node.least, low) + size):
                continue
            for other in node.ends:
                if linked(overlap, sizes[other], size):
                    union.join(other, doc)
            if node.children:
                if not node.uniform:
                    stack.append((node, overlap, True))
                # The likeliest branches come off the stack first.
                near = [c for t, c in node.children.items() if t in mine]
                stack += [(c, overlap, False) for t, c in node.children.items() if t not in mine]
                stack += [(c, overlap, False) for c in near]


def trie_components(sizes: list[int], paths: list[list[int]], start: list[int] | None = None) -> list[int]:
    """For each set the smallest number of a set in its component.

    ``start`` gives sets known to be in one component equal labels.
    """
    union = Union(len(sizes))
    if start is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(start):
            union.join(first.setdefault(label, i), i)
    tree = PrefixTree(sizes, union)
    for i, path in enumerate(paths):
        tree.probe(i, path)
        tree.insert(i, path)
    return [union.find(i) for i in range(len(sizes))]
