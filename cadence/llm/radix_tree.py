"""An adaptive radix tree over byte strings: node layouts that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Leaf:
    """A single key below a branch; ``path`` is what of the key is left there."""

    __slots__ = ("path", "value")

    def __init__(self, path: bytes, value):
        self.path, self.value = path, value


class Sorted:
    """Up to 4 or 16 children: their bytes in order, and beside them the children."""

    __slots__ = ("bytes", "nodes", "limit")

    def __init__(self, limit: int):
        self.bytes, self.nodes, self.limit = bytearray(), [], limit

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> bool:
        """False if there is no room for a new byte."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        elif len(self.nodes) == self.limit:
            return False
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def pairs(self) -> Iterator[tuple]:
        return zip(self.bytes, self.nodes, strict=True)

    def grown(self):
        larger = Sorted(16) if self.limit == 4 else Indexed()
        for byte, node in self.pairs():
            larger.put(byte, node)
        return larger


class Indexed:
    """Up to 48 children: a table from byte to place."""

    __slots__ = ("places", "nodes")
    FREE = 255

    def __init__(self):
        self.places, self.nodes = bytearray([self.FREE]) * 256, []

    def get(self, byte: int):
        place = self.places[byte]
        return None if place == self.FREE else self.nodes[place]

    def put(self, byte: int, node) -> bool:
        if self.places[byte] != self.FREE:
            self.nodes[self.places[byte]] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.places[byte] = len(self.nodes)
            self.nodes.append(node)
        return True

    def pairs(self) -> Iterator[tuple]:
        return ((b, self.nodes[p]) for b, p in enumerate(self.places) if p != self.FREE)

    def grown(self):
        larger = Direct()
        for byte, node in self.pairs():
            larger.put(byte, node)
        return larger


class Direct:
    """Up to 256 children, one place per byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def pairs(self) -> Iterator[tuple]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Inner:
    """A branch: the compressed path above it, its children, and the value of the key that ends here."""

    __slots__ = ("path", "children", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.children, self.value = path, Sorted(4), value

    def put(self, byte: int, node) -> None:
        if not self.children.put(byte, node):
            self.children = self.children.grown()
            self.children.put(byte, node)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    """Keys are byte strings, one may be the beginning of another; values are not None."""

    def __init__(self):
        self.root = Inner(b"")

    def add(self, key: bytes, value) -> None:
        """Add a key that is not in the tree."""
        node, rest = self.root, key
        while True:
            if not rest:
                node.value = value
                return
            child = node.children.get(rest[0])
            if child is None:
                node.put(rest[0], Leaf(rest, value))
                return
            same = _common(child.path, rest)
            if same < len(child.path) or isinstance(child, Leaf):
                # the path splits, or a leaf becomes a branch
                branch = Inner(child.path[:same])
                left = child.path[same:]
                if left:
                    child.path = left
                    branch.put(left[0], child)
                else:
                    branch.value = child.value
                node.put(rest[0], branch)
                child = branch
            node, rest = child, rest[same:]

    def bottom_up(self) -> Iterator[tuple]:
        """(node, depth above its path, depth at its end), every child before its parent, without recursion."""
        stack = [(self.root, 0, False)]
        while stack:
            node, above, done = stack.pop()
            if not done and isinstance(node, Inner):
                stack.append((node, above, True))
                below = above + len(node.path)
                stack.extend((child, below, False) for _, child in node.children.pairs())
            else:
                yield node, above, above + len(node.path)
