"""Adaptive radix tree over byte strings: node layouts that grow with their children, and path compression."""

from __future__ import annotations

from collections.abc import Iterator


class Few:
    """Up to 4 or 16 children: their bytes in order beside the children."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4) -> None:
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node: Node) -> Few | Some:
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            return (Few(16) if self.room == 4 else Some()).filled(self.items()).put(byte, node)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def filled(self, items: Iterator[tuple[int, Node]]) -> Few:
        for byte, node in items:
            self.bytes.append(byte)
            self.nodes.append(node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes, strict=True)


class Some:
    """Up to 48 children: for each byte the number of its place, from 1."""

    __slots__ = ("places", "nodes")

    def __init__(self) -> None:
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Some | Every:
        at = self.places[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == 48:
            return Every().filled(self.items()).put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def filled(self, items: Iterator[tuple[int, Node]]) -> Some:
        for byte, node in items:
            self.put(byte, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.places) if at)


class Every:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self) -> None:
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Every:
        self.nodes[byte] = node
        return self

    def filled(self, items: Iterator[tuple[int, Node]]) -> Every:
        for byte, node in items:
            self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """``prefix``: the bytes after the one that leads here; ``value``: of the key that ends here; ``kids``: its layout,
    none for a leaf."""

    __slots__ = ("prefix", "value", "kids")

    def __init__(self, prefix: bytes, value: object = None) -> None:
        self.prefix, self.value, self.kids = prefix, value, None

    def put(self, byte: int, node: Node) -> None:
        self.kids = (self.kids or Few()).put(byte, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return iter(()) if self.kids is None else self.kids.items()


def common_length(a: bytes, b: bytes) -> int:
    """The number of first bytes that two strings share."""
    n = min(len(a), len(b))
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: object) -> None:
        """A key that is there already gets the new value."""
        node, above, at = self.root, None, 0
        while True:
            prefix = node.prefix
            if prefix and not key.startswith(prefix, at):
                shared = common_length(prefix, key[at : at + len(prefix)])
                upper = Node(prefix[:shared])
                node.prefix = prefix[shared + 1 :]
                upper.put(prefix[shared], node)
                above.put(key[at - 1], upper)
                node = upper
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            nxt = node.kids.get(key[at]) if node.kids is not None else None
            if nxt is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, node, at = node, nxt, at + 1

    def get(self, key: bytes) -> object:
        node, at = self.root, 0
        while True:
            if not key.startswith(node.prefix, at):
                return None
            at += len(node.prefix)
            if at == len(key):
                return node.value
            node = node.kids.get(key[at]) if node.kids is not None else None
            if node is None:
                return None
            at += 1

    def upwards(self) -> Iterator[tuple[Node, int, int, int]]:
        """Each node after those below it, in the order of their bytes: with the byte depths before and after its path, and
        the number of its children. However deep the tree is, nothing recurses."""
        held = [[self.root, 0, 0, None, 0]]
        held[0][2] = len(self.root.prefix)
        held[0][3] = self.root.items()
        while held:
            top = held[-1]
            for _, kid in top[3]:
                top[4] += 1
                begin = top[2]
                held.append([kid, begin, begin + 1 + len(kid.prefix), kid.items(), 0])
                break
            else:
                held.pop()
                yield top[0], top[1], top[2], top[4]
