"""One deterministic automaton over bytes from many patterns, and its scan of many texts at once."""

from __future__ import annotations

import re

import numpy as np

_ALL = frozenset(range(256))
_CATEGORY = {
    "d": frozenset(b"0123456789"), "s": frozenset(b" \t\n\r\f\v"),
    "w": frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_") | frozenset(range(128, 256)),
}
_CONTROL = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


def _fold(bytes_: frozenset) -> frozenset:
    return bytes_ | {b ^ 32 for b in bytes_ if b < 128 and chr(b).isalpha()}


def parsed(pattern: str) -> tuple:
    """A pattern of literals, classes, groups, alternatives and repetitions as a tree.

    Nodes: ("set", bytes), ("seq", nodes), ("alt", nodes), ("rep", node, least, most or None).  ``(?i)``
    at the start folds the case of ASCII letters; ``\\w`` holds every byte of characters beyond ASCII.
    """
    fold = pattern.startswith("(?i)")
    text, at = pattern.removeprefix("(?i)"), 0

    def escaped() -> frozenset:
        nonlocal at
        c = text[at]
        at += 1
        if c.lower() in _CATEGORY and c.isalpha() and c in "dswDSW":
            return _CATEGORY[c] if c.islower() else _ALL - _CATEGORY[c.lower()]
        return frozenset([_CONTROL.get(c, ord(c))])

    def chosen() -> frozenset:
        nonlocal at
        negate = text[at] == "^"
        at += negate
        found: set[int] = set()
        while text[at] != "]":
            c = text[at]
            at += 1
            if c == "\\":
                found |= escaped()
            elif text[at] == "-" and text[at + 1] != "]":
                found |= set(range(ord(c), ord(text[at + 1]) + 1))
                at += 2
            else:
                found.add(ord(c))
        at += 1
        whole = _fold(frozenset(found)) if fold else frozenset(found)
        return _ALL - whole if negate else whole

    def one() -> tuple:
        nonlocal at
        c = text[at]
        at += 1
        if c == "(":
            at += 2 if text.startswith("?:", at) else 0
            node = either()
            at += 1
            return node
        if c == "[":
            return ("set", chosen())
        if c == "\\":
            return ("set", escaped())
        if c == ".":
            return ("set", _ALL - {10})
        return ("set", _fold(frozenset([ord(c)])) if fold else frozenset([ord(c)]))

    def sequence() -> tuple:
        nonlocal at
        nodes = []
        while at < len(text) and text[at] not in "|)":
            node = one()
            while at < len(text) and text[at] in "*+?{":
                m = re.compile(r"\*|\+|\?|\{(\d+)(,?)(\d*)\}").match(text, at)
                at = m.end()
                if m.group(1):
                    least = int(m.group(1))
                    node = ("rep", node, least, int(m.group(3)) if m.group(3) else None if m.group(2) else least)
                else:
                    node = ("rep", node, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[m.group(0)])
            nodes.append(node)
        return ("seq", nodes)

    def either() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    return either()


class Automaton:
    """The union of patterns, found anywhere in a text or, ``anchored``, from its start only.

    Thompson's construction; subsets are built when a text first leads to them, so that counted
    repetitions cost only the states that occur.  State 0 is the start; ``accept[s]`` is a bit mask of
    the patterns that end in state ``s``; ``backward`` reads the patterns from their ends.
    """

    #: States from which the table is forgotten before the next scan.
    LIMIT = 200_000

    def __init__(self, patterns: list[str], anchored: bool = False, backward: bool = False) -> None:
        self._eps: list[list[int]] = []
        self._arcs: list[list[tuple[frozenset, int]]] = []
        self._anchored, self._backward = anchored, backward
        self._start, self._finals = self._node(), {}
        for i, p in enumerate(patterns):
            end = self._build(parsed(p), self._start)
            self._finals[end] = self._finals.get(end, 0) | (1 << i)
        classes = sorted({b for arcs in self._arcs for b, _ in arcs}, key=sorted)
        signature = [tuple(b in c for c in classes) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.byte_class = np.array([kinds[s] for s in signature], np.uint8)
        self._sample = [signature.index(s) for s in kinds]
        self.width = len(kinds)
        self._forget()

    def _node(self) -> int:
        self._eps.append([])
        self._arcs.append([])
        return len(self._eps) - 1

    def _build(self, tree: tuple, at: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self._node()
            self._arcs[at].append((tree[1], end))
            return end
        if kind == "seq":
            for node in reversed(tree[1]) if self._backward else tree[1]:
                at = self._build(node, at)
            return at
        end = self._node()
        if kind == "alt":
            for node in tree[1]:
                self._eps[self._build(node, at)].append(end)
            return end
        _, node, least, most = tree
        for _ in range(least):
            at = self._build(node, at)
        if most is None:
            self._eps[at].append(end)
            self._eps[self._build(node, end)].append(end)
            return end
        self._eps[at].append(end)
        for _ in range(most - least):
            at = self._build(node, at)
            self._eps[at].append(end)
        return end

    def _close(self, nodes: set[int]) -> frozenset:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for n in self._eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(n for n in seen if self._arcs[n] or n in self._finals)

    def _forget(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self.table = np.full((64, self.width), -1, np.int32)
        self.accept = np.zeros(64, np.int64)
        self._state(self._close({self._start}))

    def _state(self, nodes: frozenset) -> int:
        found = self._states.get(nodes)
        if found is None:
            found = self._states[nodes] = len(self._sets)
            self._sets.append(nodes)
            if found == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accept = np.concatenate([self.accept, np.zeros_like(self.accept)])
            mask = 0
            for n in nodes:
                mask |= self._finals.get(n, 0)
            self.accept[found] = mask
        return found

    def step(self, state: int, kind: int) -> int:
        """The next state, built if it is not known yet."""
        nxt = int(self.table[state, kind])
        if nxt < 0:
            b = self._sample[kind]
            to = {t for n in self._sets[state] for chosen, t in self._arcs[n] if b in chosen}
            nxt = self._state(self._close(to if self._anchored else to | {self._start}))
            self.table[state, kind] = nxt
        return nxt

    def longest(self, data: bytes, pattern: int = 0) -> int:
        """How many bytes of ``data`` from its start the longest match of a pattern takes; 0 for none.

        For an anchored automaton; the scan ends where nothing can match any more.
        """
        state, best, bit = 0, 0, 1 << pattern
        for i, b in enumerate(data):
            state = self.step(state, int(self.byte_class[b]))
            if not self._sets[state]:
                break
            if int(self.accept[state]) & bit:
                best = i + 1
        return best

    def ends(self, data: np.ndarray, chunk: int = 2048, overlap: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """All places (of the last byte) in a byte array where some pattern ends, in order, and the masks of those patterns.

        Chunks are scanned side by side, each from ``overlap`` bytes before its start; a chunk
        whose state at its start turns out to differ from the end of the chunk before is scanned
        again from there, so that the result is that of one scan from the first byte.
        """
        if len(self._sets) > self.LIMIT:
            self._forget()
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = self.byte_class[data]
        starts = np.arange(0, n, chunk)
        state = self._run(kinds, np.maximum(starts - overlap, 0), starts, np.zeros(len(starts), np.int64))[0]
        state[0] = 0
        places, masks, finish = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        todo = np.arange(len(starts))
        while len(todo):
            finish[todo], at, mask = self._run(kinds, starts[todo], np.minimum(starts[todo] + chunk, n), state[todo])
            again = np.zeros(len(starts), bool)
            again[todo] = True
            keep = ~again[places // chunk]
            places, masks = np.concatenate([places[keep], at]), np.concatenate([masks[keep], mask])
            true = np.concatenate([[0], finish[:-1]])
            todo = np.flatnonzero(true != state)
            state = true
        order = np.argsort(places)
        return places[order], masks[order]

    def _run(self, kinds: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Step all ranges [lo, hi) together; (states at the ends, places of acceptance, their masks)."""
        state, places, masks = state.copy(), [], []
        longest, shortest = int((hi - lo).max(initial=0)), int((hi - lo).min(initial=0))
        for t in range(longest):
            live = None if t < shortest else np.flatnonzero(lo + t < hi)
            now, at = (state, lo + t) if live is None else (state[live], lo[live] + t)
            kind = kinds[at]
            key = now * self.width + kind
            nxt = self.table.ravel().take(key)
            if nxt.min() < 0:
                for k in np.unique(key[nxt < 0]):
                    self.step(int(k) // self.width, int(k) % self.width)
                nxt = self.table.ravel().take(key)
            hit = self.accept[nxt]
            if hit.any():
                some = hit != 0
                places.append(at[some])
                masks.append(hit[some])
            if live is None:
                state = nxt.astype(np.int64)
            else:
                state[live] = nxt
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return state, join(places), join(masks)
