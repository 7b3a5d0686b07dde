"""Levenshtein automata run against a vocabulary trie."""

from __future__ import annotations

from collections.abc import Iterable

State = tuple[tuple[int, int], ...]


class Trie:
    """A trie of words as nested dicts; the key "" holds the word that ends at a node."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w


class Levenshtein:
    """The parametric automaton of bound ``k``: states are relative to a base position, so that their transitions,
    which depend on nothing but where the next characters of the word equal the one read, are shared by all words. States go by number."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.window = 2 * k + 1
        self.states: list[State] = []
        self.numbers: dict[State, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}  # by state, characters left and hits: the shift of the base, and the state or -1
        self._number(((0, 0),))

    def _number(self, state: State) -> int:
        if not state:
            return -1
        got = self.numbers.get(state)
        if got is None:
            got = self.numbers[state] = len(self.states)
            self.states.append(state)
        return got

    def _reduced(self, positions: set[tuple[int, int]]) -> State:
        kept = []
        for i, e in sorted(positions, key=lambda p: (p[1], p[0])):
            if not any(abs(i - j) <= e - f for j, f in kept):
                kept.append((i, e))
        return tuple(sorted(kept))

    def _move(self, state: State, hits: int, left: int) -> tuple[int, State]:
        """The shift of the base and the state after a character; bit x of ``hits``: it equals the word at base + x."""
        new: set[tuple[int, int]] = set()
        for i, e in state:
            if i < left and hits >> i & 1:
                new.add((i + 1, e))
            if e < self.k:
                new.add((i, e + 1))
                if i < left:
                    new.add((i + 1, e + 1))
                for d in range(1, self.k - e + 1):
                    if i + d < left and hits >> (i + d) & 1:
                        new.add((i + d + 1, e + d))
        if not new:
            return 0, ()
        reduced = self._reduced(new)
        base = min(i for i, _ in reduced)
        return base, tuple((i - base, e) for i, e in reduced)

    def search(self, word: str, trie: Trie) -> list[tuple[str, int]]:
        """All words of the trie within distance k of ``word``, with their distances."""
        n, k, window, moves = len(word), self.k, self.window, self.moves
        out: list[tuple[str, int]] = []
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | 1 << i
        stack: list[tuple[dict, int, int]] = [(trie.root, 0, 0)]
        full = (1 << window) - 1
        mask = masks.get
        while stack:
            node, base, state = stack.pop()
            left = n - base
            span = left if left < window else window
            head = state * (window + 1) + span << window
            for ch, child in node.items():
                if ch == "":
                    d = min([e + left - i for i, e in self.states[state]])
                    if d <= k:
                        out.append((child, d))
                    continue
                hits = mask(ch, 0) >> base & full
                got = moves.get(head | hits)
                if got is None:
                    shift, to = self._move(self.states[state], hits, span)
                    got = moves[head | hits] = (shift, self._number(to))
                if got[1] >= 0:
                    stack.append((child, base + got[0], got[1]))
        return out
