"""A minimal acyclic transducer: words to id sequences, as flat arrays that can be memory-mapped.

Words are byte strings. States that accept the same suffixes are one state, so
shared suffixes are stored once. An edge carries how many words come before those
that go through it; their sum along a path is the word's number, which is its
place in the table of ids.
"""

from __future__ import annotations

import numpy as np


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final, self.number, self.words = False, -1, 0

    def key(self):
        return (self.final, *((b, id(s)) for b, s in self.edges.items()))


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> np.ndarray:
    """``entries``: distinct words in byte order with their ids. Returns one int32 array."""
    root, register = _State(), {}
    path: list[_State] = [root]
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            same = register.setdefault(child.key(), child)
            if same is not child:
                path[-1].edges[before[len(path) - 1]] = same

    for word, _ in entries:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            state = _State()
            path[-1].edges[byte] = state
            path.append(state)
        path[-1].final = True
        before = word
    settle(0)

    states: list[_State] = []
    stack: list[tuple[_State, bool]] = [(root, False)]
    while stack:  # children first
        state, ready = stack.pop()
        if ready:
            if state.number < 0:
                state.number = len(states)
                state.words = state.final + sum(s.words for s in state.edges.values())
                states.append(state)
        elif state.number < 0:
            stack.append((state, True))
            stack.extend((s, False) for s in state.edges.values())

    first, byte, to, skip = [0], [], [], []
    for state in states:
        passed = int(state.final)
        for b in sorted(state.edges):
            child = state.edges[b]
            byte.append(b), to.append(child.number), skip.append(passed)
            passed += child.words
        first.append(len(byte))
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
    ids = [i for _, own in entries for i in own]
    head = [len(states), len(byte), len(entries), len(ids), root.number]
    owner = np.repeat(np.arange(len(states)), np.diff(first))
    parts = [head, owner, byte, to, skip, [s.final for s in states], starts, ids]
    return np.concatenate([np.asarray(p, dtype=np.int32) for p in parts])


class Lexicon:
    """Looks words up in the arrays of ``compile_lexicon``, many at a time."""

    def __init__(self, flat: np.ndarray):
        n_states, n_edges, n_words, n_ids, self.root = (int(x) for x in flat[:5])
        cuts = np.cumsum([5, n_edges, n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids])
        owner, byte, self.to, self.skip, self.final, self.starts, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))
        self.keys = owner.astype(np.int64) * 256 + byte
        self.words = n_words

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each word its ids as little-endian bytes, or None."""
        if not words or not self.words:
            return [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = np.full(len(words), self.root, np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes > 0)
        depth = 0
        while len(live):  # all words go one byte further at a time
            key = state[live] * 256 + text[at[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            state[live[~there]] = -1
            live, edge = live[there], edge[there]
            number[live] += self.skip[edge]
            state[live] = self.to[edge]
            depth += 1
            live = live[sizes[live] > depth]
        known = (state >= 0) & (self.final[state] == 1)
        return [
            self.ids[self.starts[n] : self.starts[n + 1]].astype("<u4").tobytes() if ok else None
            for ok, n in zip(known.tolist(), number.tolist())
        ]
