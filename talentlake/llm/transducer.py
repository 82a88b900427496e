"""Minimal acyclic transducers over sorted words: word to lexicographic ordinal.

States that accept the same endings are one state, so the automaton of a sorted
list grows with its distinct beginnings and endings, not with its words. Each arc
carries how many words of its state come before it; their sum along a word's path
is the word's ordinal. Built word by word (a state is final once the next word
leaves it), kept as four flat arrays, and walked for many words at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

NO_WORD = -1


class Transducer:
    """Arcs by (state, byte): ``keys`` = state * 256 + byte, ``target`` states and ``skip``, the words of the
    state before the arc; ``accepts`` says for each state whether a word ends there. ``root`` is the last state."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, accepts: np.ndarray):
        self.keys, self.target, self.skip, self.accepts = keys, target, skip, accepts

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """From distinct words in ascending order."""
        known: dict[tuple, int] = {}                  # (accepts, arcs) of each finished state
        sizes: list[int] = []                         # words from each finished state on
        path: list[list] = [[False, []]]              # open states of the last word: accepts, [(byte, target)]
        last = b""

        def finish(down_to: int) -> None:
            while len(path) > down_to + 1:
                accepts, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], state(accepts, arcs)))

        def state(accepts: bool, arcs: list) -> int:
            key = (accepts, tuple(arcs))
            if key not in known:
                known[key] = len(sizes)
                sizes.append(accepts + sum(sizes[t] for _, t in arcs))
            return known[key]

        for word in words:
            same = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            finish(same)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        finish(0)
        # the root is a state of its own, the last one, whether or not an equal one exists
        states = [*known, (path[0][0], tuple(path[0][1]))]
        keys, target, skip = [], [], []
        for number, (accepts, arcs) in enumerate(states):
            before = int(accepts)
            for byte, to in arcs:
                keys.append(number << 8 | byte)
                target.append(to)
                skip.append(before)
                before += sizes[to]
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(skip, np.int32),
                   np.array([a for a, _ in states], bool))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, NO_WORD where it is none of the transducer's."""
        ends = np.cumsum([0, *map(len, words)])
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        length = np.diff(ends)
        state = np.full(len(words), len(self.accepts) - 1, np.int64)
        ordinal, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        for i in range(int(length.max(initial=0)) if len(self.keys) else 0):
            on = alive[length[alive] > i]
            key = state[on] << 8 | flat[ends[on] + i]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            state[on] = np.where(found, self.target[arc], -1)
            ordinal[on] += self.skip[arc]
            alive = on[found]
            if not len(alive):
                break
        # a word is read to its end or its state is -1; without arcs only the empty word can be
        whole = (state >= 0) & ((len(self.keys) > 0) | (length == 0))
        return np.where(whole & self.accepts[state], ordinal, NO_WORD)

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal below the number of words."""
        out, state = [], len(self.accepts) - 1
        while not (self.accepts[state] and ordinal == 0):
            first, behind = np.searchsorted(self.keys, [state << 8, state + 1 << 8])
            arc = first + int(np.searchsorted(self.skip[first:behind], ordinal, "right")) - 1      # the last arc at or before it
            ordinal -= int(self.skip[arc])
            out.append(int(self.keys[arc]) & 255)
            state = int(self.target[arc])
        return bytes(out)

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.accepts)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.target, self.skip, self.accepts))

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        arcs, states = np.frombuffer(data, np.int64, 2).tolist()
        at = np.cumsum([16, 8 * arcs, 4 * arcs, 4 * arcs]).tolist()
        return cls(np.frombuffer(data, np.int64, arcs, at[0]), np.frombuffer(data, np.int32, arcs, at[1]),
                   np.frombuffer(data, np.int32, arcs, at[2]), np.frombuffer(data, bool, states, at[3]))
