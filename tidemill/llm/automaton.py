"""Generalised suffix automaton over words: every run of words of a set of texts, read in one pass over any text."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """States of runs of words that end at the same places of the added texts.

    ``size[s]`` is the longest run of state ``s``, ``link[s]`` the state of its longest suffix that ends at more places.
    """

    def __init__(self):
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, before: int, word: bytes) -> int:
        """The state of ``before`` plus ``word`` alone, cut off from the longer runs if it shares a state with them."""
        target = self.step[before][word]
        wanted = self.size[before] + 1
        if self.size[target] == wanted:
            return target
        part = self._state(wanted, dict(self.step[target]), self.link[target])
        self.link[target] = part
        while before != -1 and self.step[before].get(word) == target:
            self.step[before][word] = part
            before = self.link[before]
        return part

    def add(self, words: Iterable[bytes]) -> int:
        """Add a text; the state of the whole of it."""
        at = 0
        for word in words:
            if word in self.step[at]:
                at = self._split(at, word)
                continue
            new = self._state(self.size[at] + 1, {}, 0)
            before = at
            while before != -1 and word not in self.step[before]:
                self.step[before][word] = new
                before = self.link[before]
            if before != -1:
                self.link[new] = self._split(before, word)
            at = new
        return at


class Matcher:
    """Finds, in texts streamed past it, the places of windows and of short texts of a set of items.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.
    """

    def __init__(self, items: Sequence[tuple[Hashable, Sequence[bytes]]], window: int):
        self.window = window
        self.automaton = auto = SuffixAutomaton()
        for _, words in items:
            auto.add(words)
        states = len(auto.size)
        # the state on the suffix path whose runs include the last ``window`` words
        self.window_state = [-1] * states
        self.window_items: dict[int, set[Hashable]] = {}
        # items that are short as a whole, by state, and the next such state on the suffix path
        self.short: dict[int, list[tuple[int, Hashable]]] = {}
        order = sorted(range(1, states), key=auto.size.__getitem__)
        for s in order:
            if auto.size[s] >= window:
                self.window_state[s] = s if auto.size[auto.link[s]] < window else self.window_state[auto.link[s]]
        for item, words in items:
            at = 0
            for i, word in enumerate(words):
                at = auto.step[at][word]
                if i + 1 >= window:
                    self.window_items.setdefault(self.window_state[at], set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(at, []).append((len(words), item))
        self.short_state = [-1] * states
        for s in order:
            self.short_state[s] = s if s in self.short else self.short_state[auto.link[s]]
        self.marked = [self.window_state[s] != -1 or self.short_state[s] != -1 for s in range(states)]

    def find(self, words: Sequence[bytes]) -> tuple[list[list[int]], set[Hashable], list[tuple[int, int, Hashable]]]:
        """Merged spans ``[first, last]`` of hit words, the items found, and each place of a short item.

        One pass; the state and the length of the longest match that ends at the word are all that is kept.
        """
        step, link, size, marked = self.automaton.step, self.automaton.link, self.automaton.size, self.marked
        spans: list[list[int]] = []
        found: set[Hashable] = set()
        places: list[tuple[int, int, Hashable]] = []
        at = length = 0
        for i, word in enumerate(words):
            following = step[at].get(word)
            if following is None:
                while at:
                    at = link[at]
                    following = step[at].get(word)
                    if following is not None:
                        break
                else:
                    length = 0
                    continue
                length = size[at]
            length += 1
            at = following
            if not marked[at]:
                continue
            first = i + 1
            if length >= self.window and self.window_state[at] != -1:
                first = i + 1 - self.window
                found |= self.window_items[self.window_state[at]]
            s = self.short_state[at]
            while s > 0:
                for n, item in self.short[s]:
                    if n <= length:
                        first = min(first, i + 1 - n)
                        found.add(item)
                        places.append((i + 1 - n, i, item))
                s = self.short_state[link[s]]
            if first <= i:
                last = i
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append([first, last])
        return spans, found, places

    def matching_statistics(self, words: Sequence[bytes]) -> list[int]:
        """For each word, how many words up to and with it are the longest run found in any item."""
        step, link, size = self.automaton.step, self.automaton.link, self.automaton.size
        lengths = []
        at = length = 0
        for word in words:
            while at and word not in step[at]:
                at = link[at]
                length = size[at]
            if word in step[at]:
                at = step[at][word]
                length += 1
            else:
                length = 0
            lengths.append(length)
        return lengths
