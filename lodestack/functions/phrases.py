"""An Aho-Corasick automaton over words, which finds all of many phrases in one pass over a text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark import Broadcast


class Phrases:
    """States are prefixes of phrases.  From a state a word leads on or, over failure links, to the longest
    suffix that is a prefix too; ``ends`` has the phrase that ends in a state, ``shorter`` the next state on
    its failure path where one does.  Time is linear in the text and the matches, whatever the number and
    lengths of the phrases."""

    def __init__(self, phrases: Iterable[str]):
        self.words: dict[str, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for number, phrase in enumerate(phrases):
            state = 0
            for word in phrase.split():
                w = self.words.setdefault(word, len(self.words))
                state = self.steps[state].setdefault(w, len(self.steps))
                if state == len(self.steps):
                    self.steps.append({})
                    self.ends.append(-1)
            self.ends[state] = number
        self.fail, self.shorter = [0] * len(self.steps), [0] * len(self.steps)
        todo = deque(self.steps[0].values())
        while todo:
            state = todo.popleft()
            back = self.fail[state]
            self.shorter[state] = back if self.ends[back] >= 0 else self.shorter[back]
            for w, after in self.steps[state].items():
                at = back
                while at and w not in self.steps[at]:
                    at = self.fail[at]
                self.fail[after] = self.steps[at].get(w, 0)
                todo.append(after)

    def find(self, words: Iterable[str]) -> set[int]:
        """Numbers of the phrases that stand in the words."""
        state, found = 0, set()
        for word in words:
            w = self.words.get(word, -1)
            if w < 0:
                state = 0
                continue
            while state and w not in self.steps[state]:
                state = self.fail[state]
            state = self.steps[state].get(w, 0)
            at = state if self.ends[state] >= 0 else self.shorter[state]
            while at:
                found.add(self.ends[at])
                at = self.shorter[at]
        return found


_built: dict[str, Phrases] = {}


def built(name: str, part: Broadcast) -> Phrases:
    """The automaton of a broadcast list of rows that begin with a phrase, built once per worker process."""
    got = _built.get(name)
    if got is None:
        _built.clear()  # one part at a time
        got = _built[name] = Phrases(row[0] for row in part.value)
    return got
