"""A bounded memory of what words encode to."""

from __future__ import annotations


class Memo(dict):
    """Encoded words. The first ``keep`` words stay; rarer ones are held for one batch only."""

    def __init__(self, keep: int):
        self.keep, self.rare = keep, {}

    def encode_new(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def learn(self, words: set[str]) -> None:
        fresh = sorted(w for w in words if w not in self)
        self.rare = {}
        for word, got in zip(fresh, self.encode_new(fresh) if fresh else ()):
            (self if len(self) < self.keep else self.rare)[word] = got

    def __missing__(self, word: str) -> bytes:
        return self.rare[word]
