"""A bounded table of distinct chunks and their ids, kept by a Python worker.

Where a tokenizer never looks across chunk borders, each distinct chunk is segmented once and the ids are joined back by position.
The table has two generations of ``most`` chunks: when the young one is full it becomes the old one, and chunks that
are met again move back, so frequent chunks stay. Chunks above ``longest`` characters are not kept. A chunk that was
dropped is segmented again, with the same ids, so the bounds touch memory only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

GROUP_CHARS = 1 << 18


class DistinctTable:
    def __init__(self, split: Callable[[str], list[str]], segment: Callable[[list[str]], Iterable[bytes]],
                 most: int = 300_000, longest: int = 48):
        self.split, self.segment, self.most, self.longest = split, segment, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as the bytes ``segment`` gives for its chunks."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        lists = [self.split(t) for t in texts]
        wanted = set().union(*lists).difference(self.young)
        new = []
        for chunk in wanted:
            if (known := self.old.get(chunk)) is None:
                new.append(chunk)
            else:
                self.young[chunk] = known
        self.young.update(zip(new, self.segment(new)))
        look = self.young.__getitem__
        yield from [b"".join(map(look, chunks)) for chunks in lists]
        for chunk in new:
            if len(chunk) > self.longest:
                del self.young[chunk]
