"""A bounded memo for Arrow functions; it lives as long as the Python worker.

A worker serves one operator after another. Only the memo in use holds entries: when another one
comes into use, the last one is emptied, so a worker's memory does not add up over operators.
"""

from __future__ import annotations

import ctypes
import gc

LIBC = ctypes.CDLL(None)
if hasattr(LIBC, "mallopt"):
    # Large arrays are mapped on their own and go back to the system at once: -3 is M_MMAP_THRESHOLD, -8 M_ARENA_MAX.
    LIBC.mallopt(-3, 2 << 20)
    LIBC.mallopt(-8, 2)
#: Entries of a generation; the last one is kept beside the one that fills: some 70 MB in all with keys and values.
MEMO_ENTRIES = 100_000
#: Bytes that one call of a tokenizer gets; characters of texts that are handled together.
BATCH_BYTES, GROUP_CHARS = 1 << 18, 1 << 20


def settle() -> None:
    """Give memory that is free back to the system, that of Arrow's pool too."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


class Memo:
    """word -> value; `compute` gives the values of many words in one call."""

    in_use: Memo | None = None

    def __init__(self, compute, entries: int = MEMO_ENTRIES, unload=None):
        self.kept: dict = {}
        self.last: dict = {}
        self.compute, self.entries, self.unload = compute, entries, unload
        self.calls = 0

    def clear(self) -> None:
        self.kept.clear()
        self.last.clear()

    @classmethod
    def drop(cls) -> None:
        """Empty the memo in use and let go of its model; operators without one call this, since they share the workers."""
        if cls.in_use:
            cls.in_use.clear()
            if cls.in_use.unload:
                cls.in_use.unload()
            cls.in_use = None
            gc.collect()
            settle()

    def of(self, lists) -> dict:
        """The values of all words in the lists; unknown ones are computed in batches balanced by size."""
        if Memo.in_use is not self:
            Memo.drop()
            Memo.in_use = self
        self.calls += 1
        if self.calls % 16 == 0:
            settle()
        needed = list(set().union(*lists)) if len(lists) != 1 else lists[0]
        found = dict(zip(needed, map(self.kept.get, needed), strict=True))
        new = [w for w, value in found.items() if value is None]
        if new:
            if len(self.kept) + len(new) > self.entries:
                self.last, self.kept = self.kept, {}
            again = {w: value for w in new if (value := self.last.get(w)) is not None}
            found.update(again)
            self.kept.update(again)
            new = [w for w in new if w not in again]
            start, held = 0, 0
            for i, word in enumerate(new):
                held += (len(word.encode("utf-8", "surrogatepass")) if isinstance(word, str) else len(word)) + 16
                if held >= BATCH_BYTES or i == len(new) - 1:
                    values = dict(zip(new[start : i + 1], self.compute(new[start : i + 1]), strict=True))
                    found.update(values)
                    self.kept.update(values)
                    start, held = i + 1, 0
        return found


def groups_by_chars(texts, most: int = GROUP_CHARS):
    """Consecutive texts in lists of about `most` characters; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
