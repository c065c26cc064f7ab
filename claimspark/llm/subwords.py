"""Exact subword ids from a tokenizer file, with repeated words encoded once per worker.

Both pre-tokenizers used here never join a non-space character with a following space, so a text
may be cut before each run of white space without changing its ids. The cut pieces repeat a lot:
a worker encodes a word once, keeps its ids, and assembles texts by array gathers. New words are
encoded many at a time, joined by a special token, which the library always cuts out first.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np

#: Distinct pieces a worker keeps before it starts afresh, which bounds its memory.
CACHE_PIECES = 1_500_000
#: Characters that are cut into pieces at once.
CHUNK_CHARS = 2_000_000
#: New pieces that one call of the library encodes as one text.
JOINED = 512


def _pieces(text: str) -> list[str]:
    """Cut before each run of white space that follows a visible character."""
    cut, current = [], None
    for part in text.split(" "):
        if current is None:
            current = part
        elif current == "" or current[-1].isspace():
            current += " " + part
        else:
            cut.append(current)
            current = " " + part
    cut.append(current)
    return cut


class CachedEncoder:
    """``tokenizers`` ids as of ``encode(text, add_special_tokens=False)``.

    A string of a special token inside a text gives that token's id, as in the plain call.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        alone = [(i, t) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (alone[-1][0], alone[-1][1].content) if alone else (None, None)
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.spaced: dict[str, int] = {}  # by the piece without its leading space
        self.exact: dict[str, int] = {}
        self.start, self.size, self.ids = array("q"), array("q"), array("I")

    def _keep(self, known: dict[str, int], keys: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        known.update(zip(keys, range(len(self.start), len(self.start) + len(keys))))
        self.start.frombytes((len(self.ids) + np.cumsum(size) - size).tobytes())
        self.size.frombytes(size.tobytes())
        self.ids.frombytes(flat.tobytes())

    def _add(self, known: dict[str, int], keys: list[str], lead: str) -> None:
        """Encode new pieces, ``lead`` before each."""
        odd = [k for k in keys if self.mark is None or any(a in k for a in self.added)]
        if odd:
            found = self.tokenizer.encode_batch_fast([lead + k for k in odd], add_special_tokens=False)
            flat = np.array([i for e in found for i in e.ids], np.uint32)
            self._keep(known, odd, flat, np.array([len(e.ids) for e in found], np.int64))
            keys = [k for k in keys if k not in known]
        if not keys:
            return
        glue = self.mark + lead
        joined = [lead + glue.join(keys[i : i + JOINED]) + self.mark for i in range(0, len(keys), JOINED)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        is_mark = flat == self.mark_id
        self._keep(known, keys, flat[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.start) > self.limit:
            self._clear()
        parts, counts = [], []
        for text in texts:
            cut = text.split(" ")
            counts.append(len(cut))
            parts += cut
        firsts = np.cumsum(counts) - counts
        at = np.fromiter(map(self.spaced.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0).tolist()
        new = {p for p in map(parts.__getitem__, missing) if p and not p[-1].isspace()}
        self._add(self.spaced, list(new), " ")
        at[missing] = [self.spaced.get(parts[i], -1) for i in missing]
        cut_apart = {i: _pieces(texts[i]) for i in np.flatnonzero(np.minimum.reduceat(at, firsts) < 0).tolist()}
        heads = {parts[f] for f in firsts.tolist()}.union(*cut_apart.values()).difference(self.exact)
        self._add(self.exact, list(heads), "")
        rows = []
        for i, (first, count) in enumerate(zip(firsts.tolist(), counts)):
            if i in cut_apart:
                own = cut_apart[i]
                rows.append(np.fromiter(map(self.exact.__getitem__, own), np.int64, len(own)))
            else:
                at[first] = self.exact[parts[first]]
                rows.append(at[first : first + count])
        order = np.concatenate(rows)
        start, size = np.array(self.start, np.int64)[order], np.array(self.size, np.int64)[order]
        ends = np.cumsum(size)
        index = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
        total = np.concatenate([[0], ends])[np.cumsum([len(r) for r in rows])]
        return np.array(self.ids, np.uint32)[index], np.diff(total, prepend=0)

    def encode(self, texts: list[str | None]):
        """Yield ``(position, ids)`` per text, in order; null is the empty text."""
        done = 0
        while done < len(texts):
            upto, chars = done, 0
            while upto < len(texts) and (upto == done or chars < CHUNK_CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            flat, sizes = self._chunk([t or "" for t in texts[done:upto]])
            at = 0
            for i, n in enumerate(sizes.tolist()):
                yield done + i, flat[at : at + n]
                at += n
            done = upto


@lru_cache(maxsize=2)
def encoder(path: str, limit: int = CACHE_PIECES) -> CachedEncoder:
    """The worker's encoder, kept from task to task."""
    return CachedEncoder(path, limit)
