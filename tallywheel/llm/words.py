"""Words of whole texts as 64-bit hashes, for operators on word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_SEEN = _Hashes()
_MOST = 250_000  # remembered words in a worker; the table is emptied beyond that


def word_lists(texts: list[str | None], lower: bool) -> list[list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, A-Z in lower case if asked for; null has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return [(r.lower() if lower else r).split() for r in raw]  # bytes know only ASCII case and blanks


def word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after the other, and the offset of each text (one more at the end)."""
    if len(_SEEN) > _MOST:
        _SEEN.clear()
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
    flat = np.empty(int(offsets[-1]), np.uint64)
    for at, x in zip(offsets.tolist(), lists, strict=False):
        flat[at : at + len(x)] = np.fromiter(map(_SEEN.__getitem__, x), np.uint64, len(x))
    return flat, offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of so many consecutive words; entry i is the run that starts at i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, length):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += words[k : n + k]
    return mixed(h)


def portions(texts: list[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of a list of texts with about so many characters each; a text is never divided."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
