"""Token ids of whole texts by the tokenizers library, with repeated words encoded once.

A byte-level BPE splits a text by a pattern before it merges anything, and no piece of that split
runs from a character that isn't white space into one that is. A text can thus be cut before any
blank that follows other characters, the cuts encoded by themselves, and their ids joined: the result
equals the ids of the whole text. Natural text repeats its words, so each Python worker keeps the ids
of the words it has met, a bounded number of them, and looks up only the distinct words of a portion.

Texts that hold an added token of the vocabulary ("<|endoftext|>") go to the library whole, as all texts
do with a vocabulary that splits in another way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters with the Unicode property White_Space (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_CUT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_FIRST = "\x01"  # stands before the first word of a text, which has no blank of its own
#: One run of letters, then marks: the pattern makes at most a line feed, the letters and the marks of it.
_PLAIN = r"^(?P<lead>[\x01\n]?)(?P<letters>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
_PORTION, _BLOCK = 1 << 22, 1 << 15


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def _splits_before_blanks(tok) -> bool:
    """Whether a tokenizer splits by the usual byte-level pattern and changes no text before."""
    said = json.loads(tok.to_str())
    split = said["pre_tokenizer"] or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return bool(usual and not said["normalizer"] and said["model"]["type"] == "BPE")


class TextEncoder:
    """Encodes texts to unsigned 32-bit ids, the same as the library's for each whole text.

    ``max_words`` bounds the words that are remembered for good: the first ones met, among them the
    frequent ones. ``passing`` bounds those that are remembered for a while. Null texts count as
    empty and give no ids.
    """

    def __init__(self, path: str, max_words: int = 800_000, passing: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_word = _splits_before_blanks(self.tok)
        self.max_words, self.passing = max_words, passing
        self.kept: dict[str, int] = {}
        self.later: dict[str, int] = {}
        # Word k has the ids flat[bounds[k]:bounds[k + 1]]. Word 0 has none: it says that a text can't be cut.
        self.flat, self.bounds, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 1
        if self.by_word:
            self.model = self.tok.model
            (self.feed,) = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of stems (letters, perhaps after a blank), by the library's model, and their offsets."""
        ids, ends = [], [0]
        known = map(self.kept.get, [x[1:] if x[0] == " " else _FIRST + x for x in stems])
        for x, number in zip(stems, known, strict=True):
            if number is not None:
                ids += self.flat[self.bounds[number] : self.bounds[number + 1]].tolist()
                ends.append(len(ids))
                continue
            mapped = x.replace(" ", _LETTERS[32]) if x.isascii() else x.encode().decode("latin1").translate(_LETTERS)
            ids += [t.id for t in self.model.tokenize(mapped)]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends)

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of new words, their sizes, and whether a text can be cut before and after each.

        'x' stands for ' x', '\\nx' for itself, and the mark of a first word for nothing.
        """
        split = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(split).to_numpy(zero_copy_only=False)
        lead, letters, tail = split.filter(pa.array(plain)).flatten()
        stem = pc.binary_join_element_wise(pc.if_else(pc.equal(lead, ""), " ", ""), letters, "").dictionary_encode()
        tail = tail.dictionary_encode()
        rest = [w for w in words.filter(pa.array(~plain)).to_pylist()]
        cut = [bool(w) and w[-1] not in SPACES for w in rest]
        literal = [(w if w[0] == "\n" else w[1:] if w[0] == _FIRST else " " + w) if c else "" for w, c in zip(rest, cut, strict=True)]
        # The ids of all pieces one after the other: a line feed's, those of stems, of tails, and of other words.
        stem_ids, stem_at = self._stems(stem.dictionary.to_numpy(zero_copy_only=False).tolist())
        more_ids, more_at = _joined([np.array(x, np.uint32) for x in self._ids(tail.dictionary.to_pylist() + literal)])
        pieces = np.concatenate((np.array([self.feed], np.uint32), stem_ids, more_ids))
        at = np.concatenate(([0], 1 + stem_at, 1 + len(stem_ids) + more_at[1:]))
        begins, sizes = np.zeros((len(words), 3), np.int64), np.zeros((len(words), 3), np.int64)
        feeds = pc.equal(lead, "\n").to_numpy(zero_copy_only=False)
        sizes[np.flatnonzero(plain)[feeds], 0] = 1
        n = 1 + len(stem.dictionary)
        for column, where, number in ((1, plain, 1 + _indices(stem)), (2, plain, n + _indices(tail)), (1, ~plain, n + len(tail.dictionary) + np.arange(len(rest)))):
            begins[where, column], sizes[where, column] = at[number], at[number + 1] - at[number]
        usable = plain.copy()
        usable[~plain] = [c or w == _FIRST for w, c in zip(rest, cut, strict=True)]
        return pieces[_ranges(begins.ravel(), sizes.ravel())], sizes.sum(axis=1), usable

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Numbers for new words; 0 for those before or after which a text can't be cut."""
        ids, sizes, usable = self._found(words)
        n, at = self.n, int(self.bounds[self.n])
        if n + len(words) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros(n + 2 * len(words), np.int64)))
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(at + len(ids), np.uint32)))
        self.flat[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        numbers = np.where(usable, n + np.arange(len(words)), 0)
        names, room = words.to_numpy(zero_copy_only=False).tolist(), max(0, self.max_words - len(self.kept))
        self.kept.update(zip(names[:room], numbers[:room].tolist(), strict=True))
        self.later.update(zip(names[room:], numbers[room:].tolist(), strict=True))
        self.n += len(words)
        return numbers

    def _numbers(self, words: pa.Array) -> np.ndarray:
        names = words.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.kept.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new) and self.later:
            if len(self.later) > self.passing:
                self.later.clear()
                self.n = len(self.kept) + 1
            out[new] = np.fromiter((self.later.get(names[k], -1) for k in new.tolist()), np.int64, len(new))
            new = new[out[new] < 0]
        if len(new):
            out[new] = self._learn(words.take(pa.array(new)))
        return out

    def _cut(self, text: str) -> list[int]:
        """Ids of a text with several blanks in a row, cut by pattern."""
        cuts = _CUT.findall(text)
        block = list(dict.fromkeys(cuts))
        found = dict(zip(block, self._ids(block), strict=True))
        return list(chain.from_iterable(map(found.__getitem__, cuts)))

    def _portion(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the offset of each text (one more at the end)."""
        if not self.by_word:
            ids = self._ids(texts.to_pylist())
            return _joined([np.array(x, np.uint32) for x in ids])
        split = pc.replace_substring(texts, "\n", " \n")  # blanks between line feeds go again:
        for _ in range(2):
            split = pc.replace_substring(split, "\n \n", "\n\n")
        split = pc.split_pattern(pc.binary_join_element_wise("", split, _FIRST), " ")
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = self._numbers(coded.dictionary)[_indices(coded)]
        bounds -= bounds[0]
        begins, parts, ends, total = self.bounds, [], np.zeros(len(words) + 1, np.int64), 0
        for at in range(0, len(words), _BLOCK):  # blocks stay in the processor's cache
            own = words[at : at + _BLOCK]
            first = begins[own]
            sizes = begins[own + 1] - first
            parts.append(self.flat[_ranges(first, sizes)])
            ends[at + 1 : at + 1 + len(own)] = total + np.cumsum(sizes)
            total += len(parts[-1])
        ids, offsets = np.concatenate(parts) if parts else np.empty(0, np.uint32), ends[bounds]
        odd = np.diff(np.concatenate(([0], np.cumsum(words == 0)))[bounds]) > 0
        held = _bytes_of(texts)
        for mark in (m for m in (_FIRST, *self.added) if m.encode() in held):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            text = texts[k].as_py()
            parts[k] = np.array(self._ids([text])[0] if any(a in text for a in self.added) else self._cut(text), np.uint32)
        return _joined(parts)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Portions of a column of texts: first row, row after the last, all ids, and each text's offset (one more at the end).

        With ``end_id`` each text has this id after its own. A text is never divided, so a portion
        holds about four million bytes or one longer text.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PORTION, side="right")))
            ids, offsets = self._portion(texts[at:stop])
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                offsets = offsets + np.arange(len(offsets))
            yield at, stop, ids, offsets
            at = stop


def _bytes_of(texts: pa.Array) -> bytes:
    """The bytes of all texts, one after the other."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset :][[0, len(texts)]]
    return texts.buffers()[2].slice(int(ends[0]), int(ends[1] - ends[0])).to_pybytes() if ends[1] > ends[0] else b""


def _indices(coded: pa.DictionaryArray) -> np.ndarray:
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[i], begins[i] + 1 and so on, sizes[i] of them, for one i after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(begins - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), offsets


_KEPT: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _KEPT:
        _KEPT[path] = TextEncoder(path)
    return _KEPT[path]
