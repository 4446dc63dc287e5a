"""Token ids of whole Arrow columns with the tokenizers library.

A text is cut where a tokenizer's own pre-tokeniser must cut: before a single space
between two characters that are not white space. The pieces of a batch repeat a lot,
so each distinct one is encoded once and the ids are gathered with numpy. A piece of
plain characters is split by the tokenizer file's own pattern and its parts go to the
library's model, a part at a time and remembered; any other piece, and any text where
the cut would not be safe (runs of white space, names of special tokens), goes through
`encode` whole. The ids are those of `encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# bounds the memory of remembered parts, per generation
REMEMBERED = 150_000
_PLAIN = re.compile(r"[\n\r\t\x20-\x7e¡-ɏ]*")
_WORD_AND_MARK = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ASCII_SPACE = _LETTERS[32]
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.keep_space, self.pattern, self.lower = self._kind(spec)
        # two generations: what is still in use moves to the younger one
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _kind(spec: dict) -> tuple[bool, regex.Pattern | None, bool]:
        """Whether pieces keep their space, the pattern of the parts, and lower-casing."""
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and norm is None:
            if not before.get("add_prefix_space"):
                return True, regex.compile(_BYTE_PATTERN), False
        steps = before.get("pretokenizers", [])
        norms = [n["type"] for n in (norm or {}).get("normalizers", [])]
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            split, byte = steps
            removed = split["behavior"] == "Removed" and split["invert"]
            if removed and not byte["use_regex"] and not byte["add_prefix_space"]:
                return False, regex.compile(split["pattern"]["Regex"]), True
        return True, None, False

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is not None:
            return got
        got = self.older.get(part)
        if got is None:
            if part.isascii() and part.isprintable():
                letters = part.replace(" ", _ASCII_SPACE)
            else:
                letters = part.encode().decode("latin-1").translate(_LETTERS)
            got = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.parts) >= self.remembered:
            self.older, self.parts = self.parts, {}
        self.parts[part] = got
        return got

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32).tobytes()

    def _piece(self, word: str, space: str) -> bytes:
        """Ids of a piece: the word, after a space where the tokenizer keeps it."""
        if not (word.isascii() and word.isprintable()) and not _PLAIN.fullmatch(word):
            return self._whole(space + word)
        if self.lower:
            word = word.lower()
        if word.isalpha():
            return self._part(space + word)
        head = word[:-1]
        if word and word[-1] in _WORD_AND_MARK and head.isalpha():
            return self._part(space + head) + self._part(word[-1])
        return b"".join(map(self._part, self.pattern.findall(space + word)))

    def _unsafe(self, words: pa.Array) -> np.ndarray:
        """Pieces whose text is encoded whole: beside white space, or the name of a special token."""
        bad = np.zeros(len(words), dtype=bool)
        if self.keep_space:
            edge = pc.or_(pc.match_substring_regex(words, r"^$|^[\s\x1c-\x1f]|[\s\x1c-\x1f]$"), self._wide_edge(words))
            bad |= edge.to_numpy(zero_copy_only=False)
        for name in self.special:
            bad |= pc.match_substring(words, name).to_numpy(zero_copy_only=False)
        return bad

    @staticmethod
    def _wide_edge(words: pa.Array) -> pa.Array:
        """White space outside ASCII at either end."""
        return pc.not_equal(pc.utf8_length(pc.utf8_trim_whitespace(words)), pc.utf8_length(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n + 1 offsets; null counts as empty."""
        column = column.fill_null("") if column.null_count else column
        n = len(column)
        if self.pattern is None:
            return _joined([self._whole(t) for t in column.to_pylist()])
        units = pc.split_pattern(column.cast(pa.large_string()), " ")
        marks = units.offsets.to_numpy()
        marks = marks - marks[0]
        coded = units.flatten().dictionary_encode()
        # strings by way of numpy: in a list of Arrow's each is made from a scalar of its own
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy().astype(np.int64)
        if not n or not len(index):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        space = " " if self.keep_space else ""
        # where spaces are kept, the first piece of a text has none
        first = marks[:-1]
        unsafe = self._unsafe(coded.dictionary)
        whole = np.zeros(n, dtype=bool)
        if unsafe.any():
            owner = np.repeat(np.arange(n), np.diff(marks))
            whole[owner[unsafe[index]]] = True
        # a piece of letters is one part, and its ids are known or not
        known = self.parts.get
        pool = [known(space + w) if w.isalpha() else None for w in words]
        for i in [i for i, got in enumerate(pool) if got is None]:
            pool[i] = b"" if unsafe[i] else self._piece(words[i], space)
        if self.keep_space:
            heads = pc.unique(pa.array(index[first])).to_numpy()
            at = np.zeros(len(words), dtype=np.int64)
            at[heads] = len(pool) + np.arange(len(heads))
            pool += [b"" if unsafe[h] else self._piece(words[h], "") for h in heads]
            index[first] = at[index[first]]
        if whole.any():
            index[whole[owner]] = len(pool)
            pool.append(b"")
            for i in np.flatnonzero(whole):
                index[marks[i]] = len(pool)
                pool.append(self._whole(column[int(i)].as_py()))
        flat, ends = _joined(pool)
        size = np.diff(ends)[index]
        total = np.concatenate(([0], np.cumsum(size)))
        # where each id comes from: its piece's place in the pool, shifted to its own
        source = np.repeat((ends[:-1][index] - total[:-1]).astype(np.int32), size)
        source += np.arange(total[-1], dtype=np.int32)
        return flat[source], total[marks]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    return np.frombuffer(b"".join(parts), dtype=np.uint32), np.concatenate(([0], np.cumsum(sizes)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One per Python worker; a reused worker keeps it."""
    return Encoder(path, remembered)
