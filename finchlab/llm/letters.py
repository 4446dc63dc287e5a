"""Texts of a batch as one array of code points, with tables over all of Unicode."""

from __future__ import annotations

import functools
import sys
import unicodedata
import zlib

import numpy as np

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "a": "аɑα", "b": "Ьвβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "f": "ƒ", "g": "ɡ", "h": "һн", "i": "іιı",
    "j": "ј", "k": "кκ", "l": "ӏⅼ", "m": "мⅿ", "n": "пη", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ",
    "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind one space and the last followed by one, and n + 1 offsets."""
    sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
    joined = "".join([" " + (t or "") for t in texts]) + " "
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate(([0], np.cumsum(sizes)))


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool)


@functools.cache
def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in np.flatnonzero(letters()).tolist():
        small = chr(c).lower()
        table[c] = ord(small) if len(small) == 1 else c
    return table


def base_letter(char: str) -> str:
    """A letter without its accents."""
    base = unicodedata.normalize("NFKD", char)[0]
    return base if base.isalpha() else char


@functools.cache
def folded_letters() -> np.ndarray:
    """Lower-case letters without accents; look-alikes and substitutes as the letter they stand for; else a space."""
    table = lower_letters().copy()
    for c in np.flatnonzero(letters()[:0x3000]).tolist():
        small = base_letter(chr(int(table[c]))).lower()
        table[c] = ord(small) if len(small) == 1 else table[c]
    for latin, others in HOMOGLYPHS.items():
        for char in others:
            table[ord(char)] = ord(latin)
            if len(char.upper()) == 1:
                table[ord(char.upper())] = ord(latin)
    for char, latin in SUBSTITUTES.items():
        table[ord(char)] = ord(latin)
    return table


def remainder(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, for splits; a null id is the word "null"."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % modulus
