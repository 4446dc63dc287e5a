"""Spelling variants against all pairs of words in plain Python."""

import re
import zlib
from collections import Counter

from finchlab.llm import spelling
from tests.llm.cases import SCHEMA, awkward, prose, row

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(rows):
    found = Counter()
    for r in rows:
        for run in RUN.findall((r[1] or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def truth(rows):
    words = vocabulary(rows)
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(docs, **options):
    rows = [tuple(r) for r in spelling.variants(docs, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants_of(*words):
    """Texts in which words differ by an edit, with counts that make chains."""
    rows, k = [], 0
    for word, times in words:
        for _ in range(times):
            rows.append(row(k, word))
            k += 1
    return rows


CHAIN = variants_of(
    ("spelling", 2400), ("spellinG", 3), ("SPELING", 110), ("spelins", 9), ("spelings", 10), ("speliings", 2),
    ("spellung", 110), ("spélling", 4), ("SpÉlling", 4), ("aaaaaaa", 30), ("aaaaaaaa", 3), ("aaaaaab", 2),
    ("abababab", 2), ("babababa", 2), ("z" * 5000, 2), ("z" * 4999 + "y", 2), ("onetwothree", 1),
)


def test_awkward_rows(docs):
    rows = awkward() + awkward()
    assert found(docs.unionAll(docs)) == truth(rows)


def test_chains_ties_and_long_words(spark):
    docs = spark.createDataFrame(CHAIN, SCHEMA).repartition(5)
    want = truth(CHAIN)
    assert any(w != r and f != r for w, f, r, *_ in want if f)
    for symbols in (2, 8):
        assert found(docs, symbols=symbols) == want


def test_dense_vocabulary(spark):
    rows = [row(k, " ".join("ba" * 2 + f"{v % 5 * 'a'}{'abc'[v % 3]}{'xyz'[v % 7 % 3]}ba" for v in range(k, k + 60))) for k in range(40)]
    rows += [row(90 + k, " ".join(f"word{'aeiou'[x % 5]}{'aeiou'[x // 5 % 5]}{'nmr'[x % 3]}" for x in range(75))) for k in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == truth(rows)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(prose(3, 4000)) + " " + "q" * 3000
    whole = spelling.RUN.findall(text)
    monkeypatch.setattr(spelling, "_CHARS", 100)
    assert [w for some in spelling.runs(text) for w in some] == whole


def test_empty(nothing):
    assert found(nothing) == set()
