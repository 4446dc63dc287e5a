"""Repeated byte strings against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from finchlab.llm import suffix_dedup
from finchlab.llm.words import column_bytes
from tests.llm.cases import SCHEMA, awkward, prose, row


def truth(rows, window=100):
    """Strings in order of (id, place); rows of one id and different texts are not in here."""
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts[r[0]] = (r[1] or "").encode()
    seen, gone = set(), {}
    for doc in sorted(texts):
        t = texts[doc]
        out = bytearray(len(t))
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            if w in seen:
                out[p : p + window] = b"\1" * window
            seen.add(w)
        gone[doc] = out
    result = []
    for r in rows:
        t = (r[1] or "").encode()
        g = gone.get(r[0], bytes(len(t)))
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        result.append((r[0], len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def found(docs, **options):
    rows = suffix_dedup.trim_repeats(docs, **options).collect()
    return sorted(
        ((r.doc, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str
    )


def test_awkward_rows(docs):
    assert found(docs) == truth(awkward())


def edited():
    """Copies with edits, shared passages at many offsets, runs, periods and repeats inside a text."""
    rng = random.Random(5)
    base, passage = " ".join(prose(40, 120)), " ".join(prose(41, 40))
    rows = []
    for k in range(40):
        text = list(base)
        for _ in range(k % 5):
            text[rng.randrange(len(text))] = rng.choice("éxyz ")
        rows.append(row(k, "".join(text)))
        rows.append(row(100 + k, " ".join(prose(500 + k, 20)) + passage[k % 9 :] + " ".join(prose(700 + k, 9))))
    rows += [row(200 + k, c * n) for k, (c, n) in enumerate([("a", 99), ("a", 100), ("a", 340), ("ab", 130), ("abc", 222), ("é", 120)])]
    rows.append(row(300, passage + "\n" + passage + passage))
    rows.append(row(301, "".join(rng.choice("ab") for _ in range(3000))))
    rows.append(row(302, passage[:99]))
    return rows


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"crowd": 3, "trigger": 8}, {"trigger": 48}])
def test_edits_passages_and_runs(spark, options):
    rows = edited()
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), **options) == truth(rows)


def test_short_windows(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(docs, window=30, trigger=8) == truth(rows, 30)


def test_one_id_with_several_texts(spark):
    long, other = " ".join(prose(60, 90)), " ".join(prose(61, 90))
    texts = [(1, long), (5, long), (5, "short text only"), (5, other), (7, other), (7, other), (None, long)]
    want = []
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([row(*t) for t in order], SCHEMA).repartition(3)
        want.append(found(docs))
    assert want[0] == want[1]
    sizes = [(r[0], r[1] - r[2]) for r in want[0]]
    assert sorted(sizes, key=str) == sorted(
        [(1, len(long)), (5, 0), (5, 15), (5, len(other)), (7, 0), (7, 0), (None, len(long))], key=str
    )


def test_pieces_of_long_texts_agree(monkeypatch):
    """A parse in small pieces finds the triggers of a parse at once."""
    import pyarrow as pa

    texts = [" ".join(prose(k, 700)) for k in range(6)] + ["", "x" * 4000, "y" * 99, "z" * 100]
    data, marks = column_bytes(pa.array(texts))

    def whole():
        parts = list(suffix_dedup.parse(data, marks, 100, 24))
        return [np.concatenate(x).tolist() for x in zip(*parts, strict=True)]

    want = whole()
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 900)
    assert whole() == want
    windows = sum(max(0, len(t) - 99) for t in texts)
    assert sum(want[4]) == windows


def test_empty(nothing):
    assert found(nothing) == []
