"""Token files and packing: exact round trips against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from finchlab.llm import packing, token_files
from finchlab.llm.tokens import Encoder
from tests.llm.cases import awkward, prose

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "x\n y\n\n z", "é́ ü̈ ẞ ΑΣ Σ", "<|endoftext|> hi", "hi <|endoftext|>",
    "it's we'LL I'm don't", "12345 6,7.8", "\x1c a\x85b\xa0c", "\xa0 x", "x   y", "😀🎉 ok 你好 hello", "a\n \nb", "a \nb", "\n",
    "naïve Ĳ İ ŉ", "tab\tx \t y", "'s 's'", "(foo) [bar] {x}=y||z", "word_x __y__ a-b—c", "ªº ²³ ½", "x" * 3000, "\x1cq \x1d r",
]


@pytest.mark.parametrize("file", FILES)
def test_encoder_equals_the_library(file):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    texts = TEXTS + [r[1] for r in awkward()] + [" ".join(prose(k, 200)) for k in range(20)]
    ids, marks = Encoder(public_tokenizers.path(file)).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[marks[i] : marks[i + 1]].tolist() == want


def expected(file, end):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    return [
        (r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [end], dtype="<u4"))
        for r in awkward()
    ]


def key(doc):
    return (doc is not None, doc or 0)


def test_token_files(spark, docs, nothing):
    path = public_tokenizers.path(FILES[0])
    folder = token_files.write_tokens(docs, path, shard_tokens=3000)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(expected(FILES[0], 0), key=lambda x: key(x[0]))
    assert [r.doc for r in got] == [d for d, _ in want]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    by_doc = sorted((str(d), zlib.crc32(i.tobytes()), len(i)) for d, i in want)
    assert sorted((str(r.doc), r.ids_crc32, r.n_tokens) for r in got) == by_doc
    shards = [s.asDict() for s in spark.read.parquet(folder).collect()]
    ids = dict(expected(FILES[0], 0))
    for shard in shards:
        for i, doc in enumerate(shard["docs"]):
            whole = token_files.decode_document(shard, i)
            if doc is not None:
                assert whole.tolist() == ids[doc].tolist()
            assert token_files.decode_document(shard, i, 1, 4).tolist() == whole[1:4].tolist()
    empty = token_files.write_tokens(nothing, path)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_compress_shrinks_and_expands():
    rng = np.random.default_rng(5)
    ids = rng.choice(40, 20_000, p=np.arange(1, 41)[::-1] / 820).astype(np.uint32)
    marks = np.array([0, 0, 500, 501, 12_000, 20_000, 20_000])
    seq, starts, rules, lengths, base = token_files.compress(ids, marks)
    assert len(seq) < 0.8 * len(ids) and len(rules)
    assert token_files.expand(seq, rules, base).tolist() == ids.tolist()
    sizes = np.where(seq >= base, lengths[np.maximum(seq.astype(int) - base, 0)], 1)
    assert np.concatenate(([0], np.cumsum(sizes)))[starts].tolist() == marks.tolist()


def plain_pairs(seq, starts):
    """Occurrences of each pair inside documents, without overlaps."""
    count = {}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        last = None
        for i in range(a, b - 1):
            pair = (int(seq[i]), int(seq[i + 1]))
            if pair[0] == pair[1] and last == (pair, i - 1):
                last = None
                continue
            last = (pair, i)
            count[pair] = count.get(pair, 0) + 1
    return count


@pytest.mark.parametrize("most", [2, token_files.PAIRS])
def test_compress_goes_on_until_no_pair_is_frequent(most):
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 5000, 64)
    parts = [np.concatenate((rng.integers(0, 5000, 9), passage)) for _ in range(200)]
    parts += [np.full(1000, 7), np.full(1001, 8), rng.integers(0, 30, 4000), np.full(3, 7)]
    ids = np.concatenate(parts).astype(np.uint32)
    marks = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    seq, starts, rules, lengths, base = token_files.compress(ids, marks, most=most)
    assert max(plain_pairs(seq, starts).values()) < token_files.LEAST
    assert lengths.max() >= 64 and (rules[:, 0] == rules[:, 1]).any()
    assert token_files.expand(seq, rules, base).tolist() == ids.tolist()
    sizes = np.where(seq >= base, lengths[np.maximum(seq.astype(int) - base, 0)], 1)
    assert np.concatenate(([0], np.cumsum(sizes)))[starts].tolist() == marks.tolist()


def test_counts_of_pairs_are_kept_up_to_date(monkeypatch):
    """Each round takes the most frequent pairs of the sequence as the rounds before left it, without counting it anew."""
    rng = np.random.default_rng(7)
    parts = [rng.choice(30, 700, p=np.arange(1, 31)[::-1] / 465) for _ in range(6)]
    parts += [np.full(77, 3), np.zeros(0, int), np.tile([3, 3, 3, 4, 4], 60)]
    ids = np.concatenate(parts).astype(np.uint32)
    marks = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    counted = []
    count = token_files.Pairs.count
    monkeypatch.setattr(token_files.Pairs, "count", lambda self, seq, inner, at: counted.append(int(at.sum())) or count(self, seq, inner, at))
    for done in range(5):
        seq, starts, rules, _, base = token_files.compress(ids, marks, done, most=20)
        after = token_files.compress(ids, marks, done + 1, most=20)[2][len(rules) :].tolist()
        plain = plain_pairs(seq, starts)
        times = [plain[tuple(pair)] for pair in after]
        assert times == sorted(times, reverse=True) and min(times) >= token_files.LEAST
        assert times[0] == max(plain.values())
    assert counted[-1] < counted[-6] == len(ids)
    shard = token_files.compress(ids, marks, most=20)
    assert token_files.expand_shard(shard[0], *shard[2:]).tolist() == ids.tolist()


def test_pairs_of_large_ids():
    """Pair and place do not fit one number."""
    ids = np.tile(np.array([5, 2**31, 7, 2**31 + 9], dtype=np.uint32), 40)
    seq, starts, rules, lengths, base = token_files.compress(ids, np.array([0, 100, 160]))
    assert len(seq) < len(ids) / 4 and starts.tolist()[0] == 0
    assert token_files.expand(seq, rules, base).tolist() == ids.tolist()


def test_packing(docs, nothing):
    path = public_tokenizers.path(FILES[1])
    got = [r.asDict() for r in packing.packed(docs, path, size=64).collect()]
    want = expected(FILES[1], 2)
    ids = {d: i for d, i in want if d is not None}
    for r in got:
        if r["doc"] is not None:
            own = ids[r["doc"]]
            assert r["doc_tokens"] == len(own)
            assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in want)
    for doc in (10, 18, 7):
        pieces = sorted((r["start"], r["length"]) for r in got if r["doc"] == doc)
        assert [s for s, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    partly = 0
    for pieces in windows.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert total <= 64
        partly += total < 64
    assert partly <= 3  # one for each task
    assert packing.packed(nothing, path).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(1)
    packer, count = packing.SumOfSquares(16), [0] * 17
    for k in range(400):
        n = int(rng.integers(1, 16))
        options = []
        for level in range(0, 17 - n):
            if level and not count[level]:
                continue
            after = list(count)
            if level:
                after[level] -= 1
            if level + n < 16:
                after[level + n] += 1
            options.append((sum(x * x for x in after), -level, after))
        packer.place((k, 0, np.zeros(n, np.uint32), n))
        count = min(options)[2]
        assert packer.count.tolist() == count
