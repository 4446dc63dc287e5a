"""Exact, near and substring duplicates against plain Python."""

import hashlib
from collections import Counter

import numpy as np

from finchlab.llm import components, exact_dedup, near_dedup, substring_dedup
from tests.llm.cases import SCHEMA, SPACE, awkward, prose, row, shingles, words
from tests.llm.cases import components as plain_components


def test_exact_groups(docs):
    got = Counter((r.doc, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    groups = {}
    for r in awkward():
        groups.setdefault(SPACE.sub(" ", r[1] or ""), []).append(r[0])
    want = Counter()
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want.update((i, first, len(ids), i == first) for i in ids)
    assert got == want


def test_prefixes_of_any_length_give_the_same_groups(docs):
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    for prefix in (0, 1, 10_000):
        assert sorted(map(str, exact_dedup.exact_groups(docs, prefix=prefix).collect())) == want


def test_unique_lengths_and_prefixes_are_not_hashed(spark, docs, monkeypatch):
    """Only rows that share length and prefix get a full hash."""
    tables = {}
    plain = exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: tables.setdefault(name, plain(df, name)))
    exact_dedup.exact_groups(docs).count()
    norm = [SPACE.sub(" ", r[1] or "") for r in awkward()]
    pairs = Counter((len(t), t[:64]) for t in norm)
    hashed = tables["hashed-texts"].filter("_key is not null").count()
    assert hashed == sum(n for n in pairs.values() if n > 1) < len(norm)


def test_drop_copies_keeps_all_columns_and_one_row(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub(" ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub(" ", r[1] or "") for r in awkward()})
    assert {r.copy for r in kept.collect()} == {7}


def test_empty_tables(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0
    assert near_dedup.near_groups(nothing).count() == 0
    assert substring_dedup.trim_repeats(nothing).count() == 0


def near_truth(rows):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], set()).update(shingles(r[1]))
    ids = sorted(sets)
    pairs = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, plain_components(pairs, ids)


def test_near_groups(docs):
    rows = awkward()
    sets, component = near_truth(rows)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc is None:
            assert r.component_id is None
        else:
            assert r.component_id == component[r.doc]
            assert r.n_shingles == len(sets[r.doc])


def crowd():
    """Copies of one source that resemble it more than one another; its id is not the smallest."""
    base = prose(9, 300)
    rows = [row(500, " ".join(base))]
    for k in range(90):
        copy = list(base)
        for j in range(7):
            copy[(37 * k + 41 * j) % 300] = f"edit{k}x{j}"
        rows.append(row(k, " ".join(copy)))
    for k in range(60):  # share a passage and nothing else
        rows.append(row(1000 + k, " ".join(prose(3000 + k, 90) + base[:60])))
    return rows


def test_crowded_groups_lose_no_link(spark):
    rows = crowd()
    _, component = near_truth(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for limit in (48, 4):
        got = {r.doc: r.component_id for r in near_dedup.near_groups(docs, crowd=limit).collect()}
        assert got == component


def test_a_group_that_hangs_together_makes_no_rows_per_shingle(spark, monkeypatch):
    made, write = {}, near_dedup.staged

    def counting(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "staged", counting)
    docs = spark.createDataFrame(crowd()[:91], SCHEMA).repartition(4)
    groups = {r.component_id for r in near_dedup.near_groups(docs, crowd=4).collect()}
    assert groups == {0}
    assert made["crowded"] > 0
    assert made["prefixes"] == 0


def test_drop_near_copies(docs):
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    _, component = near_truth(awkward())
    assert ids - {None} == set(component.values())


def test_signature_agrees_as_often_as_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    agree = []
    for k in range(200):
        a, b = np.sort(pool[:300]), np.sort(pool[75:375])
        pool = np.roll(pool, 17 * k)
        both = near_dedup.signatures(np.concatenate((a, b)), np.array([0, 300, 600]))
        agree.append((both[0] == both[1]).mean())
    # similarity 225 / 375
    assert abs(np.mean(agree) - 0.6) < 0.02
    assert np.std(agree) < (0.6 * 0.4 / near_dedup.SLOTS) ** 0.5 * 1.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 1500), (7, 7)]
    links = spark.createDataFrame(chain, "x long, y long").repartition(5)
    got = {r.doc: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1500: 1000, 2000: 1000}


def trimmed_truth(rows, window=50):
    first = {}
    for r in rows:
        w = words(r[1])
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[p : p + window])] < r[0]:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def trimmed(docs, **options):
    rows = substring_dedup.trim_repeats(docs, **options).collect()
    return [(r.doc, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows]


def test_trim_repeats(docs):
    assert sorted(trimmed(docs), key=str) == sorted(trimmed_truth(awkward()), key=str)


def test_trim_runs_and_edges(spark):
    run = ["a"] * 120
    unit = "p q r s t u v".split()
    rows = [
        row(1, " ".join(run)),
        row(2, " ".join(["z"] + run[:60] + ["y"])),
        row(3, " ".join(unit * 20)),
        row(4, " ".join(["k"] + unit * 15 + ["a"] * 49)),
        row(5, " ".join(run[:50])),
        row(6, " ".join(prose(8, 49) + ["b"])),
        row(7, " ".join(prose(8, 49) + ["b"])),
        row(8, " ".join(prose(8, 49) + ["c"])),
        row(9, " ".join(unit * 8)),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for rounds in (0, 2, 4, 7):
        assert sorted(trimmed(docs, rounds=rounds), key=str) == sorted(trimmed_truth(rows), key=str)


def test_trim_many_shared_passages(spark):
    passage, other = prose(77, 80), prose(78, 64)
    rows = [
        row(k, " ".join(prose(100 + k, 30 + k % 7) + passage[k % 5 :] + prose(200 + k, 20) + other[: 50 + k % 15]))
        for k in range(40)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(trimmed(docs), key=str) == sorted(trimmed_truth(rows), key=str)


def test_near_groups_of_ids_with_several_texts(spark):
    """An id has the links of each of its rows, one that is folded into a copy included."""
    base, other = prose(50, 200), prose(51, 200)
    close = [*other[:190], *prose(52, 10)]
    texts = [(1, base), (3, base), (3, other), (2, close), (4, prose(53, 80)), (4, prose(54, 80)), (9, prose(54, 80))]
    rows = [row(i, " ".join(t)) for i, t in texts]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 9: 4}
    for some in (rows, rows[::-1]):
        got = near_dedup.near_groups(spark.createDataFrame(some, SCHEMA).repartition(3)).collect()
        assert len(got) == len(rows)
        assert {r.doc: r.component_id for r in got} == want


def test_trim_ids_with_several_texts(spark):
    long, other = prose(60, 300), prose(61, 120)
    texts = [(1, long), (5, long), (5, ["short", "text", "only"]), (5, other), (7, other), (7, long[:90] + other[:60])]
    rows = [row(i, " ".join(t)) for i, t in texts]
    want = sorted(trimmed_truth(rows), key=str)
    assert sorted(r[2] for r in want) == [0, 0, 0, 120, 150, 300]
    for some in (rows, rows[::-1]):
        for parts in (1, 3):
            docs = spark.createDataFrame(some, SCHEMA).repartition(parts)
            assert sorted(trimmed(docs), key=str) == want
