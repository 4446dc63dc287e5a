"""Quality rules, mixing, and the stages of the pipeline."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from finchlab.llm import mixing, quality
from tests.llm.cases import SCHEMA, awkward, prose, row, words


def plain_counts(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), signs, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality.judged(docs).collect()
    )
    want = Counter()
    for r in awkward():
        c = plain_counts(r[1])
        want[(r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want


def divergence(p, q):
    def h(x):
        return sum(v * math.log2(v) for v in x if v > 0)

    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(h(p) / 2 + h(q) / 2 - h(m), 0))


def test_distances(docs):
    refs = quality.references(docs)
    assert set(refs) == {"en", "fr"}
    sizes = {}
    for r in quality.judged(docs, refs=refs).collect():
        sizes[r.doc_id] = r
    text = next(r[1] for r in awkward() if r[0] == 18)
    w = words(text)
    counts = [sum(x == v for x in w) for v in quality.VOCABULARY]
    p = [c / len(w) for c in counts] + [1 - sum(counts) / len(w)]
    nearest = min(divergence(p, [*r.words, 1 - sum(r.words)]) for r in refs.values())
    assert abs(sizes[18].word_distance - nearest) < 1e-9
    kinds = [str.islower, str.isupper, str.isdigit, str.isspace, lambda c: c in ".,;:!?'\"()-"]
    n = [sum(k(c) for c in text) for k in kinds] + [0, 0, 0]
    nearest = min(divergence([x / len(text) for x in n], r.classes) for r in refs.values())
    assert abs(sizes[18].class_distance - nearest) < 1e-9
    assert sizes[14].class_distance == sizes[14].word_distance == 0  # too short


def test_quality_of_nothing(nothing, docs):
    assert quality.judged(nothing).count() == 0
    assert quality.judged(docs, refs={}).filter("kept").count() > 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").filter("not base_failed")
    counts = {(r.quality, r.kept): r.n for r in rows.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts.get((1, False), 0) == 0
    assert counts[(0, False)] > counts.get((0, True), 0)


def test_short_documents_are_judged_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judged(docs).join(labels, "doc_id").filter("not base_failed")
    rows = judged.withColumn("long", F.expr("n_words >= 200")).groupBy("long", "quality", "kept").count().collect()
    n = {(r.long, r.quality, r.kept): r["count"] for r in rows}
    # 59 of 112 short bad documents were kept when short texts had other rules
    assert n.get((False, 0, True), 0) <= 0.05 * n[(False, 0, False)]
    assert n.get((False, 1, False), 0) <= 0.01 * n[(False, 1, True)]
    assert n.get((True, 0, True), 0) == n.get((True, 1, False), 0) == 0


def test_limits_have_no_step(spark):
    n, near = F.col("id"), F.lit(0.1)
    sizes = spark.range(50, 450).select(
        quality.class_limit(6 * n, n, near).alias("c"), quality.word_limit(n).alias("w")
    )
    c, w = np.array(sizes.orderBy("id").collect()).T
    for limit, last in ((c, quality.RULES.max_class_distance), (w, quality.RULES.max_word_distance)):
        assert -0.01 < np.diff(limit).min() and np.diff(limit).max() < 0 and last < limit[-1] < last + 0.02
    assert w[0] < 0.3355  # nearer than a text without any listed word


def test_mixing_counts(spark):
    rows = [row(k, "t", "en", "a" if k % 4 else "b") for k in range(4000)] + [row(None, "t", "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.replicated(docs, weights={"a": 1.0, "b": 3.0})
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy", "mix_key"]
    got = got.collect()
    share = Counter(r.source for r in got)
    assert abs(share["b"] / len(got) - 0.75) < 0.02
    assert abs(len(got) - 4001) < 250
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    # the counts of a source follow the Poisson distribution of its rate
    rate = 0.75 * 4001 / 1000
    seen = np.bincount([len(copies.get(k, ())) for k in range(0, 4000, 4)], minlength=12) / 1000
    want = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(12)]
    assert np.abs(seen[:12] - want).max() < 0.05
    # neighbours come from all over the input
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert np.mean(np.abs(np.diff(ids)) > 100) > 0.8


def test_large_rates_are_split(spark):
    rows = [row(k, "t", "en", "big") for k in range(9000)] + [row(9000 + k, "t", "en", "tiny") for k in range(4)]
    got = mixing.replicated(spark.createDataFrame(rows, SCHEMA), temperature=0.0)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["tiny"] - 4502) < 5 * 4502**0.5


def test_mixing_of_awkward_rows(docs, nothing):
    got = mixing.replicated(docs).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in awkward()}
    assert mixing.replicated(nothing).count() == 0


def test_stages_keep_their_columns(spark, docs, nothing):
    for start in (docs, nothing):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, None)
            if name != "pack":
                assert out.columns == start.columns
            rows = out
        assert (rows.count() > 0) == (start.count() > 0)


def test_every_operator_is_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()


def test_columns_of_any_name(docs):
    """Rules and mixing keep extra columns that have the names used inside."""
    names = ["_q", "_s", "_source", "_cdf", "_parts", "_copies", "_copy", "_key", "_row", "_id", "_class_limit", "a.b"]
    wide = docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for plain, result in (
        (quality.judged(docs), quality.judged(wide)),
        (mixing.replicated(docs), mixing.replicated(wide)),
    ):
        own = [f"`{n}`" for n in names]
        assert set(names) <= set(result.columns)
        assert {tuple(r) for r in result.select(*own).collect()} == {tuple(range(len(names)))}
        assert sorted(map(str, result.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
