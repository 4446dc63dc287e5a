"""Language identification, toxicity and language-model scores."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from finchlab.llm import language_id, lm_scoring, toxicity
from finchlab.llm.letters import remainder
from tests.llm.cases import SCHEMA, awkward, prose, row, words


def test_remainder_is_the_filter(spark):
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in ids.filter(language_id.held_out(F.col("doc_id"))).collect()}
    assert got == {i for i in range(200) if remainder(i, 3) == 1}


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    assert model.languages == ["de", "en", "es", "fr"]
    out = language_id.predict(docs, model).join(docs.withColumnRenamed("doc_id", "doc"), "doc")
    rows = out.filter(language_id.held_out(F.col("doc"))).collect()
    assert len(rows) > 250
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, docs, nothing):
    model = language_id.fit(docs)
    got = Counter((r.doc, r.lang_pred == "und", r.score == 0) for r in language_id.predict(docs, model).collect())
    blind = [not any(c.isalpha() for c in r[1] or "") for r in awkward()]
    assert got == Counter((r[0], b, b) for r, b in zip(awkward(), blind, strict=True))
    untaught = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict(docs, untaught).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_language_scores_are_bayes(spark):
    """Label and score of every row, from counts of plain n-grams."""
    rows = [row(1, "aab ab", "x"), row(2, "bba", "y"), row(3, "ab", None), row(4, "abba bab aab", "y"), row(5, "Bä-ß 7", "z"), row(6, "z", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)

    def grams(text):
        low = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        return [low[i : i + n] for n in (2, 3) for i in range(len(low) - n + 1)]

    got = {r.doc: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    langs = sorted({r[2] for r in rows if r[2]})
    counts = {x: Counter(g for r in rows if r[2] == x for g in grams(r[1])) for x in langs}
    prior = {x: sum(r[2] == x for r in rows) / 5 for x in langs}
    for r in rows:
        like = {}
        for x in langs:
            total = sum(counts[x].values()) + language_id.SMOOTHING * language_id.FEATURES
            like[x] = math.log(prior[x]) + sum(
                math.log((counts[x][g] + language_id.SMOOTHING) / total) for g in grams(r[1])
            )
        best = max(langs, key=lambda x: like[x])
        share = 1 / sum(math.exp(v - like[best]) for v in like.values())
        assert got[r[0]].lang_pred == best
        assert got[r[0]].score == pytest.approx(share, rel=1e-4)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    rows = [row(k, "some text", f"l{k}") for k in range(4)]
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.fit(spark.createDataFrame(rows, SCHEMA))
    assert language_id.fit(spark.createDataFrame(rows[:3], SCHEMA)).languages == ["l0", "l1", "l2"]


def test_folding():
    assert toxicity.fold("Іdi0t, STÜPID! m0rоn 1d1ot") == "idiot stupid moron idiot"


def toxic_corpus(spark):
    rows, labels = [], []
    for k in range(300):
        text, toxic = prose(k, 40 + k % 50), k % 6 == 0
        if toxic:
            text[k % 30] = ("grumbold", "Grumbolds", "snarkle")[k % 3]
        rows.append(row(k, " ".join(text)))
        labels.append((k, int(toxic), "extra"))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_learns_and_matches(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.fit(docs, labels.filter("doc_id < 240"), exceptions=("grumbold fish",))
    extra = [
        row(1000, "x grumb0lԁ y"),
        row(1001, "the grumbold fish"),
        row(1002, None),
        row(1003, ""),
        row(1004, "ungrumbold"),
    ]
    more = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r.doc: r for r in toxicity.scored(more, lexicon).collect()}
    wrong = [k for k in range(240, 300) if (got[k].score >= 0.5) != (k % 6 == 0)]
    assert not wrong
    assert got[1000].score >= 0.5
    assert got[1001].weight == got[1002].weight == got[1003].weight == got[1004].weight == 0
    assert got[1002].score == got[1003].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values())


def test_longer_texts_score_lower_for_one_match(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    few = [row(1, "grumbold " + " ".join(prose(1, 20))), row(2, "grumbold " + " ".join(prose(1, 3000)))]
    got = {r.doc: r.score for r in toxicity.scored(spark.createDataFrame(few, SCHEMA), lexicon).collect()}
    assert got[1] >= got[2]


def test_copies_of_a_toxic_text_do_not_crowd_out_its_term(spark):
    """Words that only come along in copies are no entries; a term of few other texts is."""
    copies = " ".join(["snarkle", *(f"along{k}x" for k in range(400))])
    rows = [row(k, copies) for k in range(60)]
    rows += [row(100 + k, " ".join([*prose(900 + k, 30), "grumbold", *prose(950 + k, 30)])) for k in range(12)]
    rows += [row(200 + k, " ".join([*prose(k, 50), "snarkle"])) for k in range(10)]
    clean = [row(300 + k, " ".join(prose(2000 + k, 60))) for k in range(400)]
    labels = [(r[0], 1) for r in rows] + [(r[0], 0) for r in clean]
    docs = spark.createDataFrame(rows + clean, SCHEMA)
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("grumbold".startswith(e) for e in lexicon.weights)
    assert not any(e.startswith("along") and len(e) > 5 for e in lexicon.weights)
    got = {r.doc: r.score for r in toxicity.scored(docs, lexicon).collect()}
    assert all(got[100 + k] >= 0.5 for k in range(12)) and all(got[r[0]] < 0.5 for r in clean)


def test_short_words_and_learned_exceptions(spark):
    rows, labels = [], []
    for k in range(400):
        text, toxic = prose(k, 30), k % 4 == 0
        text[10:12] = ["zug", "hello"] if toxic else ["zug", "fish"] if k % 80 == 1 else ["calm", "fish"]
        rows.append(row(k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    settings = toxicity.Settings(min_share=0.9)
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), settings=settings)
    assert "zug " in lexicon.weights and "zug fish" in lexicon.exceptions and "zug hello" not in lexicon.exceptions
    few = [row(1, "zug"), row(2, "zug fish"), row(3, "zugs"), row(4, "a zug and a zug fish"), row(5, "azug")]
    got = {r.doc: r.weight for r in toxicity.scored(spark.createDataFrame(few, SCHEMA), lexicon).collect()}
    one = lexicon.weights["zug "]
    assert got == {1: one, 2: 0, 3: 0, 4: one, 5: 0}


def test_weights_and_scores_match_a_plain_version(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    a, b, c = lexicon.curve
    phrases = [f" {toxicity.fold(p)} " for p in lexicon.exceptions]
    for r in toxicity.scored(docs, lexicon).collect():
        text = " " + toxicity.fold(next(x.text for x in docs.filter(F.col("doc_id") == r.doc).collect())) + " "
        total = 0.0
        for at in range(len(text)):
            inside = any(text.startswith(p, s) for p in phrases for s in range(max(0, at - len(p) + 2), at + 1))
            if text[at] == " " and not inside:
                total += sum(w for e, w in lexicon.weights.items() if text.startswith(" " + e, at))
        assert r.weight == pytest.approx(total) and r.words == len(text.split())
        z = a + b * math.log1p(total) + c * total / math.sqrt(max(r.words, 1))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
        if r.doc >= 20:
            break


def test_toxicity_without_lessons(spark, docs, nothing):
    labels = spark.createDataFrame([(10, 0), (11, None)], "doc_id long, toxic int")
    untaught = toxicity.fit(docs, labels)
    assert {r.score < 0.5 for r in toxicity.scored(docs, untaught).collect()} == {True}
    assert toxicity.scored(docs, untaught).count() == len(awkward())
    assert toxicity.scored(nothing, untaught).count() == 0
    # labels, but no text of a toxic row
    alone = toxicity.fit(docs, spark.createDataFrame([(10, 0), (99999, 1)], "doc_id long, toxic int"))
    assert {r.score < 0.5 for r in toxicity.scored(docs, alone).collect()} == {True}


def backoff_scores(rows, order, alpha):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = [[w.translate(low) for w in words(r[1])] for r in rows]
    total = Counter(tuple(t[i - n : i]) for t in texts for n in range(1, order + 1) for i in range(n, len(t) + 1))
    size = sum(map(len, texts))
    out = []
    for t in texts:
        own = Counter(tuple(t[i - n : i]) for n in range(1, order + 1) for i in range(n, len(t) + 1))

        def score(i, n, t=t, own=own):
            gram = tuple(t[i - n + 1 : i + 1])
            count = total[gram] - own[gram]
            if n == 1:
                return math.log(count / (size - len(t))) if count else math.log(alpha / size)
            context = gram[:-1]
            if count:
                return math.log(count / (total[context] - own[context]))
            return math.log(alpha) + score(i, n - 1)

        out.append(sum(score(i, min(order, i + 1)) for i in range(len(t))))
    return out


@pytest.mark.parametrize(("order", "chunk"), [(2, 8 << 20), (2, 2000), (3, 5000), (1, 5000)])
def test_backoff_scores(docs, order, chunk):
    rows = awkward()
    want = Counter(
        (r[0], len(words(r[1])), round(s, 4)) for r, s in zip(rows, backoff_scores(rows, order, 0.4), strict=True)
    )
    got = lm_scoring.scored(docs, order=order, chunk_bytes=chunk).collect()
    assert Counter((r.doc, r.n_words, round(r.log_score + 0.0, 4)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_backoff_scores_of_nothing(nothing):
    assert lm_scoring.scored(nothing).count() == 0
