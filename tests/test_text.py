"""Text functions on hand-made rows; Python's re is the yardstick where it applies."""

import decimal
import math
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finchlab.functions import patterns as P
from finchlab.functions import text as X
from finchlab.plans.features import add_count, add_matches, post_features
from finchlab.schemas import FEATURE_COLUMNS

EDGE_ROWS = [
    None,
    "",
    "   ",
    "RT @a_b: hi",
    "RTx not a retweet",
    "#",
    "#a#b",
    "##x",
    "@",
    "ÜNÏ café",
    "a!b??$5",
    "pic.twitter.com/abc pic.twitter.com/def",
    "https://t.co/x:)",
    "😀🎉",
    "🇺🇸",
    "don't cannot gonna",
    "ALL CAPITALS",
    "a b c",
    "tab\tand\nnewline",
    "no break em　wide",
    "3.14 and 42",
    "écannot cannotx CANNOT",
]


def run(spark, column_fn, rows=EDGE_ROWS):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    out = df.select("i", column_fn(F.col("c")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def one(spark, column_fn, text):
    return run(spark, column_fn, [text])[0]


def test_lists(spark):
    assert one(spark, X.hashtags, "#a#b ##x #") == ["#a", "#b", "#x"]
    assert one(spark, X.mentions, "RT @a_b: hi @") == ["@a_b"]
    assert one(spark, X.reserved_words, "RT RTx FAV xRT ÉRT RT_") == ["RT", "FAV"]
    assert one(spark, X.emojis, "😀🎉 🇺🇸") == ["😀", "🎉", "🇺", "🇸"]
    assert one(spark, X.smileys, "https://t.co/x :) ;-D") == [":)", ";-D"]
    assert one(spark, X.numbers, "3.14 and 42") == ["3", "14", "42"]
    assert one(spark, X.urls, "see https://t.co/x:) now") == ["https://t.co/x:)"]
    assert one(spark, X.pictures, "pic.twitter.com/a pic.twitter.com/b") == [
        "pic.twitter.com/a",
        "pic.twitter.com/b",
    ]


def test_capture_group_and_strip(spark):
    df = spark.createDataFrame([("#a and #b",)], "c string")
    assert add_matches(df, r"#(\w*)", "c", "x").first()["x"] == ["a", "b"]
    stripped = add_count(add_matches(df, r"#\w+", "c", "x", strip=True), "x").first()
    assert stripped["x"] == ["#a", "#b"]
    assert stripped["c"] == " and "
    assert stripped["x_count"] == 2
    assert X._group_of(r"a\(b") == 0
    assert X._group_of(r"[(]") == 0
    assert X._group_of(r"(?:a)") == 0
    assert X._group_of(r"(a)") == 1


def py_remove_punctuation(text):
    return re.sub(r"[^\w\s]", "", text).strip()


def py_pct_upper(text):
    compact = re.sub(r"\s+", "", text)
    return sum(c.isupper() for c in compact) / len(compact) if compact else 0


def test_punctuation_and_case_match_python(spark):
    rows = [r for r in EDGE_ROWS if r is not None]
    assert run(spark, X.remove_punctuation, rows) == [py_remove_punctuation(r) for r in rows]
    assert run(spark, X.pct_upper, rows) == pytest.approx([py_pct_upper(r) for r in rows])


# Java and Python know different Unicode versions: draw characters both have
COMMON = st.characters(codec="utf-8", categories=["L", "Nd", "P", "Zs", "Sm", "Sc"]).filter(
    lambda c: unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c)
)
LETTERS = st.text(COMMON | st.sampled_from(" \t\n"), max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS, min_size=1, max_size=20))
def test_text_properties(spark, rows):
    assert run(spark, X.remove_punctuation, rows) == [py_remove_punctuation(r) for r in rows]
    shares = run(spark, X.pct_upper, rows)
    assert all(0 <= s <= 1 for s in shares)
    words = run(spark, X.tokens, rows)
    assert run(spark, X.word_count, rows) == [len(w) for w in words]


def test_contractions(spark):
    assert one(spark, X.tokens, "I cannot GIMME wanna xgonna cannots écannot") == [
        "I", "can", "not", "GIM", "me".upper(), "wan", "na", "xgonna", "cannots", "écannot",
    ]


def test_stop_words_after_punctuation(spark):
    assert one(spark, X.content_tokens, "The dont cannot Café") == ["dont", "café"]


def test_emoticons(spark):
    text = ":) :( <3 x"
    assert one(spark, lambda c: X.emoticon_count(c, P.HAPPY_EMOTICONS), text) == 2
    assert one(spark, lambda c: X.emoticon_count(c, P.SAD_EMOTICONS), text) == 1


def test_small_mappings(spark):
    assert run(spark, X.wordnet_pos, ["JJ", "VBD", "NNS", "RB", "IN", ""]) == [
        "a", "v", "n", "r", None, None,
    ]
    assert one(spark, X.at_name, "bob") == "@bob"
    df = spark.createDataFrame([(0,), (1,), (None,)], "v int")
    assert [r[0] for r in df.select(X.zero_else(F.col("v"), "No", "Yes")).collect()] == ["No", "Yes", "Yes"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1000, 1000) | st.integers(-64, 64).map(lambda n: n / 32), min_size=1, max_size=30))
def test_fixed_decimals_round_the_shortest_decimal(spark, values):
    values = [*values, 1e16, 1e20, -1e20, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    for digits in (2, 3, 4):
        got = df.select("i", X.fixed_decimals(F.col("v"), digits).alias("s")).orderBy("i").collect()
        for row, v in zip(got, values, strict=True):
            if math.isfinite(v):
                exact = decimal.Decimal(repr(float(v)))
                step = decimal.Decimal(1).scaleb(-digits)
                assert decimal.Decimal(row["s"]) == exact.quantize(step, decimal.ROUND_HALF_UP)
            else:
                assert row["s"] == {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}[str(v)]


def posts_frame(spark, rows):
    return spark.createDataFrame(
        [(i, "a", r, None, 0) for i, r in enumerate(rows)],
        "post_id int, author string, content string, publish_date timestamp_ntz, target int",
    )


def test_feature_table(spark):
    rows = ["Hi! RT @bob see https://t.co/x #A #b 😀 pic.twitter.com/q What? $5", None, ""]
    out = post_features(posts_frame(spark, rows), keep=["post_id"]).orderBy("post_id").collect()
    assert list(out[0].asDict()) == ["post_id", *FEATURE_COLUMNS]
    first = out[0].asDict()
    assert {k: v for k, v in first.items() if k.endswith("_count")} == {
        "urls_count": 1, "mentions_count": 1, "hashtags_count": 2, "reserved_words_count": 1,
        "emojis_count": 1, "word_count": 3, "exclams_count": 1, "ques_marks_count": 1,
        "dollar_marks_count": 1, "pics_count": 1,
    }
    assert "pic.twitter" not in first["content"]
    assert first["content_tokenized_lemma_joined"] == "hi see"
    assert first["hashtags_joined"] == "#A #b"
    for empty in out[1:]:
        assert empty["word_count"] == 0
        assert empty["pct_upper"] == 0.0
        assert empty["content_tokenized_lemma_joined"] == ""


def test_marks_counted_after_cleaning_are_zero(spark):
    features = post_features(posts_frame(spark, ["a! b? $c"]), "clean").first()
    assert features["exclams_count"] == features["ques_marks_count"] == 0
    assert features["dollar_marks_count"] == 0


def test_feature_plan_has_no_python_and_no_shuffle(spark):
    plan = post_features(posts_frame(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert "Exchange" not in plan


@pytest.mark.parametrize("pattern", sorted(P.QUICK))
def test_quick_patterns_match_the_same_characters(spark, pattern):
    assert X.quick(pattern) != pattern
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 4096]) for i in range(0, len(points), 4096)] + ["".join(points[::4099])]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.matches(F.col("t"), pattern).alias("quick"),
        F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("plain"),
        X.without(F.col("t"), pattern).alias("rest"),
        F.regexp_replace("t", pattern, "").alias("plain_rest"),
    )
    assert found.filter(F.size("plain") > 0).count() > 0
    assert found.filter("quick != plain or rest != plain_rest").count() == 0
