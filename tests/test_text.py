import random

import pytest
from pyspark.ml.feature import StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from reelmart.functions import text
from reelmart.operators.reviews import classify_reviews, review_scores, review_tokens

EDGES = [
    "A GOOD film",
    "Goodness me",
    "not good",
    "bad",
    "",
    " ",
    "\n",
    "trailing  blanks   ",
    "  leading",
    "inner  gap the",
    "the  ",
    "a the  ",
    'quotes "and"\nlines',
    "tab\there\x0bvertical\fform\rreturn",
    "I can't, you CAN'T",
    "the and the",
]


def _random_texts(n):
    rng = random.Random(7)
    pieces = ["the", "and", "good", "Good", "x", "ness", " ", "  ", "\n", "\t", "can't", "", "an"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(EDGES + _random_texts(300)))
    return spark.createDataFrame(rows, "id long, t string").cache()


def test_stop_words_are_the_default_list(spark):
    assert list(text.ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens_and_clean_text_equal_the_ml_transformers(texts):
    by_ml = StopWordsRemover(inputCol="tokens", outputCol="clean").transform(
        Tokenizer(inputCol="t", outputCol="tokens").transform(texts)
    )
    rows = by_ml.select(
        "t",
        "tokens",
        F.concat_ws(" ", "clean").alias("clean"),
        text.tokens(F.col("t")).alias("own_tokens"),
        text.clean_text(F.col("t")).alias("own_clean"),
    ).collect()
    for row in rows:
        assert row.own_tokens == row.tokens, row.t
        assert row.own_clean == row.clean, row.t


@pytest.mark.parametrize("keyword", ["good", "the", "an", "x", "good x", "ness", "GOOD", "can't", " "])
def test_mentions_equals_search_in_clean_text(texts, keyword):
    wrong = texts.where(
        text.mentions(F.col("t"), keyword)
        != F.when(text.clean_text(F.col("t")).contains(keyword), 1).otherwise(0)
    )
    assert wrong.collect() == []


def test_mentions_skips_the_token_array_only_where_it_may(spark, texts):
    def plan(keyword):
        return texts.select(text.mentions(F.col("t"), keyword))._jdf.queryExecution().toString()

    assert "split" not in plan("good")
    assert "split" in plan("the")
    assert "split" in plan("o g")


def test_classification_keeps_substrings_and_null_text(spark):
    raw = spark.createDataFrame(
        [(1, "A GOOD film", 10), (1, "Goodness me", 11), (2, "not good", 12), (2, "bad", 13),
         (3, "", 14), (3, None, 15), (None, "good", 16), (4, "good", None)],
        "cid long, review_str string, id_review long",
    )
    classified = classify_reviews(raw)
    assert classified.columns == ["user_id", "positive_review", "review_id"]
    flags = {row.review_id: row.positive_review for row in classified.collect()}
    assert flags == {10: 1, 11: 1, 12: 1, 13: 0, 14: 0, 15: 0, 16: 1, None: 1}
    scores = {r.user_id: (r.review_score, r.review_count) for r in review_scores(classified).collect()}
    assert scores == {1: (2, 2), 2: (1, 2), 3: (0, 2), None: (1, 1), 4: (1, 0)}


def test_review_tokens(spark):
    raw = spark.createDataFrame([(1, "The  good film ", 5)], "cid long, review_str string, id_review long")
    row = review_tokens(raw).first()
    assert (row.review_id, row.n_tokens, row.review_clean_str) == (5, 4, " good film")
