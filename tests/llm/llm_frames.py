"""Small tables with what the operators must bear: nulls, repeats, long texts, clashing columns."""

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Names that the operators use for columns of their own.
CLASHES = (
    "key size place block bucket member words probe text_hash n_words spans items signature set_key "
    "findings target copies taken rank low high content shared string label before rest learned hash"
).split()


def words(draw, number, letters="abcdefghij"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) for _ in range(number))


def edge_rows():
    """Documents: ordinary, copied, nearly copied, empty, blank, NULL, long, repeated."""
    draw = random.Random(7)
    base = words(draw, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "aa", "s1"),
        (2, base, "aa", "s1"),
        (3, " ".join(near), "aa", "s2"),
        (4, base.upper(), "aa", None),
        (5, "", "aa", "s2"),
        (6, " \n\t ", None, "s2"),
        (7, None, "aa", "s3"),
        (8, None, None, None),
        (9, words(draw, 30_000), "aa", "s1"),
        (10, words(draw, 80, "qrstuvwxyz"), "bb", "s4"),
        (11, words(draw, 90, "qrstuvwxyz"), "bb", "s4"),
        (12, "one", "bb", "s4"),
        (13, "one two three four", "bb", "s4"),
        (14, "1234 5678 !!", "bb", "s4"),
        (15, "éàü ß 中文 \U0001f600 " + words(draw, 20), "aa", "s5"),
        (16, words(draw, 50), "aa", "s5"),
        (16, words(draw, 50), "aa", "s5"),
        (17, "same row", "aa", "s6"),
        (17, "same row", "aa", "s6"),
        (None, words(draw, 40), "aa", "s6"),
        (None, None, None, None),
        (18, "x" * 5_000, "aa", "s7"),
        (19, "ab" * 3_000, "aa", "s7"),
    ]
    return [(*row, len(row[1]) if row[1] is not None else None) for row in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, DOCUMENTS).repartition(3)


def with_clashes(df):
    """The table with further columns under the names that operators use."""
    return df.select("*", *(F.lit(i).alias(name) for i, name in enumerate(CLASHES) if name not in df.columns))


def same_rows(found, expected):
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])
    assert order(found) == order(expected)
