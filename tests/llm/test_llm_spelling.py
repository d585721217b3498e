"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_frames import documents, edge_rows, with_clashes

from reelmart.llm import spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _expected(counts):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        rows[w] = (form, n, len(near), counts[form] if form else None)
    found = []
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        found.append((w, form, root, n, n_near, form_n))
    return sorted(found)


def _sorted(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def _variant(draw, word, letters):
    at = draw.randrange(len(word) + 1)
    return draw.choice([word[:at] + draw.choice(letters) + word[at:], word[:at] + word[at + 1 :],
                        word[:at] + draw.choice(letters) + word[at + 1 :]])


def _made_words(draw, letters, number):
    made = {"".join(draw.choice(letters) for _ in range(draw.randint(6, 9))) for _ in range(number)}
    for word in list(made):
        made |= {_variant(draw, word, letters) for _ in range(3)}
    # One beginning and one end that a third of all words share.
    made |= {"prefix" + "".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(number)}
    made |= {"".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) + "suffix" for _ in range(number // 2)}
    return {w: draw.choice([5, 6, 30, 200, 2_000]) for w in made if w}


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzéÿ×"])
@pytest.mark.parametrize("most_pairs", [spelling.MOST_PAIRS, 20])
def test_variants_equal_brute_force(spark, letters, most_pairs):
    """Long lists are cut again and again, down to words that differ in one character."""
    counts = _made_words(random.Random(len(letters)), letters, 120)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert _sorted(spelling.grouped_variants(words, most_pairs=most_pairs)) == _expected(counts)


def test_large_lists_are_not_compared_with_all(spark):
    """Words that share all but their last five characters: the lists that are joined stay short."""
    draw = random.Random(4)
    words = {"abcdefgh" + "".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3_000)}
    rows = spelling._posted(spelling._opened(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")))
    first = spelling._large_lists(rows, 10_000).collect()
    assert first and max(r.pairs for r in first) > 1_000_000
    large = spelling._large_lists(rows, 10_000).select("list")
    again = spelling._posted(rows.join(large, "list", "left_semi"))
    assert sum(r.pairs for r in spelling._large_lists(again, 0).collect()) < 1_000_000 < 3_000**2


def test_documents_equal_brute_force(spark):
    draw = random.Random(9)
    base = [f"{a}{b}{c}" for a in ("spell", "word", "Étud") for b in ("ing", "ed", "er") for c in ("s", "ly", "ness")]
    rows = list(edge_rows())
    for i in range(400):
        picked = [draw.choice(base) for _ in range(60)]
        picked = [_variant(draw, w, LOWER) if draw.random() < 0.1 else w for w in picked]
        rows.append((100 + i % 350, draw.choice([" ", ", ", "9", "-"]).join(picked), "aa", "s", 0))
    rows += [(None, " ".join(base), "aa", "s", 0)] * 3
    counts = _words(rows)
    assert any(n > 100 for n in counts.values())
    docs = documents(spark, rows)
    for table in (docs, with_clashes(docs)):
        assert _sorted(spelling.spelling_variants(table)) == _expected(counts)


def test_few_words(spark):
    assert spelling.spelling_variants(documents(spark, [])).collect() == []
    rows = [(1, None, "aa", "s", 0), (2, "", "aa", "s", 0), (3, "1 22", "aa", "s", 0), (4, "a b", "aa", "s", 0)]
    assert spelling.spelling_variants(documents(spark, rows)).collect() == []
    one = [(5, "single " * 5, "aa", "s", 0)]
    assert _sorted(spelling.spelling_variants(documents(spark, one))) == [("single", None, "single", 5, 0, None)]


def test_chains_lead_to_the_last_form(spark):
    chain = [("aaaaaa" + "b" * i, 5 * 6**i) for i in range(7)]
    words = spark.createDataFrame(chain, "word string, n bigint")
    found = {r.word: r.root for r in spelling.grouped_variants(words).collect()}
    assert set(found.values()) == {chain[-1][0]}
