"""Decontamination, repeated bytes and near-duplicates against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from llm_frames import documents, edge_rows, same_rows, with_clashes, words
from pyspark.sql import functions as F

from reelmart.llm import decontamination, near_duplicates, substring_dedup

# Decontamination ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _windows(benchmark, n=13):
    found = collections.defaultdict(set)
    for item, text in benchmark:
        own = _words(text)
        size = min(n, len(own))
        for i in range(len(own) - size + 1) if own else ():
            found[tuple(own[i : i + size])].add("null" if item is None else str(item))
    return found


def _brute_hits(text, windows):
    own, hit, items = _words(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(own) - size + 1):
            found = windows.get(tuple(own[i : i + size]))
            if found:
                hit.update(range(i, i + size))
                items |= found
    return len(own), len(hit), sorted(items)


def _benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("words", F.lit("clash"))


def _contaminated_tables():
    draw = random.Random(11)
    items = [(i, words(draw, draw.randint(1, 40), "abc")) for i in range(25)]
    items += [(90, "same text here"), (91, "Same, TEXT: here!"), (92, None), (93, " ... "), (None, "nobody's item")]
    items += [(94, "É été"), (95, "x"), (96, " ".join(f"w{i}" for i in range(13)))]
    rows = []
    for i in range(60):
        text = words(draw, draw.randint(0, 60), "abc")
        if i % 3 == 0:
            own = items[draw.randrange(25)][1].split()
            cut = draw.randint(0, max(0, len(own) - 14))
            text += "! " + ";".join(own[cut:]).upper() + " " + words(draw, 30, "abc")
        if i % 7 == 0:
            text += " Same-Text\nhere nobody's... ITEM x É été é ÉTÉ " + " ".join(f"w{i}" for i in range(13))
        rows.append((i, text, "aa", "s", 0))
    return items, rows + edge_rows()


def test_hits_equal_brute_force(spark):
    items, rows = _contaminated_tables()
    windows = _windows(items)
    found = decontamination.contamination(with_clashes(documents(spark, rows)), _benchmark(spark, items))
    result = [(r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in found.collect()]
    expected = [(r[0], *_brute_hits(r[1], windows)) for r in rows]
    same_rows(result, [(*e[:3], tuple(e[3])) for e in expected])
    assert sum(e[2] > 0 for e in expected) > 20


def test_several_passes_give_the_same(spark, monkeypatch):
    items, rows = _contaminated_tables()
    docs, benchmark = documents(spark, rows), _benchmark(spark, items)
    once = decontamination.window_hits(docs, benchmark).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_GRAMS", 150)
    same_rows(decontamination.window_hits(docs, benchmark).collect(), once)


def test_removal(spark):
    items = [(1, " ".join(f"w{i}" for i in range(13)))]
    text = "Before it: " + ", ".join(f"W{i}" for i in range(13)) + "! after it."
    long = text + " " + words(random.Random(1), 400)
    docs = with_clashes(documents(spark, [(1, text, "a", "s", 0), (2, long, "a", "s", 0), (3, None, None, None, 0)]))
    benchmark = _benchmark(spark, items)
    assert {r.doc_id for r in decontamination.decontaminate(docs, benchmark).collect()} == {2, 3}
    cut = decontamination.decontaminate(docs, benchmark, mode="spans")
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "Before it: after it." and texts[3] is None
    assert texts[2] == long.replace(text, "Before it: after it.")


def test_empty_tables(spark):
    docs, none = documents(spark), _benchmark(spark, [])
    found = decontamination.contamination(docs, none).collect()
    assert len(found) == len(edge_rows()) and not any(r.n_hit for r in found)
    assert decontamination.contamination(documents(spark, []), _benchmark(spark, [(1, "a b")])).collect() == []
    same_rows(decontamination.decontaminate(docs, none).collect(), edge_rows())


# Repeated bytes ----------------------------------------------------------------------------------


def _brute_repeats(rows, size):
    counts = collections.Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        counts.update(t[i : i + size] for i in range(len(t) - size + 1))
    found = []
    for (doc_id, _), t in zip(rows, texts):
        covered = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = len(re.findall(b"\1+", bytes(covered)))
        found.append((doc_id, len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return found


def _repeat_rows():
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefgh ") for _ in range(3_000))
    return [
        (1, base), (2, base[:1500] + "XX" + base[1500:]), (3, "q" * 700), (4, "ab" * 300), (5, None), (6, ""),
        (7, "short"), (8, "zz" + base[100:600] + "yy" + base[100:499]), (9, "é" * 400 + base[2000:2450]),
        (10, "abcde" * 500 + "x"), (11, base[700:1100]), (12, base[700:1099]), (13, "u1" + base),
        (13, "u1" + base), (None, "nul" * 200), (14, "ab" * 199 + "a"), (15, "alone" + words(draw, 500)),
    ]


@pytest.mark.parametrize("size", [400, 64, 101])
def test_removed_bytes_equal_brute_force(spark, size):
    rows = _repeat_rows()
    docs = with_clashes(documents(spark, [(i, t, "a", "s", 0) for i, t in rows]))
    found = substring_dedup.repeats(docs, size).collect()
    same_rows([(r.doc_id, r.n_bytes, r.n_removed, len(r.runs), r.kept_sha256) for r in found], _brute_repeats(rows, size))


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = _repeat_rows()
    monkeypatch.setattr(substring_dedup, "TOGETHER", 300)
    docs = documents(spark, [(i, t, "a", "s", 0) for i, t in rows])
    found = substring_dedup.repeats(docs, 400).collect()
    same_rows([(r.doc_id, r.n_removed) for r in found], [(r[0], r[2]) for r in _brute_repeats(rows, 400)])


def test_repeats_are_cut_out(spark):
    rows = _repeat_rows()
    docs = with_clashes(documents(spark, [(i, t, "a", "s", 0) for i, t in rows]))
    cut = substring_dedup.remove_repeats(docs, 400)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[3] == "" and texts[7] == "short" and texts[5] is None
    assert texts[8] == "zzyy" + rows[7][1][-399:] and texts[12] == rows[11][1]
    assert substring_dedup.repeats(documents(spark, [])).collect() == []


# Near-duplicates ---------------------------------------------------------------------------------


def _brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        own = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    ids = sorted(sets)
    component = {i: i for i in ids}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((root(i), root(j)))
                component[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def _near_rows():
    """A large group of near copies in chains, groups of few, a passage that all share, singles."""
    draw = random.Random(9)
    passage = words(draw, 30)
    base = words(draw, 150).split()
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(draw.randint(0, 7)):
            own[draw.randrange(150)] = words(draw, 1)
        rows.append((1_000 - i, " ".join(own)))
    for i in range(60):
        own = words(draw, draw.randint(8, 60)).split()
        for k in range(draw.randint(1, 3)):
            rows.append((2_000 + 10 * i + k, " ".join(own[: len(own) - k]) + " " + passage))
    chain = words(draw, 400).split()
    rows += [(5_000 + i, " ".join(chain[6 * i : 6 * i + 100])) for i in range(40)]
    return rows


def test_components_equal_brute_force(spark):
    rows = _near_rows()
    expected = _brute_components(rows)
    docs = with_clashes(documents(spark, [(i, t, "a", "s", 0) for i, t in rows]))
    found = near_duplicates.near_duplicates(docs).collect()
    result = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found]
    same_rows(result, [(i, *expected[i], expected[i][1] == i) for i in expected])
    assert len({c for _, c in expected.values()}) < 150


def test_edge_rows(spark):
    docs = with_clashes(documents(spark))
    found = {}
    rows = near_duplicates.near_duplicates(docs).collect()
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == len(edge_rows())
    assert found[5] == [(0, 5, True)] and found[7] == [(0, 7, True)] and found[12] == [(1, 12, True)]
    assert {found[i][0][1] for i in (1, 2, 3, 4)} == {1}
    assert found[17] == [(1, 17, True)] * 2 and {c for _, c, _ in found[None]} == {None}
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(edge_rows()) - 3
    assert near_duplicates.near_duplicates(documents(spark, [])).collect() == []


def test_pairs_at_the_threshold_with_few_matches(spark):
    rows = []
    for i, seed in enumerate((3318, 8256, 54102)):
        drawn = [f"w{seed}x{k}" for k in range(12)]
        pair = " ".join(drawn[:11]), " ".join(drawn[1:])
        hashes = [near_duplicates.shingle_hashes(text) for text in pair]
        assert (near_duplicates.signature(hashes[0]) == near_duplicates.signature(hashes[1])).sum() == 23
        rows += [(2 * i, pair[0], "aa", "s", 0), (2 * i + 1, pair[1], "aa", "s", 0)]
    found = near_duplicates.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_stated_miss_rate():
    n, k = near_duplicates.COORDINATES, near_duplicates.MATCHES
    missed = sum(math.comb(n, i) * 0.75**i * 0.25 ** (n - i) for i in range(k))
    assert 118e6 < 1 / missed < 120e6


def test_bitmaps_never_rule_out_a_link():
    draw = random.Random(2)
    for _ in range(200):
        own = words(draw, draw.randint(1, 300)).split()
        other = list(own)
        for _ in range(draw.randint(0, 3 + len(own) // 10)):
            other[draw.randrange(len(own))] = "z"
        a, b = (near_duplicates.shingle_hashes(" ".join(w)) for w in (own, other))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        bits = (near_duplicates.bitmap(x).view("uint64").tolist() for x in (a, b))
        assert sum((x ^ y).bit_count() for x, y in zip(*bits)) <= apart


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a bigint, b bigint")
    found = {r.member: r.component for r in near_duplicates.components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


def _changed(text, place):
    parts = text.split()
    parts[place] = "changed"
    return " ".join(parts)


def test_every_set_of_a_repeated_id_is_searched(spark):
    """Documents 2 and 3 resemble different texts of document 1: all three belong together."""
    draw = random.Random(21)
    a, b, c, d = (words(draw, 120) for _ in range(4))
    rows = [(1, a), (1, b), (2, _changed(a, 60)), (3, _changed(b, 30)), (4, c), (5, d), (5, _changed(c, 10)), (6, d), (7, "one two")]
    found = near_duplicates.near_duplicates(documents(spark, [(i, t, "aa", "s", 0) for i, t in rows])).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}


def test_repeated_ids_equal_brute_force(spark):
    draw = random.Random(22)
    pool = [words(draw, draw.randint(3, 60)) for _ in range(12)]
    rows = []
    for i in range(90):
        text = draw.choice(pool)
        if draw.random() < 0.5 and len(text.split()) > 20:
            text = _changed(text, draw.randrange(len(text.split())))
        rows.append((draw.choice([i, i % 7, 40 + i % 30]), draw.choice([text, text, None, ""])))
    sets = [frozenset(near_duplicates.shingle_hashes(t).tolist()) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, _), x in zip(rows, sets):
        for (j, _), y in zip(rows, sets):
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    expected = sorted((i, len(x), find(i) if x else i) for (i, _), x in zip(rows, sets))
    table = documents(spark, [(i, t, "aa", "s", 0) for i, t in rows])
    found = near_duplicates.near_duplicates(table).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_unique_texts_stay_when_their_id_is_repeated(spark):
    draw = random.Random(23)
    a, unique = words(draw, 100), words(draw, 100)
    rows = [(1, a), (7, a), (7, unique), (7, None), (8, _changed(a, 50)), (8, _changed(a, 50)), (9, unique.upper()), (9, a)]
    kept = near_duplicates.drop_near_duplicates(documents(spark, [(i, t, "aa", "s", 0) for i, t in rows]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (7, unique), (7, None)], key=str)


def test_one_id_holds_a_third_of_all_rows(spark):
    draw = random.Random(24)
    texts = [words(draw, 40) for _ in range(150)]
    rows = [(0 if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(200 + i, texts[3 * i]) for i in range(20)]
    found = near_duplicates.near_duplicates(documents(spark, [(i, t, "aa", "s", 0) for i, t in rows])).collect()
    assert {r.component_id for r in found if r.doc_id == 0 or r.doc_id >= 200} == {0}
    assert all(r.kept for r in found if 0 < r.doc_id < 200)
