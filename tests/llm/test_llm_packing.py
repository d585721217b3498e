"""Packing against the tokenizer library, and its bins against the best possible."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from llm_frames import documents, edge_rows, with_clashes, words
from tokenizers import Tokenizer

from reelmart.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def _check(found, rows, capacity):
    """All rules but the number of sequences, which is returned."""
    expected = []
    for doc_id, text, *_ in rows:
        ids = _ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == order(expected)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_edges(spark):
    rows = edge_rows() + [(30, "a <|startoftext|> b<|endoftext|>", "aa", "s", 0), (31, "naïve ́x  É   Σς", "aa", "s", 0)]
    docs = documents(spark, rows)
    for table in (docs, with_clashes(docs)):
        found = packing.pack(table).collect()
        total = sum(len(_ids(r[1])) for r in rows)
        assert _check(found, rows, 4096) <= math.ceil(total / 4096) + 2
    assert packing.pack(documents(spark, [])).collect() == []


def test_few_sequences_from_many_tasks(spark):
    draw = random.Random(11)
    rows = [(i, words(draw, draw.choice([1, 5, 30, 60, 90])), "aa", "s", 0) for i in range(1_500)]
    table = documents(spark, rows).repartition(12)
    found = packing.pack(table, capacity=256).collect()
    # One task that sees all pieces, longest first, and keeps every bin open.
    whole = packing.OpenBins(256, 10**9)
    for size in sorted((r.length for r in found), reverse=True):
        assert all(sum(closed) == 256 for closed in whole.place(size, size))
    free = sum(256 - used for used, _ in whole.rest())
    best = (sum(r.length for r in found) + free) // 256
    assert _check(found, rows, 256) <= best * 1.05


def test_few_open_bins(spark):
    """With four open bins per task the rules hold as well."""
    draw = random.Random(12)
    rows = [(i, words(draw, draw.randint(0, 40)), "aa", "s", 0) for i in range(300)]
    found = packing.pack(documents(spark, rows), capacity=100, most_open=4).collect()
    _check(found, rows, 100)


def test_turns_of_merging(spark, monkeypatch):
    """Open bins of many tasks are packed in groups, and what they leave again."""
    draw = random.Random(13)
    sizes = [draw.randint(1, 40) for _ in range(400)]
    monkeypatch.setattr(packing, "GROUP", 50)
    bins = spark.createDataFrame(list(enumerate(sizes)), "bin bigint, used bigint")
    found = {r.bin: r for r in packing._merged(bins, 400, 100).collect()}
    assert set(found) == set(range(400))
    into = defaultdict(list)
    for i, size in enumerate(sizes):
        into[found[i].into].append((found[i].shift, size))
    for places in into.values():
        places.sort()
        assert all(b[0] >= a[0] + a[1] for a, b in zip(places, places[1:])) and sum(places[-1]) <= 100
    assert len(into) <= math.ceil(sum(sizes) / 100) + 8


def test_ids_are_part_of_the_result_if_asked_for(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    found = packing.pack(documents(spark, rows), with_ids=True).collect()
    for r in found:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_long_texts_in_stretches(monkeypatch):
    draw = random.Random(14)
    text = " \n\t".join(words(draw, 7, "abcé ́'sΣ1!<|endoftext|>") for _ in range(400))
    monkeypatch.setattr(packing, "_CHARACTERS", 50)
    parts = list(packing.stretches(text))
    assert "".join(parts) == text and len(parts) > 100
    monkeypatch.setattr(packing, "_REMEMBERED", 40)
    known = packing.TextIds("word_bpe_49k.json")
    for t in (text, "", "one", text, "x" * 5_000 + " " + text):
        assert np.frombuffer(known.of_text(t), "<u4").tolist() == _ids(t)[:-1]
    assert len(known.words) + len(known.chunks) <= 200


def test_any_characters_as_the_library_has_them():
    """White space, marks, special strings and signs of all kinds, at all places."""
    draw = random.Random(15)
    signs = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u0301", "\u0345", "e", "E", "Σ", "ς"]
    signs += ["İ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "1", "٣", "中", "ﬁ", "\ufeff", "\u200d", "😀", "\u1100", "\u1161", "!"]
    known = packing.TextIds("word_bpe_49k.json")
    for _ in range(3_000):
        text = "".join(draw.choices(signs, k=draw.randint(0, 25)))
        assert np.frombuffer(known.of_text(text), "<u4").tolist() == _ids(text)[:-1], repr(text)
    plain = [c for c in map(chr, range(0x100)) if packing.is_plain(c)]
    assert len(plain) > 180
    for _ in range(3_000):
        text = "".join(draw.choices(plain, k=draw.randint(0, 40)))
        assert np.frombuffer(known.of_text(text), "<u4").tolist() == _ids(text)[:-1], repr(text)
    every = "".join(map(chr, range(0x20, 0x3000))) + " " + " ".join(map(chr, range(0x20, 0x3000)))
    assert np.frombuffer(known.of_text(every), "<u4").tolist() == _ids(every)[:-1]


def test_best_fit_and_fullest_closed_first():
    bins = packing.OpenBins(10, 2)
    assert list(bins.place(4, "a")) == [] and list(bins.place(7, "b")) == []
    assert list(bins.place(3, "c")) == [["b", "c"]]  # the fullest that has room
    assert list(bins.place(8, "d")) == []
    assert list(bins.place(9, "e")) == [["d"]]  # no room and two open: the fullest closes
    assert [(used, items) for used, items in bins.rest()] == [(9, ["e"]), (4, ["a"])]
