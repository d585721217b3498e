"""Inferred types against Spark's inference and a sequential fold; provenance against the bytes of the files."""

import bz2
import csv
import gzip
import random

import pytest
from pyspark.sql import functions as F

from reelmart import schemas
from reelmart.sources.csv_files import infer_csv, read_csv, read_csv_and_rejects, read_movie_reviews
from reelmart.sources.csv_records import all_records, by_line_break, ends_inside
from reelmart.sources.csv_types import joined_type, kind_of

VALUES = (
    "5 +5 -5 2147483647 2147483648 -2147483648 9223372036854775807 9223372036854775808 00012 -0 1.5 1e5 .5 +.5e-3 "
    "1d 5f 0x1F NaN nan Inf -Inf Infinity 1e400 true TRUE True t yes false 2020-01-01 2020-1-1 2020 2020-01 "
    "2020-01-01T10:00:00 2020-01-01T10:00:00Z 10:00:00 T10:00 2020/01/01 01-02-2020 20200101 2020-02-30 1,5 1_000 "
    "- --5 1L 2020-01-01T10:00:00+05:30 +2020-01-01 12020-01-01 2020-01-01x epoch now today " + "1" * 38 + " " + "1" * 39
).split() + [" 5", "5 ", "2020-01-01 10:00:00", "2020-01-01 25:00:00", "2020-01-01 ", " true", "a b", '"', "two\nlines"]


@pytest.fixture
def small_splits(spark):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, 64)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def _write(path, header, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_MINIMAL, lineterminator=newline)
        out.writerow(header)
        out.writerows(rows)


def test_single_values_as_spark_infers_them(spark, tmp_path):
    _write(tmp_path / "a.csv", [f"c{i}" for i in range(len(VALUES))], [VALUES])
    own = infer_csv(spark, str(tmp_path / "a.csv"))
    theirs = spark.read.options(header=True, inferSchema=True, escape='"', multiLine=True).csv(str(tmp_path / "a.csv"))
    assert dict(zip(VALUES, (f.dataType.simpleString() for f in own.schema))) == dict(
        zip(VALUES, (t for _, t in theirs.dtypes))
    )
    assert own.widenings == []


# Groups of values whose types Spark finds to be the same in any order.
GROUPS = [
    ["1", "22", "-7"], ["1", "3000000000"], ["1", "1.5", "3000000000"], ["1", "x"], ["true", "false"], ["true", "1"],
    ["2020-01-01", "2021-12-31"], ["2020-01-01T10:00:00", "10:30"], ["1.5", "2020-01-01"], ["1", "99999999999999999999999"],
    ["99999999999999999999999", "0.5"], ["true", "1.5", "x"], ["2020-01-01", "x"],
]


@pytest.mark.parametrize("seed", range(3))
def test_columns_as_spark_infers_them(spark, tmp_path, seed):
    draw = random.Random(seed)
    columns = [[draw.choice([*group, ""]) for _ in range(40)] for group in GROUPS]
    for column, group in zip(columns, GROUPS):
        column[: len(group)] = draw.sample(group, len(group))
    names = [f"c{i}" for i in range(len(GROUPS))]
    _write(tmp_path / "a.csv", names, list(zip(*columns)))
    theirs = spark.read.options(header=True, inferSchema=True, escape='"').csv(str(tmp_path / "a.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in infer_csv(spark, str(tmp_path)).schema] == theirs.dtypes


@pytest.mark.parametrize("seed", range(2))
def test_first_widening_rows_equal_a_fold_in_order(spark, tmp_path, small_splits, seed):
    draw = random.Random(seed)
    names = ["a", "b", "c", "d"]
    pools = [["1", "2", "", "3000000000"], ["1", "1.5", ""], ["2020-01-01", "2020-01-01T10:00:00", "x\ny, z"], ["", "true", "no"]]
    weights = [[20, 20, 5, 1], [30, 1, 5], [30, 1, 1], [20, 20, 1]]
    files = {}
    for name in ("f1.csv", "f2.csv"):
        rows = [[draw.choices(p, w)[0] for p, w in zip(pools, weights)] for _ in range(120)]
        _write(tmp_path / name, names, rows)
        files[name] = rows
    kinds = {v: k for v, k in spark.createDataFrame([(v,) for p in pools for v in p], "v string")
             .select("v", kind_of(F.col("v")).alias("k")).collect()}
    expected = []
    for place, name in enumerate(names):
        seen, before = set(), None
        for file, rows in files.items():
            line = 2
            for row in rows:
                kind = kinds[row[place]]
                if kind:
                    seen.add(kind)
                    after = joined_type(seen).simpleString()
                    if before not in (None, after):
                        expected.append((name, before, after, file, line))
                    before = after
                line += 1 + sum(v.count("\n") for v in row)
    found = infer_csv(spark, str(tmp_path))
    assert [(w.column, w.before, w.after, w.file.rsplit("/", 1)[1], w.line) for w in found.widenings] == expected
    for w in found.widenings:
        content = (tmp_path / w.file.rsplit("/", 1)[1]).read_bytes()
        assert content[: w.offset].count(b"\n") == w.line - 1


def test_a_schema_is_inferred_where_none_is_given(spark, tmp_path):
    _write(tmp_path / "a.csv", ["n", "t", "s", "nothing"], [["1", "2020-01-01", "x", ""], ["", "2020-01-02", "a\nb", ""]])
    for limit in (-1, 10_000):
        rows = read_csv(spark, str(tmp_path), file_bytes_per_task=limit)
        assert rows.dtypes == [("n", "int"), ("t", "date"), ("s", "string"), ("nothing", "string")]
        assert sorted((r.n, str(r.t), r.s) for r in rows.collect() if r.n) == [(1, "2020-01-01", "x")]


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    found = infer_csv(spark, str(tmp_path / "a.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("x", "string"), ("y", "string")]
    good, rejects = read_csv_and_rejects(spark, str(tmp_path / "a.csv"), schemas.CLASSIFIED_MOVIE_REVIEWS)
    assert good.collect() == rejects.collect() == []


HEADER = b"cid,review_str,id_review"


def _records_of(content, ending):
    """``(offset, line, text)`` of the records, byte by byte line; the header left out."""
    found, within, at, number = [], False, 0, 1
    begun, parts = (0, 1), []
    pieces = content.split(ending[-1:])
    if pieces[-1] == b"":
        pieces.pop()
    for piece in pieces:
        if not parts:
            begun = (at, number)
        at, number = at + len(piece) + 1, number + 1
        text = piece[:-1] if ending == b"\r\n" and piece.endswith(b"\r") else piece
        parts.append(text)
        within = ends_inside(text, within)
        if not within:
            record = b"\n".join(parts)
            if record:
                found.append((*begun, record.decode()))
            parts = []
    return found[1:]


def _content(seed, ending, n=150):
    draw = random.Random(seed)
    out = [HEADER]
    for i in range(n):
        text = "".join(draw.choices(["a", "é", '""', ",", "\n", "word ", ending.decode()], k=draw.randint(0, 12)))
        out.append(f'{i},"{text}",{i}'.encode() if draw.random() < 0.7 else f"{i},plain,{i}".encode())
        if draw.random() < 0.1:
            out.append(b"")
    return ending.join(out) + (ending if seed % 2 else b"")


@pytest.mark.parametrize("ending", [b"\n", b"\r\n", b"\r"])
@pytest.mark.parametrize("packed", ["", ".gz", ".bz2"])
def test_places_equal_the_bytes(spark, tmp_path, small_splits, ending, packed):
    pack = {"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress}[packed]
    contents = {f"f{seed}.csv{packed}": _content(seed, ending) for seed in (1, 2)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(pack(content))
    found = all_records(spark, by_line_break(spark, str(tmp_path), -1, whole_only=True)).collect()
    for name, content in contents.items():
        got = sorted((r.offset, r.line, r.value) for r in found if r.file.endswith(name))
        assert got == _records_of(content, ending)
        if ending != b"\r\n":
            assert all(content[offset:].startswith(v.split("\n")[0].encode()) for offset, _, v in got)


@pytest.mark.parametrize("ending", [b"\n", b"\r"])
def test_one_large_bzip2_file_uses_several_tasks(spark, tmp_path, ending):
    draw = random.Random(1)
    rows = [(i, f"text {draw.random()}, of\nline {draw.random()}" * 3, i) for i in range(9_000)]
    body = ending.join([HEADER, *(f'{a},"{b}",{c}'.encode() for a, b, c in rows)]) + ending
    (tmp_path / "f.csv.bz2").write_bytes(bz2.compress(body, 1))
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, 60_000)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        split = read_movie_reviews(spark, str(tmp_path), file_bytes_per_task=0)
        assert sorted(map(tuple, split.collect())) == rows
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)


def test_many_files_are_read_in_turns(spark, tmp_path, small_splits, monkeypatch):
    """Where the states of all splits would be too much to send, files are read in turns."""
    monkeypatch.setattr("reelmart.sources.csv_records._BROADCAST_BYTES", 3_000)
    contents = {f"f{seed}.csv": _content(seed, b"\n", 40) for seed in range(5)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = all_records(spark, by_line_break(spark, str(tmp_path), 0)).collect()
    for name, content in contents.items():
        assert sorted((r.offset, r.line, r.value) for r in found if r.file.endswith(name)) == _records_of(content, b"\n")


def test_rejects_with_their_places(spark, tmp_path, small_splits):
    draw = random.Random(2)
    lines, expected, good = [b"user_id,positive_review,review_id"], [], []
    forms = [("{i},1,{i}", None), ('x{i},"1",{i}', "fields"), ("{i},1", "fields"), ('{i},"1\n2",{i}', "fields"), ("{i},1,2,3", "fields"),
             ('"{i}",0,', None)]
    for i in range(200):
        form, reason = draw.choices(forms, [10, 1, 1, 1, 1, 5])[0]
        text = form.format(i=i)
        if reason:
            offset = sum(len(x) + 1 for x in lines)
            expected.append((offset, 1 + sum(x.count(b"\n") + 1 for x in lines), text, reason))
        else:
            good.append((i, 1, i) if form == forms[0][0] else (i, 0, None))
        lines.append(text.encode())
    (tmp_path / "f.csv").write_bytes(b"\n".join(lines) + b"\n")
    rows, rejects = read_csv_and_rejects(spark, str(tmp_path), schemas.CLASSIFIED_MOVIE_REVIEWS)
    assert sorted(map(tuple, rows.collect())) == good
    assert sorted((r.offset, r.line, r.value, r.reason) for r in rejects.collect()) == expected
    assert rows.dtypes == [("user_id", "bigint"), ("positive_review", "int"), ("review_id", "bigint")]


def test_texts_beyond_their_limit_are_rejected(spark, tmp_path):
    _write(tmp_path / "f.csv", ["user_id", "file"], [["1", "short"], ["2", "long enough"], ["3", "short     "]])
    schema = schemas.table_of(("user_id", schemas.LongType()), ("file", schemas.StringType()))
    rows, rejects = read_csv_and_rejects(spark, str(tmp_path), schema, {"file": 5})
    assert sorted(map(tuple, rows.collect())) == [(1, "short"), (3, "short     ")]
    assert [(r.line, r.value, r.reason) for r in rejects.collect()] == [(3, "2,long enough", "length of file")]
