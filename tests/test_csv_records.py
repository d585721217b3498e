import random

import pytest

from reelmart import schemas
from reelmart.sources.csv_files import read_csv, read_movie_reviews, read_user_purchase
from reelmart.sources.csv_records import by_line_break, ends_inside


@pytest.fixture
def small_splits(spark):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, 64)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def _field(value):
    if value is None:
        return ""
    if value == "" or any(c in value for c in ',"\n\r'):
        return '"' + value.replace('"', '""') + '"'
    return value


def _write(path, rows, ending):
    lines = ["cid,review_str,id_review"]
    lines += [",".join(_field(None if v is None else str(v)) for v in row) for row in rows]
    path.write_bytes((ending.join(lines) + ending).encode())


def _reviews(seed, n):
    rng = random.Random(seed)
    pieces = ["good", "the", " ", ",", '"', "\n", "\n\n", "é", "\\", "x" * 30, "line\nbreak", '""', "1,2,3"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) or None for _ in range(n)]
    # one record that fills several splits on its own
    texts[n // 2] = "\n".join(f'row {i}, "quoted"' for i in range(60))
    return [(i, text, 10 * i) for i, text in enumerate(texts)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_files_give_the_same_rows(spark, tmp_path, small_splits, seed, ending):
    rows = _reviews(seed, 80)
    _write(tmp_path / "a.csv", rows[:50], ending)
    _write(tmp_path / "b.csv", rows[50:], ending)
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    whole = read_movie_reviews(spark, paths)
    split = read_movie_reviews(spark, paths, file_bytes_per_task=0)
    assert spark.read.text(paths).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, split.collect())) == rows
    assert sorted(map(tuple, whole.collect())) == rows


def test_bad_fields_and_bad_rows_are_treated_alike(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('user_id,positive_review,review_id\nx,1,2\n\n3,"0",4\n5,1,\n')
    schema = schemas.CLASSIFIED_MOVIE_REVIEWS
    for limit in (0, 10_000):
        rows = read_csv(spark, str(path), schema, file_bytes_per_task=limit).collect()
        assert sorted(rows, key=str) == sorted([(None, 1, 2), (3, 0, 4), (5, 1, None)], key=str)
        with pytest.raises(Exception, match="(?i)malformed|cannot|error"):
            read_csv(
                spark, str(path), schema, fail_on_bad_rows=True, file_bytes_per_task=limit
            ).collect()


def test_purchases_from_split_files(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        "invoice_number,stock_code,detail,quantity,invoice_date,unit_price,customer_id,country\n"
        'C1,S1,"a ""quoted"",\nlamp",6,2010-12-01 08:26:00,2.5505,17850,France\n'
        'C2,S2,"",-1,2010-12-01 08:26:00.123456,0.001,,\n'
    )
    split = read_user_purchase(spark, str(path), file_bytes_per_task=0)
    whole = read_user_purchase(spark, str(path))
    assert split.dtypes == whole.dtypes
    assert sorted(split.collect()) == sorted(whole.collect())
    assert split.count() == 2


HEADER = b"cid,review_str,id_review"
ODD_FILES = {
    "stray quote": HEADER + b'\n1,"a ""b"" c",10\n2,a 5" screen,11\n3,"x\ny",12\n4,b"c"d,13\n5,"z",14\n',
    "stray quote, then quoted text": HEADER + b'\n0,3" nail,0\n' + b'1,"ordinary, quoted",1\n' * 200,
    "lone returns": HEADER + b'\r1,a,2\r3,"b\rc",4\r',
    "header with a line break": b'cid,"review\nstr",id_review\n1,a,2\n3,b,4\n',
    "line of blanks": HEADER + b"\n1,a,2\n   \n\n3,b,4\n",
    "returns and feeds in a field": HEADER + b'\r\n1,"a\r\nb",2\r\n3,c,4\r\n',
    "feeds in a file of returns and feeds": HEADER + b'\r\n1,"a\nb",2\r\n3,c,4',
    "lone return in a line-feed file": HEADER + b'\n1,"a\rb",2\n3,c\rd,4\n',
    "text after the closing quote": HEADER + b'\n1,"a"b,2\n3,"c" d,4\n5,"e""f"g"h,6\n7,"i\nj"k,8\n',
    "empty lines before the header": b"\n\n" + HEADER + b"\n1,a,2\n",
    "no line break at the end": HEADER + b'\n1,"a\n",2',
    "a header alone": HEADER + b"\n",
    "nothing": b"",
}


@pytest.mark.parametrize("name", list(ODD_FILES))
@pytest.mark.parametrize("split_bytes", [16, 1 << 20])
def test_every_file_size_follows_the_same_rules(spark, tmp_path, name, split_bytes):
    (tmp_path / "f.csv").write_bytes(ODD_FILES[name])
    path = str(tmp_path / "f.csv")
    whole = read_movie_reviews(spark, path).collect()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, split_bytes)
    try:
        split = read_movie_reviews(spark, path, file_bytes_per_task=0).collect()
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert sorted(split, key=str) == sorted(whole, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_bytes_follow_the_same_rules(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    ending = rng.choice([b"\n", b"\r\n"])
    pieces = [b"a", b'"', b'""', b",", b'"q, r"', ending, b" ", b"1", b'x"y', ending + b'"']
    body = b"".join(rng.choices(pieces, k=400))
    # Closed at its end: whatever is open there is another test.
    state = False
    for line in (HEADER + ending + body).split(b"\n"):
        state = ends_inside(line, state)
    path = tmp_path / "f.csv"
    path.write_bytes(HEADER + ending + body + (b'"' if state else b"") + ending)
    whole = read_movie_reviews(spark, str(path)).collect()
    split = read_movie_reviews(spark, str(path), file_bytes_per_task=0).collect()
    assert sorted(split, key=str) == sorted(whole, key=str)


def test_a_quote_that_is_never_closed_is_named(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_bytes(HEADER + b"\n1,a,2\n" * 30 + b'3,"never closed,4\n' + b"5,b,6\n" * 30)
    with pytest.raises(ValueError, match="f.csv.*never closed"):
        read_movie_reviews(spark, str(path), file_bytes_per_task=0)


def test_only_pieces_at_borders_are_shuffled(spark, tmp_path, small_splits):
    _write(tmp_path / "a.csv", _reviews(1, 60), "\n")
    split = read_movie_reviews(spark, str(tmp_path / "a.csv"), file_bytes_per_task=0)
    plan = split._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("== Initial Plan ==")[-1].splitlines()
    # Below the exchange of text there is the filter that keeps pieces only.
    for i, line in enumerate(tree):
        if "Exchange hashpartitioning(file" in line:
            assert any("Filter" in x and "kind" in x for x in tree[i : i + 8])
    assert plan.count("FileScan text") >= 1


def test_files_are_told_apart(spark, tmp_path):
    texts = {"a.csv": b"x\ny\n", "b.csv": b"x\r\ny", "c.csv": b"x\ry", "d.csv.gz": b"no", "e.csv": b"one line"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    found = by_line_break(spark, str(tmp_path), 0)
    names = [[f.rsplit("/", 1)[1] for f in part] for part in found]
    assert names == [["a.csv", "e.csv"], ["b.csv"], ["c.csv"], ["d.csv.gz"]]
    assert len(by_line_break(spark, str(tmp_path), 1_000).others) == 5
