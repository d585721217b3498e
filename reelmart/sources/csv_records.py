"""Records of CSV files whose quoted fields may hold line breaks, with the place where each begins.

A quote opens a field only where it is the field's first character; elsewhere it is text, as Spark's
own reader has it. So whether a line starts a record depends on whether the line before it ended
within a quoted field. Every file split is read in order, twice: the first pass finds what the split
makes of either state, and how many lines and bytes it has, one row per split; the second one, with
the state and the place known, yields the records. Only the pieces of records that cross the border
of a split are shuffled.

Lines end as the file's first one does: in a line feed, in a carriage return with one, or in a lone
carriage return. Files of a codec that can be cut (bzip2) are read by many tasks as plain ones are; of
other compressed files each is one split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmart.scratch import written
from reelmart.shipping import ship_package

# States of splits are sent to every executor, up to this many bytes; files with more are read in turns.
_BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_BYTES = 96

# Suffixes by which Hadoop's codecs know compressed files that cannot be cut.
_WHOLE_ONLY = (".gz", ".deflate", ".lz4", ".snappy", ".zst", ".xz")

# Bytes of a file that are looked at for its first line break, as Spark's reader does, in steps of a
# size that holds a header, and the files that are looked at together.
_LOOK_AHEAD = 1024 * 1024
_LOOK_STEP = 4096
_LOOKS = 32

_BATCH_BYTES = 4 * 1024 * 1024


class LargeFiles(NamedTuple):
    """Files to be cut into records, by the line break that each of them uses, and all others."""

    line_feed: list[str]
    return_and_feed: list[str]
    lone_return: list[str]
    others: list[str]

    def by_break(self) -> Iterator[tuple[str, list[str]]]:
        """The line breaks in use, each with its files."""
        kinds = (("\n", self.line_feed), ("\r\n", self.return_and_feed), ("\r", self.lone_return))
        return ((ending, files) for ending, files in kinds if files)


def by_line_break(
    spark: SparkSession, path: str | list[str], file_bytes_per_task: int, whole_only: bool = False
) -> LargeFiles:
    """The files below ``path``: large ones by their line break, all others to be read whole.

    Compressed files that cannot be cut are among the others, unless ``whole_only`` asks for them. A
    file without a line break in the part looked at counts as one of line feeds.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "length")
    files = sorted(map(tuple, listing.collect()))  # one short row per file, as Spark's own listing
    large = [
        name
        for name, length in files
        if length > file_bytes_per_task and (whole_only or not name.endswith(_WHOLE_ONLY))
    ]
    with ThreadPoolExecutor(_LOOKS) as threads:
        endings = dict(zip(large, threads.map(lambda name: _first_break(spark, name), large)))
    found = LargeFiles([], [], [], [])
    kinds = {"\r\n": found.return_and_feed, "\r": found.lone_return}
    for name, _ in files:
        if name in endings:
            kinds.get(endings[name], found.line_feed).append(name)
        else:
            found.others.append(name)
    return found


def _first_break(spark: SparkSession, file: str) -> str:
    """The first line break of a file; empty if there is none in the bytes looked at."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    try:
        text = codec.createInputStream(stream) if codec else stream
        start = b""
        while len(start) < _LOOK_AHEAD:
            step = jvm.org.apache.commons.io.input.BoundedInputStream(text, _LOOK_STEP)
            more = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(step))
            start += more
            feed, turn = start.find(b"\n"), start.find(b"\r")
            # What follows a carriage return must be seen as well.
            if not more or feed >= 0 or 0 <= turn < len(start) - 1:
                break
    finally:
        stream.close()
    if turn < 0 or 0 <= feed < turn:
        return "\n" if feed >= 0 else ""
    return "\r\n" if feed == turn + 1 else "\r"


def _after_quoted(line: bytes, at: int) -> int:
    """The place after the quote that closes the field open at ``at``; -1 if none does."""
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return -1
        if line[at + 1 : at + 2] != b'"':
            return at + 1
        at += 2


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, given whether one was before it."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        at = _after_quoted(line, 0)
        if at < 0:
            return True
    elif line[:1] == b'"':
        at = _after_quoted(line, 1)
        if at < 0:
            return True
    while True:
        # The next field that begins with a quote.
        at = line.find(b',"', at)
        if at < 0:
            return False
        at = _after_quoted(line, at + 2)
        if at < 0:
            return True


class _Line(NamedTuple):
    """A line with its split, what the first pass found of the split, and its own bytes."""

    file: str
    split: int
    state: int | None
    bytes_before: int | None
    lines_before: int | None
    value: bytes


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[_Line]:
    """The lines in file order."""
    for batch in batches:
        yield from map(_Line, *(batch.column(name).to_pylist() for name in _Line._fields))


def _outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split the state at its end, begun outside and begun inside a quoted field, lines and bytes."""
    rows: dict[tuple[str, int], list[int]] = {}
    for line in _lines(batches):
        row = rows.setdefault((line.file, line.split), [0, 1, 0, 0])
        row[0], row[1] = ends_inside(line.value, bool(row[0])), ends_inside(line.value, bool(row[1]))
        row[2] += 1
        row[3] += len(line.value) + 1
    if rows:
        columns = zip(*((*split, *map(int, row)) for split, row in rows.items()))
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["file", "split", "from_outside", "from_inside", "lines", "bytes"],
        )


# What a row of the second pass is: a whole record, the beginning of one that goes on in the next
# split, its further pieces, and the piece that ends it.
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)

_PIECES = {
    "file": (pa.string(), "string"),
    "split": (pa.int64(), "bigint"),
    "kind": (pa.int32(), "int"),
    "is_header": (pa.bool_(), "boolean"),
    "offset": (pa.int64(), "bigint"),
    "line": (pa.int64(), "bigint"),
    "value": (pa.binary(), "binary"),
}


def _pieces(batches: Iterable[pa.RecordBatch], cut_returns: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    current: tuple[str, int] | None = None
    parts: list[bytes] = []
    within = begun_here = seek_header = False
    # Place of the next line, and of the first one in ``parts``.
    offset = number = begun_at = begun_in = 0

    def as_batch() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, (kind, _) in zip(zip(*rows), _PIECES.values())], names=list(_PIECES)
        )
        rows.clear()
        held = 0
        return batch

    def add(kind: int) -> None:
        nonlocal held, seek_header
        value = b"\n".join(parts)
        parts.clear()
        # Records without a character are no records; a header is the first one that is.
        if kind == _WHOLE and not value:
            return
        rows.append((*current, kind, seek_header, begun_at, begun_in, value))
        held += len(value)
        seek_header = False

    for line in _lines(batches):
        if (line.file, line.split) != current:
            if parts:
                add(_HEAD if begun_here else _MIDDLE)
            current, within = (line.file, line.split), bool(line.state)
            offset, number = line.bytes_before, line.lines_before + 1
            begun_here, seek_header = not within, line.split == 0
        if not parts:
            begun_at, begun_in = offset, number
        value = line.value
        offset += len(value) + 1
        number += 1
        if cut_returns and value.endswith(b"\r"):
            value = value[:-1]
        parts.append(value)
        within = ends_inside(value, within)
        if not within:
            add(_WHOLE if begun_here else _TAIL)
            begun_here = True
        if held >= _BATCH_BYTES:
            yield as_batch()
    if parts:
        add(_HEAD if begun_here else _MIDDLE)
    if rows:
        yield as_batch()


def _text(spark: SparkSession, files: list[str], ending: str) -> DataFrame:
    return spark.read.option("lineSep", ending[-1]).text(files).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )


def _split_states(text: DataFrame) -> DataFrame:
    """Per split: whether it begins inside a quoted field, and the bytes and lines before it."""
    unknown = {"state": "int", "bytes_before": "bigint", "lines_before": "bigint"}
    outcomes = written(
        text.withColumns({name: F.lit(None).cast(kind) for name, kind in unknown.items()})
        .select(*_Line._fields)
        .mapInArrow(
            _outcomes, "file string, split bigint, from_outside int, from_inside int, lines bigint, bytes bigint"
        )
    )
    so_far = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # A split sets the state, keeps it or turns it round: what was set last, turned as often since.
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turned = F.sum(F.when(F.col("from_outside") > F.col("from_inside"), 1).otherwise(0)).over(so_far)
    ended = (
        outcomes.withColumn("fixed", fixed)
        .withColumn("turned", turned)
        .withColumn("set", F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")), True).over(so_far))
        .withColumn(
            "ends",
            F.pmod(
                F.coalesce(F.col("set.fixed"), F.lit(0))
                + F.col("turned")
                - F.coalesce(F.col("set.turned"), F.lit(0)),
                F.lit(2),
            ).cast("int"),
        )
    )
    in_file = Window.partitionBy("file").orderBy("split")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    return written(
        ended.select(
            "file",
            "split",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
            F.coalesce(F.lag("ends").over(in_file), F.lit(0)).alias("state"),
            F.when(F.lead("split").over(in_file).isNull(), F.col("ends")).alias("ends_file"),
        )
    )


def quoted_records(spark: SparkSession, files: list[str], ending: str) -> DataFrame:
    """One row per record of ``files``: file, offset, line and value; header and empty records left out.

    ``ending`` is the line break of the files. ``offset`` is the place of the record's first byte in
    the (decompressed) file, a byte order mark not counted, and ``line`` the number of its first line, from
    1; line breaks within the value are line feeds. A quoted field that is still open at the end of a
    file raises, with the file and the place where its record begins at the earliest.
    """
    ship_package(spark)
    text = _text(spark, files, ending)
    states = _split_states(text)
    measured = states.agg(
        F.sum(F.octet_length("file") + _ROW_BYTES).alias("bytes"),
        F.max(F.when(F.col("ends_file") == 1, F.struct("file", "split"))).alias("open"),
    ).first()
    if measured["open"]:
        last = F.max(F.when(F.col("state") == 0, F.col("bytes_before")))
        begins = states.where(F.col("file") == measured["open"]["file"]).agg(last).first()[0]
        raise ValueError(
            f"{measured['open']['file']}: a quoted field that begins at byte {begins} or later is never closed"
        )
    if (measured["bytes"] or 0) > _BROADCAST_BYTES and len(files) > 1:
        half = len(files) // 2
        return quoted_records(spark, files[:half], ending).unionAll(quoted_records(spark, files[half:], ending))

    lines = text.join(F.broadcast(states.drop("ends_file")), ["file", "split"]).select(*_Line._fields)
    cut_returns = ending == "\r\n"
    schema = ", ".join(f"{name} {kind}" for name, (_, kind) in _PIECES.items())
    pieces = lines.mapInArrow(lambda batches: _pieces(batches, cut_returns), schema)
    pieces = pieces.withColumn("value", F.col("value").cast("string"))
    record = ["file", "offset", "line", "value"]
    whole = pieces.where((F.col("kind") == _WHOLE) & ~F.col("is_header")).select(*record)

    # A record that crosses borders: its head, and the pieces up to the next tail.
    crossing = pieces.where(F.col("kind") != _WHOLE)
    in_file = Window.partitionBy("file").orderBy("split", F.desc("kind"))
    begun = crossing.withColumn(
        "record",
        F.sum((F.col("kind") == _HEAD).cast("int")).over(
            in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    joined = (
        begun.groupBy("file", "record")
        .agg(
            F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"),
            F.max("is_header").alias("is_header"),
            F.min("offset").alias("offset"),
            F.min("line").alias("line"),
        )
        .where(~F.col("is_header"))
        .select("file", "offset", "line", F.array_join(F.col("parts.value"), "\n").alias("value"))
    )
    return whole.unionAll(joined)


def all_records(spark: SparkSession, found: LargeFiles) -> DataFrame:
    """``quoted_records`` of all large files, whatever their line breaks."""
    return reduce(
        DataFrame.unionAll, (quoted_records(spark, files, ending) for ending, files in found.by_break())
    )
