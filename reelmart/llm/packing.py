"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Every task packs the pieces of its own documents, so nothing is shuffled: bounded-space online best fit
with ``OPEN`` open bins. A bitset holds the free spaces that open bins have; its lowest bit from the
piece's length on is the fullest bin the piece fits into. Where none does, a new bin is opened, and if
there are too many, the fullest one closes. Pieces arrive longest first within a window of ``WINDOW``
pieces, so that short ones fill what long ones leave.

What is still open at the end of a task, ``OPEN`` bins at most, is packed again: the bins of many tasks
are pieces of the same packing, in groups of ``GROUP`` bins per task, until one group is left or
packing joins hardly any. Bins keep their inner order, so a piece's place is the sum of both offsets.

Documents longer than the capacity are cut, others never. The public library tokenises what stands between
white spaces, which no token holds, and a worker remembers ids up to a fixed number of words. A task keeps
lengths and checksums, the ids only if the caller asks for them, and then in windows bounded by their
number. The vocabulary must be one of lower-case words without white space, as the default one is.

Defined results: a NULL or empty text is the end id alone; rows that repeat a doc_id, and those with a
NULL one, are packed each for itself; special strings in a text are what the library makes of them by
default; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.llm.batches import slices
from reelmart.llm.token_counts import byte_letters, vocabulary_file
from reelmart.scratch import measured, written
from reelmart.shipping import ship_package

CAPACITY = 4_096
END_ID = 1
OPEN = 4_096
WINDOW = 65_536
# Ids held in a window when they are part of the result.
WINDOW_IDS = 16_000_000
GROUP = 65_536

# Characters that are tokenised together; longer texts are cut at the next of these white spaces.
_CHARACTERS = 500_000
_BREAK = re.compile(r"[ \t\n\r]")

# Words and chunks that a worker remembers, and the length from which on one is forgotten at once.
_REMEMBERED = 400_000
_LONG = 100

# Characters that no normalisation but lower case changes, and what begins a special string.
_ODD = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]|<\|")
# Fixed value: the words of the vocabulary's pre-tokenizer, for lower-case text of such characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")
_LETTERS = byte_letters()

# Bins of one task are numbered below this.
_BINS_PER_TASK = 1 << 40


class OpenBins:
    """Open bins by free space; items are whatever the caller packs."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.spaces = 0  # bit f is set where a bin with f free places is open
        self.by_space: dict[int, list[list]] = {}
        self.number = 0

    def _taken(self, space: int) -> list:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            del self.by_space[space]
            self.spaces &= ~(1 << space)
        self.number -= 1
        return found

    def place(self, size: int, item: Any) -> Iterator[list]:
        """Puts one item into a bin; yields the bins that this closes."""
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            chosen = self._taken(space)
        else:
            if self.number >= self.most:
                yield self._taken((self.spaces & -self.spaces).bit_length() - 1)
            space, chosen = self.capacity, []
        chosen.append(item)
        space -= size
        if not space:
            yield chosen
            return
        self.by_space.setdefault(space, []).append(chosen)
        self.spaces |= 1 << space
        self.number += 1

    def rest(self) -> Iterator[tuple[int, list]]:
        """``(used, items)`` of the bins that are still open, fullest first."""
        for space in sorted(self.by_space):
            for items in self.by_space[space]:
                yield self.capacity - space, items


def stretches(text: str) -> Iterator[str]:
    """A text in parts that can be tokenised apart: each but the first begins with white space."""
    start = 0
    while len(text) - start > _CHARACTERS:
        found = _BREAK.search(text, start + _CHARACTERS)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def chunks(text: str) -> list[str]:
    """What stands between the white spaces of a text, empty strings among it."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def is_plain(text: str) -> bool:
    return not _ODD.search(text)


class _WordIds(dict):
    """Ids of single words by the library's model, as little-endian unsigned 32-bit numbers."""

    def __init__(self, library):
        super().__init__()
        self.model = library.model

    def __missing__(self, word: str) -> bytes:
        letters = "".join(map(_LETTERS.__getitem__, word.encode()))
        ids = np.array([token.id for token in self.model.tokenize(letters)], "<u4").tobytes()
        if len(word) <= _LONG:
            self[word] = ids
        return ids


class _ChunkIds(dict):
    """The same of whole chunks by the whole library."""

    def __init__(self, library):
        super().__init__({"": b""})
        self.library = library

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= _LONG:
            self[chunk] = ids
        return ids


class TextIds:
    """Ids of texts, with the words and chunks that a worker remembers, up to a fixed number each.

    White space ends every token and is dropped, and neither normalisation nor special strings reach over
    it, so the ids of a text are those of its chunks in order. Chunks of plain letters, which no
    normalisation but lower case changes, are cut into words here, and the library's model has the ids of
    each word; all others go through the library as they are.
    """

    def __init__(self, vocabulary: str):
        # Tasks are parallel already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary_file(vocabulary))
        self.words, self.chunks = _WordIds(library), _ChunkIds(library)

    def _of_plain(self, part: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(part.lower())))

    def _of_chunk(self, chunk: str) -> bytes:
        return self._of_plain(chunk) if is_plain(chunk) else self.chunks[chunk]

    def of_text(self, text: str) -> bytes:
        done = []
        for part in stretches(text):
            for known in (self.words, self.chunks):
                if len(known) > _REMEMBERED:
                    known.clear()
            done += [self._of_plain(part)] if is_plain(part) else map(self._of_chunk, chunks(part))
        return b"".join(done)


@lru_cache(maxsize=2)
def _ids(vocabulary: str) -> TextIds:
    """One memory per worker process and vocabulary."""
    return TextIds(vocabulary)


def _pieces(
    batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int, end_id: int, with_ids: bool
) -> Iterator[tuple[int, tuple]]:
    """``(length, (doc_id, piece, start, crc, ids))`` of the documents in order."""
    known = _ids(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = known.of_text(text.as_py() or "") + end
            for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[start : start + 4 * capacity]
                held = np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None
                yield len(part) // 4, (doc_id, piece, start // 4, zlib.crc32(part), held)


def _windows(pieces: Iterable[tuple[int, Any]], most_ids: float) -> Iterator[list[tuple[int, Any]]]:
    """Windows of pieces, longest first; ties stay in their order."""
    window: list[tuple[int, Any]] = []
    ids = 0
    for piece in pieces:
        window.append(piece)
        ids += piece[0]
        if len(window) >= WINDOW or ids >= most_ids:
            yield sorted(window, key=lambda p: -p[0])
            window, ids = [], 0
    yield sorted(window, key=lambda p: -p[0])


def _rows_of(bin_id: int, used: int | None, sizes_and_items: list[tuple[int, tuple]]) -> Iterator[tuple]:
    offset = 0
    for size, item in sizes_and_items:
        yield (*item, size, bin_id, offset, used)
        offset += size


def _packed(windows: Iterable[list[tuple[int, Any]]], capacity: int, most_open: int) -> Iterator[tuple]:
    """Rows of the bins of one task; ``used`` (last) is set for bins that are open at its end."""
    task = TaskContext.get()
    bin_id = (task.partitionId() if task else 0) * _BINS_PER_TASK
    bins = OpenBins(capacity, most_open)
    for window in windows:
        for size, item in window:
            for closed in bins.place(size, (size, item)):
                yield from _rows_of(bin_id, None, closed)
                bin_id += 1
    for used, items in bins.rest():
        yield from _rows_of(bin_id, used, items)
        bin_id += 1


def _as_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 8_192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _repacked(bins: DataFrame, groups: int, capacity: int) -> DataFrame:
    """``(bin, into, shift, used)``: bins packed into bins, in ``groups`` tasks."""
    schema = pa.schema([("bin", pa.int64()), ("length", pa.int64()), ("into", pa.int64()), ("shift", pa.int64()), ("used", pa.int64())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pair for b in batches for pair in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
        # By length and then number, whatever the order in which they arrived.
        found.sort(key=lambda pair: (-pair[0], pair[1]))
        yield from _as_batches(_packed([[(used, (bin_id,)) for used, bin_id in found]], capacity, GROUP), schema)

    grouped = bins.select("bin", "used").repartition(groups, "bin")
    return grouped.mapInArrow(pack, "bin bigint, length bigint, into bigint, shift bigint, used bigint").drop("length")


def _merged(open_bins: DataFrame, number: int, capacity: int) -> DataFrame:
    """``(bin, into, shift)`` of the bins left open by all tasks, packed until it helps no more."""
    found, turn = None, 0
    while True:
        groups = math.ceil(number / GROUP)
        turn += 1
        # Numbers apart from those of other turns, and below zero apart from those of the tasks.
        packed = written(_repacked(open_bins, groups, capacity).withColumn("into", -F.col("into") * 64 - turn))
        if found is None:
            found = packed.select("bin", "into", "shift")
        else:
            later = packed.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            found = written(
                found.join(later, "into", "left").select(
                    "bin",
                    F.coalesce("next", "into").alias("into"),
                    (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                )
            )
        if groups == 1:
            return found
        # Bins at least half full hardly join with each other.
        open_bins, again = measured(
            packed.where(F.col("used") * 2 < capacity).select(F.col("into").alias("bin"), "used").distinct(),
            number=F.count("*"),
        )
        if again["number"] <= 1 or again["number"] * 2 > number:
            return found
        number = again["number"]


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    most_open: int = OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and the ids if asked for."""
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = "piece bigint, start bigint, ids_crc32 bigint, ids array<int>, length bigint, bin bigint, offset bigint, used bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("doc_id", first.schema.field(0).type)]
            + [(n, pa.int64()) for n in ("piece", "start", "ids_crc32")]
            + [("ids", pa.list_(pa.int32()))]
            + [(n, pa.int64()) for n in ("length", "bin", "offset", "used")]
        )
        pieces = _pieces(_chained(first, batches), vocabulary, capacity, end_id, with_ids)
        windows = _windows(pieces, WINDOW_IDS if with_ids else math.inf)
        yield from _as_batches(_packed(windows, capacity, most_open), schema, 512 if with_ids else 8_192)

    packed = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {names}"))
    columns = ["doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32"]
    ids = ["ids"] if with_ids else []
    closed = packed.where("used IS NULL").select(*columns, F.col("bin").alias("sequence_id"), "offset", *ids)
    still_open = packed.where("used IS NOT NULL")
    bins, found = measured(still_open.select("bin", "used").distinct(), number=F.count("*"))
    if not found["number"]:
        return closed
    merged = _merged(bins, found["number"], capacity)
    moved = still_open.join(merged, "bin").select(
        *columns, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"), *ids
    )
    return closed.unionAll(moved)


def _chained(first: pa.RecordBatch, others: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from others
