"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes when a string of ``min_bytes`` bytes that covers it also begins anywhere else. Two places
begin with equal strings when their suffixes stay in one bucket down to that depth. The steps:

1. **Buckets.** The suffixes of a text begin in the buckets of their 8 bytes. A bucket of depth 2h is
   made from the bucket of the suffix and the bucket of the suffix h bytes later, and each new depth
   is used for the next. Bucket identifiers are hashes of the content, the same in every task.
2. **Sampling.** Every place looks at the suffixes of the first half of its string and points to that of
   the smallest bucket (the first of equals). Places that share a pointer form a block. Equal strings
   have their pointers at equal offsets, so the pointers, refined to half the depth, are grouped over
   the whole corpus, and blocks whose pointer is alone in its bucket are done: nothing there repeats.
3. **Refinement.** The remaining blocks are refined to the content of all their strings together:
   where that occurs twice, the whole block repeats. Where it does not, but the pointer is shared, one
   block of each content is cut into cells of ``CELL`` places; cells are refined to what their
   strings have in common, and those that still share a bucket place by place.
4. **Removal.** The strings found are merged to runs of bytes and cut out.

Buckets are counted by aggregation, never gathered; equal texts go on as one, and so do blocks of equal
content, so a passage in every document costs a few rows for each occurrence. Texts are shuffled packed,
and blocks by number: what belongs to a number is found again from the text.

Defined results: NULL and shorter texts lose nothing; matches never cross texts; rows that repeat a
doc_id are texts of their own, also when they are equal (then both lose what repeats, their whole
text if it is long enough); an empty table gives an empty result; other columns are ignored, and kept
by ``remove_repeats``, where bytes that are no whole character after the cut become the replacement
character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmart.scratch import cleared_scratch, scratch_folder, written
from reelmart.shipping import ship_package

MIN_BYTES = 400
CELL = 16
# Bytes that are refined together, and places of a long text that go into one piece.
TOGETHER = 1 << 19

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)

_RUNS = "array<struct<low:bigint,high:bigint>>"


def _mix(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The bucket of two buckets, in this order."""
    x = one * _ONE
    x ^= x >> np.uint64(29)
    x += other
    x *= _TWO
    x ^= x >> np.uint64(32)
    return x


def _first_buckets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``data`` ends in spare bytes."""
    count = len(data) - 7
    found = np.empty(count, np.uint64)
    for shift in range(8):
        whole = (len(data) - shift) // 8 * 8
        found[shift::8] = data[shift : shift + whole].view("<u8")
    return found


def _refined(buckets: np.ndarray, depth: int) -> np.ndarray:
    """Buckets of twice the depth; the last places, which have no later bucket, are dropped."""
    return _mix(buckets[:-depth], buckets[depth:])


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` values from each place on."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def blocks(data: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """``(bucket, low, high, pointer)`` of the blocks of places in ``data``.

    ``low`` and ``high`` are the first and the last place of a block.
    """
    places = len(data) - min_bytes + 1
    width = min_bytes // 2 + 1
    depth = min_bytes - width + 1
    level, buckets = 8, _first_buckets(data)
    pointers = None
    while True:
        if level == 16:
            # Order of buckets by their upper bits, then by place.
            ranked = (buckets & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(buckets), dtype=np.uint64)
            pointers = (_least_in(ranked, width)[:places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if 2 * level > depth:
            break
        buckets = _refined(buckets, level)
        level *= 2
    begins = np.flatnonzero(np.append(True, pointers[1:] != pointers[:-1]))
    low, high = begins, np.append(begins[1:], places) - 1
    pointer = pointers[begins]
    bucket = _mix(buckets[pointer], buckets[pointer + depth - level])
    return bucket.view(np.int64), low, high, pointer


def _pieces(text: memoryview, min_bytes: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in pieces that overlap by all but one byte of a string."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - min_bytes + 1, TOGETHER):
        yield start, data[start : start + TOGETHER + min_bytes - 1]


def _bytes(scalar: pa.Scalar) -> memoryview:
    return memoryview(scalar.as_buffer()) if scalar.is_valid else memoryview(b"")


def _all_blocks(text: memoryview, min_bytes: int) -> list[np.ndarray]:
    """``[bucket, low, high, pointer]`` of all blocks of a text, in their order."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for start, piece in _pieces(text, min_bytes):
        bucket, *places = blocks(piece, min_bytes)
        for held, values in zip(found, (bucket, *(p + start for p in places))):
            held.append(values)
    return [np.concatenate(held) if held else np.empty(0, np.int64) for held in found]


def _as_batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields)
    )


def _sign(batches: Iterable[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Size, hash and buckets of each text."""
    for batch in batches:
        sizes, digests, found = [], [], []
        for scalar in batch.column(2):
            text = _bytes(scalar)
            sizes.append(len(text))
            digests.append(sha256(text).hexdigest())
            found.append(_all_blocks(text, min_bytes)[0])
        ends = np.cumsum([0, *map(len, found)])
        buckets = pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), buckets),
            ],
            names=["key", "doc_id", "n_bytes", "whole_sha256", "buckets"],
        )


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress(_bytes(scalar)) for scalar in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "packed"])


def _unpacked(scalar: pa.Scalar) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(scalar.as_buffer()))


_GROWN = {"text_id": pa.int64(), "copies": pa.int64(), "number": pa.int32(), "bucket": pa.int64(), "content": pa.binary()}


def _grown(batches: Iterable[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """The content of all strings of each remaining block, as a hash."""
    for batch in batches:
        rows: list[tuple] = []
        for text_id, packed, copies, numbers in zip(*batch.columns):
            text = _unpacked(packed)
            bucket, low, high, _ = (x.tolist() for x in _all_blocks(text, min_bytes))
            for n in numbers.as_py():
                content = xxhash.xxh3_128_digest(text[low[n] : high[n] + min_bytes])
                rows.append((text_id.as_py(), copies.as_py(), n, bucket[n], content))
        yield _as_batch(rows, _GROWN)


_CELLS = {
    "text_id": pa.int64(), "alone": pa.bool_(), "last": pa.int32(), "least": pa.int32(), "most": pa.int32(),
    "shared": pa.binary(), "before": pa.binary(), "after": pa.binary(),
}


def _cells(batches: Iterable[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """The cells of each example: a hash of what their strings share, and the bytes around it.

    The string that begins ``i`` bytes before ``last``, for ``i`` from ``least`` to ``most``, is the last
    ``i`` bytes of ``before``, the shared bytes, and the first ``CELL - 1 - i`` bytes of ``after``.
    """
    for batch in batches:
        rows: list[tuple] = []
        for text_id, packed, examples in zip(*batch.columns):
            text = _unpacked(packed)
            _, lows, highs, pointers = (x.tolist() for x in _all_blocks(text, min_bytes))
            for example in examples.as_py():
                n = example["number"]
                low, high, pointer = lows[n], highs[n], pointers[n]
                # Cells are counted back from the pointer, alike wherever the strings occur.
                for cell in range((pointer - high) // CELL, (pointer - low) // CELL + 1):
                    last = pointer - cell * CELL
                    end = last - CELL + 1 + min_bytes
                    shared = xxhash.xxh3_128(text[last:end])
                    shared.update(cell.to_bytes(4, "little"))
                    first, final = max(low, last - CELL + 1), min(high, last)
                    rows.append((
                        text_id.as_py(), example["alone"], last, last - final, last - first, shared.digest(),
                        bytes(text[first:last]), bytes(text[end : final + min_bytes]),
                    ))
        yield _as_batch(rows, _CELLS)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one."""
    found: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def _cut(text: memoryview, runs: list[tuple[int, int]]) -> bytes:
    parts, done = [], 0
    for low, high in runs:
        parts.append(text[done:low])
        done = high
    parts.append(text[done:])
    return b"".join(parts)


def _cut_texts(batches: Iterable[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """What goes of each text: its blocks but for those alone, and single strings."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    fields = {"its_key": pa.binary(), "n_removed": pa.int64(), "runs": kind, "kept_sha256": pa.string()}
    for batch in batches:
        rows: list[tuple] = []
        for key, packed, copies, numbers, alone, singles in zip(*batch.columns):
            text = _unpacked(packed)
            if copies.as_py() > 1:
                runs = [(0, len(text))]
            else:
                _, low, high, _ = (x.tolist() for x in _all_blocks(text, min_bytes))
                repeated = set(numbers.as_py()).difference(alone.as_py() or ())
                spans = [(low[n], high[n] + min_bytes) for n in repeated]
                runs = merged(spans + [(p, p + min_bytes) for p in singles.as_py() or ()])
            listed = [{"low": low, "high": high} for low, high in runs]
            removed = sum(high - low for low, high in runs)
            rows.append((key.as_py(), removed, listed, sha256(_cut(text, runs)).hexdigest()))
        yield _as_batch(rows, fields)


def text_key(text: Column) -> Column:
    """Equal for equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _candidates(keyed: DataFrame, min_bytes: int, signed: DataFrame, folder: str) -> DataFrame:
    """Texts with blocks whose pointer shares its bucket, written to ``folder``, one row per text.

    text_id, key, packed (the text), copies (rows that have it) and numbers (of the remaining blocks).
    """
    spark = keyed.sparkSession
    pointed = signed.select("row_id", F.posexplode("buckets").alias("number", "bucket"))
    # Counts are written before they are joined: only then can a bucket with many rows be split.
    shared = written(pointed.groupBy("bucket").count().where("count > 1").select("bucket"))
    remaining = (
        pointed.join(shared, "bucket", "left_semi")
        .groupBy("row_id")
        .agg(F.collect_list("number").alias("numbers"))
        .join(signed.select("row_id", F.col("key").alias("its_key")), "row_id")
        # Equal texts have equal blocks.
        .groupBy("its_key")
        .agg(F.first("numbers").alias("numbers"))
    )
    texts = (
        keyed.where(F.octet_length("text") >= min_bytes)
        .select("key", "text")
        .mapInArrow(_packed, "key binary, packed binary")
        .groupBy("key")
        .agg(F.first("packed").alias("packed"), F.count("*").alias("copies"))
        .join(remaining, F.col("key") == F.col("its_key"))
        .select(F.monotonically_increasing_id().alias("text_id"), "key", "packed", "copies", "numbers")
    )
    texts.write.parquet(folder)
    return spark.read.schema(texts.schema).parquet(folder)


def _single_strings(texts: DataFrame, contents: DataFrame, min_bytes: int) -> DataFrame:
    """``(text_id, low)``: strings that repeat within blocks that as a whole do not."""
    several = written(contents.groupBy("bucket").count().where("count > 1").select("bucket"))
    examples = (
        contents.join(several, "bucket", "left_semi")
        .groupBy(F.col("example.text_id").alias("its_id"))
        .agg(F.collect_list(F.struct("example.number", (F.col("blocks") == 1).alias("alone"))).alias("examples"))
    )
    cells = written(
        texts.join(examples, F.col("text_id") == F.col("its_id"))
        .select("text_id", "packed", "examples")
        .mapInArrow(
            lambda batches: _cells(batches, min_bytes),
            "text_id bigint, alone boolean, last int, least int, most int, shared binary, before binary, after binary",
        )
    )
    still = written(cells.groupBy("shared").count().where("count > 1").select("shared"))
    strings = written(
        cells.join(still, "shared", "left_semi")
        .withColumn("back", F.explode(F.sequence("least", "most")))
        .select(
            "text_id",
            "alone",
            (F.col("last") - F.col("back")).alias("low"),
            "shared",
            "back",
            F.substring("before", F.col("most") - F.col("back") + 1, F.col("back")).alias("before"),
            F.substring("after", F.lit(1), F.lit(CELL - 1) - F.col("back")).alias("after"),
        )
    )
    string = ["shared", "back", "before", "after"]
    twice = written(strings.groupBy(*string).count().where("count > 1").select(*string))
    return strings.where("alone").join(twice, string, "left_semi").select("text_id", "low")


def repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Per row: key, doc_id, n_bytes, n_removed, runs (low, high: bytes, end exclusive), kept_sha256."""
    if min_bytes < 64:
        raise ValueError("strings of 64 bytes at least")
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(text_key(F.col("text")).alias("key"), "doc_id", "text")
    signed = (
        keyed.mapInArrow(
            lambda batches: _sign(batches, min_bytes),
            f"key binary, doc_id {id_type}, n_bytes bigint, whole_sha256 string, buckets array<bigint>",
        )
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    signed = written(signed)
    texts = _candidates(keyed, min_bytes, signed, scratch_folder(spark))

    # What the steps in between write is deleted as soon as it has been used.
    edges = scratch_folder(spark)
    with cleared_scratch(spark):
        grown = texts.select("text_id", "packed", "copies", "numbers").mapInArrow(
            lambda batches: _grown(batches, min_bytes),
            "text_id bigint, copies bigint, number int, bucket bigint, content binary",
        )
        contents = written(
            grown.groupBy("bucket", "content").agg(
                F.sum("copies").alias("blocks"), F.min(F.struct("text_id", "number")).alias("example")
            )
        )
        alone = (
            contents.where("blocks = 1")
            .groupBy(F.col("example.text_id").alias("its_id"))
            .agg(F.collect_list("example.number").alias("alone"), F.array().cast("array<int>").alias("singles"))
        )
        singles = (
            _single_strings(texts, contents, min_bytes)
            .groupBy(F.col("text_id").alias("its_id"))
            .agg(F.array().cast("array<int>").alias("alone"), F.collect_set("low").alias("singles"))
        )
        alone.unionByName(singles).groupBy("its_id").agg(
            F.flatten(F.collect_list("alone")).alias("alone"), F.flatten(F.collect_list("singles")).alias("singles")
        ).write.parquet(edges)
    edges = spark.read.schema("its_id bigint, alone array<int>, singles array<int>").parquet(edges)

    cut = (
        texts.join(edges, F.col("text_id") == F.col("its_id"), "left")
        .select("key", "packed", "copies", "numbers", "alone", "singles")
        .mapInArrow(
            lambda batches: _cut_texts(batches, min_bytes),
            f"its_key binary, n_removed bigint, runs {_RUNS}, kept_sha256 string",
        )
    )
    return signed.drop("buckets").join(cut, F.col("key") == F.col("its_key"), "left").select(
        "key",
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all other columns are kept."""
    runs = (
        repeats(docs, min_bytes)
        .where("n_removed > 0")
        .select(F.col("key").alias("__cut_key"), F.col("runs").alias("__cut_runs"))
        .dropDuplicates(["__cut_key"])
    )
    joined = docs.join(runs, text_key(docs["text"]) == F.col("__cut_key"), "left")
    at, schema = docs.columns.index("text"), docs.schema

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(
                [
                    _cut(_bytes(text), [(r["low"], r["high"]) for r in own.as_py()]).decode("utf-8", "replace") if own.is_valid else text.as_py()
                    for text, own in zip(batch.column(at), batch.columns[-1])
                ],
                pa.string(),
            )
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.drop("__cut_key").mapInArrow(cut, schema)
