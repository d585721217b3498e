"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words. A benchmark item contributes each run of ``n`` words,
an item of fewer words its whole sequence; a document word within any occurrence of such a window is
hit. Only DataFrame operations are used.

How windows are found: a window of L words covers a gram of ``ceil(L / 2)`` words that begins at a
multiple of ``L - ceil(L / 2) + 1``. So of each document only the grams at those places are hashed and
looked up in the broadcast set of all benchmark grams; where one is found, the windows around it are
compared with the benchmark's word by word. Benchmarks of more grams than one broadcast may hold are
looked up in several passes, each with a bounded part of the set.

Defined results: NULL texts and texts without words have no words, no hits and are not contaminated;
items without words are ignored; a NULL item_id counts as the item ``null``; items with equal texts
are all counted; repeated document rows are all returned, a NULL doc_id too; an empty benchmark hits
nothing. Other columns are ignored, and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmart.scratch import written

# Characters of words: digits, letters a-z in either case, everything beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Grams in one broadcast: 12 bytes each, some 100 MB as a hash table.
BROADCAST_GRAMS = 1_000_000


def words_of(text: Column) -> Column:
    """Words in their own case; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _gram(length: int) -> tuple[int, int]:
    """Words of a gram, and the step between the places where documents are looked at."""
    gram = math.ceil(length / 2)
    return gram, length - gram + 1


def _gram_hash(words: Column, begin: Column, gram: int) -> Column:
    """Hash of ``gram`` words from ``begin`` (0-based), in any case.

    Lower-casing all letters here only makes more grams agree; the comparison that follows is exact.
    """
    return F.xxhash64(F.transform(F.slice(words, begin + 1, gram), F.lower))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct ``(item, length, window)``: the windows of every item, words joined by blanks."""
    words = F.split(lower_ascii(F.concat_ws(" ", words_of(F.col("text")))), " ")
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words.alias("words")
    ).where(F.col("words")[0] != "")
    length = F.least(F.size("words"), F.lit(n))
    return (
        items.withColumn("length", length)
        .withColumn("begin", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
        .select("item", "length", F.concat_ws(" ", F.slice("words", F.col("begin"), F.col("length"))).alias("window"))
        .distinct()
    )


def _benchmark_grams(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct ``(gram_length, gram_hash)`` of all grams at any place of a window."""
    parts = []
    for length in lengths:
        gram, step = _gram(length)
        words = F.split("window", " ")
        parts.append(
            windows.where(F.col("length") == length)
            .select(
                F.lit(length).alias("gram_length"),
                F.explode(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(step - 1)), lambda at: _gram_hash(words, at, gram)
                    )
                ).alias("gram_hash"),
            )
            .distinct()
        )
    return reduce(DataFrame.unionByName, parts)


def _probes(words: Column, length: int) -> Column:
    """Array of (length, place, hash) of the grams that a document is looked up by."""
    gram, step = _gram(length)
    places = F.sequence(F.lit(0), F.size(words) - gram, F.lit(step))
    probe = F.transform(
        places,
        lambda at: F.struct(
            F.lit(length).alias("length"), at.alias("place"), _gram_hash(words, at, gram).alias("hash")
        ),
    )
    none = F.array().cast("array<struct<length:int,place:int,hash:bigint>>")
    return F.when(F.size(words) >= length, probe).otherwise(none)


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct ``(doc_id, text_hash, begin, length, item)``: where benchmark windows occur.

    ``begin`` is the 0-based number of the first word; ``text_hash`` tells rows of one doc_id apart.
    """
    windows = written(benchmark_windows(benchmark, n))
    # At most n different lengths.
    lengths = sorted(row[0] for row in windows.select("length").distinct().collect())
    spark = docs.sparkSession
    if not lengths:
        shape = "text_hash bigint, begin int, length int, item string"
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {id_type}, {shape}")
    grams = written(_benchmark_grams(windows, lengths))
    passes = math.ceil(grams.count() / BROADCAST_GRAMS)

    probed = docs.select(
        "doc_id", text_hash(F.col("text")).alias("text_hash"), words_of(F.col("text")).alias("words")
    ).withColumn("probe", F.explode(F.concat(*(_probes(F.col("words"), x) for x in lengths))))
    found = []
    for number in range(passes):
        part = grams.where(F.pmod("gram_hash", F.lit(passes)) == number)
        found.append(
            probed.join(
                F.broadcast(part),
                (F.col("probe.hash") == F.col("gram_hash"))
                & (F.col("probe.length") == F.col("gram_length")),
            )
        )
    near = reduce(DataFrame.unionByName, found)

    step = F.col("gram_length") - F.ceil(F.col("gram_length") / 2).cast("int") + 1
    first = F.greatest(F.lit(0), F.col("probe.place") - step + 1)
    around = near.select(
        "doc_id",
        "text_hash",
        F.col("gram_length").alias("length"),
        first.alias("first"),
        F.split(
            lower_ascii(
                F.concat_ws(
                    " ", F.slice("words", first + 1, F.col("probe.place") - first + F.col("gram_length"))
                )
            ),
            " ",
        ).alias("around"),
    )
    begins = F.sequence(F.lit(0), F.size("around") - F.col("length"))
    occurring = (
        around.where("size(around) >= length")
        .withColumn("shift", F.explode(begins))
        .select(
            "doc_id",
            "text_hash",
            (F.col("first") + F.col("shift")).alias("begin"),
            "length",
            F.concat_ws(" ", F.slice("around", F.col("shift") + 1, F.col("length"))).alias("window"),
        )
    )
    return (
        occurring.join(windows, ["length", "window"])
        .select("doc_id", "text_hash", "begin", "length", "item")
        .distinct()
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, items and spans.

    ``items`` are the ids of the items with occurring windows, as sorted strings; ``spans`` the hit
    stretches of words as an array of (begin, end), end exclusive.
    """
    hits = written(window_hits(docs.select("doc_id", "text"), benchmark, n))
    items = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # Windows that overlap or touch make one span; a document has one window per word at most.
    of_document = Window.partitionBy("doc_id", "text_hash").orderBy("begin", "end")
    before = of_document.rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        hits.select("doc_id", "text_hash", "begin", (F.col("begin") + F.col("length")).alias("end"))
        .distinct()
        .withColumn("apart", F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)))
        .withColumn("span", F.sum(F.col("apart").cast("int")).over(of_document))
        .groupBy("doc_id", "text_hash", "span")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    )
    found = items.join(
        spans.withColumnsRenamed({"doc_id": "s_id", "text_hash": "s_hash"}),
        F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")),
    ).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "items", "spans")
    counted = docs.select(
        "doc_id",
        text_hash(F.col("text")).alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
    )
    no_spans = F.array().cast("array<struct<begin:int,end:int>>")
    return counted.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")),
        "left",
    ).select(
        "doc_id",
        "text_hash",
        "n_words",
        F.expr("aggregate(coalesce(spans, array()), 0L, (n, s) -> n + s.end - s.begin)").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", no_spans).alias("spans"),
    )


def contaminated(one_in: int = 20) -> Column:
    """The rule on the columns of ``contamination``: at least one word in ``one_in`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 13, one_in: int = 20
) -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``spans``) without the hit words themselves.

    All columns are kept. In mode ``spans`` a hit word goes together with what separates it from the
    next word.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"no such mode: {mode}")
    found = contamination(docs, benchmark, n)
    found = found.where(contaminated(one_in) if mode == "documents" else "n_hit > 0").select(
        F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"), F.col("spans").alias("__spans")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__hit_id")) & (text_hash(docs["text"]) == F.col("__hit_hash"))
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    # Words and what lies between them alternate; the first piece is a word or not.
    pieces = F.regexp_extract_all(docs["text"], F.lit(f"({_WORD}(?:{_BETWEEN})?|{_BETWEEN})"), F.lit(1))
    offset = F.when(docs["text"].rlike(f"^{_BETWEEN}"), 1).otherwise(0)

    def kept(piece: Column, at: Column) -> Column:
        word = at - offset
        hit = F.exists("__spans", lambda s: (word >= s["begin"]) & (word < s["end"]))
        return F.when(hit, F.lit("")).otherwise(piece)

    cleaned = F.when(F.col("__spans").isNull(), docs["text"]).otherwise(
        F.concat_ws("", F.transform(pieces, kept))
    )
    columns = [cleaned.alias(c) if c == "text" else docs[c] for c in docs.columns]
    return docs.join(found, same, "left").select(*columns)
