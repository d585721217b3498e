"""Spelling variants of words, joined by asymmetric chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced character. The shorter
word of such a pair (either one, if both are as long) contributes two disjoint chunks, its halves; the
other one its positional grams. One edit leaves one of the chunks whole, at its own place if the edit
comes after it, and moved by the difference of the lengths if the edit comes before. So the join takes
chunk and gram with equal text, the lengths and that place, within a shift of one, as its key; grams at
other places can meet no chunk and are not posted. Pairs are verified by their edit distance within the
join, so only near pairs leave it.

A chunk that very many words share makes a large list, which would compare all its chunks with all its
grams. Lists of more than ``MOST_PAIRS`` comparisons are therefore not joined: what is outside the chunk
must hold the edit, so its words post the two halves of that as further chunks, next to the first one, in
turns, until lists are short. At the last turn words of a list differ in one character. Nothing is cut
off, and no list is compared all with all beyond the bound, however many words share their beginning.

Words and pairs are written tables and all steps are built-in expressions; roots are found by pointer
jumping, whose turns grow with the logarithm of the longest chain of forms.

Defined results: a NULL or empty text has no words; a NULL doc_id is the text ``null`` in the checksum;
rows that repeat a doc_id count each for itself; a run of one character that is deleted is no word; ties
of forms go to the smallest in code-point order; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.scratch import measured, written

RUN = r"[a-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
# A form has at least this many times the occurrences of the word.
TIMES = 5
# One in so many runs of documents loses a character.
EVERY = 199
# Comparisons of one list in the join.
MOST_PAIRS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, run)``: every run of letters, A-Z lower-cased."""
    text = F.translate("text", _UPPER, _LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def with_slips(found: DataFrame, every: int = EVERY) -> DataFrame:
    """``(word)``: the runs, of which a checksum of document and run makes some lose a character."""
    checksum = F.crc32(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")).cast("binary")
    )
    place = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.expr("left(run, h % length(run))"), F.substring("run", place + 2, F.length("run")))
    return found.withColumn("h", checksum).select(
        F.when(F.col("h") % every == 0, without).otherwise(F.col("run")).alias("word")
    )


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    return (
        words.where(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _opened(words: DataFrame) -> DataFrame:
    """The rows that post before the first halving: nothing is shared yet, the whole word may hold the edit.

    Words of equal length meet in rows that are chunk and gram at once. Words of which one is longer
    (``longer``) meet in rows of either kind. ``length`` is that of the chunk's word on both sides, so
    both cut at the same places; ``head`` and ``tail`` are the lengths of what chunk and gram share.
    """
    kind = "struct({} AS longer, {} AS is_chunk, {} AS is_gram)"
    kinds = [kind.format(0, "true", "true"), kind.format(1, "true", "false"), kind.format(1, "false", "true")]
    length = F.length("word") - F.when(F.col("is_chunk"), 0).otherwise(F.col("longer"))
    return (
        words.select("word", "n", F.expr(f"inline(array({', '.join(kinds)}))"))
        .withColumn("length", length)
        .where("length > 0")
        .withColumns({"head": F.lit(0), "tail": F.lit(0)})
    )


def _posted(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first and with the last half of its open part as a further chunk.

    ``list`` stands for lengths, places and text of all that is shared; as pairs are verified, words that
    it brings together by chance do no harm.
    """
    half = F.expr("(length - head - tail) div 2").cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    last = F.struct(F.col("head").alias("head"), (F.col("length") - F.col("head") - half).alias("tail"))
    plain = ["word", "n", "longer", "is_chunk", "is_gram", "length"]
    # The end is taken from the end of the word: a longer word has it one place later.
    start, end = F.expr("substring(word, 1, head)"), F.expr("substring(word, length(word) - tail + 1, tail)")
    return (
        rows.select(*plain, F.explode(F.array(first, last)).alias("shared"))
        .select(*plain, "shared.head", "shared.tail")
        .withColumn("list", F.xxhash64("longer", "length", "head", "tail", start, end))
    )


def _large_lists(rows: DataFrame, most_pairs: int) -> DataFrame:
    """The lists with more than ``most_pairs`` comparisons that can still be cut."""
    chunks, grams = F.count_if("is_chunk"), F.count_if("is_gram")
    counted = rows.where(F.col("length") - F.col("head") - F.col("tail") > 1).groupBy("list")
    # As doubles, which cannot overflow.
    return counted.agg((chunks.cast("double") * grams).alias("pairs")).where(F.col("pairs") > most_pairs)


def _verified(rows: DataFrame) -> DataFrame:
    """Near pairs ``(a, n_a, b, n_b)`` within the lists; the distance is part of the join's condition."""
    a = rows.where("is_chunk").select("list", F.col("longer").alias("by"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.where("is_gram").select("list", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.col("by") == 1) | (F.col("a") < F.col("b"))
    return a.join(b, "list").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``(a, n_a, b, n_b)``: the pairs of ``words`` (word, n) that are one edit apart, each once."""
    rows = written(_posted(_opened(words)))
    found = None
    while True:
        large, measures = measured(_large_lists(rows, most_pairs).select("list"), number=F.count("*"))
        small = rows.join(large, "list", "left_anti") if measures["number"] else rows
        pairs = _verified(small)
        found = pairs if found is None else found.unionAll(pairs)
        if not measures["number"]:
            return found.distinct()
        rows = written(_posted(rows.join(large, "list", "left_semi")))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last form from each word of ``forms`` (word, form)."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links, found = measured(
            links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"),
            moved=F.count("next"),
        )
        links = links.drop("next")
        if not found["moved"]:
            return links


def grouped_variants(words: DataFrame, times: int = TIMES, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per word of ``words`` (word, n): form, root, n, n_near and form_n.

    The form is the near word of the largest n, if that is at least ``times`` the word's own.
    """
    pairs = written(near_pairs(words, most_pairs))
    both = pairs.unionAll(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "near", "near_n")
    best = (
        both.groupBy("word", "n")
        .agg(
            F.count("*").alias("n_near"),
            # Largest n first, then the smallest word by code points.
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
        )
        .select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"), "n")
    )
    is_form = F.col("form_n") >= F.col("n") * times
    found = written(
        best.select(
            "word",
            "n_near",
            F.when(is_form, F.col("form")).alias("form"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            "form_n",
        )
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per frequent word of the documents its form, root, and numbers."""
    return grouped_variants(written(vocabulary(with_slips(runs(docs)))))
