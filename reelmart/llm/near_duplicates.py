"""Near-duplicate documents by a join of inverted MinHash coordinates.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.75 or
more; linked documents form components. The steps:

1. **Signatures.** Each text becomes its set of shingle hashes, of which ``COORDINATES`` minima under
   seeded hash functions are kept. Texts with equal sets are one class from here on.
2. **Posting with a prefix.** A class posts under its (coordinate, value) pairs. A pair of classes
   that agrees in ``MATCHES`` coordinates must agree in one of the ``COORDINATES - MATCHES + 1`` rarest
   of each, so only those are posted, and those that no other class has need not be written. Values
   of a passage that many texts share are thus not posted by texts that have enough of their own.
3. **Skip merging.** In each posting list the class with the most shared values is the centre, and
   every other member is compared with it: matches are counted on the signatures, pairs above the
   threshold are confirmed on the full sets, and links are contracted to components. Then only
   lists that still hold different components are merged, and in these only the members outside the
   main component are compared with the others. Pairs within a component can add nothing, so a large
   group of copies costs its size, not its square.
4. **Bitmaps.** The join of two postings also compares bitmaps in which every shingle flips one of
   ``BITS`` bits. Sets differ in as many shingles at least as their bitmaps in bits, so pairs that
   cannot be similar are never emitted, and no link is lost.

A pair of similarity 0.75 has 36 of 48 matches on average; fewer than the 18 asked for occur once in
about 119 million such pairs, and less often the more similar they are.

Defined results: a text without words, or NULL, has an empty set and is its own component; a text of
fewer than five words has one shingle, its whole sequence; every set is searched, also if rows repeat a
doc_id with different texts: then all their links are links of that document, and each row is
returned; a NULL doc_id is linked with nothing and has a NULL component; an empty table gives an empty
result. Other columns of the input are ignored. ``drop_near_duplicates`` looks at rows by their texts: of
rows that repeat a doc_id only those go whose own text another document stands for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmart.llm.batches import slices
from reelmart.scratch import written
from reelmart.shipping import ship_package

SHINGLE = 5
COORDINATES = 48
MATCHES = 18
BITS = 1024
SIMILAR_PERCENT = 75

# Words whose hashes a worker remembers, and shingles that are hashed together.
_WORDS_KNOWN = 100_000
_TOGETHER = 1 << 15
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _WordHashes()


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text."""
    # Bytes are lower-cased in A-Z only and split at ASCII white space only.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_known) > _WORDS_KNOWN:
        _known.clear()
    hashes = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    rolled = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        rolled *= _PRIME
        rolled ^= rolled >> np.uint64(29)
        rolled += hashes[i : i + len(rolled)]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _PRIME
    return np.unique(rolled)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeded = np.random.default_rng(20_240)
    draw = seeded.integers(1, 2**63, (2, COORDINATES), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima under the seeded functions, as 32-bit values."""
    factor, offset = _functions()
    lowest = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), _TOGETHER):
        part = hashes[start : start + _TOGETHER, None] * factor + offset
        np.minimum(lowest, part.min(axis=0), out=lowest)
    return (lowest >> np.uint64(32)).astype(np.uint32)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each bit, as 64-bit numbers."""
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def may_be_similar(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column) -> Column:
    """False only where the sets must be less similar than asked for."""
    apart = reduce(
        Column.__add__, (F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(BITS // 64))
    )
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SIMILAR_PERCENT
    return sizes & ((n_a + n_b) * (100 - SIMILAR_PERCENT) >= apart * (100 + SIMILAR_PERCENT))


def _set_key(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, keys = [], []
        values = np.zeros((batch.num_rows, COORDINATES), np.int64)
        bits = np.zeros((batch.num_rows, BITS // 64), np.int64)
        for i, text in enumerate(batch.column(1)):
            hashes = shingle_hashes(text.as_py())
            sizes.append(len(hashes))
            keys.append(_set_key(hashes))
            values[i] = signature(hashes)
            bits[i] = bitmap(hashes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                _lists(values),
                _lists(bits),
                batch.column(2),
            ],
            names=["doc_id", "n_shingles", "set_key", "signature", "bitmap", "text_key"],
        )


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def text_key(text: Column) -> Column:
    """The digest of a text; NULL for none."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (equal for equal sets), signature, bitmap and text_key."""
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(
        _sign,
        f"doc_id {id_type}, n_shingles bigint, set_key binary, signature array<bigint>, bitmap array<bigint>, "
        "text_key binary",
    )


def posting_lists(classes: DataFrame) -> DataFrame:
    """``(coordinate, value, member, n, bits, weight)``: the prefix postings that several classes have.

    ``classes`` has member, signature, n and bits. ``weight`` adds up how often the member's values occur
    elsewhere, so it is largest for the text that others resemble most.
    """
    posted = classes.select("member", F.posexplode("signature").alias("coordinate", "value"))
    shared = written(
        posted.groupBy("coordinate", "value").agg(F.count("*").alias("classes")).where("classes > 1")
    )
    prefix = COORDINATES - MATCHES + 1
    # The values of a member: 48 at most. Those not shared come first in the order, unwritten.
    ordered = (
        posted.join(shared, ["coordinate", "value"])
        .groupBy("member")
        .agg(
            F.sort_array(F.collect_list(F.struct("classes", "coordinate", "value"))).alias("ordered"),
            F.sum("classes").alias("weight"),
        )
        .where(F.size("ordered") >= MATCHES)
    )
    rarest = F.slice("ordered", F.lit(1), prefix - (COORDINATES - F.size("ordered")))
    return (
        ordered.select("member", "weight", rarest.alias("rarest"))
        .join(classes.select("member", "n", "bits"), "member")
        .select("member", "n", "bits", "weight", F.explode("rarest").alias("posting"))
        .select("posting.coordinate", "posting.value", "member", "n", "bits", "weight")
    )


def _of_pair(side: str, column: str, values: DataFrame) -> DataFrame:
    return values.select(F.col("member").alias(side), F.col(column).alias(f"{column}_{side}"))


def _with_matches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``MATCHES`` coordinates at least."""
    both = pairs.join(_of_pair("a", "signature", classes), "a").join(
        _of_pair("b", "signature", classes), "b"
    )
    matches = F.aggregate(
        F.zip_with("signature_a", "signature_b", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return both.where(matches >= MATCHES).select("a", "b")


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose set is that of the class they are taken for."""
    for batch in slices(batches):
        members, found = [], []
        for member, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
            hashes = shingle_hashes(text.as_py())
            if _set_key(hashes) == key.as_py():
                members.append(member.as_py())
                found.append(hashes.view(np.int64))
        ends = np.cumsum([0, *map(len, found)])
        sets = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found]))
        )
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), sets], names=["member", "hashes"])


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that are linked by their full sets, which are taken from a text of each class."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    asked = classes.select("member", "set_key", "first_id").join(needed, "member", "left_semi")
    sets = written(
        docs.select(F.col("doc_id").alias("first_id"), "text")
        .join(asked, "first_id")
        .select("member", "set_key", "text")
        .mapInArrow(_sets, "member bigint, hashes array<bigint>")
        # Rows that repeat a doc_id may have the same set.
        .dropDuplicates(["member"])
    )
    both = pairs.join(_of_pair("a", "hashes", sets), "a").join(_of_pair("b", "hashes", sets), "b")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    together = F.size("hashes_a") + F.size("hashes_b") - common
    return both.where(common * 100 >= together * SIMILAR_PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(member, component)`` of the members of ``links`` (a, b): the smallest member reachable.

    Links are contracted in turns, each larger neighbour to the smallest one around a member, and then
    each smaller one; every turn is written, and the number of turns grows with the logarithm of the
    longest chain.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .where("high <> low")
        .distinct()
    )
    before = None
    while True:
        # Around every member: its larger neighbours go to its smallest neighbour, or to itself.
        both = edges.union(edges.select(F.col("low"), F.col("high"))).toDF("member", "near")
        lowest = both.groupBy("member").agg(F.least(F.min("near"), F.col("member")).alias("lowest"))
        larger = (
            both.where("near > member")
            .join(lowest, "member")
            .select(F.col("near").alias("high"), F.col("lowest").alias("low"))
            .distinct()
        )
        # Around every member: its smaller neighbours, and itself, go to the smallest of them.
        smallest = larger.groupBy("high").agg(F.min("low").alias("lowest"))
        joined = larger.join(smallest, "high")
        edges = written(
            joined.select(F.col("low").alias("high"), F.col("lowest").alias("low"))
            .union(smallest.select("high", F.col("lowest").alias("low")))
            .where("high <> low")
            .distinct()
        )
        # Stable when every member has one link, and the same as before.
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select("low").distinct()
    return edges.union(roots.select("low", "low")).toDF("member", "component")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their component, their own id where they have no link."""
    labels = found.select(F.col("member").alias("labelled"), "component")
    return (
        members.join(labels, F.col("member") == F.col("labelled"), "left")
        .withColumn("component", F.coalesce("component", "member"))
        .drop("labelled")
    )


def pairs_across(postings: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of one list and different components that may be similar.

    ``postings`` are ``posting_lists`` with the component of each member. In each list the members of
    its main component are met by those of the others only, so a list costs its size times the number
    of members outside the main component.
    """
    posting = ["coordinate", "value"]
    main = written(
        postings.groupBy(*posting, "component")
        .count()
        .groupBy(*posting)
        .agg(
            F.max_by("component", F.struct("count", "component")).alias("main"),
            F.count("*").alias("components"),
        )
        .where("components > 1")
        .select(*posting, "main")
    )
    mixed = written(postings.join(main, posting))

    def side(name: str) -> DataFrame:
        columns = {"member": name, "component": f"of_{name}", "n": f"n_{name}", "bits": f"bits_{name}"}
        return mixed.select(*posting, "main", *(F.col(c).alias(to) for c, to in columns.items()))

    similar = may_be_similar(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"))
    return (
        side("a")
        .where("of_a <> main")
        .join(side("b").drop("main"), posting)
        .where(F.expr("of_a <> of_b AND (of_b = main OR a < b)") & similar)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _links_of_sets(classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: enough links between similar sets that all others follow, and their components."""
    lists = written(posting_lists(classes))

    # Written, as are the main components below, so that the join can split a list of many members.
    centres = written(
        lists.groupBy("coordinate", "value").agg(
            F.max_by(F.struct("member", "n", "bits"), F.struct("weight", "member")).alias("centre")
        )
    )
    to_centre = (
        lists.join(centres, ["coordinate", "value"])
        .where(F.col("member") != F.col("centre.member"))
        .where(may_be_similar(F.col("n"), F.col("bits"), F.col("centre.n"), F.col("centre.bits")))
        .select(
            F.least("member", "centre.member").alias("a"), F.greatest("member", "centre.member").alias("b")
        )
        .distinct()
    )
    near = written(_with_matches(to_centre, classes))
    links = written(_confirmed(near, classes, docs))

    found = written(components(links))
    across = pairs_across(_labelled(lists, found))
    more = written(_with_matches(across, classes))
    links = links.union(_confirmed(more, classes, docs))
    return links, written(components(links))


def _links_of_ids(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``(a, b)`` between the sets of one doc_id, if any has several: all to the first of them."""
    several = written(
        signed.groupBy("doc_id")
        .agg(F.min("set_key").alias("one"), F.max("set_key").alias("other"))
        .where("one <> other")
        .select("doc_id")
    )
    if several.isEmpty():
        return None
    members = written(
        signed.join(several, "doc_id", "left_semi")
        .select("doc_id", "set_key")
        .distinct()
        .join(classes.select("set_key", "member"), "set_key")
        .select("doc_id", "member")
    )
    first = members.groupBy("doc_id").agg(F.min("member").alias("a"))
    return members.join(first, "doc_id").where("member <> a").select("a", F.col("member").alias("b"))


def _with_components(docs: DataFrame, join_ids: bool) -> DataFrame:
    """The signed rows with the smallest doc_id of their component; with ``join_ids`` through ids as well."""
    signed = written(signatures(docs))
    sound = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = sound.groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"),
        F.first(F.struct("signature", F.col("n_shingles").alias("n"), F.col("bitmap").alias("bits"))).alias("sign"),
    )
    # Numbered as it is written: what is read from there on has the same numbers.
    classes = written(grouped.select(F.monotonically_increasing_id().alias("member"), "set_key", "first_id", "sign.*"))
    links, found = _links_of_sets(classes, docs)
    more = _links_of_ids(sound, classes) if join_ids else None
    if more is not None:
        found = written(components(links.union(more)))
    labelled = written(_labelled(classes.select("set_key", "first_id", "member"), found))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("smallest_id"))
    ids = labelled.join(smallest, "component").select(F.col("set_key").alias("its_key"), "smallest_id")
    linked = (F.col("set_key") == F.col("its_key")) & (F.col("n_shingles") > 0)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("smallest_id"), F.col("doc_id")))
    return signed.join(ids, linked, "left").withColumn("component_id", component)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept (it is its component's smallest)."""
    return _with_components(docs, join_ids=True).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another document of its component stands for.

    All columns are kept. Rows with a NULL doc_id stay; of repeated rows all stay or none.
    """
    gone = (
        _with_components(docs, join_ids=False)
        .where("doc_id <> component_id")
        .select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key"))
        .distinct()
    )
    of_row = (docs["doc_id"] == F.col("__gone_id")) & (text_key(docs["text"]) == F.col("__gone_key"))
    return docs.join(gone, of_row, "left_anti")
