"""Token counts by rank-synchronous merging of ragged arrays.

A text is split into pre-tokens by the byte-level pattern. The pre-tokens that a worker has not seen
yet are held together as one flat numpy array of symbols with the sequence each belongs to. In a
round, every sequence finds the lowest rank among its adjacent pairs and merges all places of that
pair at once, from left to right; sequences without a known pair are done, and their symbols are
counted. This gives the counts of the greedy merge order: a pair that holds a merged symbol ranks after
the merge that made the symbol, so no merge of a round can call for another one before it.

The vocabulary is a public file that the caller names; each worker reads it by the name of the
installed package, so nothing of it is shipped.

Defined results: NULL and empty texts have no tokens; special strings count as one token; whole texts
are counted, long ones in pieces of their pre-tokens; repeated rows are counted each for itself; a
NULL doc_id is kept; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmart.llm.batches import slices
from reelmart.shipping import ship_package

# Fixed value: the pattern of the byte-level pre-tokenizer.
PRE_TOKEN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

# Pre-tokens that are looked up together, and counts that a worker remembers.
TOKENS_TOGETHER = 200_000
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class MergeTable:
    """Symbols, the ranks of their pairs, and the special strings of a vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.byte_ids = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        # Symbols are vocabulary ids; the span leaves room for the one pair key.
        self.span = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A sentinel above all keys keeps every search within bounds.
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, 0)
        self.made = made
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_first = special

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        wanted = left * self.span + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], len(self.made))

    def count_symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word when no pair can be merged any more."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = len(self.made)
        while len(symbols) > 1:
            joined = owner[:-1] == owner[1:]
            ranks = np.where(joined, self.pair_ranks(symbols[:-1], symbols[1:]), none)
            lowest = np.full(len(words), none)
            np.minimum.at(lowest, owner[:-1], ranks)
            open_words = lowest < none
            if not open_words.any():
                break
            chosen = (ranks == lowest[owner[:-1]]) & (ranks < none)
            at = _without_overlaps(np.flatnonzero(chosen))
            symbols[at] = self.made[ranks[at]]
            keep = open_words[owner]
            keep[at + 1] = False
            counts[open_words] -= np.bincount(owner[at], minlength=len(words))[open_words]
            symbols, owner = symbols[keep], owner[keep]
        return counts


def _without_overlaps(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other directly every second one, from the first of each run."""
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    begins = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - begins) % 2 == 0]


class TokenCounter:
    """Counts texts and remembers the counts of pre-tokens up to a fixed number."""

    def __init__(self, file: str):
        self.table = MergeTable(file)
        self.known: dict[str, int] = {}

    def _learn(self, tokens: list[str]) -> None:
        new = list(set(tokens).difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set(tokens))
        # By length, so that long words do not take the short ones through their many rounds.
        words = sorted((t.encode("utf-8", "replace"), t) for t in new)
        words.sort(key=lambda w: len(w[0]))
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            counts = self.table.count_symbols([w for w, _ in part])
            self.known.update(zip((t for _, t in part), counts.tolist()))

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many special strings there are."""
        table = self.table
        if table.special is None or not any(s in text for s in table.special_first):
            return [text], 0
        parts = table.special.split(text)
        return parts, len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            self._learn([t for _, tokens in held for t in tokens])
            known = self.known
            for i, tokens in held:
                totals[i] += sum(map(known.__getitem__, tokens))
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            pieces, totals[i] = self._pieces(text)
            for piece in pieces:
                if len(piece) < 4 * TOKENS_TOGETHER:
                    runs: Iterable[list[str]] = [PRE_TOKEN.findall(piece)]
                else:
                    found = (m.group() for m in PRE_TOKEN.finditer(piece))
                    runs = iter(lambda: list(islice(found, TOKENS_TOGETHER)), [])
                for tokens in runs:
                    held.append((i, tokens))
                    size += len(tokens)
                    if size >= TOKENS_TOGETHER:
                        settle()
        settle()
        return totals


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    return TokenCounter(vocabulary_file(vocabulary))


def vocabulary_file(vocabulary: str) -> str:
    """A path as it is; a bare name is a file of the installed tokenizer package."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    ship_package(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in slices(batches):
            totals = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), batch.column(2)],
                names=["doc_id", "n_tokens", "n_bytes"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    counted = docs.select("doc_id", "text", n_bytes.alias("n_bytes")).mapInArrow(
        count, f"doc_id {id_type}, n_tokens bigint, n_bytes bigint"
    )
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
