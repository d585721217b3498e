"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. A text is parsed against each of them into the
longest phrases that occur there; the fewer phrases it takes, the lower the cross entropy, and the
language of the fewest phrases, normalised by the letters read, wins.

Learning is bounded: of each language the labelled texts with
the smallest hashes of their doc_id are taken, ``TEXTS_PER_LANGUAGE`` of them at most, of each its first
``LONGEST_TEXT`` characters, until the language has its share of ``LEARNED_CHARACTERS``, or
``MOST_CHARACTERS``. All languages are learned: ``MOST_LANGUAGES`` of them share the characters, and where there
are more, groups of as many take turns, so that the automata held at once have a fixed size together; the work grows
with the number of groups, and the driver has the learned texts of all. Prediction reads whole texts. A text is cut into lanes of
``LANE`` letters that are parsed side by side, so that numpy makes one step of all lanes at once; a
phrase ends at the end of a lane, for every language alike.

What is in none of the learned languages is told by its break rate, the share of letters at which phrases
break off. Scripts and learned sizes differ in it, so each language has its own cut: up to ``HELD_TEXTS``
labelled texts that were not learned are parsed against it, and the cut lies a margin above the
``HELD_QUANTILE`` of their rates. A language that has no text to spare is cut by parts of its learned
texts against the others. Short texts have an allowance of one over the root of their letters.

Letters are compared in lower case, other characters as one blank. What no learned text holds is one
class of its own, on which each phrase ends.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; ties go to the
most frequent language; without learned texts all are ``und``; a NULL language is not learned; repeated rows
are predicted each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelmart.llm.batches import slices
from reelmart.shipping import ship_package

UNDETERMINED = "und"
# Languages whose automata are held at once.
MOST_LANGUAGES = 256
TEXTS_PER_LANGUAGE = 400
LONGEST_TEXT = 20_000
LEARNED_CHARACTERS = 160_000
MOST_CHARACTERS = 40_000
# Labelled texts per language that cuts are taken from, and the characters of each.
HELD_TEXTS = 100
HELD_CHARACTERS = 2_000
HELD_QUANTILE = 0.99
# Of the way from the quantile to 1.
MARGIN = 0.15
LANE = 256
# Letters that are parsed side by side.
TOGETHER = 1 << 21

# Classes of characters: what is no letter, and letters that were not learned.
_BLANK, _STRANGE = 0, 1


def _letters(text: str) -> np.ndarray:
    """Lower-case code points, 0 for what is no letter, with runs of 0 as one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_is_letter()[np.minimum(codes, 0x10FFFF)], codes, 0)
    if len(codes):
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
    return codes


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _automaton(codes: list[int], classes: int) -> np.ndarray:
    """The transitions of the suffix automaton of ``codes``, 0 where there is none.

    State 0 is the beginning, to which no transition leads back.
    """
    following = np.zeros((2 * len(codes) + 2, classes), np.int32)
    link, length = [-1], [0]
    last = 0
    for c in codes:
        current = len(length)
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state != -1 and following[state, c] == 0:
            following[state, c] = current
            state = link[state]
        if state != -1:
            target = int(following[state, c])
            if length[state] + 1 == length[target]:
                link[current] = target
            else:
                copy = len(length)
                following[copy] = following[target]
                length.append(length[state] + 1)
                link.append(link[target])
                while state != -1 and following[state, c] == target:
                    following[state, c] = copy
                    state = link[state]
                link[target] = link[current] = copy
        last = current
    return following[: len(length)].copy()


class LanguageModel:
    """Automata of the learned languages over one set of character classes."""

    def __init__(self, learned: dict[str, list[str]]):
        self.languages = list(learned)
        texts = {
            language: np.concatenate([np.append(_letters(t), 0) for t in learned[language]])
            for language in self.languages
        }
        used = np.unique(np.concatenate([*texts.values(), np.zeros(1, np.uint32)]))
        self.classes = np.full(0x110000, _STRANGE, dtype=np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.classes[0] = _BLANK
        self.width = len(used) + 1
        self.automata = []
        for language in self.languages:
            self.automata.append(_automaton(self.classes[texts[language]].tolist(), self.width).ravel())

    def _phrases(self, lanes: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Phrases per lane and language; ``lanes`` holds classes by step, ``used`` lengths."""
        counts = np.zeros((len(used), len(self.automata)))
        steps = [int((used > i).sum()) for i in range(lanes.shape[0])]
        for k, following in enumerate(self.automata):
            state = np.zeros(len(used), np.int32)
            ended = np.zeros(len(used), np.int32)
            for i, n in enumerate(steps):
                # Lanes are sorted by length, longest first.
                read = lanes[i, :n]
                reached = following[state[:n] * self.width + read]
                none = reached == 0
                ended[:n] += none
                state[:n] = np.where(none, following[read], reached)
            counts[:, k] = ended + 1
        return counts

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and letters (with blanks) per text."""
        total = np.zeros((len(texts), len(self.automata)))
        length = np.zeros(len(texts), np.int64)
        lanes, owners = [], []
        held = 0

        def settle() -> None:
            nonlocal held
            if not lanes:
                return
            used = np.array([len(x) for x in lanes])
            order = np.argsort(-used, kind="stable")
            grid = np.zeros((len(lanes), int(used.max())), np.int32)
            for place, i in enumerate(order):
                grid[place, : used[i]] = lanes[i]
            counts = self._phrases(np.ascontiguousarray(grid.T), used[order])
            np.add.at(total, np.array(owners)[order], counts)
            lanes.clear()
            owners.clear()
            held = 0

        for number, text in enumerate(texts):
            classes = self.classes[_letters(text)]
            length[number] = len(classes)
            for start in range(0, len(classes), LANE):
                lanes.append(classes[start : start + LANE])
                owners.append(number)
                held += len(lanes[-1])
                if held >= TOGETHER:
                    settle()
        settle()
        return total, length

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """``(language, score, break rate, letters)`` of each text.

        The score is the share of phrases that the winner saves against the next language, the break
        rate the share of letters at which its phrases break off.
        """
        readable = [i for i, t in enumerate(texts) if t and _has_letter(t)]
        found = [(UNDETERMINED, 0.0, 1.0, 0)] * len(texts)
        if not self.languages or not readable:
            return found
        phrases, length = self.measure([texts[i] for i in readable])
        order = np.argsort(phrases, axis=1, kind="stable")
        for place, i in enumerate(readable):
            best = phrases[place, order[place, 0]]
            second = phrases[place, order[place, 1]] if len(self.languages) > 1 else length[place] + 1
            score = max(0.0, min(1.0, 1 - best / second))
            breaks = _break_rate(best, length[place])
            found[i] = (self.languages[order[place, 0]], float(score), float(breaks), int(length[place]))
        return found


def _break_rate(phrases, length):
    """Phrases that break off, per letter; the last one of each lane ends with it."""
    return (phrases - -(-length // LANE)) / length


def _allowance(length):
    return 1 / np.sqrt(length)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class GroupsInTurn(LanguageModel):
    """More languages than are held at once: the automata of one group after the other, for each call anew."""

    def __init__(self, learned: dict[str, list[str]], at_once: int):
        self.languages = list(learned)
        self.groups = [
            {language: learned[language] for language in self.languages[start : start + at_once]}
            for start in range(0, len(learned), at_once)
        ]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        phrases, length = zip(*(LanguageModel(group).measure(texts) for group in self.groups))
        return np.concatenate(phrases, axis=1), length[0]


@lru_cache(maxsize=1)
def _model(learned: tuple[tuple[str, tuple[str, ...]], ...], at_once: int) -> LanguageModel:
    """One model per worker process, built from the labelled texts themselves."""
    texts = {language: list(own) for language, own in learned}
    return LanguageModel(texts) if len(texts) <= at_once else GroupsInTurn(texts, at_once)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def learned_texts(labelled: DataFrame) -> dict[str, list[str]]:
    """The bounded sample of ``labelled`` (doc_id, text, lang) that is learned from."""
    return {language: texts for learned, _ in _drawn_texts(labelled, 0) for language, texts in learned.items()}


def _drawn_texts(
    labelled: DataFrame, held_texts: int
) -> Iterator[tuple[dict[str, list[str]], dict[str, list[str]]]]:
    """The texts to learn, and beginnings of the next ``held_texts`` texts of each language, group by group."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang",
        "doc_id",
        F.least(F.length("text"), F.lit(LONGEST_TEXT)).alias("size"),
        F.substring("text", 1, LONGEST_TEXT).alias("text"),
    ).where(F.col("size") > 0)
    # One row per language, the most frequent first.
    rows = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    share = min(MOST_CHARACTERS, LEARNED_CHARACTERS // max(1, min(len(rows), MOST_LANGUAGES)))
    for start in range(0, len(rows), MOST_LANGUAGES):
        counts = {row[0]: row[1] for row in rows[start : start + MOST_LANGUAGES]}
        yield _drawn_group(usable, counts, share, held_texts)


def _drawn_group(
    usable: DataFrame, counts: dict[str, int], share: int, held_texts: int
) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """``share`` characters of each language of ``counts``, and what is held back.

    Texts are drawn by the hash of their doc_id. The choice is made on ids and lengths; only texts
    that are chosen come to the driver.
    """
    languages = list(counts)
    # A first draw of some more texts than are wanted, so that none of the steps below grows with the
    # number of texts of a language.
    shares = F.create_map(
        *(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * TEXTS_PER_LANGUAGE / n)))
    )
    first_draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30)
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    so_far = drawn.rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        usable.where(F.col("lang").isin(languages) & first_draw)
        .select("lang", "doc_id", "size")
        .withColumn("place", F.row_number().over(drawn))
        .where(F.col("place") <= TEXTS_PER_LANGUAGE + held_texts)
        .withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .withColumn("learn", (F.col("before") < share) & (F.col("place") <= TEXTS_PER_LANGUAGE))
        .withColumn("last", F.max(F.when(F.col("learn"), F.col("place"))).over(Window.partitionBy("lang")))
        .where(F.col("place") <= F.col("last") + held_texts)
        # Rows that repeat a doc_id are learned together.
        .groupBy(F.col("lang").alias("its_lang"), F.col("doc_id").alias("its_id"))
        .agg(F.max("learn").alias("learn"))
    )
    # At most TEXTS_PER_LANGUAGE + held_texts short rows per language.
    rows = (
        usable.join(
            F.broadcast(chosen),
            (F.col("lang") == F.col("its_lang")) & F.col("doc_id").eqNullSafe(F.col("its_id")),
        )
        .select(
            "lang",
            "doc_id",
            F.when(F.col("learn"), F.col("text")).otherwise(F.substring("text", 1, HELD_CHARACTERS)).alias("text"),
            "learn",
        )
        .distinct()
        .collect()
    )
    # The most frequent language first: it wins ties.
    learned: dict[str, list[str]] = {language: [] for language in languages}
    held: dict[str, list[str]] = {language: [] for language in languages}
    for row in sorted(rows, key=lambda r: (r.lang, r.doc_id is None, r.doc_id, r.text)):
        (learned if row.learn else held)[row.lang].append(row.text)
    return learned, held


def _parted(texts: list[str]) -> tuple[list[str], list[str]]:
    """Four fifths of the learned texts of a language, and the others; of a single text, of its letters."""
    if len(texts) > 1:
        return [t for i, t in enumerate(texts) if i % 5], [t[:HELD_CHARACTERS] for t in texts[::5]]
    at = len(texts[0]) * 4 // 5
    return [texts[0][:at]], [texts[0][at:][:HELD_CHARACTERS]]


def break_cuts(learned: dict[str, list[str]], held: dict[str, list[str]]) -> dict[str, float]:
    """The highest break rate, less the allowance, that a text of each language may have."""
    cuts = {}
    for language, texts in learned.items():
        own, apart = texts, [t for t in held.get(language, ()) if _has_letter(t)]
        if not apart:
            own, apart = _parted(texts)
            apart = [t for t in apart if _has_letter(t)]
        if not apart:
            cuts[language] = 1.0
            continue
        phrases, length = LanguageModel({language: own}).measure(apart)
        rates = np.sort(_break_rate(phrases[:, 0], length) - _allowance(length))
        high = max(0.0, float(rates[math.ceil(HELD_QUANTILE * len(rates)) - 1]))
        # The highest of few texts is passed by the next one once in as many and one.
        margin = min(1.0, MARGIN + 0.5 / (len(rates) + 1))
        cuts[language] = high + margin * (1 - high)
    return cuts


def predict_languages(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per document: doc_id, lang_pred, score and break_rate.

    Learns from ``labelled`` (doc_id, text, lang); predicts from the text of ``docs`` alone.
    """
    ship_package(docs.sparkSession)
    learned = tuple((language, tuple(texts)) for language, texts in learned_texts(labelled).items())
    at_once = MOST_LANGUAGES

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(learned, at_once)
        for batch in slices(batches):
            found = model.predict(batch.column(1).to_pylist())
            languages, scores, rates, _ = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(languages, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rates, pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score", "break_rate"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {id_type}, lang_pred string, score double, break_rate double"
    )


def keep_identified(docs: DataFrame, labelled: DataFrame, into: str | None = None) -> DataFrame:
    """``docs`` without texts that are undetermined or in none of the learned languages.

    A text is in none of them if its break rate lies above the cut of the best one by more than its
    allowance. ``into`` names the column that gets the identified language of each text, one that
    ``docs`` has or a further one. All other columns and all other rows are kept as they are, in one pass.
    """
    ship_package(docs.sparkSession)
    texts, cuts = {}, {}
    for own, held in _drawn_texts(labelled, HELD_TEXTS):
        texts |= own
        cuts |= break_cuts(own, held)
    learned = tuple((language, tuple(own)) for language, own in texts.items())
    at_once = MOST_LANGUAGES
    at, names = docs.columns.index("text"), docs.columns
    schema = docs.schema
    if into is not None:
        found_in = StructField(into, StringType())
        fields = [found_in if f.name == into else f for f in schema]
        schema = StructType(fields if into in names else [*fields, found_in])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(learned, at_once)
        for batch in slices(batches):
            found = model.predict(batch.column(at).to_pylist())
            kept = pa.array([x != UNDETERMINED and r - _allowance(n) <= cuts[x] for x, _, r, n in found], pa.bool_())
            if into is not None:
                columns = dict(zip(names, batch.columns)) | {into: pa.array([x for x, *_ in found], pa.string())}
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield batch.filter(kept)

    return docs.mapInArrow(keep, schema)
