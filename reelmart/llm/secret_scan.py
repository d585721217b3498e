"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

The patterns find assignments to names of secrets, access key ids and long hexadecimal strings. A
candidate is any run of twelve or more characters of the usual secret alphabet that holds a digit or
changes from lower to upper case. A small convolutional network in numpy reads each candidate with the
characters around it, long ones in windows; what it takes for a secret is added to the findings.

The network learns from all candidates of all texts, labelled by the patterns; equal ones are one row
that counts as often. Groups of about ``GROUP`` rows learn side by side from the same weights, each with
``MADE_FINDINGS`` made from well-known shapes of secrets and of harmless strings, so that the network
learns shapes that the patterns miss; the mean of their weights is where the next of ``ROUNDS`` begins.
Candidates of such a shape that no pattern finds teach nothing: they are not harmless.
A quarter is held out to calibrate the scores by a logistic fit, from counts of their scores in steps of
1 / ``STEPS``; the threshold is the highest step that keeps ``RECALL`` of the held-out secrets, and
``MOST_SCORE`` at most. Weights are added as whole numbers: neither files nor tasks change the network.

Defined results: NULL and empty texts have no findings; spans are code points, the end exclusive; a
span of the network never overlaps one of the patterns; repeated rows are scanned each for itself; a
NULL doc_id is kept; without any labelled text the made findings alone are learned from; other columns
are ignored by the scan and kept by ``redact``.
"""

from __future__ import annotations

import base64
import copy
import math
import re
import string
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmart.llm.batches import slices
from reelmart.scratch import measured
from reelmart.shipping import ship_package

# In the order in which findings that begin together are listed.
KINDS = ("assign", "access", "hex", "model")

_ALPHABET = "A-Za-z0-9+/_.=-"
_ASSIGN = re.compile(
    rf"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{_ALPHABET}]+)""", re.I | re.A
)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rf"[{_ALPHABET}]{{12,}}")
_TELLING = re.compile(r"[0-9]|[a-z][A-Z]")
# Well-known shapes of secrets, which candidates may have after a name, a path or a sign.
_KNOWN_SHAPE = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"xox[abeoprs]-[A-Za-z0-9-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}|AIza[\w-]{30,}|A(?:KI|SI)A[A-Z0-9]{16}|sk-[\w-]{20,}|"
    r"npm_[A-Za-z0-9]{30,}|ya29\.[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,})",
    re.A,
)
LEAST_ASSIGNED = 12

# Characters of a candidate that one window holds, and those shown on either side.
WINDOW = 48
CONTEXT = 16

# Rows that learn together, with so many made findings.
GROUP = 4_000
MADE_FINDINGS = 1_500
EPOCHS = 8
ROUNDS = 4
# One held out of so many.
HELD = 4
# Steps of a score, and the largest score told apart.
STEPS = 256
FARTHEST = 30
# What one of a weight is as a whole number.
_UNIT = 2**32
RECALL = 0.98
# Before anything is learned.
FIRST_SCORE = 0.5
MOST_SCORE = 0.9

# Known characters; 0 stands for beyond the text, the last class for all others.
_KNOWN = string.ascii_letters + string.digits + "+/_.=-:\"' \n@,;()[]{}<>#$%&*!?"
_CLASSES = len(_KNOWN) + 2


class Finding(NamedTuple):
    start: int
    kind: int
    end: int


def base_findings(text: str) -> list[Finding]:
    """What the patterns find, by start and kind."""
    found = []
    lowered = text.encode("utf-8", "replace").lower()
    if any(name in lowered for name in _NAMES):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                found.append(Finding(m.start(), 0, m.end()))
    if b"akia" in lowered:
        found += [Finding(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [Finding(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _TELLING.search(m.group())]


def windows(text: str, start: int, end: int) -> list[tuple[str, int, str]]:
    """A candidate in windows: what stands before, the offset of the window's end, the characters."""
    found = []
    for begin in range(start, end, WINDOW):
        stop = min(begin + WINDOW, end)
        before = text[max(0, begin - CONTEXT) : begin].rjust(CONTEXT, "\0")
        after = text[stop : stop + CONTEXT]
        found.append((before, stop - begin, text[begin:stop] + after))
    return found


def _encode(shown: list[tuple[str, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes per window, and 1 where the candidate itself stands."""
    width = WINDOW + 2 * CONTEXT
    joined = "".join((before + rest).ljust(width, "\0") for before, _, rest in shown)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).reshape(-1, width)
    table = np.full(128, _CLASSES - 1, np.int64)
    table[0] = 0
    for i, c in enumerate(_KNOWN):
        table[ord(c)] = i + 1
    classes = np.where(codes < 128, table[np.minimum(codes, 127)], _CLASSES - 1)
    length = np.array([n for _, n, _ in shown])
    place = np.arange(width) - CONTEXT
    return classes, ((place >= 0) & (place < length[:, None])).astype(np.float32)


class Network:
    """Embedding, one convolution, largest and mean response, one output."""

    EMBEDDED, WIDTH, FILTERS = 8, 5, 24

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        inputs = (self.EMBEDDED + 1) * self.WIDTH
        self.weights = {
            "embedding": draw.normal(0, 0.5, (_CLASSES, self.EMBEDDED)).astype(np.float32),
            "kernel": draw.normal(0, math.sqrt(2 / inputs), (inputs, self.FILTERS)).astype(np.float32),
            "shift": np.zeros(self.FILTERS, np.float32),
            "output": draw.normal(0, 0.2, 2 * self.FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, FIRST_SCORE

    def _forward(self, classes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        shown = np.concatenate([w["embedding"][classes], inside[:, :, None]], axis=2)
        steps = shown.shape[1] - self.WIDTH + 1
        patches = np.concatenate([shown[:, i : i + steps] for i in range(self.WIDTH)], axis=2)
        response = np.maximum(patches @ w["kernel"] + w["shift"], 0)
        largest = response.argmax(axis=1)
        pooled = np.concatenate([response.max(axis=1), response.mean(axis=1)], axis=1)
        return pooled @ w["output"] + w["bias"][0], (classes, patches, response, largest, pooled)

    def _gradients(self, error: np.ndarray, state: tuple) -> dict[str, np.ndarray]:
        w = self.weights
        classes, patches, response, largest, pooled = state
        n, steps, _ = response.shape
        to_pooled = error[:, None] * w["output"]
        to_response = np.repeat(to_pooled[:, None, self.FILTERS :] / steps, steps, axis=1)
        rows, filters = np.arange(n)[:, None], np.arange(self.FILTERS)[None]
        to_response[rows, largest, filters] += to_pooled[:, : self.FILTERS]
        to_response *= response > 0
        flat = to_response.reshape(-1, self.FILTERS)
        to_patches = to_response @ w["kernel"].T
        # What each place of a window passes back, over all filters that saw it.
        to_shown = np.zeros((n, classes.shape[1], self.EMBEDDED), np.float32)
        channels = self.EMBEDDED + 1
        for i in range(self.WIDTH):
            to_shown[:, i : i + steps] += to_patches[:, :, i * channels : i * channels + self.EMBEDDED]
        flat_classes = classes.ravel()
        to_embedding = np.stack(
            [
                np.bincount(flat_classes, to_shown[:, :, k].ravel(), minlength=_CLASSES)
                for k in range(self.EMBEDDED)
            ],
            axis=1,
        ).astype(np.float32)
        return {
            "embedding": to_embedding,
            "kernel": patches.reshape(-1, patches.shape[2]).T @ flat,
            "shift": flat.sum(axis=0),
            "output": error @ pooled,
            "bias": error.sum(keepdims=True),
        }

    def fit(self, classes: np.ndarray, inside: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Weights by Adam on three quarters; scale and threshold on the rest."""
        order = np.random.default_rng(11).permutation(len(labels))
        held, used = order[::HELD], np.delete(order, np.s_[::HELD])
        self.descend(classes[used], inside[used], labels[used], np.ones(len(used)), epochs)
        scores = self.scores(classes[held], inside[held])
        self._calibrate(scores, labels[held])

    def descend(
        self, classes: np.ndarray, inside: np.ndarray, labels: np.ndarray, counts: np.ndarray, epochs: int, seed: int = 11
    ) -> None:
        """Weights by Adam, each row as often as it counts."""
        draw = np.random.default_rng(seed)
        order = np.arange(len(labels))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        turn = 0
        for _ in range(epochs):
            draw.shuffle(order)
            for start in range(0, len(order), 64):
                part = order[start : start + 64]
                scores, state = self._forward(classes[part], inside[part])
                error = (1 / (1 + np.exp(-scores)) - labels[part]) * (counts[part] / counts[part].sum())
                turn += 1
                for k, g in self._gradients(error.astype(np.float32), state).items():
                    first, second = moments[k]
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    step = (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
                    self.weights[k] -= np.float32(0.005) * step

    def _calibrate(self, scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> None:
        """A logistic fit of the held-out labels on the scores, by gradient steps of Newton's method."""
        counts = np.ones(len(scores)) if counts is None else counts

        def loss(slope: float, offset: float) -> float:
            z = np.clip(slope * scores + offset, -30, 30)
            return float((counts * (np.log1p(np.exp(z)) - labels * z)).sum() + 5e-3 * (slope - 1) ** 2)

        slope, offset = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(slope * scores + offset, -30, 30)))
            rest, weight = counts * (p - labels), counts * np.maximum(p * (1 - p), 1e-6)
            gradient = np.array([(rest * scores).sum() + 1e-2 * (slope - 1), rest.sum()])
            cross = (weight * scores).sum()
            bend = np.array([[(weight * scores**2).sum() + 1e-2, cross], [cross, weight.sum() + 1e-2]])
            step = np.linalg.solve(bend, gradient)
            # A step that goes too far is halved.
            while np.abs(step).max() > 1e-6 and not loss(slope - step[0], offset - step[1]) <= loss(slope, offset):
                step = step / 2
            slope, offset = slope - step[0], offset - step[1]
            if not math.isfinite(slope) or slope <= 0:
                slope, offset = 1.0, 0.0
                break
        self.slope, self.offset = float(slope), float(offset)
        chances, shares = self.chances(scores[labels == 1]), counts[labels == 1]
        if len(chances):
            order = np.argsort(chances, kind="stable")
            passed = np.cumsum(shares[order])
            highest = float(chances[order[np.searchsorted(passed, (1 - RECALL) * passed[-1], side="right")]])
            self.threshold = min(highest, MOST_SCORE)

    def as_numbers(self) -> list[int]:
        """The weights one after the other, as whole numbers."""
        return [int(x) for v in self.weights.values() for x in np.rint(v.ravel().astype(np.float64) * _UNIT)]

    def take_numbers(self, numbers: list[float]) -> None:
        """Weights from numbers like those of ``as_numbers``."""
        flat, begin = np.array(numbers) / _UNIT, 0
        for k, v in self.weights.items():
            self.weights[k] = flat[begin : begin + v.size].reshape(v.shape).astype(np.float32)
            begin += v.size

    def scores(self, classes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        parts = [
            self._forward(classes[i : i + 512], inside[i : i + 512])[0] for i in range(0, len(classes), 512)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)

    def chances(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -30, 30)))


def made_findings(number: int, seed: int = 3) -> list[tuple[tuple[str, int, str], int]]:
    """Windows of made secrets (1) and harmless strings (0) in made surroundings."""
    draw = np.random.default_rng(seed)

    def run(alphabet: str, low: int, high: int) -> str:
        return "".join(draw.choice(list(alphabet), int(draw.integers(low, high + 1))))

    letters, digits, lower = string.ascii_letters, string.digits, string.ascii_lowercase
    both = letters + digits

    def word() -> str:
        return run(lower, 2, 9)

    secrets = [
        lambda: run(both, 24, 48),
        lambda: run(both + "+/", 38, 44) + "=",
        lambda: "ghp_" + run(both, 36, 36),
        lambda: "sk_live_" + run(both, 24, 32),
        lambda: "xoxb-" + run(digits, 11, 12) + "-" + run(both, 24, 24),
        lambda: "eyJ" + run(both + "_-", 20, 40) + "." + run(both + "_-", 30, 60),
        lambda: "AKIA" + run(string.ascii_uppercase + digits, 16, 16),
        lambda: "AIza" + run(both + "_-", 35, 35),
        lambda: run("0123456789abcdef", 32, 40),
        lambda: base64.b64encode(draw.bytes(int(draw.integers(18, 40)))).decode(),
    ]
    harmless = [
        lambda: run(digits, 12, 19),
        lambda: f"{word()}{run(digits, 1, 3)}.example.com",
        lambda: f"20{run(digits, 2, 2)}-{run(digits, 2, 2)}-{run(digits, 2, 2)}_{word()}",
        lambda: "/".join(word() for _ in range(4)) + f"/{run(digits, 1, 4)}",
        lambda: "-".join(word() for _ in range(4)) + f"-{run(digits, 1, 4)}",
        lambda: ".".join(run(digits, 1, 3) for _ in range(5)),
        lambda: "-".join(run(digits, 3, 4) for _ in range(4)),
        lambda: "".join(word().capitalize() for _ in range(4)),
        lambda: f"{word()}_{word()}_{word()}{run(digits, 1, 2)}",
        lambda: "=" * int(draw.integers(12, 30)) + run(digits, 1, 1),
        lambda: "+1-" + "-".join(run(digits, 3, 4) for _ in range(3)),
        lambda: f"v{run(digits, 1, 2)}.{run(digits, 1, 2)}.{run(digits, 1, 3)}-{word()}.tar.gz",
    ]
    before = ["", " ", "key = ", 'auth: "', "Bearer ", "credentials=", "\n", "at ", "see ", "(", "https://", "id "]
    found = []
    for i in range(number):
        label = i % 2
        makers = secrets if label else harmless
        shape = makers[int(draw.integers(len(makers)))]()
        lead = " ".join(word() for _ in range(3)) + before[int(draw.integers(len(before)))]
        if not lead.endswith((" ", '"', "=", "\n", "(", ":", "/")):
            lead += " "
        text = lead + shape + " " + " ".join(word() for _ in range(3))
        start = len(lead)
        found += [(w, label) for w in windows(text, start, start + len(shape))[:1]]
    return found


def _labelled(text: str) -> Iterator[tuple[str, int, str, int]]:
    """Windows of the candidates of a text with the label that the patterns give them.

    Candidates that are hexadecimal by their digits alone may be plain numbers and are left out, and so
    are those without a pattern that hold a known shape of a secret.
    """
    base = base_findings(text)
    for start, end in candidates(text):
        within = [f for f in base if f.start < end and f.end > start]
        if within and all(f.kind == 2 and text[f.start : f.end].isdigit() for f in within):
            continue
        if not within and _KNOWN_SHAPE.search(text[start:end]):
            continue
        for before, length, rest in windows(text, start, end)[:1]:
            yield before, length, rest, int(bool(within))


def labelled_windows(docs: DataFrame) -> DataFrame:
    """All windows that ``docs`` (text) teaches: before, length, rest, label, how often they stand there
    (n), and a hash (place)."""
    ship_package(docs.sparkSession)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [row for text in batch.column(0) for row in _labelled(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows)], names=["before", "length", "rest", "label"]
                )

    return (
        docs.where(F.length("text") >= LEAST_ASSIGNED)
        .select("text")
        .mapInArrow(label, "before string, length bigint, rest string, label bigint")
        .groupBy("before", "length", "rest", "label")
        .agg(F.count("*").alias("n"))
        .withColumn("place", F.xxhash64("before", "length", "rest"))
    )


def _shown(rows: pa.Table | pa.RecordBatch) -> list[tuple[str, int, str]]:
    return list(zip(*(rows.column(c).to_pylist() for c in ("before", "length", "rest"))))


def _next_weights(used: DataFrame, network: Network, made: list, turn: int) -> list[float]:
    """The mean of the weights that the groups learn, each from those of ``network``."""

    def learn(rows: pa.Table) -> pa.Table:
        # In an order that does not depend on the tasks before.
        rows = rows.sort_by([(c, "ascending") for c in ("before", "length", "rest", "label")])
        classes, inside = _encode(_shown(rows) + [w for w, _ in made])
        labels = np.array(rows.column("label").to_pylist() + [label for _, label in made], dtype=np.float32)
        counts = np.array(rows.column("n").to_pylist() + [1] * len(made), dtype=np.float64)
        own = copy.deepcopy(network)
        own.descend(classes, inside, labels, counts, EPOCHS // ROUNDS, seed=11 + turn)
        return pa.table({"weights": pa.array([own.as_numbers()], pa.list_(pa.int64()))})

    learned = used.groupBy("group").applyInArrow(learn, "weights array<bigint>")
    weights = learned.select(F.posexplode("weights").alias("at", "weight")).groupBy("at")
    sums = weights.agg(F.sum("weight").alias("weight"), F.count("*").alias("groups")).orderBy("at").collect()
    return [r.weight / r.groups for r in sums]


def _counted_scores(held: DataFrame, network: Network) -> DataFrame:
    """Of each step of a score and each label, how many windows have it."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            steps = np.floor(np.clip(network.scores(*_encode(_shown(batch))), -FARTHEST, FARTHEST) * STEPS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(steps.astype(np.int64)), batch.column("label"), batch.column("n")], names=["step", "label", "n"]
            )

    columns = held.select("before", "length", "rest", "label", "n")
    return columns.mapInArrow(score, "step bigint, label bigint, n bigint").groupBy("step", "label").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Network:
    """The network learned from all candidates of ``docs`` (doc_id, text)."""
    made = made_findings(MADE_FINDINGS)
    # Secrets and harmless ones take turns: one of so many is held out of a drawn order.
    made = [made[i] for i in np.random.default_rng(11).permutation(len(made))]
    classes, inside = _encode([w for w, _ in made])
    labels = np.array([label for _, label in made], dtype=np.float32)
    network = Network()
    network.fit(classes, inside, labels)
    windows, found = measured(labelled_windows(docs), rows=F.count("*"))
    if not found["rows"]:
        return network

    groups = -(-found["rows"] // GROUP)
    is_held = F.pmod("place", F.lit(HELD)) == 0
    group = F.pmod(F.shiftright("place", 16), F.lit(groups)).alias("group")
    used = windows.where(~is_held).select("before", "length", "rest", "label", "n", group).repartition(groups, "group")
    for turn in range(ROUNDS):
        weights = _next_weights(used, network, [x for i, x in enumerate(made) if i % HELD], turn)
        if weights:
            network.take_numbers(weights)

    # Made findings take the share that they have in every group.
    counted = sorted(map(tuple, _counted_scores(windows.where(is_held), network).collect()))
    steps, of, number = (np.array(c, dtype=np.float64) for c in zip(*counted)) if counted else [np.zeros(0)] * 3
    total = float(number.sum())
    share = max(1.0, total * (HELD / GROUP))
    own = network.scores(classes[::HELD], inside[::HELD])
    network._calibrate(
        np.concatenate([steps / STEPS, own]),
        np.concatenate([of, labels[::HELD]]),
        np.concatenate([number, np.full(len(own), share)]),
    )
    return network


def find_secrets(texts: list[str], network: Network) -> list[list[Finding]]:
    """All findings of each text, by start and kind."""
    found = [base_findings(t) for t in texts]
    shown, owners = [], []
    for i, text in enumerate(texts):
        base = found[i]
        for start, end in candidates(text):
            if not any(f.start < end and f.end > start for f in base):
                for window in windows(text, start, end):
                    shown.append(window)
                    owners.append((i, start, end))
    added = set()
    for begin in range(0, len(shown), 4096):
        part = shown[begin : begin + 4096]
        chances = network.chances(network.scores(*_encode(part)))
        added.update(owners[begin + k] for k in np.flatnonzero(chances >= network.threshold))
    for i, start, end in added:
        found[i].append(Finding(start, 3, end))
    return [sorted(f) for f in found]


def scan_secrets(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and findings, an array of (kind, start, end)."""
    ship_package(docs.sparkSession)
    network = network or train(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _scan(batches, network),
        f"doc_id {id_type}, findings array<struct<kind:string,start:int,end:int>>",
    )


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _as_array(found: list[list[Finding]]) -> pa.Array:
    return pa.array(
        [[{"kind": KINDS[f.kind], "start": f.start, "end": f.end} for f in own] for own in found], _FINDINGS
    )


def _scan(batches: Iterable[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.as_py() or "" for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _as_array(find_secrets(texts, network))], names=["doc_id", "findings"]
        )


def listed(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )


def redact(docs: DataFrame, network: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; findings that overlap become one mark.

    Texts without findings stay as they are, and so do all other columns.
    """
    ship_package(docs.sparkSession)
    network = network or train(docs)
    schema, at = docs.schema, docs.columns.index("text")

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            masked = [
                _masked(t, found, mark) if found else t
                for t, found in zip(texts, find_secrets([t or "" for t in texts], network))
            ]
            columns = list(batch.columns)
            columns[at] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, schema)


def _masked(text: str, found: list[Finding], mark: str) -> str:
    parts, done = [], 0
    for finding in found:
        if finding.start >= done:
            parts += [text[done : finding.start], mark]
        done = max(done, finding.end)
    return "".join(parts) + text[done:]
