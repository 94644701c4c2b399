"""Quality classifier by co-training two views.

One classifier sees a document's content (shape of the text and hashed words),
the other its page metadata (source, language, length on record and how it
compares with the text). Over several rounds each scores every document without
a label, and all verdicts of which it is sure become training rows of the other.
Sure is a verdict that moves the odds of a good document, by the view's
calibrated probability, at least SURE_ODDS-fold from what they are among the
labels, so a view that knows nothing hands over nothing. The verdicts of a class
weigh PSEUDO_SHARE of the labelled rows of that class together, however many
they are.

Both views are calibrated by themselves on labelled documents that neither was
fitted on. The calibrated views are combined by adding what each says beyond the
rate: views that are independent given the class, as co-training asks for.

The features of all documents are computed once, a few hundred bytes each;
documents with equal features, as copies have, are one candidate. The pseudo-
labelled rows stay where they are: a step of the fit adds up gradients and
curvatures over them, a few thousand numbers a task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.shingles import mixed, slices, text_bytes, word_spans
from meshwork.llm.toxicity import _sigmoid
from meshwork.runtime import materialise, ship

#: Labelled documents used, at most; every third of them only calibrates.
FIT_DOCS, CALIBRATE_EVERY = 4000, 3
#: Rounds of exchange, and the steps of a fit within them.
ROUNDS, STEPS = 3, 4
#: How far a verdict must move the odds to be handed over, and what those of a class weigh in all, as a share of its labelled rows.
SURE_ODDS, PSEUDO_SHARE = 9.0, 0.5
RIDGE = 1.0
#: Standard errors that a calibrated view's slope must have, for the view to count at all.
SLOPE_ERRORS = 2.5

SHAPES, HASHED = 14, 50
CONTENT = 1 + SHAPES + HASHED
SOURCES, LANGS, PAIRS, LENGTHS = 24, 6, 32, 12
META = 1 + SOURCES + LANGS + PAIRS + LENGTHS + 4
WIDTHS = {"content": CONTENT, "meta": META}

_CLASSES = {"sign": b"#*$%&|<>", "bang": b"!", "upper": bytes(range(0x41, 0x5B)), "digit": bytes(range(0x30, 0x3A)), "bar": b"|", "line": b"\n", "stop": b".,;:?"}
_tables = np.zeros((len(_CLASSES), 256), bool)
for _i, _chars in enumerate(_CLASSES.values()):
    _tables[_i, list(_chars)] = True


def content_features(texts: pa.Array) -> np.ndarray:
    """(1, shapes, hashed words) of each text; zeros but for the constant where there is none."""
    data, bounds = text_bytes(texts)
    hashes, first, _, sizes = word_spans(data, bounds)
    n = len(bounds) - 1
    out = np.zeros((n, CONTENT), np.float32)
    out[:, 0] = 1.0
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    size = np.maximum(np.diff(bounds), 1)
    words = np.diff(first)
    for i, table in enumerate(_tables):
        out[:, 1 + i] = np.diff(np.append(0, np.cumsum(table[data]))[bounds]) / size
    at = 1 + len(_tables)
    out[full, at] = np.log1p(words[full]) / 10
    out[full, at + 1] = np.add.reduceat(sizes, first[full]) / words[full] / 10
    doc = np.repeat(np.arange(n), words)
    # repeats: distinct words and distinct three-word windows over all of them
    out[full, at + 2] = _distinct(hashes, doc, n)[full] / words[full]
    if len(hashes) > 2:
        three = mixed(hashes[:-2] + mixed(hashes[1:-1] + mixed(hashes[2:])))
        whole = doc[:-2] == doc[2:]
        got = np.bincount(doc[:-2][whole], minlength=n)
        out[:, at + 3] = np.where(got > 0, _distinct(three[whole], doc[:-2][whole], n) / np.maximum(got, 1), words > 0)
    out[full, at + 4] = (np.add.reduceat((sizes <= 2).astype(np.int64), first[full])) / words[full]
    out[full, at + 5] = np.maximum.reduceat(sizes, first[full]).clip(0, 100) / 100
    out[full, at + 6] = (words[full] < 50).astype(np.float32)
    place = doc * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)
    counts = np.bincount(place, minlength=n * HASHED).reshape(n, HASHED)
    out[:, 1 + SHAPES :] = np.sqrt(counts / np.maximum(words, 1)[:, None])
    return out


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each document has."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _slots(column: pa.Array, slots: int) -> np.ndarray:
    """A slot for each value, null in one of its own."""
    coded = column.dictionary_encode()
    slot = np.array([zlib.crc32(b"=" + v.encode()) % slots for v in coded.dictionary.to_pylist()] + [zlib.crc32(b"null") % slots])
    return slot[np.asarray(pc.fill_null(coded.indices, len(slot) - 1)).astype(np.int64)]


def meta_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array, counted: np.ndarray) -> np.ndarray:
    """(1, source, language, both, recorded length and whether it is that of the text); unknown values are values of their own."""
    n = len(source)
    out = np.zeros((n, META), np.float32)
    rows = np.arange(n)
    out[:, 0] = 1.0
    out[rows, 1 + _slots(source, SOURCES)] = 1.0
    out[rows, 1 + SOURCES + _slots(lang, LANGS)] = 1.0
    both = pc.binary_join_element_wise(pc.fill_null(source, "\x00"), pc.fill_null(lang, "\x00"), "\x01")
    out[rows, 1 + SOURCES + LANGS + _slots(both, PAIRS)] = 1.0
    known = np.asarray(pc.fill_null(n_chars.cast(pa.float64(), safe=False), -1.0))
    chars = np.maximum(known, 0.0)
    out[rows, 1 + SOURCES + LANGS + PAIRS + np.minimum(np.log2(chars + 1).astype(np.int64) * 2 // 3, LENGTHS - 1)] = 1.0
    ratio = np.log((counted + 1) / (chars + 1)).clip(-3, 3)
    out[:, -4], out[:, -3], out[:, -2], out[:, -1] = np.log1p(chars) / 10, known < 0, np.where(known < 0, 0, ratio), np.where(known < 0, 0, chars != counted)
    return out


def _featured(batches):
    for batch in batches:
        for start, rows in slices(batch.column("text")):
            part = batch.slice(start, rows)
            x = content_features(part.column("text")).astype("<f2")
            counted = np.asarray(pc.fill_null(pc.utf8_length(part.column("text")), 0)).astype(np.float64)
            z = meta_features(part.column("source"), part.column("lang"), part.column("n_chars"), counted).astype("<f2")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], names=["id", "content", "meta"])


def _matrix(cells, view: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f2").reshape(-1, WIDTHS[view]).astype(np.float64)


class View:
    """One classifier: its weights, and the line that makes its log odds calibrated ones."""

    def __init__(self, name: str, x: np.ndarray, y: np.ndarray, aside: np.ndarray):
        self.name, self.x, self.y, self.aside = name, x, y, aside
        self.weights, self.line = np.zeros(WIDTHS[name]), np.array([0.0, 1.0])

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log likelihood of some rows at the present weights."""
        p = _sigmoid(x @ self.weights)
        return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """A Newton step on the labelled rows and what other rows add; the largest change."""
        own = self.sums(self.x[~self.aside], self.y[~self.aside], np.ones((~self.aside).sum()))
        penalty = np.full(len(self.weights), RIDGE)
        penalty[0] = 1e-6
        change = np.clip(np.linalg.solve(own[1] + curvature + np.diag(penalty), own[0] + gradient - penalty * self.weights), -5, 5)
        self.weights = self.weights + change
        return float(np.abs(change).max())

    def calibrate(self) -> None:
        """Platt scaling on the rows set aside, with a ridge towards the constant.

        The line is the constant where the slope is not clearly positive.
        """
        held = self.aside if self.aside.any() else np.ones(len(self.y), bool)
        odds, y = self.odds(self.x[held]), self.y[held]
        x = np.column_stack([np.ones(len(y)), odds])
        rate = (y.sum() + 0.5) / (len(y) + 1)
        line, penalty = np.array([np.log(rate / (1 - rate)), 0.0]), np.diag([1e-6, 1.0])
        for _ in range(50):
            p = _sigmoid(x @ line)
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
            change = np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty @ (line - [line[0], 0.0])), -2, 2)
            line = line + change
            if np.abs(change).max() < 1e-9:
                break
        # a view whose slope could be chance says nothing but the rate
        if line[1] < SLOPE_ERRORS * np.sqrt(np.linalg.inv(h)[1, 1]):
            line = np.array([np.log(rate / (1 - rate)), 0.0])
        self.line = line

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights, -12, 12)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of a good document."""
        return self.line[0] + self.line[1] * self.odds(x)

    def plain(self) -> "View":
        """Without the labelled rows: what the tasks need."""
        out = View(self.name, np.zeros((0, WIDTHS[self.name])), np.zeros(0), np.zeros(0, bool))
        out.weights, out.line = self.weights, self.line
        return out


def _scored(views: list[View], batches):
    for batch in batches:
        odds = [v.calibrated(_matrix(batch.column(v.name).to_pylist(), v.name)) for v in views]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], *[pa.array(x) for x in odds]], names=[*batch.schema.names, "odds_content", "odds_meta"])


def _verdict(odds, rate: float):
    """1 and 0 for what is surely good and bad, null for the rest."""
    beyond = odds - F.lit(float(rate))
    return F.when(beyond >= float(np.log(SURE_ODDS)), 1).when(beyond <= -float(np.log(SURE_ODDS)), 0)


def _added(views: list[View], weigh: dict, batches):
    """(view, slot, value): the sums of ``View.sums`` over this task's pseudo-labelled rows, for each taker."""
    total = {v.name: [np.zeros(len(v.weights)), np.zeros((len(v.weights),) * 2)] for v in views}
    for batch in batches:
        for v in views:
            y = np.asarray(pc.fill_null(batch.column(f"for_{v.name}"), -1)).astype(np.int64)
            rows = np.flatnonzero(y >= 0)
            if len(rows):
                weight = np.array([weigh[v.name, 0], weigh[v.name, 1]])[y[rows]]
                g, h = v.sums(_matrix(batch.column(v.name).take(pa.array(rows)).to_pylist(), v.name), y[rows].astype(np.float64), weight)
                total[v.name][0] += g
                total[v.name][1] += h
    for name, (g, h) in total.items():
        flat = np.concatenate([g, h[np.triu_indices(len(g))]])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["view", "slot", "value"])


def _pseudo_sums(sure: DataFrame, views: list[View], weigh: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of all pseudo-labelled rows for each view; summed as decimals, in any order alike."""
    plain = [v.plain() for v in views]
    parts = sure.mapInArrow(lambda batches: _added(plain, weigh, batches), "view string, slot int, value double")
    sums = parts.groupBy("view", "slot").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value")).collect()
    out = {}
    for v in views:
        n = len(v.weights)
        flat = np.zeros(n + n * (n + 1) // 2)
        for r in sums:
            if r["view"] == v.name:
                flat[r["slot"]] = r["value"]
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = flat[n:]
        out[v.name] = flat[:n], h + np.triu(h, 1).T
    return out


def co_train(features: DataFrame, known: DataFrame, x: dict[str, np.ndarray], y: np.ndarray, rounds: int = ROUNDS, report: list | None = None) -> list[View]:
    """Both views, fitted on the labelled rows (x by view, y) and on what they hand each other over ``features``.

    ``known`` (id) are the labelled ids. ``report`` gets a dict a round: the
    candidates, the verdicts handed over by giver and class, and the views.
    """
    aside = np.arange(len(y)) % CALIBRATE_EVERY == 0
    if not len(y[aside]) or y[aside].min() == y[aside].max() or y[~aside].min(initial=1) == y[~aside].max(initial=0):
        aside = np.zeros(len(y), bool)
    views = [View(name, x[name], y, aside) for name in WIDTHS]
    for v in views:
        while v.step(np.zeros(len(v.weights)), np.zeros((len(v.weights),) * 2)) > 1e-6:
            pass
        v.calibrate()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    rate = float(np.log(rate / (1 - rate)))
    free = features.join(known, "id", "left_anti").select("content", "meta").distinct()
    candidates = materialise(free, "candidates")
    schema = "content binary, meta binary, odds_content double, odds_meta double"
    for number in range(rounds):
        plain = [v.plain() for v in views]
        scored = candidates.mapInArrow(lambda batches, w=plain: _scored(w, batches), schema)
        # what one view is sure of is for the other
        marked = scored.select("content", "meta", _verdict(F.col("odds_content"), rate).alias("for_meta"), _verdict(F.col("odds_meta"), rate).alias("for_content"))
        sure = materialise(marked.where("for_meta IS NOT NULL OR for_content IS NOT NULL"), "sure")
        counts = sure.agg(*[F.count_if(F.col(f"for_{v}") == c).alias(f"{v}{c}") for v in WIDTHS for c in (0, 1)]).first()
        if report is not None:
            report.append({"round": number, "handed": {(g, c): counts[f"{t}{c}"] for g, t in (("content", "meta"), ("meta", "content")) for c in (0, 1)}, "views": plain})
        if not sum(counts):
            break
        weigh = {(v, c): PSEUDO_SHARE * float((y == c).sum()) / max(counts[f"{v}{c}"], 1) for v in WIDTHS for c in (0, 1)}
        for _ in range(STEPS):
            added = _pseudo_sums(sure, views, weigh)
            if max([v.step(*added[v.name]) for v in views]) < 1e-4:
                break
        for v in views:
            v.calibrate()
    if report is not None:
        report.append({"round": rounds, "handed": {}, "views": [v.plain() for v in views], "rate": rate})
    return views


def combined(odds_content, odds_meta, rate: float):
    """Log odds of both calibrated views together: the rate's, and what each view says beyond it."""
    return odds_content + odds_meta - rate


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5, report: list | None = None
) -> DataFrame:
    """One row per document: id, p_content, p_meta (each calibrated), score, kept.

    At most FIT_DOCS labelled documents are fitted on; every document without a
    label is a candidate in every round, and every sure verdict is handed over.
    Nulls in any column are values of their own; empty texts are scored from the
    constant and the metadata. Where the labelled documents are all good or all
    bad, or none, there is nothing to tell apart and every score is the rate.
    Repeated rows get the same scores, ties in the order of a hash of the id; an
    empty table gives an empty result; further columns are ignored. A text of
    any length is read whole, in a batch alone.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(chars_col).cast("long").alias("n_chars"))
    features = materialise(rows.mapInArrow(_featured, f"id {kind}, content binary, meta binary"), "features")
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(FIT_DOCS)
    got = features.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "content").limit(FIT_DOCS).collect()
    y = np.array([r["y"] for r in got], np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return features.select(F.col("id").alias(id_col), *[F.lit(float(rate)).alias(c) for c in ("p_content", "p_meta", "score")], F.lit(bool(rate >= threshold)).alias("kept"))
    views = [v.plain() for v in co_train(features, known.select("id"), {v: _matrix([r[v] for r in got], v) for v in WIDTHS}, y, report=report)]
    final = features.mapInArrow(lambda batches: _scored(views, batches), f"id {kind}, content binary, meta binary, odds_content double, odds_meta double")
    p = lambda odds: F.round(1 / (1 + F.exp(-odds)), 9)
    both = combined(F.col("odds_content"), F.col("odds_meta"), float(np.log(rate / (1 - rate))))
    return final.select(F.col("id").alias(id_col), p(F.col("odds_content")).alias("p_content"), p(F.col("odds_meta")).alias("p_meta"), p(both).alias("score")).withColumn("kept", F.col("score") >= threshold)
