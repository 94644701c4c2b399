"""Toxicity by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text. A token's features are
its word and the beginnings of the word, which hold for inflected forms that
the labels do not show. Labelled tokens come from the labelled documents: in a
toxic document the words with a feature that marks toxic documents
significantly are toxic tokens, every other token is clean. The field is fitted
on a bounded sample of labelled documents. Forward-backward gives every token's
marginal; a document's score is a calibrated function of the marginals, and runs
of likely toxic tokens are its offending spans. The calibration is fitted on
marginals of fields that have not seen the document or its near copies.

The chains of all texts of a batch are one chain that starts afresh at each
text. It is cut into blocks whose 2x2 matrix products are formed side by side,
so that forward-backward is exact and vectorised for texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.shingles import letter_codes, mixed, slices, text_bytes, word_spans
from meshwork.runtime import ship

#: Labelled documents, and bytes of their texts, that are used for fitting, at most, and the features that the field knows.
FIT_DOCS, FIT_BYTES, VOCABULARY = 2500, 24_000_000, 30_000
#: Parts of the labelled documents for the calibration.
CALIBRATION_FOLDS = 2
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Rounds of fitting, and the strength of the penalty on word weights.
ROUNDS, PENALTY = 30, 1e-4
#: From this marginal on, a token belongs to an offending span.
SPAN_FROM = 0.5

BLOCK = 64
_between = np.ones(256, bool)
_between[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Field:
    """Weights of the field and of the calibration."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of known features
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))  # the last two: of every token, and nothing
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log potentials, from row to column
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))


def token_features(data: np.ndarray, bounds: np.ndarray):
    """Hashes (features, tokens), first token of each text, first byte and length of each token; 0 where a word is too short."""
    hashes, first, at, sizes = word_spans(data, bounds, _between)
    rows = [hashes]
    for n in BEGINNINGS:
        part = np.zeros(len(hashes), np.uint64)
        long = np.flatnonzero(sizes >= n)
        sums = np.full(len(long), n, np.uint64)
        for j in range(n):
            sums = mixed(sums + letter_codes[data[at[long] + j]])
        part[long] = sums
        rows.append(part)
    return np.stack(rows), first, at, sizes


def feature_index(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the features of each token among the known ones, and of what every token has; one past for unknown ones."""
    places = np.full((len(hashes) + 1, hashes.shape[1]), len(words) + 1, np.int32)
    places[-1] = len(words)
    if len(words):
        for row, place in zip(hashes, places):
            at = np.minimum(np.searchsorted(words, row), len(words) - 1)
            place[:] = np.where(words[at] == row, at, len(words) + 1)
    return places


def _carried(first: np.ndarray, products: np.ndarray) -> np.ndarray:
    """State before each block, from the state before all and the blocks' products (both normalised)."""
    out = np.empty((len(products), 2))
    a, b = first
    for i, ((p, q), (r, s)) in enumerate(products.tolist()):
        out[i] = a, b
        a, b = a * p + b * r, a * q + b * s
        t = a + b
        a, b = a / t, b / t
    return out


def marginals(emission: np.ndarray, starts: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Forward and backward states (n, 2), each normalised, of the chain of all texts.

    ``emission``: log odds of the toxic state at each token; ``starts``: whether
    a text begins there.
    """
    n = len(emission)
    blocks = -(-n // BLOCK)
    size = blocks * BLOCK
    # potentials of each step: m[i, j] = move(i, j) * word(j); at a text's start all rows are the start potentials
    odds = np.ones(size)
    odds[:n] = np.exp(np.clip(emission, -30, 30))
    fresh = np.zeros(size, bool)
    fresh[:n] = starts
    fresh[n:] = True
    a, s = np.exp(moves), np.exp(start)
    m = [[np.where(fresh, s[j], a[i, j]) * (odds if j else 1.0) for j in range(2)] for i in range(2)]
    m = [[x.reshape(blocks, BLOCK).T.copy() for x in row] for row in m]  # m[i][j][step, block]

    def product(order):
        p = np.tile(np.eye(2), (blocks, 1, 1))
        for t in order:
            step = np.stack([np.stack([m[0][0][t], m[0][1][t]], -1), np.stack([m[1][0][t], m[1][1][t]], -1)], -2)
            p = p @ step
            p /= p.sum(axis=(1, 2), keepdims=True)
        return p

    p = product(range(BLOCK))
    ahead = _carried(np.array([0.5, 0.5]), p)
    behind = _carried(np.array([0.5, 0.5]), p.transpose(0, 2, 1)[::-1])[::-1]
    forward, backward = np.empty((2, BLOCK, blocks)), np.empty((2, BLOCK, blocks))
    x, y = ahead[:, 0], ahead[:, 1]
    for t in range(BLOCK):
        x, y = x * m[0][0][t] + y * m[1][0][t], x * m[0][1][t] + y * m[1][1][t]
        total = x + y
        x, y = x / total, y / total
        forward[0, t], forward[1, t] = x, y
    x, y = behind[:, 0], behind[:, 1]
    for t in reversed(range(BLOCK)):
        backward[0, t], backward[1, t] = x, y
        x, y = m[0][0][t] * x + m[0][1][t] * y, m[1][0][t] * x + m[1][1][t] * y
        total = x + y
        x, y = x / total, y / total
    flat = lambda z: z.transpose(2, 1, 0).reshape(size, 2)[:n]
    return flat(forward), flat(backward)


def toxic_marginals(model: Field, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marginal of the toxic state at each token."""
    n = hashes.shape[1]
    if not n:
        return np.zeros(0)
    starts = np.zeros(n, bool)
    begin = first[:-1]
    starts[begin[begin < n]] = True
    emission = model.weights[feature_index(model.words, hashes)].sum(axis=0)
    f, b = marginals(emission, starts, model.moves, model.start)
    both = f * b
    return both[:, 1] / both.sum(axis=1)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(1, largest marginal, log of 1 + expected toxic tokens) of each text; 0 for texts without words."""
    n = len(first) - 1
    out = np.zeros((n, 3))
    out[:, 0] = 1.0
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full, 1] = np.maximum.reduceat(p, first[full])
        out[full, 2] = np.log1p(np.add.reduceat(np.where(p > 0.1, p, 0.0), first[full]))
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def copy_groups(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each document; those with the same least three-word window, as near copies have, share it."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), np.diff(first))
    least = np.arange(n).astype(np.uint64)
    if len(words) > 2:
        three = mixed(words[:-2] + mixed(words[1:-1] + mixed(words[2:])))
        three[own[:-2] != own[2:]] = np.uint64(2**64 - 1)
        long = np.flatnonzero(np.diff(first) > 2)
        stops = np.stack([first[long], first[long + 1] - 2], 1).ravel()
        least[long] = np.minimum.reduceat(np.append(three, np.uint64(2**64 - 1)), stops)[::2]
    return np.unique(least, return_inverse=True)[1]


def token_labels(hashes: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known features, toxic-token flags) of labelled documents.

    A feature marks toxic documents when the lower end of the interval
    (z = 2.58) for the share of toxic documents among those that hold it is
    over one half; near copies count as one document. Known features are those,
    then the most frequent.
    """
    own = np.repeat(np.arange(len(toxic)), np.diff(first))
    group = copy_groups(hashes[0], first)
    share_toxic = np.bincount(group, weights=toxic) / np.bincount(group)
    doc = group[own]
    flags = np.zeros(len(doc), bool)
    kinds = []
    z2 = 2.58**2
    for row in hashes:
        order = np.lexsort((doc, row))
        h, d = row[order], doc[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        once &= h != 0
        if not once.any():
            continue
        words, of, n = np.unique(h[once], return_inverse=True, return_counts=True)
        k = np.bincount(of, weights=share_toxic[d[once]], minlength=len(words))
        share = k / n
        lower = (share + z2 / (2 * n) - np.sqrt(z2 * (share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
        marks = lower > 0.5
        kinds.append((words, n, marks))
        at = np.minimum(np.searchsorted(words, row), len(words) - 1)
        flags |= marks[at] & (words[at] == row)
    words, n, marks = (np.concatenate(x) for x in zip(*kinds))
    rank = np.lexsort((words, -n, ~marks))[:VOCABULARY]
    return np.unique(words[rank[(n[rank] > 1) | marks[rank]]]), flags & (toxic[own] == 1)


def fit(texts: list[str | None], toxic: list[int]) -> Field:
    """The field and its calibration, from labelled whole texts."""
    y = np.array(toxic, dtype=np.float64)
    hashes, first, _, _ = token_features(*text_bytes(pa.array(texts, pa.large_string())))
    if not hashes.shape[1] or y.min(initial=1) == y.max(initial=0):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Field(calibration=np.array([np.log(rate / (1 - rate)), 0.0, 0.0]))
    fold = mixed(copy_groups(hashes[0], first).astype(np.uint64)) % np.uint64(CALIBRATION_FOLDS)
    x = np.zeros((len(y), 3))
    for k in range(CALIBRATION_FOLDS):
        unseen = fold == k
        if not unseen.any():
            continue
        part = fit_field(*_documents(hashes, first, ~unseen), y[~unseen])
        h, f = _documents(hashes, first, unseen)
        x[unseen] = document_features(toxic_marginals(part, h, f), f)
    model = fit_field(hashes, first, y)
    model.calibration = logistic(x, y)
    return model


def _documents(hashes: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features and first tokens of the chosen documents."""
    sizes = np.diff(first)
    return hashes[:, np.repeat(chosen, sizes)], np.append(0, np.cumsum(sizes[chosen]))


def fit_field(hashes: np.ndarray, first: np.ndarray, y: np.ndarray) -> Field:
    """The field by gradient ascent on the labelled tokens' likelihood, without a calibration."""
    model, n = Field(), hashes.shape[1]
    if not n or y.min(initial=1) == y.max(initial=0):
        return model
    model.words, labels = token_labels(hashes, first, y)
    z = labels.astype(np.int64)
    index = feature_index(model.words, hashes)
    starts = np.zeros(n, bool)
    begin = first[:-1]
    starts[begin[begin < n]] = True
    inside = np.flatnonzero(~starts)
    size = len(model.words) + 2
    total = lambda x: sum(np.bincount(row, weights=x, minlength=size) for row in index)
    seen_words = total(z)
    seen_moves = np.bincount(2 * z[inside - 1] + z[inside], minlength=4).reshape(2, 2)
    seen_start = np.bincount(z[starts], minlength=2)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, moves, start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        emission = weights[index].sum(axis=0)
        f, b = marginals(emission, starts, moves, start)
        both = f * b
        p = both[:, 1] / both.sum(axis=1)
        odds = np.exp(np.clip(emission[inside], -30, 30))
        pair = np.stack([f[inside - 1, i] * np.exp(moves[i, j]) * (odds if j else 1.0) * b[inside, j] for i in range(2) for j in range(2)])
        pair /= pair.sum(axis=0)
        gradient = np.concatenate([seen_words - total(p), (seen_moves.ravel() - pair.sum(axis=1)), seen_start - np.array([(1 - p[starts]).sum(), p[starts].sum()])])
        gradient = gradient / len(y) - PENALTY * theta
        gradient[size - 1] = 0.0  # unknown features weigh nothing
        m, v = 0.8 * m + 0.2 * gradient, 0.95 * v + 0.05 * gradient**2
        theta = theta + 0.35 * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-9)
    model.weights, model.moves, model.start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
    return model


def _spans(p: np.ndarray, data: np.ndarray, bounds: np.ndarray, first: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each text the runs of tokens that are likely toxic, in characters of the text; linear in the text."""
    rows = len(bounds) - 1
    hot = np.flatnonzero(p >= SPAN_FROM)
    doc = np.searchsorted(first, hot, side="right") - 1
    new = np.ones(len(hot), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hot[1:] != hot[:-1] + 1)
    begin = np.flatnonzero(new)
    if not len(hot):
        start = end = top = np.zeros(0)
    else:
        last = np.append(begin[1:], len(hot)) - 1
        chars = np.append(0, np.cumsum(data & 0xC0 != 0x80))  # characters that begin before each byte
        base = chars[bounds[doc[begin]]]
        start, end = chars[at[hot[begin]]] - base, chars[at[hot[last]] + sizes[hot[last]]] - base
        top = np.maximum.reduceat(p[hot], begin)
    cells = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(top.astype(np.float64))], names=["start", "end", "p"])
    counts = np.bincount(doc[begin], minlength=rows) if len(hot) else np.zeros(rows, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), cells)


def _score(model: Field, batches):
    for batch in batches:
        for start, rows in slices(batch.column("text")):
            texts = batch.column("text").slice(start, rows)
            data, bounds = text_bytes(texts)
            hashes, first, at, sizes = token_features(data, bounds)
            p = toxic_marginals(model, hashes, first)
            score = _sigmoid(document_features(p, first) @ model.calibration)
            found = _spans(p, data, bounds, first, at, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, rows), pa.array(score), found], names=["id", "score", "spans"])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """(y, text) of at most ``limit`` labelled rows outside the held-out quarter with ``size`` bytes at most, by a hash of the id."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    # the ids are bounded by the limit, so they reach every scan task and the texts stay where they are
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes"))
    wanted, total = [], 0
    for r in rows.select("id", "bytes").join(F.broadcast(chosen), "id").select("id", "y", "bytes").distinct().orderBy(F.xxhash64("id"), "id", "bytes").limit(limit).collect():
        if total + r["bytes"] <= size:
            wanted.append((r["id"], r["y"], r["bytes"]))
            total += r["bytes"]
    if not wanted:
        return []
    taken = docs.sparkSession.createDataFrame(wanted, f"id {docs.schema[id_col].dataType.simpleString()}, y int, bytes int")
    # rows that repeat an id and a length: the first text
    return rows.join(F.broadcast(taken), ["id", "bytes"]).groupBy("id", "y", "bytes").agg(F.min("text").alias("text")).orderBy("id", "bytes").select("y", "text").collect()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted, spans (start, end in characters; p).

    Only labels outside the held-out quarter of the ids are learned from, from
    FIT_DOCS documents of FIT_BYTES at most (a longer text is passed over, never
    cut); only the text is an input of a score. Null and empty texts score like
    a text without toxic words. Without labels of both kinds every text gets the
    rate. Repeated rows get the same score; an empty table gives an empty result;
    further columns are ignored. Texts of any length are scored whole, in time
    linear in their length.
    """
    ship(docs.sparkSession)
    rows = sample(docs, labels, "toxic", FIT_DOCS, FIT_BYTES, id_col, text_col)
    model = fit([r["text"] for r in rows], [r["y"] for r in rows])
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: _score(model, batches), f"id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
