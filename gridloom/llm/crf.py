"""Quality classifier: a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own and its neighbours' features;
forward-backward marginals, weighted by the lines' lengths, make the document's
score.  It is trained on a bounded sample of labelled documents, whose lines all
carry the document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

#: Labelled documents of each class, and code points of one of them, that the fit may use.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 20_000
#: Text bytes of the sample whose features the driver computes at once.
SAMPLE_SLICE = 1 << 17
ROUNDS, RATE, RIDGE = 250, 0.08, 1e-3

_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def _bytes(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {
    "upper": _bytes(bytes(range(0x41, 0x5B))),
    "lower": _bytes(bytes(range(0x61, 0x7B))),
    "digit": _bytes(b"0123456789"),
    "symbol": _bytes(b"#*$%&<>@=~^_+\\/"),
    "pipe": _bytes(b"|"),
    "shout": _bytes(b"!"),
    "stop": _bytes(b".,;:?"),
    "bracket": _bytes(b"()[]{}\"'"),
    "other": _bytes(bytes(range(0x80, 0x100))),
}
FEATURES = (*_CLASSES, "log_length", "word_length", "repeats", "distinct", "seen_before", "ends_sentence", "starts_upper", "stop_words")
#: frequent function words of the languages, as hashes
_STOP_WORDS = "the of and to in is that for it was as with be on by are this from or an der die und das ist nicht ein eine zu den mit von sich des auf für im dem le la les de des un une et est dans que qui pour sur par el los las y en por con se del una para al".split()


def _hashes(words: list[str]) -> np.ndarray:
    raw, offsets = tx.utf8(pa.array(words, pa.string()))
    return np.unique(tx.words(raw, offsets).hash)


_STOP = _hashes(sorted(set(_STOP_WORDS)))


@dataclass
class Lines:
    """Lines with a word, row after row: features, lengths in bytes, rows' bounds."""

    x: np.ndarray
    length: np.ndarray
    bounds: np.ndarray


def line_features(array: pa.Array) -> Lines:
    raw, offsets = tx.utf8(array)
    rows = len(offsets) - 1
    lines = tx.words(raw, offsets, _NOT_NEWLINE)
    w = tx.words(raw, offsets)
    of = np.searchsorted(lines.start, w.start, "right") - 1
    worded = np.bincount(of, minlength=len(lines)) > 0
    keep = np.flatnonzero(worded)
    start, end, row, key = lines.start[keep], lines.end[keep], lines.row[keep], lines.hash[keep]
    n, length = len(keep), end - start
    of = (np.cumsum(worded) - 1)[of]
    n_words = np.maximum(np.bincount(of, minlength=n), 1)
    share = []
    for table in _CLASSES.values():
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        share.append((total[end] - total[start]) / np.maximum(length, 1))
    same = np.zeros(len(w), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
    mine = w.hash ^ tx.mix(of.astype(np.uint64), 5)
    new = np.zeros(len(w), bool)
    new[np.unique(mine, return_index=True)[1]] = True
    per = lambda values: np.bincount(of, weights=values, minlength=n) / n_words
    first = np.ones(n, bool)
    first[:] = False
    first[np.unique(key ^ tx.mix(row.astype(np.uint64), 6), return_index=True)[1]] = True
    lowered = tx.words(tx.LOWER[raw], offsets).hash
    stop = _STOP[np.minimum(np.searchsorted(_STOP, lowered), len(_STOP) - 1)] == lowered
    last = raw[end - 1] if n else raw[:0]
    x = np.column_stack(
        [*share, np.log1p(length), per((w.end - w.start).astype(float)), per(same), per(new), ~first, np.isin(last, list(b".!?")), _CLASSES["upper"][raw[start]] if n else np.zeros(0), per(stop)]
    ).astype(np.float64) if n else np.zeros((0, len(FEATURES)))
    return Lines(x, length, np.searchsorted(row, np.arange(rows + 1)))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own, previous and next line's features; beyond the text's ends they are 0."""
    x, n = lines.x, len(lines.x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    if n:
        before[1:], after[:-1] = x[:-1], x[1:]
        edges = lines.bounds[:-1][np.diff(lines.bounds) > 0]
        before[edges] = 0
        after[np.append(edges[1:], n) - 1] = 0
    return np.hstack([x, before, after])


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    #: log-potentials of neighbouring labels, [before, after]
    move: np.ndarray

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        node = np.column_stack([np.zeros(len(x)), ((x - self.mean) / self.scale) @ self.weight + self.bias])
        return _forward_backward(node, bounds, self.move)[0]


def _forward_backward(node: np.ndarray, bounds: np.ndarray, move: np.ndarray):
    """P(good) of each line, and the expected moves, of all texts side by side."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, n = bounds[:-1][order], n[order]
    alpha, beta = np.zeros_like(node), np.zeros_like(node)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest + 1), "left")  # texts with more lines than t
    counts = [int(c) for c in active]
    for t in range(longest):
        at = first[: counts[t]] + t
        if t:
            previous = alpha[at - 1]
            alpha[at] = node[at] + np.logaddexp(previous[:, :1] + move[0], previous[:, 1:] + move[1])
        else:
            alpha[at] = node[at]
    for t in range(longest - 2, -1, -1):
        at = first[: counts[t + 1]] + t
        ahead = beta[at + 1] + node[at + 1]
        beta[at] = np.column_stack([np.logaddexp(move[i, 0] + ahead[:, 0], move[i, 1] + ahead[:, 1]) for i in (0, 1)])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    starts = np.zeros(len(node), bool)
    starts[bounds[:-1][np.diff(bounds) > 0]] = True
    later = np.flatnonzero(~starts)
    moves = np.exp(alpha[later - 1][:, :, None] + move + (node + beta)[later][:, None, :] - total[later][:, None, None]).sum(0)
    return good, moves


def fit(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Field:
    """Penalised maximum likelihood by gradient steps with per-weight rates (Adam)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    y = np.repeat(labels, np.diff(bounds)).astype(float)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    theta = np.zeros(z.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    starts = np.zeros(len(y), bool)
    starts[bounds[:-1][np.diff(bounds) > 0]] = True
    later = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
    each = np.repeat(balance / np.maximum(np.diff(bounds), 1), np.diff(bounds))
    for step in range(1, ROUNDS + 1):
        node = np.column_stack([np.zeros(len(z)), z @ theta[:-5] + theta[-5]])
        good, moves = _forward_backward(node, bounds, theta[-4:].reshape(2, 2))
        miss = (y - good) * each
        gradient = np.concatenate([z.T @ miss, [miss.sum()], ((seen - moves) / max(len(later), 1) * len(labels)).ravel()]) / len(labels) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    """A field fitted on at most ``sample_docs`` documents of each quality that are not
    held out, have at most ``sample_chars`` code points, and come first by md5(doc_id).
    None if either class has no document."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    first = lambda q: usable.where(F.col("quality") == q).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample_docs)
    chosen = first(0).unionByName(first(1)).select("doc_id", "quality")
    near = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= sample_chars)
    sample = near.toArrow().to_pandas().drop_duplicates("doc_id").sort_values("doc_id")
    y = sample["quality"].to_numpy()
    texts = pa.record_batch({"text": pa.array(sample["text"], pa.string())})
    # small slices: a whole sample's scratch arrays would fill the driver
    parts = [line_features(part.column("text")) for part in tx.slices([texts], limit=SAMPLE_SLICE)]
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(p.bounds) for p in parts]])
    lines = Lines(np.concatenate([p.x for p in parts] or [np.zeros((0, len(FEATURES)))]), np.concatenate([p.length for p in parts] or [np.zeros(0, np.int64)]), np.cumsum(sizes))
    some = np.flatnonzero(np.diff(lines.bounds))
    if not {0, 1} <= set(y[some]):
        return None
    return fit(with_neighbours(lines), lines.bounds, y)


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with score: the length-weighted mean of its lines' P(good).

    A text without words (or null) scores 0; without a field every text with
    words scores 0.5.  A column named score is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for part in tx.slices(batches):
            lines = line_features(part.column("text"))
            good = shared.value.marginals(with_neighbours(lines), lines.bounds) if shared.value is not None else np.full(len(lines.x), 0.5)
            total = np.append(0, np.cumsum(good * lines.length))
            size = np.append(0, np.cumsum(lines.length))
            n = size[lines.bounds[1:]] - size[lines.bounds[:-1]]
            mean = (total[lines.bounds[1:]] - total[lines.bounds[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(mean, 0, 1), pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Labels are read only of documents whose crc32(doc_id as text) mod 3 is not
    1; documents with contradicting labels are left out of the fit.  A null
    doc_id is not held out.  Repeated rows get equal scores; an empty table
    stays empty; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs``, without the documents that score under 0.5.

    Null and empty texts score 0 and go; long texts are scored whole; repeated rows
    and rows of a null doc_id are judged one by one; an empty table stays empty;
    without labels of both kinds every text with words stays.  All other columns
    pass through, whatever their names.
    """
    held = "score" in docs.columns
    plain = docs.withColumnRenamed("score", "__own_score") if held else docs
    kept = score(plain, train(docs, labels)).where("score >= 0.5").drop("score")
    return (kept.withColumnRenamed("__own_score", "score") if held else kept).select(*docs.columns)
