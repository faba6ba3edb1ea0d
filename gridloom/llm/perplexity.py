"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The model is over the bytes of the texts, five at a time, one for each language, so
every script is modelled as it is.  Spark counts the 5-grams of all documents, and
groupings of that table give every discount, continuation count and back-off weight.
The model grows with the corpus.  For scoring it is cut by the byte before the
predicted one: such a part holds all that a prediction and its back-off need.  Parts
are gathered into blocks of bounded size, stored as sorted arrays of gram codes, and
documents pass the blocks one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .common import small, stored

ORDER = 5
SYMBOL_BITS = 8
SYMBOLS = 1 << SYMBOL_BITS
#: Model entries broadcast at once (12 bytes each); a larger model takes several passes.
BLOCK_ENTRIES = 2_000_000
#: Perplexity bands: medians of a language's log-perplexity, minus and plus so many median
#: absolute deviations of the documents on that side, and at least so many nats.
BAND_MADS, BAND_NATS = (10.0, 10.0), (0.5, 1.0)
#: Resolution of the distributions that give the bands, in nats.
BIN = 0.01

_SYMBOL_CHARACTER = np.zeros(256, bool)
_SYMBOL_CHARACTER[list(b"#*$%&|<>")] = True
_LEXICAL = tx.LOWER_ALNUM[tx.LOWER]
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def gram_codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of the 5-gram that ends there; texts start after line ends."""
    symbol = raw.astype(np.int64)
    code = symbol.copy()
    first = offsets[:-1][np.diff(offsets) > 0]
    for back in range(1, ORDER):
        before = np.full(len(symbol), 0x0A, np.int64)
        before[back:] = symbol[:-back] if len(symbol) > back else symbol[:0]
        for k in range(back):  # the bytes nearer to a text's start than ``back``
            at = first + k
            before[at[at < len(raw)]] = 0x0A
        code |= before << (SYMBOL_BITS * back)
    return code


def _codes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = tx.utf8(part.column("text"))
    return raw, offsets, gram_codes(raw, offsets)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all whole texts of ``docs`` (lang, text), pre-aggregated in each task."""

    def run(batches):
        names: dict[str, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for part in tx.slices(batches):
            raw, offsets, codes = _codes(part)
            if not len(raw):
                continue
            lang = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.int64)
            codes |= np.repeat(lang << (ORDER * SYMBOL_BITS), np.diff(offsets))
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            parts.append((codes[first], np.diff(np.append(first, len(codes)))))
            if sum(len(c) for c, _ in parts) > 4_000_000:
                parts = [_merged(parts)]
        if parts:
            codes, counts = _merged(parts)
            back = list(names)
            for i in range(0, len(codes), 100_000):
                c = codes[i : i + 100_000]
                langs = pa.DictionaryArray.from_arrays(pa.array(c >> (ORDER * SYMBOL_BITS), pa.int64()), pa.array(back, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(c & ((1 << ORDER * SYMBOL_BITS) - 1), pa.int64()), pa.array(counts[i : i + 100_000], pa.int64())], names=["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value): log-probabilities of all seen o-grams, kind 2 o, and log
    back-off weights of their contexts, kind 2 o + 1, for the orders o from 1 to 5."""
    grams = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols come before
        tail = F.col("gram").bitwiseAND(F.lit((1 << order * SYMBOL_BITS) - 1))
        grams[order] = stored(grams[order + 1].groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    out, below = None, None
    for order in range(1, ORDER + 1):
        g = grams[order].withColumn("context", F.shiftright("gram", SYMBOL_BITS))
        n = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
        spread = g.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        discount = [
            F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5))))
            for k in (1, 2, 3)
        ]
        spread = spread.select("lang", *[d.alias(f"d{k}") for k, d in enumerate(discount, 1)])
        contexts = g.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("c1"), F.count_if(F.col("n") == 2).alias("c2"), F.count_if(F.col("n") >= 3).alias("c3")
        )
        contexts = contexts.join(small(spread), "lang")
        left = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")
        contexts = stored(contexts.withColumn("left", left), "contexts")
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        scored = g.join(contexts.select("lang", "context", "total", "left", "d1", "d2", "d3"), ["lang", "context"])
        if below is None:
            scored = scored.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            tail = F.col("gram").bitwiseAND(F.lit((1 << (order - 1) * SYMBOL_BITS) - 1))
            scored = scored.withColumn("tail", tail).join(below, ["lang", "tail"])
        p = F.greatest(F.lit(0.0), F.col("n") - own) / F.col("total") + F.col("left") * F.col("lower")
        scored = stored(scored.select("lang", "gram", p.alias("p")), "scored")
        below = scored.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
        rows = scored.select("lang", F.lit(2 * order).alias("kind"), "gram", F.log("p").cast("float").alias("value")).unionByName(
            contexts.select("lang", F.lit(2 * order + 1).alias("kind"), F.col("context").alias("gram"), F.log("left").cast("float").alias("value"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def prior(kind: F.Column, gram: F.Column) -> F.Column:
    """The byte before the predicted one, by which the model is cut: that of an o-gram, or
    a context's last.  Unigrams and the empty context have none: they belong to every part."""
    last = gram.bitwiseAND(F.lit(SYMBOLS - 1))
    own = F.when(F.pmod(kind, F.lit(2)) == 1, last).otherwise(F.shiftright(gram, SYMBOL_BITS).bitwiseAND(F.lit(SYMBOLS - 1)))
    return F.when(kind >= 4, own).otherwise(F.lit(-1)).cast("int")


@dataclass
class Model:
    """A block of one language: for each kind sorted codes and their values."""

    of: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, kind: np.ndarray, gram: np.ndarray, value: np.ndarray) -> Model:
        of = {}
        for k in range(2, 2 * ORDER + 2):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(gram[mine])]
            of[k] = (gram[mine], value[mine])
        return cls(of)

    def _find(self, kind: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.of[kind]
        if not len(keys):
            return np.zeros(len(codes), bool), np.zeros(len(codes), np.float32)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        seen = keys[at] == codes
        return seen, np.where(seen, values[at], np.float32(0))

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Natural log-probability of each code's last byte after its first four."""
        out, open_, weight = np.zeros(len(codes), np.float32), np.arange(len(codes)), np.zeros(len(codes), np.float32)
        for order in range(ORDER, 0, -1):
            left = codes[open_] & np.int64((1 << order * SYMBOL_BITS) - 1)
            seen, value = self._find(2 * order, left)
            out[open_[seen]] = value[seen] + weight[open_[seen]]
            open_ = open_[~seen]
            if not len(open_):
                return out
            weight[open_] += self._find(2 * order + 1, left[~seen] >> SYMBOL_BITS)[1]
        out[open_] = weight[open_] - np.log(SYMBOLS)
        return out


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    w = tx.words(raw, offsets)
    starts = tx.code_points(raw) & tx.NOT_SPACE[raw]
    lines = tx.words(raw, offsets, _NOT_NEWLINE)
    worded = np.zeros(len(lines), bool)
    worded[np.searchsorted(lines.start, w.start, "right") - 1] = True
    row, key = lines.row[worded], lines.hash[worded] ^ tx.mix(lines.row[worded].astype(np.uint64))
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    hashes, at = tx.grams(w, 3)
    key = hashes ^ tx.mix(w.row[at].astype(np.uint64), 1)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    found = at[np.isin(key, twice)] if len(twice) else at[:0]
    rows = len(offsets) - 1
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": tx.row_sums(offsets, starts),
        "n_symbols": tx.row_sums(offsets, _SYMBOL_CHARACTER[raw]),
        "n_dup_lines": np.bincount(row[again], minlength=rows),
        "n_repeat_words": tx.row_sums(w.bounds, tx.covered(len(w), found, 3)),
    }


def lexical_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each row that hold a letter, a digit or a non-ASCII character: the
    unit of the perplexity, so that marks between words are a cost of the words."""
    w = tx.words(raw, offsets)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LEXICAL[raw], out=total[1:])
    return tx.row_sums(w.bounds, total[w.end] > total[w.start])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _blocks(model: DataFrame, entries: int) -> list[list[tuple[str, int]]]:
    """Parts (lang, prior) gathered into blocks of at most ``entries``, or of one larger part.
    A language has 256 parts, however large the corpus is; its empty ones are in the block
    of its first."""
    sizes = model.groupBy("lang", prior(F.col("kind"), F.col("gram")).alias("prior")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "prior").collect()
    out: list[list[tuple[str, int]]] = []
    room, begun = 0, set()
    for r in sizes:
        if r.prior < 0:
            continue
        if r.n > room or not out:
            out.append([])
            room = entries
        if r.lang not in begun:
            begun.add(r.lang)
            known = {x.prior for x in sizes if x.lang == r.lang}
            out[-1] += [(r.lang, x) for x in range(SYMBOLS) if x not in known]
        out[-1].append((r.lang, r.prior))
        room -= r.n
    return out


def score(docs: DataFrame, model: DataFrame, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``docs`` (doc_id, lang, text) -> doc_id, lang, the base counts, log_perplexity (nats a word).

    A language that the model lacks has no perplexity (null), like a text without words."""
    kept = [f for f in docs.schema if f.name != "text"]
    blocks = _blocks(model, entries) or [[]]
    # all blocks but the last only add up costs; the last one also counts
    out = docs.withColumn("__cost", F.lit(0.0))
    for block in blocks[:-1]:
        out = _costs(out, model, block)
    return _costs(out, model, blocks[-1], [f.name for f in kept])


def _costs(docs: DataFrame, model: DataFrame, block: list[tuple[str, int]], counted: list[str] | None = None) -> DataFrame:
    """``docs`` with the costs of a block's predictions added to __cost; with ``counted``,
    these columns, the base counts and log_perplexity instead."""
    langs = sorted({lang for lang, _ in block})
    number = F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")).cast("int") - 1
    part = prior(F.col("kind"), F.col("gram"))
    wanted = F.lit(False)
    for lang in langs:
        wanted = wanted | ((F.col("lang") == lang) & part.isin(-1, *[p for x, p in block if x == lang]))
    table = model.where(wanted).select(number.alias("lang"), F.col("kind").cast("byte").alias("kind"), "gram", "value").toArrow()
    columns = {c: np.asarray(table.column(c)) for c in table.schema.names}
    models, priors = {}, {}
    for i, lang in enumerate(langs):
        mine = columns["lang"] == i
        models[lang] = Model.build(columns["kind"][mine], columns["gram"][mine], columns["value"][mine])
        priors[lang] = np.isin(np.arange(SYMBOLS), [p for x, p in block if x == lang])
    del table, columns
    shared = docs.sparkSession.sparkContext.broadcast((models, priors))
    schema = docs.schema
    if counted is not None:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in counted], *[f"{c} long" for c in _COUNTS], "log_perplexity double"])

    def run(batches):
        models, priors = shared.value
        for batch in tx.slices(batches):
            raw, offsets, codes = _codes(batch)
            costs = np.zeros(len(codes) + 1)
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                if lang in models:
                    mine = np.repeat(np.array([x == lang for x in langs]), np.diff(offsets))
                    mine &= priors[lang][(codes >> SYMBOL_BITS) & (SYMBOLS - 1)]
                    costs[1:][mine] = -models[lang].log_p(codes[mine])
            total = np.cumsum(costs)
            cost = total[offsets[1:]] - total[offsets[:-1]] + np.asarray(batch.column("__cost"))
            if counted is None:
                yield pa.RecordBatch.from_arrays([pa.array(cost) if n == "__cost" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)
                continue
            n, counts = lexical_words(raw, offsets), base_counts(raw, offsets)
            unknown = (n == 0) | np.array([x not in models for x in langs])
            values = [*[batch.column(c) for c in counted], *[pa.array(counts[c], pa.int64()) for c in _COUNTS], pa.array(cost / np.maximum(n, 1), pa.float64(), mask=unknown & (cost == 0))]
            yield pa.RecordBatch.from_arrays(values, names=[*counted, *_COUNTS, "log_perplexity"])

    return docs.mapInArrow(run, schema)


def bands(scored: DataFrame, mads: tuple[float, float] = BAND_MADS, nats: tuple[float, float] = BAND_NATS) -> DataFrame:
    """(lang, low, high) from the whole distribution of each language's log-perplexity.

    Each side has a width of its own: the median distance from the median of the
    documents on that side, those at the median's own bin included, times ``mads``, and
    ``nats`` at least."""
    bins = scored.where(F.col("log_perplexity").isNotNull()).groupBy("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def median(df: DataFrame, value: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy(value))
        total = F.sum("n").over(Window.partitionBy("lang"))
        return df.withColumns({"upto": upto, "total": total}).where(F.col("upto") * 2 >= F.col("total")).groupBy("lang").agg(F.min(value).alias("median"))

    centre = median(bins, "bin")
    apart = bins.join(centre, "lang").withColumn("apart", F.abs(F.col("bin") - F.col("median")))
    mid, out = (F.col("median") + 0.5) * BIN, centre
    for name, sign, side, many, least in (("low", -1, "bin <= median", mads[0], nats[0]), ("high", 1, "bin >= median", mads[1], nats[1])):
        width = median(apart.where(side), "apart").withColumnRenamed("median", "width")
        out = out.join(width, "lang").withColumn(name, mid + sign * F.greatest(F.col("width") * BIN * many, F.lit(float(least)))).drop("width")
    return out.select("lang", "low", "high")


def quality_rules(docs: DataFrame, mads: tuple[float, float] = BAND_MADS, nats: tuple[float, float] = BAND_NATS) -> DataFrame:
    """doc_id, n_words, base counts, base_failed, kept, lang, log_perplexity, low, high.

    A document fails the base rules with fewer than 50 words or more than half
    of its words in repeated 3-word windows; of the others, those inside their
    language's perplexity band are kept.  The model and the bands come from all
    whole texts of ``docs``.  A null text is empty: it has no words and fails.
    A null language is a language of its own.  Repeated rows count each time and
    give equal rows.  An empty table stays empty.  Other columns are ignored,
    whatever their names.
    """
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    model = stored(kneser_ney(stored(count_grams(docs), "grams")), "model")
    scored = stored(score(docs, model), "scored")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    band = bands(scored.where(~F.col("base_failed")), mads, nats)
    judged = scored.join(small(band), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "low", "high")
