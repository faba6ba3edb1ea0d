"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of tokens of the normalised test items.  Training
tokens stream through it; the longest match that ends at each token tells which
item windows occur there.  Only stretches of words in windows with an item window's
hash need the walk, and a whole slice of texts is hashed at once.

A benchmark that is too large for one automaton is dealt to several.  A map of its
window hashes, of bounded size, then chooses the texts that may hold a window, and
only these meet the automata, one after another.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import small, stored

#: Words of one item window; shorter items are one window each.
WINDOW = 10
#: Item words that one broadcast automaton may hold (about 1 KB each in a task);
#: more items go into several automata, one after another.
AUTOMATON_WORDS = 100_000
#: Bits of the broadcast map of window hashes (16 MB), whatever the number of windows.
MAP_BITS = 1 << 27


class SuffixAutomaton:
    """All token runs of several items; ``items_of(state, w)`` are the items with
    the run of ``w`` tokens that ends in a state, if it is one of their windows."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, int], set[str]] = defaultdict(set)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the shorter runs of ``q``, cut off after ``p``."""
        short = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier item has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)

    def suffix(self, state: int, width: int) -> int:
        """The state of the last ``width`` tokens of a match that ends in ``state``."""
        while self.length[self.link[state]] >= width:
            state = self.link[state]
        return state

    def mark(self, item: str, tokens, width: int) -> None:
        """Note the windows of ``width`` tokens of an item; call it after every ``add``."""
        for end, (state, length) in enumerate(self.walk(tokens), 1):
            if end >= width:
                assert length >= width
                self.windows[self.suffix(state, width), width].add(item)

    def walk(self, tokens):
        """(state, longest match) after each token."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


@dataclass
class ItemIndex:
    automaton: SuffixAutomaton
    #: width -> the sorted hashes of the item windows of this width, by ascending width
    seeds: dict[int, np.ndarray]


def _tokens(array: pa.Array) -> tx.Words:
    raw, offsets = tx.utf8(array)
    return tx.words(tx.LOWER[raw], offsets, tx.LOWER_ALNUM)


def _windows(w: tx.Words, window: int) -> dict[int, np.ndarray]:
    """width -> the distinct hashes of the items' windows; an item is a row of ``w``."""
    widths = np.minimum(np.diff(w.bounds), window)
    out = {}
    for width in np.unique(widths[widths > 0]).tolist():
        hashes, at = tx.grams(w, width)
        out[width] = np.unique(hashes[widths[w.row[at]] == width])
    return out


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW) -> ItemIndex:
    w = _tokens(pa.array([text for _, text in items], pa.string()))
    token_lists = [w.hash[w.bounds[r] : w.bounds[r + 1]].tolist() for r in range(len(items))]
    automaton = SuffixAutomaton()
    for tokens in token_lists:
        automaton.add(tokens)
    for (item, _), tokens in zip(items, token_lists, strict=True):
        if tokens:
            automaton.mark(item, tokens, min(window, len(tokens)))
    return ItemIndex(automaton, _windows(w, window))


def matches(w: tx.Words, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Marks hit words, and gives the longest match in hit windows and the items of each row."""
    hit, longest, items = np.zeros(len(w), bool), np.zeros(len(w.offsets) - 1, np.int64), defaultdict(set)
    stretch = np.zeros(len(w), bool)
    for width, seeds in index.seeds.items():
        hashes, at = tx.grams(w, width)
        found = at[seeds[np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)] == hashes]
        if len(found):
            stretch |= tx.covered(len(w), found, width)
    if not stretch.any():
        return hit, longest, items
    new = stretch.copy()
    new[1:] &= ~stretch[:-1] | (w.row[1:] != w.row[:-1])
    starts = np.flatnonzero(new)
    automaton = index.automaton
    for first, last in zip(starts, np.append(starts[1:], len(w)), strict=True):
        last = first + int(stretch[first:last].sum())
        row = int(w.row[first])
        for i, (state, length) in enumerate(automaton.walk(w.hash[first:last].tolist()), int(first)):
            longest[row] = max(longest[row], length)
            for width in index.seeds:
                if length < width:
                    break
                if here := automaton.windows.get((automaton.suffix(state, width), width)):
                    hit[i - width + 1 : i + 1] = True
                    items[row] |= here
    return hit, longest, items


#: Names of the columns while documents are searched, and of the results.
_PRIVATE = {"__spans": "spans", "__items": "items", "__n_words": "n_words", "__longest": "longest_match"}
_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("__spans", T.ArrayType(_SPAN)), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__n_words", T.LongType()), T.StructField("__longest", T.LongType())])
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, index) -> DataFrame:
    """Adds the private columns: what the automaton of ``index``, a broadcast, finds."""

    def run(batches):
        for batch in batches:
            for part in tx.slices([batch]):
                w = _tokens(part.column("text"))
                hit, longest, items = matches(w, index.value)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                names: list[list[str]] = [[] for _ in range(part.num_rows)]
                for row in items:
                    at = np.flatnonzero(hit[w.bounds[row] : w.bounds[row + 1]]) + w.bounds[row]
                    for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        base = w.offsets[row]
                        spans[row].append({"first": int(run_[0] - w.bounds[row]), "count": len(run_), "start": int(w.start[run_[0]] - base), "end": int(w.end[run_[-1]] - base)})
                    names[row] = sorted(items[row])
                new = [pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string())), pa.array(np.diff(w.bounds), pa.int64()), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *_FOUND.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_FOUND.fields]))


def _place(hashes: np.ndarray) -> np.ndarray:
    """The bit of each hash in the map."""
    return (hashes >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)


def _window_map(item: DataFrame, window: int) -> tuple[list[int], np.ndarray]:
    """The widths of all items' windows, and the bytes of the map of their hashes.

    The tasks set the bits in chunks of 32,768, of which the driver gets each at most once."""

    def run(batches):
        for batch in batches:
            for width, hashes in _windows(_tokens(batch.column("text")), window).items():
                place = _place(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), width), pa.int32()), pa.array(place >> 15, pa.int64()), pa.array(place & 32767, pa.int64())], names=["width", "chunk", "at"])

    bits = item.select("text").mapInArrow(run, "width int, chunk long, at long")
    chunks = bits.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits"), F.collect_set("width").alias("widths"))
    filled, widths = np.zeros(MAP_BITS // 8, np.uint8), set()
    for r in chunks.toLocalIterator():
        widths.update(r.widths)
        filled[r.chunk << 12 : (r.chunk + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return sorted(widths), filled


def _keyed(docs: DataFrame, widths: list[int], filled: np.ndarray) -> DataFrame:
    """Adds __n_words and __text, the SHA-256 of texts that may hold a window, else null."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        for batch in batches:
            for part in tx.slices([batch]):
                w, bits = _tokens(part.column("text")), shared.value
                maybe = np.zeros(part.num_rows, bool)
                for width in widths:
                    hashes, at = tx.grams(w, width)
                    place = _place(hashes)
                    maybe[w.row[at[bits[place >> 3] >> (place & 7) & 1 == 1]]] = True
                texts = part.column("text")
                keys = [hashlib.sha256(texts[r].as_py().encode()).digest() if m else None for r, m in enumerate(maybe.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(w.bounds), pa.int64()), pa.array(keys, pa.binary())], names=[*part.schema.names, "__n_words", "__text"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__text", T.BinaryType())]))


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, automaton_words: int) -> DataFrame:
    """``docs`` with the private columns."""
    context = docs.sparkSession.sparkContext
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = F.coalesce(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    blocks = -(-int(item.agg(F.sum(size)).first()[0] or 0) // automaton_words)
    if blocks <= 1:
        return _pass(docs, context.broadcast(build_index([tuple(r) for r in item.collect()], window)))
    windows = _window_map(item, window)
    keyed = _keyed(docs, *windows)
    # equal texts are searched once
    texts = _keyed(docs.select("text"), *windows).where("__text IS NOT NULL")
    texts = stored(texts.groupBy("__text").agg(F.first("text").alias("text")), "candidates")
    found = []
    for block in range(blocks):
        mine = item.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        index = context.broadcast(build_index([tuple(r) for r in mine.collect()], window))
        hits = _pass(texts, index).where(F.size("__spans") > 0)
        found.append(stored(hits.select("__text", "__spans", "__items", "__longest"), "hits"))
        index.destroy()  # one automaton at a time, here and in the tasks
    hits = reduce(DataFrame.unionByName, found).groupBy("__text")
    hits = hits.agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"), F.max("__longest").alias("__longest"))
    hits = stored(hits, "found")
    none = {"__spans": F.array().cast(_FOUND["__spans"].dataType), "__items": F.array().cast("array<string>"), "__longest": F.lit(0).cast("long")}
    columns = [*docs.columns, *_FOUND.names]
    # most texts have no key, and no join
    clean = keyed.where("__text IS NULL").withColumns(none).select(columns)
    joined = keyed.where("__text IS NOT NULL").join(small(hits), "__text", "left").withColumns({n: F.coalesce(n, v) for n, v in none.items()})
    return clean.unionByName(joined.select(columns))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (first word, count, byte start and end), items, longest_match.

    Texts are lower-cased (A-Z) and cut into words of a-z, 0-9 and non-ASCII
    characters.  A null or empty text has no words and no spans; a null item_id
    counts as the empty string, repeated items as one; an empty benchmark finds
    nothing; an empty table stays empty; repeated rows give equal rows; long texts
    are searched whole.  Columns of ``docs`` with the names of new ones are
    replaced, all others pass through.  Items of more than ``automaton_words`` words
    are dealt to several automata by hash, each item whole; spans of different automata
    may overlap.  ``longest_match`` is the longest run of an item among hit windows.
    """
    found = _searched(docs.drop(*_PRIVATE.values()), benchmark, window, automaton_words)
    return found.withColumnsRenamed(_PRIVATE)


def hit_words(spans):
    """How many words the spans cover; spans of several automata may overlap."""
    words = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["first"] + s["count"] - 1)))
    return F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(words))).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """Documents without item passages: the columns of ``docs`` and the cleaned text.

    Spans of ``min_span`` words or more are cut out of the text, the rest of
    which stays as it is; documents with more than ``max_coverage`` of their
    words hit are dropped.  ``n_chars`` follows the text where it is an integer
    column.  Null and empty texts have no spans and stay; rows of a null doc_id and
    repeated rows are judged one by one; long texts are searched whole; an empty
    table stays empty and an empty benchmark changes nothing.  All other columns
    pass through, whatever their names.
    """
    found = _searched(docs, benchmark, window, AUTOMATON_WORDS)
    kept = found.where(hit_words(F.col("__spans")) <= F.col("__n_words") * max_coverage)
    spans = F.array_sort(F.filter("__spans", lambda s: s["count"] >= min_span))
    kept = kept.withColumn("__spans", spans).withColumn("__cut", F.when(F.size("__spans") > 0, _without("text", "__spans")))
    new = {"text": F.coalesce("__cut", "text")}
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("short", "integer", "long"):
        new["n_chars"] = F.coalesce(F.length("__cut").cast(docs.schema["n_chars"].dataType), "n_chars")
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def _without(text: str, spans: str):
    """``text`` without the byte ranges of its sorted spans, which may overlap."""
    raw = F.col(text).cast("binary")
    upto = lambda some: F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), F.lit(0)).cast("int")
    piece = lambda start, end: F.substring(raw, start + 1, F.greatest(end - start, F.lit(0))).cast("string")
    before = F.transform(spans, lambda s, i: piece(upto(F.slice(spans, 1, i)), s["start"].cast("int")))
    return F.concat(F.array_join(before, ""), piece(upto(F.col(spans)), F.length(raw)))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "longest_match",
    )
