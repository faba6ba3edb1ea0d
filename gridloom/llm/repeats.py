"""Substring dedup with repeated-phrase automata.

A word window recurs if its word sequence also starts in a document with a
smaller doc_id.  Three steps find all of them without comparing documents:

1. Winnowing picks from every window one 16-word anchor, the one of least hash,
   so equal windows have equal anchors.  Anchors in more than one document mark
   the candidates.
2. Windows with such an anchor are counted by hash.  Those in several documents
   are confirmed; runs of them in the first document that has them are the
   recurring passages.
3. Passages, cut into tiles of which every window holds a whole one, are compiled
   into Aho-Corasick automata, sharded by the first document.  Documents are
   routed to the shards of their confirmed windows and stream through them, and
   every occurrence is marked.  Shards that many documents need are salted.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import small, stored

WINDOW, ANCHOR = 50, 16
TILE = WINDOW // 2
#: Text bytes of the passages of one automaton, and of the documents of one salt.
SHARD_BYTES, SALT_BYTES = 1 << 21, 1 << 23


def _anchors(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window, and its anchor: the least anchor hash inside it."""
    hashes, at = tx.grams(w, ANCHOR, salt=7)
    place = np.full(len(w) + 1, -1, np.int64)
    place[at] = np.arange(len(at))
    _, starts = tx.grams(w, WINDOW)
    width, span = 1, WINDOW - ANCHOR + 1
    least = hashes
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    first = place[starts]
    return starts, np.minimum(least[first], least[first + span - width]) if len(first) else hashes[:0]


def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def _surveyed(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, a hash of the text, n_words, digest of all words, distinct anchors."""

    def run(batches):
        for part in tx.slices(batches):
            w = tx.words(*tx.utf8(part.column("text")))
            starts, anchor = _anchors(w)
            row = w.row[starts]
            key = anchor ^ tx.mix(row.astype(np.uint64), 8)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]  # most repeats are neighbours
            row, anchor = row[new], anchor[new]
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("version"),
                    pa.array(np.diff(w.bounds), pa.int64()),
                    _digest(tx.joined(w, np.ones(len(w), bool))),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tx.signed(anchor), pa.int64())),
                ],
                names=["doc_id", "version", "n_words", "sha256", "anchors"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _versioned(docs).mapInArrow(run, f"doc_id {kind}, version long, n_words long, sha256 string, anchors array<long>")


def _versioned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("version"))


def _windows(candidates: DataFrame) -> DataFrame:
    """(window, doc_id, version) of every window whose anchor recurs."""

    def run(batches):
        for part in tx.slices(batches):
            w = tx.words(*tx.utf8(part.column("text")))
            starts, anchor = _anchors(w)
            wanted = part.column("anchors")
            owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            key = np.asarray(wanted.flatten(), np.int64).view(np.uint64) ^ tx.mix(owner, 9)
            hit = np.isin(anchor ^ tx.mix(w.row[starts].astype(np.uint64), 9), key)
            at, row = starts[hit], w.row[starts[hit]]
            window = tx.span_grams(w, at, np.full(len(at), WINDOW))
            take = pa.array(row, pa.int64())
            for i in range(0, len(at), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tx.signed(window[i : i + 200_000]), pa.int64()), *[part.column(c).take(take[i : i + 200_000]) for c in ("doc_id", "version")]],
                    names=["window", "doc_id", "version"],
                )

    return candidates.mapInArrow(run, f"window long, doc_id {candidates.schema['doc_id'].dataType.simpleString()}, version long")


def _passages(homes: DataFrame) -> DataFrame:
    """(home, passage): runs of confirmed windows in the first document that has them."""

    def run(batches):
        for part in tx.slices(batches):
            w = tx.words(*tx.utf8(part.column("text")))
            hashes, starts = tx.grams(w, WINDOW)
            listed = part.column("windows")
            owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            key = np.asarray(listed.flatten(), np.int64).view(np.uint64) ^ tx.mix(owner, 9)
            at = starts[np.isin(hashes ^ tx.mix(w.row[starts].astype(np.uint64), 9), key)]
            if not len(at):
                continue
            # a run breaks where the next window does not start one word later in the same text
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(w.row[at]) > 0)) + 1
            first, last = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + WINDOW
            texts = [bytes(w.raw[w.start[a] : w.end[b - 1]]).decode() for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(w.row[first])), pa.array(texts, pa.string())], names=["home", "passage"])

    return homes.mapInArrow(run, f"home {homes.schema['doc_id'].dataType.simpleString()}, passage string")


def _spaced(w: tx.Words) -> tuple[list[str], np.ndarray]:
    """Each row's words with one space around each, and where, in that string, each
    word's closing space stands."""
    texts = [f" {t} " for t in tx.joined(w, np.ones(len(w), bool)).to_pylist()]
    points = np.concatenate([[0], np.cumsum(tx.code_points(w.raw))])
    end = np.cumsum(points[w.end] - points[w.start] + 1)
    before = np.concatenate([[0], end])[w.bounds[:-1]]
    return texts, end - np.repeat(before, np.diff(w.bounds))


def _automaton(w: tx.Words) -> ahocorasick.Automaton:
    """The tiles of all passages."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    texts, closing = _spaced(w)
    for row, text in enumerate(texts):
        end = closing[w.bounds[row] : w.bounds[row + 1]]
        for k in range(0, len(end) - TILE + 1, TILE):
            out.add_word(text[end[k - 1] if k else 0 : end[k + TILE - 1] + 1])
    out.make_automaton()
    return out


def _located(passages: pa.Table, routed: pa.Table) -> pa.Table:
    """The spans of every occurrence in ``routed`` of windows of earlier documents' passages."""
    kind = routed.schema.field("doc_id").type
    schema = pa.schema([("doc_id", kind), ("version", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())])))])
    if not passages.num_rows or not routed.num_rows:
        return schema.empty_table()
    p = tx.words(*tx.utf8(passages.column("passage").combine_chunks()))
    automaton = _automaton(p)
    known, at = tx.grams(p, WINDOW)
    home = np.asarray(passages.column("home"))[p.row[at]]
    order = np.argsort(known, kind="stable")
    known, home = known[order], home[order]
    out = []
    for batch in routed.to_batches():
        for part in tx.slices([batch]):
            w = tx.words(*tx.utf8(part.column("text")))
            texts, closing = _spaced(w)
            tiles = []
            for row, text in enumerate(texts):
                ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
                if len(ends):
                    tiles.append(w.bounds[row] + np.searchsorted(closing[w.bounds[row] : w.bounds[row + 1]], ends) - TILE + 1)
            if not tiles:
                continue
            tile = np.zeros(len(w) + 1, np.int64)
            tile[np.unique(np.concatenate(tiles)) + 1] = 1
            tile = np.cumsum(tile)
            hashes, starts = tx.grams(w, WINDOW)
            holds = tile[starts + WINDOW - TILE + 1] > tile[starts]
            hashes, starts = hashes[holds], starts[holds]
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            ids = np.asarray(part.column("doc_id"))
            earlier = (known[place] == hashes) & (home[place] < ids[w.row[starts]])
            marked = tx.covered(len(w), starts[earlier], WINDOW)
            found = np.flatnonzero(marked)
            runs = np.split(found, np.flatnonzero((np.diff(found) > 1) | (np.diff(w.row[found]) > 0)) + 1)
            spans: dict[int, list] = {}
            for r in runs:
                if len(r):
                    row = int(w.row[r[0]])
                    spans.setdefault(row, []).append({"first": int(r[0] - w.bounds[row]), "count": len(r)})
            rows = pa.array(list(spans), pa.int64())
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("version").take(rows), pa.array(list(spans.values()), schema.field("spans").type)], schema=schema))
    return pa.Table.from_batches(out, schema)


def _shard_count(size: int) -> int:
    return max(1, -(-size // SHARD_BYTES))


def _survey(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' survey, the candidate documents with their texts, and the spans of these
    that recur."""
    survey = stored(_surveyed(docs), "survey")
    anchors = survey.where(F.col("doc_id").isNotNull()).select(F.explode("anchors").alias("anchor"), "doc_id", "version")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "version").agg(F.collect_set("anchor").alias("anchors"))
    candidates = stored(_versioned(docs).join(wanted, ["doc_id", "version"]), "candidates")
    windows = _windows(candidates)
    confirmed = windows.groupBy("window").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last").select("window", "home")
    confirmed = stored(confirmed, "confirmed")
    at_home = confirmed.groupBy(F.col("home").alias("doc_id")).agg(F.collect_list("window").alias("windows"))
    passages = stored(_passages(candidates.select("doc_id", "text").join(at_home, "doc_id")), "passages")
    shards = _shard_count(passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0)
    shard = F.pmod(F.xxhash64("home"), F.lit(shards))
    routes = windows.join(confirmed, "window").where("home < doc_id").select("doc_id", "version", shard.alias("shard")).distinct()
    routed = stored(routes.join(candidates.select("doc_id", "version", "text"), ["doc_id", "version"]), "routed")
    salts = routed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / SALT_BYTES).alias("salts"))
    salts = small(stored(salts, "salts"), shards)
    left = passages.withColumn("shard", shard).join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = routed.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), F.col("salts")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    groups = left.select("shard", "salt", "home", "passage").groupBy("shard", "salt").cogroup(right.select("shard", "salt", "doc_id", "version", "text").groupBy("shard", "salt"))
    spans = groups.applyInArrow(_located, f"doc_id {kind}, version long, spans array<struct<first:int,count:int>>")
    spans = spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return survey, candidates, spans


def _without(texts: DataFrame) -> DataFrame:
    """doc_id, version, n_removed, kept text and its digest of rows with spans."""

    def run(batches):
        for part in tx.slices(batches):
            w = tx.words(*tx.utf8(part.column("text")))
            keep = np.ones(len(w), bool)
            for row, spans in enumerate(part.column("spans").to_pylist()):
                for s in spans:
                    keep[w.bounds[row] + s["first"] : w.bounds[row] + s["first"] + s["count"]] = False
            kept = tx.joined(w, keep)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("version"), pa.array(tx.row_sums(w.bounds, ~keep), pa.int64()), kept, _digest(kept)],
                names=["doc_id", "version", "n_removed", "kept", "kept_sha256"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, version long, n_removed long, kept string, kept_sha256 string")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    survey, candidates, spans = _survey(docs)
    found = _without(candidates.select("doc_id", "version", "text").join(spans, ["doc_id", "version"]))
    return survey, stored(found.dropDuplicates(["doc_id", "version"]), "found")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text).

    A null or empty text has no words.  A null doc_id neither loses words nor
    makes others lose them.  Rows that repeat a doc_id are one document: they
    never remove each other's words.  Texts of fewer than 50 words stay whole;
    an empty table gives an empty result; other columns are ignored.
    """
    survey, found = _found(docs)
    joined = survey.select("doc_id", "version", "n_words", "sha256").join(found.drop("kept"), ["doc_id", "version"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; texts with recurring passages become their kept words,
    joined by one space, and all other texts stay as they are, null ones too.

    Rows that repeat a doc_id are one document and never lose words to each other;
    an empty table stays empty; other columns pass through.
    """
    _, found = _found(docs)
    keyed = docs.withColumn("__version", F.xxhash64("text"))
    cut = found.select("doc_id", F.col("version").alias("__version"), F.col("kept").alias("__kept"))
    joined = keyed.join(cut, ["doc_id", "__version"], "left")
    return joined.select(*[F.coalesce("__kept", "text").alias(c) if c == "text" else F.col(c) for c in docs.columns])
