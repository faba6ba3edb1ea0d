"""MinHash near-duplicates with an LSH forest.

Every tree sorts all documents by a sequence of MinHash values of its own.  In that
order the documents with the longest common prefixes stand next to each other; these
neighbours are the first candidates, one for each document, then one for each pair of
components, then all that still join two components.  A run of documents with a common
prefix is a region of the tree, and its depth adapts: shorter where few documents share
the prefix, and where a region holds more open pairs than a limit, its members are told
apart by their rarest shingles instead.  Inside a region only the members outside its
largest component are searched, so a group of near copies costs about its size.  What
is not compared in full is ruled out by exact bounds: sizes, and parity sketches, whose
differing bits never outnumber the shingles that two sets do not share.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .common import members, stored

#: Words of one shingle, and the least percentage that links two documents.
SHINGLE, PERCENT = 5, 75
#: Trees, the MinHash values that each has for itself, and the prefix that two documents
#: have to share.  As no value serves two trees, two sets of similarity s meet in some
#: region with probability 1 - (1 - s**DEPTH)**TREES at least.
TREES, KEYS, DEPTH = 20, 6, 4
HASHES = TREES * KEYS
#: Documents that may share a prefix of DEPTH - 1 values and be one region by it.
CROWD = 64
#: Open pairs of a region that are looked at; more are found by the rarest shingles.  Both
#: ways find every link between two members.
REGION_PAIRS = 1_000_000
#: Bits of a parity sketch.
SKETCH_BITS = 1024
_SKETCH_LONGS = SKETCH_BITS // 64
_LABEL = 4 * KEYS

_RNG = np.random.default_rng(75)
_FLIP = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row, and the rows' bounds."""
    raw, offsets = tx.utf8(array)
    w = tx.words(tx.LOWER[raw], offsets)
    hashes, at = tx.grams(w, SHINGLE)
    row = w.row[at]
    n = np.diff(w.bounds)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        hashes = np.concatenate([hashes, tx.span_grams(w, w.bounds[short], n[short])])
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        row, hashes = np.concatenate([row, short])[order], hashes[order]
    key = hashes ^ tx.mix(row.astype(np.uint64), 2)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        again = np.flatnonzero(np.isin(key, twice))
        first = again[np.unique(key[again], return_index=True)[1]]
        keep = np.ones(len(key), bool)
        keep[again] = False
        keep[first] = True
        row, hashes = row[keep], hashes[keep]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set (d1, d2), and the MinHash
    values of all trees, four big-endian bytes each."""

    def run(batches):
        for part in tx.slices(batches):
            hashes, bounds = shingle_sets(part.column("text"))
            some = np.flatnonzero(np.diff(bounds))
            sig = np.zeros((part.num_rows, HASHES), ">u4")
            for k in range(HASHES if len(some) else 0):
                sig[some, k] = np.minimum.reduceat((hashes ^ _FLIP[k]) * _ODD[k], bounds[some]) >> np.uint64(32)
            digests = []
            for salt in (3, 4):
                total = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(tx.mix(hashes, salt), out=total[1:])
                digests.append(pa.array(tx.signed(total[bounds[1:]] - total[bounds[:-1]]), pa.int64()))
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), part.num_rows, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), *digests, values], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, the full shingle set and its parity sketch, of every row with a set.

    A shingle flips one bit of the sketch.  The bits in which two sketches differ are
    flipped an odd number of times by the shingles that only one set has, so there are
    at least as many such shingles."""

    def run(batches):
        for part in tx.slices(batches):
            hashes, bounds = shingle_sets(part.column("text"))
            some = np.flatnonzero(np.diff(bounds))
            row = np.repeat(np.arange(len(some)), np.diff(bounds)[some])
            flips = np.bincount(row * SKETCH_BITS + (tx.mix(hashes, 11) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=len(some) * SKETCH_BITS)
            sketch = np.packbits((flips & 1).astype(np.uint8)).view(np.int64)
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(sketch, pa.int64()), _SKETCH_LONGS).cast(pa.list_(pa.int64()))
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tx.signed(hashes), pa.int64()))
            rows = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), sets.take(rows), pa.array(np.diff(bounds)[some], pa.int64()), sketches], names=["node", "shingles", "size", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"node {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>, size long, sketch array<long>")


def _possible(percent: int, size: Column, sketch: Column, other_size: Column, other_sketch: Column) -> Column:
    """False only if sizes or sketches prove that two sets are less similar than ``percent``.

    Sets of n and m shingles with d unshared ones have similarity (n + m - d) / (n + m + d)."""
    least, most = F.least(size, other_size), F.greatest(size, other_size)
    differing = [F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(other_sketch, F.lit(i)))) for i in range(_SKETCH_LONGS)]
    unshared = sum(differing[1:], differing[0]).cast("long")
    return (least * 100 >= most * percent) & (unshared * (100 + percent) <= (size + other_size) * (100 - percent))


def orders(nodes: DataFrame, shortest: int = DEPTH - 1) -> DataFrame:
    """The sorted orders of ``nodes`` (node, sig), of all trees.

    One row for each node and tree in which a neighbour shares ``shortest`` values or
    more: tree, label (the tree's values), node, the neighbour before it and their
    common prefix (prev, with_prev), the length of the longest prefix that it shares
    with a neighbour (near) and the first node with that prefix (hub).  The first and
    last rows of a task, whose neighbours another task has, carry its number in part.
    """
    label = F.substring("sig", F.col("tree") * _LABEL + 1, F.lit(_LABEL))
    placed = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "node")
    ordered = placed.orderBy("tree", "label", "node").withColumn("part", F.spark_partition_id())
    kind = nodes.schema["node"].dataType.simpleString()

    def common(rows: pa.Table) -> np.ndarray:
        """Of each row but the first, the values that it has in common with the row before."""
        label = rows.column("label").cast(pa.binary(_LABEL)).combine_chunks()
        values = np.frombuffer(label.buffers()[1], ">u4", len(rows) * KEYS, label.offset * _LABEL).reshape(len(rows), KEYS)
        same = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1)
        tree = np.asarray(rows.column("tree"))
        return np.where(tree[1:] == tree[:-1], same, 0)

    def run(batches):
        # the last row waits for its next neighbour; with it, what is known of it
        held, held_with, held_prev, held_hubs, at_start = None, 0, None, None, True
        for batch in chain((b for b in batches if b.num_rows), [None]):
            fresh = None if batch is None else pa.Table.from_batches([batch])
            parts = [t for t in (held, fresh) if t is not None]
            if not parts:
                return
            rows = pa.concat_tables(parts).combine_chunks()
            n, last = len(rows), batch is None
            node = rows.column("node").combine_chunks()
            with_prev = np.append(held_with, common(rows)).astype(np.int64)
            prev = pa.concat_arrays([node.slice(0, 1) if held is None else held_prev, node.slice(0, n - 1)])
            hubs = []
            for d in range(KEYS + 1):  # the first node of the run with a prefix of d values
                start = np.where(with_prev < d, np.arange(n), -1)
                start[0] = -1
                earlier = node.slice(0, 1) if held is None else held_hubs[d]
                hubs.append(pa.concat_arrays([earlier, node]).take(pa.array(np.maximum.accumulate(start) + 1)))
            near = np.maximum(with_prev, np.append(with_prev[1:], 0))
            edge = np.zeros(n, bool)
            edge[0], edge[-1] = at_start, last
            wanted = np.flatnonzero(((near >= shortest) | edge)[: n if last else n - 1])
            if n > 1 or last:
                take = pa.array(wanted, pa.int64())
                hub = pa.concat_arrays(hubs).take(pa.array(near[wanted] * n + wanted, pa.int64()))
                task = pa.array(np.where(edge, np.asarray(rows.column("part")), -1)[wanted], pa.int32())
                columns = [*[rows.column(c).take(take) for c in ("tree", "label", "node")], prev.take(take), pa.array(with_prev[wanted], pa.int32()), pa.array(near[wanted], pa.int32()), hub, task]
                yield from pa.Table.from_arrays(columns, names=["tree", "label", "node", "prev", "with_prev", "near", "hub", "part"]).to_batches()
                at_start = False
            held, held_with, held_prev, held_hubs = rows.slice(n - 1), int(with_prev[-1]), prev.slice(n - 1), [h.slice(n - 1) for h in hubs]

    return ordered.mapInArrow(run, f"tree int, label binary, node {kind}, prev {kind}, with_prev int, near int, hub {kind}, part int")


def _shared_prefix(label: Column, other: Column) -> Column:
    same = F.lit(0)
    for n in range(1, KEYS + 1):
        same = F.when(F.substring(label, 1, 4 * n) == F.substring(other, 1, 4 * n), F.lit(n)).otherwise(same)
    return same


def neighbours(ordered: DataFrame, shortest: int = DEPTH - 1) -> DataFrame:
    """(a, b, near): each pair of neighbours of some order once, and its longest common prefix."""
    pairs = ordered.where(F.col("with_prev") >= shortest).select(F.col("prev").alias("one"), F.col("node").alias("two"), F.col("with_prev").alias("near"))
    pairs = pairs.unionByName(ordered.where(F.col("near") >= shortest).select(F.col("hub").alias("one"), F.col("node").alias("two"), "near"))
    # the ends of the tasks' runs, two rows for each task
    along = Window.partitionBy("tree").orderBy("label", "node")
    ends = ordered.where("part >= 0").withColumns({"one": F.lag("node").over(along), "other": F.lag("label").over(along)})
    cuts = ends.select("one", F.col("node").alias("two"), _shared_prefix(F.col("label"), F.col("other")).alias("near")).where((F.col("near") >= shortest) & F.col("one").isNotNull())
    pairs = pairs.unionByName(cuts).where(F.col("one") != F.col("two"))
    return pairs.groupBy(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).agg(F.max("near").alias("near"))


def forest(ordered: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(region, node) of all regions of two nodes or more: the region is a hash of
    the tree and a prefix of its label, of ``depth`` values or one less where at most
    CROWD nodes share that.  Nodes with a common prefix of ``depth`` are always in one region."""

    def prefix(n: int) -> Column:
        return F.xxhash64("tree", F.lit(n), F.substring("label", 1, 4 * n))

    def crowds(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    placed = ordered.select("node", prefix(depth - 1).alias("short"), prefix(depth).alias("long"))
    shared = stored(placed.join(crowds(placed, "short"), "short"), "prefixes")
    few = shared.where(F.col("n") <= CROWD).select(F.col("short").alias("region"), "node")
    many = shared.where(F.col("n") > CROWD).select("long", "node")
    return few.unionByName(many.join(crowds(many, "long").select("long"), "long").select(F.col("long").alias("region"), "node"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.where(F.col("common").cast("long") * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) can reach.

    Labels spread to neighbours and then jump to their labels' labels, so the
    rounds grow with the logarithm of the longest chain.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), "component")
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        after = stored(stepped.join(far, "to").select("node", F.least("to", "far").alias("component"), (F.least("to", "far") != F.col("component")).alias("changed")), "labels")
        labels = after.select("node", "component")
        if not after.where("changed").limit(1).count():
            return labels


def _outsiders(groups: DataFrame, *key: str) -> DataFrame:
    """Members of each group that are not in its largest component, with that one's name.

    Most of a group is one component; starting from the others, a search of the
    rest costs their number times the group's, not the square of the latter.
    """
    parts = groups.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy(*key).agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return groups.join(largest.select(*key, F.col("most.component").alias("largest")), list(key)).where("component <> largest")


def _cross_pairs(groups: DataFrame, percent: int, condition: Column | None = None) -> DataFrame:
    """Pairs (a < b) of members (region, node, component, size, sketch) of different components
    of a group that may be similar enough.  With ``places``, all regions of a node, a pair
    leaves the join only in the first region that both share."""
    mine = {c: f"own_{c}" for c in groups.columns if c != "region"}
    left = _outsiders(groups, "region").select("region", *[F.col(c).alias(n) for c, n in mine.items()])
    wanted = (F.col("own_component") != F.col("component")) & _possible(percent, F.col("own_size"), F.col("own_sketch"), F.col("size"), F.col("sketch"))
    if "places" in groups.columns:
        wanted = wanted & (F.get(F.array_intersect("own_places", "places"), F.lit(0)) == F.col("region"))
    if condition is not None:
        wanted = condition & wanted
    pairs = left.join(groups, "region").where(wanted)
    return pairs.select(F.least("own_node", "node").alias("a"), F.greatest("own_node", "node").alias("b")).distinct()


def _dense_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact candidates among dense regions' nodes, by their rarest shingles.

    In any shared order of shingles, two sets of similarity t or more, n >= m shingles,
    have a shingle in common that is among the first n - ceil(t n) + 1 of the larger and
    the first m - ceil(2 t m / (1 + t)) + 1 of the smaller set.  A shingle that is in no
    set's shorter start links nothing."""
    nodes = members.select("node", "component").distinct()
    rows = nodes.join(sets.select("node", "shingles", "size"), "node").select("node", "component", "size", F.explode("shingles").alias("shingle"))
    spread = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    ranked = rows.join(spread, "shingle").groupBy("node", "component", "size").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", (F.col("c1") != F.col("c2")).alias("mixed")))).alias("order"))
    longer = (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int")
    shorter = F.col("size") - F.ceil(F.col("size") * (2 * percent) / (100 + percent)) + 1
    keyed = ranked.select("node", "component", "size", shorter.alias("shorter"), F.posexplode(F.slice("order", F.lit(1), longer)).alias("at", "x")).where("x.mixed")
    keyed = keyed.select(F.col("x.shingle").alias("region"), "node", "component", "size", (F.col("at") < F.col("shorter")).alias("early"))
    useful = keyed.groupBy("region").agg(F.max("early").alias("some")).where("some").select("region")
    both = F.when(F.col("own_size") >= F.col("size"), F.col("early")).otherwise(F.lit(False)) | F.when(F.col("own_size") <= F.col("size"), F.col("own_early")).otherwise(F.lit(False))
    return _cross_pairs(keyed.join(useful, "region").join(sets.select("node", "sketch"), "node"), percent, both)


def _named(rows: DataFrame, labels: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """``rows`` with the component of ``node``; a node without links is its own component."""
    known = labels.select(F.col("node").alias(node), F.col("component").alias(component))
    return rows.join(known, node, "left").withColumn(component, F.coalesce(component, node))


def _best(pairs: DataFrame, *key: str) -> DataFrame:
    """For each key the pair of longest common prefix, of equal ones the one of least names."""
    return pairs.groupBy(*key).agg(F.min(F.struct((-F.col("near")).alias("far"), "a", "b")).alias("x")).select("x.a", "x.b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    ``percent`` is 75 or more, which the trees are made for.

    Texts are lower-cased (A-Z); a text of fewer than five words is one shingle,
    one without words (or null) has none and is linked with nothing.  Documents
    with equal sets are linked at once and enter the forest as one node, the
    smallest doc_id; so a group of copies of any size is one node.  A null
    doc_id is linked with nothing, has no component and is kept.  Rows that
    repeat a doc_id are one document.  Very long texts are compared whole.  An
    empty table gives an empty result; other columns are ignored.
    """
    if percent < PERCENT:
        raise ValueError(f"percent must be at least {PERCENT}")
    signed = stored(signatures(docs), "signatures")
    known = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "classes")
    ordered = stored(orders(classes.select("node", "sig")), "orders")
    wanted = stored(ordered.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    sets = stored(_sets(members(docs.select("doc_id", "text"), wanted, "doc_id").dropDuplicates(["doc_id"])), "sets")

    open_ = stored(neighbours(ordered), "neighbours")
    tried = links = labels = None
    for step in ("nodes", "components", "all"):
        if labels is None:
            ends = open_.withColumn("node", F.explode(F.array("a", "b")))
            pairs = _best(ends, "node")
        else:
            apart = _named(_named(open_.join(tried, ["a", "b"], "left_anti"), labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
            apart = apart.withColumns({"c1": F.least("ca", "cb"), "c2": F.greatest("ca", "cb")})
            pairs = _best(apart, "c1", "c2") if step == "components" else apart.select("a", "b")
        pairs = stored(pairs, "pairs")
        found = stored(confirmed(pairs, sets, percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is None or found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            labels = components(links)

    named = stored(_named(forest(ordered, DEPTH), labels), "named")
    parts = named.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("region").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where("pairs > 0")
    left = stored(named.join(mixed, "region"), "open")
    sparse = left.where(F.col("pairs") <= REGION_PAIRS)
    about = sets.select("node", "size", "sketch").join(sparse.groupBy("node").agg(F.array_sort(F.collect_set("region")).alias("places")), "node")
    pairs = _cross_pairs(sparse.select("region", "node", "component").join(about, "node"), percent)
    dense = left.where(F.col("pairs") > REGION_PAIRS)
    if dense.limit(1).count():
        pairs = pairs.union(_dense_pairs(dense, sets, percent)).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    more = stored(confirmed(pairs, sets, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = _named(classes.select("d1", "d2", "n_shingles", "node"), labels).drop("node")
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs``, one document of each group: the smallest doc_id.

    Rows with a null doc_id stay; so do all rows that repeat a kept doc_id.  Nulls,
    empty and long texts, ties and empty tables are as in ``near_duplicates``; extra
    columns pass through, whatever their names.
    """
    dropped = near_duplicates(docs.select("doc_id", "text"), percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
