"""Mixing, classification, near duplicates, chat, sharding and the pipeline."""

import importlib.util
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from fixtures import DOCUMENT, SPACE_WORD, corpus, lowered, sha
from pyspark.sql import functions as F

from gridloom.llm import chat, crf, mixing, near_dup, sharding
from gridloom.llm.oracle import SQL
from gridloom.llm.queries import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def rows():
    return corpus(2)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(5)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries()[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def components(rows, percent=75):
    sets = {}
    for i, text, *_ in rows:
        w = SPACE_WORD.findall(lowered(text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


@pytest.mark.parametrize("region_pairs", [1_000_000, 0])
def test_near_duplicates(spark, docs, rows, monkeypatch, region_pairs):
    monkeypatch.setattr(near_dup, "REGION_PAIRS", region_pairs)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    want = components(rows)
    assert got == want and sum(not r[3] for r in want) > 15
    kept = sorted(r.doc_id for r in near_dup.deduplicated(docs).collect())
    assert kept == [r[0] for r in want if r[3]]


def test_near_copies_of_one_base(spark, monkeypatch):
    """A large group of copies with scattered edits, and many texts that share a passage."""
    rng = random.Random(4)
    base, shared = [f"b{i}" for i in range(120)], [f"s{i}" for i in range(50)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0, ""))
    for i in range(150, 260):
        rows.append((i, " ".join([*shared, *[f"u{rng.randrange(10**6)}" for _ in range(40)]]), "en", "s", 0, ""))
    want = components(rows)
    monkeypatch.setattr(near_dup, "REGION_PAIRS", 5)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCUMENT)).collect()) == want


def planted_pairs(n, kept, changed, seed=8):
    """Pairs of texts that share ``kept`` - 4 shingles and have ``changed`` more each."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(10**9)}" for _ in range(kept + changed)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:kept] + [f"v{rng.randrange(10**9)}" for _ in range(changed)]))]
    return rows


@pytest.mark.parametrize("kept,changed,lost", [(64, 10, 5), (64, 6, 1)])
def test_forest_misses_few_pairs(spark, kept, changed, lost):
    """Recall on pairs of similarity 60 / 80 and 60 / 72, through the whole operator."""
    n = 3000
    docs = spark.createDataFrame(planted_pairs(n, kept, changed), "doc_id long, text string").repartition(8)
    got = near_dup.near_duplicates(docs).where("doc_id % 2 = 1")
    assert got.where("component_id = doc_id - 1").count() >= n - lost and got.where("component_id < doc_id - 1").count() == 0


def brute_orders(sigs, shortest):
    """For each tree, the sorted order and each node's longest prefix with a neighbour."""
    out, size = {}, 4 * near_dup.KEYS
    for tree in range(near_dup.TREES):
        rows = sorted((sig[tree * size : (tree + 1) * size], node) for node, sig in sigs)
        same = lambda x, y: next((i for i in range(near_dup.KEYS) if x[4 * i : 4 * i + 4] != y[4 * i : 4 * i + 4]), near_dup.KEYS)
        with_prev = [0, *[same(rows[i - 1][0], rows[i][0]) for i in range(1, len(rows))]]
        for i, (label, node) in enumerate(rows):
            near = max(with_prev[i], with_prev[i + 1] if i + 1 < len(rows) else 0)
            if near >= shortest:
                hub = min((other for other in rows if other[0][: 4 * near] == label[: 4 * near]))[1]
                out[tree, node] = (near, hub, rows[i - 1][1] if with_prev[i] >= shortest else None)
    return out


@pytest.mark.parametrize("batch", [10_000, 3])
def test_orders_against_brute_force(spark, docs, batch):
    """Neighbours by longest common prefix, however the rows are cut into batches and tasks."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        signed = near_dup.signatures(docs).where("n_shingles > 0").selectExpr("doc_id AS node", "sig")
        sigs = [(r.node, bytes(r.sig)) for r in signed.collect()]
        want = brute_orders(sigs, 1)
        whole = near_dup.orders(signed.coalesce(1), 1)
        pairs = {(r.a, r.b): r.near for r in near_dup.neighbours(whole, 1).collect()}
        got = {(r.tree, r.node): (r.near, r.prev if r.with_prev >= 1 else None) for r in whole.collect() if r.part < 0}
        assert got and all(want[k][0] == near and want[k][2] == prev for k, (near, prev) in got.items())
        order = {}
        for (tree, node), (near, hub, prev) in want.items():
            for other in {hub, prev} - {node, None}:
                order.setdefault(tuple(sorted((node, other))), set()).add(tree)
        # at the ends of tasks hubs may be nearer ones; every neighbour in an order is a pair
        assert {tuple(sorted((n, p))) for (_, n), (_, _, p) in want.items() if p is not None} <= set(pairs)
        assert len(set(order) - set(pairs)) <= near_dup.TREES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bounds_never_exclude_a_link(spark):
    """Whatever sizes and sketches rule out is less similar than the limit."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.choice([6, 30, 90])))) for i in range(40)]
    for i in range(40):
        words = rng.choice(rows)[1].split()
        words[rng.randrange(len(words))] = "x"
        rows.append((100 + i, " ".join(words)))
    sets = near_dup._sets(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = (sets.select(*[F.col(c).alias(f"{x}_{c}") for c in sets.columns]) for x in "ab")
    both = a.join(b, F.col("a_node") < F.col("b_node")).withColumn("common", F.size(F.array_intersect("a_shingles", "b_shingles")))
    linked = F.col("common") * 100 >= (F.col("a_size") + F.col("b_size") - F.col("common")) * 75
    possible = near_dup._possible(75, F.col("a_size"), F.col("a_sketch"), F.col("b_size"), F.col("b_sketch"))
    counts = {(r.linked, r.possible): r["count"] for r in both.groupBy(linked.alias("linked"), possible.alias("possible")).count().collect()}
    assert counts[True, True] > 10 and (True, False) not in counts and counts[False, False] > 10 * counts.get((False, True), 0)


def test_near_duplicates_of_odd_tables(spark, docs):
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (10, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect())
    assert got == {(None, None, True): 1, (3, 3, True): 2, (9, 3, False): 1, (10, 10, True): 1}
    assert near_dup.deduplicated(odd).count() == 4


def labelled(n=240, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("an er to in st".split()) for _ in range(rng.choice([1, 2, 3])))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        line = lambda: " ".join(word().upper() + "!!" if bad else word() for _ in range(12)) + ("" if bad else ".")
        docs.append((i, "\n".join(line() for _ in range(rng.choice([1, 3, 9]))), "en", "s", 0, "x"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_classifier(spark):
    docs, labels = labelled()
    df = spark.createDataFrame([*docs, (900, None, None, None, None, None), (901, "", "en", "s", 0, ""), (902, "ok words. " * 3000, "en", "s", 0, "")], DOCUMENT)
    lab = spark.createDataFrame([*labels, (900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in crf.quality_scores(df, lab).collect()}
    held = [i for i, *_ in docs if got[i].held_out]
    import zlib

    assert held == [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1] and len(held) > 40
    assert all(got[i].predicted == labels[i][1] for i in held)
    assert got[900].score == got[901].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = crf.good_documents(df.withColumn("score", F.lit("mine")), lab)
    assert kept.columns == [*df.columns, "score"] and {r.score for r in kept.collect()} == {"mine"}
    assert crf.quality_scores(df.limit(0), lab).count() == 0
    assert {r.score for r in crf.quality_scores(df.limit(5), lab.limit(0)).collect()} == {0.5}


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    bounds, node, move = np.array([0, 3, 3, 7, 8]), rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, moves = crf._forward_backward(node, bounds, move)
    seen = np.zeros((2, 2))
    for a, b in itertools.pairwise(bounds):
        paths = list(itertools.product((0, 1), repeat=b - a))
        weight = np.array([np.exp(sum(node[a + i, s] for i, s in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        weight /= weight.sum()
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for w, p in zip(weight, paths, strict=True) if p[i]))
        for w, p in zip(weight, paths, strict=True):
            for x, y in itertools.pairwise(p):
                seen[x, y] += w
    assert moves == pytest.approx(seen)


def conversations(rows, loss="assistant"):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0][0], t[0][1] or 0, t[1], t[2]))
        said = "".join(t for _, r, t in turns if r == loss)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said)))
    return sorted(out, key=str)


def test_chat(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u <turn x>"), (1, 2, "assistant", r"\### </turn> \l \\b"), (2, 1, "assistant", "first"), (2, 0, "user", None), (3, 0, "user", "a"), (3, 0, "user", "a"),
        (4, None, None, "odd < role"), (4, 5, "assistant", ""), (None, 0, "user", "é日本" * 5000), (5, 0, "us<er>", "x"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    parsed = chat.chat_parse(chat.chat_format(df)).collect()
    got = sorted(((r.conv_id, len(r.turns), sha("".join(f"{t.role}\n{t.text}\n" for t in r.turns)), len(r.loss_text), sha(r.loss_text)) for r in parsed), key=str)
    assert got == conversations(rows)
    assert {r.conv_id: r.turn_order_valid for r in parsed} == {1: True, 2: True, 3: False, 4: False, None: True, 5: False}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in parsed)
    assert chat.chat_format(df.limit(0)).count() == 0


def test_sharding(spark, docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    import zlib

    assert len(got) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    slots, size = {}, Counter()
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t) for t in texts.values()) + 1
    assert max(size.values()) - min(size[i] for i in range(4)) <= 2 * largest
    assert sorted(map(tuple, sharding.shard_documents(docs.repartition(3), 4).collect())) == sorted(map(tuple, got))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_shards_are_even(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")).alias("text"), F.lit(1).alias("slot"))
    out = sharding.shard_rows(df, 16)
    sizes = [r.n for r in out.groupBy("shard").agg(F.sum(F.length("text") + 1).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.003 * sum(sizes) / 16 + 600
    same = spark.createDataFrame([(1, "same")] * 50 + [(None, None)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_documents(same).where("doc_id = 1").collect()) == list(range(50))


def test_mixing_budget(spark):
    rows = [(i, "w " * 10, "en" if i % 3 else "de", f"src{(0, 3, 12)[i % 3]}", 0, "") for i in range(900)]
    rows += [(None, None, None, None, None, None), (5000, "", "en", "src0", 0, "")]
    weights = {("web",): 0.0, ("news",): 3.0, ("books",): 1.0, ("other",): 1.0}
    out = mixing.mix(spark.createDataFrame(rows, DOCUMENT), weights, fraction=0.9, max_epochs=2.0)
    per = {r.mix_domain: r.n for r in out.groupBy("mix_domain").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
    # 9000 tokens, 8100 wanted: news takes three quarters of it but has 6000 in two epochs, books the rest
    assert per["web"] == 0 and per["news"] == 6000 and 2090 <= per["books"] <= 2100
    assert out.count() == len(rows) and mixing.repeat_copies(out, ["doc_id"]).count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix(spark.createDataFrame([], DOCUMENT), weights).count() == 0


def test_budgets_pass_by_a_leaf_of_weight_zero(spark):
    leaves = spark.createDataFrame([("books", "en", "src10", 33_000), ("books", "en", "src11", 1_000), ("books", "de", "src12", 66_000)], "mix_domain string, mix_lang string, mix_source string, tokens long")
    weights = {("books", "en"): 1.0, ("books", "de"): 3.0, ("books", "en", "src10"): 0.0}
    tree = ("mix_domain", "mix_lang", "mix_source")
    got = lambda total: {r.mix_source: r.budget for r in mixing.budgets(leaves, tree, weights, F.lit(total), 2.0).collect()}
    # src11 has 2,000 in two epochs; all the rest is for src12, which has 132,000
    assert got(80_000) == {"src10": 0, "src11": 2_000, "src12": 78_000}
    assert got(200_000) == {"src10": 0, "src11": 2_000, "src12": 132_000}


def test_mixing_of_odd_tables(spark):
    """Ids of letters, clashing columns, repeated rows and a long text."""
    rows = [(f"id{i}", "w " * (1 + i % 7), "en", f"src{i % 3}", 77, 5, 1) for i in range(300)] + [("id1", "w w", "en", "src1", 77, 5, 1), (None, "x " * 100_000, None, "src0", 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, copies int, n_tokens int, mix_domain int")
    out = mixing.mixture(docs, {("web",): 2.0}, fraction=0.9)
    assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r.copies for r in out.where("doc_id IS NOT NULL").collect()}
    assert got == {77} and 0 < out.count() <= 2 * len(rows)
    assert mixing.mix(docs, {}).count() == len(rows)


STAGE_ROWS = [
    (1, None, None, None, None, 1, "a", 2, 3, 4, 5, 6, 7), (2, "", "en", "src0", 0, 1, "a", 2, 3, 4, 5, 6, 7), (None, "null id with words. " * 30, "de", "src3", 5, 1, "a", 2, 3, 4, 5, 6, 7),
    *[(3, "the same row twice, with words in it. " * 3, "en", "src12", 9, 1, "a", 2, 3, 4, 5, 6, 7)] * 2,
    (4, "long " * 120_000, "en", "src1", 600_000, 1, "a", 2, 3, 4, 5, 6, 7),
    *[(i, f"Some text of number {i}, and no other text says {i * i} as this.", "en", f"src{i % 14}", 60, 1, "a", 2, 3, 4, 5, 6, 7) for i in range(10, 60)],
]
STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, items string, n_words int, score int, copies int, size int, node int, component int"


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parent.parent.parent / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("at", range(5))
def test_stages_of_odd_tables(spark, sf_dir, pipeline, at):
    docs = spark.createDataFrame(STAGE_ROWS, STAGE_SCHEMA).repartition(3)
    name, step = pipeline.STAGES[at]
    out = step(spark, docs, sf_dir)
    assert out.columns == [*docs.columns, *(["shard", "slot"] if name == "sharding" else [])]
    rows = out.collect()
    assert {r.items for r in rows} <= {"a"} and {r.size for r in rows} <= {5} and {(r.spans, r.n_words, r.score, r.copies) for r in rows} <= {(1, 2, 3, 4)}
    texts = {r[1] for r in STAGE_ROWS}
    assert {r.text for r in rows} <= texts and rows
    if name in ("near_dedup", "decontamination", "sharding"):
        assert len(rows) == len(STAGE_ROWS)
    assert step(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_chain_without_being_written(spark, sf_dir, pipeline):
    docs = spark.createDataFrame(STAGE_ROWS, STAGE_SCHEMA)
    assert pipeline.remove_benchmark(spark, pipeline.deduplicate(spark, docs, sf_dir), sf_dir).count() == len(STAGE_ROWS)


def test_tables_go_at_the_end(spark, docs):
    from gridloom.llm import common

    before = common.stored_paths()
    with common.temporary_tables(spark):
        assert near_dup.near_duplicates(docs).count() and len(common.stored_paths()) > len(before)
    assert common.stored_paths() == before
    ids = spark.range(100_000).withColumnRenamed("id", "k")
    some = ids.where("k % 7 = 1")
    for bits in (1 << 15, 1 << 27):
        common.FILTER_BITS, kept = bits, common.FILTER_BITS
        try:
            assert common.members(ids, some, "k").count() == some.count()
        finally:
            common.FILTER_BITS = kept


def test_pipeline(spark, sf_dir):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parent.parent.parent / "corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    results = {}
    for name, stage in pipeline.STAGES:
        docs, _ = pipeline.written(stage(spark, docs, sf_dir), name)
        results[name] = docs
        assert docs.columns[: len(columns)] == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= kept
        kept = ids
        if name == "near_dedup":
            assert docs.count() == len(ids)
            assert all(r[3] for r in components([(r.doc_id, r.text) for r in docs.collect()]))
    whole = pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
