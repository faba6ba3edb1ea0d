"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crf, decontaminate, html_text, mixing, near_dup, perplexity, repeats, sharding, surrogates
from .common import table

#: Weights of the mixing tree: by domain, language in a domain, source in both.
WEIGHTS = {
    ("web",): 2.0,
    ("news",): 1.0,
    ("books",): 1.0,
    ("other",): 0.5,
    ("web", "en"): 4.0,
    ("news", "en"): 2.0,
    ("books", "de"): 3.0,
    ("news", "en", "src3"): 4.0,
    ("books", "en", "src10"): 0.0,
}
#: Share of the corpus's tokens that the mixture holds, and epochs a leaf may give.
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.5, 2.0, 17


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op3_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


#: Key of the surrogates; a deployment passes its own.
SURROGATE_KEY = "example key"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return surrogates.pseudonymise(docs.select("doc_id", "text"), SURROGATE_KEY)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "n_tokens", "copies")


def op7_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lsh_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
ESCAPE_CONVERSATION = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "conv_id long, turn long, role string, text string"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("conv_id", "turn", "role", "text"), row, strict=True)]) for row in ESCAPE_CONVERSATION])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t) for c, t in (x.split() for x in kind.split(", "))]).unionByName(extra)
    parsed = chat.chat_parse(chat.chat_format(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "turn_order_valid",
    )


def op10_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {**named, "pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
