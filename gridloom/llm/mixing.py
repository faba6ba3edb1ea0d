"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down the tree domain -> language -> source.  At each node it
is shared among the children by weight; a child that cannot use its share leaves
the shortage to its siblings, and only what a whole subtree cannot use goes to
the siblings of its ancestor.  Each leaf then takes whole seeded epochs of its
documents and a token-prefix of the next one.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Rows meant for one bucket of a leaf's seeded order.
BUCKET_ROWS = 4_000


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """The domain of a source by the number at its end: 0 web, 1-9 news, 10 and up books, else other."""
    number = F.regexp_extract(source, r"(\d{1,6})$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n == 0, F.lit("web")).when(n < 10, F.lit("news")).when(n >= 10, F.lit("books")).otherwise(F.lit("other"))


def _weight(level: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The weight of a node by its path; 1 where none is given."""
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(level):
            here = F.lit(True)
            for column, value in zip(level, path, strict=True):
                here = here & (F.col(column) == F.lit(value))
            out = F.when(here, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, tree: Sequence[str], weights: Mapping[tuple[str, ...], float], total: Column, max_epochs: float) -> DataFrame:
    """``leaves`` (tree columns, tokens, docs) with ``budget``: whole tokens of each leaf.

    Shares are water-filled level by level from the root: siblings sorted by
    capacity per weight fill up one after another, and those left share the rest
    by weight.  A node's capacity is that of its leaves whose whole path has positive
    weight, so shortages stay among siblings as long as these can use them.
    """
    open_ = F.lit(True)
    for depth in range(1, len(tree) + 1):
        open_ = open_ & (_weight(tree[:depth], weights) > 0)
    nodes = leaves.withColumn("usable", F.when(open_, F.col("tokens")).otherwise(0))
    nodes = nodes.withColumn("cap0", F.floor(F.sum("usable").over(Window.partitionBy()) * max_epochs)).withColumn("share0", F.least(total.cast("double"), F.col("cap0").cast("double")))
    for depth in range(1, len(tree) + 1):
        path, parent = list(tree[:depth]), list(tree[: depth - 1])
        level = nodes.groupBy(*path).agg((F.sum("usable") * F.lit(float(max_epochs))).alias("cap"), F.first(f"share{depth - 1}").alias("above"))
        level = level.withColumn("weight", _weight(path, weights)).withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
        level = level.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
        family = Window.partitionBy(*parent)
        order = family.orderBy("ratio", tree[depth - 1])
        filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        level = level.withColumn("water", F.try_divide(F.col("above") - filled, rest))
        full = F.col("cap") <= F.col("water") * F.col("weight")
        surface = F.max(F.when(~full, F.col("water"))).over(family)
        share = F.when(full, F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.coalesce(surface, F.lit(0.0)) * F.col("weight")))
        nodes = nodes.join(level.select(*path, share.alias(f"share{depth}")), path)
    return nodes.withColumn("budget", F.floor(f"share{len(tree)}").cast("long")).drop("usable", "cap0", *[f"share{i}" for i in range(len(tree) + 1)])


def mix(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float],
    fraction: float = 0.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    domain: Column | None = None,
) -> DataFrame:
    """``docs`` with mix_domain, mix_lang, mix_source, n_tokens and copies (0: not taken).

    The budget is ``fraction`` of all tokens; ``weights`` maps paths (domain,),
    (domain, lang), (domain, lang, source) to weights, 1 where none is given; no
    leaf gets more than ``max_epochs`` of its tokens.  Epoch e of a leaf is
    ordered by md5(seed:e:doc_id), then doc_id; the prefix is the longest run of
    whole documents that fits.  Rows with one doc_id in one leaf go together.
    Null lang or source is the child "unknown", a null doc_id hashes as "", null
    and empty texts have 0 tokens; doc_ids of any type that has a text form will do.
    Repeated rows are documents of their own; very long texts count whole.  An
    empty table stays empty.  Columns of ``docs`` with the names of the five new
    ones are replaced (``mixture`` keeps them).  Leaves, never documents, pass
    through one task.
    """
    tree = ("mix_domain", "mix_lang", "mix_source")
    names = {
        "mix_domain": F.coalesce(source_domain(F.col("source")) if domain is None else domain, F.lit("unknown")),
        "mix_lang": F.coalesce("lang", F.lit("unknown")),
        "mix_source": F.coalesce("source", F.lit("unknown")),
    }
    own = [c for c in docs.columns if c not in (*tree, "n_tokens", "copies")]
    docs = docs.select(*own).withColumns(names)
    slim = stored(docs.select("doc_id", *tree, count_words(F.col("text")).alias("tokens")), "tokens")
    leaves = slim.groupBy(*tree).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = stored(leaves, "leaves")
    total = F.floor(F.sum("tokens").over(Window.partitionBy()) * F.lit(float(fraction)))
    plan = budgets(leaves.withColumn("total", total), tree, weights, F.col("total"), max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long"))
    plan = plan.select(*tree, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets"))
    plan = stored(plan, "plan")
    n_leaves = leaves.count()

    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.floor(F.conv(F.substring("seeded", 1, 12), 16, 10).cast("double") / float(2**48) * F.col("buckets"))
    rows = slim.join(small(plan, n_leaves), list(tree)).withColumn("seeded", seeded).withColumn("bucket", bucket)
    sums = rows.groupBy(*tree, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*tree).orderBy("bucket"))
    sums = sums.withColumn("upto", upto).where((F.col("upto") - F.col("tokens") <= F.col("rest")))
    last = sums.groupBy(*tree).agg(F.max_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), "bucket").alias("last"))
    edge = rows.join(small(last, n_leaves), list(tree)).where(F.col("bucket") == F.col("last.bucket"))
    # equal hashes are of equal doc_ids, but for a null and an empty one
    place = F.struct("seeded", F.col("doc_id").isNotNull().alias("known"))
    reached = F.sum("tokens").over(Window.partitionBy(*tree).orderBy("seeded", F.col("doc_id").isNotNull()))
    inside = edge.withColumn("fits", reached <= F.col("last.left"))
    cut = inside.groupBy(*tree).agg(
        F.max(F.when(F.col("fits"), place)).alias("cut"),
        F.first("last.bucket").alias("edge"),
    )
    plan = stored(plan.join(cut, list(tree), "left"), "cuts")
    seen = docs.join(small(plan, n_leaves), list(tree)).withColumn("seeded", seeded).withColumn("bucket", bucket)
    taken = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (place <= F.col("cut")))
    copies = F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")
    return seen.select(*own, *tree, count_words(F.col("text")).alias("n_tokens"), copies.alias("copies"))


def repeat_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixed corpus itself: every document as often as its copies say.

    Documents without copies, or with a null there, are left out; an empty table
    stays empty; nulls elsewhere, repeated rows and long texts pass through.
    """
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(*columns)


def mixture(docs: DataFrame, weights: Mapping[tuple[str, ...], float], fraction: float = 0.5, max_epochs: float = 2.0, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """The mixed corpus with exactly the columns of ``docs``, whatever their names; odd
    values are treated as in ``mix``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    packed = docs.select("doc_id", "lang", "source", "text", row) if domain is None else docs.select("doc_id", "lang", "source", "text", row, domain.alias("__domain"))
    mixed = mix(packed, weights, fraction, max_epochs, seed, None if domain is None else F.col("__domain"))
    return repeat_copies(mixed, ["__row"]).select("__row.*")
