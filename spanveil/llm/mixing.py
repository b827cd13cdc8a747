"""Mixing sources to target weights by Pareto order sampling.

Targets: a total is shared among sources by weight; no source gets more than ``most`` times its own size, and what it
can't take goes to the others by weight, until none is above. A document's expected copies are its source's target over
its source's size. The whole part is certain; the rest is its inclusion probability p. For p, documents are ranked by
random odds over inclusion odds, (U / (1 - U)) / (p / (1 - p)), and the first ones are taken until the source's words
are reached, so the size is fixed in words: it misses the target by at most half a document.

Scale: the cut of each source is found on a narrow table (source, size, rank) in three rounds of counting: 4,096 ranges
of ranks, 4,096 ranges within the one that holds the cut, then its few ranks. No window or sort holds a source.
A document's copies follow from its own columns and its source's cut; texts are never shuffled. Ranks come from a
digest of the id and a seed, so reruns agree and rows with the same id share their fate.

Nulls: a null text has size 0; null sources are one source, the last one; a null id is ranked as an empty id. A source
without words takes nothing. An empty table gives no sources and no rows. Columns of any other name are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanveil.llm.common import column, kept, packed, text_of, unpacked

WEIGHTS = (5, 2, 1)
BITS = 12  # bits of a rank that one round of counting settles
SOURCES_IN_PLAN = 100_000  # beyond so many sources (a few MB) their table is shuffled instead of broadcast


def size_of(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _uniform(id_: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    The common level (words per unit of weight) rises as sources reach their limit; each turn of the loop is one
    aggregate of the table of sources, and only its sums reach the driver.
    """
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    table = kept(
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)) + 1))
    )
    limit, total = most * F.col("source_size"), None
    level, last = 0.0, -1.0
    while level != last:
        full = limit <= level * F.col("weight") if last >= 0 else F.lit(False)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        total = share * (row["total"] or 0)
        last, level = level, (total - row["used"]) / row["open"] if row["open"] else level
    return table.select("source", "source_size", F.least(limit, level * F.col("weight")).alias("target"))


def mixing_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per source: source, source_size, target, certain (whole copies), p and cut (the last rank taken)."""
    rows = kept(
        docs.select(
            column(source_column).alias("source"), size_of(text_of(text_column)).alias("size"),
            _uniform(column(id_column), seed).alias("u"),
        )
    )
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = kept(
        targets.withColumn("certain", F.floor(rate)).withColumn("p", rate - F.col("certain"))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    )
    ranked = kept(
        _with_source(rows, sources.where("p > 0").select("source", "p", "rest"))
        .withColumn("rank", _rank(F.col("u"), F.col("p"))).select("source", "size", "rank", "rest")
    )
    found = sources.where("p > 0").select("source", F.lit(0).cast("bigint").alias("range"), F.lit(0.0).alias("before"))
    by_source = W.partitionBy("source")
    for shift in (2 * BITS, BITS):
        ranges = (
            _inside(ranked, found, shift + BITS)
            .groupBy("source", "rest", F.shiftright("rank", shift).alias("range"))
            .agg(F.sum("size").alias("words"), F.first("start").alias("start"))
        )
        before = F.col("start") + F.sum("words").over(by_source.orderBy("range")) - F.col("words")
        found = kept(
            ranges.withColumn("before", before).where(F.col("before") <= F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("range", "before")).alias("at"))
            .select("source", F.col("at.range").alias("range"), F.col("at.before").alias("before"))
        )
    last = (
        _inside(ranked, found, BITS).groupBy("source", "rest", "rank")
        .agg(F.sum("size").alias("words"), F.first("start").alias("start"))
    )
    before = F.col("start") + F.sum("words").over(by_source.orderBy("rank")) - F.col("words")
    cuts = (
        last.withColumn("before", before).where(F.col("before") + F.col("words") / 2 <= F.col("rest"))
        .groupBy("source").agg(F.max("rank").alias("cut"))
    )
    edges = found.select("source", (F.shiftleft("range", BITS) - 1).alias("edge"))
    return kept(
        _null_safe(_null_safe(sources, edges), cuts)
        .select(
            "source", "source_size", "target", "certain", "p",
            F.coalesce("cut", "edge", F.lit(-1).cast("bigint")).alias("cut"),
        )
    )


def with_copies(
    docs: DataFrame,
    plan: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """doc (the whole row as a struct) and mix (size, source_size, target, copies) of every document."""
    sources = plan.select(F.col("source").alias("plan_source"), F.struct("source_size", "target", "certain", "p", "cut").alias("plan"))
    if plan.count() <= SOURCES_IN_PLAN:
        sources = F.broadcast(sources)
    rows = docs.select(
        packed(docs), column(source_column).alias("own_source"), size_of(text_of(text_column)).alias("size"),
        _uniform(column(id_column), seed).alias("u"),
    )
    extra = (F.col("plan.p") > 0) & (_rank(F.col("u"), F.col("plan.p")) <= F.col("plan.cut"))
    copies = (F.col("plan.certain") + F.when(extra, 1).otherwise(0)).cast("int")
    return rows.join(sources, F.col("own_source").eqNullSafe(F.col("plan_source"))).select(
        "doc", F.struct("size", "plan.source_size", "plan.target", copies.alias("copies")).alias("mix")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    names = {k: options[k] for k in ("id_column", "text_column", "source_column", "seed") if k in options}
    chosen = with_copies(docs, mixing_plan(docs, **options), **names)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mix.copies")))
    return unpacked(chosen.select("doc", copies.alias("copy")), docs.columns)


def _rank(u: Column, p: Column) -> Column:
    """Pareto's ranking variable q = odds(u) / odds(p) as q / (1 + q), in 3 * BITS bits: the same order."""
    return F.floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * float(1 << 3 * BITS))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    if sources.count() <= SOURCES_IN_PLAN:
        sources = F.broadcast(sources)
    right = sources.withColumnRenamed("source", "__source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _inside(ranked: DataFrame, found: DataFrame, shift: int) -> DataFrame:
    """The rows whose rank lies in their source's range of the previous round, with the words before that range."""
    at = found.select("source", F.col("range").alias("__range"), F.col("before").alias("start"))
    return _with_source(ranked, at).where(F.shiftright("rank", shift) == F.col("__range")).drop("__range")
