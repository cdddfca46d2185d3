"""Mixing sources to target weights, with DataFrame functions only.

Each source is put in a fixed random order (by a digest of doc_id) and cut into blocks of about ``block_rows`` documents.
Its target of words is met by whole passes over the source and a part of one more. The copies of blocks that the passes
need are split among the output shards by a binary tree: at each node the left half's blocks are drawn without
replacement from what the node has, source by source (a multivariate hypergeometric draw), so that every shard's share
of every source is exact and random. A shard then gets the next disjoint run of permuted block copies of each source,
and its documents are ordered by a digest that is its own.

The driver gets one row a source and makes ``shards`` numbers for each: sources are the entries of a mixture, a table of
weights, not something that grows with the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import dropping, stage, text_key

WEIGHTS, CAP, SHARDS, BLOCK_ROWS, SHARD_BYTES, MOST_SHARDS = (5, 2, 1), 3, 16, 1024, 64 << 20, 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def digest(*parts: Column | str, seed: str = "mix") -> Column:
    """60 bits of the md5 of the parts, the same on any engine."""
    whole = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to (source, n_rows, source_size): shares of all words by weight, none above ``cap`` times its source.

    Sources that reach the cap are those whose cap a unit of weight is least; in that order a source is capped while its
    cap is no more than its share of what the capped ones before it leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("i", F.lit(len(weights))) + 1).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most").cast("double") / F.col("weight"), "i")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    share = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    capped = F.col("most").cast("double") * share.cast("double") <= F.col("weight").cast("double") * left.cast("double")
    marked = ranked.withColumn("capped", capped).withColumn("total", F.sum("source_size").over(everything))
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise((F.col("weight") * rest).cast("double") / open_weight.cast("double"))
    return marked.withColumn("target", target).select("source", "n_rows", "source_size", "target")


def split_quotas(blocks: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Block copies of each source (columns) for each shard (rows); exact in both sums, shards alike to one block."""
    quotas = np.zeros((shards, len(blocks)), np.int64)

    def part(first: int, after: int, have: np.ndarray) -> None:
        if after - first == 1:
            quotas[first] = have
            return
        middle = (first + after) // 2
        total = int(have.sum())
        draw = np.random.default_rng([seed, first, after])
        take = draw.multivariate_hypergeometric(have, total * (middle - first) // (after - first), method="marginals") if total else have
        part(first, middle, take)
        part(middle, after, have - take)

    part(0, shards, np.asarray(blocks, np.int64))
    return quotas


def running(rows: DataFrame, bucket: Column, what: str, name: str, *order: str) -> DataFrame:
    """Adds ``name``, the sum of ``what`` over the rows of the source that come before in ``order``.

    Buckets follow the order: sums of buckets are run up first, then rows within their bucket, so no task has a whole source.
    """
    rows = rows.withColumn("bucket_", bucket.cast("long"))
    sums = rows.groupBy(F.col("source").alias("s_"), F.col("bucket_").alias("b_")).agg(F.sum(what).alias("n_"))
    sums = sums.withColumn("before_", F.sum("n_").over(Window.partitionBy("s_").orderBy("b_")) - F.col("n_"))
    inside = F.sum(what).over(Window.partitionBy("source", "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(what)
    placed = rows.withColumn("inside_", inside).join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket_") == F.col("b_")))
    return placed.withColumn(name, F.col("before_") + F.col("inside_")).drop("s_", "b_", "n_", "before_", "inside_", "bucket_")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, whole: bool = False, seed: int = 0) -> DataFrame:
    """What the mix takes of each row: doc_id, text_key, source, size, source_size, target, takes (pass, words, shard).

    ``whole``: no part of a document is taken; the last one of a source is taken or not, whichever is nearer its target.
    Null texts have size 0 and are never taken; a null source is a source, the last one; rows that repeat are taken like
    any other. An empty table gives an empty plan. Extra columns don't matter.
    """
    with dropping(docs.sparkSession):
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"))
        rows = stage(rows.withColumn("key", digest("doc_id", "text_key" if whole else F.lit(""), seed=f"mix{seed}")), "mix-sizes")
        stats = targets(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), weights, cap)
        quota = F.floor(F.col("target") + 0.5).cast("long")
        passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
        stats = stats.withColumn("passes", passes).withColumn("more", quota - F.col("passes") * F.col("source_size"))
        stats = stage(stats.withColumn("n_blocks", F.ceil(F.col("n_rows") / F.lit(block_rows)).cast("long")), "mix-sources")
        same = stats["source"].eqNullSafe(rows["source"])
        block = F.shiftright(F.shiftright("key", 30) * F.col("n_blocks"), 30)
        placed = rows.join(F.broadcast(stats) if stats.count() <= 100_000 else stats, same).drop(stats["source"]).withColumn("block", block)

        sums = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.max("passes").alias("passes"), F.max("more").alias("more"))
        sums = stage(running(sums, F.shiftright("block", 10), "block_size", "block_before", "block"), "mix-blocks")

        # every copy of a block that some pass needs, in the source's own random order
        needed = F.col("passes") + F.when(F.col("block_before") < F.col("more"), 1).otherwise(0)
        copies = sums.where(needed > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), needed)))
        copies = copies.withColumns({"draw": digest("block", "pass", seed=f"block{seed}"), "one": F.lit(1).cast("long")})
        copies = running(stage(copies, "mix-copies"), F.shiftright("draw", 48), "one", "at", "draw", "block", "pass").withColumn("at", F.col("at") + 1)
        counted = [(r["source"], r["n"]) for r in copies.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()]
        quotas = split_quotas([n for _, n in counted], shards, seed).cumsum(axis=0)
        ends = spark.createDataFrame([(s, [int(x) for x in quotas[:, i]]) for i, (s, _) in enumerate(counted)], "source string, ends array<long>")
        dealt = copies.join(ends, copies["source"].eqNullSafe(ends["source"])).drop(ends["source"])
        dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))))
        shard_of = dealt.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("shards"))

        blocks = sums.select("source", "block", "block_before").join(shard_of.withColumnsRenamed({"source": "s_", "block": "b_"}), F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")), "left").drop("s_", "b_").withColumnsRenamed({"source": "s_", "block": "b_"})
        inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, 0)
        ordered = placed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        ordered = ordered.join(blocks, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_"))).drop("s_", "b_")
        room = F.col("more") - F.col("block_before") - F.col("inside")
        extra = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), room))
        every = F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("passes"))).otherwise(F.array().cast("array<long>"))
        full = F.transform(every, lambda p: F.struct(p.alias("pass"), F.col("size").alias("words")))
        takes = F.when(F.col("extra") > 0, F.concat(full, F.array(F.struct((F.col("passes") + 1).alias("pass"), F.col("extra").alias("words"))))).otherwise(full)
        takes = F.transform(takes, lambda t: F.struct(t["pass"].alias("pass"), t["words"].alias("words"), F.element_at("shards", t["pass"]).alias("shard")))
        made = ordered.withColumn("extra", extra.cast("long")).withColumn("takes", takes).select("doc_id", "text_key", "source", "size", "source_size", "target", "takes")
        return stage(made, "mix-plan", keep=True)


def taken(plan_: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row (the words of its copies that shards have drawn), and those shards."""
    drawn = F.filter("takes", lambda t: t["shard"].isNotNull())
    words = F.aggregate(drawn, F.lit(0).cast("long"), lambda n, t: n + t["words"])
    return plan_.select("doc_id", "size", "source_size", "target", words.alias("taken"), F.array_sort(F.transform(drawn, lambda t: t["shard"])).alias("shards"))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """row_ (the row of ``docs`` as a struct), mix_shard and mix_order of every copy in the mix."""
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    made = plan(docs, whole=True, **options).withColumn("take", F.explode("takes")).where(F.col("take.shard").isNotNull())
    made = made.groupBy("doc_id", "text_key", "source", F.col("take.pass").alias("pass")).agg(F.min("take.shard").alias("mix_shard"))
    made = made.withColumn("mix_order", digest("doc_id", "text_key", "pass", "mix_shard", seed="order"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id_"), text_key("text").alias("key_"), F.col("source").cast("string").alias("source_"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")) & F.col("source").eqNullSafe(F.col("source_"))
    return keyed.join(made, same).select("row_", "mix_shard", "mix_order")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: a row a copy, with ``mix_shard`` and ``mix_order`` (the order in its shard) in place of columns of those names.

    Documents are taken whole. Rows are matched to their plan by doc_id, text and source, so that rows alike in them share
    one. Empty and null texts have no words and are never taken; long ones are taken whole or not; a null source is a
    source, the last one; an empty table gives none.
    """
    own = [F.col(f"row_.`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_order")]
    return drawn(docs, **options).select(*own, "mix_shard", "mix_order")


def shuffled(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mix with the columns of ``docs``: a partition a shard, each in its own random order.

    Without a number there is a shard for every ``SHARD_BYTES`` of text, from ``SHARDS`` to ``MOST_SHARDS``.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(SHARDS, min(MOST_SHARDS, size // SHARD_BYTES))
    made = drawn(docs, shards=shards, **options).repartitionById(shards, F.col("mix_shard")).sortWithinPartitions("mix_order", "row_.doc_id")
    return made.select("row_.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix0:' || COALESCE(doc_id::VARCHAR, '') || ':'), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM r),
c AS (SELECT *, SUM(source_size) OVER () AS total,
        most::DOUBLE * (SUM(weight) OVER (ORDER BY most::DOUBLE / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
        <= weight::DOUBLE * (SUM(source_size) OVER () - (SUM(most) OVER (ORDER BY most::DOUBLE / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - most))::DOUBLE AS capped
      FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE
        ELSE (weight * (total - SUM(CASE WHEN capped THEN most ELSE 0 END) OVER ()))::DOUBLE / (SUM(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
      FROM c),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota,
        CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM t),
o AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.quota - q.passes * q.source_size AS more,
        SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM o
"""
