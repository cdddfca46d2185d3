"""Line dedup over content-defined chunks of lines, with DataFrame functions only.

A text is cut at line feeds; each line has a digest, and rolling digests cover one or two lines. A chunk ends where the
rolling digest falls under a bound, so cuts depend on two lines at most and come back right after lines that were put in
or taken out. A short passage may have no cut at its ends, so texts are cut several times over, by independent digests
(``LEVELS``). Of chunks of two lines or more that occur more than once anywhere, in whichever cutting, all but the first
(least doc_id, then text key, then place) are removed, and a line goes with any of its chunks. The least place of a line
never loses it: each removal points to an earlier one.

Hashes only propose: chunks are grouped by their bytes before any is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import barrier, drop_stage, dropping, release, stage, text_key

#: (lines under the rolling digest, bound of its first hexadecimal digit: "8" cuts after every second line on average)
LEVELS, LEAST_LINES = ((1, "8"), (1, "8"), (2, "8")), 2


def with_chunks(docs: DataFrame, levels: tuple = LEVELS, least_lines: int = LEAST_LINES) -> DataFrame:
    """Adds ``lines_``, and ``chunks_``: begin, size and hash of the chunks of ``least_lines`` lines or more, each once."""
    made = barrier(docs, lines_=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    made = barrier(made, digests_=F.transform("lines_", lambda x: F.md5(x)))
    earlier = F.slice(F.concat(F.array(F.lit("")), F.col("digests_")), F.lit(1), F.size("digests_"))
    ends = {}
    for k, (over, bound) in enumerate(levels):
        rolled = F.col("digests_") if over == 1 else F.zip_with(earlier, "digests_", lambda a, b: F.concat(a, b))
        cut = F.transform(rolled, lambda r, i: F.when((F.substring(F.md5(F.concat(F.lit(f"{k}:"), r)), 1, 1) < bound) | (i == F.size("lines_") - 1), i + 1))
        ends[f"ends{k}_"] = F.filter(cut, lambda e: e.isNotNull())
    made = barrier(made, **ends)
    spans = []
    for name in ends:
        begins = F.concat(F.array(F.lit(0)), F.slice(name, F.lit(1), F.size(name) - 1))
        spans.append(F.filter(F.zip_with(begins, name, lambda b, e: F.struct(b.alias("begin"), (e - b).alias("size"))), lambda s: s["size"] >= least_lines))
    made = barrier(made, spans_=F.array_distinct(F.concat(*spans)))
    chunks = F.transform("spans_", lambda s: F.struct(s["begin"].alias("begin"), s["size"].alias("size"), F.xxhash64(F.slice("digests_", s["begin"] + 1, s["size"])).alias("hash")))
    return barrier(made, chunks_=chunks).drop("digests_", "spans_", *ends)


def removed_chunks(docs: DataFrame, levels: tuple = LEVELS, least_lines: int = LEAST_LINES) -> DataFrame:
    """doc_id, text_key, gone (begin, size of the removed chunks) of each document that loses some.

    Counts travel without text: only texts that have a chunk whose hash occurs again are cut, and of such chunks a
    partition sends each text once, to be grouped by its bytes. Rows alike in doc_id and text count once.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    place = ["doc_id", "text_key", "begin", "size"]
    rows = stage(with_chunks(source, levels, least_lines).select("doc_id", "text_key", F.inline("chunks_")).groupBy(*place, "hash").agg(F.lit(1).alias("one_")).drop("one_"), "chunks")
    again = rows.groupBy("hash").agg(F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    # what is joined here grows with the documents, so it is merged at every size and never broadcast
    wanted = stage(rows.join(again.hint("merge"), "hash"), "chunks-wanted")
    drop_stage(rows)
    release(spark)

    def cut(wanted: DataFrame) -> DataFrame:
        """The wanted chunks with their bytes."""
        cuts = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "size", "hash")).alias("cuts")).withColumnsRenamed({"doc_id": "id_", "text_key": "tk_"})
        joined = source.join(cuts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("tk_")))
        joined = barrier(joined.select("doc_id", "text_key", "text", "cuts"), lines_=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
        return joined.select("doc_id", "text_key", "lines_", F.inline("cuts")).select(*place, "hash", F.array_join(F.slice("lines_", F.col("begin") + 1, F.col("size")), "\n").alias("bytes"))

    here = F.struct("doc_id", "text_key", "begin", "size")
    # rows that repeat name one place, so the number of places is that of the wanted rows
    texts = cut(wanted).groupBy("hash", "bytes").agg(F.min(here).alias("first"), F.max(here).alias("last")).groupBy("hash").agg(F.count("*").alias("texts"), F.first("first").alias("first"), F.first("last").alias("last"))
    texts = stage(texts, "chunk-classes")
    release(spark)
    # a hash has one text, but for collisions: those are told apart by their bytes
    alone = wanted.join(texts.where((F.col("texts") == 1) & (F.col("first") != F.col("last"))).select("hash", "first"), "hash").where(~here.eqNullSafe(F.col("first"))).select(*place)
    shared = stage(wanted.join(texts.where("texts > 1").select("hash"), "hash"), "chunk-collisions")
    if not shared.isEmpty():
        bytes_ = stage(cut(shared), "chunk-bytes")
        firsts = bytes_.groupBy("hash", "bytes").agg(F.min(here).alias("first"))
        alone = alone.union(bytes_.join(firsts, ["hash", "bytes"]).where(~here.eqNullSafe(F.col("first"))).select(*place))
    gone = stage(alone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "size")).alias("gone")), "chunks-gone", keep=True)
    for done in (wanted, texts, shared):
        drop_stage(done)
    release(spark)
    return gone


def dedup_lines(docs: DataFrame, levels: tuple = LEVELS, least_lines: int = LEAST_LINES) -> DataFrame:
    """``docs`` with n_lines, n_removed_chunks, n_removed_lines and kept_text, in place of columns of those names.

    A null text is one empty line. Rows alike in doc_id and text are one document given twice: neither makes the other
    a repetition, and both lose the same chunks. Chunks of blank lines count like any other. Long texts are cut whole. An
    empty table gives an empty result. Column names that clash with those used here don't matter.
    """
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    with dropping(docs.sparkSession):
        gone = removed_chunks(docs, levels, least_lines).withColumnsRenamed({"doc_id": "id_", "text_key": "tk_"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    text = F.col("text").cast("string")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))
    joined = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("tk_")), "left")
    # the numbers of the removed lines, each once
    lost = F.array_distinct(F.flatten(F.transform(F.coalesce("gone", F.array().cast("array<struct<begin:int,size:int>>")), lambda c: F.sequence(c["begin"], c["begin"] + c["size"] - 1))))
    made = barrier(joined, lost_=lost, lines_=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    # lines are marked by one pass over both: a line's number is in the map or not
    made = barrier(made, marks_=F.map_from_arrays("lost_", F.transform("lost_", lambda _: F.lit(True))))
    kept = F.when(F.size("lost_") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter("lines_", lambda _, i: ~F.map_contains_key("marks_", i)), "\n"))
    counts = {"n_lines": F.size("lines_"), "n_removed_chunks": F.coalesce(F.size("gone"), F.lit(0)), "n_removed_lines": F.size("lost_")}
    new = {k: v.cast("long") for k, v in counts.items()} | {"kept_text": kept}
    return made.select(*[F.col(f"row_.`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def report(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: For doc_ids that don't repeat.
ORACLE = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n, md5(lines[i]) AS m FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
r AS (SELECT *, COALESCE(LAG(m) OVER (PARTITION BY doc_id ORDER BY i), '') AS before FROM l),
c AS ({" UNION ALL ".join(f"SELECT doc_id, i, line, {k} AS level, (substr(md5('{k}:' || {'m' if over == 1 else 'before || m'}), 1, 1) < '{bound}' OR i = n)::INT AS cut FROM r" for k, (over, bound) in enumerate(LEVELS))}),
k AS (SELECT *, SUM(cut) OVER (PARTITION BY doc_id, level ORDER BY i) - cut AS chunk FROM c),
g AS (SELECT doc_id, MIN(i) AS first, COUNT(*) AS size, string_agg(line, chr(10) ORDER BY i) AS bytes FROM k GROUP BY doc_id, level, chunk HAVING COUNT(*) >= {LEAST_LINES}),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY bytes ORDER BY doc_id, first) AS occurrence FROM (SELECT DISTINCT * FROM g)),
x AS (SELECT * FROM o WHERE occurrence > 1),
gone AS (SELECT DISTINCT doc_id, i FROM x, unnest(range(first, first + size)) AS u(i)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines,
       (SELECT COUNT(*) FROM x WHERE x.doc_id = d.doc_id) AS n_removed_chunks,
       (SELECT COUNT(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed_lines,
       sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
