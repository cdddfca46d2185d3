"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

A rotation is learned (principal directions, then iterative quantisation) on a bounded sample; the signs of a rotated
vector are its code. Codes are cut into 16-bit substrings, each with its own table from value to rows. Within Hamming
radius r of a query, some substring differs in at most r // m bits (or one less: the pigeonholes of the first r % m + 1
and of the others), so probing every near value in every table finds every code within r. Those are scored with the
original numbers in double precision.

Norms may differ: rows are banded by norm, and the radius of a band is the one within which the sample's true
neighbours of that band lie, so that long vectors are found at wide angles and short ones only at narrow ones. Shards are
of one band and of bounded size; each is sent once, indexed once, and passed by the queries. A query with fewer than k
rows found is asked again with no radius. Vectors of other lengths than a few common ones are compared by brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import dropping, slots, stage

K, SAMPLE, SAMPLE_NUMBERS, ASKED, RECALL, PIECE, BANDS, LENGTHS = 20, 20_000, 1 << 21, 512, 0.97, 16, 8, 8
SHARD_ROWS, SHARD_NUMBERS = 1 << 17, 1 << 22


def usable(vectors: DataFrame, wanted: Column) -> DataFrame:
    """uid, vec_id, embedding, d (its length), norm, asks of the rows that take part: not null, no null or non-finite component, not zero."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.coalesce(wanted, F.lit(False)).alias("asks"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding", F.size("embedding").alias("d"), norm.alias("norm"), "asks")


@dataclass
class Codes:
    """The learned map from directions to codes, the norms that part the bands, and each band's radius (-1: not probed)."""

    map: np.ndarray
    bits: int
    edges: list[float]
    radii: list[int]

    @property
    def pieces(self) -> int:
        return -(-self.bits // PIECE)

    def of(self, x: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(x), 64), np.uint8)
        bits[:, : self.bits] = x @ self.map > 0  # signs don't depend on the norm
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def learn(sample: np.ndarray, k: int, recall: float = RECALL, bands: int = BANDS, seed: int = 0) -> Codes:
    norms = np.linalg.norm(sample, axis=1)
    rows = sample / norms[:, None]
    bits = min(64, sample.shape[1])
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(rows.T @ rows)
    base = vectors[:, ::-1][:, :bits]
    low = rows @ base
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(20):  # iterative quantisation
        u, _, vt = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (u @ vt).T
    edges = np.unique(np.quantile(norms, np.arange(1, bands) / bands))
    made = Codes(base @ turn, bits, edges.tolist(), [])
    asked = rng.choice(len(sample), min(ASKED, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf  # not itself
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    codes = made.of(sample)
    apart = np.bitwise_count(codes[asked][:, None] ^ codes[near])
    band = np.searchsorted(edges, norms[near], side="right")
    for b in range(len(edges) + 1):
        own = apart[band == b]
        made.radii.append(int(np.quantile(own, recall, method="higher")) if own.size else -1)
    return made


@lru_cache(PIECE + 1)
def masks(reach: int) -> np.ndarray:
    """All values of a substring with at most ``reach`` bits set."""
    every = np.arange(1 << PIECE, dtype=np.uint32)
    return every[np.bitwise_count(every) <= reach]


class Index:
    """Substring tables over a shard's codes: rows in order of value, where each value begins, and the values there are."""

    def __init__(self, codes: np.ndarray, pieces: int):
        self.codes, self.tables = codes, []
        for j in range(pieces):
            value = (codes >> np.uint64(PIECE * j)) & np.uint64((1 << PIECE) - 1)
            order = np.argsort(value, kind="stable")
            begins = np.concatenate([[0], np.cumsum(np.bincount(value.astype(np.int64), minlength=1 << PIECE))])
            self.tables.append((order, begins, np.flatnonzero(np.diff(begins)).astype(np.uint32)))

    def within(self, code: int, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits, all of them."""
        m, found = len(self.tables), []
        for j, (order, begins, present) in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            if reach < 0:
                continue
            own = np.uint32(code >> (PIECE * j) & ((1 << PIECE) - 1))
            probes = masks(min(reach, PIECE))
            values = probes ^ own if len(probes) < len(present) else present[np.bitwise_count(present ^ own) <= reach]  # the fewer
            first, sizes = begins[values], begins[values + 1] - begins[values]
            some = sizes > 0
            first, sizes = first[some], sizes[some]
            ends = np.cumsum(sizes)
            found.append(order[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)])
        hit = np.zeros(len(self.codes), bool)
        for rows in found:
            hit[rows] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ np.uint64(code)) <= radius]


def scores(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, each row's summed in one order wherever the row stands."""
    return np.add.reduce(x * vector, axis=1)


def best(rows: np.ndarray, score: np.ndarray, names: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores; ties to the smaller name."""
    if len(rows) > k:
        good = score >= np.partition(score, -k)[-k]
        rows, score = rows[good], score[good]
    order = np.lexsort((uids[rows], names[rows], -score))[:k]
    return rows[order], score[order]


FOUND = "query long, query_id long, uid long, vec_id long, score double, scored long"


def _search(codes: list[Codes | None], radii: list[int], which: list[int], k: int):
    """Search of shards: a partition has the rows of each of its shards (kind 0) and then the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = -1, [], None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1, [len(shard)]]) if len(shard) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(int(a), int(b - a))
                if shard[a] != now:
                    now, held, index = int(shard[a]), [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                learned = codes[which[now]]
                if index is None:
                    table = pa.Table.from_batches(held)
                    x, uids, names = _matrix(table.column("embedding").combine_chunks()), table.column("uid").to_numpy(), table.column("vec_id").combine_chunks()
                    order = names.fill_null(np.iinfo(np.int64).max).to_numpy()  # null last
                    index = Index(learned.of(x), learned.pieces) if learned is not None else object()
                q, asks, ids = _matrix(part.column("embedding")), part.column("uid").to_numpy(), part.column("vec_id").to_pylist()
                own = learned.of(q).tolist() if learned is not None else [0] * len(q)
                out: list[list] = [[], [], [], [], []]
                for code, vector, uid, query_id in zip(own, q, asks.tolist(), ids, strict=True):
                    rows = np.arange(len(x)) if radii[now] is None else index.within(code, radii[now])
                    rows = rows[uids[rows] != uid]
                    n = len(rows)
                    rows, score = best(rows, scores(x[rows], vector), order, uids, k)
                    for column, made in zip(out, ([uid] * len(rows), [query_id] * len(rows), rows, score, [n] + [0] * (len(rows) - 1) if len(rows) else []), strict=True):
                        column.extend(made)
                rows = np.array(out[2], np.int64)
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(uids[rows]), names.take(pa.array(rows)), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "uid", "vec_id", "score", "scored"])

    return run


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def nearest(vectors: DataFrame, wanted: Column, k: int = K, sample: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``wanted`` selects, itself left out.

    Ties go to the smaller vec_id, a null one last. Rows that :func:`usable` leaves out are neither queries nor found.
    Rows that repeat, or share a vec_id, are rows of their own, and each is asked where it is wanted. Vectors are compared
    with those of their own length, however long. A table of fewer rows gives all it has; an empty one gives nothing.
    Other columns don't matter. The driver gets at most ``sample`` rows, or ``SAMPLE_NUMBERS`` numbers, of each of up to
    ``LENGTHS`` lengths. ``report`` is given the share of rows that were scored.
    """
    with dropping(vectors.sparkSession):
        return stage(_nearest(vectors, wanted, k, sample, report), "nearest", keep=True)


def _nearest(vectors: DataFrame, wanted: Column, k: int, sample: int, report: dict | None) -> DataFrame:
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = stage(usable(vectors, wanted), "vectors")
    lengths = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).where((F.col("asked") > 0) & (F.col("n") > 1))
    common = lengths.orderBy(F.desc("n"), "d").limit(LENGTHS + 1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    codes, shards, places = [], [], []  # of a shard: (number in codes, radius); of a length: column of the shard's number
    for i, length in enumerate(common[:LENGTHS]):
        own = rows.where(F.col("d") == length["d"])
        most = max(2, min(sample, SAMPLE_NUMBERS // length["d"]))
        drawn = _matrix(own.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(most).select("embedding").toArrow().column(0).combine_chunks())
        codes.append(learn(drawn, k))
        size = max(1, min(SHARD_ROWS, SHARD_NUMBERS // length["d"]))
        place = None
        for b, radius in enumerate(codes[i].radii):
            parts = max(1, -(-length["n"] // (size * len(codes[i].radii))), min(slots(spark) // 4, length["n"] // (4096 * len(codes[i].radii))))
            number = F.lit(len(shards)) + F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
            shards += [(i, radius)] * parts
            here = F.col("norm") < codes[i].edges[b] if b < len(codes[i].edges) else F.lit(True)
            place = F.when(here, number) if place is None else place.when(here, number)
        places.append((F.col("d") == length["d"], place))
    if len(common) > LENGTHS:  # rare lengths: by brute force, a shard for some lengths
        codes.append(None)
        known = [r["d"] for r in common[:LENGTHS]]
        parts = 4 * slots(spark)
        places.append((~F.col("d").isin(known), F.lit(len(shards)) + F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int")))
        shards += [(LENGTHS, None)] * parts
    shard = places[0][1] if len(places) == 1 else None
    for here, number in places if shard is None else []:
        shard = F.when(here, number) if shard is None else shard.when(here, number)
    number = shard
    columns = ["uid", "vec_id", "embedding"]

    def search(asked: DataFrame, radii: list[int | None]) -> DataFrame:
        index = rows.where(places[0][0] if len(places) == 1 else F.lit(True)).select(number.alias("shard"), F.lit(0).alias("kind"), "d", *columns).where(F.col("shard").isNotNull())
        to = None  # the shards of a length, of those that are probed
        for i, length in enumerate(common[:LENGTHS]):
            own = F.array(*[F.lit(s) for s, (c, _) in enumerate(shards) if c == i and radii[s] != -1]).cast("array<int>")
            to = F.when(F.col("d") == length["d"], own) if to is None else to.when(F.col("d") == length["d"], own)
        to = to.otherwise(F.array(number)) if len(common) > LENGTHS else to
        passing = asked.select(F.explode(to).alias("shard"), F.lit(1).alias("kind"), "d", *columns)
        by_length = [codes[c] is None for c, _ in shards]
        both = index.union(passing)
        if any(by_length):  # lengths that share a shard follow each other as shards of their own
            both = both.withColumn("part", F.col("shard")).withColumn("shard", F.when(F.element_at(F.array(*map(F.lit, by_length)), F.col("shard") + 1), F.col("shard") + len(shards) * F.col("d")).otherwise(F.col("shard")))
        else:
            both = both.withColumn("part", F.col("shard"))
        placed = both.repartitionById(len(shards), F.col("part")).sortWithinPartitions("shard", "kind")
        made = _search(codes, _Wrapped(radii), _Wrapped([c for c, _ in shards]), k)
        return placed.select("shard", "kind", *columns).mapInArrow(made, FOUND)

    found = stage(search(rows.where("asks"), [r for _, r in shards]), "neighbours")
    asked = rows.where("asks").join(lengths.select("d", F.col("n").alias("n_")), "d")
    got = found.groupBy("query").agg(F.count("*").alias("got"))
    short = asked.join(got, F.col("uid") == F.col("query"), "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n_") - 1)).select(*rows.columns)
    short = stage(short, "neighbours-short")
    if not short.isEmpty():
        more = stage(search(short, [None] * len(shards)), "neighbours-more")
        found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti").select(*found.columns).union(more)
    if report is not None:
        counted = found.agg(F.sum("scored").alias("s")).first()["s"]
        report["scored"] = counted / max(1, asked.agg(F.sum(F.col("n_") - 1)).first()[0])
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Wrapped(list):
    """By shard number; a shard of a rare length is numbered beyond the end, round and round."""

    def __getitem__(self, i):
        return super().__getitem__(i % len(self))
