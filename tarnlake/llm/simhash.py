"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: a bit is 1 where more than half of the document's shingle hashes have it. Two fingerprints
that differ in at most ``radius`` bits agree, in at least one of m groups of bits, to within that group's threshold, if
the thresholds sum to radius - m + 1. Groups collect bits that vary together on a bounded sample of fingerprints, and
the thresholds (-1: the group isn't probed) are those of least estimated cost, found by dynamic programming.

Fingerprints are unique before any pairing, so copies never meet. A row is indexed by each probed group's value, probes
send every value within the threshold, and rows that meet are compared in full. Neighbours in the index are compared
first; probes then look only for links between the components that these make, and of such links one for each two
components is kept: so a dense cluster gives about as many links as it has members, not as many as it has pairs. Where more than ``crowd`` fingerprints
share a group's value, index and probe carry the value of one of radius + 1 parts of the other bits too: what is left of
the radius can't touch them all. That is exact as well, so there is no cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_stage, dropping, release, stage, text_key
from tarnlake.llm.components import components

SHINGLE, RADIUS, SAMPLE, CROWD = 4, 4, 20_000, 4096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 where it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    held: list[int] = []
    for a, b in spans:
        held.append(xxh64_intdigest(joined[a:b], 42))
        if len(held) == 1 << 16:
            total += _bits(held)
            held = []
    if held:
        total += _bits(held)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long). Null texts have no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


# ---------------------------------------------------------------- the plan of groups and thresholds


def bit_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size: each begins with the free bit least tied to others and takes the bits most tied to it."""
    n, width = bits.shape
    if n > 1:
        centred = bits - bits.mean(0)
        scale = np.sqrt((centred**2).sum(0))
        tie = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    else:
        tie = np.zeros((width, width))
    free, groups = list(range(width)), []
    for k in range(m):
        size = len(free) // (m - k)
        first = free[int(np.argmin(tie[np.ix_(free, free)].sum(1)))]
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = free[int(np.argmax(tie[np.ix_(free, group)].sum(1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def thresholds(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Least cost with one threshold a group summing to ``total``; cost[i, t + 1] is group i's at threshold t from -1."""
    m, wide = cost.shape
    low = -m
    best = np.full(total - low + 1, np.inf)
    best[-low] = 0.0
    choice = []
    for i in range(m):
        nxt, via = np.full_like(best, np.inf), np.zeros(len(best), int)
        for s in range(len(best)):
            for t in range(wide):
                p = s - (t - 1)
                if 0 <= p < len(best) and best[p] + cost[i, t] < nxt[s]:
                    nxt[s], via[s] = best[p] + cost[i, t], t
        best = nxt
        choice.append(via)
    at, found = total - low, []
    for via in reversed(choice):
        found.append(int(via[at]) - 1)
        at -= found[-1]
    return float(best[total - low]), found[::-1]


def make_plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to probe, for n fingerprints of which ``sample`` (uint64) is a part."""
    sample = np.unique(sample)
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    best: tuple[float, list] = (np.inf, [])
    for m in range(2, radius + 2):
        groups = bit_groups(bits[:5000], m)
        wide = radius - m + 3
        cost = np.zeros((m, wide))
        for i, g in enumerate(groups):
            value = _value(sample, g)
            seen, count = np.unique(value, return_counts=True)
            for t in range(0, wide - 1):
                masks = sum(comb(len(g), k) for k in range(t + 1))
                # pairs that meet: what the sample shows among its own values, and chance for what it is too small to show
                meet = max(0.0, float((count.astype(float) ** 2).sum() - len(sample)) / max(1, len(sample)) ** 2) * masks if t == 0 else _near(seen, count, t, len(g)) / max(1, len(sample)) ** 2
                meet = max(meet, masks / 2.0 ** len(g))
                cost[i, t + 1] = 4.0 * n * masks + float(n) * n * meet
        price, found = thresholds(cost, radius - m + 1)
        if price < best[0]:
            best = (price, [(g, t) for g, t in zip(groups, found, strict=True) if t >= 0])
    return best[1]


def _value(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _near(seen: np.ndarray, count: np.ndarray, t: int, width: int) -> float:
    """Pairs of sample rows whose group values differ in at most t bits (t up to 2 is looked up, beyond it is scaled)."""
    total = float((count.astype(float) ** 2).sum() - count.sum())
    for k in range(1, min(t, 2) + 1):
        for flips in combinations(range(width), k):
            other = seen ^ np.uint64(sum(1 << f for f in flips))
            at = np.minimum(np.searchsorted(seen, other), len(seen) - 1)
            total += float((count * np.where(seen[at] == other, count[at], 0)).sum())
    return total * (sum(comb(width, k) for k in range(t + 1)) / sum(comb(width, k) for k in range(3)) if t > 2 else 1.0)


# ---------------------------------------------------------------- links


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def links(unique: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, crowd: int = CROWD, every: bool = False) -> DataFrame:
    """(a, b) of pairs of fingerprints (column fp, unique) that differ in at most ``radius`` bits.

    They connect all fingerprints that any such pairs connect; ``every``: all such pairs, with a < b.
    """
    n = unique.count()
    if n < 2:
        return unique.sparkSession.createDataFrame([], "a long, b long")
    drawn = unique.select("fp").orderBy(F.xxhash64("fp")).limit(sample).toArrow().column(0).to_numpy()  # at most `sample` longs
    chosen = make_plan(np.ascontiguousarray(drawn).view(np.uint64), n, radius)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius

    keyed = F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(_signed(_mask(g))).alias("value"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("rest")) for i, (g, _) in enumerate(chosen)])
    rooted, first = unique.select("fp", F.col("fp").alias("root")), None
    if not every:
        before = F.lag("fp").over(Window.partitionBy("g", "value").orderBy("fp"))
        first = stage(rooted.select("fp", F.inline(keyed)).select(before.alias("a"), F.col("fp").alias("b")).where(close).distinct(), "simhash-first")
        if not first.isEmpty():
            rooted = stage(unique.select("fp").join(components(first, "simhash-first"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    index = rooted.select("fp", "root", F.inline(keyed))
    crowded = index.groupBy("g", "value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("n") > crowd)
    crowded = stage(crowded.select("g", "value", F.lit(True).alias("full"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("only")), "simhash-crowded")
    probes = []
    for i, (g, t) in enumerate(chosen):
        flips = [_signed(_mask(list(f))) for k in range(t + 1) for f in combinations(g, k)]
        flipped = rooted.select("fp", "root", F.lit(i).alias("g"), F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip"))
        probes.append(flipped.select("fp", "root", "g", F.col("fp").bitwiseAND(_signed(_mask(g))).bitwiseXOR(F.col("flip")).alias("value")))
    probe = probes[0]
    for p in probes[1:]:
        probe = probe.union(p)
    probe = probe.withColumns({"part": F.lit(0), "rest": F.lit(0).cast("long")})
    if not crowded.isEmpty():
        index = _refined(index, crowded, chosen, radius)
        probe = _refined(probe, crowded, chosen, radius, own=False)
    met = probe.withColumnsRenamed({"fp": "a", "root": "ra"}).join(index.withColumnsRenamed({"fp": "b", "root": "rb"}), ["g", "value", "part", "rest"])
    met = met.where((F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & close)
    if every:
        return met.select("a", "b").distinct()
    cross = met.groupBy(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")).agg(F.min(F.struct("a", "b")).alias("pair"))
    return first.union(cross.select("pair.a", "pair.b"))


def _refined(rows: DataFrame, crowded: DataFrame, chosen: list, radius: int, own: bool = True) -> DataFrame:
    """Rows at crowded values once for each of radius + 1 parts of the other bits, with that part's bits; ``own``: those where all have the row's root too."""
    parts = None
    for i, (g, _) in enumerate(chosen):
        other = [b for b in range(64) if b not in set(g)]
        cut: Column = F.array(*[F.struct(F.lit(k + 1).alias("part"), F.col("fp").bitwiseAND(_signed(_mask(other[k :: radius + 1]))).alias("rest")) for k in range(radius + 1)])
        parts = F.when(F.col("g") == i, cut) if parts is None else parts.when(F.col("g") == i, cut)
    marked = rows.select("fp", "root", "g", "value").join(crowded, ["g", "value"], "left")
    if not own:
        marked = marked.where(F.col("only").isNull() | (F.col("only") != F.col("root")))
    none = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("rest")))
    return marked.select("fp", "root", "g", "value", F.inline(F.when(F.col("full"), parts).otherwise(none)))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, fp, component_id (the least doc_id reachable) of every document.

    Null and empty texts have fingerprint zero and group like any other; a null doc_id is never a component's id while
    the component has others. Rows that repeat share their group. An empty table gives an empty result; other columns
    don't matter. Only at most ``sample`` fingerprints and counts reach the driver.
    """
    with dropping(docs.sparkSession):
        made = stage(fingerprints(docs, shingle), "simhash-fingerprints")
        unique = stage(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
        found = stage(links(unique.select("fp"), radius, sample, crowd), "simhash-links")
        if found.isEmpty():
            named = unique.select("fp", F.col("least").alias("component_id"))
        else:
            rooted = unique.join(components(found, "simhash-components"), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
            least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
            named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
        return stage(made.join(named, "fp"), "simhash-groups", keep=True)


def report(grouped: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity, for filtering

NEAR_SHINGLE, SIMILARITY = 5, 0.8
COMMON_TEXTS, COMMON_LEAST, COMMON, LIST = 20_000, 3, 100_000, 4096


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct signed hashes of a text's word shingles, ascending; the whole text where it has fewer words, nothing where it has none."""
    from xxhash import xxh64_intdigest

    words = np.array([xxh64_intdigest(w, 42) for w in (text or "").encode().translate(LOWER).split()], np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    long = min(shingle, len(words))
    n = len(words) - long + 1
    made = np.full(n, long, np.uint64)
    for k in range(long):
        made = (made ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        made ^= made >> np.uint64(29)
    return np.unique(made.view(np.int64))


def _prefix(n: int, overlap: float) -> int:
    """How many of n ordered shingles must hold one of at least ``overlap`` * n shared ones."""
    return n - ceil(overlap * n - 1e-9) + 1 if n else 0


def parity(s: np.ndarray) -> bytes:
    """A power of two of bits, four a shingle or more: bit i says whether an odd number of hashes is i modulo the width.

    Two sets' bits differ in at most as many places as the sets have shingles apart; halves laid over each other are the
    bits of half the width.
    """
    width = max(256, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 256
    return np.packbits((np.bincount(s & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    if len(x) > len(y):
        x, y = y, x
    low, high = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    width = 8 * len(y)
    while width > 8 * len(x):
        width //= 2
        high = (high >> width) ^ (high & ((1 << width) - 1))
    return (low ^ high).bit_count()


def _common(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles met most in a bounded sample of the texts. They only order shingles: no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(shingle_hashes(t, shingle))
                size += len(held[-1])
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["s"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["s"])

    share = max(1, keyed.count() // COMMON_TEXTS)
    drawn = keyed.where(F.pmod("text_key", F.lit(share)) == 0).select("text").mapInArrow(run, "s long")
    met = drawn.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST)
    most = met.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    hashes, counts = (most.column(c).to_numpy() for c in ("s", "n"))
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _sets(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_key, set_key (hash of the text's shingle set), n (its size), fp (its SimHash), bits (its parity), prefix (its rarest shingles, rarest first)."""
    known, counts = _common(keyed, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                rows = []
                for t in batch.column(2).to_pylist():
                    s = shingle_hashes(t, shingle)
                    fp = np.packbits(2 * _bits(s.view(np.uint64)) > len(s)).view(">i8")[0] if len(s) else 0
                    rows.append([xxh64_intdigest(s.tobytes(), 42), len(s), fp, parity(s)])
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                    rows[-1].append(s[: _prefix(len(s), similarity)])
                keys, sizes, fps, bits, prefixes = zip(*rows, strict=True)
                columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.int64)), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "set_key", "n", "fp", "bits", "prefix"])

    return keyed.mapInArrow(run, "doc_id long, text_key long, set_key long, n int, fp long, bits binary, prefix array<long>")


def _meetings(unique: DataFrame, similarity: float) -> DataFrame:
    """id, k, n, at: the sets k (of n shingles) that have one shingle in their prefixes, at their place ``at``, under one id.

    Near copies meet at many shingles in the same company, so a list of up to ``LIST`` sets goes by the hash of its
    members, and once, with the places of its first shingle: that is the first for all of them, since the order of
    shingles is the same in every set. Longer ones go by their shingle and pass through row by row. Of two sets as
    similar, the lesser shares one of its first n - 2 s / (1 + s) n + 1 shingles; lists without such a place are left out.
    """
    shared = 2 * similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: dict[int, int] = {}
        held: list[np.ndarray] | None = None
        through = None  # the shingle of a long list that is under way

        def rows(parts: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
            ids = np.concatenate([np.full(len(c[0]), i, np.uint64) for i, c in parts]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([c[j] for _, c in parts])) for j in (1, 2, 3))], names=["id", "k", "n", "at"])

        def lists(columns: list[np.ndarray], begins: list[int], ends: list[int]) -> Iterator[pa.RecordBatch]:
            parts = []
            for a, b in zip(begins, ends, strict=True):
                own = [c[a:b] for c in columns]
                s = int(own[0][0])
                if s == through or b - a > LIST:
                    parts.append((xxh64_intdigest(s.to_bytes(8, "little", signed=True), 7), own))
                elif b - a > 1 and (own[2] - own[3] >= shared * own[2] - 1e-6).any():
                    name, place = xxh64_intdigest(own[1].tobytes(), 42), int(own[3][0])
                    if seen.get(name, place + 1) > place:
                        if len(seen) == 1 << 16:
                            seen.clear()
                        seen[name] = place
                        parts.append((name, own))
            if parts:
                yield rows(parts)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            begins = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist()]
            yield from lists(columns, begins[:-1], begins[1:])
            held = [c[begins[-1] :].copy() for c in columns]
            if len(begins) > 1:
                through = None
            if len(held[0]) > LIST:
                through = int(held[0][0])
                yield from lists(held, [0], [len(held[0])])
                held = None
        if held is not None:
            yield from lists(held, [0], [len(held[0])])

    rows = unique.select("set_key", "n", F.posexplode("prefix").alias("at", "s")).select("s", F.col("set_key").alias("k"), "n", "at")
    rows = rows.repartition("s").sortWithinPartitions("s", "n", "k")
    return rows.mapInArrow(run, "id long, k long, n int, at int").groupBy("id", "k").agg(F.first("n").alias("n"), F.min("at").alias("at"))


def _may(similarity: float) -> Column:
    """Whether the sets x and y of a list, x the lesser, can be as similar. Where the list's shingle is the first that they
    share, all others come after it in both; where it isn't, they meet in the first one's list too."""
    least = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    return (F.col("x.n") >= similarity * F.col("y.n") - 1e-9) & (F.col("x.n") - F.col("x.at") >= least) & (F.col("y.n") - F.col("y.at") >= least)


def _pair() -> list[Column]:
    return [F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")]


def _proposed(tied: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of sets of one list (id, k, n, at, root) that can be as similar and have different roots."""
    sides = [tied.select("id", F.struct("k", "n", "at", "root").alias(x)) for x in "xy"]
    order = [F.struct(f"{x}.n", f"{x}.k") for x in "xy"]
    return sides[0].join(sides[1], "id").where((order[0] < order[1]) & (F.col("x.root") != F.col("y.root")) & _may(similarity)).select(*_pair()).distinct()


def near_copies(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, root of every document: the root is the same for all of a group of copies and near copies.

    A link is a Jaccard similarity of ``similarity`` or more between the sets of word shingles, and all links count.
    Texts of equal sets are one node. SimHash fingerprints of the sets within ``radius`` bits propose the first pairs;
    since sets as similar may differ in more bits than can be probed, a prefix filter proposes all others: of two such
    sets, the rarest n - similarity * n + 1 shingles of each have one in common. Neighbours by size among the sets that
    share one are compared with the first pairs; of the rest only those that this hasn't joined. Pairs whose parity bits
    prove them too far apart are dropped, all others are compared shingle by shingle. Null and empty texts are copies of
    each other. Rows that repeat are copies too. Texts and sets go by 64-bit hashes: of 10^9 different texts, two share one
    with a chance of 1 in 40, and count as copies then.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    made = stage(_sets(keyed, shingle, similarity), "near-sets")
    unique = stage(made.groupBy("set_key").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")]), "near-unique")
    groups = made.select("doc_id", "text_key", "set_key")
    release(spark)
    members = stage(_meetings(unique, similarity), "near-lists")
    release(spark)

    def near_enough(pairs: DataFrame) -> DataFrame:
        """Without the pairs that are too far apart by their sizes and parity bits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = (1 - similarity) / (1 + similarity)
            for batch in batches:
                na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
                keep = pa.array([bits_apart(p, q) <= most * (m + n) + 1e-6 for m, n, p, q in zip(na, nb, x, y, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        left, right = (unique.select(F.col("set_key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
        sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
        return stage(sized.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long"), "near-pairs")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "s"])

    def alike(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct().join(unique.select("set_key", F.col("text_key").alias("k_")), "set_key")
        texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"))  # copies go before they are shuffled
        sets = stage(texts.join(involved, F.col("text_key") == F.col("k_")).select("set_key", "text").mapInArrow(sets_of, "set_key long, s array<long>"), "near-shingles")
        release(spark)
        left, right = (sets.select(F.col("set_key").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        found = pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9)
        found = stage(found.select("a", "b"), "near-links")
        drop_stage(sets)
        release(spark)
        return found

    ahead = F.lag(F.struct("k", "n", "at")).over(Window.partitionBy("id").orderBy("n", "k")).alias("x")
    steps = members.select(ahead, F.struct("k", "n", "at").alias("y")).where(F.col("x").isNotNull() & _may(similarity)).select(*_pair())
    first = near_enough(_fingerprint_pairs(unique, radius).union(steps).distinct())
    release(spark)
    found = alike(first)
    tied = members
    if not found.isEmpty():
        tied = tied.join(components(found, "near-first"), F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k")).drop("node")
    else:
        tied = tied.withColumn("root", F.col("k"))
    tied = stage(tied, "near-members")
    drop_stage(members)
    apart = tied.groupBy("id").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("id")
    other = near_enough(_proposed(tied.join(apart, "id"), similarity).join(first, ["a", "b"], "left_anti"))
    release(spark)
    if not other.isEmpty():
        found = found.union(alike(other))
    if found.isEmpty():
        return groups.withColumnRenamed("set_key", "root")
    rooted = groups.join(components(found, "near-components"), F.col("set_key") == F.col("node"), "left")
    return rooted.select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))


def _fingerprint_pairs(unique: DataFrame, radius: int) -> DataFrame:
    """(a, b): sets of like fingerprints, one of each fingerprint with the others of it, and with one of each linked fingerprint."""
    heads = unique.groupBy("fp").agg(F.min("set_key").alias("head"))
    same = unique.join(heads, "fp").where(F.col("set_key") != F.col("head")).select(F.col("head").alias("a"), F.col("set_key").alias("b"))
    linked = links(heads.select("fp"), radius)
    left, right = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    linked = linked.join(left, "a").join(right, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return same.union(linked)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: the least doc_id (a null one only where all are).

    Rows that repeat are copies. Null and empty texts are one group. Long texts are compared whole. An empty table gives
    none. Column names that clash with those used here don't matter.
    """
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    with dropping(docs.sparkSession):
        made = near_copies(docs, **options).groupBy("root").agg(least.alias("k"))
        kept = stage(made.select(F.col("k.doc_id").alias("id_"), F.col("k.text_key").alias("key_")), "near-kept", keep=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))
    one = keyed.join(kept, same, "left_semi").groupBy("doc_id", "text_key").agg(F.first("row_").alias("row_"))
    return one.select("row_.*")
