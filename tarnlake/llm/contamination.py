"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, each text scanned once.

Windows of an item overlap, so not they are the automaton's patterns but its aligned blocks of half a window: every
window holds a whole one. A block that is met is extended word by word; it counts where a whole window agrees. So the
automaton has about as many nodes as the benchmark has bytes.

Texts are normalised byte by byte (A-Z to a-z, every ASCII character that is neither letter nor digit to a space) and
their words joined by single spaces; a window is a word-aligned string of the normalised text. The words' places in the
original are kept as arrays, so a hit maps back to byte offsets of the text as given.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import stage

WINDOW = 13
KEEP = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PART_BYTES, GROUP_BYTES, HELD_BYTES = 2 << 20, 64 << 20, 64 << 20  # benchmark text in an automaton, in a pass; text held by a task of several automata


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(KEEP).split()


class Benchmark:
    """The automaton over `` w1 w2 ... `` of the items' blocks, with the places of each: (item, first word)."""

    def __init__(self, items: list[tuple], n: int = WINDOW):
        import ahocorasick

        self.n, self.block = n, (n + 1) // 2
        self.ids, self.words = [i for i, _ in items], [words_of(t) for _, t in items]
        found: dict[bytes, list] = {}
        for item, words in enumerate(self.words):
            if len(words) < n:
                starts, size = [0] if words else [], len(words)
            else:
                starts, size = range(0, len(words) - self.block + 1, self.block), self.block
            for k in starts:
                found.setdefault(b" ".join(words[k : k + size]), []).append((item, k, size))
        self.automaton = ahocorasick.Automaton()
        for w, places in found.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, places))
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)

    def run(self, text: list[bytes], first: int, item: int, k: int, size: int) -> tuple[int, int] | None:
        """The words of ``text`` that agree with the item around a block met at ``first``, if a whole window does."""
        own = self.words[item]
        if len(own) < self.n:
            return (first, first + size) if size == len(own) else None
        a, room = first, min(self.n - size, k, first)
        while first - a < room and text[a - 1] == own[k - (first - a) - 1]:
            a -= 1
        b, more = first + size, k + size
        end = min(len(text), first + self.n, first + len(own) - k)
        while b < end and text[b] == own[more]:
            b, more = b + 1, more + 1
        return (a, b) if b - a >= self.n else None


class Scan:
    """One text: its words, and which of them are inside an occurrence of a window."""

    def __init__(self, text: str | None):
        self.raw, self.words = (text or "").encode(), words_of(text)

    def hits(self, built: Benchmark) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (first, after last) of every occurrence, and the items found."""
        ranges, items, begins = [], set(), None
        if built.some and self.words:
            joined = b" " + b" ".join(self.words) + b" "
            for end, (size, places) in built.automaton.iter(joined.decode("latin-1")):
                if begins is None:
                    begins = np.cumsum([0, *(len(w) + 1 for w in self.words)])  # of each word's leading space
                first = int(np.searchsorted(begins, end)) - size
                for item, k, n in places:
                    if n == size and (found := built.run(self.words, first, item, k, n)):
                        ranges.append(found)
                        items.add(built.ids[item])
        return ranges, items

    def original(self, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte offsets in the text as given of word ranges."""
        cover = np.frombuffer(b" " + self.raw.translate(KEEP) + b" ", np.uint8) != 32
        edges = np.flatnonzero(np.diff(cover.astype(np.int8)))
        return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in ranges]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SCHEMA = "n_words long, spans array<struct<first:long,after:long,begin:long,end:long>>, items array<long>"
_built: dict[str, Benchmark] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each document with its word count, hit spans (words and bytes of the original) and found items.

    Up to ``group_bytes`` of benchmark text goes to the tasks with the plan, and a task has one automaton of
    ``part_bytes`` of it at a time; a larger benchmark takes several passes, each written to the shared folder. Null texts
    and items have no words; items alike share their windows and are all reported; null item_ids take no part; long texts
    are scanned whole. Other columns of either table don't matter, and clashing names neither.
    """
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = -(-size // group_bytes) or 1
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    made = docs
    for k in range(groups):  # what is found so far travels with the row
        own = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k)
        parts, held = [[]], 0
        for item_id, text in sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0], r[1] or "")):
            if parts[-1] and held + len(text or "") > part_bytes:
                parts.append([])
                held = 0
            parts[-1].append((item_id, text))
            held += len(text or "")
        made = _scan(made, parts, n, keep, carry=k > 0, text=k < groups - 1)
        if k < groups - 1:
            made = stage(made, "contamination")
    return made


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(docs: DataFrame, parts: list[list[tuple]], n: int, keep: tuple[str, ...], carry: bool, text: bool) -> DataFrame:
    kept = [F.col(c) for c in keep]
    source = docs.select(*kept, F.col("text").cast("string").alias("text"), *([F.col("spans"), F.col("items")] if carry else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema = f"{fields}, {'text string, ' if text else ''}{SCHEMA}"
    name = uuid.uuid4().hex

    def automaton(k: int) -> Benchmark:
        """One automaton a worker; that of a benchmark of one part outlives the task."""
        if f"{name}-{k}" not in _built:
            _built.clear()
            _built[f"{name}-{k}"] = Benchmark(parts[k], n)
        return _built[f"{name}-{k}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, HELD_BYTES if len(parts) > 1 else 0):
            texts = table.column("text").to_pylist()
            found: list[tuple[list, set]] = [([], set()) for _ in texts]
            if carry:
                found = [([(s["first"], s["after"]) for s in old], {*ids}) for old, ids in zip(table.column("spans").to_pylist(), table.column("items").to_pylist(), strict=True)]
            counts, spans = [], [[] for _ in texts]
            for k in range(len(parts)):
                built = automaton(k)
                for i, t in enumerate(texts):
                    scan = Scan(t)
                    ranges, ids = scan.hits(built)
                    found[i][0].extend(ranges)
                    found[i][1].update(ids)
                    if k == len(parts) - 1:
                        counts.append(len(scan.words))
                        ranges = merged(found[i][0])
                        spans[i] = [{"first": a, "after": b, "begin": x, "end": y} for (a, b), (x, y) in zip(ranges, scan.original(ranges) if ranges else [], strict=True)]
            span = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "after", "begin", "end")]))
            whole = table.combine_chunks()
            columns = [*(whole.column(c).chunk(0) for c in keep), *([whole.column("text").chunk(0)] if text else []), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array([sorted(ids) for _, ids in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(["text"] if text else []), "n_words", "spans", "items"])

    return source.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a document is contaminated with hits in 5 % of its words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = 0.0) -> DataFrame:
    """The documents without any benchmark window, with all their columns; ``share``: those with hits in fewer of their words than that.

    Null and empty texts stay; repeated rows fare alike; long texts are scanned whole; an empty table, or an empty
    benchmark, changes nothing. Column names that clash with those used here don't matter.
    """
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    found = find_contamination(docs.select(whole, "text"), benchmark, n, keep=("row_",))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda k, s: k + s["after"] - s["first"])
    return found.where(~((n_hit > 0) & (n_hit >= share * F.col("n_words")))).select("row_.*")


_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS u(k) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(p)),
hit AS (SELECT DISTINCT r, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT r, COUNT(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY r),
items AS (SELECT r, COUNT(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
