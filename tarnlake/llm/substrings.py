"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere.

Routing. Every 200-byte window has a key, the least hash of its 64-byte strings, so equal windows have equal keys; a run
of windows with one key at one place of a text is a segment. A key that one segment alone has can't hold a repeat, and
its segment is left out. Hashes decide nothing else: all other segments go, by key, to shards of about a megabyte.

Suffix arrays. A shard's segments are collapsed by their bytes (each counts as often as it occurs). One that is then alone
with its key is a repeat as a whole, or not at all. The others go to the shard's suffix array, which comes from Larsson-Sadakane refinement: groups of equal prefixes, doubled by sorting on the rank of what follows, sorted
groups left alone. Common prefixes come from Kasai's scan, in lanes. Windows that are neighbours in the array with 200
bytes in common are one class, and the windows of a class that occurs twice or more are repeats.

Merging. A key with too many segments for a shard is salted over several. Each of them passes its classes on, in the
order of its suffix array, cut by a hash of the window into parts of bounded size; the sorted lists of a part are merged
two by two, by binary search of the one's windows in the other's, on their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_stage, dropping, release, stage, text_key
from tarnlake.llm.tokens import ragged

LENGTH, GRAM, BUFFER, SHARD_BYTES, CROWD, PARTS, SOME, ROWS = 200, 64, 1 << 19, 1 << 20, 2048, 8, 4096, 256
WINDOW = LENGTH - GRAM + 1
LOW = np.uint64((1 << 20) - 1)  # room for a place in a buffer

TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
MOST = BUFFER + 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.cumprod(out)


POWERS, INVERSE = _powers(BASE, MOST), _powers(pow(BASE, -1, 2**64), MOST)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rolling_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w + w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, key) of the segments of a buffer of (text number, offset, bytes)."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)  # they give the hash of any substring
    np.cumsum(TABLE[data] * POWERS[:n], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * INVERSE[: n - GRAM + 1])
    least = _rolling_min((grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), WINDOW)
    sizes = np.array([len(p[2]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    edge = np.zeros(n + 1, np.int32)
    edge[begins] += 1
    edge[begins + sizes - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)])
    best = least[starts]
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (np.diff(starts) != 1)]))
    s = starts[first]
    key = grams[(best[first] & LOW).astype(np.int64)]
    piece = np.searchsorted(begins, s, side="right") - 1
    offsets, numbers = np.array([p[1] for p in pieces]), np.array([p[0] for p in pieces])
    return numbers[piece], s - begins[piece] + offsets[piece], np.diff(np.append(first, len(starts))), key.view(np.int64)


def buffers(texts: Iterable[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts of 200 bytes or more, in buffers; a long one in pieces that overlap by 199 bytes."""
    held, size, part = [], 0, BUFFER // 2
    for i, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, part):
            piece = t[at : at + part + LENGTH - 1]
            if size + len(piece) > BUFFER:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that follow each other in a text, as one."""
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], at[first], np.add.reduceat(n, first) if len(first) else n


RUNS = "doc_id long, text_key long, at int, n int"


def find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (doc_id, text_key, text). Texts are taken from a batch one by one: a worker holds no second copy of it."""
    for batch in batches:
        for held in buffers(t.as_py() or b"" for t in batch.column(2)):
            text, at, n, key = segments(held)
            text = pa.array(text)
            columns = [pa.array(key), batch.column(0).take(text), batch.column(1).take(text), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "text_key", "at", "n"])
    pa.default_memory_pool().release_unused()


def segment_rows(docs: DataFrame) -> DataFrame:
    """key, doc_id, text_key, at, n of every segment."""
    return _source(docs).mapInArrow(find_segments, f"key long, {RUNS}")


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order; in full order, since Kasai's scan relies on it."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(n, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    sa = np.argsort(word).astype(np.int32)
    word = word[sa]
    first = np.concatenate([[True], word[1:] != word[:-1]])
    del word
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    h, slots = 8, np.arange(n, dtype=np.int32)
    while h < n:
        edge = np.append(first, True)
        slots = slots[~(edge[slots] & edge[slots + 1])]  # groups of one are done
        if not len(slots):
            break
        suffix = sa[slots]
        key = rank[suffix].astype(np.int64) << 32 | (rank[np.minimum(suffix.astype(np.int64) + h, n)] + 1)
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[slots] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[slots] = new
        rank[suffix] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int = LENGTH, lane: int = 256) -> np.ndarray:
    """Length (up to ``most``) that each suffix has in common with the one before it in the array: Kasai's scan over
    lanes of ``lane`` suffixes in text order, where the length falls by at most one from a suffix to the next."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray(n + most + 8, "<u8", padded.tobytes(), strides=(1,))
    base = np.arange(0, n, lane)
    known = np.zeros(len(base), np.int64)
    out = np.zeros(n, np.int32)
    for t in range(min(lane, n)):
        i = base + t
        i = i[i < n]
        known = np.maximum(known[: len(i)] - 1, 0)
        j = before[i].astype(np.int64)
        live = np.flatnonzero((j >= 0) & (known < most))
        while len(live):
            apart = words[i[live] + known[live]] ^ words[j[live] + known[live]]
            same = apart == 0
            known[live] += np.where(same, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[same & (known[live] < most)]
        known = np.where(j >= 0, np.minimum(known, most), 0)
        out[i] = known
    return out


def classes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows at ``starts`` in the order of the suffix array, and the class of each: equal windows share it."""
    number = np.full(len(data), -1, np.int32)
    number[starts] = np.arange(len(starts))
    sa = suffix_array(data)
    lcp = common_prefixes(data, sa)[sa]
    at = np.flatnonzero(number[sa] >= 0)
    alike = np.minimum.reduceat(lcp, at[:-1] + 1)[: len(at) - 1] if len(at) > 1 else np.zeros(0, np.int32)
    if len(at) > 1:  # the last stretch ends at the last window
        alike[-1] = lcp[at[-2] + 1 : at[-1] + 1].min()
    return number[sa[at]], np.concatenate([[0], np.cumsum(alike < LENGTH)])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole (key, salt) groups, about SHARD_BYTES at a time."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column("key").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)])
        change = np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1
        if last is not None and (now[:, 0] != last).any():
            change = np.concatenate([[0], change])
        last = now[:, -1]
        before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())])
        begin = 0
        while True:
            full = int(np.searchsorted(before, SHARD_BYTES - size + before[begin]))
            at = int(np.searchsorted(change, max(full, begin)))
            if at == len(change):
                break
            if part := [*held, *([batch.slice(begin, int(change[at]) - begin)] if change[at] > begin else [])]:
                yield pa.Table.from_batches(part)
            held, size, begin = [], 0, int(change[at])
            change = change[at + 1 :]
        held.append(batch.slice(begin))
        size += int(before[-1] - before[begin])
    if held:
        yield pa.Table.from_batches(held)


FOUND = f"{RUNS}, key long, part int, windows binary, places binary"


def _found(runs: list | None = None, lists: list[tuple] = ()) -> pa.RecordBatch:
    """Runs of repeated windows (doc_id, text_key, at, n), and (key, part, windows, places) for merging."""
    size = len(lists) if runs is None else len(runs[0])
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(runs or [], kinds, strict=False)] or [pa.nulls(size, k) for k in kinds[:4]]
    columns += [pa.nulls(size, k) if runs is not None else pa.array([r[i] for r in lists], k) for i, k in enumerate(kinds[4:])]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "at", "n", "key", "part", "windows", "places"])


PLACE = np.dtype([("doc_id", "<i8"), ("text_key", "<i8"), ("at", "<i4"), ("null", "u1"), ("open", "u1")])


def _ordered(texts: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text, place in it, place in the bytes of all; those bytes; the windows' order and classes."""
    of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(texts):
        return of, step, step, np.zeros(0, np.uint8), of, of
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    data, starts = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]], ends[of] + step
    return of, step, starts, data, *classes(data, starts)


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeats found in each shard; of keys that are salted also the classes, in order, part by part.

    The windows of one segment all differ, since equal ones hold the string of the key at the same place. So where all
    segments of a key have the same bytes, each of their windows occurs as often as they do: only the others are ordered.
    """
    for rows in _shards(batches):
        coded = rows.column("bytes").combine_chunks().dictionary_encode()  # equal bytes have equal keys
        own, every = coded.indices.to_numpy(), coded.dictionary
        times = np.bincount(own, 1 + rows.column("again").to_numpy())
        counts = pc.binary_length(every).to_numpy().astype(np.int64) - LENGTH + 1
        some = np.empty(len(every), np.int64)
        some[own] = np.arange(len(own))  # a row of each segment
        keys, salts = rows.column("key").to_numpy()[some], rows.column("salts").to_numpy()[some]
        _, which, alike = np.unique(keys, return_inverse=True, return_counts=True)
        lone = (alike[which] == 1) & (salts == 1)
        rest = np.flatnonzero(~lone)
        of, step, starts, data, order, kind = _ordered(every.take(pa.array(rest)), counts[rest])
        total = np.bincount(kind, times[rest][of[order]])
        flag = np.zeros(len(of), bool)
        flag[order] = total[kind] > 1
        seg, at, n = _joined(rest[of[flag]], step[flag], np.ones(int(flag.sum()), np.int64))
        whole = np.flatnonzero(lone & (times > 1))
        seg, at, n = np.concatenate([seg, whole]), np.concatenate([at, np.zeros(len(whole), np.int64)]), np.concatenate([n, counts[whole]])
        by = np.argsort(seg, kind="stable")
        seg, at, n = seg[by], at[by], n[by]
        pick, per = ragged(np.arange(len(seg)), np.bincount(seg, minlength=len(every)), own)
        first = rows.column("at").to_numpy().astype(np.int64)
        if len(pick):
            row = np.repeat(np.arange(len(own)), per)
            yield _found([*(rows.column(c).combine_chunks().take(pa.array(row)) for c in ("doc_id", "text_key")), first[row] + at[pick], n[pick]])
        if salts.max() > 1:
            some, keys, salts = some[rest], keys[rest], salts[rest]
            place = np.zeros(len(rest), PLACE)
            doc_id = rows.column("doc_id").combine_chunks()
            place["doc_id"], place["null"] = doc_id.fill_null(0).to_numpy()[some], doc_id.is_null().to_numpy(zero_copy_only=False)[some]
            place["text_key"], place["at"] = rows.column("text_key").to_numpy()[some], first[some]
            head = order[np.concatenate([[True], np.diff(kind) > 0])]  # a window of each class, in order
            for key in np.unique(keys[salts > 1]).tolist():
                mine = head[keys[of[head]] == key]
                where = place[of[mine]]
                where["at"] += step[mine].astype(np.int32)
                where["open"] = ~flag[mine]
                lists = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[mine]]
                parts = np.uint64(int(salts[keys == key][0]) * PARTS)
                # eight bytes a byte, so for some windows at a time
                hashes = np.concatenate([lists[i : i + SOME].astype(np.uint64) @ POWERS[:LENGTH] for i in range(0, len(lists), SOME)])
                part = (hashes >> np.uint64(40)) % parts
                for p in np.unique(part).tolist():
                    yield _found(lists=[(key, int(p), lists[part == p].tobytes(), where[part == p].tobytes())])


def merged(a: tuple, b: tuple, found: list[np.ndarray]) -> tuple:
    """Two sorted lists of (windows, places) as one; places of windows met in both go to ``found`` and are closed."""
    at = np.searchsorted(a[0], b[0])
    held = np.minimum(at, len(a[0]) - 1)
    hit = a[0][held] == b[0]
    for places, which in ((a[1], held[hit]), (b[1], np.flatnonzero(hit))):
        found.append(places[which][places["open"][which] == 1])
        places["open"][which] = 0
    return np.insert(a[0], at[~hit], b[0][~hit]), np.insert(a[1], at[~hit], b[1][~hit])


def merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of one key and part across shards. Lists of like length are merged, so a window is moved a few times only."""

    def result(held: list[tuple], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        while len(held) > 1:
            held.append(merged(held.pop(), held.pop(), found))
        every = np.concatenate(found) if found else np.zeros(0, PLACE)
        if len(every):
            yield _found([pa.array(every["doc_id"], pa.int64(), mask=every["null"] == 1), every["text_key"], every["at"], np.ones(len(every), np.int32)])

    held, found, now = [], [], None
    for batch in batches:
        for key, part, windows, places in zip(*(batch.column(c) for c in ("key", "part", "windows", "places")), strict=True):
            key, part, windows, places = key.as_py(), part.as_py(), windows.as_buffer(), places.as_buffer()
            if (key, part) != now:
                yield from result(held, found)
                held, found, now = [], [], (key, part)
            raw = np.frombuffer(windows, np.uint8).reshape(-1, LENGTH)
            # a last byte that isn't zero, since trailing zeros of strings don't count in numpy
            held.append((np.pad(raw, ((0, 0), (0, 1)), constant_values=1).view(f"S{LENGTH + 1}").ravel(), np.frombuffer(places, PLACE).copy()))
            while len(held) > 1 and len(held[-2][0]) <= len(held[-1][0]):
                held.append(merged(held.pop(), held.pop(), found))
    yield from result(held, found)
    pa.default_memory_pool().release_unused()


def without_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each (doc_id, text, runs), some rows at a time: a worker holds no second copy of a batch."""
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not own:
                    out.append((len(text), 0, 0, text))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, [r["at"] for r in own], 1)
                np.add.at(edge, [r["at"] + r["n"] + LENGTH - 1 for r in own], -1)
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- the operator


def repeated_runs(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_key, at, n): windows at .. at + n - 1 of a text start a 200-byte string that starts elsewhere too."""
    spark = docs.sparkSession
    rows = stage(segment_rows(docs), "segments")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("key_"), F.ceil(F.col("c") / crowd).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("doc_id", "text_key", "at"), F.col("salts")).cast("int")
    chosen = rows.join(shared, F.col("key") == F.col("key_")).select("doc_id", "text_key", F.struct("key", salt.alias("salt"), "salts", "at", "n").alias("cut"))
    # rows alike in doc_id and text are one place here, that counts twice
    wanted = chosen.groupBy("doc_id", "text_key").agg(F.collect_set("cut").alias("cuts"), F.count("*").alias("c"))
    wanted = wanted.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("tk_"), "cuts", (F.col("c") > F.size("cuts")).cast("int").alias("again"))
    wanted = stage(wanted, "segments-wanted")
    drop_stage(rows)
    release(spark)
    joined = _source(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("tk_")))
    cut = joined.select("doc_id", "text_key", "text", "again", F.inline("cuts")).select("key", "salt", "salts", "doc_id", "text_key", "again", "at", F.substring("text", F.col("at") + 1, F.col("n") + LENGTH - 1).alias("bytes"))
    found = stage(cut.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(search_shards, FOUND), "shard-repeats")
    drop_stage(wanted)
    release(spark)
    spread = found.where(F.col("key").isNotNull()).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(merge_shards, FOUND)
    runs = ["doc_id", "text_key", "at", "n"]
    return found.where(F.col("key").isNull()).select(*runs).union(spread.select(*runs))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document.

    Every occurrence of a repeated string goes, the first one too. Null texts are empty; texts under 200 bytes lose
    nothing; rows that repeat are repeats of each other; an empty table gives none; other columns don't matter.
    """
    with dropping(docs.sparkSession):
        runs = repeated_runs(docs, crowd).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
        runs = stage(runs, "repeat-runs", keep=True).withColumnsRenamed({"doc_id": "id_", "text_key": "tk_"})
    joined = _source(docs).join(runs, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("tk_")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(without_runs, SCHEMA)


def report(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remove_python(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same by a table of all windows: what tests compare with."""
    seen: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
