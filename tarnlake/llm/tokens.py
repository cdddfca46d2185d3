"""Token-id output: canonical length-limited Huffman files.

A data set is a folder with one ``codebook.bin`` (ids and code lengths, from global counts) and one ``.hfm`` file a
shard. Shards hold documents in ascending doc_id order, shard by shard. A file is a run of independent blocks::

    u32 magic | u32 segments | u32 checkpoints | u32 payload bytes
    per segment:    i64 doc_id | u8 null doc_id | u8 last of its document | u32 tokens | u32 checkpoints | u32 payload bytes
    per checkpoint: u32 bit offset in the block's payload
    payload

There is a checkpoint at every ``EVERY`` tokens of a segment, so that a reader decodes all of them side by side with
one table look-up a token. A document longer than ``SEGMENT`` tokens takes several segments.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_stage, new_dir, release, slots, stage

MAGIC, EVERY, SEGMENT, BLOCK, LIMIT = 0x31464D48, 256, 1 << 18, 1 << 20, 16
SEGMENT_DTYPE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("last", "u1"), ("tokens", "<u4"), ("points", "<u4"), ("bytes", "<u4")])

# ---------------------------------------------------------------- tokenising


def ragged(flat: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``pick`` of ``flat`` (run i has sizes[i] items) in a row, and their sizes."""
    begins, own = np.cumsum(sizes) - sizes, sizes[pick]
    ends = np.cumsum(own)
    return flat[np.repeat(begins[pick] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)], own


NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Token ids of texts from the tokenizers library, each different word encoded once.

    A tokenizer that drops white space has no step that looks across it, so the ids of a text are those of its words
    (split at ASCII white space) in a row. Words of visible ASCII and Latin letters are lower-cased and cut as the
    tokenizer's own splitter does, and the pieces not met before go to the library's BPE model in one call. All other
    words, and those that could hold a special token, go through the whole tokenizer, as do all texts, whole, where the
    tokenizer's normaliser and splitter aren't these.
    """

    PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+\Z")
    LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
    CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PART, KNOWN = 1 << 22, 300_000

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        made = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = steps == NORMALIZER and cuts[0].get("pattern") == {"Regex": SPLIT} and cuts[0]["behavior"] == "Removed" and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and made["model"]["type"] == "BPE" and bool(made["model"]["end_of_word_suffix"])
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
        if self.by_word:
            self.final[[i for w, i in made["model"]["vocab"].items() if w.endswith(made["model"]["end_of_word_suffix"])]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _slow(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self) -> None:
        """Encode the pieces that were numbered since the last call."""
        new = [*self.known][len(self.sizes) :]
        if new:
            made = np.array(self.model.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            self.ids = np.concatenate([self.ids, made])
            self.sizes = np.concatenate([self.sizes, np.diff(np.flatnonzero(self.final[made]), prepend=-1)])

    def _unique(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if len(self.known) > self.KNOWN:
            self._forget()
        number, known = self.known.setdefault, self.known
        flat: list[int] = []
        sizes: list[int] = []
        slow: list[tuple[int, str]] = []
        letters, plain, cut = self.LETTERS.match, self.PLAIN.match, self.CUT.findall
        for k, word in enumerate(words):
            if letters(word):
                flat.append(number(word.lower(), len(known)))
                sizes.append(1)
            elif plain(word):
                own = cut(word.lower())
                flat.extend([number(x, len(known)) for x in own])
                sizes.append(len(own))
            else:
                sizes.append(0)
                if word:
                    slow.append((k, word))
        self._learn()
        per_word = np.array(sizes, np.int64)
        ids, lengths = ragged(self.ids, self.sizes, np.array(flat, np.int64))
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(per_word)
        sizes_out = total[ends] - total[ends - per_word]
        if slow:
            parts, at = [], 0
            begins = np.cumsum(sizes_out) - sizes_out
            for k, word in slow:
                own = self._slow(word)
                parts += [ids[at : begins[k]], np.array(own, ids.dtype)]
                at = int(begins[k])
                sizes_out[k] = len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, sizes_out

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in a row and how many each has, for a few megabytes of texts at a time."""
        texts = texts.fill_null("").cast(pa.large_string())
        total = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.PART, side="right")))
            if not self.by_word:
                made = [e.ids for e in self.tokenizer.encode_batch_fast(texts.slice(at, stop - at).to_pylist(), add_special_tokens=False)]
                yield np.array([i for ids in made for i in ids], self.dtype), np.array([len(ids) for ids in made], np.int64)
                at = stop
                continue
            words = pc.ascii_split_whitespace(texts.slice(at, stop - at))
            offsets, coded = np.asarray(words.offsets), words.flatten().dictionary_encode()
            ids, sizes = self._unique(coded.dictionary.to_pylist())
            out, own = ragged(ids.astype(self.dtype), sizes, coded.indices.to_numpy())
            tally = np.concatenate([[0], np.cumsum(own)])
            yield out, np.diff(tally[offsets - offsets[0]])
            pa.default_memory_pool().release_unused()
            at = stop


_encoders: dict[tuple, WordEncoder] = {}


def word_encoder(path: str, width: int) -> WordEncoder:
    """This worker's encoder; it outlives a task where workers are reused."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def tokenize(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, uid, n_tokens, crc, ids (little-endian, as wide as the vocabulary needs) of every text; null counts as empty."""
    width = id_width(tokenizer)
    end = b"" if end_id is None else int(end_id).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, width)
        for batch in batches:
            ids: list[bytes] = []
            for flat, sizes in encoder.encode(batch.column(2)):
                data, stops = flat.tobytes(), (np.cumsum(sizes) * width).tolist()
                ids += [data[i:j] + end for i, j in zip([0, *stops], stops, strict=False)]
            crcs = [zlib.crc32(np.frombuffer(b, encoder.dtype).astype("<u4")) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) // width for b in ids], pa.int64()), pa.array(crcs, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "uid", "n_tokens", "crc", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, n_tokens long, crc long, ids binary")


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    n = len(present)
    if n <= 1:
        lengths[present] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = present[np.argsort(counts[present], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_flags, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([weights, packages])
        by = np.argsort(items, kind="stable")
        leaf_flags.append(by < n)
        merged = items[by][: len(items) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take, used = 2 * n - 2, np.zeros(n + 1, np.int64)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        used[leaves] += 1  # the `leaves` lightest ids get a bit more
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(used[::-1])[::-1][1:]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for width in np.unique(lengths[order]):
        group = order[lengths[order] == width]
        code <<= int(width) - last
        codes[group] = code + np.arange(len(group), dtype=np.uint32)
        code, last = code + len(group), int(width)
    return codes


class Codebook:
    """Code lengths by id, with the encoder's and the decoder's tables."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.peek = max(1, int(lengths.max(initial=0)))

    def to_bytes(self) -> bytes:
        present = np.flatnonzero(self.lengths).astype("<u4")
        return len(present).to_bytes(4, "little") + len(self.lengths).to_bytes(4, "little") + present.tobytes() + self.lengths[present].tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Codebook:
        n, size = np.frombuffer(data, "<u4", 2)
        lengths = np.zeros(size, np.uint8)
        lengths[np.frombuffer(data, "<u4", n, 8)] = np.frombuffer(data, np.uint8, n, 8 + 4 * n)
        return Codebook(lengths)

    def decoding_table(self) -> tuple[np.ndarray, np.ndarray]:
        symbols, widths = np.zeros(1 << self.peek, np.uint32), np.zeros(1 << self.peek, np.uint8)
        order = np.lexsort((self.codes, self.lengths))
        order = order[self.lengths[order] > 0]
        spans = 1 << (self.peek - self.lengths[order].astype(np.int64))
        filled = int(spans.sum())
        symbols[:filled], widths[:filled] = np.repeat(order, spans), np.repeat(self.lengths[order], spans)
        return symbols, widths

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of segments of sizes[i] > 0 ids each, that begin at whole bytes; where they begin, and every id's bit offset in its own."""
        widths = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(widths)
        last = np.cumsum(sizes)
        bits = np.diff(ends[last - 1], prepend=0)
        begins = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
        own = ends - widths - np.repeat(ends[last - 1] - bits, sizes)
        starts = own + np.repeat(8 * begins[:-1], sizes)
        word, room = starts >> 6, 64 - widths - (starts & 63)
        codes = self.codes[ids].astype(np.uint64)
        value = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(begins[-1]) // 8 + 3, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(value, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return out.byteswap().view(np.uint8)[: int(begins[-1])], begins, own


def decode_block(payload: np.ndarray, points: np.ndarray, counts: np.ndarray, book: tuple[np.ndarray, np.ndarray], peek: int) -> np.ndarray:
    """Ids of a block: every checkpoint is a lane of counts[i] tokens, and all lanes step together."""
    symbols, widths = book
    padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    windows = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, to, left = points[order].astype(np.int64), first[order], counts[order]
    mask, shift = np.uint32((1 << peek) - 1), 32 - peek
    live = len(order)
    for step in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= step:
            live -= 1
        now = at[:live]
        key = (windows[now >> 3] >> (shift - (now & 7)).astype(np.uint32)) & mask
        out[to[:live] + step] = symbols[key]
        now += widths[key]
    return out


# ---------------------------------------------------------------- writing and reading a data set


def count_ids(tokens: DataFrame, width: int) -> dict[int, int]:
    """Occurrences of every id; at most one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def _bounds(tokens: DataFrame, shards: int) -> list[int]:
    """doc_ids that part the documents into about equal shards."""
    if shards < 2:
        return []
    marks = tokens.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 20 * shards)).first()[0]
    return sorted(set(marks or []))


def write_dataset(tokens: DataFrame, path: str, width: int, shard_tokens: int = 1 << 25) -> tuple[list[tuple], int]:
    """Write the ids of :func:`tokenize` (a staged table) as a data set; gives (file, shard, tokens before it) of each shard.

    What comes to the driver: counts by id, doc_id marks and a row a shard.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens, width)
    total = sum(counts.values())
    by_id = np.zeros(max(counts, default=0) + 1, np.int64)
    by_id[list(counts)] = list(counts.values())
    book = Codebook(code_lengths(by_id))
    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/codebook.bin") as f:
        f.write(book.to_bytes())
    per_shard = max(1 << 20, min(shard_tokens, total // (2 * slots(spark)) + 1))
    bounds = np.array(_bounds(tokens, -(-total // per_shard)), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        names = ["shard", "doc_id", "crc", "uid", "k", "last", "n", "points", "payload"]
        for rows in _segments(batches, width):
            sizes = np.array([len(r[-1]) for r in rows], np.int64)
            full = sizes > 0
            data, begins, own = book.encode(np.concatenate([r[-1] for r in rows]), sizes[full]) if full.any() else (np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
            at, out, j = 0, [], 0
            for doc_id, crc, uid, k, last, ids in rows:
                shard = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id, side="left"))
                points, payload = b"", b""
                if len(ids):
                    points, payload, j = own[at : at + len(ids) : EVERY].astype("<u4").tobytes(), data[begins[j] : begins[j + 1]].tobytes(), j + 1
                out.append((shard, doc_id, crc, uid, k, last, len(ids), points, payload))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}.hfm"
        tokens_written, file, held, size = 0, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    file = fs.FileSystem.from_uri(path)[0].open_output_stream(name)
                held.append(row)
                size += row["n"]
                tokens_written += row["n"]
                if size >= BLOCK:
                    file.write(_block(held))
                    held, size = [], 0
        if file is not None:
            if held:
                file.write(_block(held))
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([name]), pa.array([tokens_written])], names=["shard", "file", "n_tokens"])

    encoded = tokens.mapInArrow(encode, "shard int, doc_id long, crc long, uid long, k int, last boolean, n long, points binary, payload binary")
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "uid", "k")
    made = sorted(tuple(r) for r in placed.mapInArrow(write, "shard long, file string, n_tokens long").collect())
    files, before = [], 0
    for shard, file, n in made:
        files.append((file, shard, before))
        before += n
    return files, total


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """(doc_id, crc, uid, number, last, ids) of every segment, in lists of about SEGMENT ids."""
    held, size = [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "crc", "uid", "ids"))
        for doc_id, crc, uid, blob in zip(*columns, strict=True):
            ids = np.frombuffer(blob, f"<u{width}")
            for k, s in enumerate(range(0, max(1, len(ids)), SEGMENT)):
                held.append((doc_id, crc, uid, k, s + SEGMENT >= len(ids), ids[s : s + SEGMENT]))
                size += len(held[-1][-1])
                if size >= SEGMENT or len(held) >= 5000:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _block(rows: list[dict]) -> bytes:
    segments, points, base = np.zeros(len(rows), SEGMENT_DTYPE), [], 0
    for i, r in enumerate(rows):
        own = np.frombuffer(r["points"], "<u4")
        points.append(own + np.uint32(8 * base))
        segments[i] = (r["doc_id"] or 0, r["doc_id"] is None, r["last"], r["n"], len(own), len(r["payload"]))
        base += len(r["payload"])
    marks = np.concatenate(points).astype("<u4")
    return np.array([MAGIC, len(rows), len(marks), base], "<u4").tobytes() + segments.tobytes() + marks.tobytes() + b"".join(r["payload"] for r in rows)


def read_file(system: fs.FileSystem, name: str, book: Codebook) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, last of its document, ids) of every segment of a file, block by block."""
    tables = book.decoding_table()
    with system.open_input_stream(name) as f:
        while head := f.read(16):
            magic, n, n_points, size = (int(x) for x in np.frombuffer(head, "<u4"))
            if magic != MAGIC:
                raise ValueError(f"{name}: not a block")
            segments = np.frombuffer(f.read(n * SEGMENT_DTYPE.itemsize), SEGMENT_DTYPE)
            points = np.frombuffer(f.read(4 * n_points), "<u4")
            payload = np.frombuffer(f.read(size), np.uint8)
            lanes = np.full(n_points, EVERY, np.int64)
            ends = np.cumsum(segments["points"].astype(np.int64))
            some = segments["points"] > 0
            lanes[ends[some] - 1] = segments["tokens"][some] - (segments["points"][some].astype(np.int64) - 1) * EVERY
            ids = decode_block(payload, points, lanes, tables, book.peek)
            at = 0
            for s in segments:
                yield None if s["null"] else int(s["doc_id"]), bool(s["last"]), ids[at : at + int(s["tokens"])]
                at += int(s["tokens"])


def read_dataset(spark: SparkSession, path: str, files: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of a data set."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    root = fs.FileSystem.from_uri(path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(path)[0]
        with system.open_input_stream(f"{root}/codebook.bin") as f:
            book = Codebook.from_bytes(f.read())
        for batch in batches:
            for row in batch.to_pylist():
                start, n, crc, out = row["before"], 0, 0, []
                for doc_id, last, ids in read_file(system, row["file"], book):
                    n, crc = n + len(ids), zlib.crc32(ids.astype("<u4"), crc)
                    if last:
                        out.append((doc_id, start, n, crc))
                        start, n, crc = start + n, 0, 0
                    if len(out) >= 10_000:
                        yield _docs(out)
                        out = []
                if out:
                    yield _docs(out)

    parts = min(len(files), 16 * slots(spark))  # a task reads several files, one after the other
    listed = spark.createDataFrame([(f, i % parts, b) for i, (f, _, b) in enumerate(files)], "file string, i int, before long")
    return listed.repartitionById(parts, F.col("i")).mapInArrow(run, schema)


def _docs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, path: str | None = None) -> tuple[str, list[tuple]]:
    """Tokenise ``docs`` (doc_id, text; other columns are ignored) and write a data set; gives its folder and files.

    Null texts are empty: such a document has the end id alone. Null doc_ids come first. Rows with one doc_id each count
    as a document, in order of their ids' crc32. An empty table gives no file. Texts of any length are whole: long ones
    take several segments.
    """
    spark = docs.sparkSession
    path = path or new_dir(spark, "tokens")
    tokens = stage(tokenize(docs, tokenizer, end_id), "token-ids")
    files, _ = write_dataset(tokens, path, id_width(tokenizer))
    drop_stage(tokens)
    release(spark)
    return path, files


def huffman_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32. See :func:`write_tokens` for nulls, ties and long texts."""
    path, files = write_tokens(docs, tokenizer, end_id)
    return read_dataset(docs.sparkSession, path, files)
