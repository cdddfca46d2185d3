"""The training-data operators against brute force, with nulls, empty and long texts, repeats, ties and extra columns."""

import hashlib
import re
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import chat, contamination, linechunks, mixing, neighbours, queries, secrets, simhash, substrings, tokens, toxicity
from tarnlake.llm.common import table
from tarnlake.llm.components import components

SF = "/root/testdata/sf0.001"
WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, spans int, key string, row_ int"


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    base = real[0][1]
    odd = [(None, "no id here at all"), (900, None), (901, ""), (902, " \t\n "), (903, "a" * 700), (904, base), (904, base), (905, "x"), (906, "\x0bÄpfel ß <|endoftext|> é" * 50), (907, " ".join(w for _, t in real[:12] for w in t.split()))]
    return real + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", 0, 1, "k", 2) for k, (i, t) in enumerate(rows)], SHAPE).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def lower(t):
    return (t or "").encode().translate(simhash.LOWER).decode()


def test_tokens(docs, rows, empty):
    model = tokens.WordEncoder(WORD_BPE, 2).tokenizer
    want, start = [], 0
    coded = [(i, np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0], zlib.crc32(x[1]))):
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = sorted((tuple(r) for r in tokens.huffman_tokens(docs, WORD_BPE).collect()), key=lambda r: r[1])
    assert got == want
    assert tokens.huffman_tokens(empty, WORD_BPE).count() == 0


def test_huffman_code():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 300):
        counts = (rng.zipf(1.3, n) % 10**9).astype(np.int64) + 1
        book = tokens.Codebook(tokens.code_lengths(counts, 12))
        assert book.lengths.max() <= 12 and (n == 1 or sum(2.0 ** -book.lengths.astype(float)) == 1)
        again = tokens.Codebook.from_bytes(book.to_bytes())
        sizes = np.array([1000, 1, 700])
        ids = rng.integers(0, n, sizes.sum())
        data, begins, own = again.encode(ids, sizes)
        points = np.concatenate([own[a : a + s : tokens.EVERY] + 8 * b for a, s, b in zip(np.cumsum(sizes) - sizes, sizes, begins, strict=False)])
        lanes = np.array([min(tokens.EVERY, s - k) for s in sizes for k in range(0, s, tokens.EVERY)])
        assert (tokens.decode_block(data, points, lanes, again.decoding_table(), again.peek) == ids).all()


def check_nearest(spark, rows, least=0.9, kind="float"):
    """Against brute force: whole rows, exact scores, order, ties to the smaller vec_id."""
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, uid string, norm int").repartition(3)
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    hits = total = 0
    for at, (i, v) in enumerate(good):
        if i is None or i % 20 or sum(j == i for j, _ in good) > 1:
            continue
        scored = [(-float((w * v).sum()), 2**63 if j is None else j) for k, (j, w) in enumerate(good) if k != at and len(w) == len(v)]
        want, own = sorted(scored)[:20], sorted(found.get(i, []))
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert [(-s, 2**63 if j is None else j) for _, j, s in own] == sorted((-s, 2**63 if j is None else j) for _, j, s in own)
        all_scores = dict(zip(((j, round(-s, 9)) for s, j in scored), scored, strict=True))
        assert all((2**63 if j is None else j, round(s, 9)) in all_scores for _, j, s in own)
        best = {j for _, j in want}
        hits += sum((2**63 if j is None else j) in best for _, j, _ in own)
        total += len(want)
    assert hits >= least * total
    return found


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 24)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0]), (None, x[0].tolist()), (0, x[0].tolist()), (1080, [None] * 24)]
    found = check_nearest(spark, rows)
    assert sorted(found) == list(range(0, 900, 20)) and len(found[0]) == 40  # two rows are called 0, and both ask
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_repeated_vectors(spark):
    """A vector that repeats has one score, so its ties go by vec_id."""
    v = np.random.default_rng(2).standard_normal(24).astype(np.float32).tolist()
    w = np.random.default_rng(3).standard_normal(24).astype(np.float32).tolist()
    found = check_nearest(spark, [(i, v) for i in range(1, 700)] + [(0, v), (1000, w)], 1.0)
    assert [j for _, j, _ in sorted(found[0])] == list(range(1, 21)) and len({s for _, _, s in found[0]}) == 1
    assert [j for _, j, _ in sorted(found[1000])] == list(range(20))


def test_nearest_of_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(1 + i % 12).tolist()) for i in range(400)] + [(400, rng.standard_normal(5000).tolist()), (401, rng.standard_normal(5000).tolist())]
    found = check_nearest(spark, rows, kind="double")
    assert sorted(found) == list(range(0, 401, 20)) and [j for _, j, _ in found[400]] == [401]


def test_index_finds_all_within_a_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0xFFFF00FF00FF0F0F)
    index = neighbours.Index(codes, 4)
    for radius in (0, 3, 7, 12, 30, 64):
        for q in (int(codes[0]), 12345):
            want = np.flatnonzero(np.bitwise_count(codes ^ np.uint64(q)) <= radius)
            assert (index.within(q, radius) == want).all()


def test_mixture(spark, docs, rows, empty):
    got = mixing.taken(mixing.plan(docs, shards=3, block_rows=4)).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len(re.findall(mixing.WORD, t or "")) for _, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - k[1]) <= 1 and k[1] <= 3 * k[0] for k, v in by.items())
    again = mixing.taken(mixing.plan(docs.repartition(2), shards=3, block_rows=4)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.plan(empty).count() == 0
    quotas = mixing.split_quotas([5, 0, 17, 300], 7)
    assert quotas.sum(0).tolist() == [5, 0, 17, 300] and quotas.sum(1).max() - quotas.sum(1).min() <= 3
    made = mixing.plan(docs, shards=3, block_rows=2).select("source", F.inline("takes")).collect()
    assert all(r.shard in (0, 1, 2) for r in made)  # every copy is dealt, a block's to one shard each pass
    for weights in ((5, 2, 1), (1,)):
        mixed = mixing.mix(docs, weights=weights, shards=3, block_rows=4)
        assert mixed.columns == [*docs.columns, "mix_shard", "mix_order"]
        whole = mixing.shuffled(docs, weights=weights, shards=3, block_rows=4)
        assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.drop("mix_shard", "mix_order").collect()))
        dealt = [(r.p, r.doc_id, r.text) for r in whole.select(F.spark_partition_id().alias("p"), "*").collect()]
        assert sorted((r.mix_shard, str(r.doc_id), str(r.text)) for r in mixed.collect()) == sorted((p, str(i), str(x)) for p, i, x in dealt)
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("row_1", "id_", "key_", "source_", "pass", "takes", "mix_shard", "bucket_")])
    assert mixing.mix(odd).count() == mixing.mix(docs).count() and mixing.shuffled(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.shuffled(empty).columns == empty.columns


def test_mixture_quotas(spark):
    """Each shard has its share of every source's blocks, and nearly of its words."""
    rows = [(i, "w " * (1 + i * 7919 % 13), "ab"[i % 10 < 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.plan(df, shards=4, block_rows=20).select("source", F.inline("takes")).groupBy("source", "shard").agg(F.sum("words").alias("n")).collect()
    for s in "ab":
        words = [r.n for r in made if r.source == s]
        assert len(words) == 4 and max(words) < 1.6 * min(words)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 30)) + (" vile-a them" if i % 4 == 0 else " vile-a" if i % 4 == 1 else " them" if i % 4 == 2 else "") for i in range(1200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]  # the pair is toxic, neither part is
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    machine = toxicity.fit(df, labels)
    assert toxicity.score(empty, machine).count() == 0
    assert toxicity.score(docs, machine).where("toxicity between 0 and 1").count() == docs.count()
    assert toxicity.reject(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_of_pairs_alone(spark):
    """Toxic with exactly one of two words: neither says anything by itself."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 30)) + ("", " vile", " them", " vile them")[i % 4] for i in range(2400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 in (1, 2))) for i in range(2400)], "doc_id long, toxic int")
    held = [r for r in toxicity.report(df, labels).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 in (1, 2)) for r in held) >= 0.95 * len(held)


def test_toxicity_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(40)]
    known = np.unique([t for w in words[:30] for t in toxicity.word_terms(w)])
    machine = toxicity.Machine(known, -0.3, rng.standard_normal(len(known)) / 4, rng.standard_normal((len(known), 3)) / 4)
    texts = [" ".join(rng.choice(words, rng.integers(0, 25))) for _ in range(50)] + [None, "", "unknown only"]
    for t, s in zip(texts, machine.score(pa.array(texts)), strict=True):
        own = [k for k, x in enumerate(known) if x in {h for w in (t or "").split() for h in toxicity.word_terms(w)}]
        total = machine.bias + sum(machine.weights[k] for k in own) + sum(machine.factors[a] @ machine.factors[b] for a in own for b in own if a < b)
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9


def test_toxicity_odd_input(spark, docs):
    texts = spark.createDataFrame([(1, "a b", 5.0, "r"), (1, "a b", 5.0, "r"), (2, None, None, None), (3, "long " * 200_000, 1.0, "s"), (None, "", 2.0, "t")], "doc_id long, text string, toxicity double, row_ string")
    for only in ([(1, 1)], [(1, 0), (2, 0)], []):
        labels = spark.createDataFrame(only, "doc_id long, toxic int")
        assert {r.score for r in toxicity.report(texts, labels).collect()} == {0.5}
        assert sorted(map(str, toxicity.reject(texts, labels).collect())) == sorted(map(str, texts.collect()))
    assert toxicity.score(texts, toxicity.fit(texts, labels)).columns == ["doc_id", "text", "row_", "toxicity"]


def lines_python(rows):
    """(n_lines, n_removed_chunks, kept text) of each row, straight from the definition, byte by byte."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    chunks = {}
    for doc, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        m = [digest(x) for x in lines]
        for k, (over, bound) in enumerate(linechunks.LEVELS):
            begin = 0
            for i in range(len(lines)):
                rolled = m[i] if over == 1 else (m[i - 1] if i else "") + m[i]
                if digest(f"{k}:{rolled}")[0] < bound or i == len(lines) - 1:
                    if i + 1 - begin >= 2:
                        chunks.setdefault("\n".join(lines[begin : i + 1]), set()).add((doc is not None, doc or 0, begin, i + 1, doc, text))
                    begin = i + 1
    gone = {}
    for places in chunks.values():
        for _, _, a, b, doc, text in sorted(places, key=lambda p: p[:4])[1:]:
            gone.setdefault((doc, text), []).append((a, b))
    out = []
    for doc, text in rows:
        lines, own = (text or "").split("\n"), gone.get((doc, text or ""), [])
        lost = {i for a, b in own for i in range(a, b)}
        out.append((str(doc), len(lines), len(own), len(lost), "\n".join(x for i, x in enumerate(lines) if i not in lost)))
    return sorted(out)


def test_line_chunks(spark, rows, empty):
    shared = "\n".join(f"shared line {i}" for i in range(40))
    more = [(1001, f"own a\n{shared}\nlast a"), (1002, f"own b\nmore b\n{shared}"), (1003, None), (1004, ""), (1005, "alone\n\n\n\n"), (1005, "alone\n\n\n\n"), (1006, "x\r\ny"), (1007, (shared + "\n") * 300)]
    every = [r for r in rows if r[0] not in (904, None)] + more + [(None, f"no id\n{shared}")]
    odd = ("hash", "level", "gone", "row_", "id_", "tk_", "lines_", "lost_", "n_lines")
    df = spark.createDataFrame([(i, t, *range(len(odd))) for i, t in every], "doc_id long, text string, " + ", ".join(f"{c} int" for c in odd)).repartition(4)
    made = linechunks.dedup_lines(df)
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed_chunks, r.n_removed_lines, r.kept_text) for r in made.collect())
    assert got == lines_python(every)
    assert made.columns == [*(c for c in df.columns if c != "n_lines"), "n_lines", "n_removed_chunks", "n_removed_lines", "kept_text"]
    assert linechunks.dedup_lines(empty).count() == 0


def test_line_chunks_whose_hashes_collide(spark, rows, monkeypatch):
    every = [(k, t) for k, (_, t) in enumerate(rows[:30])] + [(100 + k, t) for k, (_, t) in enumerate(rows[:10])]
    real = linechunks.with_chunks
    few = lambda c: F.struct(c["begin"].alias("begin"), c["size"].alias("size"), F.pmod(c["hash"], F.lit(3).cast("long")).alias("hash"))
    monkeypatch.setattr(linechunks, "with_chunks", lambda *a: real(*a).withColumn("chunks_", F.transform("chunks_", few)))
    made = linechunks.dedup_lines(spark.createDataFrame(every, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed_chunks, r.n_removed_lines, r.kept_text) for r in made.collect()) == lines_python(every)


def test_line_chunks_catch_short_passages(spark):
    """The share of the lines of passages (of some lines, in two documents each) that goes from the second document."""
    rng = np.random.default_rng(3)
    line = lambda: " ".join(rng.choice([f"w{i}" for i in range(5000)], 12))
    for size, least in ((2, 0.15), (3, 0.3), (5, 0.6), (12, 0.82)):
        rows = []
        for k in range(150):
            passage = [line() for _ in range(size)]
            rows += [(10 * k + j, "\n".join([*(line() for _ in range(rng.integers(0, 9))), *passage, *(line() for _ in range(4))])) for j in (0, 1)]
        lost = sum(r[3] for r in lines_python(rows))
        assert lost >= least * 150 * size, (size, lost / 150 / size)


@pytest.mark.parametrize("crowd", [8192, 5])
def test_substrings(spark, rows, empty, crowd):
    base = rows[3][1]
    more = rows + [(2000 + i, f"{i * 7919 % 1000003:08d}" * 12 + base[:260] + f"{i * 104729 % 1000003:09d}" * 9) for i in range(25)]
    df = spark.createDataFrame([(i, t) for i, t in more], "doc_id long, text string").repartition(4)
    want = sorted(zip([str(i) for i, _ in more], substrings.remove_python([t for _, t in more]), strict=True))
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.report(substrings.remove_repeats(df, crowd)).collect())
    assert got == want
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_order_only_what_differs(monkeypatch):
    """Keys whose segments are all the same bytes need no suffix array: all of their windows repeat, or none."""
    rng = np.random.default_rng(3)
    same, once, core = (bytes(rng.integers(97, 123, n, np.uint8)) for n in (230, 220, 215))
    made = [(1, same, 0), (1, same, 0), (2, once, 0), (3, once[::-1], 1), (4, core + b"x", 0), (4, b"y" + core, 0)]
    columns = {
        "key": pa.array([k for k, _, _ in made], pa.int64()), "salt": pa.array([0] * 6, pa.int32()), "salts": pa.array([1] * 6, pa.int32()),
        "doc_id": pa.array([10, 11, 20, None, 40, 41], pa.int64()), "text_key": pa.array(range(6), pa.int64()), "again": pa.array([a for _, _, a in made], pa.int32()),
        "at": pa.array([5, 6, 7, 8, 9, 10], pa.int32()), "bytes": pa.array([b for _, b, _ in made], pa.binary()),
    }
    ordered, classes = [], substrings.classes
    monkeypatch.setattr(substrings, "classes", lambda data, starts: ordered.append(data.tobytes()) or classes(data, starts))
    found = [r for b in substrings.search_shards(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert sorted((r["text_key"], r["doc_id"], r["at"], r["n"]) for r in found) == [(0, 10, 5, 31), (1, 11, 6, 31), (3, None, 8, 21), (4, 40, 9, 16), (5, 41, 11, 16)]
    assert ordered == [core + b"x" + b"y" + core]


def traced_mb(step):
    """What a step gives, and the most MB of Python and numpy that it held at once; Arrow's own memory isn't traced."""
    tracemalloc.start()
    try:
        return step(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_substrings_hold_no_second_copy_of_a_batch():
    rng = np.random.default_rng(7)
    raw = rng.integers(97, 123, 96 << 20, np.uint8).tobytes()
    texts = pa.array([raw[i : i + (1 << 14)] for i in range(0, len(raw), 1 << 14)], pa.binary())
    number = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([number, number, texts], names=["doc_id", "text_key", "text"])
    _, mb = traced_mb(lambda: next(substrings.find_segments(iter([batch]))))
    assert mb < 80
    runs = pa.array([[{"at": 3, "n": 5}], None] * (len(texts) // 2), pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([number, texts, runs], names=["doc_id", "text", "runs"])
    rows, mb = traced_mb(lambda: sum(b.num_rows for b in substrings.without_runs(iter([batch]))))
    assert rows == len(texts) and mb < 30
    first = next(substrings.without_runs(iter([batch]))).slice(0, 2).to_pylist()
    kept = (raw[:3] + raw[207 : 1 << 14], raw[1 << 14 : 2 << 14])
    assert [tuple(r.values()) for r in first] == [(0, 1 << 14, 204, 1, kept[0]), (1, 1 << 14, 0, 0, kept[1])]


def test_substrings_pass_classes_on_in_little_memory():
    """A salted key whose segments all differ has a class for nearly each of their windows, and hundreds of bytes a class."""
    rng = np.random.default_rng(5)
    core = bytes(rng.integers(97, 123, 64, np.uint8))
    made = [bytes(rng.integers(97, 123, 136, np.uint8)) + core + bytes(rng.integers(97, 123, 136, np.uint8)) for _ in range(600)]
    made[7] = made[3]
    columns = {
        "key": pa.array([1] * 600, pa.int64()), "salt": pa.array([0] * 600, pa.int32()), "salts": pa.array([2] * 600, pa.int32()),
        "doc_id": pa.array(range(600), pa.int64()), "text_key": pa.array(range(600), pa.int64()), "again": pa.array([0] * 600, pa.int32()),
        "at": pa.array([5] * 600, pa.int32()), "bytes": pa.array(made, pa.binary()),
    }
    found, mb = traced_mb(lambda: list(substrings.search_shards(iter([pa.RecordBatch.from_pydict(columns)]))))
    rows = [r for b in found for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["at"], r["n"]) for r in rows if r["key"] is None) == [(3, 5, 137), (7, 5, 137)]
    lists = [r for r in rows if r["key"] is not None]
    windows = [r["windows"][i : i + 200] for r in lists for i in range(0, len(r["windows"]), 200)]
    assert sorted(windows) == sorted({t[i : i + 200] for t in made for i in range(137)})
    assert all(r["windows"] == b"".join(sorted(r["windows"][i : i + 200] for i in range(0, len(r["windows"]), 200))) for r in lists)
    assert mb < 100


def test_suffix_array():
    data = np.frombuffer(b"abracadabra" * 60 + bytes(range(256)) + b"abracadabra" * 20, np.uint8)
    sa, raw = substrings.suffix_array(data), data.tobytes()
    assert sorted(sa.tolist()) == list(range(len(data)))
    cut = [raw[i : i + 200] for i in sa]
    assert all(a <= b for a, b in zip(cut, cut[1:], strict=False))
    lcp = substrings.common_prefixes(data, sa)
    for k in range(1, len(sa), 37):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[sa[k]] >= min(n, 200) and (lcp[sa[k]] == min(n, 200) or n == min(len(a), len(b)))


def test_chat(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = [r"\### Assistant: </turn> ok", "", None, "a\\", "\\\\</turn>", "### x: y", "<|endoftext|> é́ \n", "long " * 30_000]
    rows = [(c, t, ("user", "assistant", "a:b###", None)[t % 4], texts[((c or 0) + t) % len(texts)]) for c in (1, 2, None) for t in range(8)] + [(1, 3, "user", "again"), (1, 3, "user", "again"), (1, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df, path), path).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(df.limit(0), path), path).count() == 0


def test_contamination(spark, docs, rows, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = word.findall(lower(rows[5][1]))
    items = [(1, " ".join(cut[:20])), (2, "X"), (3, None), (4, ""), (5, " ".join(cut[3:18]).upper()), (None, "x")]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    wins = {}
    for i, t in items:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if ids := wins.get(tuple(w[k : k + n])):
                    found |= ids
                    hit.update(range(k, k + n))
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for part, group in ((1 << 24, 1 << 24), (60, 1 << 24), (60, 150)):
        made = contamination.find_contamination(docs, bench, part_bytes=part, group_bytes=group)
        assert sorted((str(r[0]), *r[1:]) for r in contamination.report(made).collect()) == sorted(want)
    assert contamination.decontaminate(docs, bench).columns == docs.columns
    clean = sorted(w[0] for w in want if not w[2])
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("row_1", "items", "n_words", "item_id")])
    assert sorted(str(r.doc_id) for r in contamination.decontaminate(odd, bench).collect()) == clean
    assert contamination.find_contamination(empty, bench).count() == 0 and contamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_contamination_windows():
    """Every window of every length of item, at every place, and none that agrees in fewer words."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 6, 13):
        items = [(i, " ".join(rng.choice(list("abc") if n > 3 else list("abcdefgh"), k))) for i, k in enumerate([0, 1, n - 1, n, n + 1, 2 * n, 5 * n])]
        built = contamination.Benchmark(items, n)
        for _ in range(60):
            text = rng.choice(list("abcx"), 40).tolist()
            for _, t in items[3:]:
                w = t.split()
                a, at = rng.integers(0, len(w)), rng.integers(0, 30)
                text[at : at + len(w) - a] = w[a:]
            want, found = set(), set()
            for i, t in items:
                w = t.split()
                long = min(n, len(w))
                for s in range(len(w) - long + 1 if w else 0):
                    for p in range(len(text) - long + 1):
                        if text[p : p + long] == w[s : s + long]:
                            want.update(range(p, p + long))
                            found.add(i)
            ranges, ids = contamination.Scan(" ".join(text)).hits(built)
            assert {k for a, b in ranges for k in range(a, b)} == want and ids == found


PATTERNS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def test_secrets(spark, rows, empty):
    texts = ["secret= token: abcdef", "é API_KEY = 'abc123xyz' password:short", "AKIA" + "A" * 16 + "AKIA" + "B" * 16, "f" * 24 + "g" + "0" * 23, "secret=token=abcdefg" * 3, None, "", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "𝕏 passwd='s3cr3tpw'", "x " * 300_000 + "token=abcdefgh " * 500, "Token\n=abcdefg api-key: abcdefg apikey:abcdefg"]
    odd = ("mask", "secrets_", "key_", "text_key", "found0", "row_", "bits_")
    every = [*enumerate(texts), (1, texts[1]), (None, texts[2]), *rows]
    df = spark.createDataFrame([(i, t, *range(len(odd))) for i, t in every], "doc_id long, text string, " + ", ".join(f"{c} int" for c in odd)).repartition(4)
    made = secrets.scan(df)
    assert made.columns == [*df.columns, "secrets"]
    index = secrets.build_index(df, secrets.mandatory_trigrams(), 3)
    for found in (made, secrets.scan(df, index=index), secrets.scan(made)):
        got = found.collect()
        assert len(got) == len(every)
        for r in got:
            want = sorted((m.start(), k, name, m.end()) for k, (name, p, group, least) in enumerate(PATTERNS) for m in p.finditer(r.text or "") if len(m[group]) >= least)
            assert [tuple(s) for s in r.secrets if s.ord < 3] == want
            assert [tuple(s) for s in r.secrets] == secrets.find_python(r.text)
    assert secrets.scan(empty).count() == 0
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == () and secrets.trigram_query("AKIA[A-Z0-9]+") == (frozenset([frozenset(["aki", "kia"])]),)


def test_simhash(spark, docs, rows, empty):
    want = {}
    prints = [simhash_python(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    for k in range(len(rows)):
        want.setdefault(find(k), []).append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in want.items()}
    expected = sorted((str(rows[k][0]), f"{prints[k]:016x}", str(least[find(k)])) for k in range(len(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.report(simhash.groups(docs)).collect())
    assert got == expected
    assert simhash.groups(empty).count() == 0


def near_sets(n, pairs):
    """The components of n nodes."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return {frozenset(k for k in range(n) if find(k) == r) for r in {find(k) for k in range(n)}}


def simhash_python(text, shingle=4):
    """A fingerprint straight from its definition, a bit at a time."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[k : k + shingle]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(rows):
    more = [t for _, t in rows] + ["one", "one two", "a b c d", "A B c d e", "a b a b a b a b a b", "\u00a0x \x1c y\u2003z"]
    assert [simhash.fingerprint(t) for t in more] == [simhash_python(t) for t in more]


def test_links_are_whole(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for s in seeds for k in (1, 3, 4, 6)]
    crowd = [np.uint64((0xABCDE << 44) | int(x)) for x in rng.integers(0, 2**30, 100)]
    fps = np.unique(np.array([*seeds, *near, *crowd], np.uint64))
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for radius in (2, 4, 5):
        want = {tuple(sorted((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))) for i, j in zip(*np.where(np.triu(apart <= radius, 1)), strict=True)}
        whole = near_sets(len(fps), [(i, j) for i, j in zip(*np.where(np.triu(apart <= radius, 1)), strict=True)])
        number = {int(x): k for k, x in enumerate(fps.view(np.int64))}
        for full in (4096, 3):
            assert {tuple(r) for r in simhash.links(df, radius, crowd=full, every=True).collect()} == want
            some = {tuple(sorted(r)) for r in simhash.links(df, radius, crowd=full).collect()}
            assert some <= want and near_sets(len(fps), [(number[a], number[b]) for a, b in some]) == whole


def test_links_of_a_dense_cluster_are_few(spark):
    base = np.uint64(0x0123456789ABCDEF)
    fps = [int((base ^ np.uint64(sum(1 << b for b in bits))).view(np.int64)) for k in range(3) for bits in combinations(range(0, 64, 3), k)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for full in (4096, 50):
        found = simhash.links(df, crowd=full).collect()
        assert len(found) < 8 * len(fps) < len(fps) ** 2 / 8
        assert len({r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_near_copies(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(4000)]
    texts = [rng.choice(words, 400).tolist() for _ in range(60)]
    edited = [[*t[:150], "edited", *t[151:]] for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + edited)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert set(range(60)) <= kept and len(kept) <= 63
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("id_", "key_", "text_key", "root", "set_key", "k_")])
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd).count() == simhash.keep_one(docs).count()
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(empty).count() == 0


def near_groups(texts):
    """The groups of a brute-force comparison of all pairs."""
    cut = [(t or "").encode().translate(simhash.LOWER).split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)} for w in cut]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(sorted(k for k in range(len(texts)) if root[k] == r) for r in set(root))


def found_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    groups = {}
    for r in simhash.near_copies(df).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def test_near_copies_are_whole(spark, rows):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(3000)]
    common = rng.choice(words, 60).tolist()
    texts = [*(t for _, t in rows)]
    for k in range(40):
        t = [*rng.choice(words, 150 + 5 * k).tolist(), *common]
        n = len(t)
        part = rng.choice(words, int(n * (0.1 + 0.004 * k))).tolist()
        scattered = list(t)
        for at in rng.choice(n, 1 + k // 8, replace=False):
            scattered[at] = "edited"
        cut = int(n * (0.12 + 0.003 * k))
        texts += [" ".join(x) for x in (t, [*t[:70], *part, *t[70:]], [*t[:40], *t[40 + cut :]], scattered)]
    want = near_groups(texts)
    assert sum(len(g) > 1 for g in want) > 40 and found_groups(spark, texts) == want


def test_near_copies_of_equal_word_sets(spark):
    rng = np.random.default_rng(17)
    texts = []
    for k in range(12):
        y = rng.choice([f"t{k}word{i}" for i in range(200)], 200, replace=False).tolist()
        texts += [" ".join(x) for x in (*(rng.permutation(y).tolist() for _ in range(4)), y, [*y[:99], y[100], y[99], *y[101:]])]
    want = near_groups(texts)
    assert sum(len(g) == 2 for g in want) == 12 and found_groups(spark, texts) == want


def test_near_copies_propose_only_what_can_be_alike(spark):
    """146 shingles are in all texts; 12 more are a short text's own, 26 a long one's: only the short ones are alike (146 of 170; 146 of 184 aren't)."""
    core = [f"core{i}" for i in range(150)]
    texts = {(k, v): " ".join([*core, *(f"own{k}x{v}x{i}" for i in range(k))]) for k in (12, 26) for v in range(12)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    sets = simhash._sets(docs.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text"), 5, 0.8).cache()
    lists = simhash._meetings(sets, 0.8).withColumn("root", F.col("k"))
    short = sorted(r["set_key"] for r in sets.where("n = 158").collect())
    assert len(short) == 12
    assert sorted(map(tuple, simhash._proposed(lists, 0.8).collect())) == [(a, b) for i, a in enumerate(short) for b in short[i + 1 :]]
    assert found_groups(spark, list(texts.values())) == near_groups(list(texts.values()))


def test_pipeline_stages(spark, docs, rows, empty):
    """Every stage on rows with nulls, empty, long and repeated texts, clashing columns, and on an empty table."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near copies", "decontamination", "mixture", "tokens"]
    for stage in [*stages.values()][:4]:
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0
    assert stages["tokens"](spark, empty, SF).count() == 0
    name = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    own = sorted((str(i), str(t)) for i, t in rows)
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("toxicity", "id_", "key_", "root", "spans_", "items", "mix_shard", "found0")])

    real = table(spark, SF, "documents")
    machine = toxicity.fit(real, table(spark, SF, "labels"))
    scores = machine.score(pa.array([r.text for r in real.collect()]))
    kept = stages["toxicity"](spark, real, SF)
    assert name(kept) == sorted((str(r.doc_id), r.text) for r, s in zip(real.collect(), scores, strict=True) if s < 0.7)

    made = stages["near copies"](spark, odd, SF)
    groups = near_groups([t for _, t in rows])
    least = [min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups]
    assert made.columns == odd.columns and sorted(str(r.doc_id) for r in made.collect()) == sorted(map(str, least))

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(lower(t))
    wins = {tuple(w[k : k + 13]) for r in table(spark, SF, "benchmark").collect() for w in [cut(r.text)] for k in range(max(1, len(w) - 12))}
    clean = [(i, t) for i, t in rows if not any(tuple(w[k : k + 13]) in wins for w in [cut(t)] for k in range(len(w)))]
    assert len(clean) < len(rows) and name(stages["decontamination"](spark, odd, SF)) == sorted((str(i), str(t)) for i, t in clean)

    made = stages["mixture"](spark, odd, SF)
    copies = {}
    for r in made.select("doc_id", "text", "source").collect():
        copies.setdefault(r, []).append(r)
    assert made.columns == odd.columns and all(len(c) <= 3 * 2 for c in copies.values()) and {(str(r.doc_id), str(r.text)) for r in copies} <= {*own}
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    plan = mixing.taken(mixing.plan(odd)).select("source_size", "target").distinct().collect()
    by = {}
    for r in odd.collect():
        by.setdefault(r.source, []).append(size(r.text))
    taken = {s: sum(size(r.text) * len(c) for r, c in copies.items() if r.source == s) for s in by}
    for s, sizes in by.items():
        target = next(r.target for r in plan if r.source_size == sum(sizes))
        assert abs(taken[s] - target) <= max(sizes) / 2 + 1
    again = stages["mixture"](spark, odd.repartition(2), SF)
    assert name(again) == name(made)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns and 0.7 * docs.count() < made.count() <= docs.count(), name
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
