"""Chat formatting at token level.

Every segment of a turn (role, text) is encoded by itself and joined with reserved ids that no text can produce, so a
tokenizer never merges across a border. The rendered form of a turn is ``### role: text</turn>`` and a line feed; a
backslash goes before each backslash and each control string of a role or text, which is undone by dropping one
backslash before any character. The loss mask covers the texts of the assistant's turns, as token ranges from prefix
sums of the segments' lengths.

A conversation is written in rows of whole turns, about ``ROW`` tokens each, so none has to fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import stage
from tarnlake.llm.tokens import ragged

TURN, ROLE_END, TURN_END, ROW = 0, 1, 2, 1 << 16  # reserved ids, counted from the end of the vocabulary
RENDERED = {TURN: "### ", ROLE_END: ": ", TURN_END: "</turn>\n"}
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
LEARNED = "assistant"


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S) if b"\\" in text else text


@lru_cache(4)
def load(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and how many each has; the three reserved ids have none."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(visible)]
    value = {**{chr(x): x for x in visible}, **{chr(256 + i): x for i, x in enumerate(hidden)}}
    model = load(path)
    if "ByteLevel" not in model.to_str():
        raise ValueError("a byte-level tokenizer is needed: others don't give a text's bytes back")
    names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    every = [bytes(value[c] for c in x) if all(c in value for c in x) else x.encode() for x in names] + [b""] * 3
    return np.frombuffer(b"".join(every), np.uint8), np.array([len(x) for x in every], np.int64)


def encode_turns(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text, with ids (u32 little-endian) of the turn and the lengths of its two segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        first = model.get_vocab_size()
        start, middle, stop = (np.array([first + k], "<u4").tobytes() for k in (TURN, ROLE_END, TURN_END))
        names: dict[str, bytes] = {}
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                roles = [r or "" for r in part.column(2).to_pylist()]
                for r in set(roles) - names.keys():
                    names[r] = np.array(model.encode(escape(r, ROLE_CONTROL), add_special_tokens=False).ids, "<u4").tobytes()
                texts = model.encode_batch_fast([escape(t or "") for t in part.column(3).to_pylist()], add_special_tokens=False)
                coded = [np.array(t.ids, "<u4").tobytes() for t in texts]
                ids = [start + names[r] + middle + c + stop for r, c in zip(roles, coded, strict=True)]
                sizes = pa.array([len(names[r]) // 4 for r in roles], pa.int32()), pa.array([len(c) // 4 for c in coded], pa.int32())
                learn = pa.array([r == LEARNED for r in roles])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(ids, pa.binary()), *sizes, learn], names=["conv_id", "turn", "role", "text", "ids", "n_role", "n_text", "learn"])

    source = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, n_role int, n_text int, learn boolean")


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, row, ids (array of int), loss_begin and loss_end (token ranges of the row under the mask)."""

    def pack(held: list[tuple]) -> tuple:
        sizes = np.array([(1, r, 1, t, 1) for _, r, t, _ in held]).ravel()
        learn = np.array([(False, False, False, x, False) for _, _, _, x in held]).ravel()
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(b for b, _, _, _ in held), "<u4")
        return ids.astype(np.int32), (ends - sizes)[learn].astype(np.int32), ends[learn].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, row = object(), [], 0, 0
        for batch in batches:
            out = []
            for conv, ids, n_role, n_text, learn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "n_role", "n_text", "learn")), strict=True):
                if held and (conv != now or size >= ROW):
                    out.append((now, row, *pack(held)))
                    row = row + 1 if conv == now else 0
                    held, size = [], 0
                now = conv
                held.append((ids, n_role, n_text, learn))
                size += len(ids) // 4
            if out:
                yield _rows(out)
        if held:
            yield _rows([(now, row, *pack(held))])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "n_role", "n_text", "learn")
    return ordered.mapInArrow(run, "conv_id long, row int, ids array<int>, loss_begin array<int>, loss_end array<int>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "row", "ids", "loss_begin", "loss_end"])


def format_chat(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """The formatted conversations, written to the shared folder: see :func:`assemble`.

    Turns go by number, then role and text; rows that repeat are turns of their own. Null texts and roles are empty,
    null conv_ids are one conversation, null turns come first. An empty table gives no row. Other columns don't matter.
    """
    return stage(assemble(encode_turns(conversations, tokenizer)), "chat")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the token ids and the mask alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = token_bytes(tokenizer), load(tokenizer).get_vocab_size()
        now, state, out = object(), None, []
        for batch in batches:
            ids, begins, ends = (batch.column(c) for c in ("ids", "loss_begin", "loss_end"))
            parts = [(np.asarray(c.offsets), np.asarray(c.values)) for c in (ids, begins, ends)]
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.result()))
                    now, state = conv, _Reading()
                state.add(*(v[o[k] : o[k + 1]] for o, v in parts), table, first)
            if out:
                yield _results(out)
                out = []
        if state is not None:
            yield _results([(now, *state.result())])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "row")
    return ordered.mapInArrow(run, schema)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


class _Reading:
    """Digests of one conversation, a row at a time."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray], first: int) -> None:
        raw, sizes = ragged(*table, ids)
        at = np.concatenate([[0], np.cumsum(sizes)])
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # bytes that begin a character
        data, marks = raw.tobytes(), np.flatnonzero(ids >= first)
        cuts = at[marks].tolist()
        for k in range(0, len(cuts), 3):  # a turn has three marks: before the role, before the text, after it
            self.turns.update(unescape(data[cuts[k] : cuts[k + 1]]) + b"\n" + unescape(data[cuts[k + 1] : cuts[k + 2]]) + b"\n")
        self.n_turns += len(cuts) // 3
        self.chars += int(chars[-1]) + len(cuts) // 3 * sum(map(len, RENDERED.values()))
        for a, b in zip(at[begins].tolist(), at[ends].tolist(), strict=True):
            plain = unescape(data[a:b])
            self.loss.update(plain)
            self.loss_chars += len(plain.decode())

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


#: For turns that differ in number within a conversation.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, role)),
e AS (SELECT *, 14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars FROM t)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       SUM(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
