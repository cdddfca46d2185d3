"""Secret scans over a trigram index, with DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: strings that a match must contain, as an AND of ORs of ANDs
of trigrams (in lower case, so that one index serves all rules). The index has, for each trigram that some query
mentions and each block of texts, the texts that contain it; queries are answered by intersecting and uniting those
postings, block by block. Only the candidates of a rule are searched with its regex. A rule that has no mandatory
trigram scans every text.
"""

from __future__ import annotations

import re
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import barrier, dropping, stage, text_key


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads alike in Java and Python; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED
MOST_STRINGS, SMALL_CLASS = 32, 6

# ---------------------------------------------------------------- trigram queries

Query = tuple[frozenset[frozenset[str]], ...]  # all of: any of: all of these trigrams


def _class_members(items) -> list[str] | None:
    out = []
    for op, arg in items:
        if str(op) == "LITERAL":
            out.append(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < SMALL_CLASS:
            out += [chr(c) for c in range(arg[0], arg[1] + 1)]
        else:
            return None
    return out if len(out) <= SMALL_CLASS else None


def _choices(node) -> tuple[list[str] | None, list]:
    """(all strings that the node can match, clauses): no strings where they are many; then the clauses say what it contains."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg)], []
    if name == "IN":
        return _class_members(arg), []
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return [x for s, _ in parts for x in s], []
        return None, []
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = arg
        strings, clauses = _sequence(body)
        if most == 1 and strings is not None:
            return ["", *strings] if least == 0 else strings, []
        return None, clauses if least else []
    return None, []


def _sequence(nodes) -> tuple[list[str] | None, list]:
    """As for a node; the run of strings is closed, and its trigrams become a clause, where a part isn't a few strings."""
    run, clauses, exact = [""], [], True
    for node in nodes:
        strings, inner = _choices(node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = [a + b for a, b in product(run, strings)]
            continue
        clauses += [run, *inner]
        exact, run = False, [""]
        if strings is not None:
            run = strings
    if exact:
        return run, []
    return None, [*clauses, run]


def trigrams(text: str) -> frozenset[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` contains; empty where nothing is mandatory."""
    run, clauses = _sequence(parser.parse(pattern))
    out = []
    for strings in [run] if run is not None else clauses:
        options = [trigrams(s) for s in strings]
        if all(options):
            least = [o for o in set(options) if not any(p < o for p in options)]  # an option within another says it all
            out.append(frozenset(least))
    return tuple(out)


# ---------------------------------------------------------------- index and candidates


def build_index(docs: DataFrame, grams: list[str], block_texts: int = 4096) -> DataFrame:
    """(trigram, block, texts): the keys of the block's texts that contain the trigram, each text once."""
    low = barrier(docs.select(text_key("text").alias("text_key"), F.col("text").cast("string").alias("text")), low=F.lower("text"))
    held = F.filter(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    rows = low.select("text_key", F.explode(held).alias("trigram"))
    blocks = max(1, docs.count() // block_texts)
    rows = rows.select("trigram", F.pmod("text_key", F.lit(blocks)).alias("block"), "text_key")
    return rows.groupBy("trigram", "block").agg(F.collect_set("text_key").alias("texts"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(text_key, mask): bit i is set where the text meets query i. Postings are of one block, so of bounded length."""
    none = F.array().cast("array<long>")
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("postings"))

    def posting(g: str) -> Column:
        return F.coalesce(F.element_at("postings", F.lit(g)), none)

    def answer(query: Query) -> Column:
        made = None
        for clause in query:
            united = None
            for grams in sorted(clause, key=sorted):
                both = None
                for g in sorted(grams):
                    both = posting(g) if both is None else F.array_intersect(both, posting(g))
                united = both if united is None else F.array_union(united, both)
            made = united if made is None else F.array_intersect(made, united)
        return made

    found = F.flatten(F.array(*[_tagged(answer(q), 1 << i) for i, q in queries.items()]))
    return blocks.select(F.inline(found)).groupBy("text_key").agg(F.bit_or("bit").alias("mask"))


def _tagged(texts: Column, bit: int) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text_key"), F.lit(bit).cast("long").alias("bit")))


SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _spans(rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in ``text``, in code points: the lengths of what is between matches and of the matches add up."""
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.char_length(x))
    sizes = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), lambda x: F.char_length(x))
    tests = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.char_length(x) >= rule.least)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (begin + m["size"]).alias("end"))
        return F.struct((begin + m["size"]).alias("at"), F.when(m["good"], F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), F.zip_with(sizes, tests, lambda s, g: F.struct(s.alias("size"), g.alias("good"))), lambda a, b: F.struct(a.alias("gap"), b["size"].alias("size"), b["good"].alias("good")))
    return F.aggregate(zipped, start, step, lambda s: s["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_texts: int = 4096, index: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``secrets`` (in place of a column of that name): array of (start, ord, kind, end) by start, then rule; code points, end exclusive.

    ``index``: one that :func:`build_index` made of these documents for these rules' trigrams, to be used again. Null texts
    are empty. Texts that repeat share their index entries. Long texts are searched whole. An empty table gives an empty
    result; other columns pass through, whatever they are called.
    """
    if len(set(docs.columns)) < len(docs.columns):
        raise ValueError("column names of documents must differ")
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    text = F.col("text").cast("string")
    made = docs.select(row, text.alias("text"), text_key(text).alias("text_key"))
    if queries:
        with dropping(docs.sparkSession):
            if index is None:
                index = stage(build_index(docs, mandatory_trigrams(rules), block_texts), "trigram-index")
            masks = stage(candidates(index, queries), "trigram-candidates", keep=True).withColumnsRenamed({"text_key": "key_", "mask": "bits_"})
        made = made.join(masks, F.col("text_key") == F.col("key_"), "left").withColumn("mask", F.coalesce("bits_", F.lit(0).cast("long")))
    else:
        made = made.withColumn("mask", F.lit(0).cast("long"))
    none = F.array().cast(SPAN)
    columns = {}
    for i, rule in enumerate(rules):
        wanted = F.col("mask").bitwiseAND(1 << i) != 0 if i in queries else F.col("text").isNotNull()
        columns[f"found{i}"] = F.when(wanted & F.col("text").rlike(rule.pattern), _spans(rule, i)).otherwise(none)
    made = barrier(made, **columns)
    return made.select(*[F.col(f"row_.`{c}`") for c in docs.columns if c != "secrets"], F.array_sort(F.concat(*columns)).alias("secrets"))


def mandatory_trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that some rule's query mentions."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    own = F.filter("secrets", lambda s: s["ord"] < len(base))
    counts = [F.size(_of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def _of(order: int) -> Column:
    return F.filter("secrets", lambda s: s["ord"] == order)


def find_python(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """The same spans, straight from the regexes: what tests compare with."""
    out = []
    for i, r in enumerate(rules):
        out += [(m.start(), i, r.kind, m.end()) for m in re.compile(r.pattern, re.ASCII).finditer(text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def _rule_sql(order: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"SELECT r, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}, 0) AS hits, regexp_extract_all(text, {pattern}, {rule.group}) AS tests FROM d WHERE regexp_matches(text, {pattern})"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))}),
e AS (SELECT r, ord, kind, least, i, length(gaps[i]) AS gap, length(hits[i]) AS size, length(tests[i]) AS tested FROM m, unnest(range(1, len(hits) + 1)) AS u(i)),
s AS (SELECT *, SUM(gap + size) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM e),
f AS (SELECT r, ord, stop - size AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS name FROM s WHERE tested >= least)
SELECT d.doc_id, {", ".join(f"COUNT(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
       sha256(COALESCE(string_agg(name, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '')) AS base_sha256,
       COALESCE(string_agg(name, ',' ORDER BY start, ord), '') AS spans
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id
"""
