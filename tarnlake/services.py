"""What stands around the tables: configuration, result caches, metrics, memory, file skipping, maintenance by days, charts, tools."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import Unsupported, ValidationError
from tarnlake.functions import Expr
from tarnlake.operators.store import may_match

# ---------------------------------------------------------------- configuration

ENVIRONMENT = {"uri": "TARNLAKE_URI", "type": "TARNLAKE_TYPE", "warehouse": "TARNLAKE_WAREHOUSE", "token": "TARNLAKE_TOKEN", "oauth2-server-uri": "TARNLAKE_OAUTH2_SERVER_URI"}


def config_from_env(environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of the catalog that the environment names; the kind is ``folder`` where it names none."""
    source = os.environ if environment is None else environment
    found = {key: source[name] for key, name in ENVIRONMENT.items() if source.get(name)}
    return {"type": "folder"} | found


def check_config(config: Mapping[str, Any]) -> None:
    """A folder needs a warehouse; a remote catalog needs its address, and without credentials is worth a warning."""
    kind = config.get("type")
    needed = {"folder": ["warehouse"]}.get(kind, ["uri"])
    if missing := [k for k in ["type", *needed] if not config.get(k)]:
        raise ValueError(f"not configured: {missing}")
    if kind == "rest" and not any(k in ("token", "credential", "oauth2-server-uri", "rest.signing-name") or k.startswith("rest.sigv4") for k in config):
        warnings.warn("a remote catalog without credentials or signing", UserWarning, stacklevel=2)


def table_identifier(name: str, namespace: str | None = None) -> str:
    """``namespace.table``; a dotted name keeps its own namespace."""
    return name if "." in name else f"{namespace or 'default'}.{name}"


def plain_summary(values: Mapping[str, Any] | None) -> dict[str, str]:
    """Snapshot properties as strings; those without a value are left out."""
    return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in (values or {}).items() if v is not None}


def utc_ms(moment: datetime) -> int:
    """Milliseconds since 1970; a time without zone is UTC."""
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def days_ago_ms(days: float) -> int:
    return utc_ms(datetime.now(timezone.utc) - timedelta(days=days))


# ---------------------------------------------------------------- caches


class DiskCache:
    """Results as Parquet under a folder, by their plans; the oldest go when they take more than ``max_bytes``."""

    def __init__(self, folder: str, max_bytes: int = 1 << 30):
        self.folder, self.max_bytes = os.path.abspath(folder), max_bytes
        os.makedirs(self.folder, exist_ok=True)

    @staticmethod
    def key(df: DataFrame) -> str:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized()
        return hashlib.sha256(f"{plan.toString()}|{sorted(df.inputFiles())}|{df.schema.json()}".encode()).hexdigest()

    def _entry(self, key: str) -> dict | None:
        path = f"{self.folder}/{key}.json"
        if not os.path.exists(path):
            return None
        with open(path) as f:
            entry = json.load(f)
        if entry["expires"] is not None and time.time() > entry["expires"]:
            self._drop(key)
            return None
        return entry

    def _entries(self, but: str | None = None) -> dict[str, dict]:
        names = [n[:-5] for n in os.listdir(self.folder) if n.endswith(".json") and n[:-5] != but]
        return {n: e for n in names if (e := self._entry(n))}

    def _drop(self, key: str) -> None:
        path = f"{self.folder}/{key}.json"
        if os.path.exists(path):
            with open(path) as f:
                shutil.rmtree(json.load(f)["path"], ignore_errors=True)
            os.remove(path)

    def get(self, df: DataFrame, tables: set[str] = frozenset(), ttl: float | None = None) -> DataFrame:
        """The result of ``df``, read back; made and kept where it isn't there or has expired."""
        key = self.key(df)
        entry = self._entry(key)
        if entry is None:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            size = sum(os.path.getsize(f"{path}/{n}") for n in os.listdir(path))
            entry = {"path": path, "tables": sorted(tables), "made": time.time(), "expires": None if ttl is None else time.time() + ttl, "bytes": size}
            with open(f"{self.folder}/{key}.json", "w") as f:
                json.dump(entry, f)
            held = sorted(((k, e) for k, e in self._entries(but=key).items()), key=lambda x: x[1]["made"])
            while held and size + sum(e["bytes"] for _, e in held) > self.max_bytes:
                self._drop(held.pop(0)[0])
        return df.sparkSession.read.schema(df.schema).parquet(entry["path"])

    def invalidate(self, table: str | None = None) -> None:
        for key, entry in self._entries().items():
            if table is None or table in entry["tables"]:
                self._drop(key)

    clear = invalidate

    def stats(self) -> dict[str, Any]:
        entries = self._entries()
        return {"size": len(entries), "bytes": sum(e["bytes"] for e in entries.values()), "folder": self.folder}


# ---------------------------------------------------------------- metrics, memory, advice


@dataclass
class QueryMetrics:
    query_id: str
    table: str
    started: float
    ended: float | None = None
    rows_returned: int = 0
    cache_hit: bool = False
    error: str | None = None

    def duration_ms(self) -> float:
        return 0.0 if self.ended is None else 1000 * (self.ended - self.started)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self) | {"duration_ms": self.duration_ms()}


@dataclass
class MetricsCollector:
    """Running and past queries, the last ``most`` of them."""

    most: int = 10_000
    held: dict[str, QueryMetrics] = field(default_factory=dict)

    def start(self, table: str) -> str:
        name = uuid.uuid4().hex
        self.held[name] = QueryMetrics(name, table, time.time())
        while len(self.held) > self.most:
            del self.held[next(iter(self.held))]
        return name

    def end(self, query_id: str, rows_returned: int = 0, cache_hit: bool = False, error: str | None = None) -> None:
        if (m := self.held.get(query_id)) is not None:
            m.ended, m.rows_returned, m.cache_hit, m.error = time.time(), rows_returned, cache_hit, error

    def stats(self) -> dict[str, Any]:
        every = [*self.held.values()]
        done = [m.duration_ms() for m in every if m.ended is not None]
        share = lambda test: sum(map(test, every)) / len(every) if every else 0.0
        return {"queries": len(every), "mean_ms": sum(done) / len(done) if done else 0.0, "cache_hit_rate": share(lambda m: m.cache_hit), "error_rate": share(lambda m: m.error is not None), "rows_returned": sum(m.rows_returned for m in every)}

    def recent(self, n: int = 10) -> list[dict[str, Any]]:
        return [m.to_dict() for m in reversed([*self.held.values()][-n:])]


class MemoryGuard:
    """A limit on the driver's own memory, for reads that pass rows through it."""

    def __init__(self, max_mb: float | None = None):
        self.max_mb = max_mb

    @staticmethod
    def usage_mb() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)

    def check(self) -> None:
        if self.max_mb and (now := self.usage_mb()) > self.max_mb:
            raise MemoryError(f"{now:.0f} MB of memory, {self.max_mb} allowed")

    def guarded(self, parts: Iterator) -> Iterator:
        for part in parts:
            self.check()
            yield part


class DataSkipper:
    """Counts of the files that statistics ruled out."""

    def __init__(self) -> None:
        self.skipped = self.scanned = 0

    def can_skip(self, stats: dict[str, list], condition: Expr) -> bool:
        """``stats``: (kind, min, max) by column, as manifests have them."""
        made = not may_match(stats, condition.bounds)
        self.record(made)
        return made

    def record(self, skipped: bool) -> None:
        self.skipped += skipped
        self.scanned += not skipped

    def stats(self) -> dict[str, float]:
        total = self.skipped + self.scanned
        return {"skipped": self.skipped, "scanned": self.scanned, "skip_rate": self.skipped / total if total else 0.0}


def advice(query: Any) -> dict[str, Any]:
    """What a builder query reads, and what could make it read less."""
    df = query.dataframe()
    hints = []
    if not query.filters:
        hints.append("no filter: every file is read")
    elif not any(isinstance(f, Expr) and f.bounds for f in query.filters):
        hints.append("no filter compares a column with a value: no file can be skipped")
    if not query.selected:
        hints.append("all columns are read: select those that are needed")
    if query.order and query.n is None:
        hints.append("ordered without a limit: the whole result is sorted")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {"table": query.table, "has_filters": bool(query.filters), "has_aggregations": query.keys is not None, "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"), "suggestions": hints}


# ---------------------------------------------------------------- maintenance by days


class Maintenance:
    """A lake's tables by name; ages in days."""

    def __init__(self, lake: Any):
        self.lake = lake

    def expire_snapshots(self, name: str, older_than_days: float = 7, retain_last: int = 1) -> list[int]:
        return self.lake.call_procedure(name, "expire_snapshots", older_than_ms=days_ago_ms(older_than_days), retain_last=retain_last)

    def remove_orphan_files(self, name: str, older_than_days: float = 3, dry_run: bool = True) -> list[str]:
        return self.lake.call_procedure(name, "remove_orphan_files", older_than_ms=days_ago_ms(older_than_days), dry_run=dry_run)

    def compact_data_files(self, name: str, target_file_size_mb: int = 128, filter_expr: Any = None, min_input_files: int = 2, partition_filter: dict | None = None, deduplicate: bool = False, retries: int = 3, **options: Any) -> dict:
        """Compaction, started again when another writer commits first. ``partition_filter``: {column: value}."""
        from tarnlake.errors import CommitConflict
        from tarnlake.functions import column_of

        condition = None if filter_expr is None else F.expr(filter_expr) if isinstance(filter_expr, str) else column_of(filter_expr)
        for column, value in (partition_filter or {}).items():
            own = F.col(column).isNull() if value is None else F.col(column) == F.lit(value)
            condition = own if condition is None else condition & own
        for attempt in range(retries + 1):
            try:
                return self.lake.call_procedure(name, "rewrite_data_files", target_mb=target_file_size_mb, condition=condition, min_files=min_input_files, deduplicate=deduplicate, **options)
            except CommitConflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def z_order_optimize(self, name: str, columns: list[str], **options: Any) -> dict:
        return self.lake.call_procedure(name, "rewrite_data_files", z_order=columns, min_files=1, **options)

    def sort(self, name: str, columns: list, **options: Any) -> dict:
        return self.lake.call_procedure(name, "rewrite_data_files", sort=columns, min_files=1, **options)

    def rewrite_manifests(self, name: str) -> dict:
        return self.lake.call_procedure(name, "rewrite_manifests")


# ---------------------------------------------------------------- charts, tools


class Charts:
    """Data of charts, made where the rows are; drawn where matplotlib is there."""

    def __init__(self, lake: Any):
        self.lake = lake

    def histogram(self, name: str, column: str, bins: int = 20) -> DataFrame:
        return self.lake.histogram(name, column, bins)

    def bars(self, name: str, column: str, n: int = 20) -> DataFrame:
        return self.lake.table(name).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)

    def points(self, name: str, x: str, y: str, n: int = 1000, seed: int = 0) -> DataFrame:
        """A sample of about ``n`` points."""
        df = self.lake.table(name).select(x, y)
        total = df.count()
        return df.sample(min(1.0, n / total), seed) if total else df

    def draw(self, data: DataFrame, kind: str = "bar", **options: Any) -> Any:
        try:
            import matplotlib  # noqa: F401
        except ImportError:
            raise Unsupported("drawing needs matplotlib") from None
        return data.toPandas().plot(kind=kind, **options)


class Tools:
    """What an interactive client may call, each answer capped in rows and bytes; no changes."""

    READS = ("select", "with", "values", "show", "describe", "explain")

    def __init__(self, lake: Any, rows: int = 1000, size: int = 5 << 20):
        self.lake, self.rows, self.size = lake, rows, size
        self.known: dict[str, Callable[..., Any]] = {f.__name__: f for f in (self.list_tables, self.describe_table, self.table_stats, self.query, self.read)}

    def list_tables(self, namespace: str = "default") -> list[str]:
        return self.lake.list_tables(namespace)

    def describe_table(self, name: str) -> list[dict]:
        return [{"name": x.name, "type": x.dataType.simpleString(), "nullable": x.nullable} for x in self.lake.open(name).schema]

    def table_stats(self, name: str) -> dict:
        return self.lake.stats(name)

    def query(self, sql: str) -> dict:
        if sql.strip().split(None, 1)[:1] == [] or sql.strip().split(None, 1)[0].lower() not in self.READS:
            raise ValidationError(f"only {', '.join(self.READS)}")
        return self._capped(self.lake.sql(sql))

    def read(self, name: str, columns: list[str] | None = None, filter_sql: str | None = None, limit: int = 100) -> dict:
        return self._capped(self.lake.read_table(name, columns, filter_sql=filter_sql, limit=limit))

    def _capped(self, df: DataFrame) -> dict:
        rows, cut = self.lake.capped(df, self.rows, self.size)
        return {"rows": rows, "truncated": cut}

    def call(self, tool: str, /, **arguments: Any) -> Any:
        if tool not in self.known:
            raise ValueError(f"unknown tool {tool}: one of {sorted(self.known)}")
        return self.known[tool](**arguments)

    def serve(self, lines: Iterator[str], out: Callable[[str], Any]) -> None:
        """Answers requests of a line of JSON each, {"id", "tool", "arguments"}, with a line each."""
        for line in lines:
            if not line.strip():
                continue
            request: dict = {}
            try:
                request = json.loads(line)
                answer = {"result": self.call(request["tool"], **request.get("arguments", {}))}
            except Exception as e:  # noqa: BLE001 - reported to the client
                answer = {"error": f"{type(e).__name__}: {e}"}
            out(json.dumps({"id": request.get("id"), **answer}, default=str))


def html_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an HTML table, for notebooks."""
    from html import escape

    got = df.limit(rows).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in got)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def load_magic(shell: Any, lake: Any) -> None:
    """Register the cell magic ``%%lake`` in an interactive shell: its text is run as SQL, a name on its line keeps the result."""

    def run(line: str, cell: str) -> DataFrame:
        made = lake.sql(cell)
        if line.strip():
            shell.user_ns[line.strip()] = made
        return made

    shell.register_magic_function(run, "cell", "lake")
