"""``Lake``: one warehouse of versioned tables, with queries, SQL, changes, maintenance, quality and services."""

from __future__ import annotations

import asyncio
import contextlib
import json
import os
import re
import shutil
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import timezone
from functools import partial, reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import sources
from tarnlake.errors import CatalogError, SchemaError, TableNotFound, Unsupported, ValidationError
from tarnlake.functions import Expr, column_of, named
from tarnlake.operators.quality import Validator, describe, profile
from tarnlake.operators.store import Table, parse_spec, read_manifest, write_manifest
from tarnlake.plans import Query
from tarnlake.services import Charts, Maintenance, MetricsCollector, Tools
from tarnlake.types import schema_of


def split_name(name: str) -> tuple[str, str]:
    """Namespace (``default`` where none is given) and table of a dotted name."""
    space, _, table = name.rpartition(".")
    if not table:
        raise ValueError(f"no table name in {name!r}")
    return space or "default", table


def _column(condition: Any) -> Column:
    return F.expr(condition) if isinstance(condition, str) else column_of(condition)


def _bounds(condition: Any) -> tuple:
    return condition.bounds if isinstance(condition, Expr) else ()


class ResultCache:
    """Persisted results by plan, with a life time, dropped when one of their tables changes."""

    def __init__(self, most: int = 128, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.most, self.level, self.hits, self.misses = most, level, 0, 0
        self.held: dict[int, tuple[DataFrame, float, frozenset[str], float]] = {}

    def get(self, df: DataFrame, tables: set[str], ttl: float) -> DataFrame:
        now, key = time.monotonic(), df.semanticHash()
        for k in [k for k, (_, end, _, _) in self.held.items() if end <= now]:
            self._drop(k)
        if key in self.held and not self.held[key][0].sameSemantics(df):  # another plan of that hash
            self._drop(key)
        self.hits += key in self.held
        self.misses += key not in self.held
        if key not in self.held:
            while len(self.held) >= self.most:
                self._drop(min(self.held, key=lambda k: self.held[k][3]))
            self.held[key] = (df.persist(self.level), now + ttl, frozenset(".".join(split_name(t)) for t in tables), now)
        return self.held[key][0]

    def _drop(self, key: int) -> None:
        self.held.pop(key)[0].unpersist()

    def clear(self) -> None:
        self.invalidate()

    def stats(self) -> dict[str, Any]:
        now = time.monotonic()
        return {"size": len(self.held), "most": self.most, "hits": self.hits, "misses": self.misses, "entries": [{"tables": sorted(t), "seconds_left": end - now} for _, end, t, _ in self.held.values()]}

    def invalidate(self, table: str | None = None) -> None:
        name = ".".join(split_name(table)) if table else None
        for k in [k for k, v in self.held.items() if name is None or name in v[2]]:
            self._drop(k)


class Lake:
    registered: set[str] = set()  # views that lakes of this process have made

    def __init__(self, spark: SparkSession, warehouse: str, frames: dict[str, DataFrame] | None = None):
        self.spark, self.warehouse = spark, warehouse.removeprefix("file://").rstrip("/")
        self.frames = dict(frames or {})
        self.results, self.metrics = ResultCache(), MetricsCollector()
        os.makedirs(self.warehouse, exist_ok=True)

    # -- names, namespaces, tables

    def _root(self, name: str) -> str:
        space, table = split_name(name)
        return f"{self.warehouse}/{space}/{table}"

    def open(self, name: str) -> Table:
        return Table(self.spark, self._root(name), name)

    get_table = alter_table = partition_by = evolve_partition = open

    def create_namespace(self, name: str, properties: dict | None = None) -> None:
        os.makedirs(f"{self.warehouse}/{name}", exist_ok=True)
        self.update_namespace_properties(name, properties or {})

    def drop_namespace(self, name: str) -> None:
        if self.list_tables(name):
            raise CatalogError(f"{name} has tables")
        if not os.path.isdir(f"{self.warehouse}/{name}"):
            raise CatalogError(f"no namespace {name}")
        shutil.rmtree(f"{self.warehouse}/{name}")

    def list_namespaces(self, parent: str | None = None) -> list[tuple[str, ...]]:
        names = sorted(d for d in os.listdir(self.warehouse) if os.path.isdir(f"{self.warehouse}/{d}") and not d.startswith("_"))
        return [tuple(n.split(".")) for n in names if parent is None or n.startswith(parent + ".")]

    def namespace_properties(self, name: str) -> dict:
        path = f"{self.warehouse}/{name}/_properties.json"
        if not os.path.exists(path):
            return {}
        with open(path) as f:
            return json.load(f)

    def update_namespace_properties(self, name: str, updates: dict | None = None, removals: list[str] = ()) -> dict:
        now = {k: v for k, v in (self.namespace_properties(name) | (updates or {})).items() if k not in removals}
        with open(f"{self.warehouse}/{name}/_properties.json", "w") as f:
            json.dump(now, f)
        return now

    def list_tables(self, namespace: str = "default") -> list[str]:
        base = f"{self.warehouse}/{namespace}"
        return sorted(f"{namespace}.{t}" for t in os.listdir(base) if Table.exists(f"{base}/{t}")) if os.path.isdir(base) else []

    def table_exists(self, name: str) -> bool:
        return Table.exists(self._root(name))

    def create_table(self, name: str, schema: Any, partition_spec: Any = None, sort_order: Any = None, properties: dict | None = None) -> Table:
        """An empty table; a frame as ``schema`` gives its columns only."""
        if self.table_exists(name):
            raise CatalogError(f"{name} exists")
        sort = [[s] if isinstance(s, str) else [*s] for s in sort_order or []]
        shape = schema_of(schema)
        for s in sort:
            if s[0] not in shape.names:
                raise SchemaError(f"no column {s[0]}")
        return Table.create(self.spark, self._root(name), name, shape, parse_spec(partition_spec), sort, properties or {})

    def register_table(self, name: str, path: str) -> Table:
        """Adopt a table folder that lies elsewhere."""
        if not Table.exists(path):
            raise TableNotFound(path)
        os.makedirs(os.path.dirname(self._root(name)), exist_ok=True)
        os.symlink(path, self._root(name))
        return self.open(name)

    def drop_table(self, name: str) -> None:
        self.open(name)
        root = self._root(name)
        os.unlink(root) if os.path.islink(root) else shutil.rmtree(root)
        self.results.invalidate(name)

    # -- reading

    def table(self, name: str, bounds: tuple = ()) -> DataFrame:
        return self.frames[name] if name in self.frames else self.open(name).read(bounds=bounds)

    def read_table(self, name: str, columns: list[str] | None = None, filter: Any = None, filter_sql: str | None = None, limit: int | None = None, snapshot_id: int | None = None, as_of_timestamp: int | None = None, branch: str = "main") -> DataFrame:  # noqa: A002
        if filter is not None and filter_sql is not None:
            raise ValidationError("either filter or filter_sql")
        bounds = filter.bounds if isinstance(filter, Expr) else ()
        df = self.frames[name] if name in self.frames else self.open(name).read(snapshot_id, as_of_timestamp, branch, bounds)
        condition = filter_sql if filter is None else filter
        if condition is not None:
            df = df.where(condition if isinstance(condition, str) else column_of(condition))
        df = df.select(*columns) if columns else df
        return df if limit is None else df.limit(limit)

    def query(self, name: str) -> Query:
        return Query(self, name, lambda bounds: self.table(name, bounds))

    def over(self, df: DataFrame) -> Query:
        """A query over any DataFrame."""
        return Query(self, None, lambda bounds: df)

    def head(self, name: str, n: int = 5) -> DataFrame:
        return self.table(name).limit(n)

    def describe(self, name: str) -> DataFrame:
        return describe(self.table(name))

    def count_rows(self, name: str) -> int:
        return self.open(name).row_count()

    def scan_batches(self, name: str, columns: list[str] | None = None, filter: Any = None, batch_size: int = 10_000) -> Iterator:  # noqa: A002
        """Arrow batches of the table's types, a partition at a time."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        df, held = self.read_table(name, columns, filter), []
        shape, times = to_arrow_schema(df.schema), [x.name for x in df.schema if x.dataType.simpleString() == "timestamp"]
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(True))
            for c in times:  # rows have times of this machine's zone, without it
                held[-1][c] = held[-1][c] and held[-1][c].astimezone(timezone.utc)
            if len(held) == batch_size:
                yield pa.RecordBatch.from_pylist(held, shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, shape)

    def read_table_chunked(self, name: str, chunk_size: int = 10_000, columns: list[str] | None = None, max_memory_mb: float | None = None) -> Iterator:
        """Arrow tables of ``chunk_size`` rows; MemoryError where the driver's process takes more than allowed."""
        import pyarrow as pa

        from tarnlake.services import MemoryGuard

        for batch in MemoryGuard(max_memory_mb).guarded(self.scan_batches(name, columns, batch_size=chunk_size)):
            yield pa.Table.from_batches([batch])

    def to_arrow(self, name: str):
        return self.table(name).toArrow()

    def to_pandas(self, name: str):
        return self.table(name).toPandas()

    lazy = table

    def read_tables_parallel(self, names: list[str], max_workers: int = 4) -> dict[str, Any]:
        return dict(zip(names, self.execute_parallel(self.table, names, max_workers), strict=True))

    @staticmethod
    def execute_parallel(function: Callable, items: list, max_workers: int = 4) -> list:
        """Results in order; a failure is {"error": text}."""

        def one(x: Any) -> Any:
            try:
                return function(x)
            except Exception as e:  # noqa: BLE001 - reported to the caller
                return {"error": str(e)}

        with ThreadPoolExecutor(max_workers) as pool:
            return [*pool.map(one, items)]

    def distribute(self, function: Callable, items: list) -> list:
        """``function`` of each item on the executors, in order."""
        return self.spark.sparkContext.parallelize(items).map(function).collect() if items else []

    # -- SQL and views

    def sql(self, text: str, tables: list[str] | None = None) -> DataFrame:
        """Spark SQL; tables of the warehouse that it names are registered (dots become underscores in view names)."""
        names = tables if tables is not None else sorted({m for m in re.findall(r"(?:from|join|,)\s+([A-Za-z_][\w.]*)", text, re.I)})
        for name in names:
            if name in self.frames or self.table_exists(name):
                view = name.replace(".", "_")
                if view not in self.registered and any(x.name == view and x.isTemporary for x in self.spark.catalog.listTables(pattern=view)):
                    raise CatalogError(f"the session has a view {view} of its own")
                self.registered.add(view)
                self.table(name).createOrReplaceTempView(view)
                text = re.sub(rf"(?<![\w.]){re.escape(name)}(?!\w)(?!\.\w+\.)", view, text) if "." in name else text
            elif self.get_view(name):
                self.sql(self.get_view(name)).createOrReplaceTempView(name.replace(".", "_"))
        return self.spark.sql(text)

    def register_udf(self, name: str, function: Any, returns: str, kind: str = "scalar") -> Any:
        """A function for SQL and expressions: ``scalar`` (pandas Series to Series, a batch at a time), ``aggregate`` (Series to a value) or ``table`` (a class with ``eval`` that yields rows)."""
        from pyspark.sql.functions import pandas_udf, udtf

        if kind not in ("scalar", "aggregate", "table"):
            raise ValueError("kind must be scalar, aggregate or table")
        if kind == "table":
            made = udtf(function, returnType=returns)
            self.spark.udtf.register(name, made)
            return made
        import pandas as pd

        def batch(s):
            return function(s)

        batch.__annotations__ = {"s": pd.Series, "return": pd.Series if kind == "scalar" else float}
        made = pandas_udf(batch, returns)
        self.spark.udf.register(name, made)
        return made

    def _views(self) -> dict:
        path = f"{self.warehouse}/_views.json"
        if not os.path.exists(path):
            return {}
        with open(path) as f:
            return json.load(f)

    def create_view(self, name: str, text: str, replace: bool = False) -> None:
        views = self._views()
        if name in views and not replace:
            raise CatalogError(f"view {name} exists")
        self._save_views(views | {name: text})

    def _save_views(self, views: dict) -> None:
        with open(f"{self.warehouse}/_views.json", "w") as f:
            json.dump(views, f)

    def drop_view(self, name: str) -> None:
        views = self._views()
        if name not in views:
            raise CatalogError(f"no view {name}")
        self._save_views({k: v for k, v in views.items() if k != name})

    def list_views(self) -> list[str]:
        return sorted(self._views())

    def get_view(self, name: str) -> str | None:
        return self._views().get(name)

    # -- writing

    def to_frame(self, data: Any, schema: Any = None) -> DataFrame:
        import pandas as pd
        import pyarrow as pa

        if isinstance(data, DataFrame):
            return data
        if isinstance(data, (pd.DataFrame, pa.Table)):
            return self.spark.createDataFrame(data, schema)
        if isinstance(data, dict):
            names = [*data]
            return self.spark.createDataFrame([*zip(*data.values(), strict=True)], schema or names)
        rows = [r.model_dump() if hasattr(r, "model_dump") else r for r in data]
        return self.spark.createDataFrame(rows, schema)

    def _rows(self, name: str, data: Any) -> DataFrame:
        """Data as a frame; plain rows take the table's types for their columns."""
        if isinstance(data, (dict, list)):
            names = [*data] if isinstance(data, dict) else [*dict.fromkeys(k for r in data for k in (r.model_dump() if hasattr(r, "model_dump") else r))]
            shape = self.open(name).schema
            if unknown := set(names) - set(shape.names):
                raise SchemaError(f"columns that {name} doesn't have: {sorted(unknown)}")
            from pyspark.sql import types as T

            rows = [*zip(*data.values(), strict=True)] if isinstance(data, dict) else [tuple((r.model_dump() if hasattr(r, "model_dump") else r).get(n) for n in names) for r in data]
            return self.spark.createDataFrame(rows, T.StructType([T.StructField(n, shape[n].dataType) for n in names]))
        return self.to_frame(data)

    def append(self, name: str, data: Any, branch: str = "main", validators: list | None = None, null_policy: str = "fail") -> int:
        df = self._rows(name, data)
        if validators:
            seen = Validator(self, null_policy).validate(df, validators)
            if not seen["passed"]:
                raise ValidationError(f"nothing is written: {[d for d in seen['details'] if not d['passed']]}")
        made = self.open(name).append(df, branch)
        self.results.invalidate(name)
        return made

    append_to_table = append

    def insert_items(self, name: str, items: list, branch: str = "main") -> None:
        if items:
            self.append(name, items, branch)

    def insert_from_file(self, name: str, path: str, format: str | None = None, branch: str = "main", **options: Any) -> None:  # noqa: A002
        self.append(name, sources.read_file(self.spark, path, format, **options), branch)

    def create_table_from(self, name: str, kind: str, *args: Any, **options: Any) -> Table:
        """Read with the reader ``kind`` (or ``folder``), make a table of its columns and append its rows."""
        reader = sources.read_folder if kind == "folder" else sources.READERS[kind]
        df = reader(self.spark, *args, **options)
        table = self.create_table(name, df.schema)
        table.append(df)
        return table

    def __getattr__(self, name: str) -> Any:
        if name.startswith("create_table_from_"):
            return partial(self._create_from, name[18:])
        if name.startswith("read_") and name[5:] in sources.READERS:
            return partial(sources.READERS[name[5:]], self.spark)
        raise AttributeError(name)

    def _create_from(self, kind: str, name: str, *args: Any, **options: Any) -> Table:
        return self.create_table_from(name, kind, *args, **options)

    def add_files(self, name: str, paths: list[str]) -> int:
        return self.open(name).add_files(paths)

    def overwrite(self, name: str, data: Any, condition: Any = None) -> int:
        made = self.open(name).overwrite(self._rows(name, data), None if condition is None else _column(condition), bounds=_bounds(condition))
        self.results.invalidate(name)
        return made

    overwrite_table = overwrite

    def delete(self, name: str, condition: Any) -> int:
        n = self.open(name).delete(_column(condition), bounds=_bounds(condition))
        self.results.invalidate(name)
        return n

    delete_from_table = delete

    def update(self, name: str, condition: Any, values: dict) -> int:
        n = self.open(name).update(_column(condition), values, bounds=_bounds(condition))
        self.results.invalidate(name)
        return n

    def merge(self, name: str, source: Any, on: str | list[str], when_matched_update: Any = None, when_not_matched_insert: Any = None) -> dict:
        made = self.open(name).merge(self._rows(name, source) if isinstance(source, (dict, list)) else self.to_frame(source), [on] if isinstance(on, str) else on, when_matched_update, when_not_matched_insert)
        self.results.invalidate(name)
        return made

    def upsert(self, name: str, data: Any, join_cols: list[str], when_matched_update_all: bool = True, when_not_matched_insert_all: bool = True) -> dict:
        return self.merge(name, data, join_cols, when_matched_update_all, when_not_matched_insert_all)

    @contextlib.contextmanager
    def transaction(self, name: str) -> Iterator[Transaction]:
        """Steps on a hidden branch; the table's branch moves to their result in one commit, or not at all."""
        store = self.open(name)
        staged = Transaction(store)
        try:
            yield staged
            staged.commit()
        except BaseException:
            staged.abandon()
            raise
        self.results.invalidate(name)

    # -- history

    def read_incremental(self, name: str, since_snapshot_id: int | None = None, since_timestamp: int | None = None, columns: list[str] | None = None) -> DataFrame:
        df = self.open(name).incremental(since_snapshot_id, since_timestamp)
        return df.select(*columns) if columns else df

    def get_changes(self, name: str, from_snapshot: int, to_snapshot: int | None = None, columns: list[str] | None = None, key_cols: list[str] | None = None) -> dict:
        made = self.open(name).changes(from_snapshot, to_snapshot, key_cols)
        return {k: v.select(*columns) if columns else v for k, v in made.items()}

    def create_branch(self, name: str, branch: str, snapshot_id: int | None = None) -> None:
        self.open(name).set_ref(branch, "branch", snapshot_id)

    def tag_snapshot(self, name: str, snapshot_id: int, tag: str, max_ref_age_ms: int | None = None) -> None:
        """``max_ref_age_ms``: how old the snapshot may get before :meth:`Table.expire` drops the tag."""
        self.open(name).set_ref(tag, "tag", snapshot_id, max_ref_age_ms)

    def list_branches(self, name: str) -> list[str]:
        return sorted(self.open(name).refs("branch"))

    def list_tags(self, name: str) -> list[str]:
        return sorted(self.open(name).refs("tag"))

    def stats(self, name: str) -> dict:
        t = self.open(name)
        snap = t.snapshot()
        files = snap.files if snap else []
        return {"schema": t.schema.simpleString(), "snapshots": len(t.snapshots()), "partition_spec": t.meta["spec"], "sort_order": t.meta["sort"], "files": len(files), "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files)}

    def profile_column(self, name: str, column: str) -> DataFrame:
        return profile(self.table(name), column)

    @property
    def quality(self) -> Validator:
        return Validator(self)

    validator = quality

    def validate_data(self, name: str, constraints: Any) -> bool:
        return Validator(self).check_constraints(name, constraints)

    # -- procedures

    def call_procedure(self, name: str, procedure: str, **options: Any) -> Any:
        t = self.open(name)
        known = {"rewrite_data_files": t.compact, "expire_snapshots": t.expire, "remove_orphan_files": t.orphans, "fast_forward": t.fast_forward, "rewrite_manifests": t.rewrite_manifests, "rollback_to_snapshot": lambda snapshot_id: t.rollback(snapshot_id), "rollback_to_timestamp": lambda timestamp_ms: t.rollback(as_of=timestamp_ms), "set_current_snapshot": lambda snapshot_id: t.rollback(snapshot_id, any_snapshot=True), "add_files": t.add_files}
        if procedure not in known:
            raise ValueError(f"unknown procedure {procedure}: one of {sorted(known)}")
        made = known[procedure](**options)
        self.results.invalidate(name)
        return made

    def enable_bloom_filters(self, name: str, columns: list[str], fpp: float = 0.01) -> None:
        t = self.open(name)
        phys = {f["name"]: f["phys"] for f in t.meta["fields"]}
        t.set_properties({f"parquet.bloom.filter.enabled#{phys[c]}": "true" for c in columns} | {f"parquet.bloom.filter.fpp#{phys[c]}": str(fpp) for c in columns})

    # -- exports and services

    def to_parquet(self, name: str, path: str, columns: list[str] | None = None, filter: Any = None) -> None:  # noqa: A002
        sources.to_parquet(self.read_table(name, columns, filter), path)

    def to_csv(self, name: str, path: str, columns: list[str] | None = None, filter: Any = None) -> None:  # noqa: A002
        sources.to_csv(self.read_table(name, columns, filter), path)

    def to_json(self, name: str, path: str, columns: list[str] | None = None, filter: Any = None) -> None:  # noqa: A002
        sources.to_json(self.read_table(name, columns, filter), path, array=True)

    def capped(self, df: DataFrame, rows: int = 1000, size: int = 5 << 20) -> tuple[list[dict], bool]:
        """At most so many rows and bytes of JSON for an interactive client, and whether some are missing."""
        got = [r.asDict(True) for r in df.limit(rows + 1).collect()]
        cut = len(got) > rows
        got = got[:rows]
        while len(got) > 1 and len(json.dumps(got, default=str)) > size:
            got, cut = got[: len(got) // 2], True
        return got, cut

    def histogram(self, name: str, column: str, bins: int = 20) -> DataFrame:
        """Counts of equal bins between the least and greatest value, made where the data are."""
        df = self.table(name).where(named(column).isNotNull())
        low, high = df.agg(F.min(column), F.max(column)).first()
        width = (high - low) / bins if high is not None and high > low else 1
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")

    def timed(self, label: str, df: DataFrame) -> int:
        query = self.metrics.start(label)
        try:
            n = df.count()
        except Exception as e:
            self.metrics.end(query, error=str(e))
            raise
        self.metrics.end(query, n)
        return n

    @property
    def maintenance(self) -> Maintenance:
        return Maintenance(self)

    @property
    def viz(self) -> Charts:
        return Charts(self)

    @property
    def tools(self) -> Tools:
        return Tools(self)

    def expire_snapshots(self, name: str, older_than_days: float = 7, retain_last: int = 1) -> list[int]:
        return self.maintenance.expire_snapshots(name, older_than_days, retain_last)

    def remove_orphan_files(self, name: str, older_than_days: float = 3, dry_run: bool = True) -> list[str]:
        return self.maintenance.remove_orphan_files(name, older_than_days, dry_run)

    def compact_data_files(self, name: str, **options: Any) -> dict:
        return self.maintenance.compact_data_files(name, **options)

    def z_order_optimize(self, name: str, columns: list[str], **options: Any) -> dict:
        return self.maintenance.z_order_optimize(name, columns, **options)

    def rewrite_manifests(self, name: str) -> dict:
        return self.maintenance.rewrite_manifests(name)


class Transaction:
    def __init__(self, store: Table):
        self.store, self.branch = store, f"_txn{time.time_ns()}"
        self.base = store.snapshot()
        store.change(lambda m: m["refs"].__setitem__(self.branch, {"id": self.base.id if self.base else None, "type": "txn"}))

    def append(self, df: DataFrame) -> None:
        self.store.append(df, self.branch)

    def delete(self, condition: Any) -> None:
        self.store.delete(column_of(condition), self.branch)

    def overwrite(self, df: DataFrame, condition: Any = None) -> None:
        self.store.overwrite(df, None if condition is None else column_of(condition), self.branch)

    def update(self, condition: Any, values: dict) -> None:
        self.store.update(column_of(condition), values, self.branch)

    def set_properties(self, values: dict) -> None:
        self.properties = values

    properties: dict = {}

    def commit(self) -> None:
        def edit(meta):
            now = meta["refs"]["main"]["id"]
            if now != (self.base.id if self.base else None):
                raise ValidationError("the table changed meanwhile")
            last = meta["refs"].pop(self.branch)["id"]
            if last == now:
                meta["properties"].update(self.properties)
                return
            line, by = [], {s["id"]: s for s in meta["snapshots"]}
            while last is not None and last != now:
                line.append(last)
                last = by[last]["parent"]
            final, steps, root = by[line[0]], set(line), self.store.root
            final["parent"] = now
            final["manifest"] = write_manifest(root, [f | {"snapshot": final["id"] if f["snapshot"] in steps else f["snapshot"]} for f in read_manifest(root, final["manifest"])])
            final["operation"] = "append" if all(by[i]["operation"] == "append" for i in line) else "overwrite"
            meta["snapshots"] = [s for s in meta["snapshots"] if s["id"] not in set(line[1:])]
            meta["refs"]["main"]["id"] = final["id"]
            meta["properties"].update(self.properties)

        self.store.change(edit)

    def abandon(self) -> None:
        def edit(meta):
            last = meta["refs"].pop(self.branch, {"id": None})["id"]
            base, by, gone = self.base.id if self.base else None, {s["id"]: s for s in meta["snapshots"]}, set()
            while last is not None and last != base:
                gone.add(last)
                last = by[last]["parent"]
            meta["snapshots"] = [s for s in meta["snapshots"] if s["id"] not in gone]

        self.store.reload().change(edit)


class Federation:
    """Several lakes by name."""

    def __init__(self):
        self.lakes: dict[str, Lake] = {}

    def add_catalog(self, name: str, lake: Lake) -> None:
        self.lakes[name] = lake

    def list_catalogs(self) -> list[str]:
        return sorted(self.lakes)

    def get_catalog(self, name: str) -> Lake:
        if name not in self.lakes:
            raise ValueError(f"no catalog {name}")
        return self.lakes[name]

    def read_table(self, catalog: str, table: str, **options: Any) -> DataFrame:
        return self.get_catalog(catalog).read_table(table, **options)

    def union_tables(self, tables: list[tuple[str, str]]) -> DataFrame | None:
        frames = [self.read_table(c, t) for c, t in tables]
        if any(f.schema.simpleString() != frames[0].schema.simpleString() for f in frames):
            raise SchemaError("the tables' columns differ")
        return reduce(lambda a, b: a.unionAll(b), frames) if frames else None


class AsyncLake:
    """The lake's calls from a coroutine, on a bounded pool."""

    def __init__(self, lake: Lake, workers: int = 8):
        self.lake, self.pool = lake, ThreadPoolExecutor(workers)

    async def call(self, method: str, *args: Any, **options: Any) -> Any:
        return await asyncio.get_running_loop().run_in_executor(self.pool, partial(getattr(self.lake, method), *args, **options))

    async def read(self, name: str, **options: Any) -> list:
        return await self.run(self.lake.read_table(name, **options))

    async def append(self, name: str, data: Any) -> int:
        return await self.call("append", name, data)

    async def stats(self, name: str) -> dict:
        return await self.call("stats", name)

    async def run(self, query: DataFrame | Query) -> list:
        df = query if isinstance(query, DataFrame) else query.dataframe()
        return await asyncio.get_running_loop().run_in_executor(self.pool, df.collect)

    async def __aenter__(self) -> AsyncLake:
        return self

    async def __aexit__(self, *_: Any) -> None:
        self.pool.shutdown()


class MergeOnRead:
    """Row-level delete files aren't written here; deletes rewrite the files that hold the rows."""

    def __init__(self, lake: Lake, name: str):
        self.lake, self.name = lake, name

    def write_position_deletes(self, *_: Any) -> None:
        raise Unsupported("position deletes: use delete_where")

    def write_equality_deletes(self, *_: Any) -> None:
        raise Unsupported("equality deletes: use delete_where")

    def delete_where(self, condition: Any) -> int:
        return self.lake.delete(self.name, condition)


