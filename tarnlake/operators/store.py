"""Versioned tables over plain Parquet: a log of metadata versions, snapshots with file manifests, branches and tags.

``<root>/<namespace>/<table>/metadata/v000001.json`` is a version: schema (fields by id), partition spec, sort order,
properties, heads of snapshots, refs. A commit writes the next version aside and gives it its name only if no one has, so
a version is there whole or not at all, and of two writers one wins; the other starts again from the new version
(appends) or reports a conflict. The files of a snapshot, with their statistics, are in a Parquet manifest of its own.
Data files never change.
"""

from __future__ import annotations

import json
import math
import os
import re
import shutil
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from functools import lru_cache, reduce
from threading import Lock
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.errors import CommitConflict, MaintenanceError, SchemaError, TableNotFound, Unsupported, ValidationError

TRANSFORMS = ("identity", "bucket", "truncate", "year", "month", "day", "hour", "void")
SORTED = 512 << 20  # bytes of rows that a task of a compaction sorts, about
WIDER = {("int", "bigint"), ("float", "double")}


@dataclass
class Snapshot:
    id: int
    parent: int | None
    ts: int
    operation: str
    manifest: str
    summary: dict = field(default_factory=dict)
    root: str = ""

    @property
    def files(self) -> list[dict]:
        return read_manifest(self.root, self.manifest)

    @property
    def added(self) -> list[dict]:
        """The files that this snapshot brought in."""
        return [f for f in self.files if f["snapshot"] == self.id]


MANIFEST = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("part", pa.string()), ("snapshot", pa.int64()), ("stats", pa.string()), ("names", pa.string())])


def write_manifest(root: str, files: list[dict]) -> str:
    """Name of a new manifest. Of a file: path, rows, bytes, part (its partition), snapshot (that added it), stats, names (of its columns, where they aren't the table's)."""
    name = f"manifest-{uuid.uuid4().hex}.parquet"
    rows = [f | {"stats": json.dumps(f["stats"]), "names": json.dumps(f["names"]) if f.get("names") else None} for f in files]
    pq.write_table(pa.Table.from_pylist(rows, MANIFEST), f"{root}/metadata/{name}", compression="zstd")
    return name


@lru_cache(64)
def read_manifest(root: str, name: str) -> list[dict]:
    rows = pq.read_table(f"{root}/metadata/{name}").to_pylist()
    return [r | {"stats": json.loads(r["stats"]), "names": json.loads(r["names"]) if r["names"] else None} for r in rows]


def partition_column(df: DataFrame, spec: dict) -> Column:
    """Value of a partition field."""
    c, kind, arg = F.col(spec["column"]), spec["transform"], spec.get("arg")
    if kind == "bucket":
        return F.pmod(F.xxhash64(c), F.lit(arg or 16))
    if kind == "truncate":
        numeric = isinstance(df.schema[spec["column"]].dataType, T.NumericType)
        return c - F.pmod(c, F.lit(arg or 16)) if numeric else F.substring(c, 1, arg or 16)
    if kind in ("year", "month", "day", "hour"):
        return F.date_trunc(kind, c).cast("string")
    return F.lit(None).cast("string") if kind == "void" else c


def parse_spec(items: Any) -> list[dict]:
    out = []
    for item in items or []:
        name, kind = (item, "identity") if isinstance(item, str) else (item[0], item[1] if len(item) > 1 else "identity")
        arg = item[2] if not isinstance(item, str) and len(item) > 2 else None
        if "[" in kind:
            kind, arg = kind.rstrip("]").split("[")
            arg = int(arg)
        if kind not in TRANSFORMS:
            raise ValueError(f"unknown transform {kind}: one of {TRANSFORMS}")
        out.append({"column": name, "transform": kind, "arg": arg, "name": f"{name}_{kind}"})
    return out


def comparable(value: Any) -> tuple[str, Any] | None:
    """Kind and place of a literal or statistic: values of one kind compare as their columns do. Times are microseconds."""
    if isinstance(value, bool) or value is None or value != value:
        return None
    if isinstance(value, (int, float)):
        return "number", value
    if isinstance(value, Decimal):
        return "number", float(value)
    if isinstance(value, str):
        return "text", value
    if isinstance(value, datetime):
        aware = value.tzinfo is not None
        return "instant" if aware else "time", (value - datetime(1970, 1, 1, tzinfo=timezone.utc if aware else None)) // timedelta(microseconds=1)
    if isinstance(value, date):
        return "time", (value - date(1970, 1, 1)).days * 86_400_000_000
    return None


def may_match(stats: dict, bounds: tuple) -> bool:
    """Whether a file with these (kind, min, max) of its columns can hold a row within all bounds."""
    for name, op, value in bounds:
        kind, low, high = stats.get(name) or (None, None, None)
        place = comparable(value)
        if place is None or kind != place[0]:
            continue
        value = place[1]
        if (op in ("=", "<=") and low > value) or (op == "<" and low >= value) or (op in ("=", ">=") and high < value) or (op == ">" and high <= value):
            return False
    return True


def _file_facts(path: str) -> dict:
    meta = pq.ParquetFile(path).metadata
    stats: dict[str, list | None] = {}
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            s, name = column.statistics, column.path_in_schema
            try:
                low, high = (comparable(s.min), comparable(s.max)) if s is not None and s.has_min_max else (None, None)
            except pa.ArrowNotImplementedError:  # old timestamps of 96 bits, whose statistics have no order
                stats[name] = None
                continue
            if low is None or high is None:
                if s is None or s.null_count != column.num_values:  # a group of nulls matches no bound
                    stats[name] = None
                continue
            if isinstance(s.min, Decimal):
                low, high = (low[0], math.nextafter(low[1], -math.inf)), (high[0], math.nextafter(high[1], math.inf))
            old = stats.setdefault(name, [low[0], low[1], high[1]])
            if old is not None:
                stats[name] = [low[0], min(old[1], low[1]), max(old[2], high[1])]
    return {"path": path, "rows": meta.num_rows, "bytes": os.path.getsize(path), "part": "", "snapshot": None, "stats": {k: v for k, v in stats.items() if v}, "names": None}


OPEN_FILES, _OPEN = "spark.sql.maxConcurrentOutputFileWriters", {}
_LOCK = Lock()


@contextmanager
def several_files(spark: SparkSession, most: int = 16):
    """Writes by partition meanwhile: a task keeps up to ``most`` files open, and sorts only the rows of further partitions."""
    key = spark._jsparkSession.hashCode()
    with _LOCK:
        old, n = _OPEN.get(key) or (spark.conf.get(OPEN_FILES), 0)
        _OPEN[key] = old, n + 1
        spark.conf.set(OPEN_FILES, str(max(most, int(old))))
    try:
        yield
    finally:
        with _LOCK:
            _OPEN[key] = old, _OPEN[key][1] - 1
            if not _OPEN[key][1]:
                spark.conf.set(OPEN_FILES, _OPEN.pop(key)[0])


class Table:
    """One table at its latest version; every change is a commit."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name
        self.reload()

    # -- versions

    @staticmethod
    def exists(root: str) -> bool:
        return os.path.isdir(f"{root}/metadata") and any(f.startswith("v") for f in os.listdir(f"{root}/metadata"))

    @staticmethod
    def create(spark: SparkSession, root: str, name: str, schema: T.StructType, spec: list[dict], sort: list, properties: dict) -> Table:
        os.makedirs(f"{root}/metadata", exist_ok=True)
        fields = [{"id": i + 1, "name": f.name, "phys": f"f{i + 1}", "type": f.dataType.jsonValue(), "required": not f.nullable, "meta": f.metadata} for i, f in enumerate(schema.fields)]
        for s in spec:
            if s["column"] not in schema.names:
                raise SchemaError(f"no column {s['column']}")
        meta = {"fields": fields, "last_id": len(fields), "spec": spec, "sort": sort, "properties": properties, "snapshots": [], "refs": {"main": {"id": None, "type": "branch"}}, "log": []}
        Table._write(root, 1, meta)
        return Table(spark, root, name)

    @staticmethod
    def _write(root: str, version: int, meta: dict) -> None:
        aside, name = f"{root}/metadata/.{uuid.uuid4().hex}", f"{root}/metadata/v{version:06d}.json"
        with open(aside, "w") as f:
            json.dump(meta, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(aside, name)
        except FileExistsError:
            raise CommitConflict(f"version {version} was committed by another writer") from None
        finally:
            os.unlink(aside)

    def reload(self) -> Table:
        if not Table.exists(self.root):
            raise TableNotFound(self.name)
        self.version = max(int(f[1:-5]) for f in os.listdir(f"{self.root}/metadata") if f.startswith("v") and f.endswith(".json"))
        with open(f"{self.root}/metadata/v{self.version:06d}.json") as f:
            self.meta = json.load(f)
        return self

    def change(self, edit, retries: int = 5) -> Any:
        """Apply ``edit(meta)`` and commit; started again on a conflict."""
        for attempt in range(retries + 1):
            meta = json.loads(json.dumps(self.meta))
            result = edit(meta)
            meta["log"].append({"ts": int(time.time() * 1000), "version": self.version + 1})
            try:
                Table._write(self.root, self.version + 1, meta)
            except CommitConflict:
                if attempt == retries:
                    raise
                self.reload()
                continue
            self.reload()
            return result
        return None

    # -- schema

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f["name"], _type(f["type"]), not f["required"], f["meta"]) for f in self.meta["fields"]])

    def _field(self, meta: dict, name: str) -> dict:
        for f in meta["fields"]:
            if f["name"] == name:
                return f
        raise SchemaError(f"no column {name}")

    def add_column(self, name: str, kind: Any, doc: str | None = None) -> None:
        from tarnlake.types import parse_type

        data_type, extra = parse_type(kind)

        def edit(meta):
            if any(f["name"] == name for f in meta["fields"]):
                raise SchemaError(f"column {name} exists")
            meta["last_id"] += 1
            meta["fields"].append({"id": meta["last_id"], "name": name, "phys": f"f{meta['last_id']}", "type": data_type.jsonValue(), "required": False, "meta": extra | ({"comment": doc} if doc else {})})

        self.change(edit)

    def drop_column(self, name: str) -> None:
        def edit(meta):
            if any(s["column"] == name for s in meta["spec"]):
                raise SchemaError(f"{name} is a partition column")
            meta["fields"].remove(self._field(meta, name))

        self.change(edit)

    def rename_column(self, old: str, new: str) -> None:
        def edit(meta):
            self._field(meta, old)["name"] = new
            for s in meta["spec"]:
                s["column"] = new if s["column"] == old else s["column"]

        self.change(edit)

    def update_column_type(self, name: str, kind: Any) -> None:
        from tarnlake.types import parse_type

        new = parse_type(kind)[0]

        def edit(meta):
            f = self._field(meta, name)
            old = _type(f["type"])
            wider = (old.simpleString(), new.simpleString()) in WIDER or (isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and new.scale == old.scale and new.precision >= old.precision)
            if not wider:
                raise SchemaError(f"{old.simpleString()} can't become {new.simpleString()}")
            f["type"] = new.jsonValue()

        self.change(edit)

    def sync_schema(self, schema: T.StructType, allow_drops: bool = False) -> dict:
        """Bring the columns to those of ``schema``; says what was added, dropped, widened and skipped."""
        done: dict[str, list] = {"added": [], "dropped": [], "widened": [], "skipped": []}
        have = {f.name: f.dataType for f in self.schema}
        for f in schema:
            if f.name not in have:
                self.add_column(f.name, f.dataType)
                done["added"].append(f.name)
            elif have[f.name] != f.dataType:
                try:
                    self.update_column_type(f.name, f.dataType)
                    done["widened"].append(f.name)
                except SchemaError:
                    done["skipped"].append(f.name)
        for name in have.keys() - set(schema.names) if allow_drops else ():
            self.drop_column(name)
            done["dropped"].append(name)
        return done

    def add_partition(self, column: str, transform: str = "identity", arg: int | None = None) -> None:
        if transform in ("bucket", "truncate") and not arg:
            raise ValueError(f"{transform} needs a number")
        self._field(self.meta, column)
        self.change(lambda m: m["spec"].extend(parse_spec([(column, transform, arg)])))

    def remove_partition(self, name: str) -> None:
        def edit(meta):
            left = [s for s in meta["spec"] if name not in (s["name"], s["column"])]
            if len(left) == len(meta["spec"]):
                raise ValueError(f"no partition field {name}")
            meta["spec"] = left

        self.change(edit)

    # -- snapshots

    def snapshots(self) -> list[Snapshot]:
        return [Snapshot(**s, root=self.root) for s in self.meta["snapshots"]]

    def snapshot(self, snapshot_id: int | None = None, as_of: int | None = None, branch: str = "main") -> Snapshot | None:
        if snapshot_id is not None and as_of is not None:
            raise ValidationError("either a snapshot or a time")
        if as_of is not None:  # the past of the branch: what others wrote, or a transaction hasn't committed, is none of it
            if branch not in self.meta["refs"]:
                raise ValidationError(f"no branch or tag {branch}")
            line = {*self.ancestors(self.meta["refs"][branch]["id"])}
            earlier = [s for s in self.snapshots() if s.id in line and s.ts <= as_of]
            if not earlier:
                raise ValidationError("no snapshot that old")
            return max(earlier, key=lambda s: (s.ts, s.id))
        if snapshot_id is None:
            if branch not in self.meta["refs"]:
                raise ValidationError(f"no branch or tag {branch}")
            snapshot_id = self.meta["refs"][branch]["id"]
        if snapshot_id is None:
            return None
        for s in self.snapshots():
            if s.id == snapshot_id:
                return s
        raise ValidationError(f"no snapshot {snapshot_id}")

    def ancestors(self, snapshot_id: int | None) -> list[int]:
        by, out = {s.id: s for s in self.snapshots()}, []
        while snapshot_id is not None and snapshot_id in by:
            out.append(snapshot_id)
            snapshot_id = by[snapshot_id].parent
        return out

    def _commit(self, operation: str, make_files, branch: str = "main", summary: dict | None = None, base: int | None = -1) -> int:
        """New snapshot on a branch: ``make_files(current files)`` gives its files. ``base``: the snapshot it must follow."""

        def edit(meta):
            if branch not in meta["refs"]:
                raise ValidationError(f"no branch {branch}")
            parent = meta["refs"][branch]["id"]
            if base != -1 and parent != base:
                raise CommitConflict(f"{self.name} changed meanwhile")
            now = next((read_manifest(self.root, s["manifest"]) for s in meta["snapshots"] if s["id"] == parent), [])
            made = uuid.uuid4().int >> 65
            files = [f if f["snapshot"] else f | {"snapshot": made} for f in make_files(now)]
            last = max((s["ts"] for s in meta["snapshots"]), default=0)
            meta["snapshots"].append({"id": made, "parent": parent, "ts": max(int(time.time() * 1000), last + 1), "operation": operation, "manifest": write_manifest(self.root, files), "summary": summary or {}})
            meta["refs"][branch]["id"] = made
            return made

        return self.change(edit)

    # -- reading and writing

    def read(self, snapshot_id: int | None = None, as_of: int | None = None, branch: str = "main", bounds: tuple = ()) -> DataFrame:
        snap = self.snapshot(snapshot_id, as_of, branch)
        return self.read_files(snap.files if snap else [], bounds)

    def matching(self, files: list[dict], bounds: tuple = ()) -> list[dict]:
        """The files that can hold rows within the bounds on the table's columns."""
        phys = {f["name"]: f["phys"] for f in self.meta["fields"]}
        bounds = tuple((phys[c], op, v) for c, op, v in bounds if c in phys)
        return [f for f in files if may_match(f["stats"], bounds)] if bounds else files

    def read_files(self, files: list[dict], bounds: tuple = (), path_column: bool = False) -> DataFrame:
        groups: dict[str, list[dict]] = {}
        for x in self.matching(files, bounds):
            groups.setdefault(json.dumps(x["names"], sort_keys=True), []).append(x)
        frames = [self._read_group(g, g[0]["names"], path_column) for g in groups.values()] or [self._read_group([], None, path_column)]
        return reduce(lambda a, b: a.unionAll(b), frames)

    def _read_group(self, files: list[dict], names: dict | None, path_column: bool) -> DataFrame:
        """Files whose columns have the same names: the table's own, or those of files that were taken in."""
        stored = [(f, names.get(f["phys"]) if names else f["phys"]) for f in self.meta["fields"]]
        shape = T.StructType([T.StructField(n, _type(f["type"])) for f, n in stored if n])
        df = self.spark.read.schema(shape).parquet(*[x["path"] for x in files]) if files else self.spark.createDataFrame([], shape)
        columns = [(F.col(f"`{n}`") if n else F.lit(None).cast(_type(f["type"]))).alias(f["name"], metadata=f["meta"]) for f, n in stored]
        if path_column:
            columns.append((F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/") if files else F.lit(None).cast("string")).alias("_path"))
        return df.select(*columns)

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with the table's columns and types; missing optional columns are null, unknown ones an error."""
        unknown = set(df.columns) - {f["name"] for f in self.meta["fields"]}
        if unknown:
            raise SchemaError(f"columns that {self.name} doesn't have: {sorted(unknown)}")
        columns = []
        for f in self.meta["fields"]:
            if f["name"] not in df.columns and f["required"]:
                raise SchemaError(f"required column {f['name']} is missing")
            value = (F.col(f"`{f['name']}`") if f["name"] in df.columns else F.lit(None)).cast(_type(f["type"]))
            columns.append((F.when(value.isNull(), F.raise_error(F.lit(f"null in required column {f['name']}")).cast(_type(f["type"]))).otherwise(value) if f["required"] else value).alias(f["name"]))
        return df.select(*columns)

    def write_files(self, df: DataFrame, parts: int | None = None, order: list | None = None, compression: str | None = None) -> list[dict]:
        """Data files with the rows of ``df``: each of one partition of the spec, in the sort order (or in ``order``).

        ``parts``: the number of about equal ranges to write; without it rows go together by partition, and large ones are
        split by size while the query runs.
        """
        df = self.conform(df)
        keys = [partition_column(df, s) for s in self.meta["spec"] if s["transform"] != "void"]
        sort = order if order is not None else [F.col(s[0]).desc() if len(s) > 1 and s[1] == "desc" else F.col(s[0]) for s in self.meta["sort"]]
        names = [f"p{i}_" for i in range(len(keys))]
        df = df.withColumns(dict(zip(names, keys, strict=True)))
        if parts and (names or sort):
            ties = [F.col(f"`{f.name}`") for f in df.schema if f.name not in names and not re.search("map<|variant", f.dataType.simpleString())]
            df = df.repartitionByRange(parts, *names, *sort, *([F.xxhash64(*ties)] if ties else []))  # rows alike in the keys need not go together
        elif parts:
            df = df.repartition(parts)
        elif names:
            df = df.hint("rebalance", *[F.col(n) for n in names])
        if sort:
            df = df.sortWithinPartitions(*names, *sort)
        phys = df.select(*[F.col(f"`{f['name']}`").alias(f["phys"]) for f in self.meta["fields"]], *names)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = phys.write
        for k, v in self.meta["properties"].items():
            if k.startswith("parquet."):
                writer = writer.option(k, v)
        if names:
            writer = writer.partitionBy(*names)
        with several_files(df.sparkSession) if names and not sort else nullcontext():
            writer.option("compression", compression or self.meta["properties"].get("write.compression", "snappy")).parquet(path)
        found = sorted(f"{folder}/{f}" for folder, _, files in os.walk(path) for f in files if f.endswith(".parquet"))
        with ThreadPoolExecutor(8) as pool:
            made = [f for f in pool.map(_file_facts, found) if f["rows"]]
        return [f | {"part": os.path.dirname(f["path"])[len(path) :]} for f in made]

    def append(self, df: DataFrame, branch: str = "main", summary: dict | None = None) -> int:
        new = self.write_files(df)
        return self._commit("append", lambda now: now + new, branch, summary)

    def add_files(self, paths: list[str]) -> int:
        """Take Parquet files (or folders of them) into the table where they lie: nothing is read but their footers.

        Their columns are matched by name; missing ones are null. Columns that the table doesn't have, or has with another
        type, are an error.
        """
        found = []
        for p in paths:
            p = os.path.abspath(p.removeprefix("file://"))
            found += sorted(f"{folder}/{f}" for folder, _, files in os.walk(p) for f in files if f.endswith(".parquet") and f[0] not in "._") if os.path.isdir(p) else [p]
        have = {f["name"]: (f["phys"], _type(f["type"]), f["required"]) for f in self.meta["fields"]}
        known = {x["path"] for s in self.snapshots() for x in s.files}
        if again := [p for p in found if p in known]:
            raise ValidationError(f"already in the table: {again[:3]}")
        new, shapes = [], {}
        for p in found:
            arrow = pq.read_schema(p)
            key = arrow.remove_metadata().to_string()
            if key not in shapes:
                shapes[key] = {f.name: f.dataType for f in self.spark.read.parquet(p).schema}
            for name, kind in shapes[key].items():
                if name not in have or have[name][1] != kind:
                    raise SchemaError(f"{p}: column {name} {kind.simpleString()} isn't one of {self.name}")
            if missing := [n for n, (_, _, required) in have.items() if required and n not in shapes[key]]:
                raise SchemaError(f"{p}: required columns are missing: {missing}")
            facts, names = _file_facts(p), {have[n][0]: n for n in shapes[key]}
            new.append(facts | {"names": names, "stats": {have[n][0]: v for n, v in facts["stats"].items() if n in have}})
        return self._commit("append", lambda now: now + [f for f in new if f["rows"]])

    def _touched(self, condition: Column, branch: str = "main", bounds: tuple = ()) -> tuple[Snapshot | None, list[dict], list[dict], int]:
        """The branch's snapshot, its files that hold rows under ``condition``, the others, and how many rows those are."""
        snap = self.snapshot(branch=branch)
        if snap is None:
            return None, [], [], 0
        files = self.matching(snap.files, bounds)
        met = dict(self.read_files(files, path_column=True).where(condition).groupBy("_path").agg(F.count("*")).collect()) if files else {}
        return snap, [f for f in snap.files if f["path"] in met], [f for f in snap.files if f["path"] not in met], sum(met.values())

    def rewrite(self, operation: str, condition: Column, change, branch: str = "main", bounds: tuple = ()) -> int:
        """Copy-on-write: files with rows under ``condition`` are replaced by ``change(their rows)``; gives how many rows met it.

        ``bounds`` hold wherever the condition does: files outside them aren't looked at.
        """
        snap, hit, rest, n = self._touched(condition, branch, bounds)
        if not hit:
            return 0
        new = self.write_files(change(self.read_files(hit)))
        self._commit(operation, lambda now: rest + new, branch, base=snap.id)
        return n

    def delete(self, condition: Column, branch: str = "main", bounds: tuple = ()) -> int:
        return self.rewrite("delete", condition, lambda df: df.where(~F.coalesce(condition, F.lit(False))), branch, bounds)

    def update(self, condition: Column, values: dict[str, Any], branch: str = "main", bounds: tuple = ()) -> int:
        from tarnlake.functions import column_of

        for c in values:
            self._field(self.meta, c)
        return self.rewrite("overwrite", condition, lambda df: df.select(*[F.when(condition, column_of(values[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns]), branch, bounds)

    def overwrite(self, df: DataFrame, condition: Column | None = None, branch: str = "main", bounds: tuple = ()) -> int:
        if condition is None:
            new = self.write_files(df)
            return self._commit("overwrite", lambda now: new, branch)
        snap, hit, rest, _ = self._touched(condition, branch, bounds)
        new = self.write_files(df)
        kept = self.write_files(self.read_files(hit).where(~F.coalesce(condition, F.lit(False)))) if hit else []
        return self._commit("overwrite", lambda now: rest + kept + new, branch, base=snap.id if snap else None)

    def merge(self, source: DataFrame, on: list[str], matched: Any, unmatched: Any, branch: str = "main") -> dict:
        """Update matched rows and insert the others, in one commit.

        ``matched``: True for all source columns, or {column: value}, where a string naming a source column means its
        value; falsy: matched rows stay. ``unmatched``: True, or {column: value or source column} with null for the rest.
        The source is written aside first, so all steps see the same rows.
        """
        aside = f"{self.root}/merge-{uuid.uuid4().hex}"
        source.write.parquet(aside)
        try:
            return self._merge(self.spark.read.schema(source.schema).parquet(aside), on, matched, unmatched, branch)
        finally:
            shutil.rmtree(aside, ignore_errors=True)

    def _merge(self, source: DataFrame, on: list[str], matched: Any, unmatched: Any, branch: str) -> dict:
        if source.groupBy(*on).agg(F.count("*").alias("n_")).where("n_ > 1").limit(1).count():
            raise ValidationError("the source has several rows for a key")
        src = source.select(*[F.col(f"`{c}`").alias(f"s_{c}") for c in source.columns], F.lit(True).alias("s__"))
        names = self.schema.names

        def value(v: Any) -> Column:
            from tarnlake.functions import column_of

            return F.col(f"s_{v}") if isinstance(v, str) and v in source.columns else column_of(v)

        snap = self.snapshot(branch=branch)
        low, high = (source.agg(*[g(F.col(f"`{k}`")) for k in on]).first() for g in (F.min, F.max))
        bounds = tuple((k, op, v) for marks, op in ((low, ">="), (high, "<=")) for k, v in zip(on, marks, strict=True) if v is not None)
        target = self.read_files(snap.files if snap else [], bounds, path_column=True)  # files beyond the source's keys can't match
        same = None
        for k in on:
            c = target[k] == src[f"s_{k}"]
            same = c if same is None else same & c
        met = target.join(src, same, "inner")
        counts = met.groupBy("_path").agg(F.count("*").alias("n")).collect() if snap else []
        updated = sum(r["n"] for r in counts)
        files, rest, new = {r["_path"] for r in counts} if matched else set(), snap.files if snap else [], []
        if matched and updated:
            hit = [f for f in snap.files if f["path"] in files]
            rest = [f for f in snap.files if f["path"] not in files]
            rows = self.read_files(hit)
            pairs = {c: c for c in source.columns if c in names and c not in on} if matched is True else matched
            joined = rows.join(src, _all(rows[k] == src[f"s_{k}"] for k in on), "left")
            new += self.write_files(joined.select(*[F.when(F.col("s__"), value(pairs[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in pairs else F.col(f"`{c}`") for c in names]))
        inserted = 0
        if unmatched:
            fresh = src.join(target.select(*on), _all(src[f"s_{k}"] == target[k] for k in on), "left_anti")
            pairs = {c: c for c in source.columns if c in names} if unmatched is True else unmatched
            made = self.write_files(fresh.select(*[value(v).alias(c) for c, v in pairs.items()]))
            inserted = sum(f["rows"] for f in made)
            new += made
        if new:
            self._commit("overwrite", lambda now: rest + new, branch, base=snap.id if snap else None)
        return {"rows_updated": updated if matched else 0, "rows_inserted": inserted}

    # -- changes between snapshots

    def incremental(self, since_id: int | None = None, since_ts: int | None = None, branch: str = "main") -> DataFrame:
        """Rows that appends have added after a snapshot, which must be an ancestor."""
        if since_id is None and since_ts is None:
            raise ValidationError("a snapshot or a time is needed")
        start = self.snapshot(since_id, since_ts)
        line = self.ancestors(self.meta["refs"][branch]["id"])
        if start.id not in line:
            raise ValidationError("not an ancestor of the branch")
        after = set(line[: line.index(start.id)])
        return self.read_files([f for s in self.snapshots() if s.id in after and s.operation == "append" for f in s.added])

    def changes(self, old: int, new: int | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
        """Multisets of rows ``added`` and ``deleted``; with ``keys``, rows alike in them are ``modified`` instead."""
        a, b = self.read(old), self.read(new)
        added, deleted = b.exceptAll(a), a.exceptAll(b)
        if not keys:
            return {"added": added, "deleted": deleted, "modified": added.limit(0)}
        both = added.join(deleted.select(*keys).distinct(), keys, "left_semi")
        return {"added": added.join(deleted.select(*keys).distinct(), keys, "left_anti"), "deleted": deleted.join(added.select(*keys).distinct(), keys, "left_anti"), "modified": both}

    # -- refs

    def set_ref(self, name: str, kind: str, snapshot_id: int | None = None, max_age_ms: int | None = None) -> None:
        snap = self.snapshot(snapshot_id)
        if snap is None:
            raise ValidationError("the table has no snapshot")
        self.change(lambda m: m["refs"].__setitem__(name, {"id": snap.id, "type": kind} | ({"max_age_ms": max_age_ms} if max_age_ms else {})))

    def drop_ref(self, name: str) -> None:
        if name == "main" or name not in self.meta["refs"]:
            raise ValidationError(f"can't remove {name}")
        self.change(lambda m: m["refs"].pop(name))

    def refs(self, kind: str | None = None) -> dict[str, int]:
        return {n: r["id"] for n, r in self.meta["refs"].items() if kind in (None, r["type"])}

    def fast_forward(self, branch: str, to: str) -> None:
        target = self.refs()[to]
        if self.refs()[branch] is not None and self.refs()[branch] not in self.ancestors(target):
            raise ValidationError(f"{branch} isn't an ancestor of {to}")
        self.change(lambda m: m["refs"][branch].__setitem__("id", target))

    def rollback(self, snapshot_id: int | None = None, as_of: int | None = None, any_snapshot: bool = False) -> int:
        snap = self.snapshot(snapshot_id, as_of)
        if not any_snapshot and snap.id not in self.ancestors(self.refs()["main"]):
            raise ValidationError("not an ancestor of the current snapshot")
        self.change(lambda m: m["refs"]["main"].__setitem__("id", snap.id))
        return snap.id

    # -- metadata tables

    META = ("snapshots", "history", "refs", "files", "data_files", "delete_files", "entries", "manifests", "partitions", "metadata_log_entries")

    def inspect(self, what: str, snapshot_id: int | None = None) -> DataFrame:
        make = self.spark.createDataFrame
        snap = self.snapshot(snapshot_id)
        files = snap.files if snap else []
        if what == "snapshots":
            return make([(s.id, s.parent, s.ts, s.operation, json.dumps(s.summary)) for s in self.snapshots()], "snapshot_id long, parent_id long, ts_ms long, operation string, summary string")
        if what == "history":
            line = set(self.ancestors(self.refs()["main"]))
            return make([(s.ts, s.id, s.parent, s.id in line) for s in self.snapshots()], "ts_ms long, snapshot_id long, parent_id long, is_current_ancestor boolean")
        if what == "refs":
            return make([(n, r["type"], r["id"]) for n, r in self.meta["refs"].items()], "name string, type string, snapshot_id long")
        if what in ("files", "data_files"):
            return make([(f["path"], f["rows"], f["bytes"]) for f in files], "file_path string, record_count long, file_size_in_bytes long")
        if what == "delete_files":
            return make([], "file_path string, record_count long, file_size_in_bytes long")
        if what == "entries":
            return make([(s.id, f["path"]) for s in self.snapshots() for f in s.added], "snapshot_id long, file_path string")
        if what == "manifests":
            return make([(s.id, f"{self.root}/metadata/{s.manifest}", len(s.files), len(s.added)) for s in self.snapshots()], "snapshot_id long, manifest string, files long, added_files long")
        if what == "partitions":
            keys = [partition_column(self.read(snapshot_id), s).alias(s["name"]) for s in self.meta["spec"]]
            return self.read(snapshot_id).groupBy(*keys).agg(F.count("*").alias("record_count"))
        if what == "metadata_log_entries":
            return make([(x["ts"], x["version"]) for x in self.meta["log"]], "ts_ms long, version long")
        raise Unsupported(f"no metadata table {what}: one of {self.META}")

    def row_count(self) -> int:
        snap = self.snapshot()
        return sum(f["rows"] for f in snap.files) if snap else 0

    # -- maintenance

    def compact(self, target_mb: int = 128, condition: Column | None = None, min_files: int = 2, deduplicate: bool = False, sort: list | None = None, z_order: list[str] | None = None, dry_run: bool = False, compression: str | None = None) -> dict:
        """Rewrite files as few of about ``target_mb``, each of one partition; rows outside ``condition`` stay where they are.

        Files from 3/4 to 9/5 of that size stay too, and those of a partition with fewer than ``min_files`` others, unless
        rows are to be sorted, ordered or deduplicated. Where rows are written in order, a file whose rows take ``SORTED``
        bytes unpacked counts as one of that size, as a task sorts the rows of a file.
        """
        if target_mb <= 0:
            raise MaintenanceError("the target size must be positive")
        snap, target = self.snapshot(), target_mb << 20
        if snap is None:
            return {"files_before": 0, "files_after": 0, "rewritten": False}
        rest, hit = [], snap.files
        width = self._width() if sort or z_order or self.meta["sort"] else 0

        def size(f: dict) -> float:
            return max(f["bytes"] / target, f["rows"] * width / SORTED)

        if condition is not None:
            _, hit, rest, _ = self._touched(condition)
        stats = {"files_before": len(hit), "bytes_before": sum(f["bytes"] for f in hit), "rewritten": False}
        if not (deduplicate or sort or z_order):
            by: dict[str, list[dict]] = {}
            for f in hit:
                if size(f) < 0.75 or size(f) > 1.8:
                    by.setdefault(f["part"], []).append(f)
            chosen = [f for own in by.values() if len(own) >= min_files or any(size(f) > 1.8 for f in own) for f in own]
        else:
            chosen = hit if len(hit) >= min_files else []
        if not chosen or dry_run:
            return stats | {"files_after": len(hit)}
        paths = {f["path"] for f in chosen}
        df = self.read_files(chosen)
        if deduplicate:
            df = df.dropDuplicates()
        parts = max(1, -(-sum(f["bytes"] for f in chosen) // target), -(-sum(f["rows"] for f in chosen) * width // SORTED))
        order = [z_value(df, z_order)] if z_order else [F.col(c) if isinstance(c, str) else c for c in sort] if sort else None
        new = self.write_files(df, parts, order, compression)
        stay = rest + [f for f in hit if f["path"] not in paths]
        self._commit("replace", lambda now: stay + new, base=snap.id)
        return stats | {"files_after": len(hit) - len(chosen) + len(new), "rewritten": True}

    def _width(self) -> int:
        """About the bytes that a row takes in a sort."""
        fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        return 48 + sum(16 if isinstance(f.dataType, fixed) else 48 for f in self.schema) + 48 * len(self.meta["spec"])

    def set_properties(self, values: dict) -> None:
        self.change(lambda m: m["properties"].update(values))

    def expire(self, older_than_ms: int | None = None, retain_last: int = 1) -> list[int]:
        """Forget snapshots older than the time; the newest ``retain_last`` and those of branches and tags stay."""
        if retain_last < 0 or (older_than_ms is not None and older_than_ms < 0):
            raise MaintenanceError("must not be negative")
        age, now = {s.id: s.ts for s in self.snapshots()}, int(time.time() * 1000)
        old = [n for n, r in self.meta["refs"].items() if r.get("max_age_ms") and r["id"] in age and age[r["id"]] + r["max_age_ms"] < now and n != "main"]
        if old:
            self.change(lambda m: [m["refs"].pop(n, None) for n in old])
        newest = {s.id for s in sorted(self.snapshots(), key=lambda s: -s.ts)[: max(1, retain_last)]}
        held = newest | set(self.refs().values())
        gone = [s.id for s in self.snapshots() if s.id not in held and (older_than_ms is None or s.ts < older_than_ms)]
        if gone:
            self.change(lambda m: m.__setitem__("snapshots", [s for s in m["snapshots"] if s["id"] not in set(gone)]))
        return gone

    def _metadata(self) -> set[str]:
        """The metadata files in use: versions, and manifests of live snapshots."""
        folder = f"{self.root}/metadata"
        return {f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("v")} | {f"{folder}/{s.manifest}" for s in self.snapshots()}

    def orphans(self, older_than_ms: int | None = None, dry_run: bool = True) -> list[str]:
        """Data files that no live snapshot names and that are older than the time (three days ago by default)."""
        limit = older_than_ms if older_than_ms is not None else int(time.time() * 1000) - 3 * 86_400_000
        live = {f["path"] for s in self.snapshots() for f in s.files} | self._metadata()
        found = []
        for base in ("data", "metadata"):
            for folder, _, names in os.walk(f"{self.root}/{base}"):
                for n in names:
                    path = f"{folder}/{n}"
                    if (n.endswith(".parquet") or n.startswith(".")) and not n.endswith(".crc") and path not in live and os.path.getmtime(path) * 1000 < limit:
                        found.append(path)
        for path in [] if dry_run else found:
            os.remove(path)
        return sorted(found)

    def rewrite_manifests(self) -> dict:
        """Write the current snapshot's manifest afresh, its files in order of partition, and forget the history of versions."""
        snap, versions = self.snapshot(), len(self.meta["log"])
        name = write_manifest(self.root, sorted(snap.files, key=lambda f: (f["part"], f["path"]))) if snap else None

        def edit(meta):
            meta["log"] = meta["log"][-1:]
            for s in meta["snapshots"]:
                if snap and s["id"] == snap.id:
                    s["manifest"] = name

        self.change(edit)
        return {"versions_before": versions, "versions_after": len(self.meta["log"]), "manifest": name}

    def drop(self) -> None:
        shutil.rmtree(self.root)


def _all(conditions):
    made = None
    for c in conditions:
        made = c if made is None else made & c
    return made


def _type(value: Any) -> T.DataType:
    return T._parse_datatype_json_value(value)


def z_value(df: DataFrame, columns: list[str], bits: int = 16) -> Column:
    """Interleaved bits of each column's place among its approximate quantiles."""
    marks = 1 << min(bits, 8)
    row = df.agg(*[F.percentile_approx(F.xxhash64(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double"), [i / marks for i in range(1, marks)], 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    made = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        value = F.xxhash64(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")
        place = _below(sorted(set(row[i] or []), key=lambda q: (q != q, q)), value)
        for b in range(min(bits, 8)):
            made = made.bitwiseOR(F.shiftleft(F.shiftright(place.cast("long"), b).bitwiseAND(1), b * len(columns) + i))
    return made


def _below(marks: list, value: Column) -> Column:
    """How many of the sorted marks, 255 at most, are below the value: by halves."""
    if not marks:
        return F.lit(0)
    at = F.array(*[F.lit(q) for q in marks])
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(7, -1, -1)]), F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) < value, n + step).otherwise(n))
