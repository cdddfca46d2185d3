"""Readers by format, and exports. Formats whose library or jar isn't installed say what they need."""

from __future__ import annotations

import glob
import importlib.util
import json
import os
import urllib.request
import warnings
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import Unsupported


def _need(module: str, what: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise Unsupported(f"{what} needs the Python package {module}")


def _jar(spark: SparkSession, kind: str, options: dict, path: str) -> DataFrame:
    try:
        return spark.read.format(kind).options(**options).load(path)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e) or "AVRO" in str(e).upper():
            raise Unsupported(f"{kind} needs its data source jar on spark.jars.packages") from e
        raise


def read_csv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)


def read_json(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**{"multiLine": True} | options).json(path)


def read_ndjson(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**options).json(path)


def read_parquet(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def read_orc(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**options).orc(path)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", **options: Any) -> DataFrame:
    return spark.read.format("xml").options(rowTag=row_tag, **options).load(path)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    with pa.memory_map(path) as f:
        return spark.createDataFrame(pa.ipc.open_file(f).read_all())


def read_avro(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return _jar(spark, "avro", options, path)


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _jar(spark, "delta", {} if version is None else {"versionAsOf": version}, path)


def read_hudi(spark: SparkSession, path: str) -> DataFrame:
    return _jar(spark, "hudi", {}, path)


def read_lance(spark: SparkSession, path: str) -> DataFrame:
    _need("lance", "Lance")
    import lance

    return spark.createDataFrame(lance.dataset(path).to_table())


def read_vortex(spark: SparkSession, path: str) -> DataFrame:
    _need("vortex", "Vortex")
    import vortex

    return spark.createDataFrame(vortex.open(path).to_arrow().read_all())


def read_excel(spark: SparkSession, path: str, sheet_name: str = "Sheet1") -> DataFrame:
    _need("openpyxl", "Excel")
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet_name))


def read_gsheets(spark: SparkSession, url: str, credentials: Any = None, sheet_name: str | None = None) -> DataFrame:
    _need("gspread", "Google Sheets")
    import gspread

    book = gspread.service_account(credentials).open_by_url(url)
    return spark.createDataFrame((book.worksheet(sheet_name) if sheet_name else book.sheet1).get_all_records())


def read_sql(spark: SparkSession, query: str, uri: str, **options: Any) -> DataFrame:
    """A query answered by a JDBC source."""
    return spark.read.format("jdbc").options(url=uri, query=query, **options).load()


def read_sas(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.read_sas(path, encoding="utf-8"))


def read_spss(spark: SparkSession, path: str) -> DataFrame:
    _need("pyreadstat", "SPSS")
    import pandas as pd

    return spark.createDataFrame(pd.read_spss(path))


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.read_stata(path))


def read_api(spark: SparkSession, url: str, json_key: str | None = None) -> DataFrame:
    """Records of a JSON answer, or those under ``json_key``; one object is one record."""
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return from_payload(spark, json.load(answer), json_key)


def from_payload(spark: SparkSession, payload: Any, json_key: str | None = None) -> DataFrame:
    records = payload[json_key] if json_key else payload
    lines = [json.dumps(r) for r in ([records] if isinstance(records, dict) else records)]
    sample = spark.createDataFrame([(x,) for x in lines], "line string")
    shape = sample.select(F.schema_of_json_agg("line").alias("s")).first()["s"] if hasattr(F, "schema_of_json_agg") else spark.read.json(spark.sparkContext.parallelize(lines)).schema
    return sample.select(F.from_json("line", shape).alias("r")).select("r.*")


def read_huggingface(spark: SparkSession, name: str, split: str = "train") -> DataFrame:
    _need("datasets", "Hugging Face data sets")
    import datasets

    return spark.createDataFrame(datasets.load_dataset(name, split=split).data.table)


def read_html(spark: SparkSession, path: str, match: str | None = None) -> DataFrame:
    """The first table of a page (whose text has ``match``), by the standard library's parser."""
    from html.parser import HTMLParser

    class Tables(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tables, self.cell = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.cell = []

        def handle_data(self, data):
            if self.cell is not None:
                self.cell.append(data)

        def handle_endtag(self, tag):
            if tag in ("td", "th") and self.cell is not None:
                self.tables[-1][-1].append("".join(self.cell).strip())
                self.cell = None

    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path, timeout=60) as answer:  # noqa: S310
            page = answer.read().decode("utf-8", "replace")
    else:
        with open(path, encoding="utf-8") as f:
            page = f.read()
    parser = Tables()
    parser.feed(page)
    for rows in parser.tables:
        if rows and (match is None or any(match in c for r in rows for c in r)):
            return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
    raise ValueError("no table found")


def read_clipboard(spark: SparkSession) -> DataFrame:
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_clipboard())
    except Exception as e:
        raise Unsupported("no clipboard here") from e


READERS: dict[str, Callable[..., DataFrame]] = {n[5:]: f for n, f in list(globals().items()) if n.startswith("read_")}
EXTENSIONS = {"csv": "csv", "tsv": "csv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "parquet": "parquet", "pq": "parquet", "orc": "orc", "xml": "xml", "arrow": "ipc", "ipc": "ipc", "feather": "ipc", "avro": "avro", "delta": "delta", "hudi": "hudi", "lance": "lance", "vortex": "vortex", "xlsx": "excel", "xls": "excel", "sas7bdat": "sas", "xpt": "sas", "sav": "spss", "dta": "stata", "html": "html", "htm": "html"}


def read_file(spark: SparkSession, path: str, kind: str | None = None, **options: Any) -> DataFrame:
    kind = kind or EXTENSIONS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind not in READERS:
        raise ValueError(f"unknown format {kind or path}")
    if path.lower().endswith(".tsv"):
        options.setdefault("sep", "\t")
    return READERS[kind](spark, path, **options)


def read_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files of a folder, of one format, by column name with types widened; unknown ones are skipped with a warning."""
    files, kinds = [], set()
    for f in sorted(glob.glob(os.path.join(path, pattern))):
        kind = EXTENSIONS.get(f.rsplit(".", 1)[-1].lower())
        if kind is None:
            warnings.warn(f"{f} is skipped: unknown format", stacklevel=2)
            continue
        kinds.add(kind)
        files.append(f)
    if len(kinds) > 1:
        raise ValueError(f"several formats: {sorted(kinds)}")
    if not files:
        raise ValueError("no files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_file(spark, f) for f in files])


# ---------------------------------------------------------------- exports


def to_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def to_csv(df: DataFrame, path: str, separator: str = ",", include_header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", separator).option("header", include_header).csv(path)


def to_json(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines in a folder; ``array``: one file that is a JSON array, written row by row through the driver."""
    if not array:
        df.write.mode("overwrite").json(path)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator(prefetchPartitions=True)):
            f.write(("," if i else "") + "\n" + row["j"])
        f.write("\n]\n")
