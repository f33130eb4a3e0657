"""Readers and writers by a file's suffix, tables behind JDBC, and JSON from the web."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a format written by the driver may have.
DRIVER_ROWS = 1_000_000


#: Bytes that may come through the driver from a URL.
URL_BYTES = 256 << 20


def _suffix(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long, timestamps without zone: types do not depend on the values that happened to be there."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    small = {c: F.col(f"`{c}`").cast("long") for c, t in kinds.items() if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType))}
    times = {c: F.col(f"`{c}`").cast("timestamp_ntz") for c, t in kinds.items() if isinstance(t, T.TimestampType)}
    return df.withColumns({**small, **times}) if small or times else df


def load(spark: SparkSession, path: str, sep: str = ",", sheet: str | int = 0) -> DataFrame:
    """CSV, TSV, Parquet, JSON lines and ORC by Spark; spreadsheets and statistical files by pandas where its reader is installed."""
    kind = _suffix(path)
    if kind in ("csv", "tsv", "txt"):
        return _wide(spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else sep))
    if kind in ("json", "jsonl", "ndjson"):
        return _wide(spark.read.json(path, multiLine=kind == "json"))
    if kind == "orc":
        return spark.read.orc(path)
    readers = {"xlsx": "read_excel", "xls": "read_excel", "dta": "read_stata", "sas7bdat": "read_sas", "sav": "read_spss"}
    if kind in readers:
        import pandas as pd

        try:
            pdf = getattr(pd, readers[kind])(path, **({"sheet_name": sheet} if kind in ("xlsx", "xls") else {}))
        except ImportError as e:
            raise ImportError(f"reading .{kind} needs a package that is not installed: {e}") from e
        return _wide(spark.createDataFrame(pdf))
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, single: bool = False) -> None:
    """By suffix; `single` gathers the rows in one file."""
    kind = _suffix(path)
    if kind in ("xlsx", "dta"):
        if df.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
            raise ValueError(f".{kind} is written by the driver and takes {DRIVER_ROWS} rows at most")
        pdf = df.toPandas()
        pdf.to_stata(path, write_index=False) if kind == "dta" else pdf.to_excel(path, index=False)
        return
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    out.csv(path, header=True) if kind == "csv" else out.json(path) if kind in ("json", "jsonl") else out.orc(path) if kind == "orc" else out.parquet(path)


def sql_load(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8, **options: str) -> DataFrame:
    """A table or a SELECT behind a JDBC URL; with a numeric key the read is partitioned."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    table = f"({query}) q" if query.lstrip().lower().startswith("select") else query
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.option("dbtable", table).load()


def json_rows(payload: object, path: str = "") -> list[dict]:
    """The records of a JSON payload: below a dotted path, in the only list of an object, or the object itself."""
    for step in filter(None, path.split(".")):
        payload = payload[int(step)] if isinstance(payload, list) else payload[step]
    if isinstance(payload, dict):
        lists = [v for v in payload.values() if isinstance(v, list)]
        payload = lists[0] if len(lists) == 1 else [payload]
    return [x if isinstance(x, dict) else {"value": x} for x in payload]


def web_json(spark: SparkSession, url: str, method: str = "GET", params: Mapping[str, str] | None = None, path: str = "") -> DataFrame:
    """A REST response as a table."""
    data = urllib.parse.urlencode(params or {})
    request = urllib.request.Request(url if method == "POST" or not data else f"{url}?{data}", data.encode() if method == "POST" else None, method=method)
    with urllib.request.urlopen(request, timeout=60) as r:
        rows = json_rows(json.load(r), path)
    return _wide(spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in rows])))


def load_text(spark: SparkSession, text: str, sep: str | None = None) -> DataFrame:
    """Delimited text with a header; without `sep` a tab, if the header holds one, else a comma."""
    lines = [x for x in text.splitlines() if x.strip()]
    sep = {r"\t": "\t", "tab": "\t"}.get(sep, sep) if sep else "\t" if lines and "\t" in lines[0] else ","
    return _wide(spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True, inferSchema=True, sep=sep))


def load_url(spark: SparkSession, url: str, kind: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV, JSON or Parquet file behind a URL, of at most URL_BYTES: it passes through the driver."""
    kind = kind or _suffix(urllib.parse.urlparse(url).path)
    with urllib.request.urlopen(url, timeout=60) as r:
        data = r.read(URL_BYTES + 1)
    if len(data) > URL_BYTES:
        raise ValueError(f"more than {URL_BYTES} bytes; put the file where executors can read it, and load it there")
    if kind == "parquet":
        import io

        import pyarrow.parquet as pq

        return _wide(spark.createDataFrame(pq.read_table(io.BytesIO(data))))
    if kind in ("json", "jsonl"):
        text = data.decode()
        rows = [json.loads(x) for x in text.splitlines() if x.strip()] if kind == "jsonl" else json_rows(json.loads(text))
        return _wide(spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in rows])))
    return load_text(spark, data.decode(), sep)


def clipboard() -> str:
    """The text on the clipboard, by the first program of the system that tells it."""
    import shutil
    import subprocess

    for program in (["wl-paste"], ["xclip", "-selection", "clipboard", "-o"], ["xsel", "-ob"], ["pbpaste"]):
        if shutil.which(program[0]):
            return subprocess.run(program, capture_output=True, text=True, timeout=10, check=True).stdout
    raise ValueError("no program that reads the clipboard is installed")


def value_labels(df: DataFrame, column: str, labels: Mapping[object, str]) -> DataFrame:
    """df with value labels in the column's metadata."""
    meta = dict(df.schema[column].metadata) | {"labels": {str(k): v for k, v in labels.items()}}
    return df.withMetadata(column, meta)


def labels_of(df: DataFrame, column: str) -> dict[str, str]:
    return dict(df.schema[column].metadata.get("labels", {}))
