"""Corpora of many small tables with labels in their Parquet footers, binary token files, small files replaced whole."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.storage import scratch

#: Fixed value: the footer key that holds a table's labels as JSON.
FOOTER = b"gittables"
CELLS = 200


def _put(folder: str, name: str, content: bytes) -> str:
    """Write a file under a passing name and move it into place."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(content)
    system.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def write_tables(cells: DataFrame, folder: str, space: str) -> None:
    """One Parquet file a table from ``cells(table, columns array<struct<name, label, cells>>)``; labels go to the footer."""

    def run(pdfs):
        for pdf in pdfs:
            for name, columns in zip(pdf["table"], pdf["columns"], strict=True):
                table = pa.table({c["name"]: pa.array(list(c["cells"]), pa.string()) for c in columns})
                labels = {c["name"]: [c["label"]] if c["label"] is not None else [] for c in columns}
                table = table.replace_schema_metadata({FOOTER: json.dumps({f"{space}_semantic_column_types": labels}).encode()})
                out = io.BytesIO()
                pq.write_table(table, out)
                _put(folder, f"{name}.parquet", out.getvalue())
            yield pdf[["table"]]

    cells.mapInPandas(run, "table string").write.format("noop").mode("overwrite").save()


def _labels(schema: pa.Schema, space: str) -> dict[str, list[str]]:
    held = json.loads((schema.metadata or {}).get(FOOTER, b"{}"))
    found = held.get(f"{space}_semantic_column_types", {})
    return {k: v if isinstance(v, list) else [v] for k, v in found.items()}


def scan_tables(spark: SparkSession, folder: str, space: str, vocabulary: tuple[str, ...] | None = None) -> DataFrame:
    """SRC-04: ``(table_id, column_ix, name, label, cells)``, a row for each labelled column.

    A column's label is its first candidate in the vocabulary (the first of all,
    without one); columns hold their first 200 cells. Spark does not show footers,
    so files come whole, as bytes.
    """

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                table = pq.read_table(io.BytesIO(content))
                labels = _labels(table.schema, space)
                for i, name in enumerate(table.column_names):
                    label = next((x for x in labels.get(name, []) if vocabulary is None or x in vocabulary), None)
                    if label is not None:
                        rows.append((path.rsplit("/", 1)[-1].removesuffix(".parquet"), i, name, label, [None if x is None else str(x) for x in table.column(i).slice(0, CELLS).to_pylist()]))
            yield pd.DataFrame(rows, columns=["table_id", "column_ix", "name", "label", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", "content").mapInPandas(run, "table_id string, column_ix int, name string, label string, cells array<string>")


def discover_labels(spark: SparkSession, folder: str, space: str) -> DataFrame:
    """SRC-05: ``(label, id)``: all labels of the footers in their order, with dense ids; a label set is small by nature."""

    def run(pdfs):
        for pdf in pdfs:
            found = {x for content in pdf["content"] for own in _labels(pq.read_schema(io.BytesIO(content)), space).values() for x in own}
            yield pd.DataFrame({"label": sorted(found)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    labels = files.select("content").mapInPandas(run, "label string").distinct()
    from pyspark.sql import Window

    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("id"))


def cached_labels(spark: SparkSession, folder: str, space: str, cache: str) -> tuple[DataFrame, bool]:
    """SRC-06: the labels from the cache while the folder's files are as they were, else discovered again; and whether it was a hit.

    The staleness key is the number, size and latest change of the files; listing them reads no content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    seen = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max(F.unix_micros("modificationTime")).alias("at")).first()
    path = f"{cache}/{space}-{seen.n}-{seen.bytes}-{seen.at}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    hit = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not hit:
        discover_labels(spark, folder, space).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit


def write_bin(df: DataFrame, ids: str, folder: str | None = None) -> DataFrame:
    """SNK-05: ``part-N.bin`` with 16-bit ids end to end and ``part-N.idx`` with the rows' sizes, a pair a partition; returns ``(part, bin, idx, rows)``."""
    folder = folder or scratch(df.sparkSession, "bin")

    def run(batches):
        part = TaskContext.get().partitionId()
        held, sizes = [], []
        for batch in batches:
            for x in batch.column(0):
                own = np.array(x.as_py() or [], np.int64)
                if len(own) and not 0 <= own.min() <= own.max() < 1 << 16:
                    raise ValueError("ids must fit 16 bits")
                held.append(own.astype("<u2").tobytes())
                sizes.append(len(own))
        if sizes:
            paths = _put(folder, f"part-{part:06}.bin", b"".join(held)), _put(folder, f"part-{part:06}.idx", np.array(sizes, "<u4").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "bin": paths[0], "idx": paths[1], "rows": len(sizes)}])

    from marlstone.storage import stash

    return stash(df.select(ids).mapInArrow(run, "part long, bin string, idx string, rows long"), "bin-files")


def read_bin(manifest: DataFrame) -> DataFrame:
    """``(part, row, ids)`` of the files of :func:`write_bin`."""

    def run(batches):
        for batch in batches:
            for part, data, index in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sizes = np.frombuffer(_get(index), "<u4").astype(np.int32)
                ids = pa.array(np.frombuffer(_get(data), "<u2").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int64)), pa.array(np.arange(len(sizes))), lists], ["part", "row", "ids"])

    return manifest.select("part", "bin", "idx").mapInArrow(run, "part long, row long, ids array<int>")


def _get(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def replace_file(folder: str, name: str, text: str) -> str:
    """SNK-12: a small text file, replaced in one move."""
    return _put(folder, name, text.encode())


def latest(folder: str, patterns: tuple[str, ...], chosen: str | None = None) -> str | None:
    """SRC-26: ``chosen`` if it is there (else none); without it, the last name of the first pattern that any file meets."""
    import fnmatch

    system, path = fs.FileSystem.from_uri(folder)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)))
    if chosen is not None:
        return chosen if chosen in names else None
    return next((met[-1] for p in patterns if (met := fnmatch.filter(names, p))), None)
