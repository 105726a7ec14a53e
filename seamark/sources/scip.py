"""A Python data source for compiler index artifacts in the protobuf wire format: one row per occurrence.

``spark.dataSource.register(ScipSource)``, then ``spark.read.format("scip").load(path)``. Documents are read one by one, so that memory
holds one document; lines and columns stay as they are written and become bytes where the text is at hand.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_ARTIFACT, MOST_DOCUMENT, MOST_OCCURRENCES = 1 << 30, 8 << 20, 16_384
SCHEMA = "path string, language string, symbol string, roles int, start_line int, start_column int, end_line int, end_column int"


def varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        if i >= len(b) or shift > 63:
            raise ValueError("truncated varint")
        x = b[i]
        i += 1
        value |= (x & 0x7F) << shift
        if x < 0x80:
            return value, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field number, wire type, value) of a message."""
    i = 0
    while i < len(b):
        tag, i = varint(b, i)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, i = varint(b, i)
            yield number, wire, value
        elif wire == 2:
            n, i = varint(b, i)
            if i + n > len(b):
                raise ValueError("truncated field")
            yield number, wire, b[i : i + n]
            i += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, wire, b[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {wire}")


def packed(v: bytes | int) -> list[int]:
    if isinstance(v, int):
        return [v]
    out, i = [], 0
    while i < len(v):
        x, i = varint(v, i)
        out.append(x)
    return out


def occurrences_of(document: bytes) -> Iterator[tuple]:
    """Rows of one document; refuses one beyond the bounds."""
    if len(document) > MOST_DOCUMENT:
        raise ValueError("document too large")
    path = language = ""
    found = []
    for number, _, v in fields(document):
        if number == 1:
            path = v.decode()
        elif number == 4:
            language = v.decode()
        elif number == 2:
            span, symbol, roles = [], "", 0
            for n, _, x in fields(v):
                if n == 1:
                    span += packed(x)
                elif n == 2:
                    symbol = x.decode()
                elif n == 3:
                    roles = x
            if len(span) == 3:
                span = [span[0], span[1], span[0], span[2]]
            if len(span) == 4:
                found.append((symbol, roles, *span))
            if len(found) > MOST_OCCURRENCES:
                raise ValueError("too many occurrences")
    for row in found:
        yield (path, language, *row)


def read_scip(spark, path: str):
    """Occurrences of all artifacts below a path of any file system that Spark reads, one task for each file; one above the bound is an error."""
    from pyspark.sql import functions as F

    def decode(batches):
        for pdf in batches:
            for size, data in zip(pdf["length"], pdf["content"]):
                if size > MOST_ARTIFACT:
                    raise ValueError("artifact too large")
                rows = [r for number, _, v in fields(bytes(data)) if number == 2 for r in occurrences_of(v)]
                yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])

    # an artifact above the bound is never read: its size is known before its content is
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.scip").option("recursiveFileLookup", "true").load(path)
    content = F.when(F.col("length") <= MOST_ARTIFACT, F.col("content"))
    return files.select("length", content.alias("content")).mapInPandas(decode, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ScipReader(DataSourceReader):
    """The same as a data source, for folders that every worker has mounted; ``read_scip`` reads any file system."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.scip"))) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_File(f) for f in files]

    def read(self, partition):
        if os.path.getsize(partition.path) > MOST_ARTIFACT:
            raise ValueError("artifact too large")
        with open(partition.path, "rb") as f:
            data = f.read()
        for number, _, v in fields(data):
            if number == 2:
                yield from occurrences_of(v)


class ScipSource(DataSource):
    @classmethod
    def name(cls):
        return "scip"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ScipReader(self.options)
