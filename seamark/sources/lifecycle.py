"""Derived tables of a store: rebuilt from the rows they derive from, swapped in one step, and upgraded to a newer layout."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Derived:
    """A table that can always be made again; versions lie side by side and one small file names the current one.

    Layout: ``<dir>/v=<attempt>/`` Parquet, ``<dir>/current.json`` the attempt and its layout. The file is replaced by one rename, so that a
    reader sees the old version or the new one; what a failed build leaves behind is never read. The version that was replaced moves to
    ``<dir>/quarantine/``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.dir = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.dir).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.dir}/quarantine"))
        self._fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def state(self) -> dict | None:
        at = self._path(f"{self.dir}/current.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        now = self.state()
        return self.spark.read.parquet(f"{self.dir}/{now['version']}") if now else None

    def rebuild(self, build: Callable[[], DataFrame], layout: int = 1, check: Callable[[DataFrame], bool] | None = None) -> dict:
        """Write the table anew and swap it in, if ``check`` of what was written holds; the old version goes to quarantine."""
        old, version = self.state(), f"v={uuid.uuid4().hex[:12]}"
        build().write.parquet(f"{self.dir}/{version}")
        if check is not None and not check(self.spark.read.parquet(f"{self.dir}/{version}")):
            self._fs.delete(self._path(f"{self.dir}/{version}"), True)
            raise ValueError("the rebuilt table does not hold what it must; the old one stays")
        mark = {"version": version, "layout": layout}
        part = self._path(f"{self.dir}/.{version}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.hsync()
        out.close()
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        opts = self.spark.sparkContext._gateway.new_array(rename, 1)
        opts[0] = rename.OVERWRITE
        self._fc.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path(f"{self.dir}/current.json")), opts)
        if old:
            self._fs.rename(self._path(f"{self.dir}/{old['version']}"), self._path(f"{self.dir}/quarantine/{old['version']}"))
        return mark

    def upgrade(self, steps: dict[int, Callable[[DataFrame], DataFrame]], to: int) -> dict:
        """Carry the table from its layout to ``to``, one step for each layout between; a missing step or an older target is an error."""
        now = self.state()
        if now is None or to < now["layout"] or any(k not in steps for k in range(now["layout"], to)):
            raise ValueError("there is no way from the present layout to the one asked for")
        if to == now["layout"]:
            return now
        df = self.read()
        for k in range(now["layout"], to):
            df = steps[k](df)
        rows = self.read().count()
        return self.rebuild(lambda: df, to, lambda new: new.count() == rows)


def add_columns(**defaults) -> Callable[[DataFrame], DataFrame]:
    """An upgrade step that adds columns with their defaults."""

    def step(df: DataFrame) -> DataFrame:
        for name, value in defaults.items():
            if name not in df.columns:
                df = df.withColumn(name, F.lit(value))
        return df

    return step
