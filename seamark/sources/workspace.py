"""Workspaces of text files: scanning, admission, chunks, snapshots and their differences."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.functions.identity import digest

#: Fixed values of admission.
MOST_BYTES = 2 * 1024 * 1024
CHUNK_BYTES = 2048
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"
SKIPPED_DIRS = ("target", "node_modules")
PATH_BYTES = 4096


#: Names of files whose lines say what a scan leaves out, and how many bytes of them a scan reads.
IGNORE_FILES, IGNORE_BYTES = (".gitignore", ".ignore"), 1 << 20


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool, bool]]:
    """(pattern of whole paths, keeps?, folders only?) of all ignore files below a folder, outer ones first; later rules win.

    Spark's readers pass over names with a leading dot, so that these few files are found and read through the file system itself. They are
    configuration: their size is checked, not their number assumed.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    found, size, files = [], 0, fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        if f.getPath().getName() in IGNORE_FILES:
            size += f.getLen()
            if size > IGNORE_BYTES:
                raise ValueError(f"ignore files hold more than {IGNORE_BYTES} bytes")
            stream = fs.open(f.getPath())
            try:
                text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
            finally:
                stream.close()
            found.append((f.getPath().toUri().getPath()[len(base) + 1 :].rpartition("/")[0], text))
    rules = [ignore_rule(line, folder) for folder, text in sorted(found, key=lambda x: (x[0].count("/"), x[0] != "", x[0])) for line in text.splitlines()]
    return [r for r in rules if r]


def ignore_rule(line: str, folder: str = "") -> tuple[str, bool, bool] | None:
    """One line of an ignore file as a pattern of whole paths; None for a blank line or a comment."""
    x = line.rstrip()
    if not x or x.startswith("#"):
        return None
    keep = x.startswith("!")
    x = x[1:] if keep or x.startswith("\\") else x
    dirs = x.endswith("/")
    x = x.rstrip("/")
    anchored = "/" in x
    out, i = "", 0
    x = x.lstrip("/")
    while i < len(x):
        if x.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif x.startswith("**", i):
            out, i = out + ".*", i + 2
        elif x[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif x[i] == "?":
            out, i = out + "[^/]", i + 1
        elif x[i] == "[" and "]" in x[i + 2 :]:
            end = x.index("]", i + 2)
            out, i = out + "[" + x[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + ("\\" + x[i] if not x[i].isalnum() and x[i] != "/" else x[i]), i + 1
    base = "".join("\\" + c if not c.isalnum() and c != "/" else c for c in folder) + "/" if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{out}$", keep, dirs


def ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file's path, or a folder above it, is left out by the last rule that matches it; what is in an ignored folder stays out."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k < F.size(parts)).alias("folder")))

    def out(x: Column) -> Column:
        state = F.lit(False)
        for rx, keep, dirs in rules:
            hit = x["p"].rlike(rx) & x["folder"] if dirs else x["p"].rlike(rx)
            state = F.when(hit, not keep).otherwise(state)
        return state

    return F.exists(above, out) if rules else F.lit(False)


def _relative(root: str) -> Column:
    prefix = root.rstrip("/")
    whole = "/" + prefix.split("://")[-1].lstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join("\\" + x if not x.isalnum() and x != "/" else x for x in whole) + "/?", "")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """The files below a folder: ``path`` relative to it, ``content`` bytes, ``modified``; hidden files, build folders and what ignore files or
    the given globs name stay out, and so do empty files, which Spark's reader doesn't show.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = raw.select(_relative(root).alias("path"), "content", F.col("modificationTime").alias("modified"))
    rules = ignore_rules(spark, root)
    if rules:
        out = out.filter(~ignored(F.col("path"), rules))
    parts = F.split("path", "/")
    out = out.filter(~F.exists(parts, lambda x: x.startswith(".")) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRS])))
    for g in ignore or []:
        rx = fnmatch.translate(g.rstrip("/"))
        out = out.filter(~F.col("path").rlike(rx) & ~F.exists(F.split("path", "/"), _like(rx)))
    return out


def _like(rx: str):
    return lambda x: x.rlike(rx)


def valid_path(path: Column) -> Column:
    """Relative, without ``..``, empty or ``.`` components, backslash or NUL, and not too long."""
    return F.coalesce(
        (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.contains("\0") & (F.octet_length(path) <= PATH_BYTES) & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", "..")),
        F.lit(False),
    )


def exclusion(content: Column, is_text: bool = True) -> Column:
    """Why a body is not admitted: missing, too_large, nul, not_utf8, private_key; null if it is."""
    text = content if is_text else content.cast("string")
    valid = F.lit(True) if is_text else F.is_valid_utf8(text)
    return (
        F.when(content.isNull(), "missing")
        .when(F.octet_length(content) > MOST_BYTES, "too_large")
        .when(F.instr(text, "\0") > 0, "nul")
        .when(~valid, "not_utf8")
        .when(text.rlike(PRIVATE_KEY), "private_key")
    )


def admit(scanned: DataFrame) -> DataFrame:
    """Admitted files as source rows: ``path, sha256, bytes, lines, content``."""
    text = F.col("content").cast("string")
    return scanned.filter(exclusion(F.col("content"), False).isNull() & valid_path(F.col("path"))).select("path", digest(text).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"), F.size(F.split(text, "\n")).cast("long").alias("lines"), text.alias("content"))


def chunk_ends(body: bytes, most: int = CHUNK_BYTES) -> list[int]:
    """Ends of consecutive chunks, each cut after its last line end, or at a character boundary where it has none."""
    ends, at, n = [], 0, len(body)
    while at < n:
        end = min(n, at + most)
        if end < n:
            k = body.rfind(b"\n", at, end)
            if k >= 0:
                end = k + 1
            else:
                while end > at and body[end] & 0xC0 == 0x80:
                    end -= 1
        ends.append(end)
        at = end
    return ends


def chunks(sources: DataFrame, key: str = "path", text: str = "content", most: int = CHUNK_BYTES) -> DataFrame:
    """``key, ordinal, start, end, first_line, last_line, chunk``; the chunks of a body joined give it back."""
    schema = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType()), T.StructField("chunk", T.StringType())]))

    @F.pandas_udf(schema)
    def cut(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            body, at, line, out = t.encode("utf-8", "replace"), 0, 1, []
            for k, end in enumerate(chunk_ends(body, most)):
                part = body[at:end]
                breaks = part.count(b"\n")
                out.append((k, at, end, line, line + breaks - part.endswith(b"\n"), part.decode()))
                line, at = line + breaks, end
            return out

        return s.map(one)

    return sources.select(key, F.explode(cut(F.col(text))).alias("c")).select(key, "c.*")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, change`` with insert, update, unchanged or delete, by the digests of two snapshots (one row per key each)."""
    o = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return o.join(n, keys, "full").select(*keys, change.alias("change"))


def sweep(stored: DataFrame, seen: DataFrame, keys: list[str], complete: bool, scan_id: int | None = None, newest_scan: int | None = None) -> DataFrame:
    """Stored rows to retire: those a complete, not superseded scan did not see; none otherwise."""
    if not complete or (scan_id is not None and newest_scan is not None and scan_id < newest_scan):
        return stored.limit(0)
    return stored.join(seen.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, scanned: DataFrame, keys: list[str], complete: bool = True) -> DataFrame:
    """The snapshot after a scan: scanned rows win, rows not seen survive only an incomplete scan."""
    rest = stored.join(scanned.select(*keys), keys, "left_anti")
    return scanned.unionByName(rest.limit(0) if complete else rest, allowMissingColumns=True)
