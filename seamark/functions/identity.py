"""Identity functions: digests, keys and splits that must be equal bit for bit wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def hash64(c: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian and unsigned, as ``decimal(20,0)``."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def doc_key(path: Column, start: Column) -> Column:
    """Path and start byte joined by NUL."""
    return F.concat(path, F.lit("\0"), start.cast("string"))


def key_hash(path: Column, start: Column) -> Column:
    """The tie-breaker of every cut."""
    return hash64(doc_key(path, start))


def json_string(c: Column) -> Column:
    """A text as a compact JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[(.*)\]$", "$1")


def json_digest(*parts: Column) -> Column:
    """SHA-256 of a compact JSON array of texts and integers; a null part gives null."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def input_key(function_digest: Column, text: Column) -> Column:
    """Identity of exactly this input of exactly this function."""
    return F.sha2(F.concat(function_digest, F.lit("\0"), text), 256)


def collapse(c: Column) -> Column:
    """ASCII white space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "))


def fingerprint(family: Column, state: Column, options: Column) -> Column:
    """Family, collapsed state and sorted options: equal questions have equal fingerprints."""
    return F.sha2(F.concat_ws("\0", family, collapse(state), F.array_join(F.array_sort(F.transform(options, collapse)), "\0")), 256)


def split_of(group: Column) -> Column:
    """evaluation, calibration or train, by the group's ``hash64`` modulo ten."""
    bucket = F.pmod(hash64(group), F.lit(10).cast("decimal(20,0)"))
    return F.when(bucket == 0, "evaluation").when(bucket == 1, "calibration").otherwise("train")


def legacy_split(task: Column) -> Column:
    """The earlier split by the first byte of the task's digest."""
    first = F.substring(F.sha2(task, 256), 1, 2)
    return F.when(first == "00", "evaluation").when(first == "01", "calibration").otherwise("train")


def handle(path: Column, start: Column, end: Column, sha256: Column, workspace: Column) -> Column:
    """The citation ``path#start-end@sha32.ws16``."""
    return F.concat(path, F.lit("#"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("@"), F.substring(sha256, 1, 32), F.lit("."), F.substring(workspace, 1, 16))


#: Fixed value: the grammar of a citation, anchored at its end because a path may hold any sign.
HANDLE = r"^(.+)#([0-9]{1,20})-([0-9]{1,20})@([0-9a-f]{32})\.([0-9a-f]{16})$"


def parse_handle(c: Column) -> Column:
    """The parts of a citation; null if it isn't one or its range is empty or reversed."""
    part = lambda k: F.regexp_extract(c, HANDLE, k)
    start, end = part(2).try_cast("long"), part(3).try_cast("long")
    return F.when(c.rlike(HANDLE) & (start < end), F.struct(part(1).alias("path"), start.alias("start"), end.alias("end"), part(4).alias("sha32"), part(5).alias("ws16")))
