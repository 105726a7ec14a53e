"""Source files that do not parse (problem 2)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.worker import resource

#: Languages by extension; Markdown is always valid and a path of another extension has no language.
LANGS = {"py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "json": "json", "toml": "toml", "md": "markdown", "markdown": "markdown"}
#: The start of a line that a version control system leaves behind at a conflict.
CONFLICT = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")


def _parsers() -> dict:
    from seamark.llm.grammar.data import json_errors, toml_errors
    from seamark.llm.grammar.go import go_errors
    from seamark.llm.grammar.python import python_errors
    from seamark.llm.grammar.rust import rust_errors
    from seamark.llm.grammar.typescript import typescript_errors

    return {"python": python_errors, "json": json_errors, "toml": toml_errors, "go": go_errors, "rust": rust_errors, "typescript": typescript_errors}


def errors_of(body: str, lang: str, parsers: dict) -> list[tuple[int, str]]:
    """All errors of a body in order of place; empty for a valid one."""
    if lang == "markdown" or (lang != "json" and not body.strip()):
        # by the project's rule an empty file is invalid only as JSON, though Go's grammar asks for a package clause
        return []
    return sorted(parsers[lang](body))


def cause_of(body: str, errors: list[tuple[int, str]]) -> str:
    """What most likely broke a body, from its first error."""
    at, what = errors[0]
    line = body[body.rfind("\n", 0, at) + 1 :].split("\n", 1)[0]
    if any(line.startswith(m) for m in CONFLICT) or any(f"\n{m} " in body[:at] or body.startswith(f"{m} ") for m in CONFLICT[:1]):
        return "merge conflict"
    if not body.strip():
        return "empty"
    if "found 'EOF'" in what or what.startswith("unterminated") or "never closed" in what:
        return "truncated"
    if body.lstrip()[:1] in "<#{" and at < 200 and what.startswith(("expected", "stray")):
        return "other language"
    return "syntax"


_TYPES = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("message", pa.string())])))


def _check(parsers: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(2**31 - 1)
        for b in batches:
            out: list[list] = [[] for _ in _TYPES]
            for sid, repo, lang, body in zip(*(c.to_pylist() for c in b.columns)):
                found = errors_of(body, lang, parsers)
                row = (sid, repo, lang, not found, cause_of(body, found) if found else None, [{"at": a, "message": m.encode("utf-8", "replace").decode()} for a, m in found])
                for x, v in zip(out, row):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES)], names=["source_id", "repo", "lang", "valid", "cause", "errors"])

    return run


def check_sources(sources: DataFrame) -> DataFrame:
    """A flag per file: ``source_id, repo, lang, valid, cause, errors`` with all errors (character place, message) in order.

    One narrow pass over the scan; rows are spread by a hash first only as Spark splits the files. Defined cases: rows with a null body
    or without a known language have no row; an empty body is invalid only as JSON; a NUL is invalid where the grammar has none; nesting
    may be of any depth, in Python too, whose own compiler refuses more than 200 brackets; a row delivered several times is one; other
    columns are ignored.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])[ext]
    s = sources.filter(F.col("body").isNotNull()).select("source_id", "repo", lang.alias("lang"), "body").filter(F.col("lang").isNotNull())
    out = s.mapInArrow(_check(_parsers()), "source_id long, repo string, lang string, valid boolean, cause string, errors array<struct<at:int,message:string>>")
    return out.dropDuplicates(["source_id"])


def acceptance(checked: DataFrame) -> DataFrame:
    """Rates per repository and language, with totals (null = all): ``repo, lang, files, invalid, invalid_rate, truncated, conflicts``."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = checked.cube("repo", "lang").agg(
        F.count("*").alias("files"), count(~F.col("valid")).alias("invalid"), count(F.col("cause") == "truncated").alias("truncated"), count(F.col("cause") == "merge conflict").alias("conflicts"),
        F.grouping_id().alias("level"),
    )
    return g.select("repo", "lang", "level", "files", "invalid", (F.col("invalid") / F.col("files")).alias("invalid_rate"), "truncated", "conflicts")
