"""HTTP boundaries: facts of providers and consumers, route templates and their resolution."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.session import cut, hinted

#: Converters of route templates and what one segment of each may be; the last two take the rest of a path, the very last
#: one only if its first segment isn't empty. In angle brackets only strings and integers are known.
CONVERTERS = {"str": r"[^/]+", "int": r"[0-9]+", "float": r"[0-9]+(?:\.[0-9]+)?", "uuid": r"[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}"}
OPEN = ("path", "flask_path")
ANGLE = {"string": "str", "int": "int"}
MOST_ROUTE = 1024
MOST_FILES, MOST_FACTS, MOST_RESULTS = 64, 128, 64
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")


def normalize_template(c: Column) -> Column:
    """A route with each parameter as ``{name:converter}``: ``<int:id>``, ``<id>``, ``{id}`` and ``{id:int}`` are known.

    Null for a route that doesn't begin with a slash, is longer than 1,024 bytes, holds ``?``, ``#`` or ``%``, mixes text and a parameter
    in a segment, repeats a name, has an unknown converter or one that takes the rest before its end.
    """
    name = r"([A-Za-z_][A-Za-z0-9_]*)"
    kinds = "|".join([*CONVERTERS, *OPEN])

    def part(x: Column) -> Column:
        brace = F.regexp_replace(x, rf"^\{{{name}\}}$", "{$1:str}")
        angle = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, rf"^<{name}>$", "{$1:str}"), rf"^<string:{name}>$", "{$1:str}"), rf"^<int:{name}>$", "{$1:int}")
        out = F.when(x.startswith("<"), angle).otherwise(brace)
        return F.when(~x.rlike(r"[<>{}]"), x).when(out.rlike(rf"^\{{{name}:(?:{kinds})\}}$"), out)

    parts = F.transform(F.split(c, "/"), part)
    names = F.filter(F.transform(parts, lambda x: F.regexp_extract(x, rf"^\{{{name}:", 1)), lambda x: x != "")
    mixed = c.contains("<") & c.contains("{")
    ends_before = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.rlike(r":(?:flask_)?path\}$"))
    ok = c.startswith("/") & (F.octet_length(c) <= MOST_ROUTE) & ~c.rlike(r"[?#%]") & ~mixed & ~F.exists(parts, lambda x: x.isNull()) & (F.size(F.array_distinct(names)) == F.size(names)) & ~F.coalesce(ends_before, F.lit(False))
    return F.when(ok, F.array_join(parts, "/"))


def segment_fits(template: Column, segment: Column) -> Column:
    """Whether one segment of a path is what a segment of a template asks for; the patterns are constants."""
    out = F.when(~template.startswith("{"), template == segment)
    for name, rx in CONVERTERS.items():
        out = out.when(template.endswith(f":{name}}}"), segment.rlike(f"^{rx}$"))
    return F.coalesce(out, F.lit(False))


def fits(template: Column, path: Column) -> Column:
    """Whether a path matches a normalized template segment by segment; an open converter takes the rest, be it empty, from its segment on."""
    ts, ps = F.split(template, "/"), F.split(path, "/")
    open_ = template.endswith("path}") & template.rlike(r":(?:flask_)?path\}$")
    head = F.when(open_, F.size(ts) - 1).otherwise(F.size(ts))
    long_enough = F.when(open_, F.size(ps) >= F.size(ts)).otherwise(F.size(ps) == F.size(ts))
    first = F.get(ps, F.size(ts) - 1)
    pairs = F.zip_with(F.slice(ts, F.lit(1), head), F.slice(ps, F.lit(1), head), segment_fits)
    return long_enough & F.forall(pairs, lambda x: x) & (~template.endswith(":flask_path}") | (first != ""))


def provider_currency(providers: DataFrame, inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """``complete``: whether every input of a provider's scope still has the recorded digest (a recorded absence stays absent)."""
    s = sources.select("path", F.col("sha256").alias("_now")).dropDuplicates(["path"])
    ok = inputs.join(s, "path", "left").withColumn("_ok", F.col("hash").eqNullSafe(F.col("_now"))).groupBy("scope").agg(F.bool_and("_ok").alias("complete"))
    return providers.join(ok, "scope", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def resolve_routes(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """``consumer, state, matches, route``: exact_key, route_template, ambiguous, unresolved, incomplete or unsupported.

    A route has one key: a literal one its path; a template its number of segments, unless its end is open, and its first segment, unless
    that is a parameter. A consumer looks at the five keys that could match it, in one join on (service, method, key), so that templates are
    tried on few candidates. Routes are normalized once and counted; few of them are broadcast, so that a service with a third of all
    consumers isn't one task.
    """
    segments = lambda c: F.size(F.split(c, "/")).cast("string")
    first = lambda c: F.coalesce(F.get(F.split(c, "/"), F.lit(1)), F.lit(""))
    template = F.col("template")
    open_, free = template.rlike(r":(?:flask_)?path\}$"), first(template).contains("{")
    key = (
        F.when(~template.contains("{"), F.concat(F.lit("="), template))
        .when(~open_ & ~free, F.concat_ws("/", F.lit("n"), segments(template), first(template)))
        .when(~free, F.concat_ws("/", F.lit("o"), first(template)))
        .when(~open_, F.concat_ws("/", F.lit("f"), segments(template)))
        .otherwise("r")
    )
    p = providers.withColumn("template", normalize_template(F.col("route"))).filter("template IS NOT NULL")
    p = hinted(cut(p.select("service", "method", key.alias("_key"), "template", "route", template.contains("{").alias("_is"))))
    path = F.col("path")
    looks = F.array(F.concat(F.lit("="), path), F.concat_ws("/", F.lit("n"), segments(path), first(path)), F.concat_ws("/", F.lit("o"), first(path)), F.concat_ws("/", F.lit("f"), segments(path)), F.lit("r"))
    keys = ["service", "method"]
    c = consumers.filter(path.isNotNull() & F.col("method").isNotNull()).select("consumer", *keys, "path", F.explode(looks).alias("_key"))
    hits = c.join(p, [*keys, "_key"]).filter(~F.col("_is") | fits(template, path)).select("consumer", "route", "_is")
    g = hits.groupBy("consumer").agg(F.count("*").alias("matches"), F.min("route").alias("route"), F.bool_or("_is").alias("_template"))
    broken = providers.filter(~F.col("complete")).select(*keys).distinct().withColumn("_broken", F.lit(True))
    j = consumers.join(g, "consumer", "left").join(broken, keys, "left")
    state = (
        F.when(F.col("path").isNull() | F.col("method").isNull(), "unsupported")
        .when(F.col("_broken"), "incomplete")
        .when(F.coalesce("matches", F.lit(0)) == 0, "unresolved")
        .when(F.col("matches") > 1, "ambiguous")
        .when(F.col("_template"), "route_template")
        .otherwise("exact_key")
    )
    return j.select("consumer", state.alias("state"), F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("route")).alias("route"))


FACT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("method", T.StringType()), T.StructField("path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("unsupported", T.StringType()), T.StructField("more", T.BooleanType())]))


def facts_of(body: str) -> list[tuple]:
    """(role, method, path, line, reason, more) of the route decorators and HTTP calls of a Python file; of one that doesn't parse, none.

    At most ``MOST_FACTS`` in order of place; ``more`` says that the file has others.
    """
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def text(node) -> str | None:
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and (d.func.attr == "route" or d.func.attr in METHODS):
                    path = text(d.args[0]) if d.args else None
                    methods = [d.func.attr] if d.func.attr in METHODS else [m.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple)) for m in k.value.elts if text(m)] or ["GET"]
                    out += [("provide", m.upper(), path, d.lineno, None if path else "computed path") for m in methods]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in METHODS and isinstance(node.func.value, ast.Name) and node.func.value.id in ("requests", "httpx", "client", "session"):
            url = text(node.args[0]) if node.args else None
            out.append(("consume", node.func.attr.upper(), re.sub(r"^https?://[^/]+", "", url) if url else None, node.lineno, None if url else "computed path"))
    out.sort(key=lambda f: f[3])
    return [(*f, len(out) > MOST_FACTS) for f in out[:MOST_FACTS]]


def index_facts(sources: DataFrame, key: str, body: str) -> DataFrame:
    """``key, role, method, path, line, unsupported, more`` of Python sources."""

    @F.pandas_udf(FACT)
    def facts(s: pd.Series) -> pd.Series:
        return s.map(lambda b: facts_of(b) if b else [])

    return sources.select(key, F.explode(facts(F.col(body))).alias("f")).select(key, "f.*")
