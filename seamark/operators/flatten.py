"""Deeply nested JSON records as related flat tables (problem 4), by shared inlining.

1. ``scan_records`` parses every record once. It gives one row for each object and each array item, with its scalar members, and beside
   them the edges of the element graph: which element sits under which, of what kind, how often and how many under one parent.
2. ``plan_tables`` decides from the graph alone which elements get a table: the root; repeated elements (items of arrays); shared ones
   (the same content under several parents); recursive ones (reachable from themselves). All others are inlined.
3. ``shred`` populates the tables by SQL: rows of inlined elements become columns of the nearest ancestor that has a table, and each row
   of a table carries its own key (``node_path``) and the key of its parent row.

An element is named by its path without array places (``messages[].tool_calls[]``). An object or array below one of the same key closes a
cycle and is the same element. A text that holds JSON can't be told from other texts by any graph: ``decoded`` names those elements. What
comes out of them is any JSON, and so are ``free`` elements; JSON's own grammar is recursive, so that they get a table that refers to itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.worker import resource
from seamark.session import cut

#: Elements whose texts are JSON objects, by the formats of the records.
DECODED = ("messages[].tool_calls[].function.arguments",)
ROOT = "record"
#: Elements share a table if at least this share of the smaller one's members belongs to the other one too.
ALIKE = 0.8
#: An element of more members than this is a map whose keys are data; it is read as free JSON.
MOST_MEMBERS = 1000
#: Labels of elements are broadcast up to so many.
MOST_LABELS = 20_000
SCALARS = ("string", "number", "boolean")
SCAN_SCHEMA = "record_id long, elem string, node_path string, parent_elem string, parent_path string, ord int, kind string, value string, cols map<string,struct<kind:string,value:string>>, times long, most long"
EDGE = "edge:"


class Number(str):
    """A JSON number as it is spelled, of any size."""


def _refuse(name: str):
    raise ValueError(name)


def _decoder() -> json.JSONDecoder:
    return resource("flatten.decoder", lambda: json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse))


def parse(raw: str | None):
    """(True, value), or (False, None) for a text that isn't JSON. Of a repeated key the last value counts."""
    if raw is None:
        return False, None
    try:
        return True, _decoder().decode(raw)
    except (ValueError, RecursionError):
        return False, None


_KINDS = {dict: "object", list: "array", str: "string", Number: "number", bool: "boolean", type(None): "null"}


def decode_arguments(v):
    """An object given as text, as text of a text and so on; anything else gives None."""
    while type(v) is str:
        ok, v = parse(v)
        if not ok:
            return None
    return v if isinstance(v, dict) else None


def _text(v) -> str | None:
    if v is True:
        return "true"
    if v is False:
        return "false"
    return v


def _child(elem: str, key: str) -> str:
    """The element of a structured member; one that has its key already on the path is that earlier element."""
    parts = elem.split(".") if elem else []
    for i, p in enumerate(parts):
        if p.rstrip("[]") == key:
            return ".".join([*parts[:i], key])
    # a member of the root whose key is empty is not the root
    return f"{elem}.{key}" if elem else key or '""'


class _Scan:
    """Rows and edges of one task."""

    def __init__(self, decoded: frozenset[str], free: frozenset[str], below: frozenset[str] | None, values: bool):
        self.decoded, self.free, self.below, self.values = decoded, free, below, values
        self.known: dict[tuple[str, str], str] = {}
        self.members: dict[str, int] = {}
        self.edges: dict[tuple[str, str, str], list[int]] = {}
        self.out: list[list] = [[] for _ in range(8)]
        self.names: list[str] = []
        self.kinds: list[str] = []
        self.texts: list[str | None] = []
        self.offsets = [0]

    def _member(self, elem: str, key: str) -> str:
        """The element of a member that is new to this task; beyond ``MOST_MEMBERS`` they are one, so that keys that are data fill no memory."""
        n = self.members[elem] = self.members.get(elem, 0) + 1
        if n > MOST_MEMBERS:
            return f"{elem}.*"
        child = self.known[elem, key] = _child(elem, key)
        return child

    def _edge(self, parent: str, elem: str, kind: str, most: int) -> None:
        e = self.edges.get((parent, elem, kind))
        if e is None:
            self.edges[parent, elem, kind] = [1, most]
        else:
            e[0] += 1
            if most > e[1]:
                e[1] = most

    def _row(self, rid: int, elem: str, path: str, pelem: str | None, ppath: str | None, ord_: int | None, kind: str, value: str | None) -> None:
        for x, v in zip(self.out, (rid, elem, path, pelem, ppath, ord_, kind, value if self.values else None)):
            x.append(v)
        self.offsets.append(len(self.names))

    def record(self, rid: int, root) -> None:
        known, names, kinds, texts, values = self.known, self.names, self.kinds, self.texts, self.values
        every = self.below is None
        # (element, path, parent element, parent path, place, value, wanted?, within free JSON?)
        stack: list[tuple] = [("", "", None, None, None, root, every, "" in self.free)]
        while stack:
            elem, path, pelem, ppath, ord_, v, keep, free = stack.pop()
            if type(v) is not dict:
                if keep:
                    self._row(rid, elem, path, pelem, ppath, ord_, _KINDS[type(v)], None if type(v) is list else _text(v))
                if type(v) is list:
                    self._items(stack, elem, path, elem, path, v, keep, free)
                continue
            for k, x in v.items():
                kind = _KINDS[type(x)]
                if free:
                    child = elem
                else:
                    child = known.get((elem, k))
                    if child is None:
                        child = self._member(elem, k)
                    if kind == "string" and child in self.decoded:
                        got = decode_arguments(x)
                        if got is not None:
                            kind, x = "encoded", got
                    elif kind == "array" and child in self.decoded:
                        kind = "list"
                    self._edge(elem, child, kind, 1)
                if kind == "object" or kind == "encoded":
                    stack.append((child, f"{path}.{k}" if path else k, elem, path, None, x, keep or (not every and child in self.below), free or child in self.free or child in self.decoded))
                    continue
                if kind == "array":
                    if x:
                        self._items(stack, child, f"{path}.{k}" if path else k, elem, path, x, keep or (not every and child in self.below), free or child in self.free)
                    if keep:
                        names.append(k)
                        kinds.append(kind)
                        texts.append(str(len(x)) if values else None)
                elif keep:
                    names.append(k)
                    kinds.append("array" if kind == "list" else kind)
                    texts.append((json.dumps(x) if kind == "list" else _text(x)) if values else None)
            if keep:
                self._row(rid, elem, path, pelem, ppath, ord_, "object", None)

    def _items(self, stack: list, elem: str, path: str, pelem: str, ppath: str, v: list, keep: bool, free: bool) -> None:
        item = elem if free else f"{elem}[]"
        for i, x in enumerate(v):
            if not free:
                self._edge(pelem, item, _KINDS[type(x)], len(v))
            stack.append((item, f"{path}[{i}]", pelem, ppath, i, x, keep, free))

    def batch(self) -> pa.RecordBatch:
        n = len(self.out[0])
        entry = pa.StructArray.from_arrays([pa.array(self.kinds, pa.string()), _strings(self.texts)], names=["kind", "value"])
        cols = pa.MapArray.from_arrays(pa.array(self.offsets, pa.int32()), _strings(self.names), entry)
        types = (pa.int64(), None, None, None, None, pa.int32(), None, None)
        arrays = [_strings(x) if t is None else pa.array(x, t) for x, t in zip(self.out, types)]
        none = pa.nulls(n, pa.int64())
        for x in (*self.out, self.names, self.kinds, self.texts):
            x.clear()
        self.offsets = [0]
        return pa.RecordBatch.from_arrays([*arrays, cols, none, none], schema=_arrow())

    def edge_batch(self) -> pa.RecordBatch:
        keys, n = list(self.edges), len(self.edges)
        none = pa.nulls(n, pa.string())
        cols = pa.MapArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.string()), pa.StructArray.from_arrays([pa.array([], pa.string())] * 2, names=["kind", "value"]))
        return pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), _strings([k[1] for k in keys]), none, _strings([k[0] for k in keys]), none, pa.nulls(n, pa.int32()), pa.array([EDGE + k[2] for k in keys], pa.string()), none, cols,
            pa.array([self.edges[k][0] for k in keys], pa.int64()), pa.array([self.edges[k][1] for k in keys], pa.int64()),
        ], schema=_arrow())


def _strings(x: list) -> pa.Array:
    try:
        return pa.array(x, pa.string())
    except UnicodeEncodeError:
        # lone surrogates of JSON escapes have no UTF-8
        return pa.array([s if s is None else s.encode("utf-8", "replace").decode() for s in x], pa.string())


def _arrow() -> pa.Schema:
    s, n = pa.string(), pa.int64()
    entry = pa.struct([("kind", s), ("value", s)])
    return pa.schema([("record_id", n), ("elem", s), ("node_path", s), ("parent_elem", s), ("parent_path", s), ("ord", pa.int32()), ("kind", s), ("value", s), ("cols", pa.map_(s, entry)), ("times", n), ("most", n)])


@dataclass
class Scan:
    """What one parse of all records gave: ``rows`` and the element ``graph`` (``parent, element, kind, times, most``)."""

    rows: DataFrame
    graph: DataFrame


def scan_records(records: DataFrame, record_id: str = "record_id", raw: str = "raw", below: tuple[str, ...] | None = None, values: bool = True, once: bool = True, decoded: tuple[str, ...] = DECODED, free: tuple[str, ...] = ()) -> Scan:
    """Rows and element graph of all records from one parse, cut from its lineage.

    With ``below`` only rows of these elements and of what is in them are kept, with ``values`` false only paths and kinds; the graph is
    whole in any case. ``once`` drops records delivered again, for which the texts are shuffled; who makes the outcome distinct can spare
    that.
    """
    d, f, b = frozenset(decoded), frozenset(free), None if below is None else frozenset(below)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(d, f, b, values)
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ok, root = parse(text)
                if ok:
                    scan.record(rid, root)
                    if len(scan.names) + len(scan.offsets) > 20_000:
                        yield scan.batch()
        yield scan.batch()
        yield scan.edge_batch()

    r = records.select(F.col(record_id).cast("long").alias("record_id"), F.col(raw).cast("string").alias("raw")).filter(F.col("raw").isNotNull())
    if once:
        r = r.withColumn("_h", F.xxhash64("raw")).dropDuplicates(["record_id", "_h"]).drop("_h")
    out = cut(r.mapInArrow(per_partition, SCAN_SCHEMA))
    graph = cut(_graph(out))
    # an element with very many members is a map; its keys are no schema
    maps = graph.filter(~F.col("element").endswith("[]")).groupBy("parent").agg(F.count_distinct("element").alias("n")).filter(F.col("n") > MOST_MEMBERS)
    found = [m["parent"] for m in maps.select("parent").orderBy("parent").limit(MOST_MEMBERS).collect()]
    if found:
        return scan_records(records, record_id, raw, below, values, once, decoded, (*free, *found))
    return Scan(out.filter(~F.col("kind").startswith(EDGE)).drop("times", "most"), graph)


def _graph(scan: DataFrame) -> DataFrame:
    """``most`` is the largest number under one parent; kind ``encoded`` is a text that was decoded to an object. Each task sent one row per distinct edge."""
    e = scan.filter(F.col("kind").startswith(EDGE)).select(F.col("parent_elem").alias("parent"), F.col("elem").alias("element"), F.substring("kind", len(EDGE) + 1, 16).alias("kind"), "times", "most")
    return e.groupBy("parent", "element", "kind").agg(F.sum("times").alias("times"), F.max("most").alias("most"))


@dataclass
class Plan:
    """Which elements have a table, and what the graph says of them."""

    tables: dict[str, str] = field(default_factory=dict)
    #: structured elements without a table -> the element whose row takes them in
    owners: dict[str, str] = field(default_factory=dict)
    shared: set[str] = field(default_factory=set)
    recursive: set[str] = field(default_factory=set)

    def of(self, *elements: str) -> list[str]:
        """Tables of these elements and of everything in them."""
        return sorted({t for e, t in self.tables.items() for x in elements if e == x or e.startswith((f"{x}.", f"{x}["))})


def _words(elem: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", elem.rsplit(".", 1)[-1]).lower()) if w]


def plan_tables(graph: DataFrame, decoded: tuple[str, ...] = DECODED) -> Plan:
    """The tables that the element graph asks for. What comes to the driver is the schema's edges, not data.

    Two elements of objects are one shared element if their keys have the same last word and the members of the smaller one belong to
    the other as well (``ALIKE``); none of them may lie within the other.
    """
    edges = [tuple(r) for r in graph.select("parent", "element", "kind", "most").orderBy("parent", "element", "kind").collect()]
    members: dict[str, set[str]] = {}
    structured, repeated = {"": None}, set()
    plan = Plan()
    for parent, elem, kind, _ in edges:
        if elem.endswith("[]"):
            repeated.add(elem)
        else:
            members.setdefault(parent, set()).add(elem[len(parent) :].lstrip(".") if elem.startswith(parent) else elem)
        if kind in ("object", "encoded") or elem.endswith("[]"):
            structured.setdefault(elem, parent)
        # an edge back to what lies above, or to itself, closes a cycle
        if kind in ("object", "array") and elem and (parent == elem or parent.startswith((f"{elem}.", f"{elem}[]"))) and not elem.endswith("[]"):
            plan.recursive.add(elem if elem in structured or kind == "object" else f"{elem}[]")
    plan.recursive |= {d for d in decoded if d in structured}
    by_head: dict[str, list[str]] = {}
    for e in sorted((e for e in structured if e and members.get(e) and e not in decoded), key=lambda x: (-len(members[x]), x)):
        by_head.setdefault((_words(e) or [e])[-1], []).append(e)
    apart = lambda a, b: not a.startswith((f"{b}.", f"{b}[]")) and not b.startswith((f"{a}.", f"{a}[]"))
    groups: list[list[str]] = []
    for like in by_head.values():
        mine: list[list[str]] = []
        for e in like:
            g = next((g for g in mine if any(apart(e, x) and len(members[e] & members[x]) >= ALIKE * len(members[e]) for x in g)), None)
            mine.append([e]) if g is None else g.append(e)
        groups += [sorted(g) for g in mine]
    first = {e: g[0] for g in groups for e in g}
    # of like elements those are shared that sit in different places; under one shared parent they are one member of it
    place = {e: (first.get(structured[e], structured[e]), e[len(structured[e]) :]) for e in structured if e}
    alike = {e: g for g in groups for e in g}
    plan.shared = {e for g in groups if len({place[e] for e in g}) > 1 for e in g}
    kinds = list({id(alike[e]): alike[e] for e in sorted(plan.shared | repeated | plan.recursive) if e in alike}.values()) + [[e] for e in sorted(repeated | plan.recursive) if e not in alike]
    plan.tables[""] = ROOT
    for g in sorted(kinds):
        words = [_words(e) or ["item"] for e in g]
        n = next((i for i in range(min(map(len, words))) if len({w[-1 - i] for w in words}) > 1), min(map(len, words)))
        name = "_".join(words[0][-n:])
        if all(e.endswith("[]") or e in decoded for e in g) and name.endswith("s") and not name.endswith("ss"):
            name = name[:-1]
        if name in plan.tables.values():
            name = "_".join([*(_words(structured.get(g[0]) or "") or [ROOT]), name])
        while name in plan.tables.values():
            name += "_"
        plan.tables |= {e: name for e in g}
    for e in structured:
        if e not in plan.tables:
            up = e
            while up not in plan.tables:
                up = up.rsplit(".", 1)[0] if "." in up else ""
            plan.owners[e] = up
    return plan


def _labels(spark, plan: Plan) -> DataFrame:
    """``elem, table_name, own, more``: the table of an element's rows, whether it is the element's own, and by how much its path exceeds the owner's."""
    rows = [(e, t, True, 0) for e, t in plan.tables.items()] + [(e, plan.tables[o], False, len(e) - len(o)) for e, o in plan.owners.items()]
    out = spark.createDataFrame(rows, "elem string, table_name string, own boolean, more int")
    # as many rows as the schema has elements; they are counted here
    return F.broadcast(out) if len(rows) <= MOST_LABELS else out


def _owner_path(path: Column, more: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - more)


def shred(scan: Scan, plan: Plan, tables: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """All rows of all tables: ``record_id, table_name, node_path, parent_table, parent_path, ord, kind, value, cols``.

    (record_id, node_path) is the key of a row, (record_id, parent_path) that of its parent row in ``parent_table``. The root's path is the
    empty text. ``cols`` holds the scalar members by their path below the row, those of inlined elements too; a member that is an array has
    kind array and its length for a value. Defined cases: null raw, empty text and text that isn't JSON give no row; a JSON scalar or
    array as root gives one row of ``record``; null values stay as columns of kind null; values of another type than usual keep their own
    ``kind``; numbers keep their spelling; a text that should decode and doesn't stays a text; other columns of the input are ignored.
    ``tables`` keeps only the rows of these tables. Only inlined elements are moved: their rows are grouped by record and path, all
    others pass.
    """
    label = _labels(scan.rows.sparkSession, plan)
    n = scan.rows.join(label, "elem")
    if tables is not None:
        n = n.filter(F.col("table_name").isin(list(tables)))
    up = label.select(F.col("elem").alias("parent_elem"), F.col("table_name").alias("parent_table"), F.col("more").alias("_up"))
    own = n.filter("own").join(up, "parent_elem", "left").withColumn("parent_path", _owner_path(F.col("parent_path"), F.col("_up")))
    own = own.select("record_id", "table_name", "node_path", "parent_table", "parent_path", "ord", "kind", "value", "cols")
    prefix = lambda k: F.concat(F.expr("substring(elem, length(elem) - more + 1)"), F.lit("."), k)
    taken = n.filter(~F.col("own")).select("record_id", "table_name", _owner_path(F.col("node_path"), F.col("more")).alias("node_path"), F.transform_keys("cols", lambda k, v: F.ltrim(prefix(k), F.lit("."))).alias("more_cols"))
    taken = taken.groupBy("record_id", "table_name", "node_path").agg(F.flatten(F.collect_list(F.map_entries("more_cols"))).alias("entries"))
    merged = F.when(F.col("entries").isNull(), F.col("cols")).otherwise(F.map_from_entries(F.concat(F.map_entries("cols"), F.col("entries"))))
    return own.join(taken, ["record_id", "table_name", "node_path"], "left").select("record_id", "table_name", "node_path", "parent_table", "parent_path", "ord", "kind", "value", merged.alias("cols"))


def relational(nodes: DataFrame, name: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Rows of ``shred`` with inlined columns: ``columns`` maps output names to inlined paths."""
    t = nodes.filter(F.col("table_name").isin([name] if isinstance(name, str) else list(name)))
    return t.select("record_id", "node_path", "parent_table", "parent_path", "ord", "kind", "value", *(F.col("cols")[p]["value"].alias(c) for c, p in columns.items()))


def scalar_leaves(scan: Scan, plan: Plan) -> DataFrame:
    """The scalar leaves of all tables: ``record_id, table_name, node_path, kind``; narrow, one pass over the scanned rows."""
    n = scan.rows.join(_labels(scan.rows.sparkSession, plan).select("elem", "table_name"), "elem")
    at = F.when(F.col("node_path") == "", "").otherwise(F.concat("node_path", F.lit(".")))
    members = F.transform(F.map_entries("cols"), lambda e: F.struct(F.concat(at, e["key"]).alias("node_path"), e["value"]["kind"].alias("kind")))
    leaf = F.explode(F.concat(F.array(F.struct(F.col("node_path").alias("node_path"), F.col("kind").alias("kind"))), members))
    return n.select("record_id", "table_name", leaf.alias("leaf")).select("record_id", "table_name", "leaf.*").filter(F.col("kind").isin(*SCALARS, "null"))


#: Where the reported token usage sits, by the problem's statement.
USAGE = ("payload.info.total_token_usage", "message.usage")


def found_leaves(records: DataFrame) -> DataFrame:
    """``record_id, node_path`` of each non-null scalar inside call arguments and each number inside the reported token usage."""
    scan = scan_records(records, below=(*DECODED, *USAGE), values=False, once=False)
    plan = plan_tables(scan.graph)
    leaves = scalar_leaves(scan, plan)
    arg = F.col("table_name").isin(plan.of(*DECODED)) & (F.col("kind") != "null")
    in_usage = F.lit(False)
    for u in USAGE:
        in_usage = in_usage | F.col("node_path").startswith(f"{u}.")
    return leaves.filter(arg | (in_usage & (F.col("kind") == "number"))).select("record_id", "node_path").distinct()
