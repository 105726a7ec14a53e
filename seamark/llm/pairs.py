"""Functions paired with their documentation (problem 1).

Bodies are lexed once, where they are scanned; the tokens are exploded into rows and everything else is SQL over them: a running sum
gives the depth of the blocks, a second one numbers the islands of comments and attributes that lie directly above a head, windows over
(body, depth) end each function at the close of its own block, and lag windows attach the comments. Units are matched to functions on
one sorted line of places per body, so that no pairs of units and functions are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.llm.lexing import CLOSE, DOC, DOCSTRING, END, HEAD, LEAD, OPEN, lex
from seamark.session import cut

#: Languages that are lexed, by extension.
LANGS = {"py": "python", "pyi": "python", "rs": "rust", "ts": "ts", "tsx": "ts", "go": "go"}

#: Words that say nothing about what a function does, whatever its name.
GENERAL = (
    "a an the this that these those it its is are was be been to of for in on at by with from and or as which what who how can will shall may must should does do did done used use uses using "
    "function functions method methods func fn def routine procedure helper helpers utility util utils internal private public simple generic wrapper stub implementation impl code here "
    "str int float bool boolean dict tuple void usize vec "
    "todo fixme xxx tbd hack note wip n na placeholder place holder description describe describes desc summary write add insert fill short long brief goes go please docstring docstrings documentation document documented docs doc text your my our "
    "lorem ipsum dolor sit amet same above below see ditto self explanatory obvious trivial none nothing empty missing pending later real proper someone something anything some auto autogenerated generated automatically hidden deprecated "
    "beschreibung folgt fehlt hier diese dieser funktion methode wurde automatisch erzeugt bitte nicht ändern hilfsfunktion siehe oben descripción descripcion pendiente función funcion método metodo aquí ayuda auxiliar fonction méthode à compléter ici voir dessus"
)
#: Notices of licences, generators and tools; a sentence with one of them is no documentation.
NOTICE = (
    r"(?iu)copyright|\(c\)\s*\d|©|all rights reserved|licen[cs]ed? under|\blicen[cs]e\b|spdx|apache-2|auto-?generated|(?:was|is|were|code) generated|generated (?:by|from|with|and)|do not (?:edit|modify)|"
    r"not be edited|automatisch (?:erzeugt|generiert)|generado automáticamente|généré automatiquement|\bnoqa\b|\bnolint\b|pragma:|eslint|tslint|prettier-|pylint|mypy:|type:\s*ignore|@ts-|rustfmt|clippy|fmt:\s*(?:off|on|skip)|\bgo:[a-z]+|\+build|istanbul"
)


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = pa.struct([("k", pa.int8()), ("s", pa.int32()), ("e", pa.int32()), ("g", pa.int8()), ("x", pa.int32()), ("t", pa.string())])
    names = ("k", "s", "e", "g", "x", "t")
    types = (pa.int8(), pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.string())
    schema = pa.schema([("source_id", pa.int64()), ("source_hash", pa.string()), ("lang", pa.string()), ("tokens", pa.list_(token))])
    for b in batches:
        sid, hashes, langs, bodies = (c.to_pylist() for c in b.columns)
        flat: list[tuple] = []
        offsets = [0]
        for body, lang in zip(bodies, langs):
            rows = lex(body, lang)
            # a body without a head has no function
            if any(r[0] == HEAD for r in rows):
                flat.extend(rows)
            offsets.append(len(flat))
        cols = list(zip(*flat)) if flat else [[] for _ in names]
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))
        yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(hashes, pa.string()), pa.array(langs, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], schema=schema)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])[ext]


def token_rows(sources: DataFrame) -> DataFrame:
    """``source_id, source_hash, lang, i, k, s, e, g, x, t``: the delimiting tokens of each body as rows, all of a body in one partition."""
    s = sources.select("source_id", "source_hash", language(F.col("path")).alias("lang"), "body").filter(F.col("body").isNotNull() & F.col("lang").isNotNull())
    lexed = s.select("source_id", "source_hash", "lang", "body").mapInArrow(_lexed, "source_id long, source_hash string, lang string, tokens array<struct<k:tinyint,s:int,e:int,g:tinyint,x:int,t:string>>")
    lexed = lexed.filter(F.size("tokens") > 0).repartition("source_id")
    # a row delivered several times is lexed as often and kept once
    once = lexed.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("source_hash"))).filter("n = 1")
    return once.select("source_id", "source_hash", "lang", F.posexplode("tokens").alias("i", "tok")).select("source_id", "source_hash", "lang", "i", "tok.*")


def _doc_text(lang: Column, t: Column) -> Column:
    """A comment or attribute without its marks."""
    attr = F.regexp_replace(t, r'(?s)^#\[\s*doc\s*=\s*r?#*"(.*)"#*\s*\]$', "$1")
    lines = F.regexp_replace(t, r"(?m)^[ \t]*(?:///?|/\*\*?|\*(?!/))", "")
    return F.when(t.startswith("#["), attr).otherwise(F.regexp_replace(lines, r"\*+/\s*$", ""))


def function_rows(tokens: DataFrame) -> DataFrame:
    """One row per function or method: ``source_id, source_hash, lang, name, lead, head, end, tail, doc``.

    The function may begin anywhere from ``lead`` (the white space before its comments and attributes) to ``head`` and ends from ``end`` to
    ``tail`` (the white space behind it).
    """
    body = W.partitionBy("source_id").orderBy("i")
    is_lead = F.col("k").isin(DOC, LEAD)
    t = tokens.withColumn("depth", F.sum(F.when(F.col("k") == OPEN, 1).when(F.col("k") == CLOSE, -1).otherwise(0)).over(body))
    apart = (F.col("g") > 0) & ((F.col("g") == 2) | (F.col("lang") == "go"))
    t = t.withColumn("new", F.when(apart | ~F.coalesce(F.lag(is_lead).over(body), F.lit(False)), 1).otherwise(0))
    t = t.withColumn("island", F.sum("new").over(body))
    t = t.withColumn("level", F.when(F.col("k") == OPEN, F.col("depth") - 1).when((F.col("k") == DOCSTRING), F.col("depth") - 1).otherwise(F.col("depth")))
    t = t.filter(is_lead | F.col("k").isin(HEAD, CLOSE, END, DOCSTRING))
    isle = W.partitionBy("source_id", "island").orderBy("i")
    t = t.withColumn("lead", F.first("x").over(isle))
    t = t.withColumn("docs", F.collect_list(F.when(F.col("k") == DOC, F.col("t"))).over(isle))
    t = t.filter(F.col("k").isin(HEAD, CLOSE, END, DOCSTRING))
    line = W.partitionBy("source_id", "level").orderBy("i")
    k1, k2 = F.lead("k", 1).over(line), F.lead("k", 2).over(line)
    t = t.withColumn("k1", k1).withColumn("k2", k2)
    for c in ("e", "x", "t"):
        t = t.withColumn(f"{c}1", F.lead(c, 1).over(line)).withColumn(f"{c}2", F.lead(c, 2).over(line))
    has_string = F.col("k1") == DOCSTRING
    closed = F.when(has_string, F.col("k2")).otherwise(F.col("k1")).isin(CLOSE, END)
    own = F.when(F.col("lang") == "python", F.when(has_string, F.array("t1"))).when(F.col("lang") == "ts", F.slice("docs", -1, 1)).otherwise(F.col("docs"))
    text = F.array_join(F.transform(own, lambda d: F.when(F.col("lang") == "python", d).otherwise(_doc_text(F.col("lang"), d))), "\n")
    own_text = F.when(F.col("lang") == "ts", F.when(F.size("docs") > 0, text)).otherwise(text)
    return t.filter((F.col("k") == HEAD) & closed).select(
        "source_id", "source_hash", "lang", F.col("t").alias("name"), "lead", F.col("s").alias("head"),
        F.when(has_string, F.col("e2")).otherwise(F.col("e1")).alias("end"), F.when(has_string, F.col("x2")).otherwise(F.col("x1")).alias("tail"), own_text.alias("doc"),
    )


def substance(doc: Column) -> Column:
    """The documentation without tags, parameter lists, headings, marks, notices and to-do sentences."""
    c = F.regexp_replace(doc, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?is)```.*?```|~~~.*?~~~", " ")
    c = F.regexp_replace(c, r"\{@\w+[^}]*\}", " ")
    # tags with what they name: a parameter, a type
    c = F.regexp_replace(c, r"(?Uim)^\s*[@:](?:param|arg|argument|type|rtype|return|returns|raises?|throws|exception|var|ivar|see|since|version|author|template|typeparam)\b:?(?:[ \t]*\{[^}]*\})?(?:[ \t]*\[?[\w.$]+\]?)?[ \t]*:?[ \t]*[-–]?(?:[ \t]*\w+)?[ \t]*$", " ")
    c = F.regexp_replace(c, r"(?Uim)^\s*@\w+[ \t]*$", " ")
    # headings of sections
    c = F.regexp_replace(c, r"(?im)^\s*#*\s*(?:args|arguments|params?|parameters|returns?|yields|raises|panics|errors|safety|examples?|notes?|see also|attributes|throws|usage)\s*:?\s*$", " ")
    # lines that only name a parameter and its type
    c = F.regexp_replace(c, r"(?Uim)^\s*(?:[-*+]\s*)?`?\*{0,2}[\w.$]+`?(?:\s*\([^)]*\))?\s*(?::\s*\S*)?\s*$", " ")
    c = F.regexp_replace(c, r"(?m)^[\s\-=~*_#+.|/\\<>]+$", " ")
    # sentences of notices and of work to do
    c = F.array_join(F.filter(F.split(c, r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:go:|nolint|noqa))"), lambda s: ~s.rlike(NOTICE) & ~s.rlike(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd)\b")), " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def says_something(doc: Column, name: Column) -> Column:
    """Whether at least two words remain that are neither general nor those of the function's own name."""
    words = F.filter(F.split(F.lower(F.regexp_replace(substance(doc), r"(?<=[a-z0-9])(?=[A-Z])", " ")), r"(?U)[^\w]+|_+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))
    general = F.array(*[F.lit(w) for w in sorted(set(GENERAL.split()))])
    left = F.array_except(words, general)
    split = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2"))
    own = F.filter(F.split(split, "_+"), lambda w: F.length(w) > 0)
    stem = lambda w: F.regexp_replace(w, r"(?:ing|ed|es|s|e|y|ies)$", "")
    left = F.filter(left, lambda w: ~F.exists(own, lambda o: (w == o) | ((F.length(stem(w)) >= 2) & (stem(w) == stem(o)))))
    return F.coalesce(F.size(left) >= 2, F.lit(False))


def documented_units(sources: DataFrame, units: DataFrame) -> DataFrame:
    """The units that are exactly one function or method with telling documentation: ``unit_id, source_id, lang, name, start_byte, end_byte, doc``.

    Defined cases: units of another body (other ``source_hash``), with null places or of sources without a body give nothing; surrounding
    white space doesn't matter; a unit delivered several times is one; ``kind`` is not used; a file that doesn't parse gives the functions
    whose blocks still close; empty tables give no rows; extra columns are ignored.
    """
    found = function_rows(token_rows(sources)).filter(says_something(F.col("doc"), F.col("name")))
    f = found.groupBy("source_id", "source_hash", "end").agg(F.collect_list(F.struct("lang", "name", "lead", "head", "tail", "doc")).alias("fs"))
    u = units.filter(F.col("unit_id").isNotNull() & F.col("start_byte").isNotNull() & F.col("end_byte").isNotNull()).select("unit_id", "source_id", "source_hash", "start_byte", "end_byte")
    none = F.lit(None)
    both = f.select("source_id", "source_hash", F.col("end").cast("long").alias("at"), F.lit(0).alias("o"), "fs", none.cast("long").alias("unit_id"), none.cast("long").alias("start_byte")).unionByName(
        u.select("source_id", "source_hash", F.col("end_byte").alias("at"), F.lit(1).alias("o"), F.lit(None).cast(f.schema["fs"].dataType).alias("fs"), "unit_id", "start_byte")
    )
    line = W.partitionBy("source_id", "source_hash").orderBy("at", "o").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("near", F.last("fs", ignorenulls=True).over(line)).filter(F.col("unit_id").isNotNull() & F.col("near").isNotNull())
    hit = F.filter("near", lambda x: (F.col("at") <= x["tail"]) & (F.col("start_byte") >= x["lead"]) & (F.col("start_byte") <= x["head"]))
    out = near.withColumn("hit", hit).filter(F.size("hit") > 0).withColumn("h", F.col("hit")[0])
    out = out.select("unit_id", "source_id", "source_hash", F.col("h.lang").alias("lang"), F.col("h.name").alias("name"), "start_byte", F.col("at").alias("end_byte"), F.col("h.doc").alias("doc"))
    return out.dropDuplicates(["unit_id", "source_id", "start_byte", "end_byte"])


def code_pairs(sources: DataFrame, units: DataFrame) -> DataFrame:
    """``unit_id, source_id, lang, name, code, description``: the span cut from its body beside what documents it."""
    # written once, narrow as it is: bodies are lexed once, and only those with a hit are moved
    hit = cut(documented_units(sources, units))
    bodies = sources.filter(F.col("body").isNotNull()).select("source_id", "source_hash", "body").join(hit.select("source_id").distinct(), "source_id", "left_semi").dropDuplicates(["source_id"])
    code = F.expr("decode(substring(encode(body, 'UTF-8'), cast(start_byte + 1 as int), cast(end_byte - start_byte as int)), 'UTF-8')")
    return hit.join(bodies.select("source_id", "body"), "source_id").select("unit_id", "source_id", "lang", "name", code.alias("code"), F.trim("doc").alias("description"))
