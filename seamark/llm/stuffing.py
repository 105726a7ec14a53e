"""Keyword-stuffed and link-list pages (problem 9).

1. A text is cut into blocks, punctuated sentences and all else apart, both in order. Every block is compressed; its ratio is normalised by
   the median of blocks of sentences of like length and language. A block far below it is redundant.
2. A redundant block is junk if its sentence-punctuation density confirms it: it isn't made of sentences. A page most of whose text is
   junk, and less than half of it sentences, is a candidate.
3. What is code or a log in a candidate is no junk, whatever it repeats. Nothing is taken for code before it has been measured.

Addresses, numbers and markup are replaced by one sign before compression, so that a list of links is as redundant as the list of
keywords that it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.worker import resource
from seamark.session import cut

#: Target size of a block in characters and the least words for a measure.
BLOCK_CHARS = 640
#: A sentence ends in its mark, has at least so many words, and at least this share of them is different.
SENTENCE_WORDS = 7
SENTENCE_DISTINCT = 0.8
#: A block is redundant below this share of its usual compression ratio.
REDUNDANT = 0.90
#: The share of a page's text in sentences that refutes the redundancy of the rest.
DENSITY = 0.5
#: Share of the page's text that must be junk.
MOST = 0.5

#: Frequent function words that tell the languages of the corpus apart.
STOP = {
    "en": "the and of to is that it for was with be by this are not or from at which but have an had they you were there been one all we their has would when what so a as if its even never only before after once again more than then how why who can cannot no same still just also into out up our your too about both each every on in do does did will may must should any some such these those he she his her us them",
    "de": "der die und das ist nicht ein eine einen einer den dem des von zu mit sich auf für im in wird sind sie wenn auch als noch nach aus weil sonst wir nur gibt es alle bei jedem jeden jeder dass bevor sollte niemand keiner aber oder an am um so war waren hat haben hier kein keine mehr schon über unter durch ohne",
    "es": "el la los las de que y en un una por con para se del al no es su hay como más sin antes después pues ya lo le nadie debe cada si solo así porque dos todo todos esta este esto son fue era o pero cuando donde muy",
    "fr": "le la les des et en un une du que pour dans est pas qui sur au aux par plus ne se ce il sont avant avec car sinon faut de bout donc chaque si personne doit on y à dont leur son sa ses mais ou où quand cette ces été être",
}


def _rules() -> dict:
    code = (
        r"\s*(?://|/\*|\*/|#!?\[|from\s\S+\simport|func\s*\(|"
        r"if\s.*[:{]\s*$|for\s.*[:{]\s*$|while\s.*[:{]\s*$|else\s*[:{]\s*$|try\b\s*[:{]|except\b.*:\s*$|match\s.*\{|switch\s.*\{|default:|continue;?$|break;?$|pass$|\}|\)|\]|'''|\"\"\")"
        r"|\s*[\w.\[\]]+\s*(?::=|[-+*/|]?=(?![>=]))\s*\S|^\s*[\w.]+\([^)]*\)?[;,]?\s*$|\s*\w+!\(|\s*[\"'][^\"']*[\"']:\s"
    )
    # what code and lists of words have in common: code only by its structure, or beside code
    word = (
        r"\s*(?:import\s|use\s\S+;|package\s\w+$|func\s|(?:pub(?:\(\w+\))?\s+)?(?:fn|struct|enum|impl|trait|mod|const|static|type|use)\s|def\s|class\s\w|async\s|let\s|var\s|return\b|"
        r"else\b|case\s.*:|export\s|private\s|public\s|protected\s|interface\s|raise\s|throw\s)"
        r"|\s+[\w.\"'`]+:?\s.*,\s*$"
    )
    structure = r"\w\(|\)\s*[:;{]|\[\w*\]|[\])}]\s*;?\s*$|=|::|->|^\s*(?:(?:pub|export|private|public|protected|static|abstract|default)\s+)*(?:class|def|struct|enum|impl|trait|interface|mod|type|fn|func)\s[^,;]*[:{]\s*$"
    return {
        "fence": re.compile(r"^\s*(```|~~~)"),
        "code": re.compile(code),
        "word": re.compile(word),
        "sign": re.compile(r"\s*(?:\* |@\w)"),
        "structure": re.compile(structure),
        "link": re.compile(r"!?\[[^\]]*\]\([^)]*\)|<[^>]*>|(?:https?://|www\.)\S+", re.I),
        "log": re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d|\[?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|at \S+\(|Traceback|File \"|\$ |>>> |\+\+\+ |--- |@@ )"),
        "url": re.compile(r"<a\s[^>]*>|</a>|<br\s*/?>|(?:https?://|www\.)[^\s)\]>\"'<]+", re.I),
        "number": re.compile(r"\d+(?:[.,]\d+)*"),
        "ends": re.compile(r"(?<=[.!?])\s+(?=\S)"),
        "known": frozenset(w for k in STOP for w in STOP[k].split()),
        "stop": {w: tuple(k for k in STOP if w in STOP[k].split()) for k in STOP for w in STOP[k].split()},
    }


def _share(raw: str, r: dict) -> float:
    """Compressed size of the masked text by the size of the text as it stands."""
    masked = raw
    if "://" in raw or "<" in raw or "www." in raw:
        masked = r["url"].sub("~", masked)
    masked = r["number"].sub("0", masked).lower().encode("utf-8", "replace")
    c = zlib.compressobj(6, zlib.DEFLATED, -12, 4)
    return (len(c.compress(masked)) + len(c.flush())) / len(raw.encode("utf-8", "replace"))


#: How a line stands: text, code by itself, and code if enough code is beside it.
TEXT, CODE, MAYBE = 0, 1, 2


def code_lines(lines: list[str], r: dict) -> list[bool]:
    """Which of these lines are code; blank and fenced lines between them are left out and end no run.

    A bullet or an ``@word``, a keyword that is a usual word, and a line that ends in ``;``, ``{`` or a comma may stand in text as well. With
    the structure of code, links aside, such a line is code (bullets and ``@`` never are by themselves); within an open block
    comment it is; else a run of such lines is code if the code directly before and after it has as many lines.
    """
    code, word, sign, structure, link, log = r["code"].match, r["word"].match, r["sign"].match, r["structure"].search, r["link"].sub, r["log"].match
    kinds = []
    opened = -1
    for k, line in enumerate(lines):
        # a line that begins with a letter and ends as a sentence does needs no look at the rules for code
        if log(line):
            kind = CODE
        elif (line[-1] in ".!?" and line[0].isalpha()) or "<a " in line:
            kind = TEXT
        elif code(line):
            kind = CODE
        elif sign(line):
            kind = MAYBE
        elif line.rstrip()[-1] in ";{" or word(line):
            kind = CODE if structure(link(" ", line)) else MAYBE
        else:
            kind = TEXT
        kinds.append(kind)
        if kind != TEXT:
            if opened < 0 and line.lstrip().startswith("/*") and "*/" not in line:
                opened = k
            elif opened >= 0 and line.rstrip().endswith("*/"):
                # a comment of short lines that was closed: its lines of signs belong to it
                kinds[opened : k + 1] = [CODE if x == MAYBE and lines[opened + i].lstrip().startswith("*") else x for i, x in enumerate(kinds[opened : k + 1])]
                opened = -1
    runs: list[list[int]] = []
    for k, kind in enumerate(kinds):
        if runs and runs[-1][0] == kind:
            runs[-1][2] = k + 1
        else:
            runs.append([kind, k, k + 1])
    out = [kind == CODE for kind in kinds]
    for i, (kind, a, b) in enumerate(runs):
        if kind == MAYBE:
            beside = sum(y - x for near in (runs[i - 1 : i] if i else [], runs[i + 1 : i + 2]) for other, x, y in near if other == CODE)
            if beside >= b - a:
                out[a:b] = [True] * (b - a)
    return out


def code_chars(text: str) -> int:
    """Characters of the lines of code, logs and fenced text."""
    r = resource("stuffing.rules", _rules)
    n, fenced, lines = 0, False, []
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        if line[0] in "`~ " and r["fence"].match(line):
            fenced = not fenced
            n += len(line)
        elif fenced:
            n += len(line)
        else:
            lines.append(line)
    return n + sum(len(line) for line, is_code in zip(lines, code_lines(lines, r)) if is_code)


def blocks_of(text: str) -> tuple[str, list[tuple[bool, int, float]], int]:
    """The language by its function words, of each block (sentences?, characters, compressed share), and the characters of code.

    Code is looked for only where sentences don't make up half of the text, as no other page can be found. A text without a letter has
    no block.
    """
    r = resource("stuffing.rules", _rules)
    stop, known_words, url, ends = r["stop"], r["known"], r["url"], r["ends"]
    if not any(c.isalpha() for c in text):
        return "none", [], 0
    votes: dict[str, int] = {}
    blocks: list[tuple[bool, int, float]] = []
    streams: tuple[list[str], list[str]] = ([], [])
    sizes, whole = [0, 0], [0, 0]
    heard: list[str] = []
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        for piece in ends.split(line):
            bare = url.sub(" ", piece) if "://" in piece or "<" in piece or "www." in piece else piece
            found = bare.lower().split()
            n = len(found)
            good = 0
            if n:
                found[-1] = found[-1].rstrip(".!?,;:\"')*_`")
                distinct = set(found)
                heard.extend(distinct & known_words)
                if n >= SENTENCE_WORDS and len(distinct) >= SENTENCE_DISTINCT * n:
                    good = int(bare.rstrip(" \t\"')]*_`")[-1:] in (".", "!", "?"))
            streams[good].append(piece)
            sizes[good] += len(piece)
            if sizes[good] >= BLOCK_CHARS:
                blocks.append((good == 1, sizes[good], _share("\n".join(streams[good]), r)))
                streams[good].clear()
                whole[good] += sizes[good]
                sizes[good] = 0
    for k in (0, 1):
        if sizes[k]:
            blocks.append((k == 1, sizes[k], _share("\n".join(streams[k]), r)))
            whole[k] += sizes[k]
    for w, times in Counter(heard).items():
        for k in stop[w]:
            votes[k] = votes.get(k, 0) + times
    lang = max(sorted(votes), key=votes.get) if votes else "none"
    return lang, blocks, code_chars(text) if whole[1] < DENSITY * sum(whole) else 0


BLOCKS = "doc_id long, lang string, sentences boolean, chars long, share double, code long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.int64())
    schema = pa.schema(list(zip(("doc_id", "lang", "sentences", "chars", "share", "code"), types)))
    for b in batches:
        out: list[list] = [[] for _ in types]
        for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lang, blocks, code = blocks_of(text)
            for k, (good, chars, share) in enumerate(blocks):
                for x, v in zip(out, (did, lang, good, chars, share, 0 if k else code)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], schema=schema)


def measure_blocks(documents: DataFrame) -> DataFrame:
    """The blocks of all documents with text: ``doc_id, lang, sentences, chars, share, code``; ``code`` is that of the document, at its first block."""
    d = documents.select("doc_id", "text").filter(F.col("text").rlike(r"\S"))
    return d.mapInArrow(_measure, BLOCKS)


def stuffed_pages(documents: DataFrame, most: float = MOST, redundant: float = REDUNDANT) -> DataFrame:
    """The pages most of whose text is keywords, links, tags or slogans: ``doc_id, lang, chars, redundant_share, junk_share, sentence_share``.

    The usual ratio of a block is the median over all blocks of sentences of its language and length class, or over all languages where
    its own has few. Defined cases: null and blank texts and texts without a letter are never found; a page of code and logs isn't found;
    copies under other ids are all found; a row delivered several times is found once, as repeated blocks weigh alike; extra columns and
    a wrong ``lang`` are ignored.
    """
    blocks = cut(measure_blocks(documents).withColumn("size", F.floor(2 * F.log2(F.greatest("chars", F.lit(16))))))
    prose = blocks.filter("sentences")
    usual = prose.groupBy("lang", "size").agg(F.percentile_approx("share", 0.5, 1000).alias("own"), F.count("*").alias("n")).filter("n >= 20")
    overall = prose.groupBy("size").agg(F.percentile_approx("share", 0.5, 1000).alias("any"))
    # one row per language and length class: five languages by about forty classes at most, whatever the data
    every = blocks.join(F.broadcast(usual.select("lang", "size", "own")), ["lang", "size"], "left").join(F.broadcast(overall), "size", "left")
    flagged = F.col("share") / F.coalesce("own", "any", F.lit(0.6)) < redundant
    of = lambda c: F.sum(F.when(c, F.col("chars")).otherwise(0))
    pages = every.groupBy("doc_id").agg(
        F.first("lang").alias("lang"), F.sum("chars").alias("chars"), of(flagged).alias("redundant"), of(flagged & ~F.col("sentences")).alias("junk"), of(F.col("sentences")).alias("prose"), F.sum("code").alias("code")
    )
    junk = F.least("junk", F.greatest(F.col("chars") - F.col("prose") - F.col("code"), F.lit(0)))
    pages = pages.select("doc_id", "lang", "chars", (F.col("redundant") / F.col("chars")).alias("redundant_share"), (junk / F.col("chars")).alias("junk_share"), (F.col("prose") / F.col("chars")).alias("sentence_share"))
    return pages.filter((F.col("junk_share") >= most) & (F.col("sentence_share") < DENSITY))
