"""From texts to citable documents: units, blocks that tile the text, outlines, imports, calls and cards for embedding.

Python is read with its own parser, Markdown by its headings, languages with braces by ``functions/code``; any other text is tiled by
blocks, as is a source that doesn't parse.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.functions import code

#: Fixed values.
BLOCK, SPLIT_OVER, PART, MOST_PARSED = 2048, 8192, 4096, 1 << 20
MOST_QUALIFIERS, MOST_QNAME = 16, 256
ELIDE_LINES, ELIDE_COMMENT_LINES = 4, 6
#: Tokens of a card and of its heading; bytes that an overview takes from one declaration; the most declarations it takes.
CARD_TOKENS, HEADING_TOKENS = 512, 64
LEAD_BYTES, MOST_LEADS, MOST_TOKEN_BYTES = 256, 128, 16
#: Sixteenths of a text without declarations, in the order in which an overview takes samples of them.
SAMPLES = (0, 8, 4, 12, 2, 6, 10, 14, 1, 3, 5, 7, 9, 11, 13, 15)


def line_starts(body: bytes) -> list[int]:
    out = [0]
    for m in re.finditer(b"\n", body):
        out.append(m.end())
    return out


def blocks(body: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Ranges that tile the text but for white space: paragraphs merged up to a block, longer regions cut into parts at line ends."""
    end = len(body) if end is None else end
    paragraphs, at = [], start
    for m in re.finditer(rb"\n[ \t\r]*(?:\n[ \t\r]*)+", body[start:end]):
        if body[at : start + m.start()].strip():
            paragraphs.append((at, start + m.start() + 1))
        at = start + m.end()
    if body[at:end].strip():
        paragraphs.append((at, end))
    merged: list[tuple[int, int]] = []
    for a, b in paragraphs:
        if merged and b - merged[-1][0] <= BLOCK:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for a, b in merged:
        if b - a <= SPLIT_OVER:
            out.append((a, b))
            continue
        while b - a > PART:
            cut = body.rfind(b"\n", a, a + PART) + 1
            if cut <= a:
                cut = a + PART
                while cut > a and body[cut] & 0xC0 == 0x80:
                    cut -= 1
            out.append((a, cut))
            a = cut
        if body[a:b].strip():
            out.append((a, b))
    return out


def qualified(names: list[str], joint: str = ".") -> str:
    """The last names joined, its front cut at a character where it is too long: the own name is what must stay."""
    whole = joint.join(names[-MOST_QUALIFIERS - 1 :]).encode("utf-8", "replace")
    return whole[_char_floor_up(whole, len(whole) - MOST_QNAME) :].decode() if len(whole) > MOST_QNAME else whole.decode()


def _char_floor_up(body: bytes, at: int) -> int:
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def _python_tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_units(text: str) -> list[tuple[str, str, str, int, int, int, int]] | None:
    """(kind, name, qualified name, start, end, parent, depth) of classes, functions and values of the module; None if it doesn't parse.

    Each node is visited once and handed its parent on the way down.
    """
    tree = _python_tree(text)
    if tree is None:
        return None
    starts = line_starts(text.encode())
    out: list[tuple] = []
    stack: list[tuple[ast.AST, int, list[str]]] = [(tree, -1, [])]
    while stack:
        node, parent, names = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            start, end = starts[first - 1], starts[node.end_lineno - 1] + node.end_col_offset
            kind = "class" if isinstance(node, ast.ClassDef) else ("method" if parent >= 0 and out[parent][0] == "class" else "function")
            names = [*names, node.name]
            out.append((kind, node.name, qualified(names), start, end, parent, len(names) - 1))
            parent = len(out) - 1
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and parent < 0 and node.col_offset == 0:
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name):
                out.append(("static", target.id, target.id, starts[node.lineno - 1], starts[node.end_lineno - 1] + node.end_col_offset, -1, 0))
        stack += [(c, parent, names) for c in reversed(list(ast.iter_child_nodes(node))) if not isinstance(c, ast.expr)]
    return out


def markdown_sections(text: str) -> list[tuple[str, str, str, int, int, int, int]]:
    """Sections by ATX and setext headings outside of fences, nested by level. A setext heading begins with its paragraph.

    Headings within list items, quotes and HTML blocks aren't told apart from those outside.
    """
    body = text.encode()
    heads: list[tuple[int, int, str]] = []
    at, fence = 0, ""
    # the open paragraph: where it began and its lines; None within a list item or a quote, whose text a line of signs doesn't end
    para: tuple[int, list[str]] | None = (0, [])
    for line in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text):
        s = line.strip(" \t\r\n")
        indent = len(line) - len(line.lstrip(" "))
        flat = indent < 4 and not line.startswith("\t")
        m = re.match(r"`{3,}(?=[^`]*$)|~{3,}", s)
        if fence:
            if m and s == m.group() and s.startswith(fence):
                fence = ""
        elif m:
            fence, para = m.group(), (0, [])
        elif h := re.match(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$", s) if flat else None:
            heads.append((at, len(h.group(1)), h.group(2) or ""))
            para = (0, [])
        elif not s:
            para = (0, [])
        elif para and para[1] and flat and re.fullmatch(r"=+|-+", s):
            heads.append((para[0], 1 if s[0] == "=" else 2, " ".join(para[1])))
            para = (0, [])
        elif flat and re.fullmatch(r"(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}", s):
            para = (0, [])
        elif re.match(r"(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)|>", s) and flat:
            para = None
        elif para and (para[1] or flat):
            para = (para[0] if para[1] else at, [*para[1], s])
        at += len(line.encode())
    out: list[tuple] = []
    for i, (start, level, name) in enumerate(heads):
        end = next((h[0] for h in heads[i + 1 :] if h[1] <= level), len(body))
        parent = next((j for j in range(i - 1, -1, -1) if heads[j][1] < level), -1)
        qname = (out[parent][2] + " / " if parent >= 0 else "") + name
        out.append(("section", name, qname, start, end, parent, level - 1))
    return [(k, name, qualified([q], ""), *rest) for k, name, q, *rest in out]


def units_of(path: str, text: str) -> list[tuple] | None:
    """The units of a text, None where it isn't parsed: it is too long, of no known language, or broken."""
    ext = path.rsplit(".", 1)[-1].lower()
    if len(text.encode("utf-8", "replace")) > MOST_PARSED:
        return None
    if ext in ("py", "pyi"):
        return python_units(text)
    if ext in ("md", "markdown"):
        return markdown_sections(text)
    family = code.family_of(path)
    if family is None:
        return None
    at = code.Bytes(text)
    joint = "::" if family in ("rust", "c") else "."
    return [(u.kind, u.name, qualified(u.qname.split(joint), joint), at(u.start), at(u.end), u.parent, u.depth) for u in code.code_units(text, family)]


def parsed_of(path: str, text: str) -> bool | None:
    """Whether a text parses; null where its language has no units. Too long a text isn't parsed and counts as such."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("md", "markdown"):
        return True
    family = code.family_of(path)
    if ext not in ("py", "pyi") and family is None:
        return None
    if len(text.encode("utf-8", "replace")) > MOST_PARSED:
        return False
    return _python_tree(text) is not None if family is None else code.balanced(text, family)


def parsed(path: Column, content: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([parsed_of(p, t) if p is not None and t is not None else None for p, t in zip(paths, texts)], dtype=object)

    return run(path, content)


def documents_of(path: str, text: str) -> list[tuple[str, str | None, str | None, int, int]]:
    """(kind, name, qualified name, start, end): leaf units and the blocks between them; together they tile the text but for white space."""
    return _tiles(text.encode("utf-8", "replace"), units_of(path, text))


def _tiles(body: bytes, units: list[tuple] | None) -> list[tuple[str, str | None, str | None, int, int]]:
    if not units:
        return [("block", None, None, a, b) for a, b in blocks(body)]
    has_child = {u[5] for u in units}
    leaves = [u for i, u in enumerate(units) if i not in has_child]
    out, at = [], 0
    for kind, name, qname, start, end, _, _ in sorted(leaves, key=lambda u: u[3]):
        if start < at:
            continue
        out += [("block", None, None, a, b) for a, b in blocks(body, at, start)]
        parts = blocks(body, start, end) if end - start > SPLIT_OVER else [(start, end)]
        out += [(kind, name if k == 0 else None, qname, a, b) for k, (a, b) in enumerate(parts)]
        at = end
    return out + [("block", None, None, a, b) for a, b in blocks(body, at, len(body))]


def _udf(f: Callable[[str, str], list], schema: str):
    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(schema)))
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([f(p, t) if p is not None and t is not None else [] for p, t in zip(paths, texts)])

    return run


def _exploded(sources: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    return sources.select(*keys, F.explode(_udf(f, schema)(F.col("path"), F.col("content"))).alias("_x")).select(*keys, "_x.*")


def search_documents(sources: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, name, qname, start, end`` of all documents; ``sources`` needs ``path`` and ``content``."""
    return _exploded(sources, keys, documents_of, "kind string, name string, qname string, start long, end long")


def units(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The unit forest: ``keys, ordinal, kind, name, qname, start, end, parent, depth``."""
    f = lambda p, t: [(i, *u) for i, u in enumerate(units_of(p, t) or [])]
    return _exploded(sources, keys, f, "ordinal int, kind string, name string, qname string, start long, end long, parent int, depth int")


def imports_of(path: str, text: str) -> list[tuple[str]]:
    """The names that imports bind: an alias before the name itself, else the last segment; globs bind none."""
    ext = path.rsplit(".", 1)[-1].lower()
    family = code.family_of(path)
    found: list[str] = []
    if ext in ("py", "pyi"):
        tree = _python_tree(text)
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                found += [a.asname or a.name.rsplit(".", 1)[-1] for a in n.names if a.name != "*"]
    elif family is not None:
        found = code.code_imports(text, family)
    return [(x,) for x in dict.fromkeys(found)]


def imports(sources: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, key``: the names a file imports, each once."""
    return _exploded(sources, keys, imports_of, "key string")


def calls_of(path: str, text: str) -> list[tuple[str, int]]:
    """Names called in a file with their counts; in Python through the aliases of its imports."""
    family = code.family_of(path)
    if family is not None:
        return list(code.code_calls(text, family).items())
    tree = _python_tree(text)
    if tree is None:
        return []
    nodes = list(ast.walk(tree))
    alias = {a.asname: a.name for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names if a.asname}
    count: dict[str, int] = {}
    for n in nodes:
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else (n.func.id if isinstance(n.func, ast.Name) else None)
            if name:
                name = alias.get(name, name)
                count[name] = count.get(name, 0) + 1
    return list(count.items())


def calls(sources: DataFrame, keys: list[str]) -> DataFrame:
    known = "|".join(["py", "pyi", *code.FAMILY])
    return _exploded(sources.filter(F.lower("path").rlike(rf"\.({known})$")), keys, calls_of, "name string, calls int")


def outline_of(path: str, text: str) -> str:
    """The text with bodies of at least four lines and comments of at least six elided, each by a marker that names its size."""
    lines = text.split("\n")
    drop: list[tuple[int, int]] = []
    family = code.family_of(path)
    if path.lower().endswith((".py", ".pyi")):
        tree = _python_tree(text)
        for n in ast.walk(tree) if tree else ():
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = n.body[0].lineno
                if n.end_lineno - first + 1 >= ELIDE_LINES:
                    drop.append((first, n.end_lineno))
    elif family is not None:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        for u in code.code_units(text, family):
            if u.body is not None and u.kind in ("fn", "method"):
                # the lines between the one that opens the block and the one that closes it
                first, last = bisect.bisect_right(starts, u.body) + 1, bisect.bisect_right(starts, u.end - 1) - 1
                if last - first + 1 >= ELIDE_LINES:
                    drop.append((first, last))
    run = None
    for i, line in enumerate([*lines, ""], 1):
        comment = line.lstrip().startswith(("#", "//", "--", "*"))
        if comment and run is None:
            run = i
        elif not comment and run is not None:
            if i - run >= ELIDE_COMMENT_LINES:
                drop.append((run, i - 1))
            run = None
    out, at = [], 1
    for a, b in sorted(drop):
        if a < at:
            continue
        out += lines[at - 1 : a - 1]
        pad = re.match(r"\s*", lines[a - 1]).group()
        out.append(f"{pad}… {b - a + 1} lines")
        at = b + 1
    return "\n".join(out + lines[at - 1 :])


def outlines(path: Column, content: Column) -> Column:
    @F.pandas_udf("string")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([outline_of(p, t) if p is not None and t is not None else None for p, t in zip(paths, texts)])

    return run(path, content)


def _char_floor(body: bytes, at: int) -> int:
    while 0 < at < len(body) and body[at] & 0xC0 == 0x80:
        at -= 1
    return at


def fitting(head: str, piece: bytes, most: int) -> int:
    """How many bytes of the start of ``piece`` fit under ``head`` into a card of ``most`` tokens, counted on the card as it is; at least one character."""
    from seamark.functions.tokens import encode, encoder

    piece = piece[: _char_floor(piece, most * MOST_TOKEN_BYTES)]
    if len(encode(head + piece.decode())) <= most:
        return len(piece)
    room = max(1, most - len(encode(head)))
    end = sum(map(len, encoder().decode_tokens_bytes(encode(piece.decode())[:room])))
    while True:
        end = _char_floor(piece, end) or next(k for k in range(1, 5) if k == len(piece) or piece[k] & 0xC0 != 0x80)
        if len(encode(head + piece[:end].decode())) <= most:
            return end
        if end <= 4 and not _char_floor(piece, end - 1):
            raise ValueError("a card has no room for a character of its source")
        end -= max(1, end // 8)


def windows(body: bytes, start: int, end: int, head: str, most: int) -> list[tuple[int, int]]:
    """Ranges that tile [start, end), each as long as its card allows; a line end in the latter half of a range is preferred as its end."""
    from seamark.functions.tokens import encode

    out = []
    while start < end:
        to = start + fitting(head, body[start:end], most)
        line = body.rfind(b"\n", start, to) + 1
        if to < end and line > start and line - start >= (to - start) / 2 and len(encode(head + body[start:line].decode())) <= most:
            to = line
        out.append((start, to))
        start = to
    return out


def _lead(body: bytes, start: int, end: int) -> str:
    """Whole lines of a range within ``LEAD_BYTES``, or the start of a first line that is longer."""
    to = _char_floor(body, min(end, start + LEAD_BYTES))
    line = body.rfind(b"\n", start, to) + 1
    return body[start : line if to < end and line > start else to].decode().rstrip()


def overview(body: bytes, units: list[tuple], start: int, end: int, head: str, most: int) -> str:
    """The card of a whole range: all of it if it fits, else the leads of its declarations, widely spread ones first, or samples where it has none."""
    if end - start <= most * MOST_TOKEN_BYTES and fitting(head, body[start:end], most) == end - start:
        return head + body[start:end].decode()
    inner = sorted({u[3] for u in units if start <= u[3] < end})
    leads: list[str] = []
    if inner:
        if start < inner[0]:
            leads.append(_lead(body, start, inner[0]))
        until = dict(zip(inner, [*inner[1:], end]))
        queue, at = [(0, len(inner))], 0
        while at < len(queue) and len(leads) <= MOST_LEADS:
            lo, hi = queue[at]
            at += 1
            if lo < hi:
                leads.append(_lead(body, inner[lo], until[inner[lo]]))
                mid = lo + 1 + (hi - lo - 1) // 2
                queue += [(mid, hi), (lo + 1, mid)]
    else:
        bound = [_char_floor(body, start + (end - start) * k // 16) for k in range(17)]
        leads = [_lead(body, bound[k], bound[k + 1]) for k in SAMPLES]
    text = "\n".join(x for x in leads if x.strip()).encode()
    return head + text[: fitting(head, text, most)].decode()


def cards_of(address: str, path: str, text: str, most: int) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, card): body cards whose ranges tile the text but for white space, an overview of the file and one of each unit with children."""
    body = text.encode("utf-8", "replace")
    if not body.strip():
        return []
    units = units_of(path, text) or []

    def head(*parts: str | None) -> str:
        whole = "\n".join(x for x in parts if x).encode("utf-8", "replace")
        return whole[: fitting("", whole, min(HEADING_TOKENS, most // 4))].decode() + "\n" if whole else "\n"

    out = []
    for _, _, qname, start, end in _tiles(body, units):
        h = head(qname, address)
        out += [("body", a, b, h + body[a:b].decode()) for a, b in windows(body, start, end, h, most) if body[a:b].strip()]
    out.append(("file", 0, len(body), overview(body, units, 0, len(body), head("file", address), most)))
    for k in sorted({u[5] for u in units if u[5] >= 0}):
        _, _, qname, start, end, _, _ = units[k]
        out.append(("parent", start, end, overview(body, units, start, end, head("parent", qname, address), most)))
    return out


def cards(documents: DataFrame, path: str, qname: str, text: str, function_digest: str, most_tokens: int = CARD_TOKENS) -> DataFrame:
    """All cards: ``card_kind, card_start, card_end, card, input_key``; the key is the identity of exactly this input.

    An address card for each row; of its text body cards, whose byte ranges tile it but for white space, and overviews of the file and
    of each unit with children, which needn't hold all of it. Each of these holds at most ``most_tokens`` tokens with its heading, the
    qualified name and the address. A null or blank text has an address card only.
    """
    from seamark.functions.identity import input_key

    if most_tokens < 32:
        raise ValueError("a card must hold 32 tokens at least")

    @F.pandas_udf("array<struct<card_kind:string,card_start:bigint,card_end:bigint,card:string>>")
    def of_text(addresses: pd.Series, paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([cards_of(a or "", p or "", t, most_tokens) if t is not None else [] for a, p, t in zip(addresses, paths, texts)])

    address = F.concat_ws(" › ", F.concat_ws("/", F.col(path)), F.col(qname))
    own = F.array(F.struct(F.lit("address").alias("card_kind"), F.lit(None).cast("long").alias("card_start"), F.lit(None).cast("long").alias("card_end"), address.alias("card")))
    c = documents.withColumn("_c", F.explode(F.concat(own, of_text(address, F.col(path), F.col(text))))).select("*", "_c.*").drop("_c")
    return c.withColumn("input_key", input_key(F.lit(function_digest), F.col("card")))
