"""Lexers that name only the tokens which delimit functions: blocks, heads of functions, comments, attributes and docstrings.

Each takes the UTF-8 bytes of a body decoded as Latin-1, so that places in it are byte offsets, and gives rows
(kind, start, end, gap, edge, text): ``gap`` is what lies between this token and the one before (0 white space, 1 white space with a blank
line, 2 other text); ``edge`` is, for closing tokens, where the white space after them ends, for others where that before them begins.
"""

from __future__ import annotations

import re

from seamark.functions.worker import resource

OPEN, CLOSE, HEAD, DOC, LEAD, END, DOCSTRING = 1, 2, 3, 4, 5, 6, 7
W = r"[A-Za-z0-9_\x80-\xff]"
NAME = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_TS_NOT_METHOD = frozenset("if for while switch catch return function do else try new typeof await yield throw super import with in of case delete void constructor_ require".split())


def _compile() -> dict:
    dq = r'"(?:[^"\\\n]|\\.)*"?'
    rust = (
        rf"(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<raw>\b(?:b|c)?r(?P<h>\#*)\")|(?P<s>(?:\b[bc])?\"(?:[^\"\\]+|\\.)*+\"?)|(?P<c>(?:\bb)?'(?:\\(?:u\{{[^}}\n]*\}}|x..|.)|[\x00-\x26\x28-\x5b\x5d-\x7f]|[\x80-\xff]{{2,4}})')"
        rf"|(?P<attr>\#!?\[)|(?P<fn>(?<!{W})(?:pub(?:\s*\([^)\n]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"\n]*\")?)\s+)*fn\s+(?P<name>{NAME}))|(?P<b>[{{}}])"
    )
    go = (
        rf"(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<rs>`[^`]*`?)|(?P<s>{dq})|(?P<c>'(?:[^'\\\n]|\\.)+')"
        rf"|(?P<fn>(?<!{W})func\s+(?:\([^()\n]*\)\s*)?(?P<name>{NAME}))|(?P<b>[{{}}])"
    )
    ts = (
        rf"(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<t>`)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<re>/)|(?P<dec>@{NAME}(?:\.{NAME})*(?:\((?:[^()\n]|\([^()\n]*\))*\))?)"
        rf"|(?P<fn>(?<![\w.$])(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<name>{NAME})?)"
        rf"|(?P<arrow>(?:^|(?<=[\n;}}]))(?P<aw>[ \t]*)(?:export\s+)?(?:const|let|var)\s+(?P<aname>[$\w\x80-\xff]+)\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?=\(|<|function\b|[$\w]+\s*=>))"
        rf"|(?P<cls>(?<![\w.$])class\b[^{{\n]*\{{)"
        rf"|(?P<m>(?:(?<=\n)|^)(?P<mw>[ \t]*)(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set|declare)\s+)*[*\#]?(?P<mname>[$\w\x80-\xff]+)\s*\??(?:<[^<>()\n]*>)?\()|(?P<b>[{{}}])"
    )
    head = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`[^`]*`|(?P<o>[(\[])|(?P<k>[)\]])|(?P<b>\{)|(?P<z>\})|(?P<e>;)|(?P<a>=>)"
    py = (
        r"(?P<cm>\#[^\n]*)|(?P<s>(?P<pre>\b[A-Za-z]{1,3})?(?P<q>\"\"\"|'''|\"|'))|(?P<o>[(\[{])|(?P<k>[)\]}])|(?P<bs>\\\r?\n)|(?P<n>\n)"
    )
    return {
        "rust": re.compile(rust, re.S), "go": re.compile(go, re.S), "ts": re.compile(ts, re.S), "head": re.compile(head, re.S), "py": re.compile(py),
        "py_end": {q: re.compile(rf"(?:[^\\{q[0]}]+|\\.|{q[0]}(?!{q[0]}{q[0]}))*+{q}" if len(q) == 3 else rf"(?:[^\\{q}\n]+|\\(?:\r\n|.))*+{q}", re.S) for q in ('"""', "'''", '"', "'")},
        "nest": re.compile(r"/\*|\*/"), "tpl": re.compile(r"[`\\]|\$\{"), "tplx": re.compile(r"`|\{|\}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"),
        "regex": re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"), "ws": re.compile(r"[ \t\r\n\f\v]*"),
        "brackets": re.compile(r"[\[\]]|\"(?:[^\"\\]|\\.)*\"|r\"[^\"]*\""), "def": re.compile(rf"(?:async\s+)?def\s+(?P<name>{NAME})"),
    }


def _template_end(src: str, at: int, r: dict, depth: int = 0) -> int:
    """End of the template literal whose opening sign stands before ``at``."""
    n = len(src)
    while True:
        m = r["tpl"].search(src, at)
        if not m:
            return n
        at = m.end()
        x = m.group()
        if x == "`":
            return at
        if x == "\\":
            at += 1
            continue
        level = 1
        while level:
            m = r["tplx"].search(src, at)
            if not m:
                return n
            at, x = m.end(), m.group()
            if x == "{":
                level += 1
            elif x == "}":
                level -= 1
            elif x == "`":
                at = _template_end(src, at, r, depth + 1) if depth < 200 else n


def _block_end(src: str, at: int, r: dict, nested: bool) -> int:
    if not nested:
        k = src.find("*/", at)
        return len(src) if k < 0 else k + 2
    depth = 1
    for m in r["nest"].finditer(src, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(src)


class _Out:
    """Collects tokens with their gaps."""

    def __init__(self, src: str, ws):
        self.src, self.ws, self.rows, self.last = src, ws, [], 0

    def add(self, kind: int, start: int, end: int, text: str | None = None) -> None:
        src = self.src
        if kind in (CLOSE, END):
            self.rows.append((kind, start, end, 2, self.ws.match(src, end).end(), text))
        else:
            between = src[self.last : start] if start > self.last else ""
            if not between or between.isspace():
                gap, edge = (1 if between.count("\n") > 1 else 0), self.last if start > self.last else start
            else:
                gap, edge = 2, self.last + len(between.rstrip(" \t\r\n\f\v"))
            self.rows.append((kind, start, end, gap, edge, text))
        self.last = end


def _find_body(src: str, at: int, r: dict, lang: str) -> tuple[int, str]:
    """From the end of a head: where its body opens (``{``), or where it ends without one (``;``), or nothing."""
    depth = 0
    n = len(src)
    while True:
        m = r["head"].search(src, at)
        if not m:
            return n, ""
        at = m.end()
        k = m.lastgroup
        if k == "o":
            depth += 1
        elif k == "k":
            depth -= 1
            if depth < 0:
                return m.start(), ""
        elif k == "b":
            if depth == 0:
                before = src[max(0, m.start() - 12) : m.start()].rstrip()
                if lang == "go" and (before.endswith("interface") or before.endswith("struct")):
                    depth += 1
                elif lang == "ts" and before[-1:] in (":", "|", "&", "<", ","):
                    depth += 1
                else:
                    return m.start(), "{"
            else:
                depth += 1
        elif k == "z":
            depth -= 1
            if depth < 0:
                return m.start(), ""
        elif k == "e" and depth == 0:
            return m.start(), ";"


def _arrow_body(src: str, at: int, r: dict) -> tuple[int, str]:
    """From the ``=`` of a declaration: the arrow function's block (``{``), the end of its expression (``;``), or nothing if it's none."""
    if src.startswith("function", at):
        return _find_body(src, at, r, "ts")
    depth, n, arrow = 0, len(src), False
    while True:
        m = r["head"].search(src, at)
        if not m:
            return n, ";" if arrow else ""
        k, at = m.lastgroup, m.end()
        if k in ("o", "b") and not (k == "b" and depth == 0):
            depth += 1
        elif k in ("k", "z"):
            depth -= 1
            if depth < 0:
                return m.start(), ";" if arrow else ""
        elif k == "b":
            if arrow:
                return m.start(), "{" if not src[arrow : m.start()].strip() else ";"
            depth += 1
        elif k == "a" and depth == 0:
            arrow = at
        elif k == "e" and depth == 0:
            return m.start(), ";" if arrow else ""


def lex_braces(src: str, lang: str) -> list[tuple]:
    r = resource("lexing.rules", _compile)
    rx, out = r[lang], _Out(src, r["ws"])
    at, n = 0, len(src)
    depth = 0
    classes: list[int] = []
    search = rx.search
    while True:
        m = search(src, at)
        if not m:
            break
        k, s, at = m.lastgroup, m.start(), m.end()
        if k == "lc":
            text = m.group()
            doc = lang == "go" or (lang == "rust" and text.startswith("///") and not text.startswith("////"))
            out.add(DOC if doc else LEAD, s, at, text if doc else None)
        elif k == "bc":
            at = _block_end(src, at, r, lang == "rust")
            text = src[s:at]
            doc = lang == "go" or (text.startswith("/**") and not text.startswith("/***") and len(text) > 4)
            out.add(DOC if doc else LEAD, s, at, text if doc else None)
        elif k in ("raw", "h"):
            e = src.find('"' + m.group("h"), at)
            at = n if e < 0 else e + 1 + len(m.group("h"))
        elif k == "t":
            at = _template_end(src, at, r)
        elif k == "re":
            j = s - 1
            while j >= 0 and src[j] in " \t":
                j -= 1
            if j < 0 or src[j] in "=(,:;!&|?{}[+-*%<>~^\n" or src[max(0, j - 5) : j + 1] == "return":
                x = r["regex"].match(src, s)
                at = x.end() if x else at
        elif k == "attr":
            level = 1
            for x in r["brackets"].finditer(src, at):
                g = x.group()
                level += (g == "[") - (g == "]")
                if not level:
                    at = x.end()
                    break
            text = src[s:at]
            doc = re.match(r"#\[\s*doc\s*=", text)
            out.add(DOC if doc else LEAD, s, at, text if doc else None)
        elif k == "dec":
            out.add(LEAD, s, at)
        elif k in ("fn", "name"):
            body, how = _find_body(src, at, r, lang)
            if how == "{":
                out.add(HEAD, s, at, m.group("name"))
                at = body
            elif how == ";":
                out.add(HEAD, s, at, m.group("name"))
                out.add(END, body, body + 1)
                at = body + 1
        elif k in ("arrow", "aname", "aw"):
            body, how = _arrow_body(src, at, r)
            if how:
                out.add(HEAD, s + len(m.group("aw")), at, m.group("aname"))
                if how == "{":
                    at = body
                    classes.append(-depth - 2)  # an arrow's block may end in a semicolon that belongs to it
                else:
                    e = src.find(";", at) if body >= n else body
                    e = body if e < 0 else max(e, at)
                    out.add(END, e, min(n, e + 1))
                    at = min(n, e + 1)
        elif k == "cls":
            depth += 1
            classes.append(depth)
            out.add(OPEN, at - 1, at)
        elif k in ("m", "mname", "mw"):
            name = m.group("mname")
            if classes and classes[-1] == depth and name not in _TS_NOT_METHOD:
                body, how = _find_body(src, at - 1, r, lang)
                if how:
                    out.add(HEAD, s + len(m.group("mw")), at, name)
                    if how == "{":
                        at = body
                    else:
                        out.add(END, body, body + 1)
                        at = body + 1
                    continue
        elif k == "b":
            if src[s] == "{":
                depth += 1
                out.add(OPEN, s, at)
            else:
                depth = max(0, depth - 1)
                if classes and classes[-1] == depth + 1:
                    classes.pop()
                if classes and classes[-1] == -depth - 2:
                    classes.pop()
                    x = r["ws"].match(src, at).end()
                    if src[x : x + 1] == ";" and "\n" not in src[at:x]:
                        at = x + 1
                out.add(CLOSE, s, at)
    return out.rows


def lex_python(src: str) -> list[tuple]:
    """Logical lines become blocks by their indentation; a block ends after its last line, trailing deeper comments included."""
    r = resource("lexing.rules", _compile)
    out = _Out(src, r["ws"])
    rx, define, ends = r["py"], r["def"], r["py_end"]
    stack = [0]
    n, at = len(src), 0
    pending = None  # a head that waits for its block: (indent)
    expect_doc = False
    last_end = 0  # end of the last line that belongs to the innermost block
    comments: list[tuple[int, int, int]] = []

    def indent_of(s: int) -> int:
        col, i = 0, s
        while i < n and src[i] in " \t\f":
            col = (col // 8 + 1) * 8 if src[i] == "\t" else (0 if src[i] == "\f" else col + 1)
            i += 1
        return col

    while at < n:
        # one logical line
        ind, s = indent_of(at), r["ws"].match(src, at).end()
        nl = src.find("\n", at)
        nl = n if nl < 0 else nl
        if s > nl or s >= n:
            at = nl + 1
            continue
        first = src[s]
        if first == "#":
            e = len(src[s:nl].rstrip()) + s
            comments.append((ind, s, e))
            at = nl + 1
            continue
        # close blocks before this line; comments deeper than it still belong to the block they stand in
        while len(stack) > 1 and ind < stack[-1]:
            while comments and comments[0][0] >= stack[-1]:
                last_end = comments.pop(0)[2]
            stack.pop()
            out.add(CLOSE, last_end, last_end)
        opened = False
        if pending is not None:
            if ind > pending:
                stack.append(ind)
                opened = True
                # comments at the top of a block lead its first statement as any others do
                for _, _, ce in comments:
                    last_end = ce
            else:
                out.add(CLOSE, last_end, last_end)
            pending = None
        for _, cs, ce in comments:
            out.add(LEAD, cs, ce)
        comments.clear()
        # walk to the end of the logical line
        depth, pos, end, colon = 0, s, n, False
        string_only: list[tuple[str, int, int]] = []
        cursor = s
        only = True
        bad = False
        while True:
            m = rx.search(src, pos)
            if not m:
                end, pos = n, n
                only = only and not src[cursor:n].strip()
                break
            k, pos = m.lastgroup, m.end()
            if k in ("s", "q", "pre"):
                q = m.group("q")
                pre = m.group("pre") or ""
                start = m.start()
                if pre and pre.lower() not in ("r", "u", "b", "f", "br", "rb", "fr", "rf", "t", "rt", "tr"):
                    start = m.start("q")
                    pre = ""
                if only and src[cursor:start].strip(" \t\\\r\n()"):
                    only = False
                x = ends[q].match(src, m.end("q"))
                if not x:
                    # an unclosed string: the rest of the line, or of the file
                    pos = n if len(q) == 3 else (src.find("\n", m.end("q")) if src.find("\n", m.end("q")) >= 0 else n)
                    bad = True
                else:
                    pos = x.end()
                if only:
                    string_only.append((pre.lower(), m.end("q"), pos - len(q)))
                    cursor = pos
            elif k == "n":
                if depth <= 0:
                    end = m.start()
                    only = only and not src[cursor:end].strip(" \t\\\r\n();")
                    break
            elif k == "cm":
                if depth <= 0:
                    end = m.start()
                    only = only and not src[cursor:end].strip(" \t\\\r\n();")
                    nn = src.find("\n", m.end())
                    pos = n if nn < 0 else nn + 1
                    break
            elif k == "o":
                depth += 1
            elif k == "k":
                depth -= 1
        at = pos if pos > at else at + 1
        stop = s + len(src[s:end].rstrip())
        text_end = s + len(src[s : at].rstrip()) if at <= n else stop
        head = define.match(src, s)
        if expect_doc and opened and only and string_only and not any("b" in p or "f" in p or "t" in p for p, _, _ in string_only):
            out.add(DOCSTRING, s, stop, "".join(src[a:b] for _, a, b in string_only))
        expect_doc = False
        last_end = max(stop, text_end) if not bad else stop
        code = src[s:stop]
        if first == "@":
            out.add(LEAD, s, stop)
            continue
        block = code.endswith(":")
        if head:
            out.add(HEAD, s, head.end(), head.group("name"))
            if block:
                out.add(OPEN, stop - 1, stop)
                pending, expect_doc = ind, True
            else:
                out.add(OPEN, stop, stop)
                one = re.search(r":\s*[rRuU]?(\"\"\"|'''|\"|')(.*)\1\s*;?[^\"']*$", code, re.S)
                if one:
                    out.add(DOCSTRING, s, stop, one.group(2))
                out.add(CLOSE, stop, stop)
        elif block:
            out.add(OPEN, stop - 1, stop)
            pending = ind
    if pending is not None:
        out.add(CLOSE, last_end, last_end)
    while len(stack) > 1:
        while comments and comments[0][0] >= stack[-1]:
            last_end = comments.pop(0)[2]
        stack.pop()
        out.add(CLOSE, last_end, last_end)
    return out.rows


def lex(body: str, lang: str) -> list[tuple]:
    src = body.encode("utf-8", "replace").decode("latin-1")
    rows = lex_python(src) if lang == "python" else lex_braces(src, lang)
    return [(k, s, e, g, x, None if t is None else t.encode("latin-1").decode("utf-8", "replace")) for k, s, e, g, x, t in rows]
