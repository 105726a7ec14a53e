"""Python 3: indentation-aware tokens, statements by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re

from seamark.functions.worker import resource
from seamark.llm.grammar.base import Panic, Parser

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
#: Binding powers of binary operators.
BIN = {
    "or": 1, "and": 2, "in": 4, "not in": 4, "is": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4,
    "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "@": 10, "/": 10, "//": 10, "%": 10, "**": 12,
}
AUG = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
CLOSES = {")": "(", "]": "[", "}": "{"}


def _rx() -> dict:
    s3 = lambda q: rf"{q * 3}(?:[^\\{q}]+|\\.|{q}(?!{q}{q}))*+{q * 3}"
    s1 = lambda q: rf"{q}(?:[^\\{q}\n\r]+|\\(?:\r\n|.))*+{q}"
    digits = r"\d(?:_?\d)*"
    return {
        "tok": re.compile(
            rf"(?P<w>[ \t\f]+|\\\r?\n)|(?P<c>\#[^\n\r]*)|(?P<NL>\r\n|\n|\r)"
            rf"|(?P<STR>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:{s3(chr(34))}|{s3(chr(39))}|{s1(chr(34))}(?!{chr(34)})|{s1(chr(39))}(?!{chr(39)})|\"\"|''))"
            rf"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:{digits}\.(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?[jJ]?|{digits}[eE][+-]?{digits}[jJ]?|0(?:_?0)*[jJ]?(?!\d)|[1-9](?:_?\d)*[jJ]?|{digits}[jJ])(?!\w)|\d(?:\w|(?<=[eE])[+-])*)"
            r"|(?P<ID>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{}:;,.=!])|(?P<BAD>.)", re.S),
        "num": re.compile(rf"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:{digits}\.(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?|{digits}[eE][+-]?{digits})[jJ]?|0(?:_?0)*|[1-9](?:_?\d)*|{digits}[jJ]"),
        "fexpr": {},
    }


def tokenize(src: str) -> tuple[list[str], list[str], list[int]]:
    rx = resource("grammar.python", _rx)
    t: list[str] = []
    v: list[str] = []
    at: list[int] = []
    stack = [(0, 0)]
    brackets: list[tuple[str, int]] = []
    line_start = True
    num = rx["num"]
    if src.startswith("\ufeff"):
        src = src[1:]

    def add(a: str, b: str, p: int) -> None:
        t.append(a)
        v.append(b)
        at.append(p)

    pos = 0
    it = rx["tok"].finditer(src)
    margin = ""
    while (m := next(it, None)) is not None:
        k = m.lastgroup
        x = m.group()
        if k == "w":
            if line_start and x[0] != "\\":
                margin = x
            continue
        if k == "c":
            continue
        pos = m.start()
        if k == "NL":
            if not line_start and not brackets:
                add("NL", "", pos)
            if not brackets:
                line_start, margin = True, ""
            continue
        if line_start:
            line_start = False
            if not brackets:
                if margin:
                    margin = margin[margin.rfind("\f") + 1 :]
                    if "\t" in margin:
                        col = alt = 0
                        for ch in margin:
                            if ch == "\t":
                                col, alt = (col // 8 + 1) * 8, alt + 1
                            else:
                                col, alt = col + 1, alt + 1
                    else:
                        col = alt = len(margin)
                else:
                    col = alt = 0
                top = stack[-1]
                if col == top[0]:
                    if alt != top[1]:
                        add("BAD", "inconsistent use of tabs and spaces", pos)
                elif col > top[0]:
                    if alt <= top[1]:
                        add("BAD", "inconsistent use of tabs and spaces", pos)
                    stack.append((col, alt))
                    add("IN", "", pos)
                else:
                    while stack[-1][0] > col:
                        stack.pop()
                        add("DE", "", pos)
                    if stack[-1][0] != col:
                        add("BAD", "unindent matches no outer level", pos)
                    elif stack[-1][1] != alt:
                        add("BAD", "inconsistent use of tabs and spaces", pos)
        if k == "ID":
            if len(x) < 3 and x.lower() in ("f", "rf", "fr") and src[m.end() : m.end() + 1] in ("'", '"') and m.end() < len(src):
                # no string by the pattern, but a field may go over lines
                end = _string_end(src, m.end(), True)
                if end > 0:
                    add("STR", src[pos:end], pos)
                    it = rx["tok"].finditer(src, end)
                    continue
            add(x if x in KEYWORDS else "ID", x, pos)
        elif k == "op":
            if x in "([{":
                brackets.append((x, pos))
            elif x in CLOSES:
                if not brackets:
                    add("BAD", f"unmatched {x!r}", pos)
                    continue
                if brackets[-1][0] != CLOSES[x]:
                    add("BAD", f"{x!r} does not close {brackets[-1][0]!r}", pos)
                brackets.pop()
            add(x, x, pos)
        elif k == "NUM":
            if num.fullmatch(x):
                add("NUM", x, pos)
            else:
                # 1if and the like: a number directly before a keyword
                y = re.match(r"(?:0[xX][0-9a-fA-F_]+|[\d_.]+)(?=(?:and|else|for|if|in|is|or|not)\b)", x)
                if y and num.fullmatch(y.group()):
                    add("NUM", y.group(), pos)
                    add(x[y.end() :], x[y.end() :], pos + y.end())
                else:
                    add("BAD", f"invalid number {x[:20]!r}", pos)
        elif k == "STR":
            if "{" in x and x.count("{") != x.count("}") and "f" in x[:2].lower():
                # a field may hold the string's own quote
                end = _string_end(src, pos + re.search("[\"']", x).start(), True)
                if end > m.end():
                    x = src[pos:end]
                    it = rx["tok"].finditer(src, end)
            add("STR", x, pos)
        else:
            add("BAD", "unterminated string" if x in "\"'" else f"stray {x!r}", pos)
            if x in "\"'":
                # nothing behind it can be trusted: the rest of the line goes, or of the file
                pass
    if brackets:
        add("BAD", f"{brackets[-1][0]!r} was never closed", brackets[-1][1])
    if not line_start:
        add("NL", "", len(src))
    for _ in stack[1:]:
        add("DE", "", len(src))
    add("EOF", "", len(src))
    return t, v, at


def _string_end(text: str, at: int, fields: bool) -> int:
    """The place behind the string whose quote is at ``at``, -1 if it has no end; ``fields`` if braces hold expressions."""
    quote = text[at] * 3 if text.startswith(text[at] * 3, at) else text[at]
    i, n = at + len(quote), len(text)
    while i < n:
        c = text[i]
        if c == quote[0] and text.startswith(quote, i):
            return i + len(quote)
        if c == "\\" or (fields and text.startswith("{{", i)):
            i += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        elif fields and c == "{":
            i = _field_end(text, i)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _quoted(text: str, at: int) -> int:
    """The same for a quote within an expression, whose letters before it say what it is."""
    return _string_end(text, at, "f" in re.search(r"[A-Za-z]{0,2}$", text[max(0, at - 2) : at]).group().lower())


def _field_end(text: str, at: int) -> int:
    """The place behind the replacement field that begins at ``at``, -1 if it has no end."""
    depth, j, n = 0, at + 1, len(text)
    while j < n:
        c = text[j]
        if c in "\"'":
            j = _quoted(text, j)
            if j < 0:
                return -1
            continue
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                return j + 1 if c == "}" else -1
            depth -= 1
        elif c == ":" and depth == 0 and not text.startswith(":=", j):
            j += 1
            while j < n and text[j] != "}":
                j = _field_end(text, j) if text[j] == "{" else j + 1
                if j < 0:
                    return -1
            return j + 1 if j < n else -1
        j += 1
    return -1


def _fstring_ok(text: str) -> bool:
    known = resource("grammar.python", _rx)["fexpr"]
    hit = known.get(text)
    if hit is None:
        if len(known) > 20_000:
            known.clear()
        hit = known[text] = _fields_ok(text, 0)
    return hit


def _fields_ok(text: str, level: int) -> bool:
    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch == "{":
            if text.startswith("{{", i) and level == 0:
                i += 2
                continue
            depth, j = 0, i + 1
            spec = None
            while j < n:
                c = text[j]
                if c in "\"'":
                    j = _quoted(text, j)
                    if j < 0:
                        return False
                    continue
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    if depth == 0:
                        break
                    depth -= 1
                elif depth == 0 and ((c == "!" and text[j + 1 : j + 2] != "=") or (c == ":" and not text.startswith(":=", j))):
                    spec = j
                    break
                j += 1
            expr = text[i + 1 : j].strip()
            if expr.endswith("=") and not expr.endswith(("==", "!=", "<=", ">=")):
                expr = expr[:-1]
            if not expr or j >= n:
                return False
            p = Python(*tokenize("(" + expr + ")"))
            try:
                p.star_exprs()
                p.eat("NL")
                if p.t[p.i] != "EOF":
                    return False
            except (Panic, RecursionError):
                return False
            if spec is not None:
                if text[j] == "!":
                    if text[j + 1 : j + 2] not in ("r", "s", "a"):
                        return False
                    j += 2
                if text[j : j + 1] == ":":
                    depth, k = 0, j + 1
                    while k < n and not (text[k] == "}" and depth == 0):
                        depth += (text[k] == "{") - (text[k] == "}")
                        k += 1
                    if k >= n or not _fields_ok(text[j + 1 : k], level + 1):
                        return False
                    j = k
                if text[j : j + 1] != "}":
                    return False
            i = j + 1
        elif ch == "}":
            if text.startswith("}}", i):
                i += 2
                continue
            return False
        else:
            i += 1
    return True


class Python(Parser):
    pattern = False

    # expressions: each gives 1 for a single target (name, attribute, item), 2 for a display of targets, 0 otherwise

    def named(self) -> int:
        k = self.expr()
        if self.t[self.i] == ":=":
            if k != 1:
                self.fail("a name before :=")
            self.i += 1
            self.expr()
            return 0
        return k

    def expr(self) -> int:
        t = self.t
        if t[self.i] == "lambda":
            self.i += 1
            self.params(":", False)
            self.eat(":")
            self.expr()
            k = 0
        else:
            k = self.binary(1)
            if t[self.i] == "if" and not self.pattern:
                self.i += 1
                self.binary(1)
                self.eat("else")
                self.expr()
                k = 0
        return k

    def binary(self, least: int) -> int:
        t = self.t
        x = t[self.i]
        if x == "not":
            self.i += 1
            self.binary(3)
            k = 0
        elif x in ("-", "+", "~"):
            self.i += 1
            self.binary(11)
            k = 0
        else:
            k = self.primary()
        while True:
            op = t[self.i]
            if op == "not" and t[self.i + 1] == "in":
                power, width = 4, 2
            else:
                power, width = BIN.get(op, 0), 1
            if power < least or not power:
                return k
            self.i += width
            if op == "is" and t[self.i] == "not":
                self.i += 1
            if op == "**":
                self.binary(11)
            else:
                if power == 4 and t[self.i] == "not":
                    self.fail("an operand")
                self.binary(power + 1 if power not in (1, 2) else (2 if power == 1 else 3))
            k = 0

    def primary(self) -> int:
        t = self.t
        if t[self.i] == "await":
            self.i += 1
            self.primary()
            return 0
        k = self.atom()
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.eat("ID")
                k = 1
            elif x == "(":
                self.i += 1
                self.args()
                k = 0
            elif x == "[":
                self.i += 1
                self.slices()
                k = 1
            else:
                return k

    def atom(self) -> int:
        x = self.t[self.i]
        if x == "ID":
            self.i += 1
            return 1
        if x == "STR":
            while self.t[self.i] == "STR":
                s = self.v[self.i]
                if s[0] in "fFtTrR" and ("{" in s or "}" in s):
                    m = re.match(r"[A-Za-z]{1,2}", s)
                    if m and set(m.group().lower()) & {"f", "t"}:
                        body = s[m.end() :]
                        w = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
                        if not _fstring_ok(body[w:-w]):
                            self.fail("a well-formed field in the string")
                self.i += 1
            return 0
        if x in ("NUM", "...", "None", "True", "False"):
            self.i += 1
            return 0
        if x == "(":
            self.i += 1
            if self.got(")"):
                return 2
            if self.t[self.i] == "yield":
                self.yield_()
                self.eat(")")
                return 0
            k, single = self.star_named()
            if self.pattern and self.got("as"):
                self.eat("ID")
            if self.t[self.i] in ("for", "async"):
                self.comp()
                k = 0
            elif self.t[self.i] == ",":
                while self.got(","):
                    if self.t[self.i] == ")":
                        break
                    k = min(k, self.star_named()[0]) and 2
                    if self.pattern and self.got("as"):
                        self.eat("ID")
                k = 2 if k else 0
            elif single:
                self.fail("a tuple around a starred expression")
            self.eat(")")
            return k
        if x == "[":
            self.i += 1
            if self.got("]"):
                return 2
            k, _ = self.star_named()
            if self.t[self.i] in ("for", "async"):
                self.comp()
                k = 0
            else:
                while self.got(","):
                    if self.t[self.i] == "]":
                        break
                    k = min(k, self.star_named()[0])
                k = 2 if k else 0
            self.eat("]")
            return k
        if x == "{":
            self.i += 1
            if self.got("}"):
                return 0
            if self.got("**"):
                self.binary(5)
                mapping = True
            else:
                _, star = self.star_named()
                mapping = not star and self.t[self.i] == ":"
                if mapping:
                    self.i += 1
                    self.expr()
            if self.t[self.i] in ("for", "async"):
                self.comp()
            else:
                while self.got(","):
                    if self.t[self.i] == "}":
                        break
                    if mapping:
                        if self.got("**"):
                            self.binary(5)
                        else:
                            self.expr()
                            self.eat(":")
                            self.expr()
                    else:
                        self.star_named()
            self.eat("}")
            return 0
        self.fail("an expression")
        return 0

    def star_named(self) -> tuple[int, bool]:
        if self.got("*"):
            return self.binary(5), True
        return self.named(), False

    def yield_(self) -> None:
        self.eat("yield")
        if self.got("from"):
            self.expr()
        elif self.t[self.i] not in (")", "NL", ";", "=", "]", "}"):
            self.star_exprs()

    def comp(self) -> None:
        while True:
            if self.t[self.i] == "async":
                self.i += 1
            self.eat("for")
            self.targets()
            self.eat("in")
            self.binary(1)
            while self.t[self.i] == "if":
                self.i += 1
                self.binary(1) if self.t[self.i] != "lambda" else self.expr()
                if self.got(":="):
                    self.expr()
            if self.t[self.i] not in ("for", "async"):
                return

    def targets(self) -> None:
        """Targets of a loop, up to ``in``."""
        while True:
            self.got("*")
            k = self.binary(5)
            if not k:
                self.fail("a target")
            if not self.got(",") or self.t[self.i] == "in":
                return

    def args(self) -> None:
        keyword = False
        while self.t[self.i] != ")":
            if self.got("**"):
                self.expr()
                keyword = True
            elif self.got("*"):
                self.expr()
            elif self.t[self.i] == "ID" and self.t[self.i + 1] == "=":
                self.i += 2
                self.expr()
                keyword = True
            else:
                self.named()
                if self.t[self.i] in ("for", "async"):
                    self.comp()
                elif keyword:
                    self.i -= 1
                    self.fail("keyword arguments to come last")
                if self.pattern and self.got("as"):
                    self.eat("ID")
            if not self.got(","):
                break
        self.eat(")")

    def slices(self) -> None:
        while True:
            if self.got("*"):
                self.binary(5)
            else:
                if self.t[self.i] not in (":", ",", "]"):
                    self.named()
                for _ in range(2):
                    if self.got(":") and self.t[self.i] not in (":", ",", "]"):
                        self.expr()
            if self.t[self.i - 1] in ("[", ","):
                self.fail("an index")
            if not self.got(",") or self.t[self.i] == "]":
                break
        self.eat("]")

    def star_exprs(self) -> int:
        """A list of expressions without brackets."""
        k, star = self.star_named()
        if self.t[self.i] != ",":
            return k
        while self.got(","):
            if self.t[self.i] in ("NL", ")", "]", "}", "=", ":", ";", "EOF") or self.t[self.i] in AUG:
                break
            k = min(k, self.star_named()[0])
        return 2 if k else 0

    def params(self, end: str, typed: bool) -> None:
        default = star = False
        while self.t[self.i] != end:
            if self.got("/"):
                pass
            elif self.got("**"):
                self.eat("ID")
                if typed and self.got(":"):
                    self.expr()
            elif self.got("*"):
                star = True
                if self.got("ID") and typed and self.got(":"):
                    self.star_named()
            else:
                self.eat("ID")
                if typed and self.got(":"):
                    self.expr()
                if self.got("="):
                    self.expr()
                    default = True
                elif default and not star:
                    self.fail("a default")
            if not self.got(","):
                return

    # statements

    def suite(self) -> None:
        self.eat(":")
        if not self.got("NL"):
            self.simple_line()
            return
        if self.t[self.i] != "IN":
            self.fail("an indented block")
        self.i += 1
        while self.t[self.i] not in ("DE", "EOF"):
            self.statement()
        self.got("DE")

    def statement(self) -> None:
        start = self.i
        try:
            self.one()
        except Panic:
            self.recover(start)

    def recover(self, start: int) -> None:
        """Drop the rest of the logical line and any block below it."""
        self.pattern = False
        t = self.t
        while t[self.i] not in ("NL", "EOF"):
            if t[self.i] == "DE" and self.i > start:
                return
            self.i += 1
        self.got("NL")
        if t[self.i] == "IN":
            level = 0
            while t[self.i] != "EOF":
                level += (t[self.i] == "IN") - (t[self.i] == "DE")
                self.i += 1
                if level == 0:
                    break
        if self.i == start:
            self.i += 1

    def one(self) -> None:
        x = self.t[self.i]
        if x == "@":
            while self.got("@"):
                self.named()
                self.eat("NL")
            if self.t[self.i] not in ("def", "class", "async"):
                self.fail("a definition after its decorators")
            x = self.t[self.i]
        f = getattr(self, "s_" + x, None) if x.isalpha() and x in COMPOUND else None
        if f:
            f()
        elif x == "ID" and self.v[self.i] == "match" and self.is_match():
            self.match_()
        else:
            self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.got(";"):
                if self.got("NL"):
                    return
                continue
            if self.t[self.i] == "EOF":
                return
            self.eat("NL")
            return

    def simple(self) -> None:
        x = self.t[self.i]
        if x in ("pass", "break", "continue"):
            self.i += 1
        elif x == "return":
            self.i += 1
            if self.t[self.i] not in ("NL", ";", "EOF"):
                self.star_exprs()
        elif x == "raise":
            self.i += 1
            if self.t[self.i] not in ("NL", ";", "EOF"):
                self.expr()
                if self.got("from"):
                    self.expr()
        elif x in ("global", "nonlocal"):
            self.i += 1
            self.eat("ID")
            while self.got(","):
                self.eat("ID")
        elif x == "del":
            self.i += 1
            if not self.star_exprs():
                self.fail("a target")
        elif x == "assert":
            self.i += 1
            self.expr()
            if self.got(","):
                self.expr()
        elif x == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.got("as"):
                    self.eat("ID")
                if not self.got(","):
                    break
        elif x == "from":
            self.i += 1
            dots = False
            while self.t[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if not dots or self.t[self.i] == "ID":
                self.dotted()
            self.eat("import")
            if self.got("*"):
                return
            paren = self.got("(")
            while True:
                self.eat("ID")
                if self.got("as"):
                    self.eat("ID")
                if not self.got(",") or (paren and self.t[self.i] == ")"):
                    break
            if paren:
                self.eat(")")
        elif x == "ID" and self.v[self.i] == "type" and self.t[self.i + 1] == "ID" and self.peek(2) in ("=", "["):
            self.i += 2
            self.type_params()
            self.eat("=")
            self.expr()
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.eat("ID")
        while self.got("."):
            self.eat("ID")

    def expression_statement(self) -> None:
        if self.t[self.i] == "yield":
            self.yield_()
            k = 0
        else:
            k = self.star_exprs()
        x = self.t[self.i]
        if x == ":":
            if k != 1:
                self.fail("a target before its annotation")
            self.i += 1
            self.expr()
            if self.got("="):
                self.yield_() if self.t[self.i] == "yield" else self.star_exprs()
        elif x in AUG:
            if k != 1:
                self.fail("a single target")
            self.i += 1
            self.yield_() if self.t[self.i] == "yield" else self.star_exprs()
        else:
            while self.t[self.i] == "=":
                if not k:
                    self.fail("a target before =")
                self.i += 1
                if self.t[self.i] == "yield":
                    self.yield_()
                    k = 0
                else:
                    k = self.star_exprs()

    def type_params(self) -> None:
        if self.got("["):
            while self.t[self.i] != "]":
                self.got("*") or self.got("**")
                self.eat("ID")
                if self.got(":"):
                    self.expr()
                if self.got("="):
                    self.expr()
                if not self.got(","):
                    break
            self.eat("]")

    def s_if(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        while self.t[self.i] == "elif":
            self.i += 1
            self.named()
            self.suite()
        if self.got("else"):
            self.suite()

    def s_while(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        if self.got("else"):
            self.suite()

    def s_for(self) -> None:
        self.i += 1
        self.targets()
        self.eat("in")
        self.star_exprs()
        self.suite()
        if self.got("else"):
            self.suite()

    def s_try(self) -> None:
        self.i += 1
        self.suite()
        n = 0
        while self.t[self.i] == "except":
            n += 1
            self.i += 1
            self.got("*")
            if self.t[self.i] != ":":
                self.expr()
                while self.got(","):
                    self.expr()
                if self.got("as"):
                    self.eat("ID")
            self.suite()
        if n and self.got("else"):
            self.suite()
        if self.got("finally"):
            self.suite()
        elif not n:
            self.fail("except or finally")

    def s_with(self) -> None:
        self.i += 1
        if self.t[self.i] == "(":
            # a bracketed list of items, if the bracket closes before the colon
            save, errors = self.i, len(self.errors)
            try:
                self.i += 1
                while self.t[self.i] != ")":
                    self.item()
                    if not self.got(","):
                        break
                self.eat(")")
                if self.t[self.i] == ":":
                    self.suite()
                    return
            except Panic:
                if self.t[self.i] in ("IN", "NL", "DE"):
                    raise
            self.i = save
            del self.errors[errors:]
        while True:
            self.item()
            if not self.got(","):
                break
        self.suite()

    def item(self) -> None:
        self.named()
        if self.got("as"):
            if not (self.binary(5)):
                self.fail("a target")

    def s_def(self) -> None:
        self.i += 1
        self.eat("ID")
        self.type_params()
        self.eat("(")
        self.params(")", True)
        self.eat(")")
        if self.got("->"):
            self.expr()
        self.suite()

    def s_class(self) -> None:
        self.i += 1
        self.eat("ID")
        self.type_params()
        if self.got("("):
            self.args()
        self.suite()

    def s_async(self) -> None:
        self.i += 1
        x = self.t[self.i]
        if x not in ("def", "for", "with"):
            self.fail("def, for or with")
        getattr(self, "s_" + x)()

    def is_match(self) -> bool:
        j = self.i + 1
        while self.t[j] not in ("NL", "EOF"):
            j += 1
        return j > self.i + 2 and self.t[j - 1] == ":" and self.t[j] == "NL" and self.t[j + 1] == "IN" and self.v[j + 2] == "case"

    def match_(self) -> None:
        self.i += 1
        self.star_exprs()
        self.eat(":")
        self.eat("NL")
        self.eat("IN")
        while self.t[self.i] == "ID" and self.v[self.i] == "case":
            self.i += 1
            self.pattern = True
            self.star_exprs()
            if self.got("as"):
                self.eat("ID")
            while self.got(","):
                if self.t[self.i] in (":", "if"):
                    break
                self.star_named()
            self.pattern = False
            if self.got("if"):
                self.named()
            self.suite()
        if self.t[self.i] != "EOF":
            self.eat("DE")

    def file(self) -> None:
        while self.t[self.i] != "EOF":
            if self.t[self.i] in ("IN", "DE"):
                if self.t[self.i] == "IN":
                    self.errors.append((self.at[self.i], "unexpected indent"))
                self.i += 1
                continue
            if self.got("NL"):
                continue
            self.statement()


COMPOUND = frozenset(("if", "while", "for", "try", "with", "def", "class", "async"))


def python_errors(src: str) -> list[tuple[int, str]]:
    if "\x00" in src:
        return [(src.index("\x00"), "NUL")]
    p = Python(*tokenize(src))
    p.file()
    if not p.errors and "BAD" in p.t:
        j = p.t.index("BAD")
        p.errors.append((p.at[j], p.v[j]))
    return p.errors
