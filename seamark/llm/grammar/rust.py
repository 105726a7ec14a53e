"""Rust: items, types, patterns and statements by recursive descent, expressions by precedence climbing; bodies of macros are token trees."""

from __future__ import annotations

import re

from seamark.functions.worker import resource
from seamark.llm.grammar.base import Panic, Parser

KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try gen".split())
BIN = {
    "=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "&=": 1, "|=": 1, "^=": 1, "<<=": 1, ">>=": 1, "..": 2, "..=": 2, "||": 3, "&&": 4,
    "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "as": 12,
}
PATH = frozenset(("ID", "self", "Self", "super", "crate"))
OPENS = {"(": ")", "[": "]", "{": "}"}


def _rx() -> dict:
    esc = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\r?\n)"
    return {
        "tok": re.compile(
            r"(?P<w>\s+)|(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<raw>(?:b|c)?r(?P<h>\#*)\")"
            rf"|(?P<STR>[bc]?\"(?:[^\"\\]+|{esc})*+\")|(?P<CHR>b?'(?:{esc}|[^'\\\n\r\t])')|(?P<LIFE>'(?:r\#)?[^\W\d]\w*)"
            r"|(?P<NUM>(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:16|32|64|128))?(?!\w))"
            r"|(?P<ID>(?:r\#)?[^\W\d]\w*)|(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])|(?P<BAD>.)", re.S),
        "nest": re.compile(r"/\*|\*/"),
    }


def tokenize(src: str) -> tuple[list[str], list[str], list[int]]:
    rx = resource("grammar.rust", _rx)
    t: list[str] = []
    v: list[str] = []
    at: list[int] = []
    search = rx["tok"].match
    pos, n = 0, len(src)
    if src.startswith("#!") and not re.match(r"#!\s*\[", src):
        pos = src.find("\n")
        pos = n if pos < 0 else pos
    while pos < n:
        m = search(src, pos)
        k, x, s = m.lastgroup, m.group(), pos
        pos = m.end()
        if k == "w" or k == "lc":
            continue
        if k == "bc":
            level = 1
            for y in rx["nest"].finditer(src, pos):
                level += 1 if y.group() == "/*" else -1
                if not level:
                    pos = y.end()
                    break
            else:
                t.append("BAD"), v.append("unterminated comment"), at.append(s)
                pos = n
            continue
        if k in ("raw", "h"):
            end = '"' + m.group("h")
            e = src.find(end, pos)
            if e < 0:
                t.append("BAD"), v.append("unterminated raw string"), at.append(s)
                pos = n
            else:
                pos = e + len(end)
                t.append("STR"), v.append(src[s:pos]), at.append(s)
            continue
        if k == "ID":
            t.append(x if x in KEYWORDS and x not in ("gen",) else "ID")
            v.append(x)
        elif k == "op":
            t.append(x), v.append(x)
        elif k == "BAD":
            t.append(k), v.append("unterminated literal" if x in "\"'" else f"stray {x!r}")
        else:
            t.append(k), v.append(x)
        at.append(s)
    t.append("EOF"), v.append(""), at.append(n)
    return t, v, at


class Rust(Parser):
    def split(self, x: str) -> bool:
        """Whether the token begins with ``x``; if so, only that much of it is taken."""
        y = self.t[self.i]
        if y == x:
            self.i += 1
            return True
        if y.startswith(x) and y in (">>", ">=", ">>=", "&&", "||", "<<", "<<="):
            self.t[self.i] = self.v[self.i] = y[len(x) :]
            return True
        return False

    def need(self, x: str) -> None:
        if not self.split(x):
            self.fail(x)

    def tree(self) -> None:
        """A balanced token tree."""
        stack: list[str] = []
        t = self.t
        while True:
            x = t[self.i]
            if x in OPENS:
                stack.append(OPENS[x])
            elif x in (")", "]", "}"):
                if not stack or stack[-1] != x:
                    self.fail(stack[-1] if stack else "no closing bracket")
                stack.pop()
            elif x == "EOF" or x == "BAD":
                self.fail(stack[-1] if stack else "a token")
            self.i += 1
            if not stack:
                return

    def attributes(self, inner: bool = False) -> None:
        while self.t[self.i] == "#" and (self.t[self.i + 1] == "[" or (inner and self.t[self.i + 1] == "!" and self.peek(2) == "[")):
            self.i += 1
            self.got("!")
            self.tree()

    # paths and types

    def path(self, expression: bool) -> None:
        self.split("::") if self.t[self.i] == "::" else None
        if self.split("<"):
            self.type_()
            if self.got("as"):
                self.path(False)
            self.need(">")
            self.eat("::")
        while True:
            if self.t[self.i] not in PATH:
                self.fail("a name")
            self.i += 1
            x = self.t[self.i]
            if expression:
                if x == "::" and self.t[self.i + 1] in ("<", "<<"):
                    self.i += 1
                    self.generic_args()
            else:
                if x == "::" and self.t[self.i + 1] in ("<", "<<", "("):
                    self.i += 1
                    x = self.t[self.i]
                if x in ("<", "<<"):
                    self.generic_args()
                elif x == "(":
                    self.i += 1
                    while self.t[self.i] != ")":
                        self.type_()
                        if not self.got(","):
                            break
                    self.eat(")")
                    if self.got("->"):
                        self.type_no_bounds()
            if self.t[self.i] == "::" and self.t[self.i + 1] in PATH:
                self.i += 1
                continue
            return

    def generic_args(self) -> None:
        self.need("<")
        while not self.t[self.i].startswith(">"):
            x = self.t[self.i]
            if x == "LIFE":
                self.i += 1
            elif x in ("NUM", "STR", "CHR", "true", "false"):
                self.i += 1
            elif x == "-":
                self.i += 1
                self.eat("NUM")
            elif x == "{":
                self.block()
            else:
                self.type_()
                if self.got("="):
                    self.type_()
                elif self.got(":"):
                    self.bounds()
            if not self.got(","):
                break
        self.need(">")

    def bounds(self) -> None:
        while True:
            if self.got("("):
                self.bounds()
                self.eat(")")
            elif self.t[self.i] == "LIFE":
                self.i += 1
            elif self.t[self.i] in ("?", "for", "~", "const", "async", "use") or self.t[self.i] in PATH or self.t[self.i] in ("::", "<"):
                self.got("~")
                self.got("const")
                self.got("async")
                self.got("?")
                if self.got("for"):
                    self.generics()
                if self.got("use"):
                    self.generic_args()
                else:
                    self.path(False)
            else:
                return
            if not self.got("+"):
                return

    def type_(self) -> None:
        self.type_no_bounds(True)

    def type_no_bounds(self, plus: bool = False) -> None:
        x = self.t[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.got("LIFE")
            self.got("mut")
            self.type_no_bounds()
        elif x == "*":
            self.i += 1
            if not (self.got("const") or self.got("mut")):
                self.fail("const or mut")
            self.type_no_bounds()
        elif x == "[":
            self.i += 1
            self.type_()
            if self.got(";"):
                self.expr()
            self.eat("]")
        elif x == "(":
            self.i += 1
            while self.t[self.i] != ")":
                self.type_()
                if not self.got(","):
                    break
            self.eat(")")
        elif x == "!":
            self.i += 1
        elif x == "ID" and self.v[self.i] == "_":
            self.i += 1
        elif x in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif x in ("fn", "unsafe", "extern", "for"):
            if self.got("for"):
                self.generics()
            if self.t[self.i] in ("fn", "unsafe", "extern"):
                self.got("unsafe")
                if self.got("extern"):
                    self.got("STR")
                self.eat("fn")
                self.eat("(")
                while self.t[self.i] != ")":
                    self.attributes()
                    if self.got("..."):
                        break
                    if self.t[self.i] == "ID" and self.t[self.i + 1] == ":":
                        self.i += 2
                    self.type_()
                    if not self.got(","):
                        break
                self.eat(")")
                if self.got("->"):
                    self.type_no_bounds()
            else:
                self.path(False)
        elif x in PATH or x in ("::", "<", "<<"):
            self.path(False)
            if self.t[self.i] == "!" and self.t[self.i + 1] in OPENS:
                self.i += 1
                self.tree()
        else:
            self.fail("a type")
        if plus and self.t[self.i] == "+":
            self.i += 1
            self.bounds()

    def generics(self) -> None:
        if not self.split("<"):
            return
        while not self.t[self.i].startswith(">"):
            self.attributes()
            if self.got("LIFE"):
                if self.got(":"):
                    self.bounds()
            elif self.got("const"):
                self.eat("ID")
                self.eat(":")
                self.type_()
                if self.got("="):
                    self.block() if self.t[self.i] == "{" else self.unary()
            else:
                self.eat("ID")
                if self.got(":"):
                    self.bounds()
                if self.got("="):
                    self.type_()
            if not self.got(","):
                break
        self.need(">")

    def where(self) -> None:
        if not self.got("where"):
            return
        while self.t[self.i] not in ("{", ";", "="):
            if self.got("LIFE"):
                self.eat(":")
                self.bounds()
            else:
                if self.got("for"):
                    self.generics()
                self.type_()
                self.eat(":")
                self.bounds()
            if not self.got(","):
                return

    # patterns

    def pattern(self) -> None:
        self.split("|") if self.t[self.i] == "|" else None
        self.pattern_one()
        while self.got("|"):
            self.pattern_one()

    def literal(self) -> bool:
        if self.t[self.i] == "-" and self.t[self.i + 1] == "NUM":
            self.i += 2
            return True
        if self.t[self.i] in ("NUM", "STR", "CHR", "true", "false"):
            self.i += 1
            return True
        return False

    def pattern_one(self) -> None:
        self.attributes()
        x = self.t[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.got("mut")
            self.pattern_one()
        elif x in ("ref", "mut"):
            self.got("ref")
            self.got("mut")
            self.eat("ID")
            if self.got("@"):
                self.pattern_one()
        elif x in ("(", "["):
            self.i += 1
            close = OPENS[x]
            while self.t[self.i] != close:
                self.pattern()
                if not self.got(","):
                    break
            self.eat(close)
        elif x in ("..", "..="):
            self.i += 1
            if self.t[self.i] in ("NUM", "CHR", "-") or self.t[self.i] in PATH:
                self.literal() or self.path(True)
        elif self.literal():
            if self.t[self.i] in ("..", "..=", "..."):
                self.i += 1
                self.literal() or (self.t[self.i] in PATH and self.path(True))
        elif x in PATH or x in ("::", "<"):
            self.path(True)
            y = self.t[self.i]
            if y == "@":
                self.i += 1
                self.pattern_one()
            elif y == "(":
                self.i += 1
                while self.t[self.i] != ")":
                    self.pattern()
                    if not self.got(","):
                        break
                self.eat(")")
            elif y == "{":
                self.i += 1
                while self.t[self.i] != "}":
                    self.attributes()
                    if self.got(".."):
                        break
                    if self.t[self.i] in ("ID", "NUM") and self.t[self.i + 1] == ":":
                        self.i += 2
                        self.pattern()
                    else:
                        self.got("ref")
                        self.got("mut")
                        self.eat("ID")
                    if not self.got(","):
                        break
                self.eat("}")
            elif y == "!" and self.t[self.i + 1] in OPENS:
                self.i += 1
                self.tree()
            elif y in ("..", "..=", "..."):
                self.i += 1
                self.literal() or (self.t[self.i] in PATH and self.path(True))
        elif x == "const":
            self.i += 1
            self.block()
        else:
            self.fail("a pattern")

    # expressions

    def expr(self, least: int = 1, struct: bool = True) -> None:
        t = self.t
        x = t[self.i]
        if x in ("..", "..="):
            self.i += 1
            if self.starts(struct):
                self.expr(3, struct)
        elif x == "let":
            self.i += 1
            self.pattern()
            self.eat("=")
            self.expr(4, struct)
        else:
            self.unary(struct)
        self.climb(least, struct)

    def climb(self, least: int, struct: bool) -> None:
        t = self.t
        while True:
            op = t[self.i]
            p = BIN.get(op, 0)
            if p < least or not p:
                return
            self.i += 1
            if op == "as":
                self.type_no_bounds()
            elif p == 2:
                if self.starts(struct):
                    self.expr(3, struct)
                elif op == "..=":
                    self.fail("the end of a range")
            elif t[self.i] == "let" and op == "&&":
                self.i += 1
                self.pattern()
                self.eat("=")
                self.expr(5, struct)
            else:
                self.expr(p if p == 1 else p + 1, struct)
                if p == 5 and BIN.get(t[self.i], 0) == 5:
                    self.fail("brackets around chained comparisons")

    def starts(self, struct: bool) -> bool:
        x = self.t[self.i]
        return x in PATH or x in ("NUM", "STR", "CHR", "(", "[", "-", "!", "*", "&", "&&", "|", "||", "if", "match", "true", "false", "::", "<", "loop", "unsafe", "move", "return", "break") or (x == "{" and struct)

    def unary(self, struct: bool = True) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x in ("-", "!", "*"):
                self.i += 1
            elif x in ("&", "&&"):
                self.i += 1
                if t[self.i] == "ID" and self.v[self.i] == "raw" and t[self.i + 1] in ("const", "mut"):
                    self.i += 2
                self.got("mut")
            else:
                break
        self.postfix(self.primary(struct), struct)

    def postfix(self, _, struct: bool) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x == "?":
                self.i += 1
            elif x == ".":
                self.i += 1
                y = t[self.i]
                if y == "await":
                    self.i += 1
                elif y == "NUM":
                    self.i += 1
                else:
                    if y != "ID":
                        self.fail("a field or method")
                    self.i += 1
                    if t[self.i] == "::":
                        self.i += 1
                        self.generic_args()
                        if t[self.i] != "(":
                            self.fail("(")
            elif x == "(":
                self.i += 1
                self.list(")")
            elif x == "[":
                self.i += 1
                self.expr()
                self.eat("]")
            else:
                return

    def list(self, close: str) -> None:
        while self.t[self.i] != close:
            self.attributes()
            self.expr()
            if not self.got(","):
                break
        self.eat(close)

    def primary(self, struct: bool) -> bool:
        """True if the expression ends in a block, so that a statement may end with it."""
        t = self.t
        x = t[self.i]
        if x in ("NUM", "STR", "CHR", "true", "false"):
            self.i += 1
            return False
        if x in PATH or x in ("::", "<", "<<"):
            self.path(True)
            y = t[self.i]
            if y == "!" and t[self.i + 1] in OPENS:
                self.i += 1
                brace = t[self.i] == "{"
                self.tree()
                return brace
            if y == "{" and struct and self.is_struct():
                self.struct_literal()
            return False
        if x == "(":
            self.i += 1
            self.attributes(True)
            self.list(")")
            return False
        if x == "[":
            self.i += 1
            if self.got("]"):
                return False
            self.expr()
            if self.got(";"):
                self.expr()
                self.eat("]")
            else:
                if self.t[self.i] != "]":
                    self.eat(",")
                self.list("]")
            return False
        if x == "{":
            self.block()
            return True
        if x in ("unsafe", "async", "const", "try"):
            self.i += 1
            if x == "async":
                self.got("move")
            if t[self.i] in ("|", "||", "move"):
                return self.closure(struct)
            self.block()
            return True
        if x in ("|", "||", "move", "static"):
            return self.closure(struct)
        if x == "LIFE":
            self.i += 1
            self.eat(":")
            if t[self.i] not in ("loop", "while", "for", "{"):
                self.fail("a loop")
            return self.primary(struct)
        if x == "if":
            self.i += 1
            self.expr(1, False)
            self.block()
            while self.got("else"):
                if self.got("if"):
                    self.expr(1, False)
                    self.block()
                else:
                    self.block()
                    break
            return True
        if x == "while":
            self.i += 1
            self.expr(1, False)
            self.block()
            return True
        if x == "loop":
            self.i += 1
            self.block()
            return True
        if x == "for":
            self.i += 1
            if self.t[self.i] == "<":
                self.generics()
                return self.closure(struct)
            self.pattern()
            self.eat("in")
            self.expr(1, False)
            self.block()
            return True
        if x == "match":
            self.i += 1
            self.expr(1, False)
            self.eat("{")
            self.attributes(True)
            while t[self.i] != "}":
                self.attributes()
                self.pattern()
                if self.got("if"):
                    self.expr()
                self.eat("=>")
                start = self.i
                if t[self.i] == "{":
                    self.block()
                    if t[self.i] in (",", "}") or not (t[self.i] in (".", "?")):
                        self.got(",")
                        continue
                    self.postfix(False, True)
                    self.climb(1, True)
                else:
                    self.expr()
                if not self.got(",") and t[self.i] != "}":
                    if not (t[self.i - 1] == "}" and t[start] in ("if", "match", "loop", "while", "for", "unsafe")):
                        self.fail("a comma or }")
            self.i += 1
            return True
        if x in ("return", "break", "continue", "yield", "become"):
            self.i += 1
            if x in ("break", "continue"):
                self.got("LIFE")
            if x != "continue" and self.starts(struct):
                self.expr(1, struct)
            return False
        self.fail("an expression")
        return False

    def closure(self, struct: bool) -> bool:
        self.got("static")
        self.got("async")
        self.got("move")
        if not self.got("||"):
            self.eat("|")
            while self.t[self.i] != "|":
                self.attributes()
                self.pattern_one()
                if self.got(":"):
                    self.type_()
                if not self.got(","):
                    break
            self.eat("|")
        if self.got("->"):
            self.type_no_bounds()
            self.block()
        else:
            self.expr(1, struct)
        return False

    def is_struct(self) -> bool:
        a, b = self.t[self.i + 1], self.peek(2)
        return a == "}" or a == ".." or a == "#" or (a in ("ID", "NUM") and b in (":", ",", "}"))

    def struct_literal(self) -> None:
        self.eat("{")
        while self.t[self.i] != "}":
            self.attributes()
            if self.got(".."):
                if self.t[self.i] != "}":
                    self.expr()
                break
            if self.t[self.i] not in ("ID", "NUM"):
                self.fail("a field")
            self.i += 1
            if self.got(":"):
                self.expr()
            if not self.got(","):
                break
        self.eat("}")

    # statements

    def block(self) -> None:
        self.eat("{")
        self.attributes(True)
        while self.t[self.i] != "}":
            if self.t[self.i] == "EOF":
                self.fail("}")
            start = self.i
            try:
                self.statement()
            except Panic:
                self.skip_to((";", "}"))
                self.got(";")
                if self.i == start:
                    self.i += 1
        self.i += 1

    def statement(self) -> None:
        t = self.t
        if self.got(";"):
            return
        self.attributes()
        x = t[self.i]
        if x == "let":
            self.i += 1
            self.pattern()
            if self.got(":"):
                self.type_()
            if self.got("="):
                self.expr()
                if self.got("else"):
                    self.block()
            self.eat(";")
        elif self.is_item():
            self.item()
        else:
            blocky = x in ("{", "if", "match", "loop", "while", "for", "unsafe", "LIFE", "async", "try") or (x in PATH)
            if blocky:
                ended = self.primary(True)
                if ended and t[self.i] not in (".", "?"):
                    self.got(";")
                    return
                self.postfix(False, True)
                self.climb(1, True)
            else:
                self.expr()
            if t[self.i] != "}":
                self.eat(";")

    def is_item(self) -> bool:
        x, y = self.t[self.i], self.t[self.i + 1]
        if x in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "type", "pub"):
            return True
        if x in ("const", "static"):
            return y in ("ID", "mut", "fn", "unsafe", "async", "extern") and not (x == "static" and y == "move")
        if x == "unsafe":
            return y in ("fn", "impl", "trait", "extern")
        if x == "async":
            return y in ("fn", "unsafe")
        if x == "extern":
            return True
        if x == "ID":
            w = self.v[self.i]
            return (w == "macro_rules" and y == "!") or (w == "union" and y == "ID" and self.peek(2) in ("{", "<")) or (w == "auto" and y == "trait")
        return False

    def item(self) -> None:
        t = self.t
        if self.got("pub") and t[self.i] == "(" and t[self.i + 1] in ("crate", "super", "self", "in"):
            self.tree()
        if t[self.i] == "ID" and self.v[self.i] == "default" and t[self.i + 1] in ("fn", "impl", "type", "const", "unsafe", "async"):
            self.i += 1
        x = t[self.i]
        if x == "use":
            self.i += 1
            self.use()
            self.eat(";")
        elif x == "mod":
            self.i += 1
            self.eat("ID")
            if not self.got(";"):
                self.eat("{")
                self.items("}")
                self.eat("}")
        elif x == "struct" or (x == "ID" and self.v[self.i] == "union"):
            self.i += 1
            self.eat("ID")
            self.generics()
            self.where()
            if t[self.i] == "{":
                self.fields()
            elif t[self.i] == "(":
                self.tuple_fields()
                self.where()
                self.eat(";")
            else:
                self.eat(";")
        elif x == "enum":
            self.i += 1
            self.eat("ID")
            self.generics()
            self.where()
            self.eat("{")
            while t[self.i] != "}":
                self.attributes()
                self.visibility()
                self.eat("ID")
                if t[self.i] == "{":
                    self.fields()
                elif t[self.i] == "(":
                    self.tuple_fields()
                if self.got("="):
                    self.expr()
                if not self.got(","):
                    break
            self.eat("}")
        elif x == "type":
            self.i += 1
            self.eat("ID")
            self.generics()
            if self.got(":"):
                self.bounds()
            self.where()
            if self.got("="):
                self.type_()
            self.where()
            self.eat(";")
        elif x in ("const", "static") and t[self.i + 1] in ("ID", "mut"):
            self.i += 1
            self.got("mut")
            self.eat("ID")
            self.eat(":")
            self.type_()
            if self.got("="):
                self.expr()
            self.eat(";")
        elif x == "extern" and t[self.i + 1] == "crate":
            self.i += 2
            self.got("self") or self.eat("ID")
            if self.got("as"):
                self.eat("ID")
            self.eat(";")
        elif x == "ID" and t[self.i + 1] == "!":
            self.i += 2
            if self.v[self.i - 2] == "macro_rules":
                self.eat("ID")
            brace = t[self.i] == "{"
            if t[self.i] not in OPENS:
                self.fail("the arguments of a macro")
            self.tree()
            if not brace:
                self.eat(";")
        elif x == "ID" and self.v[self.i] == "auto":
            self.i += 1
            self.trait()
        else:
            while t[self.i] in ("const", "async", "unsafe", "extern") and t[self.i + 1] != "{":
                if t[self.i] == "extern":
                    self.i += 1
                    self.got("STR")
                    if t[self.i] == "{":
                        break
                else:
                    self.i += 1
            x = t[self.i]
            if x == "fn":
                self.fn()
            elif x == "trait":
                self.trait()
            elif x == "impl":
                self.i += 1
                if t[self.i] == "<":
                    self.generics()
                self.got("const")
                self.got("!")
                self.type_()
                if self.got("for"):
                    self.type_()
                self.where()
                self.eat("{")
                self.items("}")
                self.eat("}")
            elif x == "{" and t[self.i - 1] in ("extern", "STR"):
                self.i += 1
                self.items("}")
                self.eat("}")
            elif x in PATH:
                self.path(True)
                self.eat("!")
                brace = t[self.i] == "{"
                if t[self.i] not in OPENS:
                    self.fail("the arguments of a macro")
                self.tree()
                if not brace:
                    self.eat(";")
            else:
                self.fail("an item")

    def trait(self) -> None:
        self.eat("trait")
        self.eat("ID")
        self.generics()
        if self.got(":"):
            self.bounds()
        self.where()
        if self.got("="):
            self.bounds()
            self.eat(";")
            return
        self.eat("{")
        self.items("}")
        self.eat("}")

    def visibility(self) -> None:
        if self.got("pub") and self.t[self.i] == "(" and self.t[self.i + 1] in ("crate", "super", "self", "in"):
            self.tree()

    def fields(self) -> None:
        self.eat("{")
        while self.t[self.i] != "}":
            self.attributes()
            self.visibility()
            self.eat("ID")
            self.eat(":")
            self.type_()
            if self.got("="):
                self.expr()
            if not self.got(","):
                break
        self.eat("}")

    def tuple_fields(self) -> None:
        self.eat("(")
        while self.t[self.i] != ")":
            self.attributes()
            self.visibility()
            self.type_()
            if not self.got(","):
                break
        self.eat(")")

    def fn(self) -> None:
        self.eat("fn")
        self.eat("ID")
        self.generics()
        self.eat("(")
        while self.t[self.i] != ")":
            self.attributes()
            if self.got("..."):
                break
            save = self.i
            if self.t[self.i] in ("&", "self", "mut"):
                if self.got("&"):
                    self.got("LIFE")
                self.got("mut")
                if self.got("self"):
                    if self.got(":"):
                        self.type_()
                    if not self.got(","):
                        break
                    continue
                self.i = save
            self.pattern_one()
            self.eat(":")
            if not self.got("..."):
                self.type_()
            if not self.got(","):
                break
        self.eat(")")
        if self.got("->"):
            self.type_()
        self.where()
        if not self.got(";"):
            self.block()

    def use(self) -> None:
        self.got("::")
        while True:
            if self.got("*"):
                return
            if self.got("{"):
                while self.t[self.i] != "}":
                    self.use()
                    if not self.got(","):
                        break
                self.eat("}")
                return
            if self.t[self.i] not in PATH:
                self.fail("a name")
            self.i += 1
            if self.got("::"):
                continue
            if self.got("as"):
                self.eat("ID")
            return

    def items(self, end: str) -> None:
        while self.t[self.i] == "#" and self.t[self.i + 1] == "!" and self.peek(2) == "[":
            self.i += 2
            self.tree()
        while self.t[self.i] not in (end, "EOF"):
            start = self.i
            try:
                self.attributes()
                if self.t[self.i] in (end, "EOF", ";"):
                    self.fail("an item")
                self.item()
            except Panic:
                self.skip_to((";", "}"))
                if not self.got(";") and end == "EOF":
                    self.got("}")
                if self.i == start:
                    self.i += 1


def rust_errors(src: str) -> list[tuple[int, str]]:
    p = Rust(*tokenize(src[1:] if src.startswith("\ufeff") else src))
    p.items("EOF")
    if not p.errors and "BAD" in p.t:
        j = p.t.index("BAD")
        p.errors.append((p.at[j], p.v[j]))
    return p.errors
