"""Go: automatic semicolons in the lexer, declarations and statements by recursive descent, binary expressions by precedence climbing."""

from __future__ import annotations

import re

from seamark.functions.worker import resource
from seamark.llm.grammar.base import Panic, Parser

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BIN = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
ENDS = frozenset(("ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def _rx():
    esc = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
    return re.compile(
        r"(?P<w>[ \t\r]+)|(?P<NL>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]+|\*(?!/))*+\*/)"
        rf"|(?P<STR>`[^`]*`|\"(?:[^\"\\\n]|{esc})*+\")|(?P<CHR>'(?:[^'\\\n]|{esc})')"
        r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)i?(?!\w))"
        r"|(?P<ID>[^\W\d]\w*)|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])|(?P<BAD>.)", re.S)  # fmt: skip


def tokenize(src: str) -> tuple[list[str], list[str], list[int]]:
    t: list[str] = []
    v: list[str] = []
    at: list[int] = []
    last = ""
    for m in resource("grammar.go", _rx).finditer(src):
        k = m.lastgroup
        if k == "w":
            continue
        if k in ("NL", "lc", "bc"):
            if k == "NL" or (k == "bc" and "\n" in m.group()):
                if last in ENDS:
                    t.append(";"), v.append("newline"), at.append(m.start())
                    last = ";"
            continue
        x = m.group()
        last = (x if x in KEYWORDS else "ID") if k == "ID" else (x if k == "op" else k)
        t.append(last)
        v.append(x if k != "BAD" else ("unterminated literal or comment" if x in "\"'`/" else f"stray {x!r}"))
        at.append(m.start())
    if last in ENDS:
        t.append(";"), v.append("newline"), at.append(len(src))
    t.append("EOF"), v.append(""), at.append(len(src))
    return t, v, at


class Go(Parser):
    level = 0  # below zero in the clause of a control statement, where composite literals need brackets

    # types

    def type_(self) -> None:
        if not self.try_type():
            self.fail("a type")

    def try_type(self) -> bool:
        x = self.t[self.i]
        if x == "ID":
            self.i += 1
            if self.got("."):
                self.eat("ID")
            if self.t[self.i] == "[" and self.t[self.i + 1] != "]":
                save, errors = self.i, len(self.errors)
                try:
                    self.i += 1
                    self.type_()
                    while self.got(","):
                        self.type_()
                    self.eat("]")
                except Panic:
                    self.i = save
                    del self.errors[errors:]
        elif x == "*":
            self.i += 1
            self.type_()
        elif x == "(":
            self.i += 1
            self.type_()
            self.eat(")")
        elif x == "[":
            self.i += 1
            if not self.got("]"):
                if not self.got("..."):
                    self.nested(self.expr)
                self.eat("]")
            self.type_()
        elif x == "map":
            self.i += 1
            self.eat("[")
            self.type_()
            self.eat("]")
            self.type_()
        elif x == "chan" or (x == "<-" and self.t[self.i + 1] == "chan"):
            self.i += 1
            self.got("chan") if x == "<-" else self.got("<-")
            self.type_()
        elif x == "func":
            self.i += 1
            self.signature()
        elif x == "struct":
            self.i += 1
            self.struct()
        elif x == "interface":
            self.i += 1
            self.interface()
        else:
            return False
        return True

    def nested(self, f) -> None:
        save, self.level = self.level, 0
        f()
        self.level = save

    def struct(self) -> None:
        self.eat("{")
        while self.t[self.i] != "}":
            if self.got("*"):
                self.type_()
            else:
                self.eat("ID")
                if self.got("."):
                    self.eat("ID")
                elif self.t[self.i] not in (";", "}", "STR"):
                    while self.got(","):
                        self.eat("ID")
                    self.type_()
            self.got("STR")
            if self.t[self.i] != "}":
                self.eat(";")
        self.i += 1

    def interface(self) -> None:
        self.eat("{")
        while self.t[self.i] != "}":
            if self.t[self.i] == "ID" and self.t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                while True:
                    self.got("~")
                    self.type_()
                    if not self.got("|"):
                        break
            if self.t[self.i] != "}":
                self.eat(";")
        self.i += 1

    def params(self) -> None:
        self.eat("(")
        while self.t[self.i] != ")":
            if self.got("..."):
                self.type_()
            else:
                self.type_()
                if self.got("..."):
                    self.type_()
                elif self.t[self.i] not in (",", ")"):
                    self.type_()
            if not self.got(","):
                break
        self.eat(")")

    def signature(self) -> None:
        self.params()
        if self.t[self.i] == "(":
            self.params()
        elif self.t[self.i] != "{":
            self.try_type()

    def type_params(self) -> None:
        self.eat("[")
        while self.t[self.i] != "]":
            self.eat("ID")
            while self.got(","):
                self.eat("ID")
            while True:
                self.got("~")
                self.type_()
                if not self.got("|"):
                    break
            if not self.got(","):
                break
        self.eat("]")

    # expressions

    def expr(self, least: int = 1) -> None:
        self.unary()
        while True:
            p = BIN.get(self.t[self.i], 0)
            if p < least:
                break
            self.i += 1
            self.expr(p + 1)

    def unary(self) -> None:
        while self.t[self.i] in ("+", "-", "!", "^", "*", "&", "<-"):
            if self.t[self.i] == "<-" and self.t[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        x = self.t[self.i]
        literal = False  # may be the type of a composite literal
        if x == "ID":
            self.i += 1
            literal = True
        elif x in ("NUM", "STR", "CHR"):
            self.i += 1
        elif x == "(":
            self.i += 1
            self.nested(self.expr_or_type)
            self.eat(")")
        elif x == "func":
            self.i += 1
            self.signature()
            if self.t[self.i] == "{":
                self.nested(self.block)
        elif x in ("[", "map", "struct", "interface", "chan", "<-"):
            self.type_()
            if self.t[self.i] == "{" and x in ("[", "map", "struct"):
                self.composite()
            elif self.t[self.i] not in ("(", ")", ",", "]", "."):
                self.fail("a literal's elements")
        else:
            self.fail("an expression")
        while True:
            x = self.t[self.i]
            if x == ".":
                self.i += 1
                if self.got("("):
                    self.got("type") or self.type_()
                    self.eat(")")
                    literal = False
                else:
                    self.eat("ID")
            elif x == "(":
                self.i += 1
                self.nested(self.args)
                literal = False
            elif x == "[":
                self.i += 1
                self.nested(self.index)
            elif x == "{" and literal and self.level >= 0:
                self.composite()
                literal = False
            else:
                return

    def expr_or_type(self) -> None:
        self.expr()

    def args(self) -> None:
        while self.t[self.i] != ")":
            self.expr()
            self.got("...")
            if not self.got(","):
                break
        self.eat(")")

    def index(self) -> None:
        if self.t[self.i] == "]":
            self.fail("an index")
        colon = False
        while self.t[self.i] != "]":
            if self.got(":"):
                colon = True
                continue
            self.expr()
            if self.t[self.i] not in (":", "]"):
                if colon or not self.got(","):
                    self.eat("]")
        self.i += 1

    def composite(self) -> None:
        self.eat("{")
        save, self.level = self.level, 0
        while self.t[self.i] != "}":
            self.element()
            if self.got(":"):
                self.element()
            if not self.got(","):
                break
        if self.t[self.i] != "}":
            self.fail("a comma or }")
        self.i += 1
        self.level = save

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.composite()
        else:
            self.expr()

    def exprs(self) -> None:
        self.expr()
        while self.got(","):
            self.expr()

    # statements

    def block(self) -> None:
        self.eat("{")
        self.statements(("}",))
        self.eat("}")

    def statements(self, ends: tuple[str, ...]) -> None:
        while self.t[self.i] not in ends and self.t[self.i] != "EOF":
            start, level = self.i, self.level
            try:
                self.statement()
                if self.t[self.i] not in ends and self.t[self.i] != "EOF":
                    self.eat(";")
            except Panic:
                self.level = level
                self.skip_to((";", "}"))
                self.got(";")
                if self.i == start:
                    self.i += 1

    def simple(self) -> bool:
        """A simple statement; True if it is a range clause."""
        if self.t[self.i] == "range":
            self.i += 1
            self.expr()
            return True
        self.exprs()
        x = self.t[self.i]
        if x in ASSIGN:
            self.i += 1
            if x in ("=", ":=") and self.got("range"):
                self.expr()
                return True
            self.exprs()
        elif x in ("++", "--"):
            self.i += 1
        elif x == "<-":
            self.i += 1
            self.expr()
        return False

    def statement(self) -> None:
        x = self.t[self.i]
        if x in ("var", "const", "type"):
            self.declaration()
        elif x == "{":
            self.block()
        elif x == "if":
            self.if_()
        elif x == "for":
            self.i += 1
            save, self.level = self.level, -1
            if self.t[self.i] != "{":
                ranged = False
                if self.t[self.i] != ";":
                    ranged = self.simple()
                if not ranged and self.t[self.i] == ";":
                    self.i += 1
                    if self.t[self.i] != ";":
                        if self.t[self.i] == "{":
                            self.fail("the clauses of a loop")
                        self.simple()
                    self.eat(";")
                    if self.t[self.i] != "{":
                        self.simple()
            self.level = save
            self.nested(self.block)
        elif x == "switch":
            self.i += 1
            save, self.level = self.level, -1
            if self.t[self.i] != "{":
                if self.t[self.i] != ";":
                    self.simple()
                if self.got(";") and self.t[self.i] != "{":
                    self.simple()
            self.level = save
            self.cases()
        elif x == "select":
            self.i += 1
            self.cases()
        elif x in ("go", "defer"):
            self.i += 1
            self.expr()
        elif x == "return":
            self.i += 1
            if self.t[self.i] not in (";", "}"):
                self.exprs()
        elif x in ("break", "continue", "goto"):
            self.i += 1
            self.got("ID") or (x == "goto" and self.eat("ID"))
        elif x == "fallthrough":
            self.i += 1
        elif x == "ID" and self.t[self.i + 1] == ":":
            self.i += 2
            if self.t[self.i] not in ("}", ";"):
                self.statement()
        elif x == ";":
            pass
        elif x == "func" and self.t[self.i + 1] == "ID":
            self.i += 1
            self.fail("( of a function literal")
        else:
            self.simple()

    def if_(self) -> None:
        # a chain of else if is flat: a loop, however long it is
        while True:
            self.eat("if")
            save, self.level = self.level, -1
            if self.t[self.i] == "{":
                self.fail("a condition")
            if self.t[self.i] != ";":
                self.simple()
            if self.got(";"):
                self.simple()
            self.level = save
            self.nested(self.block)
            if not self.got("else"):
                return
            if self.t[self.i] != "if":
                self.nested(self.block)
                return

    def cases(self) -> None:
        self.eat("{")
        save, self.level = self.level, 0
        while self.t[self.i] != "}":
            if self.got("case"):
                self.simple_or_types()
            else:
                self.eat("default")
            self.eat(":")
            self.statements(("case", "default", "}"))
            if self.t[self.i] == "EOF":
                self.fail("}")
        self.i += 1
        self.level = save

    def simple_or_types(self) -> None:
        self.exprs()
        if self.t[self.i] in ("=", ":="):
            self.i += 1
            self.exprs()
        elif self.got("<-"):
            self.expr()

    # declarations

    def declaration(self) -> None:
        x = self.t[self.i]
        self.i += 1
        one = {"var": self.var, "const": self.const, "type": self.type_spec, "import": self.import_}[x]
        if self.got("("):
            while self.t[self.i] != ")":
                one()
                if self.t[self.i] != ")":
                    self.eat(";")
            self.i += 1
        else:
            one()

    def var(self) -> None:
        self.eat("ID")
        while self.got(","):
            self.eat("ID")
        if self.t[self.i] != "=":
            self.type_()
        if self.got("="):
            self.exprs()

    def const(self) -> None:
        self.eat("ID")
        while self.got(","):
            self.eat("ID")
        if self.t[self.i] not in ("=", ";", ")"):
            self.type_()
        if self.got("="):
            self.exprs()

    def type_spec(self) -> None:
        self.eat("ID")
        if self.t[self.i] == "[" and self.t[self.i + 1] == "ID" and self.peek(2) not in ("]",):
            save, errors = self.i, len(self.errors)
            try:
                self.type_params()
            except Panic:
                self.i = save
                del self.errors[errors:]
        self.got("=")
        self.type_()

    def import_(self) -> None:
        self.got("ID") or self.got(".")
        self.eat("STR")

    def file(self) -> None:
        try:
            self.eat("package")
            self.eat("ID")
            if self.t[self.i] != "EOF":
                self.eat(";")
        except Panic:
            self.skip_to((";",))
            self.got(";")
        imports = True
        while self.t[self.i] != "EOF":
            start = self.i
            try:
                x = self.t[self.i]
                if x == "func":
                    self.i += 1
                    if self.t[self.i] == "(":
                        self.params()
                    self.eat("ID")
                    if self.t[self.i] == "[":
                        self.type_params()
                    self.signature()
                    if self.t[self.i] == "{":
                        self.block()
                elif x == "import":
                    if not imports:
                        self.fail("imports before other declarations")
                    self.declaration()
                elif x in ("var", "const", "type"):
                    self.declaration()
                else:
                    self.fail("a declaration")
                imports = imports and x == "import"
                if self.t[self.i] != "EOF":
                    self.eat(";")
            except Panic:
                self.level = 0
                self.skip_to((";",))
                self.got(";")
                if self.i == start:
                    self.i += 1


def go_errors(src: str) -> list[tuple[int, str]]:
    p = Go(*tokenize(src[1:] if src.startswith("\ufeff") else src))
    p.file()
    if not p.errors and "BAD" in p.t:
        j = p.t.index("BAD")
        p.errors.append((p.at[j], p.v[j]))
    if "\x00" in src and not p.errors:
        p.errors.append((src.index("\x00"), "NUL"))
    return p.errors
