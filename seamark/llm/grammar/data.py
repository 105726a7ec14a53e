"""JSON and TOML."""

from __future__ import annotations

import re

from seamark.functions.worker import resource
from seamark.llm.grammar.base import Panic, Parser


def _json_rx():
    return re.compile(
        r'(?P<w>[ \t\n\r]+)|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<k>true|false|null)(?!\w)|(?P<op>[{}\[\]:,])|(?P<BAD>.)', re.S | re.A
    )


class Json(Parser):
    def value(self) -> None:
        # nesting of any depth: an explicit stack instead of recursion
        t = self.t
        stack: list[str] = []
        while True:
            x = t[self.i]
            if x == "{":
                self.i += 1
                if t[self.i] == "}":
                    self.i += 1
                else:
                    self.eat("STR")
                    self.eat(":")
                    stack.append("}")
                    continue
            elif x == "[":
                self.i += 1
                if t[self.i] == "]":
                    self.i += 1
                else:
                    stack.append("]")
                    continue
            elif x in ("STR", "NUM", "true", "false", "null"):
                self.i += 1
            else:
                self.fail("a value")
            while stack:
                if self.got(","):
                    if stack[-1] == "}":
                        self.eat("STR")
                        self.eat(":")
                    break
                self.eat(stack.pop())
            else:
                return

    def file(self) -> None:
        try:
            self.value()
            if self.t[self.i] != "EOF":
                self.fail("the end")
        except Panic:
            pass


def json_errors(src: str) -> list[tuple[int, str]]:
    t, v, at = [], [], []
    for m in resource("grammar.json", _json_rx).finditer(src):
        k = m.lastgroup
        if k == "w":
            continue
        x = m.group()
        t.append(x if k in ("k", "op") else k)
        v.append(x if k != "BAD" else f"stray {x!r}")
        at.append(m.start())
    t.append("EOF"), v.append(""), at.append(len(src))
    p = Json(t, v, at)
    p.file()
    return p.errors


_TOML_STR = r'"""(?:[^"\\]|\\(?:[btnfre"\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[ \t]*\r?\n\s*)|""?(?!"))*+"""(?:""?(?!"))?|\'\'\'(?:[^\']|\'\'?(?!\'))*+\'\'\'(?:\'\'?(?!\'))?'
_TOML_LINE = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfre"\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}))*+"|\'[^\'\x00-\x08\x0a-\x1f\x7f]*+\''


def _toml_rx():
    return re.compile(
        rf"(?P<w>[ \t]+|\#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)|(?P<NL>\r?\n)|(?P<ML>{_TOML_STR})|(?P<STR>{_TOML_LINE})|(?P<BARE>[A-Za-z0-9_+\-][A-Za-z0-9_+\-:]*(?:(?<=\d)[ Tt](?=\d\d:)[\d:]+)?)|(?P<op>[\[\]{{}}.,=])|(?P<BAD>.)"
    )


_TOML_VALUE = r"true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)[eE][+-]?\d(?:_?\d)*|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d)?"
_TOML_FRACTION = r"\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?(?:[Zz]|[+-]\d\d:\d\d)?"


class Toml(Parser):
    def key(self) -> None:
        while True:
            x = self.t[self.i]
            if x == "BARE":
                if re.search(r"[:+ ]", self.v[self.i]):
                    self.fail("a key")
                self.i += 1
            elif x == "STR":
                self.i += 1
            else:
                self.fail("a key")
            if not self.got("."):
                return

    def value(self) -> None:
        x = self.t[self.i]
        if x in ("STR", "ML"):
            self.i += 1
        elif x == "BARE":
            if not re.fullmatch(_TOML_VALUE, self.v[self.i]):
                self.fail("a value")
            number = self.v[self.i]
            self.i += 1
            if self.t[self.i] == "." and re.search(r"\d$", number):
                self.i += 1
                if self.t[self.i] != "BARE" or not re.fullmatch(_TOML_FRACTION, self.v[self.i]):
                    self.fail("the digits of a fraction")
                self.i += 1
        elif x == "[":
            self.i += 1
            while True:
                while self.got("NL"):
                    pass
                if self.got("]"):
                    break
                self.value()
                while self.got("NL"):
                    pass
                if not self.got(","):
                    self.eat("]")
                    break
        elif x == "{":
            self.i += 1
            if not self.got("}"):
                while True:
                    self.key()
                    self.eat("=")
                    self.value()
                    if not self.got(","):
                        break
                self.eat("}")
        else:
            self.fail("a value")

    def file(self) -> None:
        while self.t[self.i] != "EOF":
            if self.got("NL"):
                continue
            try:
                if self.got("["):
                    double = self.t[self.i] == "[" and self.at[self.i] == self.at[self.i - 1] + 1
                    if double:
                        self.i += 1
                    self.key()
                    self.eat("]")
                    if double:
                        self.eat("]")
                else:
                    self.key()
                    self.eat("=")
                    self.value()
                if self.t[self.i] != "EOF":
                    self.eat("NL")
            except Panic:
                while self.t[self.i] not in ("NL", "EOF"):
                    self.i += 1


def toml_errors(src: str) -> list[tuple[int, str]]:
    t, v, at = [], [], []
    for m in resource("grammar.toml", _toml_rx).finditer(src):
        k = m.lastgroup
        if k == "w":
            continue
        x = m.group()
        t.append(x if k == "op" else k)
        v.append(x if k != "BAD" else f"stray {x!r}")
        at.append(m.start())
    t.append("EOF"), v.append(""), at.append(len(src))
    p = Toml(t, v, at)
    p.file()
    return p.errors
