"""TypeScript: statements, declarations and types by recursive descent, binary expressions by precedence climbing, semicolons by line ends."""

from __future__ import annotations

import re

from seamark.functions.worker import resource
from seamark.llm.grammar.base import Panic, Parser

RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
BIN = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7,
    "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
VALUES = frozenset(("ID", "NUM", "STR", "TPL", "RE", ")", "]", "}", "this", "super", "true", "false", "null", "++", "--", "PRIV"))
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())
MATES = {"(": ")", "[": "]", "{": "}"}


def _rx() -> dict:
    name = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4})*"
    return {
        "tok": re.compile(
            r"(?P<w>[ \t\f\v\xa0\ufeff]+)|(?P<nl>[\r\n\u2028\u2029]+)|(?P<lc>//[^\r\n\u2028\u2029]*)|(?P<bc>/\*(?:[^*]+|\*(?!/))*+\*/)"
            r"|(?P<STR>\"(?:[^\"\\\r\n]+|\\(?:\r\n|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^ux]))*+\"|'(?:[^'\\\r\n]+|\\(?:\r\n|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^ux]))*+')|(?P<t>`)"
            rf"|(?P<NUM>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*|(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:[eE][+-]?\d+)?|\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?)n?(?![\w$]))|(?P<ID>{name})|(?P<PRIV>\#{name})"
            r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.@(){}\[\]])|(?P<BAD>.)", re.S),
        "re": re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"),
        "tpl": re.compile(r"(?:[^`\\$]+|\\.|\$(?!\{))*+(`|\$\{)", re.S),
    }


def tokenize(src: str, start: int = 0, inner: bool = False):
    """Types, texts, places, line flags; of a template also the place behind the brace that closes its field."""
    rx = resource("grammar.ts", _rx)
    match, regex = rx["tok"].match, rx["re"].match
    t: list[str] = []
    v: list[str] = []
    at: list[int] = []
    nl: list[bool] = []
    pos, n, new, level = start, len(src), False, 0
    last = ""

    def add(a: str, b: str, p: int) -> None:
        nonlocal new, last
        t.append(a)
        v.append(b)
        at.append(p)
        nl.append(new)
        new, last = False, a

    if not start and src.startswith("#!"):
        m = re.compile(r"[^\r\n]*").match(src)
        pos = m.end()
    while pos < n:
        m = match(src, pos)
        k, x, s = m.lastgroup, m.group(), pos
        pos = m.end()
        if k == "w" or k == "lc":
            continue
        if k == "nl":
            new = True
            continue
        if k == "bc":
            new = new or "\n" in x
            continue
        if k == "op":
            if x in ("/", "/=") and last not in VALUES:
                y = regex(src, s)
                if y:
                    pos = y.end()
                    add("RE", y.group(), s)
                    continue
            if inner:
                if x == "{":
                    level += 1
                elif x == "}":
                    if level == 0:
                        add("EOF", "", s)
                        return t, v, at, nl, pos
                    level -= 1
            add(x, x, s)
        elif k == "ID":
            add(x if x in RESERVED else "ID", x, s)
        elif k == "t":
            # a template: its fields are parsed on their own
            fields = []
            while True:
                y = rx["tpl"].match(src, pos)
                if not y:
                    add("BAD", "unterminated template", s)
                    pos = n
                    break
                pos = y.end()
                if y.group(1) == "`":
                    add("TPL", fields, s)
                    break
                sub = tokenize(src, pos, True)
                fields.append(sub[:4])
                if sub[4] < 0:
                    add("BAD", "unterminated template", s)
                    pos = n
                    break
                pos = sub[4]
        elif k == "BAD":
            add(k, "unterminated string" if x in "\"'" else f"stray {x!r}", s)
        else:
            add(k, x, s)
    new = True
    add("EOF", "", n)
    return t, v, at, nl, -1


class TypeScript(Parser):
    def __init__(self, types, texts, places, lines):
        super().__init__(types, texts, places)
        self.nl = lines
        self.no_in = False
        self.no_conditional = False
        self.plain = False
        self.mates: dict[int, int] | None = None

    def fail(self, what: str):
        i = min(self.i, len(self.t) - 1)
        if self.t[i] == "TPL":
            self.errors.append((self.at[i], f"expected {what}, found a template"))
            raise Panic
        super().fail(what)

    def word(self, w: str, k: int = 0) -> bool:
        j = self.i + k
        return self.t[j] == "ID" and self.v[j] == w

    def attempt(self, f) -> bool:
        """Run ``f``; on an error go back as if it hadn't been tried."""
        i, errors, a, b, c = self.i, len(self.errors), self.no_in, self.no_conditional, self.plain
        try:
            f()
            return True
        except Panic:
            self.i, self.no_in, self.no_conditional, self.plain = i, a, b, c
            del self.errors[errors:]
            return False

    def end(self) -> None:
        """The end of a statement: a semicolon, a line end, a closing brace."""
        if self.got(";") or self.t[self.i] in ("}", "EOF") or self.nl[self.i]:
            return
        self.fail("; or a line end")

    def name(self) -> None:
        if self.t[self.i] == "ID" or self.t[self.i] in RESERVED:
            self.i += 1
        else:
            self.fail("a name")

    def close_angle(self) -> None:
        x = self.t[self.i]
        if x == ">":
            self.i += 1
        elif x.startswith(">") and x in (">>", ">>>", ">=", ">>=", ">>>="):
            self.t[self.i] = self.v[self.i] = x[1:]
        else:
            self.fail(">")

    # types

    def type_(self) -> None:
        if self.is_function_type():
            self.function_type()
        else:
            self.union()
            if not self.no_conditional and self.t[self.i] == "extends" and not self.nl[self.i]:
                self.i += 1
                save, self.no_conditional = self.no_conditional, True
                self.type_()
                self.no_conditional = save
                self.eat("?")
                save, self.no_conditional = self.no_conditional, False
                self.type_()
                self.eat(":")
                self.type_()
                self.no_conditional = save

    def is_function_type(self) -> bool:
        x = self.t[self.i]
        if x == "<" or x == "new" or (self.word("abstract") and self.t[self.i + 1] == "new"):
            return True
        if x != "(":
            return False
        a, b = self.t[self.i + 1], self.peek(2)
        if a in (")", "..."):
            return a == "..." or self.peek(2) == "=>"
        if a in ("ID", "this"):
            if b in (":", ",", "?", "="):
                return True
            return b == ")" and self.peek(3) == "=>"
        if a in ("{", "["):
            j = self.mate(self.i + 1)
            return self.t[j + 1] in (":", ",", "?", "=") or (self.t[j + 1] == ")" and self.t[min(j + 2, len(self.t) - 1)] == "=>")
        return False

    def mate(self, i: int) -> int:
        """Where the bracket at ``i`` closes; all pairs are found in one pass when the first is asked for."""
        if self.mates is None:
            self.mates, open_ = {}, []
            for k, x in enumerate(self.t):
                if x in ("(", "[", "{"):
                    open_.append(k)
                elif x in (")", "]", "}") and open_:
                    self.mates[open_.pop()] = k
        return self.mates.get(i, len(self.t) - 2)

    def function_type(self) -> None:
        if self.word("abstract"):
            self.i += 1
        self.got("new")
        self.type_params()
        self.params()
        self.eat("=>")
        self.return_type()

    def return_type(self) -> None:
        if self.word("asserts") and self.t[self.i + 1] in ("ID", "this") and not self.nl[self.i + 1]:
            self.i += 2
            if self.word("is"):
                self.i += 1
                self.type_()
            return
        if self.t[self.i] in ("ID", "this") and self.word("is", 1) and not self.nl[self.i + 1]:
            self.i += 2
        self.type_()

    def union(self) -> None:
        if self.t[self.i] in ("|", "&"):
            self.i += 1
        while True:
            if self.is_function_type():
                self.function_type()
            else:
                self.postfix_type()
            if self.t[self.i] not in ("|", "&"):
                return
            self.i += 1

    def postfix_type(self) -> None:
        while (self.t[self.i] == "ID" and self.v[self.i] in ("keyof", "unique", "readonly", "infer") and not self.nl[self.i + 1] and self.t[self.i + 1] in ("ID", "[", "(", "{", "typeof", "this", "STR", "void", "null")) and True:
            infer = self.v[self.i] == "infer"
            self.i += 1
            if infer:
                self.eat("ID")
                if self.t[self.i] == "extends":
                    self.attempt(self.infer_bound)
                self.i -= 1
                break
        x = self.t[self.i]
        if x == "ID":
            self.i += 1
            while self.got("."):
                self.name()
            if self.t[self.i] in ("<", "<<") and not self.nl[self.i]:
                self.type_args()
        elif x in ("STR", "NUM", "true", "false", "null", "void", "this"):
            self.i += 1
        elif x == "TPL":
            for f in self.v[self.i]:
                self.field(f, True)
            self.i += 1
        elif x == "-":
            self.i += 1
            self.eat("NUM")
        elif x == "typeof":
            self.i += 1
            if self.t[self.i] == "import":
                self.import_type()
            else:
                self.got("this") or self.eat("ID")
                while self.got("."):
                    self.got("PRIV") or self.name()
                if self.t[self.i] == "<" and not self.nl[self.i]:
                    self.type_args()
        elif x == "import":
            self.import_type()
        elif x == "(":
            self.i += 1
            save, self.no_conditional = self.no_conditional, False
            self.type_()
            self.no_conditional = save
            self.eat(")")
        elif x == "[":
            self.i += 1
            save, self.no_conditional = self.no_conditional, False
            while self.t[self.i] != "]":
                self.got("...")
                if self.t[self.i] == "ID" and (self.t[self.i + 1] == ":" or (self.t[self.i + 1] == "?" and self.peek(2) == ":")):
                    self.i += 1
                    self.got("?")
                    self.eat(":")
                self.type_()
                self.got("?")
                if not self.got(","):
                    break
            self.no_conditional = save
            self.eat("]")
        elif x == "{":
            save, self.no_conditional = self.no_conditional, False
            self.members_type()
            self.no_conditional = save
        else:
            self.fail("a type")
        while not self.nl[self.i]:
            if self.t[self.i] == "[":
                self.i += 1
                if self.t[self.i] != "]":
                    self.type_()
                self.eat("]")
            elif self.t[self.i] == "!" and self.t[self.i + 1] not in ("ID", "("):
                self.i += 1
            else:
                break

    def infer_bound(self) -> None:
        self.i += 1
        save, self.no_conditional = self.no_conditional, True
        self.type_()
        self.no_conditional = save
        if self.t[self.i] == "?":
            self.fail("no condition")

    def import_type(self) -> None:
        self.eat("import")
        self.eat("(")
        self.eat("STR")
        if self.got(","):
            self.assignment()
        self.eat(")")
        while self.got("."):
            self.name()
        if self.t[self.i] == "<":
            self.type_args()

    def type_args(self) -> None:
        if self.t[self.i] == "<<":
            self.t[self.i] = self.v[self.i] = "<"
        else:
            self.eat("<")
        save, self.no_conditional = self.no_conditional, False
        while True:
            self.type_()
            if not self.got(","):
                break
        self.no_conditional = save
        self.close_angle()

    def type_params(self) -> None:
        if not self.got("<"):
            return
        save, self.no_conditional = self.no_conditional, False
        while not self.t[self.i].startswith(">"):
            while self.t[self.i] in ("const", "in") or (self.word("out") and self.t[self.i + 1] == "ID"):
                self.i += 1
            self.eat("ID")
            if self.got("extends"):
                self.type_()
            if self.got("="):
                self.type_()
            if not self.got(","):
                break
        self.no_conditional = save
        self.close_angle()

    def members_type(self) -> None:
        """The body of an object type or interface; a mapped type too."""
        self.eat("{")
        while self.t[self.i] != "}":
            x = self.t[self.i]
            if x in ("+", "-") and self.word("readonly", 1):
                self.i += 2
                x = self.t[self.i]
            elif self.word("readonly") and self.t[self.i + 1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
                x = self.t[self.i]
            if x == "[":
                self.i += 1
                if self.t[self.i] == "ID" and self.t[self.i + 1] in (":", "in"):
                    self.i += 1
                    if self.got("in"):
                        self.type_()
                        if self.word("as"):
                            self.i += 1
                            self.type_()
                    else:
                        self.i += 1
                        self.type_()
                else:
                    self.assignment()
                self.eat("]")
                if self.t[self.i] in ("+", "-"):
                    self.i += 1
                self.got("?")
                if self.t[self.i] in ("(", "<"):
                    self.type_params()
                    self.params()
                if self.got(":"):
                    self.return_type()
            elif x in ("(", "<"):
                self.type_params()
                self.params()
                if self.got(":"):
                    self.return_type()
            else:
                if x == "new" and self.t[self.i + 1] in ("(", "<"):
                    self.i += 1
                else:
                    if (self.word("get") or self.word("set")) and (self.t[self.i + 1] in ("ID", "STR", "[", "NUM") or self.t[self.i + 1] in RESERVED):
                        self.i += 1
                    if self.t[self.i] in ("STR", "NUM", "PRIV"):
                        self.i += 1
                    else:
                        self.name()
                    self.got("?")
                if self.t[self.i] in ("(", "<"):
                    self.type_params()
                    self.params()
                if self.got(":"):
                    self.return_type()
            if not (self.got(";") or self.got(",")) and self.t[self.i] != "}" and not self.nl[self.i]:
                self.fail("; or }")
        self.i += 1

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.got(","):
            self.assignment()

    def inside(self, f) -> None:
        save, self.no_in = self.no_in, False
        f()
        self.no_in = save

    def assignment(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "ID":
            w = self.v[self.i]
            if t[self.i + 1] == "=>" and not self.nl[self.i + 1]:
                self.i += 1
                self.arrow_tail()
                return
            if w == "async" and not self.nl[self.i + 1]:
                if t[self.i + 1] == "ID" and self.peek(2) == "=>":
                    self.i += 2
                    self.arrow_tail()
                    return
                if t[self.i + 1] in ("(", "<") and self.attempt(self.async_head):
                    self.arrow_tail()
                    return
            if w == "yield":
                self.i += 1
                if not self.nl[self.i] and t[self.i] not in (")", "]", "}", ",", ";", ":", "EOF", "in"):
                    self.got("*")
                    self.assignment()
                return
        elif x == "(":
            j = self.mate(self.i)
            after = t[j + 1] if j + 1 < len(t) else "EOF"
            if (after == "=>" or (after == ":" and not self.plain)) and self.attempt(self.arrow_head):
                self.arrow_tail()
                return
        elif x == "<":
            if self.attempt(self.arrow_head):
                self.arrow_tail()
                return
        target = self.binary(1)
        y = t[self.i]
        if y == "?":
            self.i += 1
            save, self.plain = self.plain, False
            if not self.attempt(self.first_choice):
                # brackets and a colon there are no arrow function with a type
                self.plain = True
                self.inside(self.assignment)
            self.plain = save
            self.eat(":")
            self.assignment()
        elif y in ASSIGN:
            if not target:
                self.fail("a target before the assignment")
            self.i += 1
            self.assignment()

    def first_choice(self) -> None:
        self.inside(self.assignment)
        if self.t[self.i] != ":":
            self.fail(":")

    def async_head(self) -> None:
        self.i += 1
        self.arrow_head()

    def arrow_head(self) -> None:
        self.type_params()
        self.params()
        if self.got(":"):
            self.return_type()
        if self.nl[self.i] or self.t[self.i] != "=>":
            self.fail("=> on the same line")

    def arrow_tail(self) -> None:
        self.eat("=>")
        if self.t[self.i] == "{":
            self.inside(self.block)
        else:
            self.assignment()

    def binary(self, least: int) -> bool:
        """True if the expression may be the target of an assignment."""
        t = self.t
        target = self.unary()
        while True:
            x = t[self.i]
            if x == "ID" and self.v[self.i] in ("as", "satisfies") and not self.nl[self.i]:
                if 8 < least:
                    return target
                self.i += 1
                if self.t[self.i] == "const":
                    self.i += 1
                else:
                    self.type_()
                continue
            p = BIN.get(x, 0)
            if p < least or not p or (x == "in" and self.no_in):
                return target
            self.i += 1
            self.binary(p if p == 12 else p + 1)
            target = False

    def unary(self) -> bool:
        t = self.t
        x = t[self.i]
        if x in ("!", "~", "+", "-", "typeof", "void", "delete", "++", "--") or (x == "ID" and self.v[self.i] == "await" and not (t[self.i + 1] in (")", ",", ";", ".", "=", "=>", "}", "]", ":"))):
            self.i += 1
            self.unary()
            return False
        if x == "<":
            self.i += 1
            if not self.got("const"):
                self.type_()
            self.close_angle()
            self.unary()
            return False
        target = self.postfix()
        if t[self.i] in ("++", "--") and not self.nl[self.i]:
            if not target:
                self.fail("a target")
            self.i += 1
            return False
        return target

    def postfix(self) -> bool:
        t = self.t
        if t[self.i] == "new":
            target = self.new()
        else:
            target = self.primary()
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.got("PRIV") or self.name()
                target = True
            elif x == "?.":
                self.i += 1
                if t[self.i] == "(":
                    self.args()
                elif t[self.i] == "[":
                    self.i += 1
                    self.inside(self.expression)
                    self.eat("]")
                elif t[self.i] == "<":
                    self.type_args()
                    self.args()
                else:
                    self.got("PRIV") or self.name()
                target = True
            elif x == "[":
                self.i += 1
                self.inside(self.expression)
                self.eat("]")
                target = True
            elif x == "(":
                self.args()
                target = False
            elif x == "!" and not self.nl[self.i]:
                self.i += 1
            elif x == "TPL":
                self.template()
                target = False
            elif x in ("<", "<<") and self.attempt(self.generic_call):
                target = False
            else:
                return target

    def generic_call(self) -> None:
        self.type_args()
        x = self.t[self.i]
        if x == "(" or x == "TPL":
            return
        if not (x in (")", "]", "}", ",", ";", ":", "EOF", ".", "?.", "===", "==", "!==", "!=", "&&", "||", "??", "=", "?") or self.nl[self.i]):
            self.fail("a call")

    def new(self) -> bool:
        self.i += 1
        if self.got("."):
            self.name()
            return True
        if self.t[self.i] == "new":
            self.new()
        else:
            self.primary()
        while True:
            x = self.t[self.i]
            if x == ".":
                self.i += 1
                self.got("PRIV") or self.name()
            elif x == "[":
                self.i += 1
                self.inside(self.expression)
                self.eat("]")
            elif x == "TPL":
                self.template()
            elif x == "<" and self.attempt(self.type_args):
                pass
            else:
                break
        if self.t[self.i] == "(":
            self.args()
        return False

    def args(self) -> None:
        self.eat("(")
        save, self.no_in = self.no_in, False
        while self.t[self.i] != ")":
            self.got("...")
            self.assignment()
            if not self.got(","):
                break
        self.no_in = save
        self.eat(")")

    def field(self, tokens, is_type: bool = False) -> None:
        sub = TypeScript(*tokens)
        try:
            sub.type_() if is_type else sub.expression()
            if sub.t[sub.i] != "EOF":
                sub.fail("the end of the field")
        except Panic:
            self.errors.extend(sub.errors)
            raise
        self.errors.extend(sub.errors)

    def template(self) -> None:
        for f in self.v[self.i]:
            self.field(f)
        self.i += 1

    def primary(self) -> bool:
        t = self.t
        x = t[self.i]
        if x == "ID":
            if self.v[self.i] == "async" and t[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.i += 1
                self.function()
                return False
            if self.v[self.i] == "abstract" and t[self.i + 1] == "class":
                self.i += 1
                self.class_()
                return False
            self.i += 1
            return True
        if x in ("NUM", "STR", "RE", "true", "false", "null"):
            self.i += 1
            return False
        if x in ("this", "super"):
            self.i += 1
            return False
        if x == "TPL":
            self.template()
            return False
        if x == "(":
            self.i += 1
            save, self.no_in = self.no_in, False
            a = self.i
            self.expression()
            self.no_in = save
            self.eat(")")
            return t[a] == "ID" or t[self.i - 2] in ("]", "ID")
        if x == "[":
            self.i += 1
            save, self.no_in = self.no_in, False
            while t[self.i] != "]":
                if self.got(","):
                    continue
                self.got("...")
                self.assignment()
                if not self.got(","):
                    break
            self.no_in = save
            self.eat("]")
            return True
        if x == "{":
            self.inside(self.object)
            return True
        if x == "function":
            self.function()
            return False
        if x == "class":
            self.class_()
            return False
        if x == "@":
            self.decorators()
            self.class_()
            return False
        if x == "import":
            self.i += 1
            if self.got("."):
                self.name()
            elif t[self.i] == "(":
                self.args()
            else:
                self.fail("a call of import")
            return False
        if x == "PRIV" and t[self.i + 1] == "in":
            self.i += 1
            return False
        self.fail("an expression")
        return False

    def property_name(self) -> None:
        if self.got("["):
            self.inside(self.assignment)
            self.eat("]")
        elif self.t[self.i] in ("STR", "NUM", "PRIV"):
            self.i += 1
        else:
            self.name()

    def object(self) -> None:
        t = self.t
        self.eat("{")
        while t[self.i] != "}":
            if self.got("..."):
                self.assignment()
            else:
                if self.got("*"):
                    self.property_name()
                    self.method()
                else:
                    if t[self.i] == "ID" and self.v[self.i] in ("get", "set", "async") and t[self.i + 1] not in (",", ":", "(", "}", "=", "<"):
                        self.i += 1
                        self.got("*")
                        self.property_name()
                        self.method()
                    else:
                        plain = t[self.i] == "ID"
                        self.property_name()
                        if t[self.i] in ("(", "<"):
                            self.method()
                        elif self.got(":"):
                            self.assignment()
                        elif plain:
                            if self.got("="):
                                self.assignment()
                        else:
                            self.fail(":")
            if not self.got(","):
                break
        self.eat("}")

    def method(self) -> None:
        self.type_params()
        self.params()
        if self.got(":"):
            self.return_type()
        self.block()

    def function(self, declaration: bool = False) -> None:
        self.eat("function")
        self.got("*")
        if self.t[self.i] == "ID":
            self.i += 1
        elif declaration:
            self.fail("a name")
        self.type_params()
        self.params()
        if self.got(":"):
            self.return_type()
        if self.t[self.i] == "{":
            self.inside(self.block)
        elif declaration:
            self.end()
        else:
            self.fail("{")

    def params(self) -> None:
        self.eat("(")
        save, self.no_in = self.no_in, False
        while self.t[self.i] != ")":
            self.decorators()
            while self.t[self.i] == "ID" and self.v[self.i] in MODIFIERS and self.t[self.i + 1] in ("ID", "{", "[", "this"):
                self.i += 1
            rest = self.got("...")
            if not self.got("this"):
                self.binding()
            self.got("?")
            if self.got(":"):
                self.type_()
            if self.got("="):
                self.assignment()
            if not self.got(","):
                break
            if rest and self.t[self.i] != ")":
                self.fail("the rest parameter to come last")
        self.no_in = save
        self.eat(")")

    def binding(self) -> None:
        x = self.t[self.i]
        if x == "ID":
            self.i += 1
        elif x == "[":
            self.i += 1
            while self.t[self.i] != "]":
                if self.got(","):
                    continue
                self.got("...")
                self.binding()
                if self.got("="):
                    self.assignment()
                if not self.got(","):
                    break
            self.eat("]")
        elif x == "{":
            self.i += 1
            while self.t[self.i] != "}":
                if self.got("..."):
                    self.binding()
                else:
                    plain = self.t[self.i] == "ID"
                    self.property_name()
                    if self.got(":"):
                        self.binding()
                    elif not plain:
                        self.fail(":")
                    if self.got("="):
                        self.assignment()
                if not self.got(","):
                    break
            self.eat("}")
        else:
            self.fail("a name or pattern")

    def decorators(self) -> None:
        while self.got("@"):
            if self.got("("):
                self.expression()
                self.eat(")")
            else:
                self.name()
                while self.got("."):
                    self.got("PRIV") or self.name()
                if self.t[self.i] == "<":
                    self.attempt(self.type_args)
                if self.t[self.i] == "(":
                    self.args()

    def class_(self, declaration: bool = False) -> None:
        self.eat("class")
        if self.t[self.i] == "ID" and not self.word("implements"):
            self.i += 1
        elif declaration and self.t[self.i] != "{" and self.t[self.i] != "extends":
            self.fail("a name")
        self.type_params()
        if self.got("extends"):
            self.postfix()
            if self.t[self.i] == "<":
                self.type_args()
        if self.word("implements"):
            self.i += 1
            while True:
                self.postfix_type()
                if not self.got(","):
                    break
        self.eat("{")
        save, self.no_in = self.no_in, False
        while self.t[self.i] != "}":
            if self.got(";"):
                continue
            if self.t[self.i] == "EOF":
                self.fail("}")
            self.member()
        self.no_in = save
        self.i += 1

    def member(self) -> None:
        t = self.t
        self.decorators()
        if self.word("static") and t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        while t[self.i] == "ID" and self.v[self.i] in MODIFIERS and t[self.i + 1] not in ("(", "=", ";", ":", "?", "!", "}", "<", ",") and not (self.nl[self.i + 1] and self.v[self.i] in ("async",)):
            self.i += 1
        self.got("*")
        if t[self.i] == "ID" and self.v[self.i] in ("get", "set") and t[self.i + 1] not in ("(", "=", ";", ":", "?", "!", "}", "<"):
            self.i += 1
        if t[self.i] == "[" and t[self.i + 1] == "ID" and self.peek(2) == ":":
            self.i += 3
            self.type_()
            self.eat("]")
            self.eat(":")
            self.type_()
            self.end()
            return
        self.property_name()
        self.got("?") or self.got("!")
        if t[self.i] in ("(", "<"):
            self.type_params()
            self.params()
            if self.got(":"):
                self.return_type()
            if t[self.i] == "{":
                self.block()
            else:
                self.end()
        else:
            if self.got(":"):
                self.type_()
            if self.got("="):
                self.assignment()
            self.end()

    # statements

    def block(self) -> None:
        self.eat("{")
        self.statements(("}",))
        self.eat("}")

    def statements(self, ends: tuple[str, ...]) -> None:
        while self.t[self.i] not in ends and self.t[self.i] != "EOF":
            start = self.i
            try:
                self.statement()
            except Panic:
                self.no_in, self.no_conditional = False, False
                self.skip_to((";", "}"))
                if not self.got(";") and not ends:
                    self.got("}")
                if self.i == start:
                    self.i += 1

    def variables(self) -> None:
        while True:
            pattern = self.t[self.i] != "ID"
            self.binding()
            self.got("!")
            if self.got(":"):
                self.type_()
            if self.got("="):
                self.assignment()
            if not self.got(","):
                return

    def statement(self) -> None:
        self._statement()

    def _statement(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x in ("var", "const"):
            self.i += 1
            if x == "const" and t[self.i] == "enum":
                self.enum()
                return
            self.variables()
            self.end()
        elif x == "function":
            self.function(True)
        elif x == "class":
            self.class_(True)
        elif x == "@":
            self.decorators()
            self.got("export")
            self.got("default")
            if self.word("abstract"):
                self.i += 1
            self.class_()
        elif x == "if":
            # a chain of else if is flat: a loop, however long it is
            self.i += 1
            self.condition()
            self.statement()
            while self.got("else"):
                if self.t[self.i] != "if":
                    self.statement()
                    break
                self.i += 1
                self.condition()
                self.statement()
        elif x == "for":
            self.for_()
        elif x == "while":
            self.i += 1
            self.condition()
            self.statement()
        elif x == "do":
            self.i += 1
            self.statement()
            self.eat("while")
            self.condition()
            self.got(";")
        elif x == "return":
            self.i += 1
            if t[self.i] not in (";", "}", "EOF") and not self.nl[self.i]:
                self.expression()
            self.end()
        elif x == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail("an expression on the same line")
            self.expression()
            self.end()
        elif x in ("break", "continue"):
            self.i += 1
            if not self.nl[self.i]:
                self.got("ID")
            self.end()
        elif x == "debugger":
            self.i += 1
            self.end()
        elif x == "try":
            self.i += 1
            self.block()
            caught = self.got("catch")
            if caught:
                if self.got("("):
                    self.binding()
                    if self.got(":"):
                        self.type_()
                    self.eat(")")
                self.block()
            if self.got("finally"):
                self.block()
            elif not caught:
                self.fail("catch or finally")
        elif x == "switch":
            self.i += 1
            self.condition()
            self.eat("{")
            while t[self.i] != "}":
                if self.got("case"):
                    self.expression()
                else:
                    self.eat("default")
                self.eat(":")
                self.statements(("case", "default", "}"))
                if t[self.i] == "EOF":
                    self.fail("}")
            self.i += 1
        elif x == "import" and t[self.i + 1] not in ("(", "."):
            self.import_()
        elif x == "export":
            self.export()
        elif x == "enum":
            self.enum()
        elif x == "with":
            self.i += 1
            self.condition()
            self.statement()
        elif x == "ID":
            self.id_statement()
        else:
            self.expression()
            self.end()

    def condition(self) -> None:
        self.eat("(")
        self.inside(self.expression)
        self.eat(")")

    def id_statement(self) -> None:
        t, w, y = self.t, self.v[self.i], self.t[self.i + 1]
        same = not self.nl[self.i + 1]
        if w == "let" and y in ("ID", "{", "["):
            self.i += 1
            self.variables()
            self.end()
        elif w == "type" and y == "ID" and same:
            self.i += 2
            self.type_params()
            self.eat("=")
            self.type_()
            self.end()
        elif w == "interface" and y == "ID" and same:
            self.i += 2
            self.type_params()
            if self.got("extends"):
                while True:
                    self.postfix_type()
                    if not self.got(","):
                        break
            self.members_type()
        elif w in ("namespace", "module") and y in ("ID", "STR") and same:
            self.i += 1
            self.got("STR") or self.eat("ID")
            while self.got("."):
                self.name()
            self.block() if t[self.i] == "{" else self.end()
        elif w == "global" and y == "{":
            self.i += 1
            self.block()
        elif w == "declare" and same and (y in ("function", "class", "const", "var", "enum", "import") or (y == "ID" and self.v[self.i + 1] in ("let", "namespace", "module", "type", "interface", "abstract", "global", "async"))):
            self.i += 1
            self.statement()
        elif w == "abstract" and y == "class" and same:
            self.i += 1
            self.class_(True)
        elif w == "async" and y == "function" and same:
            self.i += 1
            self.function(True)
        elif w == "using" and y == "ID" and same and self.peek(2) == "=":
            self.i += 1
            self.variables()
            self.end()
        elif y == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end()

    def for_(self) -> None:
        self.eat("for")
        if self.word("await"):
            self.i += 1
        self.eat("(")
        t = self.t
        self.no_in = True
        if t[self.i] in ("var", "const") or (self.word("let") and t[self.i + 1] in ("ID", "{", "[")):
            self.i += 1
            self.variables()
        elif t[self.i] != ";":
            self.expression()
        self.no_in = False
        if self.word("of"):
            self.i += 1
            self.assignment()
        elif self.got("in"):
            self.expression()
        else:
            self.eat(";")
            if t[self.i] != ";":
                self.expression()
            self.eat(";")
            if t[self.i] != ")":
                self.expression()
        self.eat(")")
        self.statement()

    def enum(self) -> None:
        self.eat("enum")
        self.eat("ID")
        self.eat("{")
        while self.t[self.i] != "}":
            self.property_name()
            if self.got("="):
                self.assignment()
            if not self.got(","):
                break
        self.eat("}")

    def specifiers(self) -> None:
        self.eat("{")
        while self.t[self.i] != "}":
            if self.word("type") and self.t[self.i + 1] in ("ID", "STR", "default") and not (self.word("as", 1) and self.peek(2) in (",", "}")):
                self.i += 1
            if not self.got("STR"):
                self.name()
            if self.word("as"):
                self.i += 1
                if not self.got("STR"):
                    self.name()
            if not self.got(","):
                break
        self.eat("}")

    def source(self) -> None:
        if not self.word("from"):
            self.fail("from")
        self.i += 1
        self.eat("STR")
        if self.t[self.i] == "with" or (self.word("assert") and not self.nl[self.i]):
            self.i += 1
            self.object()

    def import_(self) -> None:
        self.eat("import")
        if self.got("STR"):
            self.end()
            return
        if self.word("type") and self.t[self.i + 1] in ("ID", "{", "*") and not self.word("from", 1):
            self.i += 1
        if self.got("ID"):
            if self.got("="):
                if self.word("require"):
                    self.i += 1
                    self.eat("(")
                    self.eat("STR")
                    self.eat(")")
                else:
                    self.eat("ID")
                    while self.got("."):
                        self.name()
                self.end()
                return
            if self.got(","):
                self.import_clause()
        else:
            self.import_clause()
        self.source()
        self.end()

    def import_clause(self) -> None:
        if self.got("*"):
            if not self.word("as"):
                self.fail("as")
            self.i += 1
            self.eat("ID")
        else:
            self.specifiers()

    def export(self) -> None:
        t = self.t
        self.eat("export")
        x = t[self.i]
        if x == "default":
            self.i += 1
            if t[self.i] == "function" or (self.word("async") and t[self.i + 1] == "function"):
                if self.word("async"):
                    self.i += 1
                self.function()
            elif t[self.i] == "class" or (self.word("abstract") and t[self.i + 1] == "class"):
                if self.word("abstract"):
                    self.i += 1
                self.class_()
            elif t[self.i] == "@":
                self.decorators()
                self.class_()
            elif self.word("interface") and t[self.i + 1] == "ID":
                self.statement()
            else:
                self.assignment()
                self.end()
        elif x == "*":
            self.i += 1
            if self.word("as"):
                self.i += 1
                if not self.got("STR"):
                    self.name()
            self.source()
            self.end()
        elif x == "{" or (self.word("type") and t[self.i + 1] in ("{", "*")):
            if x != "{":
                self.i += 1
            if self.got("*"):
                if self.word("as"):
                    self.i += 1
                    self.name()
                self.source()
            else:
                self.specifiers()
                if self.word("from"):
                    self.source()
            self.end()
        elif x == "=":
            self.i += 1
            self.expression()
            self.end()
        elif self.word("as"):
            self.i += 1
            if not self.word("namespace"):
                self.fail("namespace")
            self.i += 1
            self.eat("ID")
            self.end()
        elif x == "import":
            self.import_()
        elif x in ("var", "const", "function", "class", "enum", "@") or (x == "ID" and self.v[self.i] in ("let", "type", "interface", "namespace", "module", "declare", "abstract", "async")):
            self.statement()
        else:
            self.fail("a declaration")

    def file(self) -> None:
        self.statements(())


def typescript_errors(src: str) -> list[tuple[int, str]]:
    p = TypeScript(*tokenize(src[1:] if src.startswith("\ufeff") else src)[:4])
    p.file()
    if not p.errors and "BAD" in p.t:
        j = p.t.index("BAD")
        p.errors.append((p.at[j], p.v[j]))
    return p.errors
