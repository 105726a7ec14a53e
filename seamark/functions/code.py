"""Units, imports and calls of languages, read from masked text by one table of declarations for each.

Comments and literals are blanked first, so that brackets and words in them don't count. Where blocks have braces a declaration ends where
its own block closes, or at its semicolon; in the other languages it goes on as far as its lines are further in, and takes in the line that
ends it. The result is that of a grammar on well-formed text; on broken text it is what still closes.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from seamark.functions.worker import resource

NAME = r"[^\W\d][\w$]*"
#: Extensions of each family of languages.
FAMILY = {
    "rs": "rust", "go": "go", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "ts", "js": "ts", "mjs": "ts", "cjs": "ts", "jsx": "ts", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "hxx": "c",
    "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sc": "scala", "php": "php", "phtml": "php", "dart": "dart",
    "sh": "bash", "bash": "bash", "zsh": "bash", "pl": "perl", "pm": "perl", "t": "perl", "psgi": "perl", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
    "rb": "ruby", "rake": "ruby", "lua": "lua", "ex": "elixir", "exs": "elixir", "hs": "haskell", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "vb": "vbnet",
}


@dataclass
class Spec:
    """How a family of languages declares things: (kind, pattern at the start of a line), kinds that hold methods, words that are no calls."""

    heads: list[tuple[str, str]]
    owners: tuple[str, ...] = ()
    methods: str | None = None
    joint: str = "."
    not_calls: frozenset[str] = field(default_factory=frozenset)
    enums: bool = False
    #: How the line begins that ends a declaration of a language without braces, None for braces.
    ends: str | None = None


#: Families whose declarations may end with their line.
BY_LINE = ("go", "kotlin", "swift", "scala")
_CONTROL = frozenset("pub import if for while switch match return catch when with else do try throw new typeof await yield case in is as and or not sizeof using lock fixed foreach elseif guard where super this defer go select range func fn function def class".split())
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|unsafe|extern|inline|open|data|inner|enum|annotation|suspend|operator|infix|tailrec|external|const|lateinit|implicit|lazy|case|mutating|nonmutating|convenience|required|fileprivate|indirect|dynamic|weak|volatile|synchronized|native|transient|strictfp|default|new|ref|late|covariant|factory|export|declare)\s+)*"
_PUB = r"(?:pub(?:\s*\([^)\n]*\))?\s+)?"


def _specs() -> dict[str, Spec]:
    rust = Spec([
        ("fn", rf"{_PUB}(?:(?:default|const|async|unsafe|safe|extern(?:\s+\"[^\"\n]*\")?)\s+)*fn\s+(?P<name>{NAME})"), ("struct", rf"{_PUB}struct\s+(?P<name>{NAME})"), ("enum", rf"{_PUB}enum\s+(?P<name>{NAME})"), ("union", rf"{_PUB}union\s+(?P<name>{NAME})\s*[<{{]"),
        ("trait", rf"{_PUB}(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<name>{NAME})"), ("impl", rf"(?:unsafe\s+)?impl\b(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:[^{{;]*?\bfor\s+)?(?:[&\w:]*::)?(?P<name>{NAME})"), ("mod", rf"{_PUB}mod\s+(?P<name>{NAME})"),
        ("macro", rf"macro_rules!\s*(?P<name>{NAME})"), ("const", rf"{_PUB}const\s+(?P<name>{NAME})\s*:"), ("static", rf"{_PUB}static\s+(?:mut\s+)?(?P<name>{NAME})\s*:"), ("type", rf"{_PUB}type\s+(?P<name>{NAME})"),
    ], ("impl", "trait"), joint="::", not_calls=_CONTROL, enums=True)
    ts = Spec([
        ("fn", rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<name>{NAME})"), ("class", rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{NAME})"),
        ("interface", rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<name>{NAME})"), ("type", rf"(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{NAME})\s*(?:<[^=;{{]*>)?\s*="), ("enum", rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{NAME})"),
        ("fn", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]+)?=>|{NAME}\s*=>|function\b)"),
    ], ("class",), rf"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set|declare)\s+)*[*#]?(?P<name>{NAME})\s*\??(?:<[^<>()\n]*>)?\(", not_calls=_CONTROL, enums=True)
    go = Spec([
        ("method", rf"func\s+\((?:[^()\n]*?[\s*])?(?P<owner>{NAME})(?:\[[^\]\n]*\])?\)\s*(?P<name>{NAME})"), ("fn", rf"func\s+(?P<name>{NAME})"), ("type", rf"type\s+(?P<name>{NAME})(?!\s*\()"), ("const", rf"const\s+(?P<name>{NAME})"), ("static", rf"var\s+(?P<name>{NAME})"),
    ], not_calls=_CONTROL)
    c = Spec([("struct", rf"(?:typedef\s+)?struct\s+(?P<name>{NAME})\s*(?::[^{{;]*)?(?={{)"), ("class", rf"(?:template\s*<[^>]*>\s*)?class\s+(?P<name>{NAME})\s*(?:final\s*)?(?::[^{{;]*)?(?={{)"), ("union", rf"(?:typedef\s+)?union\s+(?P<name>{NAME})\s*(?={{)"), ("enum", rf"(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>{NAME})\s*(?::[^{{;]*)?(?={{)"),
               ("mod", rf"(?:inline\s+)?namespace\s+(?P<name>{NAME})\s*(?={{)"), ("fn", rf"(?!(?:return|else|typedef|case|using|namespace|class|struct|enum|union|if|for|while|switch)\b)(?:[\w:<>,*&~\[\]]++\s++)*[*&]*(?:{NAME}::)*(?P<name>~?{NAME})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const|noexcept|override|final|\s|->\s*[\w:<>*&]+)*(?={{)")], ("class", "struct"), joint="::", not_calls=_CONTROL)
    java_like = lambda extra, word: Spec([("class", rf"{_MOD}(?:class|record|object)\s+(?P<name>{NAME})"), ("interface", rf"{_MOD}(?:interface|trait|protocol)\s+(?P<name>{NAME})"), ("enum", rf"{_MOD}enum\s+(?:class\s+)?(?P<name>{NAME})"), ("struct", rf"{_MOD}struct\s+(?P<name>{NAME})"), *extra], ("class", "interface", "enum", "struct", "impl"), word, not_calls=_CONTROL)
    typed = rf"{_MOD}(?:<[^<>{{}};]*>\s*)?(?!(?:return|else|throw|new|case|await|yield|assert)\b)(?:[\w.<>,?\[\]]+\s+)?(?P<name>{NAME})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)[^;{{}}=()]*(?=[{{;]|=>)"
    fun = lambda w: [("fn", rf"{_MOD}{w}\s+(?:<[^<>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>{NAME})")]
    return {
        "rust": rust, "ts": ts, "go": go, "c": c, "java": java_like([], typed), "csharp": java_like([("mod", rf"namespace\s+(?P<name>[\w.]+)")], typed), "dart": java_like([("fn", typed)], typed),
        "kotlin": java_like(fun("fun"), None), "swift": java_like([*fun("func"), ("impl", rf"{_MOD}extension\s+(?P<name>{NAME})")], None), "scala": java_like(fun("def"), None), "php": java_like([("fn", rf"{_MOD}function\s+&?(?P<name>{NAME})"), ("mod", r"namespace\s+(?P<name>[\w\\]+)")], None),
        "bash": Spec([("fn", r"(?:function\s+)?(?P<name>[\w:.-]+)\s*\(\)\s*(?=\{)"), ("fn", r"function\s+(?P<name>[\w:.-]+)\s*(?=\{)")]), "perl": Spec([("mod", r"package\s+(?P<name>[\w:]+)"), ("fn", rf"sub\s+(?P<name>{NAME})")], joint="::", not_calls=_CONTROL),
        "powershell": Spec([("class", rf"(?i:class)\s+(?P<name>{NAME})"), ("enum", rf"(?i:enum)\s+(?P<name>{NAME})"), ("fn", r"(?i:function|filter)\s+(?:\w+:)?(?P<name>[\w-]+)")], ("class",), not_calls=_CONTROL),
        "ruby": Spec([("class", r"class\s+(?P<name>[\w:]+)"), ("mod", r"module\s+(?P<name>[\w:]+)"), ("fn", r"(?:private\s+|protected\s+|public\s+)?def\s+(?:self\.)?(?P<name>[\w]+[?!=]?)")], ("class", "mod"), joint="::", ends=r"end\b", not_calls=_CONTROL),
        "lua": Spec([("fn", r"(?:local\s+)?function\s+(?P<name>[\w.:]+)"), ("fn", r"(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\b")], ends=r"end\b", not_calls=_CONTROL),
        "elixir": Spec([("mod", r"def(?:module|protocol|impl)\s+(?P<name>[\w.]+)"), ("macro", r"defmacrop?\s+(?P<name>\w+[?!]?)"), ("fn", r"defp?\s+(?P<name>\w+[?!]?)")], ends=r"end\b", not_calls=_CONTROL),
        "haskell": Spec([("class", r"class\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"), ("impl", r"instance\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"), ("enum", r"(?:data|newtype)\s+(?P<name>\w+)"), ("type", r"type\s+(?P<name>\w+)"), ("fn", r"(?P<name>[a-z_][\w']*)\s*::")], ends=r"(?!)"),
        "fsharp": Spec([("mod", r"(?:module|namespace)\s+(?:rec\s+)?(?P<name>[\w.]+)"), ("type", r"type\s+(?:private\s+|internal\s+)?(?P<name>\w+)"), ("fn", r"let\s+(?:rec\s+|inline\s+|private\s+|mutable\s+)*(?P<name>\w+)"), ("method", r"(?:static\s+)?(?:member|override)\s+(?:\w+\.)?(?P<name>\w+)")], ends=r"(?!)", not_calls=_CONTROL),
        "vbnet": Spec([("class", r"(?i:(?:public|private|friend|partial|mustinherit|notinheritable|\s)*class)\s+(?P<name>\w+)"), ("interface", r"(?i:(?:public|private|friend|\s)*interface)\s+(?P<name>\w+)"), ("enum", r"(?i:(?:public|private|friend|\s)*enum)\s+(?P<name>\w+)"), ("mod", r"(?i:(?:public|private|friend|\s)*(?:module|namespace))\s+(?P<name>[\w.]+)"), ("method", r"(?i:(?:public|private|protected|friend|shared|overridable|overrides|async|\s)*(?:sub|function))\s+(?P<name>\w+)")], ends=r"(?i:end)\b"),
    }


def _mask_rx() -> dict:
    dq, sq = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?"
    usual = rf"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|{dq}"
    return {
        "rust": re.compile(rf"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*(?:\*/)?|\b(?:b|c)?r(?P<h>\#*)\"(?:.*?)\"(?P=h)|(?:\b[bc])?\"(?:[^\"\\]|\\.)*\"?|'(?:\\(?:u\{{[^}}\n]*\}}|x..|.)|[^\\'\n])'", re.S),
        "ts": re.compile(rf"{usual}|{sq}|`(?:[^`\\]|\\.)*`?|(?<=[=(,:;!&|?\[{{}}\n])\s*/(?![/*\s])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S),
        "go": re.compile(rf"{usual}|`[^`]*`?|'(?:[^'\\\n]|\\.)+'", re.S),
        "php": re.compile(rf"#(?!\[)[^\n]*|{usual}|{sq}", re.S),
        **dict.fromkeys(("bash", "perl", "powershell", "ruby", "elixir"), re.compile(rf"<\#.*?\#>|(?m:^=begin\b.*?^=end\b)|(?<![$\w{{])\#[^\n]*|\"\"\".*?\"\"\"|{dq}|{sq}", re.S)),
        "lua": re.compile(rf"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|{dq}|{sq}", re.S), "haskell": re.compile(rf"\{{-.*?-\}}|--[^\n]*|{dq}", re.S), "fsharp": re.compile(rf"\(\*.*?\*\)|//[^\n]*|\"\"\".*?\"\"\"|{dq}", re.S), "vbnet": re.compile(r"'[^\n]*|\"(?:[^\"\n]|\"\")*\"?", re.S),
        "": re.compile(rf"{usual}|\"\"\"(?:.*?)\"\"\"|'(?:[^'\\\n]|\\.)'", re.S),
    }


def masked(text: str, family: str) -> str:
    """The text with comments and literals blanked; places and lines stay."""
    rx = resource("code.mask", _mask_rx)
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    return (rx.get(family) or rx[""]).sub(blank, text)


def mates(text: str) -> dict[int, int]:
    """Where each opening bracket closes; brackets that don't match are left out."""
    out, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", text):
        x = m.group()
        if x in "([{":
            stack.append((x, m.start()))
        elif stack and stack[-1][0] == close[x]:
            out[stack.pop()[1]] = m.start()
    return out


def _end(text: str, at: int, pairs: dict[int, int], by_line: bool) -> tuple[int, int | None]:
    """(end, place of the block) of a declaration whose head ends at ``at``."""
    while m := re.compile(r"[()\[\]{};\n]|=>").search(text, at):
        x = m.group()
        if x == "\n":
            if by_line:
                return m.start(), None
            at = m.end()
            continue
        if x == ";":
            return m.end(), None
        if x in ")]}":
            return m.start(), None
        if x == "{":
            close = pairs.get(m.start())
            if close is None:
                return len(text), m.start()
            return close + 1, m.start()
        at = pairs.get(m.start(), m.end()) + 1 if x in "([" else m.end()
    return len(text), None


@dataclass
class Unit:
    kind: str
    name: str
    qname: str
    start: int
    end: int
    body: int | None
    parent: int
    depth: int
    at: int


def family_of(path: str) -> str | None:
    return FAMILY.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def _variants(text: str, start: int, end: int, pairs: dict[int, int]) -> list[tuple[str, int, int]]:
    out, at = [], start + 1
    while at < end:
        m = re.compile(rf"\s*(?:#\[[^\]]*\]\s*)*(?P<name>{NAME})").match(text, at)
        if not m:
            break
        k = m.end()
        while k < end and text[k] != ",":
            k = pairs.get(k, k) + 1
        out.append((m.group("name"), m.start("name"), min(k, end)))
        at = k + 1
    return out


def code_units(text: str, family: str, most: int = 16) -> list[Unit]:
    """Declarations in order of place, containers before what they hold; a unit begins at the comments and attributes directly above it."""
    spec = resource("code.specs", _specs)[family]
    m_text = masked(text, family)
    if spec.ends is not None:
        return _indented(text, m_text, spec, most)
    pairs = mates(m_text)
    found: dict[int, tuple[str, str, int, int | None, str | None]] = {}
    at_line = r"(?m)(?:^|(?<=[{};]))[ \t]*(?:(?:@\w[\w.]*(?:\([^()\n]*\))?|\[[^\]\n]*\]|#\[[^\]\n]*\])[ \t]*)*"
    for kind, rx in spec.heads:
        for m in re.compile(at_line + f"(?P<head>{rx})").finditer(m_text):
            if m.start("head") not in found:
                end, body = _end(m_text, m.end(), pairs, family in BY_LINE)
                found[m.start("head")] = (kind, m.group("name"), end, body, m.groupdict().get("owner"), m.start("name"))
    # methods stand directly in the block of an owner
    if spec.methods:
        owners = {body for kind, _, _, body, _, _ in found.values() if kind in spec.owners and body is not None}
        places, within = _enclosing(pairs)
        for m in re.compile(at_line + f"(?P<head>{spec.methods})").finditer(m_text):
            s = m.start("head")
            if s in found or m.group("name") in spec.not_calls:
                continue
            k = bisect.bisect_left(places, s) - 1
            if k >= 0 and within[k] in owners:
                end, body = _end(m_text, m.end() - (m_text[m.end() - 1] == "("), pairs, False)
                found[s] = ("method", m.group("name"), end, body, None, m.start("name"))
    if spec.enums:
        for s, (kind, _, end, body, _, _) in list(found.items()):
            if kind == "enum" and body is not None:
                for name, a, b in _variants(m_text, body, end - 1, pairs):
                    found.setdefault(a, ("variant", name, b, None, None, a))
    out: list[Unit] = []
    stack: list[int] = []
    for s in sorted(found):
        kind, name, end, body, owner, at = found[s]
        while stack and out[stack[-1]].end <= s:
            stack.pop()
        parent = stack[-1] if stack else -1
        if kind == "fn" and parent >= 0 and out[parent].kind in spec.owners:
            kind = "method"
        names = [out[k].name for k in stack][-most:] + ([owner] if owner else [])
        out.append(Unit(kind, name, spec.joint.join([*names, name]), s, end, body, parent, len(stack), at))
        if body is not None:
            stack.append(len(out) - 1)
    for u in out:
        u.start = _lead_start(text, m_text, u.start)
    return out


def _indented(text: str, m_text: str, spec: Spec, most: int) -> list[Unit]:
    """Declarations of languages without braces: each goes on until a line that isn't further in, which it takes in if that line ends it."""
    lines, at = [], 0
    for line in m_text.split("\n"):
        lines.append((at, len(line) - len(line.lstrip(" \t")), line))
        at += len(line) + 1
    heads = [(kind, re.compile(rx)) for kind, rx in spec.heads]
    ends = re.compile(spec.ends)
    out: list[Unit] = []
    open_: list[int] = []

    def close(indent: int, start: int, end: int, line: str) -> None:
        # a further line of the same indent that ends a declaration belongs to the innermost of that indent
        while open_ and out[open_[-1]].at >= indent:
            u = out[open_.pop()]
            same = u.at == indent and ends.match(line.strip())
            u.end = end if same else last_end
            if same:
                break

    last_end = 0
    for start, indent, line in lines:
        if not line.strip():
            continue
        close(indent, start, start + len(line.rstrip()), line)
        body = line.strip()
        for kind, rx in heads:
            m = rx.match(body)
            if m and not ends.match(body):
                parent = open_[-1] if open_ else -1
                if kind == "fn" and parent >= 0 and out[parent].kind in spec.owners:
                    kind = "method"
                names = [out[k].name for k in open_][-most:]
                # until the end is known, the place of the name holds the indent
                out.append(Unit(kind, m.group("name"), spec.joint.join([*names, m.group("name")]), start + indent, -1, start + len(line), parent, len(open_), indent))
                open_.append(len(out) - 1)
                break
        last_end = start + len(line.rstrip())
    for k in open_:
        out[k].end = last_end
    for u in out:
        u.at = m_text.find(u.name, u.start)
        u.start = _lead_start(text, m_text, u.start)
    return out


def _enclosing(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Places of all matched brackets in order, and behind each the bracket that is open there, -1 for none."""
    places, within, stack = [], [], []
    for at in sorted([*pairs, *pairs.values()]):
        if at in pairs:
            stack.append(at)
        else:
            stack.pop()
        places.append(at)
        within.append(stack[-1] if stack else -1)
    return places, within


def _lead_start(text: str, m_text: str, start: int) -> int:
    """The start of the comments and attributes that end on the line above, without a blank line between."""
    line = text.rfind("\n", 0, start) + 1
    if m_text[line:start].strip() and not re.fullmatch(r"\s*[@#\[][^\n]*", text[line:start]):
        return start
    at = line
    while at > 0:
        above = text.rfind("\n", 0, at - 1) + 1
        whole, code = text[above : at - 1].strip(), m_text[above : at - 1].strip()
        if not whole or (code and not re.match(r"#!?\[|@\w|\[", whole)):
            break
        at = above
    first = at + len(text[at:start]) - len(text[at:start].lstrip())
    return min(first, start)


def _use_names(tree: str, prefix: str = "") -> list[str]:
    """The names that one argument of ``use`` binds."""
    tree = tree.strip()
    m = re.match(r"(?s)(.*?)\{(.*)\}$", tree)
    if m:
        parts, depth, last = [], 0, 0
        inner = m.group(2)
        for i, ch in enumerate(inner):
            depth += (ch == "{") - (ch == "}")
            if ch == "," and depth == 0:
                parts.append(inner[last:i])
                last = i + 1
        parts.append(inner[last:])
        return [x for p in parts if p.strip() for x in _use_names(p, prefix + m.group(1))]
    alias = re.search(rf"\bas\s+({NAME})$", tree)
    if alias:
        return [alias.group(1)] if alias.group(1) != "_" else []
    last = tree.rsplit("::", 1)[-1].strip()
    if last == "self":
        last = (prefix + tree.rsplit("self", 1)[0]).rstrip(": ").rsplit("::", 1)[-1].strip()
    return [last] if re.fullmatch(NAME, last) and last not in ("crate", "super") else []


def _stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", re.split(r"[/\\]", path)[-1])


def code_imports(text: str, family: str) -> list[str]:
    """The names that a file's imports bind: aliases before names, last segments of paths, stems of required and included files; no globs."""
    plain = re.sub(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", " ", text)
    out: list[str] = []
    if family == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", plain):
            out += _use_names(m.group(1))
    elif family == "ts":
        for m in re.finditer(r"(?m)^\s*import\s+(?:type\s+)?([^;'\"]+?)\s+from\s*[\"']", plain):
            clause = m.group(1)
            for part in re.findall(r"\{[^}]*\}|\*\s*as\s+[\w$]+|[\w$]+", clause):
                if part.startswith("{"):
                    for one in part[1:-1].split(","):
                        words = [w for w in one.split() if w != "type"]
                        if words:
                            out.append(words[-1])
                else:
                    out.append(part.split()[-1])
        out += [_stem(x) for x in re.findall(r"\brequire\(\s*[\"']([^\"']+)[\"']\s*\)", plain)]
    elif family == "go":
        for m in re.finditer(r"(?m)^import\s*(\([^)]*\)|(?:[\w.]+[ \t]+)?[\"`][^\n]+)", plain):
            for alias, path in re.findall(r"([\w.]+)?[ \t]*[\"`]([^\"`]+)[\"`]", m.group(1)):
                if alias not in ("_", "."):
                    out.append(alias or path.rsplit("/", 1)[-1])
    elif family == "c":
        out += [_stem(x) for x in re.findall(r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)[\">]", plain)]
    elif family in ("ruby", "bash", "lua", "perl", "powershell"):
        plain = re.sub(r"(?m)^\s*(?:#|--)[^\n]*", " ", text)
        out += [re.split(r"[./]", x)[-1] if family == "lua" else _stem(x) for x in re.findall(r"(?m)(?:\brequire(?:_relative)?|\bsource|^\s*\.|\bload|\bdofile)[ \t(]+[\"']?([\w./:\\-]+)", plain) if x not in ("strict", "warnings")]
        if family == "perl":
            out = [x for x in (re.split(r"::", y)[-1] for y in re.findall(r"(?m)^\s*(?:use|require)\s+([A-Za-z][\w:]*)", plain)) if x not in ("strict", "warnings", "utf8")]
        if family == "powershell":
            out += [_stem(x) for x in re.findall(r"(?mi)^\s*(?:import-module|using\s+module)\s+[\"']?([\w./\\-]+)", plain)]
    elif family == "haskell":
        out += [a or b.rsplit(".", 1)[-1] for b, a in re.findall(r"(?m)^import\s+(?:qualified\s+)?([\w.]+)(?:\s+(?:qualified\s+)?as\s+(\w+))?", text)]
    elif family == "elixir":
        out += [x.rsplit(".", 1)[-1] for x in re.findall(r"(?m)^\s*(?:import|alias|use|require)\s+([A-Z][\w.]*)", text)]
    elif family == "vbnet":
        out += [a or b.rsplit(".", 1)[-1] for a, b in re.findall(r"(?mi)^\s*Imports\s+(?:(\w+)\s*=\s*)?([\w.]+)", text)]
    elif family == "php":
        out += [a or b for b, a in re.findall(r"(?m)^\s*use\s+(?:[\w\\]*\\)?(\w+)(?:\s+as\s+(\w+))?\s*;", plain)]
    else:
        out += [a or b for b, a in re.findall(r"(?m)^\s*(?:import|using|open)\s+(?:static\s+)?(?:[\w.]*\.)?(\w+)(?:\s+as\s+(\w+))?\s*;?\s*$", plain)]
    return list(dict.fromkeys(x for x in out if x))


def code_calls(text: str, family: str) -> dict[str, int]:
    """Names that are called, macros of Rust too, with their counts; declarations and control words aren't calls."""
    spec = resource("code.specs", _specs)[family]
    m_text = masked(text, family)
    if family == "rust":
        m_text = re.sub(r"#!?\[[^\]\n]*\]", lambda m: " " * len(m.group()), m_text)
    own = {u.at for u in code_units(text, family)}
    out: dict[str, int] = {}
    bang = r"!?" if family == "rust" else ""
    for m in re.finditer(rf"(?P<name>{NAME}){bang}\s*(?:::<(?:[^<>]|<[^<>]*>)*>)?\(", m_text):
        name = m.group("name")
        if name not in spec.not_calls and m.start("name") not in own:
            out[name] = out.get(name, 0) + 1
    return out


def balanced(text: str, family: str) -> bool:
    """Whether all brackets of a text meet; what has no grammar here counts as parsed if they do. Shell patterns close what they never open."""
    m_text = masked(text, family)
    if family == "bash":
        m_text = re.sub(r"(?m)^[^()\n]*\)", "", m_text)
    return 2 * len(mates(m_text)) == sum(m_text.count(x) for x in "()[]{}")


class Bytes:
    """Byte offsets of character places in one text."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        if not self.ascii:
            self.at, n = [], 0
            self.wide = []
            for i, c in enumerate(text):
                k = len(c.encode("utf-8", "replace"))
                if k > 1:
                    n += k - 1
                    self.at.append(i)
                    self.wide.append(n)

    def __call__(self, place: int) -> int:
        if self.ascii:
            return place
        k = bisect.bisect_left(self.at, place)
        return place + (self.wide[k - 1] if k else 0)
