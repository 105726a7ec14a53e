"""Parsing of query texts: code spans, anchors, qualifiers, runs, concepts and intents; one query on the driver or a column of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

MOST_QUERY_BYTES, MOST_LIMIT, MOST_TOKENS = 4096, 64, 32768
MOST_ANCHORS, MOST_RUNS, MOST_CONCEPTS = 4, 32, 64
#: Words that express no concept, first words of a locator request, words that ask for users of a definition.
STOPWORDS = frozenset(
    (
        "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "do", "does", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "should", "that", "the", "their", "this", "to", "was", "when", "where", "which",
        "while", "with", "without", "would",
    )
)
NOT_PROSE_FIRST = frozenset(("where", "find", "locate", "show", "who"))
DOOR_WORDS = frozenset(
    (
        "callers", "caller", "calls", "called", "invokes", "invoked", "invokers", "uses", "used", "usage", "usages", "references", "reference", "referenced", "dependents", "depends", "dependency", "dependencies", "impact", "affects",
        "break", "breaks",
    )
)
#: Languages that prose may ask for, the things that must follow one, words of a request for a symbol.
LANGUAGES = {"Go": "go", "Rust": "rust", "Python": "python", "Java": "java", "Javascript": "javascript", "JavaScript": "javascript", "Typescript": "typescript", "TypeScript": "typescript", "Ruby": "ruby", "Swift": "swift", "Kotlin": "kotlin"}
LANGUAGE_THINGS = frozenset(("string", "slice", "map", "array", "boolean", "bytes", "channel", "code", "source", "package", "module", "path", "reader"))
INCIDENTAL_THINGS = LANGUAGE_THINGS | {"whitespace", "character", "characters", "text"}
INCIDENTAL_NAMES = frozenset(LANGUAGES) | {"Unicode"}
SYMBOL_WORDS = frozenset(("call", "invoke", "named", "symbol", "function", "method"))
#: How a question of behaviour begins, words that make it a locator request, words that say nothing of the behaviour.
BEHAVIOUR_STARTS = ("how does ", "how do ", "how is ", "why does ", "explain how ", "describe how ")
LOCATOR_WORDS = frozenset(("find", "locate", "defined", "definition", "definitions"))
BEHAVIOUR_STOP = frozenset(
    (
        "how", "does", "do", "is", "why", "explain", "describe", "the", "a", "an", "it", "its", "and", "or", "to", "of", "in", "on", "with", "for", "when", "before", "after", "first", "that", "this", "handle", "handles",
    )
)
PATH_EXTENSIONS = frozenset(("md", "txt", "rst", "json", "yaml", "yml", "toml", "lock"))
ENDS = "?.,:"
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


def check_query(query: str, limit: int = 10, tokens: int = 4096) -> None:
    """Refuse blank or oversized queries and limits outside of their bounds."""
    if not query.strip() or len(query.encode()) > MOST_QUERY_BYTES:
        raise ValueError("the query must hold 1 to 4096 bytes that aren't all blank")
    if not 1 <= limit <= MOST_LIMIT:
        raise ValueError("limit must be 1 to 64")
    if not 1 <= tokens <= MOST_TOKENS:
        raise ValueError("tokens must be 1 to 32768")


def code_spans(query: str) -> list[str]:
    """The contents of Markdown code spans: runs of backticks closed by runs of equal length."""
    return [query[a:b].strip() for a, b in span_ranges(query)]


def span_ranges(query: str) -> list[tuple[int, int]]:
    """Where the contents of code spans lie."""
    out, at = [], 0
    while m := re.compile(r"`+").search(query, at):
        close = re.compile(rf"(?<!`){m.group()}(?!`)").search(query, m.end())
        if close:
            out.append((m.end(), close.start()))
        at = close.end() if close else m.end()
    return out


def words_of(text: str) -> list[str]:
    """Lower-case parts of identifiers and words of at least two characters, as the analyzer of sources has them."""
    import regex

    parts = regex.split(r"[^\p{L}\p{Nl}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", text)
    return [p.lower() for p in parts if len(p) > 1]


def identifier_shaped(word: str) -> bool:
    return "_" in word or "$" in word or bool(re.search(r"[a-z][A-Z]", word))


def never_anchors(word: str) -> bool:
    """Single letters, all capitals without an underscore, and letters with only digits behind them never name a definition by themselves."""
    return len(word) < 2 or ("_" not in word and word.upper() == word and any(c.isalpha() for c in word)) or bool(re.fullmatch(r"[A-Za-z]+[0-9]+", word))


def is_path(token: str) -> bool:
    """A token with a slash, or that ends in the extension of a known language or of a usual text file."""
    from seamark.functions.text import LANGUAGE_BY_EXTENSION, LANGUAGE_BY_NAME

    stem, dot, ext = token.rpartition(".")
    return "/" in token or "\\" in token or token in LANGUAGE_BY_NAME or bool(dot and stem and (ext in LANGUAGE_BY_EXTENSION or ext in PATH_EXTENSIONS))


@dataclass
class Anchors:
    """What a query names: fixed anchors, those that need an exact definition, and qualifiers."""

    fixed: list[str] = field(default_factory=list)
    capitalized: list[str] = field(default_factory=list)
    qualifiers: list[str] = field(default_factory=list)
    #: Where each capitalized one stands.
    places: dict[str, int] = field(default_factory=dict)


def parse_anchors(query: str) -> Anchors:
    """Marked names first, then identifier-shaped ones and names of chains, then capitalized words that aren't the first.

    A chain is names joined by ``::`` or ``->``, within a code span also by ``.``; its last one is the name, the others qualify. Tokens that
    are paths only qualify. Within a span a name may hold hyphens between letters. Of equal names, whatever the case, the first counts;
    of fixed ones at most four do, and what is marked beyond them qualifies.
    """
    out = Anchors()
    spans = span_ranges(query)
    inside = lambda at: next((k for k, (a, b) in enumerate(spans) if a <= at < b), None)
    qualifiers: list[str] = []
    free = list(query)
    for m in re.finditer(r"[^\s`]+", query):
        token = m.group().lstrip("([{<\"'").rstrip(")]}>\"',;:!?.")
        if token and is_path(token):
            at = m.start() + m.group().index(token)
            free[at : at + len(token)] = " " * len(token)
            stem = re.sub(r"\.[^./]*$", "", token.lower())
            qualifiers += [x for x in re.split(r"[^a-z0-9_$]+", stem) if x]
    text = "".join(free)
    # each match is a chain, cut further below where a joint isn't one
    names: list[list[tuple[int, int]]] = []
    for m in re.finditer(r"[A-Za-z_$][A-Za-z0-9_$]*(?:(?<=[A-Za-z])-(?=[A-Za-z])[A-Za-z_$][A-Za-z0-9_$]*)*", text):
        parts = [m.span()] if inside(m.start()) is not None else [(m.start() + x.start(), m.start() + x.end()) for x in IDENTIFIER.finditer(m.group())]
        for a, b in parts:
            last = names[-1][-1] if names else None
            joint = text[last[1] : a] if last else ""
            if last and inside(last[0]) == inside(a) and (joint in ("::", "->") or (joint == "." and inside(a) is not None)):
                names[-1].append((a, b))
            else:
                names.append([(a, b)])
    start = len(query) - len(query.lstrip())
    first_end = start + len((query.split() or [""])[0])
    marked, shaped, capital = [], [], []
    for chain in names:
        a, b = chain[-1]
        qualifiers += [text[x:y].lower() for x, y in chain[:-1]]
        name = text[a:b]
        if inside(a) is not None:
            marked.append(name)
        elif len(chain) > 1 or (identifier_shaped(name) and not never_anchors(name)):
            shaped.append(name)
        elif name[0].isupper() and not never_anchors(name) and not start <= a < first_end:
            capital.append((name, a))
    seen: set[str] = set()
    for k, name in enumerate([*marked, *shaped]):
        if name.lower() not in seen:
            seen.add(name.lower())
            if len(out.fixed) < MOST_ANCHORS:
                out.fixed.append(name)
            elif k < len(marked):
                qualifiers.append(name.lower())
    if len(out.fixed) < MOST_ANCHORS:
        for name, at in capital:
            if name.lower() not in seen:
                seen.add(name.lower())
                out.capitalized.append(name)
                out.places[name] = at
    out.qualifiers = list(dict.fromkeys(qualifiers))
    return out


def select_anchors(a: Anchors, defined: set[str]) -> list[str]:
    """At most four anchors; capitalized ones only if a definition of exactly that name exists."""
    return [*a.fixed, *(c for c in a.capitalized if c in defined)][:MOST_ANCHORS]


def runs(query: str) -> list[str]:
    """Distinct identifiers in lower case: those of code spans if there are any, else all; at most 32."""
    marked = [r for s in code_spans(query) for r in IDENTIFIER.findall(s)]
    return list(dict.fromkeys(x.lower() for x in (marked or IDENTIFIER.findall(query))))[:MOST_RUNS]


def concepts(query: str) -> list[list[str]]:
    """The concepts of a prose query, each with the words that express it: a plural acronym and its singular are one.

    Stop words and the language that the query asks for are none; a word that came before adds to its concept; at most 64.
    """
    asked = language_preference(query)
    out: list[list[str]] = []
    for word in query.split():
        w = word.rstrip(ENDS)
        forms = [[w[:-1].lower(), w.lower()]] if re.fullmatch(r"[A-Z]{2,}s", w) else [[x] for x in words_of(w)]
        for f in forms:
            if f[0] in STOPWORDS or f[0] == asked:
                continue
            old = next((c for c in out if set(c) & set(f)), None)
            if old is not None:
                old += [x for x in f if x not in old]
            elif len(out) < MOST_CONCEPTS:
                out.append(f)
    return out


def is_prose(query: str) -> bool:
    """At least three words, all of letters with single hyphens, and no search verb first."""
    words = query.split()
    return len(words) >= 3 and words[0].lower() not in NOT_PROSE_FIRST and all(p.isalpha() for w in words for p in w.rstrip(ENDS).split("-"))


def asks_for_doors(query: str) -> bool:
    """Whether a whole word of the query asks for the users of a definition."""
    return any(w in DOOR_WORDS for w in re.findall(r"[a-z0-9_]+", query.lower()))


def behaviour_terms(query: str, name: str, kind: str) -> list[str]:
    """What a question of behaviour asks about a single resolved type, empty where it is none of that: its words without the type's own."""
    if not query.strip().lower().startswith(BEHAVIOUR_STARTS) or kind not in ("struct", "class", "interface", "enum", "trait"):
        return []
    words = words_of(query)
    if LOCATOR_WORDS.intersection(words):
        return []
    return sorted(set(words) - set(words_of(name)) - BEHAVIOUR_STOP)


def incidental_anchor(query: str, name: str, place: int) -> bool:
    """Whether a capitalized word of prose is part of a hyphenated one or only names a language, so that it is no anchor."""
    before, after = query[:place], query[place + len(name) :]
    if before.endswith("-") or after.startswith("-"):
        return True
    if name not in INCIDENTAL_NAMES or any(w.lower() in SYMBOL_WORDS for w in before.split()):
        return False
    return bool(after.split()) and after.split()[0].rstrip(ENDS) in INCIDENTAL_THINGS


def language_preference(query: str) -> str | None:
    """The language that a prose query asks for: one capitalized name before a kind of thing, and no request for a symbol."""
    words = query.split()
    if any(w.lower() in SYMBOL_WORDS for w in words):
        return None
    named = {LANGUAGES[a] for a, b in zip(words, words[1:]) if a in LANGUAGES and b.rstrip(ENDS) in LANGUAGE_THINGS}
    return named.pop() if len(named) == 1 else None


PARSED = "struct<fixed:array<string>,capitalized:array<string>,qualifiers:array<string>,concepts:array<array<string>>,runs:array<string>,language:string,prose:boolean,doors:boolean>"


def parsed(query):
    """A column of queries as a column of what they name and ask for; null for null, in Arrow batches."""
    def one(q: str | None) -> dict | None:
        if q is None:
            return None
        a = parse_anchors(q)
        return {"fixed": a.fixed, "capitalized": a.capitalized, "qualifiers": a.qualifiers, "concepts": concepts(q), "runs": runs(q), "language": language_preference(q), "prose": is_prose(q), "doors": asks_for_doors(q)}

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(q) or dict.fromkeys(("fixed", "capitalized", "qualifiers", "concepts", "runs", "language", "prose", "doors")) for q in s], columns=["fixed", "capitalized", "qualifiers", "concepts", "runs", "language", "prose", "doors"])

    return F.when(query.isNotNull(), run(query))
