"""Column functions on texts and paths; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The places at which an identifier falls into its parts.
SUBTOKENS = r"[^\p{IsAlphabetic}\p{N}]+|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"

#: Languages by extension and by whole file name.
LANGUAGE_BY_EXTENSION = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "go": "go", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "cs": "csharp", "fs": "fsharp", "fsx": "fsharp", "fsi": "fsharp", "vb": "vbnet",
    "php": "php", "phtml": "php", "pl": "perl", "pm": "perl", "t": "perl", "psgi": "perl", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell", "rb": "ruby", "rake": "ruby", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "scala": "scala", "sc": "scala", "lua": "lua", "dart": "dart", "ex": "elixir", "exs": "elixir", "hs": "haskell", "md": "markdown", "markdown": "markdown", "toml": "toml", "json": "json",
    "yaml": "yaml", "yml": "yaml", "sh": "bash", "bash": "bash", "zsh": "bash", "sql": "sql", "html": "html", "css": "css",
}
LANGUAGE_BY_NAME = {"Rakefile": "ruby", "Gemfile": "ruby"}

#: What makes a path a lock file, a snapshot, generated, vendored or a test, in this order.
LOCK_NAMES = (
    "bun.lock", "bun.lockb", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "go.sum",
    "packages.lock.json", "Podfile.lock", "pubspec.lock", "mix.lock", "flake.lock",
)
SNAPSHOT_GLOBS, SNAPSHOT_PARTS = ("*.snap",), ("__snapshots__",)
GENERATED_GLOBS = ("*.min.js", "*.min.css", "*.g.cs", "*.Designer.cs", "*.designer.cs", "*_pb2.py", "*.pb.go", "*.generated.*")
GENERATED_PARTS = ("generated", "__generated__", "obj")
VENDORED_PARTS = ("vendor", "third_party", "third-party", "Pods")
TEST_PARTS = ("test", "tests", "__tests__", "testing", "testdata", "fixtures", "e2e", "spec", "benches")
TEST_GLOBS = (
    "tests.rs", "conftest.py", "*_test.go", "test_*.py", "*_test.py", "*.test.*", "*.spec.*", "*_spec.rb", "*Test.java", "*Tests.java", "*Test.kt", "*Tests.kt", "*Test.swift", "*Tests.swift", "*Test.cs", "*Tests.cs",
    "*Test.php", "*_test.cc", "*_test.cpp", "*_unittest.cc", "*.t", "*.bats",
)
#: Order of the roles in every ranking.
ROLES = ("source", "test", "generated", "vendored", "lock", "snapshot")


def subtokens(c: Column) -> Column:
    """The parts of all identifiers and words, as written."""
    return F.filter(F.split(c, SUBTOKENS), lambda x: x != "")


def search_terms(c: Column, least: int = 2) -> Column:
    """Lower-case parts of at least ``least`` characters."""
    return F.filter(F.transform(subtokens(c), F.lower), lambda x: F.length(x) >= least)


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"), 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def path_segments(path: Column) -> Column:
    """Distinct lower-case words of a path without its extension, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[^./]*$", "")), r"[^a-z0-9_$]+"), lambda x: x != ""))


def directories(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def glob(c: Column, pattern: str) -> Column:
    """``*`` matches anything, all else itself."""
    rx = "".join(".*" if x == "*" else ("\\" + x if not x.isalnum() else x) for x in pattern)
    return c.rlike(f"(?s)^{rx}$")


def in_subtree(path: Column, tree: str) -> Column:
    """Whether a path is the tree or lies below it, at a component boundary; the prefix test reaches the Parquet scan."""
    t = tree.removeprefix("./").rstrip("/")
    if t in ("", "."):
        return path.isNotNull()
    return (path == t) | path.startswith(f"{t}/")


def language(path: Column) -> Column:
    """The language of a path by its file name, else its extension in any letter case; null if unknown or a bare ``.name``."""
    pair = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(pair(LANGUAGE_BY_NAME)[basename(path)], F.when(~basename(path).rlike(r"^\.[^.]*$"), pair(LANGUAGE_BY_EXTENSION)[extension(path)]))


def path_role(path: Column) -> Column:
    """lock, snapshot, generated, vendored, test or source; the first that matches. The base name is a component of the path like the others."""
    name, parts = basename(path), F.split(path, "/")
    any_glob = lambda gs: F.greatest(*[glob(name, g) for g in gs]) if len(gs) > 1 else glob(name, gs[0])
    any_part = lambda ds: F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ds]))
    return (
        F.when(name.isin(*LOCK_NAMES), "lock")
        .when(any_glob(SNAPSHOT_GLOBS) | any_part(SNAPSHOT_PARTS), "snapshot")
        .when(any_glob(GENERATED_GLOBS) | any_part(GENERATED_PARTS), "generated")
        .when(any_part(VENDORED_PARTS), "vendored")
        .when(any_glob(TEST_GLOBS) | any_part(TEST_PARTS), "test")
        .otherwise("source")
    )


def role_rank(role: Column) -> Column:
    out = F.lit(len(ROLES))
    for k, r in reversed(list(enumerate(ROLES))):
        out = F.when(role == r, k).otherwise(out)
    return out


def module_key(path: Column) -> Column:
    """The name under which a file is imported: its stem, or its directory for the usual index files."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    parent = F.element_at(F.split(path, "/"), -2)
    return F.when(stem.isin("mod", "lib", "main", "index", "__init__") & path.contains("/"), parent).otherwise(stem)


def find_word(text: Column, word: str) -> Column:
    """1-based place of the first whole identifier ``word``, 0 if there is none."""
    w = "".join(x if x.isalnum() or x == "_" else "\\" + x for x in word)
    return F.regexp_instr(text, F.lit(rf"(?<![\p{{IsAlphabetic}}\p{{N}}_$]){w}(?![\p{{IsAlphabetic}}\p{{N}}_$])"))


def has_any_word(text: Column, wanted: list[str]) -> Column:
    """Whether a whole word (letters, digits, underscore; whatever the case) is one of those wanted; null for null."""
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1), F.array(*[F.lit(w) for w in wanted]))


def best_line(text: Column, wanted: list[str]) -> Column:
    """(line, terms): the 0-based line with most distinct wanted terms, the earliest of equals."""
    lines = F.split(text, "\n")
    w = F.array(*[F.lit(x) for x in wanted])
    scored = F.transform(lines, lambda x, i: F.struct(F.size(F.array_intersect(F.array_distinct(search_terms(x)), w)).alias("terms"), (-i).alias("neg")))
    best = F.array_max(scored)
    return F.struct((-best["neg"]).alias("line"), best["terms"].alias("terms"))


def excerpt(c: Column, most: int = 160) -> Column:
    """A line without its end and leading white space, cut at ``most`` bytes on a character boundary with an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(c, r"[\r\n]+$", ""), r"^\s+", "")
    chars = F.split(line, "")
    fits = F.aggregate(chars, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, x: F.struct((a["bytes"] + F.octet_length(x)).alias("bytes"), F.when(a["bytes"] + F.octet_length(x) <= most, a["n"] + 1).otherwise(a["n"]).alias("n")))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(F.substring(line, F.lit(1), fits["n"]), F.lit("…")))


def single_line(c: Column) -> Column:
    """Control signs become blanks."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The characters of a byte range; null where a bound lies within a character or outside."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, (start + 1).cast("int"), (end - start).cast("int"))
    return F.when((start >= 0) & (start < end) & (end <= F.octet_length(text)) & F.is_valid_utf8(cut.cast("string")), cut.cast("string"))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, 1-based, both included."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def byte_of_position(text: Column, line: Column, column: Column, utf16: bool = False) -> Column:
    """Byte offset of a 0-based line and column counted in UTF-8 bytes, or in UTF-16 units; null beyond the text."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line), F.lit(0), lambda a, x: a + F.octet_length(x) + 1)
    here = F.get(lines, line)
    if not utf16:
        return F.when(column <= F.octet_length(here), before + column)
    # a character outside of the basic plane takes two units and four bytes
    walk = F.aggregate(F.split(here, ""), F.struct(F.lit(0).alias("u"), F.lit(0).alias("b")), lambda a, x: F.when(a["u"] < column, F.struct((a["u"] + F.when(F.octet_length(x) == 4, 2).otherwise(1)).alias("u"), (a["b"] + F.octet_length(x)).alias("b"))).otherwise(a))
    return F.when(walk["u"] == column, before + walk["b"])
