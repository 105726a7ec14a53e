"""What the parsers share: the token cursor, the error list and panic-mode recovery."""

from __future__ import annotations


class Panic(Exception):
    """Leaves the statement in which an error was found; the error is already stored."""


class Parser:
    """A cursor over parallel lists of token types, texts and places.

    The type of an operator or keyword is its text; others are ID, NUM, STR, CHR, NL, IN, DE, BAD and EOF. Nesting has no bound of its own:
    calls of Python functions live on the heap, about a kilobyte for each level, so that only the worker's recursion limit has to be lifted.
    """

    def __init__(self, types: list[str], texts: list[str], places: list[int]):
        self.t, self.v, self.at = types, texts, places
        self.i = 0
        self.errors: list[tuple[int, str]] = []

    def fail(self, what: str):
        i = min(self.i, len(self.t) - 1)
        found = self.v[i] if self.t[i] == "BAD" else (self.t[i] if self.t[i] in ("EOF", "NL", "IN", "DE") else self.v[i][:24])
        self.errors.append((self.at[i], self.v[i] if self.t[i] == "BAD" else f"expected {what}, found {found!r}"))
        raise Panic

    def eat(self, x: str) -> None:
        if self.t[self.i] != x:
            self.fail(x)
        self.i += 1

    def got(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def peek(self, k: int = 1) -> str:
        j = self.i + k
        return self.t[j] if j < len(self.t) else "EOF"

    def skip_to(self, ends: tuple[str, ...]) -> None:
        """Panic mode: drop tokens up to one of ``ends`` outside of brackets opened on the way; an end of file always stops."""
        t, level = self.t, 0
        while t[self.i] != "EOF":
            x = t[self.i]
            if level == 0 and x in ends:
                return
            if x in ("(", "[", "{"):
                level += 1
            elif x in (")", "]", "}"):
                if level == 0 and x == "}" and "}" in ends:
                    return
                level = max(0, level - 1)
            self.i += 1
