"""Packing of ranked results under an exact token budget.

Token counts aren't additive, so that a response is counted anew for each trial; a query has at most 32 items, which one task packs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.tokens import VOCABULARY, encode

MOST_ITEMS, MOST_RESPONSE_BYTES, MOST_LINES = 32, 256 * 1024, 1024


def pack_items(forms: list[list[str]], budget: int, path: str = VOCABULARY) -> tuple[str, list[int]]:
    """The response and, per item, which of its forms (full to short) was taken, -1 for none. Items are tried in order."""
    taken: list[int] = []
    parts: list[str] = []
    for options in forms[:MOST_ITEMS]:
        chosen = -1
        for k, text in enumerate(options):
            whole = "\n\n".join([*parts, text])
            if len(whole.encode()) <= MOST_RESPONSE_BYTES and len(encode(whole, path)) <= budget:
                parts.append(text)
                chosen = k
                break
        taken.append(chosen)
    return "\n\n".join(parts), taken


def longest_prefix(lines: list[str], budget: int, path: str = VOCABULARY) -> int:
    """How many leading lines fit, by halving."""
    lo, hi = 0, len(lines)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if len(encode("\n".join(lines[:mid]), path)) <= budget:
            lo = mid
        else:
            hi = mid - 1
    return lo


def with_tail(response: str, tail: list[str], budget: int, path: str = VOCABULARY) -> tuple[str, int]:
    """A packed response and, below it, as many lines of memory as still fit, each tried in turn; (response, lines taken)."""
    taken = 0
    for line in tail:
        whole = f"{response}\n{line}" if response else line
        if len(whole.encode()) <= MOST_RESPONSE_BYTES and len(encode(whole, path)) <= budget:
            response, taken = whole, taken + 1
    return response, taken


def pack_lines(lines: DataFrame, query: str, place: str, line: str, budget: int, path: str = VOCABULARY) -> DataFrame:
    """``query, response, tokens, shown, left_out``: the longest prefix of each query's lines that fits, as lists of references and directories are packed.

    A query has at most ``MOST_LINES`` lines; what lies beyond counts as left out.
    """
    kind = dict(lines.dtypes)[query]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(place)[line].tolist()
        n = longest_prefix(rows, budget, path)
        text = "\n".join(rows[:n])
        return pd.DataFrame([[pdf[query].iloc[0], text, len(encode(text, path)), n]], columns=[query, "response", "tokens", "shown"])

    total = lines.groupBy(query).count()
    got = lines.filter(lines[place] <= MOST_LINES).select(query, place, line).groupBy(query).applyInPandas(one, f"{query} {kind}, response string, tokens long, shown long")
    return got.join(total, query).select(query, "response", "tokens", "shown", (F.col("count") - F.col("shown")).alias("left_out"))


def pack_responses(items: DataFrame, query: str, rank: str, forms: list[str], budget: int, path: str = VOCABULARY) -> DataFrame:
    """``query, response, tokens, items, short, left_out`` for each query; ``forms`` are text columns from full to short."""
    kind = dict(items.dtypes)[query]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        text, taken = pack_items([[x for x in row if x is not None] for row in pdf[forms].itertuples(index=False)], budget, path)
        return pd.DataFrame([[pdf[query].iloc[0], text, len(encode(text, path)), sum(k >= 0 for k in taken), sum(k > 0 for k in taken), sum(k < 0 for k in taken)]], columns=[query, "response", "tokens", "items", "short", "left_out"])

    ranked = items.filter(items[rank] <= MOST_ITEMS).select(query, rank, *forms)
    return ranked.groupBy(query).applyInPandas(one, f"{query} {kind}, response string, tokens long, items int, short int, left_out int")
