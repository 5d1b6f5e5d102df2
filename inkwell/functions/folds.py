"""Line rules with a state that SQL cannot carry: each takes a whole text. They run as Arrow-batched UDFs, over the rows that need them alone."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Row(NamedTuple):
    """A line taken apart. ``place``: outside, or open, inside or close of a fence."""

    whole: str
    quote: str
    indent: str
    marker: str | None
    rest: str
    place: str

    @property
    def blank(self) -> bool:
        return not (self.marker or self.rest.strip())

    @property
    def lead(self) -> str:
        return self.quote + self.indent


#: A line: quote marks with their blank, indentation, a list marker with a blank behind it, and the rest.
PARTS = re.compile(r"(?P<quote>(?:[ \t]*>)*(?:(?<=>)[ \t])?)(?P<indent>[ \t]*)(?P<marker>(?:[*+-]|[0-9]+[.)])(?=[ \t]))?(?P<rest>.*)", re.S)
#: A run of fence marks, and what stands behind it.
MARKS = re.compile(r"(?P<run>`{3,}|~{3,})(?P<info>.*)", re.S)


def scanned(text: str) -> Iterator[Row]:
    """The lines of a text, each with its place among fences: one closes with as many marks of its kind and nothing behind them."""
    fence = ""
    for whole in text.split("\n"):
        quote, indent, marker, rest = PARTS.match(whole).groups()
        run, info = m.groups() if marker is None and (m := MARKS.match(rest)) else ("", "")
        if fence:
            closes = run.startswith(fence) and not info.strip()
            place, fence = ("close", "") if closes else ("inside", fence)
        else:
            place, fence = ("open" if run else "outside"), run
        yield Row(whole, quote, indent, marker, rest, place)


def nest_lists(text: str) -> str:
    """List items four or more columns deeper than the item above them that is less deep go two deeper than that one.

    Columns of the items that are open, and where they went, are kept in order; an item ends all that are as deep as itself. Text without
    indentation ends them all, as does a change of quote marks.
    """
    depths: list[int] = []
    moved: list[int] = []
    quote, out = "", []
    for row in scanned(text):
        item = row.place == "outside" and row.marker is not None and "\t" not in row.indent
        if item:
            if row.quote.replace(" ", "") != quote:
                depths, moved, quote = [], [], row.quote.replace(" ", "")
            depth = len(row.indent)
            above = bisect_left(depths, depth)
            depths, moved = depths[:above], moved[:above]
            step = depth - depths[-1] if depths else 0
            depths.append(depth)
            moved.append((moved[-1] + (2 if step >= 4 else step)) if moved else depth)
            out.append(row.quote + " " * moved[-1] + row.whole[len(row.lead) :])
        else:
            if row.place == "outside" and not row.blank and not row.indent:
                depths, moved = [], []
            out.append(row.whole)
    return "\n".join(out)


# Mathematics

# Delimiters by name, those that begin alike in their precedence; code; a line of equals signs.
DELIMITERS = {
    "code": r"(?s:```.*?```)|`[^`\n]+`",
    "dollars": r"\$\$(?s:(.+?))\$\$",
    "square": r"\\\[(?s:(.+?))\\\]",
    "lines": r"(?m:^)\[[ \t]*\n(?s:(.*?))\n\][ \t]*(?m:$)",
    "round": r"\\\((?s:(.+?))\\\)",
    "dollar": r"(?<!\$)\$(?!\s)([^$\n]+?)(?<!\s)\$(?!\d)",
}
UNDERLINE = re.compile(r"^[ \t]*=+[ \t]*$", re.M)
#: What displays, and what must look like mathematics to be it.
DISPLAYED, DOUBTFUL = {"dollars", "square", "lines"}, {"lines", "dollar"}
_OPENING = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in DELIMITERS.items()))
#: What makes a text look like mathematics, and a plain amount, which does not.
SIGNS, AMOUNT = re.compile(r"[\\^_{}|=<>]"), re.compile(r"[\d,]+(?:\.\d+)?")


def looks_like_math(text: str) -> bool:
    return SIGNS.search(text) is not None and AMOUNT.fullmatch(text.strip()) is None


def math_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, latex, display), in order and apart from each other; nothing that starts in code.

    One pass from left to right: what begins first is taken, and the pass goes on behind it; what only looks like an opening is stepped over.
    """
    found: list[tuple[int, int, str, bool]] = []
    at = 0
    while m := _OPENING.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "code":
            continue
        latex = next(x for x in m.groups()[m.re.groupindex[kind] :] if x is not None)
        if kind == "lines":
            latex = UNDERLINE.sub("=", latex)
        if kind in DOUBTFUL and not looks_like_math(latex):
            at = m.start() + 1
        else:
            found.append((m.start(), m.end(), latex, kind in DISPLAYED))
    return found


def protected(text: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """The text with a private token for each span, and (token, latex, display) of them."""
    spans = math_spans(text)
    tokens = [(f"MATH{k}", latex, display) for k, (_, _, latex, display) in enumerate(spans)]
    edges = [0, *(x for a, b, *_ in spans for x in (a, b)), len(text)]
    plain = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(p + t for p, t in zip(plain, [*(t for t, _, _ in tokens), ""], strict=True)), tokens


def _text_udf(rule):
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rule(t))

    return apply


_nest_lists = _text_udf(nest_lists)


def _where(needed: Column, rule, text: Column) -> Column:
    """Only rows that may need the rule go to Python."""
    return F.coalesce(rule(F.when(needed, text)), text)


def nested_lists(text: Column) -> Column:
    return _where(text.rlike(r"(?m)^[> \t]*(?:[-*+]|\d+[.)])[ \t]"), _nest_lists, text)


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("latex", T.StringType()).add("display", T.BooleanType())))
def _spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else [dict(zip(("start", "end", "latex", "display"), s, strict=True)) for s in math_spans(t)])


def math(text: Column) -> Column:
    """ARRAY<STRUCT<start, end, latex, display>>; texts without a delimiter do not reach Python."""
    return F.when(text.rlike(r"\$|\\\(|\\\[|(?m)^\["), _spans_udf(F.when(text.rlike(r"\$|\\\(|\\\[|(?m)^\["), text))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,latex:string,display:boolean>>)"))
