"""Line rules and rules on mathematics, one text at a time, to hold the column expressions against."""

from __future__ import annotations

import re
from itertools import accumulate

from inkwell.functions.folds import scanned

SCRIPT = re.compile(r"([A-Za-z0-9]{1,6})([\^_])(?:\{([A-Za-z0-9]{1,3})\}|([A-Za-z0-9]))")


def space_fences(text: str) -> str:
    """An empty line, with the fence's own quote marks, between a fence and text right before or after it; fences inside list items, that is indented by two or more, stay."""
    rows = list(scanned(text))
    lead: dict[int, str] = {}  # an empty line with these marks goes before these; between two fences the first one's
    for k, row in enumerate(rows):
        if len(row.indent) < 2 and row.place in ("open", "close"):
            other, gap = (k - 1, k) if row.place == "open" else (k + 1, k + 1)
            if 0 <= other < len(rows) and not rows[other].blank:
                lead.setdefault(gap, row.lead.rstrip())
    return "\n".join(x for k, row in enumerate(rows) for x in ([lead[k], row.whole] if k in lead else [row.whole]))


#: A list item of a bold label, a dash between blanks, and text.
LABELLED = re.compile(r"(?P<lead>\s*)(?P<marker>(?:[*+-]|\d+\.)\s+)(?P<label>\*\*[^*]+\*\*:? *?) [-–—] (?P<text>.*)", re.S)


def _brackets_close(label: str) -> bool:
    return all(list(accumulate((1 if c == a else -1 if c == b else 0 for c in label), lambda n, step: max(0, n + step), initial=0))[-1] == 0 for a, b in ("()", "[]"))


def split_labels(text: str) -> str:
    """A list item of a bold label, a dash and text becomes the label with the text as an item below it; any line of ``` begins or ends code."""
    out, code = [], False
    for line in text.split("\n"):
        ticks = line.lstrip().startswith("```")
        code ^= ticks
        m = None if code or ticks else LABELLED.fullmatch(line)
        out += [f"{m['lead']}{m['marker']}{m['label']}", f"{m['lead']}  - {m['text']}"] if m and _brackets_close(m["label"]) else [line]
    return "\n".join(out)


def simple_scripts(latex: str | None) -> str | None:
    """Superscripts and subscripts as tags where that says it all, else None."""
    marks = [] if latex is None else list(SCRIPT.finditer(latex))
    if not marks or any(c in "\\^_{}" for c in SCRIPT.sub("", latex)):
        return None
    return SCRIPT.sub(lambda m: "{0}<{1}>{2}</{1}>".format(m[1], "sup" if m[2] == "^" else "sub", m[3] or m[4]), latex)


def unboxed(latex: str) -> tuple[str, bool]:
    r"""The content of a \boxed{...} around a whole expression, and whether there was one."""
    head, s = "\\boxed{", latex.strip()
    depths = list(accumulate((c == "{") - (c == "}") for c in s[len(head) - 1 :])) if s.startswith(head) else []
    if 0 in depths and depths.index(0) == len(depths) - 1:
        return s[len(head) : -1], True
    return latex, False
