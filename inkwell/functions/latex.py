"""Rules on a piece of mathematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A script's base, mark and what is raised or lowered; what makes a text look like mathematics, and a plain amount, which does not; a box's head.
SCRIPT = r"([A-Za-z0-9]{1,6})([\^_])(?:\{([A-Za-z0-9]{1,3})\}|([A-Za-z0-9]))"
SIGNS, AMOUNT = r"[\\^_{}|=<>]", r"(?U)^\s*[\d,]+(?:\.\d+)?\s*\z"
BOX = "\\boxed{"


def looks_like_math(text: Column) -> Column:
    return text.rlike(SIGNS) & ~text.rlike(AMOUNT)


def scripts(latex: Column) -> Column:
    """Superscripts and subscripts as tags where that says it all, else null. Tags get the mark's own name first: no mark is left in the text then."""
    tagged = F.regexp_replace(latex, SCRIPT, "$1<$2>$3$4</$2>")
    for mark, name in (("^", "sup"), ("_", "sub")):
        for tag in ("<{}>", "</{}>"):
            tagged = F.replace(tagged, F.lit(tag.format(mark)), F.lit(tag.format(name)))
    return F.when(latex.rlike(SCRIPT) & ~F.regexp_replace(latex, SCRIPT, "").rlike(r"[\\^_{}]"), tagged)


def unboxed(latex: Column) -> Column:
    r"""STRUCT<latex, boxed>: the content of a \boxed{...} around a whole expression, else the expression as it is."""
    bare = F.regexp_replace(latex, r"(?U)^\s+|\s+\z", "")
    content = F.substr(bare, F.lit(len(BOX) + 1))
    step = lambda mark: F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
    # below zero: something stands behind the box
    depth = F.aggregate(F.split(F.regexp_replace(content, "[^{}]", ""), ""), F.lit(1), lambda n, mark: F.when((n < 1), -1).otherwise(n + step(mark)))
    boxed = F.startswith(bare, F.lit(BOX)) & F.endswith(bare, F.lit("}")) & (depth == 0)
    inside = F.substr(content, F.lit(1), F.length(content) - 1)
    return F.struct(F.when(boxed, inside).otherwise(latex).alias("latex"), boxed.alias("boxed"))
