"""Text normalisers as column expressions. A text is an array of lines inside its own row, so no rule needs a shuffle.

Java's character classes are ASCII by default; ``(?U)`` makes them Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lines that the rules look for.
FENCE = r"^\s*```"
LIST_ITEM = r"(?U)^\s*([-*+]|\d+\.)\s+"
TABLE_ROW = r"^\s*\|"
PAREN_ITEM = r"(?U)^(\s*)(\d{1,9})\\?\)(\s+)(\S.*)$"
LABEL_LINE = r"^\*\*[^*\n]+:\*\*(?:\s|$)"
STAMP = r"^(\*\*(?:Created|Updated|Exported):\*\*[ \t]*)(?:(\d{4})/(\d{1,2})/(\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4}))[ \t]+(\d{1,2}):(\d{2}):(\d{2})([ \t]*)$"
LABELLED = r"(?Us)^(\s*)((?:[*+-]|\d+\.)\s+)(\*\*[^*]+\*\*:? *?) [-–—] (.*)\z"
FENCE_MARKS = r"(?s)^((?:[ \t]*>)*(?:(?<=>)[ \t])?)([ \t]*)(`{3,}|~{3,})(.*)\z"
QUOTED_BLANK = r"(?U)^(?:[ \t]*>)*\s*\z"
INLINE_LINK = r"(?<!!)\(?\[([^\]]*)\]\([^)]*\)\)?"
ZERO_WIDTH = "​‌‍⁠﻿"
FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?"

# Symbols without a glyph on the target device, by their replacement.
SYMBOLS = {
    "[Yes]": "✅ ✔ ✓ ☑ 🟢",
    "[No]": "❌ ✖ ✗ ✘ ❎ 🚫 🔴",
    "[Warning]": "⚠",
    "[Partial]": "🟡 🟠",
    "*": "⭐ ★ ☆",
    "[?]": "❓ ❔",
    "[!]": "❗ ❕",
    "->": "➡",
    "<-": "⬅",
    "^": "⬆",
    "[Tip]": "💡",
    "[Note]": "📌 📝",
    "[Hot]": "🔥",
    "v": "⬇",  # last, as its replacement is a letter
}
EMOJI = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
EMOJI_SEQUENCE = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|{EMOJI}[\x{{FE0E}}\x{{FE0F}}]?[\x{{1F3FB}}-\x{{1F3FF}}]?(?:\x{{200D}}{EMOJI}[\x{{FE0E}}\x{{FE0F}}]?[\x{{1F3FB}}-\x{{1F3FF}}]?)*"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def joined(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def _is(line: Column, pattern: str) -> Column:
    return F.coalesce(line.rlike(pattern), F.lit(False))


def bound(value: Column, body) -> Column:
    """body(value) with ``value`` worked out once: an expression that a lambda refers to is otherwise worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fence_mask(rows: Column) -> Column:
    """For each line whether it is a fence line or stands between an odd fence line and the next.

    The lines from one fence line to the next have one value, so the mask is put together from runs, in time linear in the lines.
    """
    def runs(at: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(at, k + 1), F.size(rows))
        after = F.transform(at, lambda f, k: F.concat(F.array(F.lit(True)), F.array_repeat(k % 2 == 0, stop(k) - f - 1)))
        return F.concat(F.array_repeat(F.lit(False), stop(F.lit(-1))), F.flatten(after))

    fences = F.filter(F.transform(rows, lambda x, i: F.when(_is(x, FENCE), i)), lambda i: i.isNotNull())
    return bound(fences, runs)


class Line:
    """A line outside fences with its neighbours: text, whether they stand in a fence, and whether it is the first."""

    def __init__(self, x: Column) -> None:
        self.text, self.before, self.after = x["line"], x["before"], x["after"]
        self.before_fenced, self.after_fenced = x["before_mask"], x["after_mask"]
        self.first = self.before.isNull()


def _by_line(text: Column, needed: str, rule) -> Column:
    """Applies rule(Line) to each line outside fences; others stay. Only texts that match ``needed`` are taken apart."""
    shifted = lambda x, kind: (F.concat(F.array(F.lit(None).cast(kind)), F.slice(x, 1, F.size(x) - 1)), F.concat(F.slice(x, 2, F.size(x)), F.array(F.lit(None).cast(kind))))

    def masked(rows: Column, mask: Column) -> Column:
        (before, after), (before_mask, after_mask) = shifted(rows, "string"), shifted(mask, "boolean")
        whole = F.arrays_zip(rows.alias("line"), mask.alias("mask"), before.alias("before"), after.alias("after"), before_mask.alias("before_mask"), after_mask.alias("after_mask"))
        return F.transform(whole, lambda x: F.when(x["mask"], x["line"]).otherwise(rule(Line(x))))

    done = bound(lines(text), lambda rows: bound(fence_mask(rows), lambda mask: masked(rows, mask)))
    return F.when(text.rlike(needed), joined(done)).otherwise(text)


def front_matter(text: Column) -> Column:
    """Drops the fences of a front matter at the very start; its lines stay, each with a hard break."""
    inner = F.array_join(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), "  \n")
    return F.when(text.rlike(FRONT), F.concat(inner, F.lit("\n"), F.regexp_replace(text, FRONT, ""))).otherwise(text)


def zero_width_fences(text: Column) -> Column:
    """Takes zero-width characters out of a fence run that opens a line, unless the run mixes backticks and tildes."""
    def one(line: Column) -> Column:
        for mark in "`~":
            run = rf"^([ \t]*(?:>[ \t]*)*)((?:{mark}[{ZERO_WIDTH}]+){{2,}}{mark})"
            line = F.when(line.rlike(run), F.concat(F.regexp_extract(line, run, 1), F.translate(F.regexp_extract(line, run, 2), ZERO_WIDTH, ""), F.regexp_replace(line, run, ""))).otherwise(line)
        return line

    return joined(F.transform(lines(text), one))


def export_timestamps(text: Column) -> Column:
    """M/D/YYYY or YYYY/M/D stamps after a Created, Updated or Exported label become ISO; impossible dates stay."""
    def rule(line: Line) -> Column:
        part = lambda k: F.regexp_extract(line.text, STAMP, k)
        number = lambda *ks: F.coalesce(*[F.nullif(part(k), F.lit("")).try_cast("int") for k in ks])
        moment = F.try_make_timestamp(number(2, 7), number(3, 5), number(4, 6), number(8), number(9), F.nullif(part(10), F.lit("")).try_cast("decimal(8,6)"))
        sound = (number(8) < 24) & (number(9) < 60) & (part(10) < "60") & moment.isNotNull() & (number(2, 7) > 0)
        return F.when(line.text.rlike(STAMP) & sound, F.concat(part(1), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), part(11))).otherwise(line.text)

    return _by_line(text, r"(?m)^\*\*(?:Created|Updated|Exported):\*\*", rule)


def metadata_breaks(text: Column) -> Column:
    """A bold label line that another follows ends in a hard break."""
    def rule(line: Line) -> Column:
        followed = _is(line.after, LABEL_LINE) & ~F.coalesce(line.after_fenced, F.lit(True))
        return F.when(_is(line.text, LABEL_LINE) & followed & ~line.text.endswith("  "), F.concat(line.text, F.lit("  "))).otherwise(line.text)

    return _by_line(text, r"(?m)^\*\*[^*\n]+:\*\*", rule)


def paren_lists(text: Column) -> Column:
    """``N)`` items become ``N.`` where a blank line, another item or the start stands before, or an item after."""
    def rule(line: Line) -> Column:
        opens = line.first | (~F.coalesce(line.before_fenced, F.lit(False)) & (_is(line.before, r"(?U)^\s*$") | _is(line.before, PAREN_ITEM)))
        goes_on = ~F.coalesce(line.after_fenced, F.lit(True)) & _is(line.after, PAREN_ITEM)
        return F.when(_is(line.text, PAREN_ITEM) & (opens | goes_on), F.regexp_replace(line.text, PAREN_ITEM, "$1$2.$3$4")).otherwise(line.text)

    return _by_line(text, r"(?mU)^\s*\d{1,9}\\?\)\s", rule)


def hashtags(text: Column) -> Column:
    """A run of # at the start of a line, right before other text, is escaped: it is no heading."""
    return _by_line(text, r"(?mU)^#+[^#\s]", lambda line: F.regexp_replace(line.text, r"(?U)^(#+)(?=[^#\s])", r"\\$1"))


def blank_before_blocks(text: Column) -> Column:
    """A list or table that follows other text gets an empty line before it."""
    block = lambda x: _is(x, LIST_ITEM) | _is(x, TABLE_ROW)

    def rule(line: Line) -> Column:
        new = block(line.text) & ~line.first & ~_is(line.before, r"(?U)^\s*$") & ~block(line.before)
        return F.when(new, F.concat(F.lit("\n"), line.text)).otherwise(line.text)

    return _by_line(text, r"(?mU)^\s*(?:[-*+]\s|\d+\.\s|\|)", rule)


def _closes(label: Column, pair: str) -> Column:
    """Whether no bracket of the pair stays open; one that closes none is passed over."""
    marks = F.split(F.regexp_replace(label, rf"[^\{pair[0]}\{pair[1]}]", ""), "")
    step = lambda mark: F.when(mark == pair[0], 1).when(mark == pair[1], -1).otherwise(0)
    return F.aggregate(marks, F.lit(0), lambda n, mark: F.greatest(F.lit(0), n + step(mark))) == 0


def promoted_labels(text: Column) -> Column:
    """A list item of a bold label, a dash and text becomes the label with the text as an item below it; a dash within brackets of the label is none."""
    def rule(line: Line) -> Column:
        label = F.regexp_extract(line.text, LABELLED, 3)
        return F.when(_is(line.text, LABELLED) & _closes(label, "()") & _closes(label, "[]"), F.regexp_replace(line.text, LABELLED, "$1$2$3\n$1  - $4")).otherwise(line.text)

    return _by_line(text, r"(?mU)^\s*(?:[-*+]|\d+\.)\s+\*\*", rule)


#: Lines of fence marks that are followed through at once, so that the letters put down for them are copied seldom.
MARKS_AT_ONCE = 1000


def _fence_kinds(marks: Column) -> Column:
    """A letter for each line of fence marks (run, bare): o opens, c closes, i stands inside a fence, which closes with as many marks of its kind and nothing behind them."""
    state = lambda fence, kinds: F.struct(fence.alias("fence"), kinds.alias("kinds"))

    def step(so_far: Column, mark: Column) -> Column:
        fence = so_far["fence"]
        kind = F.when(fence == "", "o").when(mark["bare"] & F.startswith(mark["run"], fence), "c").otherwise("i")
        return bound(kind, lambda k: state(F.when(k == "o", mark["run"]).when(k == "c", "").otherwise(fence), F.concat(so_far["kinds"], k)))

    def part(so_far: Column, k: Column) -> Column:
        some = F.slice(marks, k * MARKS_AT_ONCE + 1, F.lit(MARKS_AT_ONCE))
        return bound(F.aggregate(some, state(so_far["fence"], F.lit("")), step), lambda x: state(x["fence"], F.concat(so_far["kinds"], x["kinds"])))

    parts = F.sequence(F.lit(0), F.floor(F.size(marks) / MARKS_AT_ONCE).cast("int"))
    return F.aggregate(parts, state(F.lit(""), F.lit("")), part, lambda x: x["kinds"])


def spaced_fences(text: Column) -> Column:
    """An empty line, with the fence's own quote marks, between a fence and text right before or after it; fences inside list items, that is indented by two or more, stay."""

    def marked(rows: Column) -> Column:
        """The lines of fence marks: place, quote and indentation, run, and whether nothing stands behind it."""
        part = lambda x, k: F.regexp_extract(x, FENCE_MARKS, k)
        one = lambda x, i: F.struct(i.alias("at"), part(x, 1).alias("quote"), part(x, 2).alias("indent"), part(x, 3).alias("run"), part(x, 4).rlike(r"(?U)^\s*\z").alias("bare"))
        return F.filter(F.transform(rows, lambda x, i: F.when(_is(x, FENCE_MARKS), one(x, i))), lambda x: x.isNotNull())

    def leads(rows: Column, marks: Column, kinds: Column) -> Column:
        """For each line, and for the end, what goes before it: a map would be searched, so the few that have one are set between runs of nulls."""
        beside = F.transform(marks, lambda x, j: F.struct(F.substr(kinds, j + 1, F.lit(1)).alias("kind"), x["at"].alias("at"), F.regexp_replace(F.concat(x["quote"], x["indent"]), r"[ \t]+\z", "").alias("lead"), (F.length(x["indent"]) < 2).alias("out")))
        gap = lambda x: x["at"] + F.when(x["kind"] == "c", 1).otherwise(0)
        other = lambda x: F.get(rows, x["at"] + F.when(x["kind"] == "c", 1).otherwise(-1))
        needed = F.filter(beside, lambda x: x["out"] & (x["kind"] != "i") & ~F.coalesce(other(x).rlike(QUOTED_BLANK), F.lit(True)))
        return bound(F.transform(needed, lambda x: F.struct(gap(x).alias("gap"), x["lead"].alias("lead"))), lambda some: spread(rows, some))

    def spread(rows: Column, some: Column) -> Column:
        # between two fences the first one's: of two with one gap the second gives no line
        before = lambda j: F.when(j == 0, -1).otherwise(F.get(some, j - 1)["gap"])
        nothing = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
        runs = F.transform(some, lambda x, j: F.when(x["gap"] == before(j), nothing(F.lit(0))).otherwise(F.concat(nothing(x["gap"] - before(j) - 1), F.array(x["lead"]))))
        last = F.coalesce(F.get(some, F.size(some) - 1)["gap"], F.lit(-1))
        return F.concat(F.flatten(runs), nothing(F.size(rows) - last - 1))

    def done(rows: Column) -> Column:
        found = bound(marked(rows), lambda marks: bound(_fence_kinds(marks), lambda kinds: leads(rows, marks, kinds)))
        return F.zip_with(rows, found, lambda line, lead: F.when(lead.isNull(), line).otherwise(F.concat(lead, F.lit("\n"), line)))

    return F.when(text.rlike("```|~~~"), joined(bound(lines(text), done))).otherwise(text)


def safe_symbols(text: Column) -> Column:
    """Symbols become plain text, with a blank where a letter or digit follows.

    Symbols are first put together by their replacement, each as one private character, so that two patterns serve them all. A text that
    holds such characters itself, or no symbol, does not go that way.
    """
    classes = {chr(0xE000 + k): (plain, found.split()) for k, (plain, found) in enumerate(SYMBOLS.items())}
    marks = "[\\x{E000}-\\x{" + f"{0xE000 + len(classes) - 1:X}" + "}]"
    put = F.translate(text, "".join(x for _, found in classes.values() for x in found), "".join(mark for mark, (_, found) in classes.items() for _ in found))
    put = F.regexp_replace(F.regexp_replace(put, rf"({marks})[︎️]?(?=[\p{{L}}\p{{N}}])", "$1 "), f"({marks})[︎️]", "$1")
    one_by_one = text
    for mark, (plain, found) in classes.items():
        put = F.replace(put, F.lit(mark), F.lit(plain))
        pattern, safe = f"(?:{'|'.join(found)})[︎️]?", plain.replace("$", r"\$")
        one_by_one = F.regexp_replace(F.regexp_replace(one_by_one, pattern + r"(?=[\p{L}\p{N}])", safe + " "), pattern, safe)
    some = f"[{''.join(x for _, found in classes.values() for x in found)}]"
    return F.when(~text.rlike(some), text).when(text.rlike(marks), one_by_one).otherwise(put)


def emoji(text: Column) -> Column:
    """The distinct emoji sequences of a text in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({EMOJI_SEQUENCE})"), 1))


#: What keeps its emoji as they are, an image cannot stand in it; and where images are.
PREFORMATTED, EMOJI_FOLDER = r"<pre\b[\s\S]*?</pre\s*>", "images"


def emoji_asset(sequence: Column) -> Column:
    """The name of an emoji's image, by its content: the same in all documents."""
    return F.concat(F.lit(f"{EMOJI_FOLDER}/emoji-"), F.left(F.sha2(sequence, 256), F.lit(16)), F.lit(".png"))


def with_emoji_images(text: Column) -> Column:
    """A text with an image for each emoji sequence, the sequence as the text in its place; what is preformatted stays."""
    pattern = f"(?:(?i){PREFORMATTED})|{EMOJI_SEQUENCE}"
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
    image = lambda m: F.concat(F.lit('<img class="emoji-img" src="'), emoji_asset(m), F.lit('" alt="'), m, F.lit('"/>'))
    whole = F.zip_with(between, found, lambda x, m: F.concat(x, F.when(m.isNull(), "").when(m.rlike("(?i)^<pre"), m).otherwise(image(m))))
    return F.when(text.rlike(EMOJI_SEQUENCE), F.array_join(whole, "")).otherwise(text)


def emoji_assets(documents: DataFrame, by: str, text: str) -> DataFrame:
    """(number, asset, sequence, documents, places): the images that the documents need, each once, numbered by first appearance: by document, then by place in it."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(f"((?:(?i){PREFORMATTED})|{EMOJI_SEQUENCE})"), 1), lambda m: ~m.rlike("(?i)^<pre"))
    rows = documents.where(F.col(text).rlike(EMOJI_SEQUENCE)).select(F.col(by).alias("of"), F.posexplode(found).alias("place", "sequence"))
    one = rows.groupBy("sequence", "of").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).groupBy("sequence").agg(F.min(F.struct("of", "place")).alias("first"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("places"))
    # a row a distinct sequence: as many as there are emoji
    return one.select(F.row_number().over(Window.orderBy("first")).alias("number"), emoji_asset(F.col("sequence")).alias("asset"), "sequence", "documents", "places")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def page_slug(text: Column, default: str | None = "page") -> Column:
    """A slug cut at 60 characters after trimming, so it may end in a dash."""
    found = F.nullif(F.left(slug(text), F.lit(60)), F.lit(""))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def clean_text(text: Column) -> Column:
    """Drops inline links, squeezes blanks and takes those before punctuation away. A pattern is tried only where what it needs is there."""
    has = lambda x, *marks: F.greatest(*[F.contains(x, F.lit(m)) for m in marks]) if len(marks) > 1 else F.contains(x, F.lit(marks[0]))
    unlinked = F.when(has(text, "]("), F.regexp_replace(text, INLINE_LINK, "")).otherwise(text)

    def squeezed_blanks(x: Column) -> Column:
        single = F.when(has(x, "  ", "\t"), F.regexp_replace(x, r"[ \t]{2,}", " ")).otherwise(x)
        return F.trim(F.when(has(x, " .", " ,", " ;", " :", "\t"), F.regexp_replace(single, r"[ \t]+([.,;:])", "$1")).otherwise(single))

    return bound(unlinked, squeezed_blanks)


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?;])\s+"), lambda x: F.trim(x) != "")


def n_words(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def first_words(text: Column, cap: int) -> Column:
    """The text itself up to ``cap`` words, else its first ``cap`` words between single blanks."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.when(F.size(words) <= cap, text).otherwise(F.array_join(F.slice(words, 1, cap), " "))


def versioned_title(title: Column, stem: Column) -> Column:
    """A ``_V2`` stem puts `` (V2)`` after the title, once."""
    mark = F.concat(F.lit(" (V"), F.regexp_extract(stem, r"_[Vv](\d+)$", 1), F.lit(")"))
    return F.when(stem.rlike(r"_[Vv]\d+$") & ~title.endswith(mark), F.concat(title, mark)).otherwise(title)


NORMALISERS = (front_matter, zero_width_fences, export_timestamps, metadata_breaks, paren_lists, hashtags, blank_before_blocks)
