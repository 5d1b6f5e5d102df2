"""Diagrams in text: parsing to nodes and edges, depth and direction, and the gate for those that would not be drawn."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Brackets of a node by its shape, arrows by their style, openings of lines that draw nothing.
SHAPES = {"((": ("))", "circle"), "[": ("]", "box"), "{": ("}", "diamond"), "(": (")", "round")}
ARROWS = {"<-->": "solid", "<==>": "solid", "-.->": "dashed", "-->": "solid", "==>": "solid"}
SILENT_LINES = ("classdef", "class ", "style ", "click ", "%%", "linkstyle", "direction ")
DIRECTIONS = ("TB", "TD", "BT", "RL", "LR")
NAME = re.compile(r"[A-Za-z_][\w-]*?(?=\s*(?:$|[\[({]|<?--|<?==|-\.))|[A-Za-z_][\w-]*")
TRANSITION = re.compile(r"(\[\*\]|[\w.-]+)\s*-->\s*(\[\*\]|[\w.-]+)\s*(?::\s*(.*))?$")
ALIAS = re.compile(r'state\s+"([^"]*)"\s+as\s+([\w.-]+)\s*$', re.I)
PARTICIPANT = re.compile(r"(?:participant|actor)\s+([\w.-]+)(?:\s+as\s+(.+))?$", re.I)
MESSAGE = re.compile(r"([\w.]+(?:-[\w.]+)*)\s*(-->>|->>|-->|->)\s*([\w.-]+)\s*:\s*(.*)$")

GLYPH = r"[─-◿←-⇿]"
BOX = r"[─-◿]"
CONNECTOR = r"-->|<--|->|<-|==>|=>|\+-{2,}|-{2,}\+"
STROKES = r"(?U)^[\s|│┃v^↓↑▼▲+\-─=]+$"
TALL = 6


def _label(text: str | None) -> str | None:
    text = re.sub(r"<br\s*/?>", " ", text or "", flags=re.I).strip().strip('"').strip()
    return text or None


class Reader:
    """A line of a flowchart read from left to right: each method takes what it names off the front, or gives None and leaves the line."""

    def __init__(self, line: str) -> None:
        self.left = line.strip()

    def _take(self, n: int) -> str:
        taken, self.left = self.left[:n], self.left[n:].lstrip()
        return taken

    def node(self) -> tuple[str, str | None, str | None] | None:
        """(name, shape, label)"""
        if (m := NAME.match(self.left)) is None:
            return None
        name = self._take(m.end())
        opening = next((o for o in SHAPES if self.left.startswith(o)), None)
        if opening is None:
            return name, None, None
        closing, shape = SHAPES[opening]
        end = self.left.find(closing, len(opening))
        inner = self.left[len(opening) : end]
        if end < 0 or any(c in inner for c in opening[0] + closing[0]):
            return name, None, None
        self._take(end + len(closing))
        return name, shape, _label(inner)

    def arrow(self) -> tuple[str, bool, str | None] | None:
        """(style, both ways, label): the label between bars behind the arrow, or within it."""
        plain = next((a for a in ARROWS if self.left.startswith(a)), None)
        if plain is not None:
            self._take(len(plain))
            bar = self.left.find("|", 1) if self.left.startswith("|") else -1
            return ARROWS[plain], plain[0] == "<", _label(self._take(bar + 1)[1:-1]) if bar > 0 else None
        if self.left.startswith("-."):
            end = self.left.find(".->", 2)
            return None if end < 0 or "." in self.left[2:end] else ("dashed", False, _label(self._take(end + 3)[2:-3]))
        if self.left.startswith(("-- ", "== ")):
            ends = [k for k in (self.left.find(f" {a}", 3) for a in ("-->", "==>")) if k > 0]
            return ("solid", False, _label(self._take(min(ends) + 4)[2:-3])) if ends else None
        return None


def _group(line: str) -> str | None:
    """The title of a subgraph line: in brackets behind its name, in quotes, or the rest of it."""
    word, _, rest = line.partition(" ")
    if word.lower() != "subgraph" or not rest.strip():
        return None
    rest = rest.strip()
    name, bracket, inner = rest.partition("[")
    return (_label(inner[:-1]) if bracket and rest.endswith("]") and NAME.fullmatch(name.strip()) else _label(rest)) or ""


def flowchart(source: str) -> list[dict] | None:
    """Rows (kind, src, dst, label, style, bidirectional) of a flowchart: its direction, nodes in order, edges, and lines not understood; None for anything else."""
    lines = [s for x in source.splitlines() if (s := x.strip())]
    head = lines[0].split() if lines else []
    if len(head) < 2 or head[0].lower() not in ("flowchart", "graph") or head[1].rstrip(";").upper() not in DIRECTIONS:
        return None
    nodes: dict[str, dict] = {}
    edges, unknown, path = [], [], []
    row = lambda kind, src, dst=None, label=None, style=None, both=None: {"kind": kind, "src": src, "dst": dst, "label": label, "style": style, "bidirectional": both}

    def see(name: str, shape: str | None, label: str | None) -> None:
        node = nodes.setdefault(name, row("node", name, "/".join(path) or None))
        if shape:
            node["style"], node["label"] = shape, label

    for line in lines[1:]:
        if line.lower().startswith(SILENT_LINES):
            continue
        if (title := _group(line)) is not None:
            path.append(title)
            continue
        if line.lower() == "end":
            del path[-1:]
            continue
        reader = Reader(line)
        first = reader.node()
        arrow = reader.arrow() if first and reader.left else None
        second = reader.node() if arrow else None
        if first is None or reader.left or arrow and second is None:
            unknown.append(row("unparsed", line))
            continue
        see(*first)
        if arrow:
            see(*second)
            style, both, label = arrow
            edges.append(row("edge", first[0], second[0], label, style, both))
    if not nodes:
        return None
    top = head[1].rstrip(";").upper()
    return [row("direction", "TB" if top == "TD" else top), *nodes.values(), *edges, *unknown]


def state_diagram(source: str) -> list[dict] | None:
    """As flowchart(), of a state diagram, with its direction where it states one; every [*] is a state of its own."""
    lines = [s for x in source.splitlines() if (s := x.strip().rstrip(";"))]
    if not lines or not lines[0].lower().startswith("statediagram"):
        return None
    labels: dict[str, str | None] = {}
    edges, pseudo, top = [], 0, []
    for line in lines[1:]:
        word, _, way = line.partition(" ")
        if word.lower() == "direction" and way.strip().upper() in DIRECTIONS:
            way = way.strip().upper()
            top = [{"kind": "direction", "src": "TB" if way == "TD" else way, "dst": None, "label": None, "style": None, "bidirectional": None}]
        elif a := ALIAS.match(line):
            labels[a[2]] = a[1]
        elif t := TRANSITION.match(line):
            ends = []
            for token in (t[1], t[2]):
                if token == "[*]":
                    token, pseudo = f"[*]{pseudo}", pseudo + 1
                labels.setdefault(token, None)
                ends.append(token)
            edges.append({"kind": "edge", "src": ends[0], "dst": ends[1], "label": _label(t[3]), "style": "solid", "bidirectional": False})
    nodes = [{"kind": "node", "src": k, "dst": None, "label": v, "style": "pseudo" if k.startswith("[*]") else "state", "bidirectional": None} for k, v in labels.items()]
    return [*top, *nodes, *edges] if nodes else None


def sequence_diagram(source: str) -> list[dict] | None:
    """As flowchart(), of a sequence diagram: participants in the order they are first seen, messages; two dashes make it dashed."""
    lines = [s for x in source.splitlines() if (s := x.strip())]
    if not lines or not lines[0].lower().startswith("sequencediagram"):
        return None
    people: dict[str, str] = {}
    sent = []
    for line in lines[1:]:
        if p := PARTICIPANT.match(line):
            people[p[1]] = (p[2] or p[1]).strip()
        elif m := MESSAGE.match(line):
            people.setdefault(m[1], m[1])
            people.setdefault(m[3], m[3])
            sent.append({"kind": "edge", "src": m[1], "dst": m[3], "label": m[4].strip(), "style": "dashed" if m[2].startswith("--") else "solid", "bidirectional": False})
    if not sent:
        return None
    return [*({"kind": "node", "src": k, "dst": None, "label": v, "style": "participant", "bidirectional": None} for k, v in people.items()), *sent]


QUOTED_ID = re.compile(r'\bid\s*:\s*"([^"]*)"')


def git_graph(source: str) -> list[dict] | None:
    """As flowchart(), of a git graph: a node per commit, numbered over all branches, edges to its parents.

    A new branch has no commit of its own, so merging it as it is does nothing; its first commit hangs from where it left its parent.
    Declaring a branch again only goes to it. Of a line's options the id alone names a node.
    """
    lines = [s for x in source.splitlines() if (s := x.strip().rstrip(";"))]
    if not lines or not lines[0].lower().startswith("gitgraph"):
        return None
    own: dict[str, list[str]] = {"main": []}  # a branch's commits
    start: dict[str, str | None] = {"main": None}  # the commit that it left from
    at, nodes, edges = "main", [], []

    def commit(label: str | None, merged: str | None = None) -> None:
        name, before = f"c{len(nodes)}", own[at][-1] if own[at] else start[at]
        nodes.append({"kind": "node", "src": name, "dst": at, "label": label, "style": "commit", "bidirectional": None})
        edges.extend({"kind": "edge", "src": p, "dst": name, "label": None, "style": "solid", "bidirectional": False} for p in (before, merged) if p)
        own[at].append(name)

    for line in lines[1:]:
        word, _, rest = line.partition(" ")
        name = (rest.split() or [""])[0]
        label = m[1] if (m := QUOTED_ID.search(rest)) else None
        if word == "commit":
            commit(label)
        elif word == "branch" and name:
            if name not in own:
                own[name], start[name] = [], own[at][-1] if own[at] else start[at]
            at = name
        elif word in ("checkout", "switch") and name in own:
            at = name
        elif word == "merge" and own.get(name):
            commit(label or f"merge {name}", own[name][-1])
    return [*nodes, *edges] if nodes else None


PARSERS = (flowchart, state_diagram, sequence_diagram, git_graph)
PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "src", "dst", "label", "style")]).add("bidirectional", T.BooleanType())


@F.pandas_udf(T.ArrayType(PARTS))
def parsed(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else next((x for p in PARSERS if (x := p(s)) is not None), None))


#: Edges of a graph that one task folds; a larger one goes round by round.
FOLDED = 100_000


def longest_path(edges: list[tuple[str, str]]) -> int | None:
    """Nodes on the longest path of a directed graph, None where it has a cycle: nodes are taken off as soon as all that lead to them are gone."""
    after: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    depth = dict.fromkeys(waits, 1)
    free = [n for n, k in waits.items() if k == 0]
    gone = 0
    while free:
        node = free.pop()
        gone += 1
        for other in after.get(node, ()):
            depth[other] = max(depth[other], depth[node] + 1)
            waits[other] -= 1
            if waits[other] == 0:
                free.append(other)
    return max(depth.values()) if gone == len(waits) else None


def depths(edges: DataFrame, by: str = "graph_id", folded: int = FOLDED) -> DataFrame:
    """(by, depth): nodes on the longest path of each directed graph, null where it has a cycle.

    A graph of up to ``folded`` edges is folded in one task; larger ones are relaxed round by round, all of them at once.
    """
    edges = edges.select(by, "src", "dst").distinct()
    sizes = edges.groupBy(by).agg(F.count(F.lit(1)).alias("edges"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        found = longest_path(list(zip(rows["src"], rows["dst"], strict=True)))
        return pd.DataFrame({by: [rows[by].iloc[0]], "depth": pd.array([found], "Int32")})

    kind = dict(edges.dtypes)[by]
    small = edges.join(sizes.where(F.col("edges") <= folded).select(by), by, "left_semi").groupBy(by).applyInPandas(fold, f"`{by}` {kind}, depth int")
    large = edges.join(sizes.where(F.col("edges") > folded).select(by), by, "left_semi")
    return small if sizes.where(F.col("edges") > folded).isEmpty() else small.unionByName(_relaxed(large, by))


def _relaxed(edges: DataFrame, by: str) -> DataFrame:
    """depths() round by round: a graph with n nodes that still grows after n rounds has a cycle."""
    from inkwell.plans.lineage import cut

    nodes = edges.select(by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    length = cut(nodes.join(sizes, by).withColumn("depth", F.lit(1)).withColumn("grown", F.lit(True)))
    while True:
        # only nodes that have grown can make others grow
        step = length.where("grown").select(by, F.col("node").alias("src"), (F.col("depth") + 1).alias("next"))
        longer = edges.join(step, [by, "src"]).groupBy(by, F.col("dst").alias("node")).agg(F.max("next").alias("next"))
        grows = F.coalesce((F.col("next") > F.col("depth")) & (F.col("depth") <= F.col("n")), F.lit(False))
        length = cut(length.drop("grown").join(longer, [by, "node"], "left").select(by, "node", "n", F.when(grows, F.col("next")).otherwise(F.col("depth")).alias("depth"), grows.alias("grown")))
        if length.where("grown").isEmpty():
            break
    found = length.groupBy(by, "n").agg(F.max("depth").alias("depth"))
    return found.select(by, F.when(F.col("depth") <= F.col("n"), F.col("depth")).alias("depth"))


def directions(graphs: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, direction): a top-to-bottom graph that fans out wider than it is deep runs left to right."""
    wide = edges.groupBy(by, "src").agg(F.count(F.lit(1)).alias("k")).groupBy(by).agg(F.max("k").alias("fan"))
    both = graphs.join(wide, by, "left").join(depths(edges, by), by, "left")
    turned = F.col("direction").isin("TB", "BT") & (F.coalesce("fan", F.lit(1)) > F.col("depth"))
    return both.select(by, F.when(turned & (F.col("direction") == "TB"), "LR").when(turned, "RL").otherwise(F.col("direction")).alias("direction"))


def _structural(line: Column) -> Column:
    return (F.trim(line) != "") & (line.rlike(BOX) | line.rlike(CONNECTOR) | (line.rlike(STROKES) & line.rlike(r"[|│┃v^↓↑▼▲+\-─=]")))


def is_flow_diagram(text: Column) -> Column:
    """At least two lines with box glyphs, connectors or nothing but strokes."""
    return F.size(F.filter(F.split(text, "\n"), _structural)) >= 2


def is_text_diagram(text: Column) -> Column:
    """Any box or arrow glyph, or two lines of connectors."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.exists(rows, lambda x: x.rlike(GLYPH)) | (F.size(F.filter(rows, lambda x: x.rlike(CONNECTOR) | x.rlike(STROKES))) >= 2)


def problems(fences: DataFrame) -> DataFrame:
    """(doc_id, line, problem) of (doc_id, line, lang, text) fences that would not be drawn: an empty result lets a document pass."""
    plain = F.coalesce("lang", F.lit("")).isin("", "text", "txt", "plaintext", "plain", "ascii", "diagram")
    size = F.size(F.split(F.btrim(F.col("text"), F.lit("\n")), "\n"))
    tall = fences.where(plain & (size > TALL) & is_flow_diagram(F.col("text"))).select("doc_id", "line", F.concat(size.cast("string"), F.lit("-line diagram must be a mermaid flowchart")).alias("problem"))
    drawn = fences.where("lang = 'mermaid'").withColumn("parts", parsed(F.col("text")))
    broken = drawn.where("parts IS NULL").select("doc_id", "line", F.lit("mermaid fence does not render").alias("problem"))
    lost = drawn.select("doc_id", "line", F.explode("parts").alias("p")).where("p.kind = 'unparsed'").select("doc_id", "line", F.concat(F.lit("line would be dropped: "), F.col("p.src")).alias("problem"))
    return tall.unionByName(broken).unionByName(lost)


def fit_scale(width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(1072.0) / width, F.lit(1448.0) / height)
