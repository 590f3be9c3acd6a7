"""HTML extraction (operator 5): the contiguous region of a page with the highest score.

A page is a row of tags and runs of words. Words score positive and tags negative, and words in
boilerplate (menus, adverts, comments and the like) slightly negative; the weights are log-odds
learned from labelled pages. One linear scan finds the best contiguous region; its words, without
those in boilerplate, are the main text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import freeing, small_batches, table
from canvass.llm.htmlpages import BOILERPLATE_NAMES, LABELLED_PAGES, PLACE_NAMES, STATE_NAMES

#: Elements whose content is never text (fixed by HTML).
RAW = "script style template iframe svg textarea"
#: Raw elements that run to the end of the page where unclosed, and elements that may close themselves (fixed by HTML).
RUNS_ON, SELF_CLOSED = frozenset(("script", "style", "textarea")), frozenset(("svg", "math"))
#: Elements that begin and end a block of text (fixed by HTML).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element's end is left out where one of these opens (fixed by HTML).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))
#: Elements that are boilerplate by what they are, and those whose names say something of the whole page.
BESIDES, WHOLE = frozenset(("nav", "aside", "footer", "header", "form")), frozenset(("html", "body"))
BESIDE = "beside-main"
#: Share of the page's words outside boilerplate from which an element of MAIN is the page's, and doubtful names don't count.
MAIN_SHARE = 0.5
_BOILERPLATE, _PLACES, _STATES = frozenset(BOILERPLATE_NAMES), frozenset(PLACE_NAMES), frozenset(STATE_NAMES)

#: Log-odds below which a feature makes its words boilerplate (one word in twenty is main text), and what such a word scores.
VETO, BOILERPLATE = -3.0, -0.25
_TOKENS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])([^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_RAW_ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW.split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HAS_MAIN = re.compile(r"<(?:article|main)[\s/>]", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Piece:
    """A run of text with its context, or a tag (``text`` None)."""

    text: str | None
    tag: str
    node: int
    label: str | None
    breaks: bool = False
    closes: bool = False
    features: frozenset[str] = frozenset()


@dataclass
class Node:
    """An open element: the one around it, its tag and names, and the words in it outside boilerplate.

    ``named`` is 2 if a name says that this is boilerplate, 1 if one may say so, else 0; ``out`` is whether it lies in boilerplate.
    """

    parent: int
    tag: str
    names: frozenset[str] = frozenset()
    named: int = 0
    out: bool = False
    words: int = 0


def names_of(values: Iterable[str]) -> tuple[frozenset[str], int]:
    """The parts of all names in class, id and role, and how much they say of boilerplate.

    ``comments`` or ``footer-links`` say that an element is boilerplate: besides a name of boilerplate there are
    only places. ``blog-search`` may say so; ``has-sidebar`` or ``menu-open`` say something else and are left out.
    """
    found, named = set(), 0
    for token in " ".join(values).split():
        parts = {x.lower() for x in _PARTS.findall(token)}
        if parts & _STATES:
            continue
        found |= parts
        if parts & _BOILERPLATE:
            named = max(named, 2 if parts <= _BOILERPLATE | _PLACES else 1)
    return frozenset("." + x for x in found), named


def pieces(html: str, lenient: bool = False) -> list[Piece]:
    """The page as a row of tags and texts; features are the open elements and names in their class, id and role.

    What encloses the page's own article or main says nothing about it, nor do its names; words beside it are marked. One
    is the page's own if it holds much of the page's words, so that teasers and comments in articles are like any other
    element. Names of html and body don't count, and doubtful names (with ``lenient`` all) not where an element holds much
    of the words.
    """
    nodes = [Node(0, "")]
    row = list(_parsed(html, nodes, lenient))
    for piece in row:
        if piece.text is not None and not nodes[piece.node].out:
            nodes[piece.node].words += len(piece.text.split())
    for node in reversed(nodes[1:]):
        nodes[node.parent].words += node.words
    much = max(1, MAIN_SHARE * nodes[0].words)
    features, inside, own = [frozenset()], [False], False
    for node in nodes[1:]:
        main = node.tag in MAIN and node.words >= much
        names = node.names if node.tag not in WHOLE and not main and (node.words < much or node.named == (0 if lenient else 2) or not node.named) else frozenset()
        features.append(frozenset((node.tag,)) if main else features[node.parent] | names | {node.tag})
        inside.append(main or inside[node.parent])
        own |= main
    for piece in row:
        piece.features = features[piece.node]
        if own and piece.text is not None and not inside[piece.node]:
            piece.features |= {BESIDE}
    return row


def _parsed(html: str, nodes: list[Node], lenient: bool) -> Iterator[Piece]:
    """The pieces, with the number of the element they are in; ``nodes`` gets the elements."""
    stack: list[tuple[str, int, str | None]] = [("", 0, None)]
    at, unclosed = 0, set()
    while m := _TOKENS.match(html, at):
        at = m.end()
        raw, inside, closing, name, attributes = m.groups()
        if raw:
            name, attributes = raw.lower(), inside
            if name in SELF_CLOSED and inside.endswith("/"):
                continue
            if name not in unclosed:
                if end := _RAW_ENDS[name].search(html, at):
                    at = end.end()
                    continue
                unclosed.add(name)  # looked for once, however many are open
            if name in RUNS_ON:
                break
        if name is None:
            whole = m.group()
            if whole == "<" or whole[0] != "<":
                _, node, label = stack[-1]
                yield Piece(whole, "", node, label)
            continue
        name = name.lower()
        if name in SELF_CLOSED and attributes.endswith("/"):
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                del stack[depth:]
        elif name not in VOID:
            ends = {"p"} if name in BLOCKS else set()
            ends |= CLOSES.get(name, set())
            while stack[-1][0] in ends:
                stack.pop()
            _, parent, label = stack[-1]
            node = Node(parent, name, out=nodes[parent].out or name in BESIDES)
            if "=" in attributes:
                given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
                label = given.get("data-label", label)
                node.names, node.named = names_of(given.get(k, "") for k in ("class", "id", "role"))
                node.out |= node.named == 2 and not lenient and name not in MAIN | WHOLE
            nodes.append(node)
            stack.append((name, len(nodes) - 1, label))
        yield Piece(None, name, stack[-1][1], None, name in BLOCKS, bool(closing))


def scored_tags(row: list[Piece]) -> list[bool]:
    """Which pieces are tags that count: empty elements don't, and of void ones that follow each other only the first."""
    counts = [p.text is None for p in row]
    opened: list[int] = []
    void = False
    for i, p in enumerate(row):
        if p.text is not None:
            if not p.text.isspace():
                opened, void = [], False
        elif p.tag in VOID:
            counts[i], void = not void, True
        elif not p.closes:
            opened.append(i)
        elif opened and row[opened[-1]].tag == p.tag:
            counts[opened.pop()] = counts[i] = False
        else:
            opened = []
    return counts


@dataclass
class Weights:
    """Log-odds by feature (words) and scores by tag; ``prior`` is the log-odds of all words."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0

    def of_word(self, features: frozenset[str]) -> float:
        found = [self.words.get(f, self.prior) for f in features]
        if any(self.words.get(f, self.prior) < VETO for f in features if f != BESIDE):
            return BOILERPLATE
        return min(max(1.0 + sum(x - self.prior for x in found), 0.05), 3.0)

    def of_tag(self, tag: str) -> float:
        return self.tags.get(tag, -0.5)


def learn(labelled: tuple[str, ...] = LABELLED_PAGES) -> Weights:
    """Log-odds of features for words in and out of the main text, and of tags, from labelled pages.

    An element's attribute ``data-label`` (main or other) labels the words in it.
    """
    words: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    tags: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    total, all_tags = [0.5, 0.5], [0.5, 0.5]
    for page in labelled:
        label = 0  # of the words before a tag
        for piece in pieces(page):
            if piece.text is None:
                tags[piece.tag][label] += 1
                all_tags[label] += 1
            elif n := len(piece.text.split()):
                label = int(piece.label == "main")
                total[label] += n
                for f in piece.features:
                    words[f][label] += n
    odds = lambda x: math.log(x[1] / x[0])
    return Weights(
        {f: odds(x) for f, x in words.items()},
        {t: -0.1 - 0.4 / (1 + math.exp(odds(x) - odds(all_tags))) for t, x in tags.items()},
        odds(total),
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the highest sum (the first of equal ones, empty if none is above 0), in one scan."""
    best = run = 0.0
    start = first = last = 0
    for i, score in enumerate(scores):
        run += score
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, first, last = run, start, i + 1
    return first, last


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best region, one to a line; white space inside a block is one space."""
    found = _best_text(pieces(html or ""), weights)
    if not found and html and not _HAS_MAIN.search(html):
        found = _best_text(pieces(html, lenient=True), weights)  # names said of all words that they are boilerplate
    return found


def _best_text(row: list[Piece], weights: Weights) -> str:
    known: dict[frozenset[str], float] = {}
    scores = []
    for piece, counts in zip(row, scored_tags(row)):
        if piece.text is None:
            scores.append(weights.of_tag(piece.tag) if counts else 0.0)
        else:
            if piece.features not in known:
                known[piece.features] = weights.of_word(piece.features)
            scores.append(known[piece.features] * len(piece.text.split()))
    first, last = best_region(scores)
    blocks, block = [], []
    for piece in row[first:last]:
        if piece.breaks:
            blocks.append("".join(block))
            block = []
        elif piece.text is None:
            if piece.tag == "br":
                block.append(" ")
        elif known[piece.features] > 0:
            block.append(piece.text)
    blocks.append("".join(block))
    return "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text`` of every row, from the whole page.

    Null and empty pages, and those without words, give an empty text; plain text without tags is all
    main text. Of regions with one score the first is taken; pages of any length are read whole; an empty table gives an
    empty one. Elements may be unclosed or closed out of order. Repeated rows and nulls in other
    columns keep their rows; further columns of ``pages`` are not read.
    """
    weights = weights or learn()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(text=[main_text(h, weights) for h in x.pop("html")])

    schema = pages.select("page_id", "url", F.lit("").alias("text")).schema
    return pages.select("page_id", "url", "html").mapInPandas(freeing(run), schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
