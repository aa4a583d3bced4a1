"""Main text of web pages: flat text blocks, judged by a small decision tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import map_arrow, record, slices
from feedloom.llm.html_samples import PAGES

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "article", "chrome", "heading")
TREE_DEPTH = 6

# Elements whose text runs on in the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
# Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("script style title textarea noscript template iframe svg select object".split())
# Start tags that leave an svg, and elements of an svg that hold HTML of their own.
LEAVE_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
HOLD_HTML = frozenset("foreignobject desc title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that say nothing about what they hold, so that it does not matter where they end.
FLAT = HEADINGS | frozenset("p html body head li dt dd tr td th thead tbody tfoot option".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
# Roles, and words in classes and ids, of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
HINTS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal "
    "overlay sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer footnav comment comments disqus "
    "respond replies related recommended share sharing social newsletter subscribe subscription signup login search pagination pager".split()
)

# A tag without its ">" ends at the next "<" or with the page, and a quote that nothing closes is a character like
# others. So every character is read once, but for one closing quote of each kind sought in vain.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?\Z|"""
    r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|(?=<)|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_SPACE = re.compile(r"\s+")


def _chrome(name: str, attributes: str, article: bool) -> bool:
    if name in CHROME:
        return not (name == "header" and article)
    if not attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape("".join(values)).lower()
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and HINTS.intersection(re.split(r"[^a-z]+", value)):
            return True
    return False


def _svg_end(page: str, at: int, around: Counter[str]) -> int:
    """Where an svg ends whose content begins at ``at``: after its end tag, or before a tag that leaves it.

    These are the start tags of ``LEAVE_SVG`` and the end tags of ``FLAT`` elements and those ``around`` it.
    """
    depth, inner, held = 1, [], Counter()
    for tag in _TAG.finditer(page, at):
        name = (tag[2] or "").lower()
        if not name or tag[3].endswith("/"):
            continue
        if name in HOLD_HTML:
            if not tag[1]:
                inner.append(name)
                held[name] += 1
            elif held[name] > 0:
                _close(inner, held, name)
        elif name == "svg":
            depth += -1 if tag[1] else 1
            if not depth:
                return tag.end()
        elif not inner and (name in FLAT or around[name] > 0 if tag[1] else name in LEAVE_SVG):
            return tag.start()
    return len(page)


def _close(names: list[str], held: Counter[str], name: str) -> None:
    """Take the last ``name``, and all opened after it, off the open ``names``, which ``held`` counts."""
    while True:
        last = names.pop()
        held[last] -= 1
        if last == name:
            return


def _object_ends(page: str) -> dict[int, int]:
    """Where the content of each closed object begins and where the object ends."""
    ends, opened = {}, []
    for tag in _TAG.finditer(page):
        if (tag[2] or "").lower() == "object":
            if not tag[1]:
                opened.append(tag.end())
            elif opened:
                ends[opened.pop()] = tag.end()
    return ends


def blocks(page: str | None) -> list[tuple[str, int, bool, bool, bool]]:
    """Text blocks of a page in order: text, characters of it in links, in an article, in page chrome, heading.

    A block ends at every tag that is not inline. References are decoded after the tags
    are found, white space becomes one space, empty blocks are left out. Unclosed and
    stray tags are taken as browsers do in simple cases: an end tag closes what is open
    above its partner, one without partner closes nothing. An svg ends at the latest where
    a block follows or an element around it ends; what follows an unclosed object is text of the page.
    The time is linear in the page, torn tags, open quotes, deep nesting and stray end tags included.
    """
    if not page:
        return []
    found: list[tuple[str, int, bool, bool, bool]] = []
    open_tags: list[str] = []
    held: Counter[str] = Counter()
    outside: list[tuple[bool, bool]] = []
    article = chrome = False
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, False
    objects: dict[int, int] | None = None

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            inside = _SPACE.sub(" ", unescape(" ".join(linked))).strip()
            found.append((text, min(len(inside), len(text)), article, chrome, heading))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if tag[1] else 1
            continue
        close()
        heading = name in HEADINGS and not tag[1]
        in_link = 0
        if name in RAW and not tag[1]:
            if not tag[3].endswith("/") or name in ("script", "style", "title"):
                if name == "svg":
                    at = _svg_end(page, at, held)
                elif name == "object":
                    objects = _object_ends(page) if objects is None else objects
                    at = objects.get(at, at)
                else:
                    stop = re.compile(rf"</{name}\b[^<>]*+(?:>|(?=<)|\Z)", re.I).search(page, at)
                    at = stop.end() if stop else end
        elif name not in VOID and name not in FLAT:
            if not tag[1]:
                if not tag[3].endswith("/"):
                    open_tags.append(name)
                    held[name] += 1
                    outside.append((article, chrome))
                    chrome = chrome or _chrome(name, tag[3], article)
                    article = article or name in ("article", "main")
            elif held[name] > 0:
                _close(open_tags, held, name)
                article, chrome = outside[len(open_tags)]
                del outside[len(open_tags) :]
    close()
    return found


def features(found: list[tuple[str, int, bool, bool, bool]]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; what lies before the first and after the last has no words."""
    own = np.array([[b[0].count(" ") + 1, b[1] / len(b[0])] for b in found]).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    flags = np.array([b[2:] for b in found], float).reshape(-1, 3)
    return np.hstack((own, before[: len(own)], after[: len(own)], flags))


def labelled() -> list[tuple[float, list[float]]]:
    """The training table: label and features of every sample block. The sign in front is no part of the text."""
    table = []
    for page in PAGES:
        found = blocks(page)
        signs = [b[0][0] == "+" for b in found]
        bare = [(b[0][1:].strip(), b[1], *b[2:]) for b in found]
        table += [(float(s), row) for s, row in zip(signs, features(bare).tolist(), strict=True)]
    return table


@dataclass
class Tree:
    """Nodes of a fitted tree: feature (-1 at leaves), threshold, left and right node, prediction."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), int)
        while (inner := self.feature[node] >= 0).any():
            some = node[inner]
            below = rows[inner, self.feature[some]] <= self.threshold[some]
            node[inner] = np.where(below, self.left[some], self.right[some])
        return self.main[node]


def train(spark: SparkSession, depth: int = TREE_DEPTH) -> Tree:
    """Decision tree over the labelled table, fitted by Spark ML."""
    table = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in labelled()], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table)
    nodes: list[list[float]] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            nodes[at][:2] = [split.featureIndex(), split.threshold()]
            nodes[at][2] = walk(node.leftChild())
            nodes[at][3] = walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    feature, threshold, left, right, main = zip(*nodes, strict=True)
    return Tree(np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(main) > 0.5)


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, main in zip(found, tree.predict(features(found)), strict=True) if main)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Each page is cut into flat blocks; the tree judges a block by its words and link
    density, those of its neighbours, and whether it stands in an article, in page chrome
    or in a heading. Blocks of main text are joined in page order. A null or empty page,
    or one without main text, gives an empty text of no characters. Repeated rows are
    read as often as they come, other columns ignored, long pages read whole. Pages stay
    where they are: nothing is shuffled.
    """
    sent = pages.sparkSession.sparkContext.broadcast(tree or train(pages.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [main_text(page.as_py(), sent.value) for page in batch.column(2)]
            columns = {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}
            yield record(_TEXTS, columns)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
