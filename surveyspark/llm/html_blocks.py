"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its word count and
link density, those of its neighbours, and two marks of where it stands (inside a boilerplate
element, inside an article). A decision tree, trained here on the labelled table `EXAMPLES`, tells
text from boilerplate: where a page has an article its marks weigh most, elsewhere counts and
densities do. Class names of layout wrappers do not mark an article inside them. Scripts, styles,
forms' fields, comments and head matter never become blocks.

Edge cases: null and empty pages have empty text; unclosed and stray tags are tolerated, and end
tags that may be left out (head, p, li, option) end where the next element begins; repeated
rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markup: comments, tags with quotes that count only behind an equals sign, declarations.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>"
    r"|<[!?][^>]*>",
    re.DOTALL,
)
#: Elements skipped up to their end tag; without one, those of plain text go on to the end of the page.
PLAIN_TEXT = frozenset("script style textarea title iframe".split())
SKIPPED = PLAIN_TEXT | frozenset("noscript template select button svg object head".split())
END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in SKIPPED}
#: Start tags that do not end a head whose end tag is left out.
IN_HEAD = SKIPPED | frozenset("html meta link base".split())
#: Elements that stay inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text.
OUTSIDE = frozenset(
    "nav header footer aside form menu dialog fieldset figcaption option optgroup datalist".split()
) | (SKIPPED - PLAIN_TEXT)
ARTICLE = frozenset(("article", "main"))
#: Names in class, id or role that mark boilerplate, an article inside it included.
FIRM = re.compile(
    r"(?:^|[\s_-])(?<!with-)(?<!has-)(?<!no-)(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|popup|modal|newsletter|"
    r"subscribe|comments?|replies|disqus|share|social|related|recommended)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
#: Names that mark boilerplate up to an article inside it, since layout wrappers carry them too.
LOOSE = re.compile(
    r"(?:^|[\s_-])(?<!with-)(?<!has-)(?<!no-)(?:banner|notice|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|header|"
    r"masthead|login|signup|search|contentinfo|complementary)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: Labelled blocks: words, link density, words and link density of the block before and behind,
#: inside boilerplate, inside an article, page has an article; label (1 is text).
EXAMPLES = [
    (3, 1.0, 0, 0.0, 4, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 2, 1.0, 9, 0.0, 1, 0, 1, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0), (25, 0.0, 1, 1.0, 40, 0.0, 1, 0, 1, 0), (8, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 0),
    (40, 0.1, 80, 0.0, 35, 0.0, 1, 0, 1, 0), (120, 0.0, 90, 0.0, 10, 0.0, 1, 0, 1, 0), (15, 0.0, 90, 0.0, 10, 0.0, 1, 1, 1, 0),
    (30, 0.5, 45, 0.0, 20, 0.3, 1, 1, 1, 0), (6, 0.0, 9, 0.0, 50, 0.0, 0, 1, 1, 1), (1, 0.0, 70, 0.0, 80, 0.0, 0, 1, 1, 1),
    (3, 0.0, 40, 0.0, 3, 0.0, 0, 1, 1, 1), (50, 0.0, 6, 0.0, 60, 0.0, 0, 1, 1, 1), (300, 0.0, 60, 0.0, 12, 0.0, 0, 1, 1, 1),
    (80, 0.2, 30, 0.0, 75, 0.0, 0, 1, 1, 1), (20, 0.3, 18, 0.1, 25, 0.0, 0, 1, 1, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1),
    (9, 1.0, 80, 0.0, 70, 0.0, 0, 1, 1, 1), (12, 0.6, 30, 0.1, 40, 0.0, 0, 1, 1, 1), (2, 0.0, 2, 1.0, 30, 0.0, 0, 1, 1, 1),
    (1, 0.0, 1, 0.0, 40, 0.0, 0, 1, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (5, 0.9, 1, 1.0, 2, 1.0, 0, 1, 1, 1),
    (2, 1.0, 6, 0.0, 1, 1.0, 0, 1, 1, 1), (9, 0.0, 3, 1.0, 1, 0.0, 0, 1, 1, 1), (14, 1.0, 2, 0.5, 3, 1.0, 0, 1, 1, 1),
    (40, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 0), (80, 0.0, 5, 0.0, 2, 1.0, 1, 0, 0, 0), (35, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0),
    (60, 0.0, 5, 0.0, 3, 0.0, 0, 0, 1, 0), (35, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0), (90, 0.1, 0, 0.0, 4, 0.0, 1, 0, 0, 0),
    (4, 0.0, 1, 1.0, 3, 1.0, 0, 0, 1, 0), (12, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0), (30, 0.0, 50, 0.0, 5, 1.0, 0, 0, 1, 0),
    (100, 0.0, 50, 0.0, 5, 0.0, 0, 0, 1, 0), (5, 1.0, 5, 1.0, 5, 1.0, 0, 0, 1, 0), (60, 0.9, 5, 0.0, 5, 0.0, 0, 0, 1, 0),
    (45, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0, 1), (120, 0.1, 40, 0.0, 60, 0.0, 0, 0, 0, 1), (22, 0.0, 70, 0.0, 30, 0.0, 0, 0, 0, 1),
    (7, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (3, 0.0, 35, 0.0, 40, 0.0, 0, 0, 0, 1), (9, 0.0, 2, 1.0, 48, 0.0, 0, 0, 0, 1),
    (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (18, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (28, 0.2, 45, 0.0, 4, 1.0, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0), (14, 0.9, 6, 1.0, 8, 1.0, 0, 0, 0, 0),
    (40, 0.8, 10, 1.0, 12, 0.9, 0, 0, 0, 0), (25, 0.7, 3, 0.0, 4, 0.5, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 0), (6, 0.0, 3, 0.5, 5, 0.0, 0, 0, 0, 0),
    (2, 0.0, 6, 0.0, 2, 0.0, 0, 0, 0, 0), (30, 0.0, 40, 0.0, 50, 0.0, 1, 0, 0, 0), (8, 0.0, 3, 1.0, 70, 0.0, 1, 0, 0, 0),
    # pages without an article: a heading above its text, text between short blocks, between links, at the ends
    (3, 0.0, 4, 1.0, 60, 0.0, 0, 0, 0, 1), (60, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1), (60, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (2, 0.0, 6, 1.0, 25, 0.0, 0, 0, 0, 1), (6, 0.0, 1, 1.0, 33, 0.1, 0, 0, 0, 1),
    (80, 0.0, 5, 1.0, 6, 1.0, 0, 0, 0, 1), (200, 0.0, 8, 0.0, 3, 1.0, 0, 0, 0, 1), (26, 0.0, 26, 0.0, 26, 0.0, 0, 0, 0, 1),
    (55, 0.3, 60, 0.0, 50, 0.2, 0, 0, 0, 1), (20, 0.0, 3, 0.0, 70, 0.0, 0, 0, 0, 1), (16, 0.1, 40, 0.0, 22, 0.0, 0, 0, 0, 1),
    (20, 0.3, 33, 0.0, 41, 0.1, 0, 0, 0, 1), (17, 0.0, 5, 0.0, 4, 1.0, 0, 0, 0, 1), (150, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    # link lists, teasers of links, short lines among short lines, the last line of a page
    (6, 1.0, 60, 0.0, 5, 1.0, 0, 0, 0, 0), (8, 0.9, 7, 1.0, 60, 0.0, 0, 0, 0, 0), (22, 1.0, 18, 1.0, 24, 1.0, 0, 0, 0, 0),
    (60, 0.9, 3, 0.0, 4, 1.0, 0, 0, 0, 0), (35, 0.6, 4, 1.0, 4, 1.0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, 0), (7, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
    (6, 0.5, 60, 0.0, 3, 0.0, 0, 0, 0, 0), (9, 0.0, 6, 0.0, 5, 0.0, 0, 0, 0, 0), (3, 1.0, 4, 0.0, 70, 0.0, 0, 0, 0, 0),
    # the same sizes among links and among text
    (14, 0.4, 30, 1.0, 28, 1.0, 0, 0, 0, 0), (14, 0.4, 30, 0.0, 28, 0.0, 0, 0, 0, 1), (18, 0.3, 32, 1.0, 30, 0.9, 0, 0, 0, 0),
    (18, 0.3, 32, 0.0, 30, 0.1, 0, 0, 0, 1), (12, 0.0, 26, 1.0, 35, 1.0, 0, 0, 0, 0), (12, 0.0, 26, 0.0, 35, 0.1, 0, 0, 0, 1),
    (9, 0.0, 40, 1.0, 45, 1.0, 0, 0, 0, 0), (9, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 1), (6, 0.0, 30, 0.9, 29, 0.9, 0, 0, 0, 0),
    # links inside an article are its text
    (12, 0.9, 30, 0.0, 40, 0.0, 0, 1, 1, 1), (10, 1.0, 20, 0.0, 6, 0.0, 0, 1, 1, 1), (14, 0.8, 9, 0.0, 12, 0.0, 0, 1, 1, 1),
    (11, 1.0, 3, 1.0, 3, 1.0, 0, 1, 1, 1), (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 1, 1), (13, 1.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1),
    (7, 1.0, 25, 1.0, 30, 1.0, 0, 1, 1, 1), (30, 1.0, 28, 1.0, 5, 0.0, 0, 1, 1, 1), (12, 0.6, 9, 1.0, 80, 1.0, 0, 1, 1, 1),
]
#: Most questions from the root to a verdict.
DEPTH = 9


def train(rows: list[tuple], depth: int = DEPTH):
    """A decision tree by Gini impurity: a label, or (feature, bound, at most, above)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            bound = (low + high) / 2
            parts = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            cost = impurity(parts[0]) + impurity(parts[1])
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, bound, parts
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, bound, (low, high) = best
    return f, bound, train(low, depth - 1), train(high, depth - 1)


def verdict(tree, features: tuple) -> int:
    while isinstance(tree, tuple):
        f, bound, low, high = tree
        tree = low if features[f] <= bound else high
    return tree


class Block:
    """Text pieces of one block, with the words inside links and where it stands."""

    __slots__ = ("linked", "outside", "article", "pieces")

    def __init__(self, outside: bool, article: bool):
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.outside, self.article = outside, article


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, link density, inside boilerplate, inside an article) of every block with text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, firmly boilerplate, loosely, article
    outside = article = False
    links = 0
    block = Block(False, False)
    endless: set[str] = set()  # skipped elements that have no end tag from here on

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            block.pieces.append(piece)
            if links:
                block.linked.append(piece)

    def cut() -> None:
        nonlocal block
        if block.pieces:
            out.append(block)
        block = Block(outside, article)

    at = 0
    while token := TOKEN.search(page, at):
        text(page[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name in SKIPPED and not token[1] and name not in endless:
            end = END[name].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(name)
            if name in PLAIN_TEXT:
                at = len(page)
                continue
        if name in INLINE and name != "wbr":
            if name == "a":
                links = max(0, links + (-1 if token[1] else 1))
            continue
        if name in VOID:
            if name in ("br", "hr"):
                text(" ")
            continue
        if token[1]:
            if name in (s[0] for s in stack):
                while stack.pop()[0] != name:
                    pass
            links = 0
        else:
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                stack.pop()
            if stack and stack[-1][0] == "p" and name in ("p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table"):
                stack.pop()
            if stack and stack[-1][0] == "option" or stack and stack[-1][0] == name == "li":
                stack.pop()
            _, firm, loose, within = stack[-1] if stack else ("", False, False, False)
            marks = " ".join(filter(None, (x for m in NAMED.findall(token[3] or "") for x in m)))
            firm = firm or (name in OUTSIDE and not (name == "header" and within))
            if name in ARTICLE:
                loose = False
            if marks and name not in ("html", "body"):
                firm = firm or FIRM.search(marks) is not None
                loose = loose or (name not in ARTICLE and LOOSE.search(marks) is not None)
            stack.append((name, firm, loose, within or (name in ARTICLE and not firm)))
        outside, article = (stack[-1][1] or stack[-1][2], stack[-1][3]) if stack else (False, False)
        cut()
    text(page[at:])
    cut()
    found = []
    for b in out:
        words = "".join(b.pieces).split()
        if words:
            linked = len("".join(b.linked).split())
            found.append((" ".join(words), min(1.0, linked / len(words)), b.outside, b.article))
    return found


def main_text(page: str | None, tree) -> str:
    """The blocks that the tree takes for text, in page order, joined by one blank."""
    found = blocks(page or "")
    sizes = [(len(t.split(" ")), density) for t, density, _, _ in found]
    any_article = int(any(a for *_, a in found))
    kept = []
    for k, (t, density, outside, article) in enumerate(found):
        before = sizes[k - 1] if k else (0, 0.0)
        behind = sizes[k + 1] if k + 1 < len(sizes) else (0, 0.0)
        if verdict(tree, (sizes[k][0], density, *before, *behind, int(outside), int(article), any_article)):
            kept.append(t)
    return " ".join(kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every page."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    tree = train(EXAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
