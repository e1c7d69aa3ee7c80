"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. What a page itself declares to be no text of its own
never becomes a block: scripts, styles, markup and form controls, navigation, asides, footers, dialogs, a
header outside an article, hidden elements, and elements whose class, id or role is made up of words such
as `cookie-notice` or `comment-list`. A form goes too, unless it wraps most of the page. An article inside
such an element is text again, unless it is a comment.

All blocks left are judged by words and links alone: a block's number of words and link density, and
those of the block before and the block after it. A decision tree (Gini splits, fitted in numpy to the
small labelled table below) tells text from lists of links, their captions and other scraps, wherever
they stand. The kept blocks are joined in page order.

Cases: null or empty html, or a page without text, gives an empty string; unclosed or stray tags, a tag cut
off at the end of the page and unknown character references don't fail; pages of any length are read
whole; rows that repeat give the same text each; equal blocks are all kept; a column named like the text
is replaced, other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[/!?]?[a-zA-Z?!](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[/!?]?[a-zA-Z][^>]*(?:>|\Z)|[^<]++|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: Elements whose content is never text; it ends at their own end tag only.
RAW = frozenset("script style noscript template svg iframe textarea title xmp noframes canvas audio video".split())
#: Elements that begin and end a block; all others stay within the block around them.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Controls of forms within a block; their text is none.
CONTROL = frozenset(("button", "select", "datalist"))
OUTSIDE = frozenset(("nav", "aside", "footer", "menu", "dialog", "fieldset", "legend", "head"))
#: An open element of the first kind ends where one of the second begins, up to an element of the third.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset(("ul", "ol", "menu", "dir", "dl", "table", "select", "div", "section", "article", "body"))
#: Words of class, id and role that say what an element is, and words that may stand beside them.
MARK = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|complementary|contentinfo|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|reply|disqus|widgets?|toolbar|pagination|pager|search|form|hidden"
)
BESIDE = frozenset("site page post global main primary secondary left right top bottom list box area section slot bar wrapper wrap container block links link buttons button icons icon items item group panel inner outer content unit policy message text title thread media".split())
COMMENT = re.compile(r"comments?|commentlist|respond|replies|reply|disqus")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

FEATURES = ("links", "links_before", "links_after", "words", "words_before", "words_after")

#: The labelled table: pages of blocks in order, each with its words, its link density, and whether it is text. Fixed values.
LABELLED = (
    # a news page: menu, title, byline, text with a lone link and a subheading, share row, related titles, imprint
    ((1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (9, 0.0, 1), (6, 0.0, 1), (48, 0.0, 1), (61, 0.03, 1), (3, 1.0, 1), (44, 0.0, 1), (7, 0.0, 1), (72, 0.02, 1), (38, 0.0, 1), (2, 0.0, 0), (1, 1.0, 0), (1, 1.0, 0), (2, 0.0, 0), (8, 1.0, 0), (9, 1.0, 0), (7, 1.0, 0), (2, 0.0, 0), (1, 1.0, 0), (2, 1.0, 0)),
    # a page with little text between two menus
    ((1, 1.0, 0), (2, 1.0, 0), (1, 1.0, 0), (5, 0.0, 1), (12, 0.0, 1), (9, 0.1, 1), (17, 0.06, 1), (6, 0.83, 0), (2, 1.0, 0), (3, 1.0, 0)),
    # short paragraphs, lists and headings without a menu
    ((10, 0.0, 1), (1, 0.0, 1), (1, 0.0, 1), (30, 0.0, 1), (2, 0.0, 1), (11, 0.0, 1), (14, 0.07, 1), (3, 0.0, 1), (8, 0.0, 1), (250, 0.02, 1), (2, 0.0, 1)),
    ((4, 0.0, 1), (64, 0.0, 1), (5, 1.0, 1), (90, 0.15, 1), (22, 0.1, 1), (2, 1.0, 1), (33, 0.0, 1), (15, 0.53, 1), (41, 0.0, 1), (1, 0.0, 1)),
    ((6, 0.0, 1),),
    ((1, 0.0, 1), (120, 0.0, 1)),
    ((3, 0.0, 1), (2, 0.0, 1), (4, 0.0, 1)),
    # a front page: titles as links, with short teasers that are mostly links
    ((2, 1.0, 0), (1, 1.0, 0), (8, 1.0, 0), (14, 0.71, 0), (9, 1.0, 0), (12, 0.75, 0), (3, 0.67, 0), (20, 0.9, 0), (1, 1.0, 0)),
    # an article with a box of links in the middle
    ((8, 0.0, 1), (55, 0.0, 1), (40, 0.05, 1), (2, 0.0, 0), (7, 1.0, 0), (6, 1.0, 0), (8, 1.0, 0), (52, 0.0, 1), (28, 0.0, 1), (4, 0.25, 1), (35, 0.0, 1)),
    # short paragraphs with links that stand alone among them
    ((7, 0.0, 1), (14, 0.0, 1), (2, 1.0, 1), (9, 0.0, 1), (5, 0.0, 1), (4, 1.0, 1), (12, 0.0, 1), (6, 0.0, 1), (1, 1.0, 1), (18, 0.0, 1), (4, 0.0, 1), (3, 0.9, 1), (8, 0.0, 1)),
    ((1, 1.0, 0), (3, 1.0, 0), (1, 1.0, 0), (11, 0.0, 1), (8, 0.0, 1), (3, 1.0, 1), (16, 0.0, 1), (4, 0.0, 1), (6, 1.0, 1), (5, 0.2, 1), (29, 0.0, 1)),
    ((4, 1.0, 0), (7, 0.0, 1), (19, 0.0, 1)),
    # lists of links right after a text
    ((12, 0.0, 1), (31, 0.0, 1), (2, 1.0, 0), (3, 1.0, 0), (1, 1.0, 0)),
    ((26, 0.0, 1), (9, 0.0, 1), (1, 1.0, 0), (1, 1.0, 0), (5, 0.0, 1), (40, 0.0, 1)),
    ((5, 0.0, 1), (17, 0.0, 1), (4, 1.0, 0), (6, 1.0, 0), (20, 0.0, 1), (8, 1.0, 0), (2, 1.0, 0), (11, 0.0, 1)),
    # language switch and tags around a text
    ((1, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (13, 0.0, 1), (70, 0.01, 1), (24, 0.04, 1), (3, 0.67, 0), (1, 1.0, 0), (1, 1.0, 0), (1, 0.0, 0), (2, 1.0, 0), (2, 1.0, 0)),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A decision tree: (feature, threshold, low, high), or the label at a leaf; ties go to the earlier feature."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = (1.0, -1, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= cut
            p, q = y[low].mean(), y[~low].mean()
            gini = (low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)) / len(y)
            if gini < best[0] - 1e-12:
                best = (gini, k, cut)
    if best[1] < 0:
        return (bool(share >= 0.5),)
    _, k, cut = best
    low = x[:, k] <= cut
    return (k, float(cut), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The tree's label of each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    k, cut, low, high = tree
    at = x[:, k] <= cut
    out = np.empty(len(x), bool)
    out[at], out[~at] = classify(low, x[at]), classify(high, x[~at])
    return out


def fit(table: tuple = LABELLED) -> tuple:
    """The tree of a labelled table."""
    rows = [features([b[:2] for b in page]) for page in table]
    return grow(np.concatenate(rows), np.array([b[2] for page in table for b in page], np.float64))


def marked(tag: str, token: str) -> str:
    """Whether a start tag says that its element is no text: "" (no), "comment" or "other"."""
    if len(token) <= len(tag) + 2:
        return ""
    if HIDDEN.search(token):
        return "other"
    for groups in ATTRIBUTE.findall(token):
        for name in (groups[0] or groups[1] or groups[2]).split():
            words = [w.lower() for w in PARTS.split(name) if w]
            marks = [w for w in words if MARK.fullmatch(w)]
            if marks and all(w in BESIDE or MARK.fullmatch(w) for w in words):
                comment = any(COMMENT.fullmatch(w) for w in marks)
                if tag not in ("body", "html", "article", "main") or comment and tag == "article":
                    return "comment" if comment else "other"
    return ""


class Flattener:
    """Cuts one page into flat blocks."""

    def __init__(self):
        self.texts: list[str] = []
        self.facts: list[tuple[int, float]] = []
        self.forms: list[int] = []  # the form that a block stands in, 0 for none
        self.stack: list[tuple[str, str, bool, int]] = []  # open elements: name, why outside, in an article, form
        self.parts: list[str] = []
        self.linked = self.mute = self.made = 0
        self.link_depth = -1

    def top(self) -> tuple[str, str, bool, int]:
        return self.stack[-1] if self.stack else ("", "", False, 0)

    def close(self) -> None:
        """End the block that is open."""
        if self.parts and not self.top()[1]:
            words = html_entities.unescape("".join(self.parts)).split()
            if words:
                self.texts.append(" ".join(words))
                self.facts.append((len(words), min(1.0, self.linked / len(words))))
                self.forms.append(self.top()[3])
        self.parts, self.linked, self.mute = [], 0, 0

    def pop(self, k: int) -> None:
        """End the open elements from place k on."""
        del self.stack[k:]
        if self.link_depth > len(self.stack):
            self.link_depth = -1

    def say(self, token: str) -> None:
        if not self.mute:
            self.parts.append(token)
            if self.link_depth >= 0:
                self.linked += len(token.split())

    def begin(self, tag: str, token: str) -> None:
        self.close()
        if self.stack and self.stack[-1][0] == "p":
            self.pop(len(self.stack) - 1)
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in CLOSES[tag]:
                    self.pop(k)
                    break
                if self.stack[k][0] in HOLDERS:
                    break
        if tag == "hr" or token.endswith("/>") and tag != "p":
            return
        _, why, article, form = self.top()
        own = marked(tag, token) or ("other" if tag in OUTSIDE or tag == "header" and not article else "")
        if tag in ("article", "main") and why == "other":
            why, form = "", 0
        if tag == "form" and not own:
            self.made += 1
            form = self.made
        elif tag in ("article", "main"):
            form = 0
        self.stack.append((tag, why if why == "comment" else own or why, article or tag in ("article", "main"), form))

    def end(self, tag: str) -> None:
        self.close()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                break

    def read(self, page: str) -> None:
        ended = ""
        for m in TOKEN.finditer(page):
            token = m.group()
            if ended:  # inside an element without text
                if token[0] == "<" and f"</{ended}" in token.lower():
                    ended = ""
                continue
            if token[0] != "<" or token == "<":
                self.say(token)
                continue
            n = NAME.match(token)
            if not n or token[-1] != ">":
                continue
            tag, closing = n.group(1).lower(), token[1] == "/"
            if tag in RAW:
                if not closing and not token.endswith("/>"):
                    ended = tag
            elif tag in BLOCK:
                self.end(tag) if closing else self.begin(tag, token)
            elif tag == "a":
                self.link_depth = -1 if closing else len(self.stack)
            elif tag in CONTROL:
                self.mute = max(0, self.mute + (-1 if closing else 1))
            elif tag in ("br", "img", "input", "wbr"):
                self.parts.append("" if tag == "wbr" else " ")
        self.close()

    def result(self) -> tuple[list[str], list[tuple[int, float]]]:
        """Blocks without those of forms, except of a form that holds most of the words."""
        words = np.bincount(np.array(self.forms, np.int64), [f[0] for f in self.facts], self.made + 1) if self.facts else np.zeros(1)
        keep = [k for k, form in enumerate(self.forms) if not form or 2 * words[form] > words.sum()]
        return [self.texts[k] for k in keep], [self.facts[k] for k in keep]


def blocks(page: str | None) -> tuple[list[str], list[tuple[int, float]]]:
    """Text of each flat block of a page, and its words and link density."""
    if not page:
        return [], []
    f = Flattener()
    f.read(page)
    return f.result()


def features(facts: list[tuple]) -> np.ndarray:
    """The rows that the tree sees, for one page's blocks: links and words of each, of the one before and of the one after."""
    own = np.array([f[:2] for f in facts], np.float64).reshape(-1, 2)
    edge = np.zeros((1, 2))
    near = [own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])]
    return np.stack([x[:, 1] for x in near] + [x[:, 0] for x in near], 1)


def extract_many(pages: list[str | None], tree: tuple) -> list[str]:
    """Main text of each page."""
    cut = [blocks(p) for p in pages]
    if not any(t for t, _ in cut):
        return [""] * len(pages)
    keep = classify(tree, np.concatenate([features(f) for _, f in cut if f]))
    out, at = [], 0
    for texts, _ in cut:
        out.append("\n\n".join(t for t, k in zip(texts, keep[at : at + len(texts)]) if k))
        at += len(texts)
    return out


def extract(pages: DataFrame, page: str = "html", out: str = "text", table: tuple = LABELLED, batch_bytes: int = 4_000_000) -> DataFrame:
    """pages without the html column, with the main text; a column named `out` is replaced."""
    keep = [f for f in pages.schema.fields if f.name not in (page, out)]
    schema = T.StructType([*keep, T.StructField(out, T.StringType(), False)])
    tree = fit(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.bytekit import pieces, raw

        for b in batches:
            for i, j in pieces(raw(b.column(page))[1], batch_bytes):
                part = b.slice(i, j - i)
                texts = extract_many(part.column(page).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(texts, pa.string())], names=schema.names)

    return small_batches(pages).mapInArrow(run, schema)


def extraction_query(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
