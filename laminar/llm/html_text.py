"""Main text of web pages: flat text blocks, judged by a decision tree on word counts and link densities of neighbours.

Kohlschütter, Fankhauser and Nejdl, "Boilerplate detection using shallow text features" (2010). A page is cut into
blocks at block-level tags; text of scripts, styles and other parts that are never shown is left out. A block's row has
its words, its link density, those of the blocks before and after it, and where it stands: in a part that its tag, class
or id names as a menu, header, footer, sidebar, notice, advert, form or comments; in an article; or outside the article
of a page that has one. The tree is grown by Gini impurity on the blocks of ``LABELLED``, a small table of labelled pages,
when first used; their features are worked out as those of any page.

Cases: a null or empty page, and one without main text, give an empty text; markup that is never closed ends with its
parent or the page; an open script, style, title, text area or comment reaches the end of the page, while another hidden element
without an end tag hides nothing; a very long page is taken whole, alone in its block, in memory in proportion to it; of
splits of equal impurity the tree takes the first feature and the smallest threshold; equal rows get equal results; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ._shared import text_slices, trimmed

#: Bytes of pages that are taken at a time, one page at least.
BLOCK_BYTES = 4 << 20
#: Fixed values of HTML: tags that break text into blocks, tags without content, and tags whose text is not shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Their content is no markup, up to their end tag or the end of the page.
RAW_TAGS = frozenset("script style textarea title".split())
#: Their content is not shown, up to the end tag that fits; without one they hide nothing.
HIDDEN_TAGS = frozenset("noscript template iframe noembed noframes svg select object audio video canvas".split())
#: Tags and words of classes or ids that name a part other than the main text.
SIDE_TAGS = frozenset("nav header footer aside form menu dialog button search".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay"
    " pager pagination popup promo promoted recommended related replies share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Of these words, those for what may stand beside or hold an article; an article or main element in it ends their effect.
LAYOUT_WORDS = frozenset("header masthead menu nav navbar navigation sidebar toolbar topbar widget widgets footer overlay modal".split())
#: Words that tell that a name speaks of another element, as in "with-sidebar".
ABOUT_WORDS = frozenset("with without no not has have hide show".split())
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class _Open:
    """An open element: its tag and where it stands."""

    __slots__ = ("place", "tag")

    def __init__(self, tag: str, place: int):
        self.tag, self.place = tag, place


#: Where blocks stand: in a part named by its tag or a word; in one named by a word of layout; elsewhere; in an article.
SIDE, BESIDE, PLAIN, ARTICLE = -2, -1, 0, 1


def _named(rest: str) -> int:
    """SIDE, BESIDE or PLAIN, from an element's classes, id and role."""
    found = PLAIN
    for m in _NAMES.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(_SPLIT.split(name))
            if words & SIDE_WORDS and not words & ABOUT_WORDS:
                found = min(found, BESIDE if words & SIDE_WORDS <= LAYOUT_WORDS else SIDE)
    return found


def _place(tag: str, rest: str, outer: int) -> int:
    """Where the content of an element stands, from where the element does."""
    if tag == "form" and outer != SIDE:  # whole pages stand in a form where a server keeps their state
        return BESIDE
    if outer == SIDE or (tag in SIDE_TAGS and not (tag == "header" and outer == ARTICLE)):
        return SIDE
    named = _named(rest) if rest and tag not in ("html", "body", "main") else PLAIN
    if named == SIDE:
        return SIDE
    if tag in ("article", "main"):
        return ARTICLE
    return min(outer, named) if named and not (tag == "header" and outer == ARTICLE) else outer


@lru_cache(maxsize=64)
def _tags(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I | re.A)


def _past_end(page: str, tag: str, at: int, nests: bool) -> int:
    """Where the element whose content begins at ``at`` ends; -1 if no end tag fits."""
    depth = 1
    for m in _tags(tag).finditer(page, at):
        if m[1]:
            depth -= 1
        elif nests and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return -1


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, place) of each block with a word, in page order."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[tuple[str, bool]] = []
    opened = [_Open("", PLAIN)]
    links, at = 0, 0

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join([t for t, _ in parts])).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, inside in parts if inside)
                words = len(text.split(" "))
                out.append((text, words, min(linked, words), opened[-1].place))
            parts.clear()

    unended: set[str] = set()
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK_TAGS:
                end_block()
            for i in range(len(opened) - 1, 0, -1):
                if opened[i].tag == tag:
                    links -= sum(x.tag == "a" for x in opened[i:])
                    del opened[i:]
                    break
                if opened[i].tag in ("td", "th", "table") and tag not in BLOCK_TAGS:
                    break
            continue
        if tag in RAW_TAGS:
            end = _past_end(page, tag, at, False)
            at = end if end >= 0 else len(page)
            continue
        if tag in HIDDEN_TAGS and tag not in unended and not m["rest"].endswith("/"):
            if (end := _past_end(page, tag, at, True)) >= 0:
                at = end
                continue
            unended.add(tag)
        if tag in BLOCK_TAGS:
            end_block()
            if opened[-1].tag == "p" or (tag == "li" and opened[-1].tag == "li"):
                opened.pop()
            else:
                # A paragraph ends before a block, with what is open inside it.
                for i in range(len(opened) - 1, 0, -1):
                    if opened[i].tag == "p":
                        links -= sum(x.tag == "a" for x in opened[i:])
                        del opened[i:]
                        break
                    if opened[i].tag in BLOCK_TAGS:
                        break
        if tag == "br":
            parts.append(("\n", links > 0))
        if tag not in VOID_TAGS and not m["rest"].endswith("/"):
            if tag == "a":
                links += 1
            opened.append(_Open(tag, _place(tag, m["rest"], opened[-1].place)))
    if at < len(page):
        parts.append((page[at:], links > 0))
    end_block()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "place", "outside")
#: The labelled table: pages as pieces of markup, each with 1 if its blocks are main text. {n} stands for n words.
LABELLED = (
    # A page that marks its article, with a menu, an advert, a notice, a form, comments and a footer around it.
    (
        ("<nav><ul><li><a href=x>{1}</a></li><li><a href=x>{2}</a></li><li><a href=x>{1}</a></li></ul></nav>", 0),
        ("<div class=ad>{24}</div><article><header>", 0), ("<h1>{9}</h1>", 1), ("<p>{3}</p></header>", 1), ("<p>{70} <a href=x>{2}</a> {20}</p>", 1),
        ("<h2>{3}</h2>", 1), ("<ul><li>{6}</li><li>{4}</li><li>{9} <a href=x>{3}</a></li></ul>", 1), ("<p>{1}</p>", 1),
        ("<div class=newsletter>{40}</div>", 0), ("<p>{35}</p>", 1), ("<figure><figcaption>{7}</figcaption></figure></article>", 1),
        ("<p>{12}</p>", 0), ("<form>{3}<button>{1}</button></form>", 0), ("<div id=comments><p>{60}</p><p>{5}</p></div>", 0), ("<footer>{30} <a href=x>{2}</a></footer>", 0),
    ),
    # Lists of links in and after an article, and links that make up most of a block.
    (
        ("<main><h1>{7}</h1><p>{45}</p>", 1), ("<ul><li><a href=x>{6}</a></li><li><a href=x>{5}</a></li></ul>", 0), ("<p>{50}</p>", 1),
        ("<p><a href=x>{8}</a> {1}</p>", 0), ("<p>{6} <a href=x>{4}</a></p>", 1), ("<p><a href=x>{12}</a> {2}</p></main>", 0), ("<ul><li><a href=x>{9}</a></li><li><a href=x>{7}</a></li></ul><p>{18}</p>", 0),
    ),
    # Short articles.
    (("<nav><a href=x>{1}</a></nav>", 0), ("<article><p>{2}</p></article>", 1), ("<footer>{6}</footer>", 0)),
    (("<ul><li><a href=x>{1}</a></li></ul>", 0), ("<article><h1>{2}</h1><p>{9}</p><p>{1}</p></article>", 1), ("<div class=cookie-notice>{22}</div>", 0)),
    # Pages that name no article: long text with few links, headings before it, short blocks between.
    (
        ("<ul><li><a href=x>{1}</a></li><li><a href=x>{2}</a></li><li><a href=x>{1}</a></li></ul>", 0), ("<h1>{6}</h1><p>{55}</p>", 1), ("<h2>{5}</h2><p>{90} <a href=x>{4}</a></p>", 1),
        ("<p>{30}</p><p>{12}</p><p>{45}</p>", 1), ("<p>{7}</p><p>{40}</p>", 1), ("<ul><li><a href=x>{3}</a></li><li><a href=x>{4}</a></li></ul>", 0), ("<div class=footer>{14}</div>", 0),
    ),
    (("<table><tr><td><a href=x>{3}</a></td><td><a href=x>{2}</a></td></tr></table>", 0), ("<div>{60}</div><div>{33}</div><div>{8}</div><div>{40}</div>", 1), ("<div>{4} <a href=x>{1}</a></div>", 0), ("<div><a href=x>{2}</a></div>", 0)),
    (("<p>{22}</p>", 1),),
    (("<p>{16}</p><p>{18}</p>", 1), ("<p><a href=x>{25}</a> {5}</p>", 0)),
    (("<div><a href=x>{2}</a></div><div><a href=x>{5}</a></div>", 0), ("<h1>{8}</h1><div>{25} <a href=x>{5}</a></div><div>{30}</div>", 1), ("<div>{3}</div>", 0), ("<div>{2}</div>", 0)),
    # Pages without main text: menus, short blocks among short ones, notices.
    (("<div>{3}</div><div>{2}</div><div>{4}</div><div>{3}</div>", 0),),
    (("<ul><li><a href=x>{4}</a></li><li>{5}</li><li><a href=x>{3}</a></li></ul>", 0), ("<div>{6} <a href=x>{2}</a></div><div>{3}</div>", 0), ("<div class=copyright>{40}</div>", 0)),
    (("<div class=sidebar><p>{70}</p><p>{35}</p></div>", 0), ("<div class=banner>{60}</div>", 0), ("<aside><p>{120}</p></aside>", 0)),
)


def _labelled() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the labelled blocks, of pages as they stand and with half and twice as many words."""
    rows: dict[tuple, int] = {}
    for pieces in LABELLED:
        for times in (1.0, 0.5, 2.0):

            def words(i: int, n: str, times: float = times) -> str:
                return " ".join([f"w{i}"] * max(1, int(int(n) * times + 0.5))) if int(n) > 9 else " ".join([f"w{i}"] * int(n))

            page = "".join(re.sub(r"\{(\d+)\}", lambda m, i=i: words(i, m[1]), markup) for i, (markup, _) in enumerate(pieces))
            found = blocks(page)
            for (text, *_), row in zip(found, rows_of(found), strict=True):
                rows.setdefault(row, pieces[int(text.split()[0][1:])][1])
    return np.array(list(rows), dtype=float), np.array(list(rows.values()))


class Tree:
    """A node: a feature and a threshold with two subtrees, or the label of a leaf."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.label = int(labels.sum() * 2 > len(labels))
        self.feature = -1
        if labels.min() == labels.max():
            return
        best = 1.0
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= t
                impurity = sum(n * 2 * p * (1 - p) for part in (left, ~left) for n, p in [(part.mean(), labels[part].mean())])
                if impurity < best - 1e-12:
                    best, self.feature, self.threshold = impurity, f, float(t)
        if self.feature >= 0:
            left = rows[:, self.feature] <= self.threshold
            self.low, self.high = Tree(rows[left], labels[left]), Tree(rows[~left], labels[~left])

    def predict(self, row) -> int:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.label


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*_labelled())


def rows_of(found: list[tuple[str, int, int, int]]) -> list[tuple]:
    """The blocks' features."""
    article = any(x[3] == ARTICLE for x in found)
    facts = [(0, 0.0), *((words, linked / words) for _, words, linked, _ in found), (0, 0.0)]
    return [(*facts[i + 1], *facts[i], *facts[i + 2], x[3], int(article and x[3] != ARTICLE)) for i, x in enumerate(found)]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join([x[0] for x, row in zip(found, rows_of(found), strict=True) if tree().predict(row)])


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row of pages."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, last in text_slices(batch.column(2), BLOCK_BYTES):
                part = batch.slice(first, last - first)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url", page).mapInArrow(trimmed(run), f"`{key}` {kind}, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
