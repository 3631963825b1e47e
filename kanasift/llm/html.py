"""Main text of web pages: the best-scoring contiguous run of words and tags.

A page becomes a sequence of words and tags. Each word scores by where it stands: in a menu, a link or plain text,
inside or outside an article element, and where a page has no such element, by the block's tag, the class words
around it and whether it is linked. Each tag scores below zero. All weights are log odds fitted on labelled pages.
One linear scan finds the run of the largest sum, the content region; within it, words whose place weighs below
zero (menus, forms, adverts, comments and the like) are left out.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages at most that fit the weights.
LABELLED_PAGES = 500

#: Elements whose content is no text of the page.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand within a line; all others begin and end blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are no main text, by kind.
KINDS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice"}
#: Words of class, id and role that say the same, by kind.
NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead topbar banner siteheader",
    "footer": "footer colophon copyright bottom sitefooter contentinfo",
    "aside": "sidebar aside widget widgets related recommended rail complementary share sharing social",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "comment": "comment comments respond reply replies disqus discussion commentlist",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert toast newsletter subscribe signup paywall disclaimer",
    "form": "form login search searchform",
}
_KIND_OF = {w: k for k, ws in NAMES.items() for w in ws.split()}
#: Those of them that say so inside an article too, where others may be layout or subject.
PLAIN_NAMES = set("breadcrumb breadcrumbs pagination pager navbar navigation sidebar related recommended share sharing ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted comments commentlist disqus replies respond cookie cookies consent gdpr newsletter paywall popup".split())
MAIN = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Item:
    """A tag (text None) or a text of a block; kind and place say where it stands."""

    tag: str
    kind: str
    inside: bool
    block: int
    text: str | None = None
    link: bool = False
    under: str = ""
    names: tuple[str, ...] = ()


def _words_of_name(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _kind(tag: str, attributes: str, inside: bool) -> tuple[str, tuple[str, ...]]:
    """(kind, words of class, id and role) of an element: the kind says that it is no main text, hidden included, or is empty."""
    names: list[str] = []
    found = hidden = ""
    if attributes and tag not in ("body", "html", "article", "main"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                for x in value.split():
                    ws = _words_of_name(x)
                    names += ws
                    # A word amid others, as in content-sidebar-wrap, says little about the element.
                    for w in ws[:1] + ws[-1:]:
                        if not found and w in _KIND_OF and (not inside or w in PLAIN_NAMES):
                            found = _KIND_OF[w]
            elif name == "hidden" and value.strip().lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
                hidden = "hidden"
    return KINDS.get(tag) or found or hidden, tuple(dict.fromkeys(names))


def parse(page: str) -> list[Item]:
    """The tags and texts of a page in order. Unclosed elements end with their parent, stray ends are dropped.

    An element that holds the page's main or first article element, or most of its plain words, has no kind by
    its name, nor has a form; comments and what is hidden stay so.
    """
    spared: set[int] = set()
    while True:
        items, opened = _parse(page, spared)
        wrappers = _wrappers(items, opened)
        if not wrappers:
            return items
        spared |= wrappers


def _wrappers(items: list[Item], opened: list[tuple[int, str, int, int]]) -> set[int]:
    """The places of those opened elements (place, kind, first item, end) that hold the main text."""
    if not opened:
        return set()
    main = next((k for k, i in enumerate(items) if i.tag == "main"), None)
    article = next((k for k, i in enumerate(items) if i.tag == "article" and k > (-1 if main is None else main)), None)
    marks = [k for k in (main, article) if k is not None]
    out = {place for place, _, lo, hi in opened if any(lo <= k < hi for k in marks)}
    if not marks:
        n = [len(i.text.split()) if i.text is not None and not i.link else 0 for i in items]
        own = [sum(n[lo:hi]) for _, _, lo, hi in opened]
        total = sum(x for x, i in zip(n, items, strict=True) if i.kind == "")
        end = 0
        for (_, _, lo, hi), x in zip(opened, own, strict=True):
            if lo >= end:  # the outermost ones
                total, end = total + x, hi
        out = {place for (place, kind, _, _), x in zip(opened, own, strict=True) if kind != "comment" and 2 * x > total}
    return out


def _parse(page: str, spared: set[int]) -> tuple[list[Item], list[tuple[int, str, int, int]]]:
    """parse() with the elements at the places `spared` without a kind, and the outermost others that could be spared."""
    items: list[Item] = []
    opened: list[tuple[int, str, int, int]] = []
    # Open elements: tag, kind of all it holds, inside main text, inside a link, its number in opened or -1, the
    # innermost block's tag and the innermost class words.
    stack: list[tuple[str, str, bool, bool, int, str, tuple[str, ...]]] = []
    block, at, n = 0, 0, len(page)
    top = ("", "", False, False, -1, "", ())
    kind, inside, link, under, names = "", False, False, "", ()

    def text(s: str) -> None:
        if s and kind != "hidden":
            if "&" in s:
                s = _html.unescape(s)
            items.append(Item("", kind, inside, block, s, link, under, names))

    def close(k: int) -> None:
        nonlocal kind, inside, link, under, names
        for x in stack[k:]:
            if x[4] >= 0:
                opened[x[4]] = (*opened[x[4]][:3], len(items))
        del stack[k:]
        _, kind, inside, link, _, under, names = stack[-1] if stack else top

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or not m[4]:  # a comment or declaration, or a tag that is cut off by the page's end
            continue
        if tag not in INLINE:
            block += 1
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            # An inline end tag does not close the blocks around it.
            if depth is not None and not (tag in INLINE and any(t not in INLINE for t, *_ in stack[depth + 1 :])):
                if kind != "hidden":
                    items.append(Item(tag, kind, inside, block))
                close(depth)
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"p"} if tag in CLOSES_P else {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}[tag]
            stop = {"ul", "ol", "dl", "table", "select", "article", "main", "body", "div", "section"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in stop and stack[k][0] != tag:
                    break
        if tag == "br" or tag == "wbr":
            if tag == "br":
                text(" ")
            continue
        own, own_names = _kind(tag, m[3], inside)
        if tag in HIDDEN:
            own = "hidden"
        could = own not in ("", "hidden") and (tag not in KINDS or KINDS[tag] == "form")
        if could and at in spared:
            own, could = "", False
        if own == "header" and inside and tag == "header" and not kind:
            own = "title"  # the header of an article: its headings count
        below = kind if kind in ("hidden", *_KIND_OF.values()) else own or kind
        if own == "hidden":
            below = "hidden"
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and below == "title":
            below = ""
        if tag == "a" and not below:
            below = "link"
        number = -1
        if could and below != "hidden" and tag not in VOID:
            number = len(opened)
            opened.append((at, below, len(items), n))
        if below != "hidden":
            items.append(Item(tag, below, inside or tag in MAIN, block))
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, below, inside or tag in MAIN, link or tag == "a", number, under if tag in INLINE else tag, own_names or names))
        _, kind, inside, link, _, under, names = stack[-1]
    return items, opened


@dataclass
class Weights:
    """words by (kind, place), tags by (tag, place); more by (feature, value), for pages without an article or main element."""

    words: dict[tuple[str, str], float]
    tags: dict[tuple[str, str], float]
    more: dict[tuple[str, str], float] = field(default_factory=dict)


#: Words seen (as content, as other) before any labelled page, by kind; their ratio stands in for rare kinds.
PRIOR = {"": (40, 4), "link": (6, 6)}
OTHER_PRIOR = (1, 40)
#: Words of each sort seen before any labelled page, for features of pages without the label.
MORE_PRIOR = 20
#: What lies between two articles counts against the second by so much at most.
MOAT = -4.0


def _place(item: Item, labelled: bool) -> str:
    """Whether the page has an article or main element and the item stands in it."""
    return "" if not labelled else "in" if item.inside else "out"


def _features(item: Item) -> list[tuple[str, str]]:
    """What a text's words are told by on pages without the label, besides their kind."""
    return [("under", item.under), *([("link", "")] if item.link else []), *(("name", w) for w in item.names)]


def count(page: str | None) -> Counter:
    """Words and tags of a labelled page by (sort, value, place, content); nothing of other pages.

    What stands in an article or main element, but not in a part of a kind that is no main text, is content. A page
    is counted with its label's place and without, so that pages with and without such elements get weights.
    """
    out: Counter = Counter()
    items = parse(page or "")
    if not any(i.inside for i in items):
        return out
    for i in items:
        content = i.inside and i.kind in ("", "link")
        n = 1 if i.text is None else len(i.text.split())
        for place in ("", _place(i, True)):
            out["tag" if i.text is None else "word", i.tag if i.text is None else i.kind, place, content] += n
        if i.text is not None:
            for feature, value in _features(i):
                out[feature, value, "", content] += n
            out["all", "", "", content] += n
    return out


def weigh(n: Counter) -> Weights:
    """Log odds of words and tags to be content, from the sum of count(). Tags score below zero whatever their odds."""
    out = Weights({}, {})
    kinds = {"", "link", "title", *KINDS.values(), *NAMES}
    for kind in kinds:
        for place in ("", "in", "out"):
            good, bad = PRIOR.get(kind, OTHER_PRIOR)
            if place == "out" and kind in PRIOR:
                good, bad = bad, good
            out.words[kind, place] = max(-4.0, min(4.0, log((n["word", kind, place, True] + good) / (n["word", kind, place, False] + bad))))
    for sort, value, place, _ in list(n):
        if sort == "tag":
            out.tags[value, place] = max(-3.0, min(-0.1, log((n[sort, value, place, True] + 1) / (n[sort, value, place, False] + 1))))
    total, other = n["all", "", "", True] + MORE_PRIOR, n["all", "", "", False] + MORE_PRIOR
    for sort, value, _, _ in list(n):
        if sort in ("under", "link", "name"):
            # How much more often content stands there than other words do.
            some, rest = n[sort, value, "", True] + MORE_PRIOR * total / (total + other), n[sort, value, "", False] + MORE_PRIOR * other / (total + other)
            out.more[sort, value] = max(-4.0, min(1.0, log(some / total) - log(rest / other)))
    return out


def fit(pages: list[str]) -> Weights:
    """Weights from pages whose article or main element is the label; pages without one teach nothing."""
    return weigh(sum(map(count, pages), Counter()))


def _score(item: Item, place: str, weights: Weights, more: dict) -> float:
    if item.text is None:
        return weights.tags.get((item.tag, place), -0.3)
    own = weights.words.get((item.kind, place), -1.0)
    if more and not place:
        own = max(-4.0, min(4.0, own + sum(more.get(f, 0.0) for f in _features(item))))
    return own * len(item.text.split())


def region(items: list[Item], weights: Weights) -> tuple[int, int]:
    """[first, end) of the items of the largest sum; of equal sums the first, and empty if none is above 0.

    Where no words reach a sum above 0 on a page without the label, kinds alone decide; and where it has no text in
    blocks that content is mostly in, the blocks' tags say nothing.
    """
    labelled = any(i.inside for i in items)
    more = {} if labelled else weights.more
    if more and not any(i.kind == "" and more.get(("under", i.under), 0.0) > 0 for i in items if i.text is not None and not i.text.isspace()):
        more = {k: v for k, v in more.items() if k[0] != "under"}
    for more in (more, {}):
        best, here, lo, moat = (0.0, 0, 0), 0.0, 0, 0.0
        for k, i in enumerate(items):
            place = _place(i, labelled)
            own = _score(i, place, weights, more)
            if place == "out":
                own = max(own, min(0.0, MOAT - moat))
                moat += min(0.0, own)
            else:
                moat = 0.0
            here += own
            if here <= 0:
                here, lo, moat = 0.0, k + 1, 0.0
            elif here > best[0]:
                best = (here, lo, k + 1)
        if best[0]:
            break
    return best[1], best[2]


def main_text(page: str | None, weights: Weights) -> str:
    """The page's main text: one line a block, white space within it as one space; empty for null or none."""
    items = parse(page or "")
    first, end = region(items, weights)
    labelled = any(i.inside for i in items)
    blocks: dict[int, list[str]] = {}
    for i in items[first:end]:
        if i.text is not None:
            place = _place(i, labelled)
            # Words in links and plain words go with the region; others, and those between articles, by their weight.
            if i.kind in ("", "link") and place != "out" or weights.words.get((i.kind, place), -1.0) > 0:
                blocks.setdefault(i.block, []).append(i.text)
    lines = (_SPACE.sub(" ", "".join(x)).strip() for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, most: int = LABELLED_PAGES) -> Weights:
    """Weights from at most `most` pages with an article or main element, the first by hash of page_id.

    Tasks count the pages and only sums reach the driver, a row for each tag, class word and the like.
    """
    rows = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64("page_id").alias("h"), F.xxhash64("page_id", "html").alias("h2"), "html")
    first = rows.select("h", "h2").distinct().orderBy("h", "h2").limit(most)

    def run(batches):
        for b in batches:
            n = sum((count(t.as_py()) for t in b.column(0)), Counter())
            keys = list(zip(*n, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in keys[:3]), pa.array(keys[3], pa.bool_()), pa.array(n.values(), pa.int64())], names=["sort", "value", "place", "content", "n"])

    some = rows.join(F.broadcast(first), ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.first("html").alias("html"))
    sums = some.select("html").mapInArrow(run, "sort string, value string, place string, content boolean, n long").groupBy("sort", "value", "place", "content").agg(F.sum("n").alias("n")).collect()
    return weigh(Counter({(r["sort"], r["value"], r["place"], r["content"]): r["n"] for r in sums}))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each row of pages (page_id, url, html).

    Null and empty pages have empty text; repeated rows are extracted each; no rows give no rows; other columns
    are ignored; pages of any length are taken whole, a page at a time. Without weights they are fitted on a bounded
    sample of pages.
    """
    weights = weights or train(pages)

    def run(batches):
        for b in batches:
            out = [main_text(t.as_py(), weights) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
