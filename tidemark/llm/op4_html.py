"""Main text of HTML pages by composite text density.

Every DOM node has characters, tags, link characters and link tags; its density is characters per
tag, turned down where much of the text is links. Nodes are block elements and the text that stands
directly in one: markup within a run of text parts nothing, but links count as tags. A node's density
sum is that of its children. The subtree of the largest sum is the article. The least density on the
way from it up to body is the threshold: wherever a node reaches it, the subtree of the largest sum
in it is content too. What stands between content, or is built like it, or heads it, goes with it. Where
the best subtree lies in an article or main element, or such elements hold the headline or a quarter of the page, they bound it.

Elements that are never the article (navigation, footers, controls, scripts, what is hidden) are left
out first. Forms and elements whose role, or a whole word of whose class or id, names an advert, a menu,
comments and the like are left out too, unless they hold the article: then only what they hold is judged.
A class or id that has such a word beside others (sharing-economy) is a hint only: it counts where the
element has few characters per tag or is mostly links.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import others
from tidemark.shared import bounded_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# fixed values: elements of HTML by how they are parsed and shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# fixed values: elements, roles and words of a class or id that mark what is not the article
DROPPED = RAW | frozenset("head nav footer aside button select option input datalist menu dialog svg canvas object audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentary commenting disqus replies "
    "respond response responses reaction reactions reader readers discussion discussions feedback guestbook".split()
)
# fixed values: words that say where or how an element is laid out, not what it is about
LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entries entry first fixed form group "
    "header heading holder inner item items large last left link links list main module outer page panel post posts primary right row "
    "secondary section site slot small stories text title top unit wrap wrapper".split()
)
KEPT = frozenset("html body main article".split())
# words before a hint that say what a page has or lacks, not what the element is: no-sidebar, has-menu
ABOUT = frozenset("no not non has have with without hide hides show shows".split())
#: Share of the page's text from which on article and main elements bound the article.
BOUNDING = 0.25
#: Characters per tag from which on an element stays though a word of its class or id is a hint.
DENSE = 40
#: Characters, and share of a doubtful element's text, from which on a paragraph or headline outside it counts as the article.
ENOUGH, SHARE = 200, 0.1


class Page:
    """Nodes in page order as parallel lists, and pieces of text with the node they stand in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.kind = ["html"], [-1], [False], [""]
        self.pieces: list[tuple[int, str]] = []
        self.stack = [0]
        self.opened: Counter[str] = Counter()
        at = 0
        while m := TAG.search(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                self.close(name)
            else:
                attrs = m["attrs"] or m["attrs2"] or ""
                self.open(name, attrs)
                if name in RAW and not attrs.endswith("/"):
                    until = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                    at = until.end() if until else len(source)
                    self.close(name)
        self.text(source[at:])

    def text(self, piece: str) -> None:
        if piece:
            self.pieces.append((self.stack[-1], piece))

    def cut(self, i: int) -> None:
        """Close all elements from place i of the stack on."""
        self.opened.subtract(self.tag[k] for k in self.stack[i:])
        del self.stack[i:]

    def close(self, name: str) -> None:
        if self.opened[name] > 0:
            self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.tag[self.stack[i]] == name))

    def open(self, name: str, attrs: str) -> None:
        if name in CLOSES_P and self.opened["p"] > 0:
            for i in range(len(self.stack) - 1, 0, -1):
                held = self.tag[self.stack[i]]
                if held == "p":
                    self.cut(i)
                    break
                if held not in INLINE:
                    break
        if name in CLOSED_BY and any(self.opened[x] > 0 for x in CLOSED_BY[name]):
            for i in range(len(self.stack) - 1, 0, -1):
                held = self.tag[self.stack[i]]
                if held in SCOPE[name]:
                    break
                if held in CLOSED_BY[name]:
                    self.cut(i)
                    break
        if name == "html":
            return
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.said = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)} if attrs else {}
        self.drop.append(self.unwanted(name, attrs))
        self.kind.append(self.said.get("class", ""))
        if name not in VOID and not (attrs.endswith("/") and name not in INLINE | CLOSES_P):
            self.stack.append(node)
            self.opened[name] += 1
        elif name in ("br", "hr"):
            self.pieces.append((node, " "))

    def unwanted(self, name: str, attrs: str) -> bool | str | None:
        """True: not the article. None: so it says, unless the article stands in it. "hint": so one of its words says."""
        if name in DROPPED:
            return True
        within = self.opened["article"] + self.opened["main"] > 0
        if name == "header":
            return not within
        if name == "label" and self.opened["form"] > 0:
            return True
        doubt = None if name == "form" else False
        if not attrs or name in KEPT:
            return doubt
        said = self.said
        if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
            return True
        if said.get("role") in ROLES:
            return None
        hinted = False
        for token in f"{said.get('class', '')} {said.get('id', '')}".split():
            parts = re.split(r"[^a-z]+", token)
            parts = [w for before, w in zip(["", *parts], parts) if len(w) > 1 and w not in ABOUT and before not in ABOUT]
            named = [w for w in parts if w in HINTS or (w == "header" and not within)]
            if parts == ["discussion"] and name == "section" and within:
                named = []  # a part of a paper
            if named and all(w in HINTS or w in LAYOUT for w in parts):
                return None
            hinted |= bool(named)
        return "hint" if hinted and doubt is False else doubt


def main_text(source: str | None) -> str:
    """The article's blocks, white space in each turned into one space, joined by two line feeds."""
    page = Page(source or "")
    n = len(page.tag)
    never, link = [False] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        never[i] = never[up] or page.drop[i] is True
        link[i] = link[up] or page.tag[i] == "a"
    pieces = [(node, html.unescape(piece)) for node, piece in page.pieces if not never[node]]
    sized = [(node, piece, len("".join(piece.split()))) for node, piece in pieces]
    gone = left_out(page, never, link, sized)
    text = densest(page, gone, link, sized)
    return text if text or gone == never else densest(page, never, link, sized)


def left_out(page: Page, never: list[bool], link: list[bool], sized: list[tuple[int, str, int]]) -> list[bool]:
    """never, and the doubtful elements that do not hold the article.

    A doubtful element stays where an h1 stands in it, or an article or main and none with text stands
    elsewhere, or where it holds most of the page's text outside links and what is not doubtful has no article. Where all of them together leave
    no article, they all stay, and density alone decides.
    """
    n = len(page.tag)
    doubtful = [page.drop[i] is None and not never[i] for i in range(n)]
    for i in sparse(page, never, link, sized):
        doubtful[i] = True
    if not any(doubtful):
        return never
    # text outside links: all of a node's, and what does not stand in a doubtful element below it
    whole, sure = [0] * n, [0] * n
    for node, _, size in sized:
        if not link[node]:
            whole[node] += size
            sure[node] += size
    named = [page.tag[i] in ("article", "main") and not never[i] for i in range(n)]
    headed, holds = [page.tag[i] == "h1" for i in range(n)], named[:]
    # some text outside links in an article or main (2), a paragraph or headline (1), outside doubtful elements below
    best = [0] * n
    for i in range(n - 1, -1, -1):
        if sure[i]:
            best[i] = max(best[i], 2 if named[i] else page.tag[i] in ("p", "h1"))
        if i:
            up = page.parent[i]
            headed[up] |= headed[i]
            holds[up] |= holds[i]
            if not never[i]:
                whole[up] += whole[i]
            if not never[i] and not doubtful[i]:
                sure[up] += sure[i]
                best[up] = max(best[up], best[i])

    def article(text: int, kind: int, than: int) -> bool:
        return kind == 2 or (kind == 1 and text >= min(ENOUGH, SHARE * than))

    gone, text, kind, dropped, outside = never[:], sure[0], best[0], 0, best[0] == 2
    for i in range(1, n):
        gone[i] |= gone[page.parent[i]]
        if doubtful[i] and not gone[i]:
            if headed[i] or (holds[i] and not outside) or (2 * whole[i] > whole[0] and not article(text, kind, whole[i])):
                text, kind = text + sure[i], max(kind, best[i])
            else:
                gone[i] = True
                dropped += whole[i]
    return gone if text >= dropped or article(text, kind, dropped) else never


def sparse(page: Page, never: list[bool], link: list[bool], sized: list[tuple[int, str, int]]) -> Iterator[int]:
    """Elements with a hint that have few characters per tag outside links, or mostly links."""
    n = len(page.tag)
    if "hint" not in page.drop:
        return
    plain, linked, tags = [0] * n, [0] * n, [0] * n
    for node, _, size in sized:
        (linked if link[node] else plain)[node] += size
    for i in range(n - 1, 0, -1):
        if page.drop[i] == "hint" and not never[i] and (plain[i] < DENSE * (1 + tags[i]) or linked[i] > plain[i]):
            yield i
        up = page.parent[i]
        plain[up] += plain[i]
        linked[up] += linked[i]
        tags[up] += tags[i] + (page.tag[i] not in INLINE)


#: Least base of the density's logarithm: nearer to 1 short texts without links would be as dense as long ones.
LEAST_BASE = 2.0


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Characters per tag, link-adjusted: the logarithm is small where text or tags are mostly links."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_links * chars + math.e)
    return chars / max(1, tags) * math.log(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags), max(base, LEAST_BASE))


def densest(page: Page, gone: list[bool], link: list[bool], sized: list[tuple[int, str, int]], bounded: bool = False) -> str:
    """The text of the subtree of the largest density sum, and of others above the threshold. Unless it is bounded already,
    only text in article and main elements counts where the best subtree lies in one, or they have the headline or a quarter
    of the text, and headlines."""
    n = len(page.tag)
    # the block that holds a node, and text and links that stand directly in it
    hold = list(range(n))
    for i in range(1, n):
        if page.tag[i] in INLINE or page.tag[i] in VOID:
            hold[i] = hold[page.parent[i]]
    own, own_link, own_tags = [0] * n, [0] * n, [0] * n
    kept = []
    for node, piece, size in sized:
        if not gone[node]:
            kept.append((node, piece))
            own[hold[node]] += size
            own_link[hold[node]] += size * link[node]
    for i in range(1, n):
        own_tags[hold[i]] += page.tag[i] == "a" and not gone[i]
    live = [i for i in range(n) if hold[i] == i and not gone[i]]
    chars, link_chars, link_tags, tags = own[:], own_link[:], own_tags[:], own_tags[:]
    up = [hold[page.parent[i]] if i else -1 for i in range(n)]
    for i in reversed(live):
        if i:
            chars[up[i]] += chars[i]
            link_chars[up[i]] += link_chars[i]
            link_tags[up[i]] += link_tags[i]
            tags[up[i]] += tags[i] + 1
    body = next((i for i in live if page.tag[i] == "body"), 0)
    if not chars[body]:
        return ""
    body_links = link_chars[body] / chars[body]
    dense, sums = [0.0] * n, [0.0] * n
    for i in live:
        dense[i] = density(chars[i], tags[i], link_chars[i], link_tags[i], body_links)
        sums[i] += density(own[i], own_tags[i], own_link[i], own_tags[i], body_links)
        if i:
            sums[up[i]] += dense[i]
    # the largest sum in each subtree, of several the outermost
    best = list(range(n))
    for i in reversed(live):
        if i and sums[best[i]] > sums[best[up[i]]]:
            best[up[i]] = best[i]
    path = [best[body]]
    while path[-1] != body:
        path.append(up[path[-1]])
    if not bounded:
        within = [page.tag[i] in ("article", "main") for i in range(n)]
        title = [page.tag[i] == "h1" for i in range(n)]
        for i in range(1, n):
            within[i] |= within[page.parent[i]]
            title[i] |= title[page.parent[i]]
        inside = [(node, piece, size) for node, piece, size in sized if within[node]]
        headed = any(title[node] and size and not gone[node] for node, _, size in inside)
        if headed or within[path[0]] or sum(size for node, _, size in inside if not gone[node]) > BOUNDING * chars[body]:
            if len(inside) < len(sized):
                return densest(page, gone, link, [x for x in sized if within[x[0]] or title[x[0]]], True)
    threshold = min(dense[i] for i in path)
    chosen = [False] * n
    for i in live:
        if i >= body and chars[i] and dense[i] >= threshold and (2 * link_chars[i] < chars[i] or i == body):
            chosen[best[i]] = True
    content = joined(page, live, up, path, chosen, chars, link_chars)
    return "\n\n".join(blocks(page, kept, [content[hold[i]] for i in range(n)]))


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def joined(page: Page, live: list[int], up: list[int], path: list[int], chosen: list[bool], chars: list[int], link_chars: list[int]) -> list[bool]:
    """chosen subtrees, and of the children of blocks from body to the best subtree those that go with
    them: what stands between two with content, siblings of content of the same element and class (in an article or
    main element any), and, where no content so far has a headline, what follows the last headline before it. Never what is mostly links."""
    n = len(page.tag)
    content, within, titled = chosen[:], chosen[:], [page.tag[i] in HEADINGS for i in range(n)]
    heading = [0] * n  # characters in headlines
    children: dict[int, list[int]] = {i: [] for i in path}
    for i in live:
        if i and content[up[i]]:
            content[i] = True
        if up[i] in children:
            children[up[i]].append(i)
    for i in reversed(live):
        if page.tag[i] in HEADINGS:
            heading[i] = chars[i]
        if i:
            heading[up[i]] += heading[i]
            within[up[i]] |= within[i] or content[i]
            titled[up[i]] |= titled[i]
    fine = lambda i: chars[i] > 0 and 2 * link_chars[i] < chars[i]
    marked = [page.tag[i] in ("article", "main") for i in range(n)]
    for i in live:
        if i:
            marked[i] |= marked[up[i]]
    has_title = titled[path[0]]
    more = []
    for at in path[1:]:
        row = children[at]
        if marked[at]:  # so the page says: all of it
            more += [i for i in row if fine(i)]
            has_title |= titled[at]
            continue
        holding = [k for k, i in enumerate(row) if within[i]]
        first, last = holding[0], holding[-1]
        same = {(page.tag[row[k]], page.kind[row[k]]) for k in holding if content[row[k]]} if at != path[-1] else set()
        more += [i for k, i in enumerate(row) if not within[i] and fine(i) and (first < k < last or (page.tag[i], page.kind[i]) in same)]
        has_title |= any(titled[row[k]] for k in holding if content[row[k]])
        if not has_title:
            heads = [k for k in range(first) if heading[row[k]] and heading[row[k]] == chars[row[k]]]
            if heads:
                more += [i for i in row[heads[-1] : first] if fine(i)]
                has_title = True
    for i in more:
        content[i] = True
    for i in live:
        if i and content[up[i]]:
            content[i] = True
    return content


def blocks(page: Page, kept: list[tuple[int, str]], content: list[bool]) -> Iterator[str]:
    """Text between the borders of block elements."""
    block = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        block[i] = block[page.parent[i]] if page.tag[i] in INLINE or page.tag[i] == "br" else i
    run: list[str] = []
    last = -1
    for node, piece in kept:
        if content[node]:
            if block[node] != last and run:
                if text := " ".join("".join(run).split()):
                    yield text
                run = []
            last = block[node]
            run.append(piece)
    if text := " ".join("".join(run).split()):
        yield text


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text, the main text of html_col, and n_chars, its code points.

    Null, empty and markup-only pages have an empty text. Pages of any length are read whole, broken
    markup too: what is not closed ends with what holds it, and a tag or comment cut off at the end is
    dropped. Repeated rows get the same text each; an empty table stays empty. Columns of pages named
    as the results are replaced, in any case of letters.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in batch], dtype=object)

    out = pages.select(*others(pages, ["text", "n_chars"]), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
