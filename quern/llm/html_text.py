"""Main text of HTML pages by composite text density.

A page is read by a tolerant scanner into a tree of elements; what never holds an article (scripts,
styles, menus and the like, and what is hidden) is left out of it. So are forms and elements that a class, id or role names as
advert, sidebar, reader comment, notice and so on: a name's token counts by its first or last word (`comment-list`,
`left-sidebar`, not `content-sidebar-wrap` or `has-comments`). In an article, paragraphs, list items, quotations, cells and
headings don't go for their names, and in main only for a name of one word. Wrappers of the article or main with the
most text outside of reader comments stay, and, where what is left holds no prose at all, or the page's only h1 was in one,
so do elements named as noise, but never reader comments or notices. The other nodes are the block-level
elements; inline tags only count, as they would split a paragraph's density. For every node, with C characters and T
tags below it, of which LC and LT in links, the composite density is

    C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

with the body's LCb and Cb, a missing count taken as 1; where the page has no links the base is 1 and
the factor is left out. The element whose children's densities sum to the most is the article. The threshold is
the least density on its path to the body: siblings on that path that reach it, with less than 30 % of their
characters in links, belong to the article too, as does a headline h1. Where the path leads through an article or main, or
the subtree holds the page's only one, with a heading if it is an article, that element bounds the article: of its siblings only an h1 and others of its kind belong to it, and all in it
does, however short, but for menus: lists of over three links and other containers of two or more, with 80 % of
their text in links (in lists, of less than 40 characters each). Where nothing bounds it, menus are lists of two or more, and paragraphs, headings, quotations and
preformatted text beside the path belong to it, and text that stands in its elements directly, if it reaches the threshold.

Text runs between block-level elements are blocks. Character references are decoded, white space in a
block becomes one space, blocks are joined in page order by two line feeds. Nothing is capped.

Nulls and oddities: a null or empty page gives an empty text; so does one without text. Unclosed and
misnested tags close as browsers close them in the common cases. Repeated rows are read each. Extra
columns are ignored. The scanner doesn't recurse, so depth is no limit, and reads a very long page once, whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import pieces

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("head nav footer aside button select option input textarea menu dialog svg math object applet canvas audio video map datalist label".split())
#: Such elements may wrap a whole page.
_FORMS = frozenset(("form", "fieldset"))
_CLOSES_P = _BLOCK - frozenset("body html caption tbody td tfoot th thead tr option legend summary".split())
#: An opening tag closes an open one of these kinds, unless one of the fences lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
_NOISE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar "
    "comment comments commentlist commenter disqus reply replies respond discussion notice notices notification cookie cookies consent gdpr alert "
    "disclaimer popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager paging footer masthead topbar toolbar "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup signin login search widget widgets "
    "skip copyright paywall toc tags outbrain taboola hidden".split()
)
#: Elements of such names hold readers' or the site's words, never the article.
_READERS = frozenset("comment comments commentlist commenter disqus reply replies respond discussion notice notices notification cookie cookies consent gdpr alert disclaimer".split())
#: First words that turn a name's last word to its opposite or to a mere property.
_PROPERTIES = frozenset("has no with without is not single".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Such elements, where over 80 % of the text stands in links, are menus: lists of over three, others of two or more.
_LISTS, _HOLDERS = frozenset("ul ol dl".split()), frozenset("ul ol div section table dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of running text.
_PROSE = frozenset("p li blockquote pre td th dd dt figcaption caption tr figure".split())
#: What may stand in a head; anything else ends it.
_HEAD = _RAW | frozenset("base basefont bgsound link meta".split())
_P_FENCES = frozenset("caption td th table".split())
_ROOTS = frozenset(("html", "body", "main"))


def _named(token: str, whole: bool) -> int:
    """What one token of a class or id says: 0 nothing, 1 noise, 2 reader comments or notices. whole: only names of one word count."""
    words = [w.lower() for w in _SPLIT.split(token) if w]
    if not words or whole and len(words) > 1:
        return 0
    said = {words[0]} if words[0] in _PROPERTIES else {words[0], words[-1]}
    return 2 if said & _READERS else int(bool(said & _NOISE))


def _noisy(tag: str, attributes: str, main: bool, article: bool) -> int:
    """What speaks against an element: 0 nothing, 1 its name in class, id or role, or a form; 2 a name of reader comments or notices; 3 it never holds an article. main, article: it is in one."""
    if tag in _NEVER or tag == "header" and not main and not article:
        return 3
    found = int(tag in _FORMS)
    if not attributes or tag in _ROOTS:
        return found
    text, inline = tag in _PROSE or tag in _HEADINGS, tag not in _BLOCK
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if article and text:
                continue
            for token in unescape(value).split():
                found = max(found, _named(token, text and main or inline and (article or main)))
                if not found and not main and not article and not text and "header" in (words := {w.lower() for w in _SPLIT.split(token)}) and not words & {"article", "entry", "post", "content"}:
                    found = 1
        elif name == "role" and value.lower() in _ROLES:
            found = max(found, 1)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 3
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
    return found


class _Tree:
    """Elements in page order: tag, parent, and the counts of composite density."""

    def __init__(self) -> None:
        self.tag, self.parent, self.chars, self.tags, self.link_chars, self.link_tags = ["html"], [-1], [0], [0], [0], [0]
        self.breaks, self.noise, self.inline = [0], [0], [False]
        self.texts: list[tuple[int, str, int, bool]] = []  # (element, text, number of its block, in a link)

    def read(self, page: str) -> None:
        open_, at, block, link = [0], 0, 0, False
        where: dict[str, list[int]] = {"html": [0]}  # places of the open elements of each kind
        inlines = [0]  # and of inline ones
        # No tag ends beyond the last ">": without that bound, many openings without an end would each be read to the end.
        find, end, last = _TAG.search, len(page), page.rfind(">") + 1

        def close(down_to: int) -> None:
            nonlocal link
            while len(open_) > down_to:
                k = open_.pop()
                where[self.tag[k]].pop()
                if self.inline[k]:
                    inlines.pop()
                link = False

        while at < end:
            m = find(page, at, last)
            upto = m.start() if m else end
            if not m and (comment := page.find("<!--", at)) >= 0:
                end = upto = comment
            if upto > at:
                text = page[at:upto]
                self.texts.append((open_[-1], unescape(text) if "&" in text else text, block, link))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if at == last and page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, at):
                    break  # a comment that doesn't end
                continue
            tag, closing = tag.lower(), bool(m[1] if m[2] else m[4])
            if closing:
                if tag in _BLOCK:
                    block += 1
                elif tag == "a":
                    link = False
                if where.get(tag) and tag not in ("html", "body"):
                    close(max(where[tag][-1], 1))
                continue
            if where.get("head") and tag not in _HEAD and tag != "head":
                close(where["head"][0])
            if tag in _RAW:
                m2 = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = m2.end() if m2 else end
                continue
            if tag in _BLOCK:
                block += 1
            last_of = lambda kinds: max((where[k][-1] for k in kinds if where.get(k)), default=0)
            if tag in _CLOSES_P and where.get("p") and where["p"][-1] > max(last_of(_P_FENCES), inlines[-1]):
                close(where["p"][-1])
            if tag in _CLOSES and any(where.get(k) for k in _CLOSES[tag][0]):
                shuts, fences = _CLOSES[tag]
                fence = last_of(fences)
                above = [where[k][i] for k in shuts if where.get(k) and (i := bisect_right(where[k], fence)) < len(where[k])]
                close(min(above, default=len(open_)))
            attributes = m[3] if m[2] else m[6]
            if tag in _VOID:
                if tag == "br" and self.texts:
                    self.texts.append((open_[-1], " ", block, link))
                self.tags[open_[-1]] += 1
                self.breaks[open_[-1]] += tag == "br"
                continue
            noise = _noisy(tag, attributes, bool(where.get("main")), bool(where.get("article")))
            if noise and (attributes or "").endswith("/"):
                continue
            # An inline element is a node while it may be left out, and so are those of its kind in it, for their end tags.
            if tag not in _BLOCK and not noise and not where.get(tag):
                self.tags[open_[-1]] += 1
                if tag == "a":
                    self.link_tags[open_[-1]] += 1
                    link = True
                continue
            if tag == "a":
                link = True
            self.tag.append(tag)
            self.noise.append(noise)
            self.inline.append(tag not in _BLOCK)
            self.parent.append(open_[-1])
            for counts in (self.chars, self.tags, self.link_chars, self.link_tags, self.breaks):
                counts.append(0)
            where.setdefault(tag, []).append(len(open_))
            if self.inline[-1]:
                inlines.append(len(open_))
            open_.append(len(self.tag) - 1)

    def prune(self) -> None:
        """Leave out what speaks against itself, unless it holds the page's article; inline elements merge with their parents."""
        size = len(self.tag)
        if not any(self.noise):
            return
        hard, mark = [False] * size, [False] * size  # never kept; in an element with noise, itself left out
        for k in range(1, size):
            up = self.parent[k]
            hard[k] = hard[up] or self.noise[k] == 3
            mark[k] = mark[up] or self.noise[up] > 0
        reader, prose, heading = [False] * size, [False] * size, [False] * size  # in such an element, itself included
        for k in range(1, size):
            up = self.parent[k]
            reader[k] = reader[up] or self.noise[k] == 2
            prose[k] = prose[up] or self.tag[k] in _PROSE
            heading[k] = heading[up] or self.tag[k] in _HEADINGS
        plain, title = [0] * size, [False] * size
        for element, text, _, link in self.texts:
            if not link and not hard[element]:
                plain[element] += len(" ".join(text.split()))
        own = list(plain)
        for k in range(size - 1, 0, -1):
            plain[self.parent[k]] += plain[k]
            title[k] = title[k] or self.tag[k] == "h1" and plain[k] > 0
            title[self.parent[k]] = title[self.parent[k]] or title[k]
        # The article or main with the most text; one that is named as noise counts only outside of other such elements.
        holders = [k for k in range(1, size) if self.tag[k] in ("article", "main") and plain[k] and not (self.noise[k] and mark[k]) and (not reader[k] or self.tag[k] == "main" or title[k])]
        k = holder = max(holders, key=lambda k: plain[k]) if holders else 0
        spared = set()
        while k:
            spared.add(k)
            k = self.parent[k]
        # Elements with the article's marks; beside an article or main all noise is noise.
        within = [holder == 0] * size
        left = {True: 0, False: 0}  # text in prose and elsewhere that no noise holds
        any_prose = titled = False
        above = [False] * size  # noise stands above the element, in the article if there is one
        for k in range(1, size):
            up = self.parent[k]
            within[k] = within[up] or k == holder
            above[k] = up != holder and (above[up] or self.noise[up] > 0)
            if within[k] and not hard[k] and not reader[k]:
                clean = k in spared or not self.noise[k] and not above[k]
                any_prose |= prose[k] and own[k] > 0
                titled |= clean and self.tag[k] == "h1" and plain[k] > 0
                if clean and not heading[k]:
                    left[prose[k]] += own[k]
        left[False] += own[holder]
        bare = left[True] == 0 if any_prose else left[False] == 0
        gone = [False] * size
        for k in range(1, size):
            kept = k in spared or within[k] and self.noise[k] == 1 and (bare or not titled and title[k])
            gone[k] = gone[self.parent[k]] or self.noise[k] > 0 and not kept or self.noise[k] == 3
        owner = list(range(size))
        for k in range(1, size):
            self.parent[k] = up = owner[self.parent[k]]
            if gone[k]:
                self.tags[k] = self.link_tags[k] = self.breaks[k] = 0
            elif self.inline[k]:
                owner[k] = up
                self.tags[up] += self.tags[k] + 1
                self.link_tags[up] += self.link_tags[k] + (self.tag[k] == "a")
                self.breaks[up] += self.breaks[k]
                self.tags[k] = self.link_tags[k] = self.breaks[k] = 0
        self.texts = [(owner[e], text, block, link) for e, text, block, link in self.texts if not gone[e]]
        # Numbers of the elements that stay, in page order.
        stay = [k for k in range(size) if not gone[k] and owner[k] == k]
        place = {k: i for i, k in enumerate(stay)}
        self.texts = [(place[e], text, block, link) for e, text, block, link in self.texts]
        self.parent = [place.get(self.parent[k], -1) for k in stay]
        for name in ("tag", "chars", "tags", "link_chars", "link_tags", "breaks"):
            values = getattr(self, name)
            setattr(self, name, [values[k] for k in stay])

    def add_up(self) -> None:
        for element, text, _, link in self.texts:
            size = len(" ".join(text.split()))
            self.chars[element] += size
            self.link_chars[element] += size * link
        for k in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            up = self.parent[k]
            self.chars[up] += self.chars[k]
            self.tags[up] += self.tags[k] + 1
            self.link_chars[up] += self.link_chars[k]
            self.link_tags[up] += self.link_tags[k]

    def own_densities(self) -> list[float]:
        """Of the text that stands in each element directly, links and line breaks left out."""
        chars, tags = [0] * len(self.tag), [t - lt - b for t, lt, b in zip(self.tags, self.link_tags, self.breaks, strict=True)]
        for element, text, _, link in self.texts:
            chars[element] += 0 if link else len(" ".join(text.split()))
        for k in range(1, len(tags)):
            tags[self.parent[k]] -= self.tags[k] + 1 - self.link_tags[k]
        return [c / max(t, 1) for c, t in zip(chars, tags, strict=True)]

    def densities(self) -> list[float]:
        ratio, out = self.link_chars[0] / max(self.chars[0], 1), []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                out.append(0.0)
                continue
            base = math.log(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
            factor = math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base if base > 1e-9 else 1.0
            out.append(c / max(t, 1) * factor)
        return out


def main_text(page: str | None) -> str:
    """The article's text; see the module."""
    if not page:
        return ""
    tree = _Tree()
    tree.read(page)
    tree.prune()
    tree.add_up()
    density = tree.densities()
    sums = [0.0] * len(density)
    for k in range(1, len(density)):
        sums[tree.parent[k]] += density[k]
    body = next((k for k, tag in enumerate(tree.tag) if tag == "body"), 0)
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    end = list(range(1, len(density) + 1))  # an element's descendants are those up to here
    for k in range(len(density) - 1, 0, -1):
        end[tree.parent[k]] = max(end[tree.parent[k]], end[k])
    alone, titled = [], set()  # outermost articles or mains in it, and those with a heading
    for k in range(best + 1, end[best]):
        if tree.chars[k] and tree.tag[k] in ("article", "main") and not (alone and k < end[alone[-1]]):
            alone.append(k)
        elif tree.chars[k] and tree.tag[k] in _HEADINGS and alone and k < end[alone[-1]]:
            titled.add(alone[-1])
    if len(alone) == 1 and (tree.tag[alone[0]] == "main" or alone[0] in titled) and tree.tag[best] not in ("article", "main"):
        best = alone[0]
    path = [best]
    while path[-1] > 0 and path[-1] != body:
        path.append(tree.parent[path[-1]])
    threshold = min(density[k] for k in path)
    taken = [False] * len(density)
    on_path = set(path)
    holder = next((k for k in reversed(path) if tree.tag[k] in ("article", "main")), None)
    taken[best if holder is None else holder] = True
    if holder is None:  # nothing says where the article ends: text that stands in them must be as dense as a sibling
        own = tree.own_densities()
        around = {k for k in path[1:] if own[k] >= threshold}
    else:
        around = set()
    for k in range(1, len(density)):
        up, c = tree.parent[k], tree.chars[k]
        if taken[k]:
            continue
        if taken[up]:
            menu = tree.tag[k] in _HOLDERS and tree.link_chars[k] > 0.8 * c
            lines = holder is not None and tree.tag[k] in _LISTS
            taken[k] = not (menu and tree.link_tags[k] > (3 if lines else 1) and not (lines and tree.link_chars[k] >= 40 * tree.link_tags[k]))
        elif up in on_path and k not in on_path and c > 0:
            prose = holder is None and (tree.tag[k] in ("p", "blockquote", "pre") or tree.tag[k] in _HEADINGS)
            dense = density[k] >= threshold and (holder is None or tree.tag[k] in ("article", "main"))
            taken[k] = tree.tag[k] == "h1" or (prose or dense) and tree.link_chars[k] < 0.3 * c
    blocks: dict[int, list[str]] = {}
    # Beside the subtree a block that is nothing but links is a menu.
    bounds = set() if holder is None else set(path[1 : path.index(holder) + 1])
    prose = {block for element, text, block, link in tree.texts if not link and text.strip()}
    for element, text, block, link in tree.texts:
        if taken[element] and not (element in bounds and block not in prose) or element in around and not link:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


_TEXT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=_TEXT)


def extract_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of `pages`: id, url, text, n_chars."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id, "url": url})
