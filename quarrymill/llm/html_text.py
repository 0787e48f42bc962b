"""Main text of web pages by tree scoring.

The page becomes a numbered tree. Text blocks give points to their ancestors for length and
commas, each container's points are discounted by its link density, and the container
with the most points is kept with those siblings that score well or read like prose.

Elements are numbered in page order and blocks too, so an element's blocks are a range and
every sum over them is a difference of running sums: the work grows with the page's length,
whatever its depth or the number of siblings. No markup is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _texts

# fixed values: the HTML element names of each kind
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body center details div main section td blockquote form".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Never main text, whatever is inside.
DROPPED = set("script style noscript template head title nav aside select option textarea datalist fieldset iframe noembed noframes object svg canvas audio video dialog menu search annotation annotation-xml".split())
#: Blocks of running text; the labels and buttons that stand in their sentences belong to them.
PROSE = set("p li dt dd td th blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
CONTROL = {"button", "label"}
#: Blocks beside the best container that are judged by link density alone.
BESIDE = set("p ul ol dl pre table figure".split())
#: What may stand in a head; any other element ends one that is open.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
# start tags that end an open element of the first set, unless one of the second was opened inside it
_CELL_EDGE, _LIST_EDGE = {"table"}, set("ul ol menu dir table td th".split())
ENDS = {
    "li": [({"li"}, _LIST_EDGE)], "dt": [({"dt", "dd"}, {"dl", "table", "td", "th"})], "dd": [({"dt", "dd"}, {"dl", "table", "td", "th"})], "option": [({"option"}, {"select"})],
    "tr": [({"td", "th"}, _CELL_EDGE), ({"tr"}, _CELL_EDGE)], "td": [({"td", "th"}, {"table", "tr"})], "th": [({"td", "th"}, {"table", "tr"})],
    **{t: [({"td", "th"}, _CELL_EDGE), ({"tr"}, _CELL_EDGE), ({"tbody", "thead", "tfoot"}, _CELL_EDGE)] for t in ("tbody", "thead", "tfoot")},
}
ENDS_P = BLOCK - set("body html head td th tr tbody thead tfoot caption".split())
SCOPE = set("table td th caption object template button".split())
#: Elements that an end tag doesn't reach through, where these aren't SCOPE.
_END_EDGE = {**{t: SCOPE - {t} for t in SCOPE}, **dict.fromkeys("tr td th tbody thead tfoot caption".split(), _CELL_EDGE), "table": set()}

#: Words that make an element junk wherever a class or id has them, and words that must be the head of the name.
STRONG = set("breadcrumb breadcrumbs comment comments disqus masthead modal navbar navigation newsletter pager pagination popup sidebar toolbar".split())
WEAK = set("alert banner consent cookie cookies disclaimer foot footer hidden login menu nav notice promo promoted promotion related replies reply respond share sharing signup social sponsor sponsored subscribe subscription warning widget".split())
ADVERTS = set("ad ads adsense adsbygoogle advert adverts advertisement advertising".split())
COMMENTS = set("comment comments disqus replies reply respond".split())
#: Words of place and form after a name's head, which don't change what it is.
PLACE = set("area bar block bottom box btn button buttons col column container form group icon icons inner item items left link links list mobile module overlay panel posts right row section side slot stories strip top unit wrap wrapper x".split())
#: Words before and after a junk word that say what an element has, lacks or does at some width, not what it is.
BEFORE, AFTER = set("has no not with without".split()), set("open closed enabled disabled".split())
WIDTHS = set("xs sm md lg xl".split())
#: Words that leave a junk word the whole name of an element inside an article.
OWN = set("article body content entry global is js main page post primary reader secondary site the user visually".split())
#: What names a paragraph or list item of an article as none of its text.
NOTICES = set("cookie cookies notice promo promoted promotion share sharing social sponsor sponsored".split())
WORDS = re.compile(r"[a-z]+")
GOOD = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|page|post|story|text)(?:$|[^a-z])")
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
COMMA = re.compile("[,،、，]")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*>?")
_DOCTYPE = re.compile(r"<!doctype[^>\[]*", re.IGNORECASE)
_SUBSET_END = re.compile(r"\]\s*>")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: Divisors of a block's points for its nearest containers, and for all above them.
NEAR, FAR = (1, 2, 3, 6), 9


class Tree:
    """Elements by number in page order, and ``items``: texts, opened elements (k), closed ones (~k), and None where a link ends before its element."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.attrs = ["html"], [-1], [{}]
        self.items: list[str | int | None] = [0]
        self.opened, self.closed = [0], [0]
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # heights in the stack of the open elements of each name
        self.blocks: list[int] = [0]  # heights of the open blocks
        self.ended_links: set[int] = set()
        self.bracket = (-1, 0)  # the next "]" of a doctype, and the end of its tag if that follows
        self._read(html)
        self._pop(0)
        self.items.append(~0)
        self.closed[0] = len(self.items) - 1

    # ------------------------------------------------------------ reading

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._text(html[at:lt])
            if lt == n:
                return
            after = html[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha():
                at = self._start(html, lt)
            elif after == "/":
                at = self._end(html, lt)
            elif after == "!":
                at = self._declaration(html, lt)
            elif after == "?":
                at = html.find(">", lt) + 1 or n
            else:
                self._text("<")
                at = lt + 1

    def _declaration(self, html: str, at: int) -> int:
        n = len(html)
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at) + 1
            end = _COMMENT_END.search(html, at + 4)
            return end.end() if end else n
        if html.startswith("<![CDATA[", at):
            return html.find("]]>", at) + 3 if html.find("]]>", at) >= 0 else n
        doctype = _DOCTYPE.match(html, at)
        if doctype and html.startswith("[", doctype.end()):
            if self.bracket[0] < doctype.end():  # the next one serves all doctypes before it
                bracket = html.find("]", doctype.end())
                end = _SUBSET_END.match(html, bracket) if bracket >= 0 else None
                self.bracket = (bracket if bracket >= 0 else n, end.end() if end else 0)
            if self.bracket[1]:
                return self.bracket[1]
        return html.find(">", at) + 1 or n

    def _attributes(self, html: str, at: int) -> tuple[dict[str, str], int]:
        found: dict[str, str] = {}
        while True:
            end = _TAG_END.match(html, at)
            if html[end.end() - 1 : end.end()] == ">" or end.end() == len(html):
                return found, end.end()
            one = _ATTRIBUTE.match(html, at)
            name = one[1].lower()
            if name not in found:
                value = one[2] or one[3] or one[4] or ""
                found[name] = unescape(value) if "&" in value else value
            at = one.end()

    def _start(self, html: str, at: int) -> int:
        name = _NAME.match(html, at + 1)
        tag, at = name[0].lower(), name.end()
        if html[at : at + 1] == ">":
            attrs, at = {}, at + 1
        else:
            attrs, at = self._attributes(html, at)
        self._leave_head(tag)
        if tag == "br":
            self.items.append("\n")
        elif tag != "html" and not (tag in ("head", "body") and self.places.get(tag)):
            if tag in ENDS_P and self.places.get("p"):
                self._close({"p"}, SCOPE)
            if tag in HEADING and self.tag[self.stack[-1]] in HEADING:
                self._pop(len(self.stack) - 1)
            for which, edges in ENDS.get(tag, ()):
                self._close(which, edges)
            self._push(tag, attrs)
            if tag in VOID or tag in ("svg", "math") and html[at - 2 : at] == "/>":
                self._pop(len(self.stack) - 1)
            elif tag in RAW and html[at - 2 : at] != "/>":
                end = _RAW_END[tag].search(html, at)
                text = html[at : end.start() if end else len(html)]
                if tag == "xmp":
                    self.items.append(text)
                at = end.start() if end else len(html)
        return at

    def _end(self, html: str, at: int) -> int:
        name = _NAME.match(html, at + 2)
        if name is None:
            return at + 3 if html[at + 2 : at + 3] == ">" else html.find(">", at) + 1 or len(html)
        end = name.end() + 1 if html[name.end() : name.end() + 1] == ">" else self._attributes(html, name.end())[1]
        tag = name[0].lower()
        if tag == "br":
            self.items.append("\n")
        places = self.places.get(tag)
        if not places or tag in ("body", "html"):
            return end
        if tag in BLOCK or tag in DROPPED:
            if places[-1] == len(self.stack) - 1 or places[-1] > self._last(_END_EDGE.get(tag, SCOPE)):
                self._pop(places[-1])
        elif places[-1] > self.blocks[-1]:
            self._pop(places[-1])
        elif tag == "a" and self.stack[places[-1]] not in self.ended_links:  # a link around blocks ends, its element goes on
            self.ended_links.add(self.stack[places[-1]])
            self.items.append(None)
        return end

    def _text(self, text: str) -> None:
        if self.tag[self.stack[-1]] == "head" and not text.isspace():
            self._pop(len(self.stack) - 1)
        self.items.append(unescape(text) if "&" in text else text)

    # ------------------------------------------------------------ the stack

    def _leave_head(self, tag: str) -> None:
        """Close an open head at the first element that can't stand there."""
        head = self.places.get("head")
        if head and tag not in IN_HEAD and (tag == "body" or self.tag[self.stack[-1]] not in IN_HEAD):
            self._pop(head[-1])

    def _last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags: set[str], edges: set[str]) -> None:
        last = self._last(tags)
        if last >= 0 and last > self._last(edges - tags):
            self._pop(last)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.attrs.append(attrs)
        self.opened.append(len(self.items))
        self.closed.append(0)
        self.items.append(k)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(k)

    def _pop(self, height: int) -> None:
        """Close all from ``height`` on, but never the root."""
        while len(self.stack) > max(height, 1):
            k = self.stack.pop()
            self.places[self.tag[k]].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.closed[k] = len(self.items)
            self.items.append(~k)


# ------------------------------------------------------------ what is never main text


def _named(attrs: dict) -> str:
    """Class and id, with camelCase parted."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()


def _names(attrs: dict, strong: set[str], weak: set[str]) -> bool:
    """Whether a class or id names one of the words: a strong one anywhere, a weak one as the head of the name.

    The head is the last word but for words of place ("share-buttons" is a share, "related-work"
    a work). A modifier beside the word ("no-sidebar", "comments-open") takes the name back.
    """
    if "class" not in attrs and "id" not in attrs:
        return False
    for token in _named(attrs).split():
        words = WORDS.findall(token)
        head = len(words) - 1
        while head > 0 and words[head] in PLACE:
            head -= 1
        for k, word in enumerate(words):
            if word in strong or k == head and word in weak:
                if not (k and words[k - 1] in BEFORE or words[k + 1 : k + 2] and (words[k + 1] in AFTER or words[k + 1] in WIDTHS)):
                    return True
            elif word == "hidden" and k < head and words[k + 1] not in WIDTHS and k:  # visually-hidden-text
                return True
    return False


def _named_whole(attrs: dict, words: set[str], ids: set[str]) -> bool:
    """Whether a class is one of ``words``, or an id one of ``ids``, as a whole but for words of place."""
    for name, known in (("class", words), ("id", ids)):
        for token in _named({name: attrs.get(name, "")}).split():
            own = [w for w in WORDS.findall(token) if w not in PLACE and w not in OWN]
            if own and known.issuperset(own):
                return True
    return False


def _names_of_article(tag: str, attrs: dict) -> bool:
    """Whether a class or id makes an element inside an article or main element junk.

    Words of the text become ids of headings, sections and paragraphs, so there only whole
    names count: none of headings but hidden ones, of running text and sections no ids
    ("comments" aside), of other elements both.
    """
    every = STRONG | WEAK | ADVERTS
    if tag in HEADING:
        return _named_whole(attrs, {"hidden"}, set())
    if tag in PROSE:
        return _named_whole(attrs, STRONG | ADVERTS | COMMENTS | NOTICES | {"hidden"}, set())
    return _named_whole(attrs, every, COMMENTS if tag == "section" else every)


def _hidden(attrs: dict) -> bool:
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found" or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in JUNK_ROLES:
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def junk_of(tree: Tree) -> list[bool]:
    """For every element outside other junk: whether it is junk.

    Junk are elements that never are main text, hidden ones, forms, page headers and footers,
    and what a class or id names so, inside an article only by its whole name. A container that only its name or its being a form makes
    junk stays if it holds most of the page's text outside links and, where the page has an
    article or main element, also one of these; adverts and reader comments never stay.
    """
    n = len(tree.tag)
    junk, held = [False] * n, [False] * n  # held: inside an article or main element
    quoted = [False] * n
    size: list[int] = []
    marked, paragraphs = ([0, *accumulate(t in tags for t in tree.tag)] for tags in ({"article", "main"}, {"p"}))

    def inside(counts: list[int], k: int) -> int:
        return counts[bisect_left(tree.opened, tree.closed[k])] - counts[k]

    def most(k: int) -> bool:
        if not size:
            size.extend(_sizes(tree))
        return 2 * (size[tree.closed[k]] - size[tree.opened[k]]) > size[-1] and (not marked[-1] or inside(marked, k) > 0)

    for k in range(1, n):
        tag, attrs, up = tree.tag[k], tree.attrs[k], tree.parent[k]
        if junk[up]:
            junk[k] = True
            continue
        held[k] = held[up] or tag in ("article", "main")
        quoted[k] = quoted[up] or tag == "blockquote"
        if tag in DROPPED or tag == "footer" and not quoted[up] or attrs and _hidden(attrs):
            junk[k] = True
        elif tag == "form":
            junk[k] = not most(k) or not inside(marked, k) and inside(paragraphs, k) < 2
        elif tag in ("body", "main"):
            pass
        elif tag == "article":
            junk[k] = bool(attrs) and (_named_whole(attrs, COMMENTS, COMMENTS) if held[up] else _names(attrs, COMMENTS, set()))
        elif attrs and held[up]:
            junk[k] = _names_of_article(tag, attrs) and (tag not in CONTAINER or _names(attrs, COMMENTS | ADVERTS, set()) or not most(k))
        elif attrs and _names({"class": attrs.get("class", "")} if tag in HEADING else attrs, STRONG | ADVERTS, WEAK):
            junk[k] = tag not in CONTAINER or _names(attrs, COMMENTS | ADVERTS, set()) or not most(k)
        elif (tag == "header" or attrs and _names(attrs, set(), {"header"})) and not held[up] and not GOOD.search(_named(tree.attrs[up])):
            junk[k] = tag not in CONTAINER or not most(k)
    return junk


def _sizes(tree: Tree) -> list[int]:
    """Running sums, by item: characters of text outside links, dropped elements, footers and controls."""
    out, total, at = [], 0, 0
    skip = DROPPED | CONTROL | {"a", "footer"}
    until = -1
    for at, item in enumerate(tree.items):
        if isinstance(item, str):
            if at > until:
                total += len(item.strip())
        elif item is not None and item >= 0 and at > until and tree.tag[item] in skip:
            until = tree.closed[item]
        out.append(total)
    return out


# ------------------------------------------------------------ blocks and scores


class Blocks:
    """The non-empty text blocks in page order, with running sums; ``first[k]`` to ``last[k]`` are those of element k."""

    def __init__(self, tree: Tree, junk: list[bool]) -> None:
        self.owner: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.first, self.last = [0] * len(tree.tag), [0] * len(tree.tag)
        self._parts: list[str] = []
        self._links = self._controls = 0
        tag, items = tree.tag, tree.items
        owners, links, controls, at = [0], 0, 0, 0
        while at < len(items):
            item = items[at]
            at += 1
            if item is None:
                links -= 1
            elif isinstance(item, str):
                if not controls or tag[owners[-1]] in PROSE:
                    self._parts.append(item)
                    if links or controls:
                        length = len(" ".join(item.split()))
                        self._links += length if links else 0
                        self._controls += length if controls else 0
            elif item >= 0:
                name = tag[item]
                if name in BLOCK:
                    self._flush(owners[-1])
                if junk[item]:
                    at = tree.closed[item] + 1
                    continue
                self.first[item] = len(self.text)
                if name in BLOCK:
                    owners.append(item)
                links += name == "a"
                controls += name in CONTROL
            else:
                name = tag[~item]
                if name in BLOCK:
                    self._flush(owners[-1])
                    owners.pop()
                self.last[~item] = len(self.text)
                links -= name == "a" and ~item not in tree.ended_links
                controls -= name in CONTROL
        self.chars = [0, *accumulate(map(len, self.text))]
        self.link_chars = [0, *accumulate(self.linked)]

    def _flush(self, owner: int) -> None:
        if self._parts:
            joined = " ".join("".join(self._parts).split())
            if joined and self._controls < len(joined):
                self.owner.append(owner)
                self.text.append(joined)
                self.linked.append(min(self._links, len(joined)))
            self._parts, self._links, self._controls = [], 0, 0

    def size(self, k: int) -> int:
        return self.chars[self.last[k]] - self.chars[self.first[k]]

    def density(self, k: int) -> float:
        return (self.link_chars[self.last[k]] - self.link_chars[self.first[k]]) / max(self.size(k), 1)


def points_of(tag: str, text: str) -> float:
    """What a block is worth: for being one, its commas and its length; headings and short fragments nothing."""
    if tag in HEADING or len(text) < 25 and tag != "p":
        return 0.0
    return 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3.0) + len(text) / 1000


def scores_of(tree: Tree, blocks: Blocks) -> dict[int, float]:
    """Of every container with text: its blocks' points, less the further away they are, times a bonus, discounted by link density."""
    tag, parent = tree.tag, tree.parent
    above = [0] * len(tag)  # the nearest container at or above each element; the root counts as one
    for k in range(1, len(tag)):
        above[k] = k if tag[k] in CONTAINER else above[parent[k]]
    points = [points_of(tag[o], t) for o, t in zip(blocks.owner, blocks.text, strict=True)]
    sums = [0.0, *accumulate(points)]
    extra: dict[int, float] = {}
    for owner, p in zip(blocks.owner, points, strict=True):
        k = above[owner]
        for divisor in NEAR:
            extra[k] = extra.get(k, 0.0) + p * (1 / divisor - 1 / FAR)
            if not k:
                break
            k = above[parent[k]]
    out = {}
    for k in range(len(tag)):
        if (tag[k] in CONTAINER or not k) and blocks.last[k] > blocks.first[k]:
            raw = (sums[blocks.last[k]] - sums[blocks.first[k]]) / FAR + extra.get(k, 0.0)
            bonus = {"article": 1.25, "main": 1.15}.get(tag[k], 1.0) * (1.1 if tree.attrs[k] and GOOD.search(_named(tree.attrs[k])) else 1.0)
            out[k] = raw * bonus * (1 - blocks.density(k))
    return out


def _joins(tree: Tree, blocks: Blocks, k: int, score: float, share: float) -> bool:
    """Whether a sibling of the best container belongs to the article."""
    n, density, tag = blocks.size(k), blocks.density(k), tree.tag[k]
    if not n:
        return False
    if tag in BESIDE:
        return density < 0.25
    inside = range(blocks.first[k], blocks.last[k])
    if density == 0 and all(tree.tag[blocks.owner[b]] in HEADING for b in inside):
        return True
    if tag in CONTAINER:
        return score >= share and density < 0.5 or (density < 0.25 if n > 80 else density == 0 and blocks.text[inside[-1]].endswith((".", "!", "?", "。", "！", "？")))
    return False


def main_text(html: str) -> str:
    """The main text of a page: its blocks in page order, joined by single spaces."""
    tree = Tree(html)
    blocks = Blocks(tree, junk_of(tree))
    if not blocks.text:
        return ""
    scores = scores_of(tree, blocks)
    best = max(scores, key=lambda k: (scores[k], tree.tag[k] in ("article", "main"), -k))
    if scores[best] <= 0 and tree.tag[best] not in ("article", "main"):
        return " ".join(t for t, linked in zip(blocks.text, blocks.linked, strict=True) if 2 * linked < len(t))
    k = best
    while k and tree.tag[k] != "article":
        k = tree.parent[k]
    if tree.tag[k] == "article":  # an article is kept whole
        best = k
    while tree.tag[best] != "article" and tree.parent[best] > 0 and (tree.tag[tree.parent[best]] == "main" or blocks.size(tree.parent[best]) == blocks.size(best)):
        best = tree.parent[best]  # a main element is kept whole; beside a wrapper of nothing else may stand what continues the text
    keep = [(blocks.first[best], blocks.last[best])]
    if best:
        share, up = 0.2 * scores.get(best, 0.0), tree.parent[best]
        for k in _children(tree, up):
            if k != best and _joins(tree, blocks, k, scores.get(k, 0.0), share):
                keep.append((blocks.first[k], blocks.last[k]))
    return " ".join(t for a, b in sorted(keep) for t in blocks.text[a:b])


def _children(tree: Tree, up: int) -> Iterator[int]:
    at, end = tree.opened[up] + 1, tree.closed[up]
    while at < end:
        item = tree.items[at]
        if isinstance(item, int) and item >= 0:
            yield item
            at = tree.closed[item]
        at += 1


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text. Rows with equal or null page_id are kept one
    by one, and of containers with equal scores the first of the page is taken. Malformed
    markup (unclosed comments, tags, attributes or sections, stray end tags) never fails: an
    unclosed comment or script reaches to the end of the page. Other columns are ignored;
    the whole html is read whatever its length. Empty table: no row.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.decode()) for x in _texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return cols.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
