"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = frozenset("ul ol dl table div article section main body aside nav header footer form select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that stand for themselves, unlike containers.
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl table figure figcaption".split())
# Elements that show no text, and elements that are never article text. Words in class, id or role that say so, and words that may stand beside them.
UNSEEN = frozenset("script style noscript template iframe object embed canvas svg math title head textarea option select".split())
DROPPED = frozenset("script style noscript template iframe object embed canvas svg math nav aside footer form button select option textarea input dialog menu title head".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail aside footer foot masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist respond replies disqus discussion "
    "pagination pager toolbar widget contentinfo complementary search dialog alert alertdialog skip".split()
)
BESIDE = frozenset("area article bar block bottom box btn button buttons col column container content form global group header icons inner left link links list main media outer page panel post posts primary reader right row secondary section site slot top unit user wrap wrapper".split())
#: An element of a noise name that holds a heading and more than this share of the page's characters is no noise.
MOST_NOISE = 0.5
#: Of a subtree's neighbours, those that hold this share of its characters belong to the same article.
SISTER = 0.2

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_ENDS = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[a-z]+|[0-9]+")


class Page:
    """A page's elements in document order (number 0 is the root, parents come first) and its texts.

    events: (element, text), or (element, None) where a block begins or ends.
    """

    def __init__(self) -> None:
        self.tags, self.parents, self.attributes = ["#root"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []
        self._open = [0]
        self._places: dict[str, list[int]] = {}
        # of each open element: the place of the nearest fence, and of the nearest block but p, at or before it
        self._fence, self._wall = [0], [0]

    def start(self, tag: str, attributes: str, empty: bool) -> None:
        ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if ends:
            fence = self._fence[-1]
            found = [p[i] for e in ends if (p := self._places.get(e)) and (i := bisect_right(p, fence)) < len(p)]
            if found:
                self._close(min(found))
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.attributes.append(attributes)
        node = len(self.tags) - 1
        if tag not in INLINE:
            self.events.append((node, None))
        if empty or tag in VOID:
            return
        place = len(self._open)
        self._open.append(node)
        self._places.setdefault(tag, []).append(place)
        self._fence.append(place if tag in FENCES else self._fence[-1])
        self._wall.append(place if tag not in INLINE and tag != "p" else self._wall[-1])

    def text(self, text: str) -> None:
        self.events.append((self._open[-1], text))

    def end(self, tag: str) -> None:
        places = self._places.get(tag)
        if not places:
            return
        least = self._wall[-1] if tag in INLINE else self._fence[-1] if tag in ("p", "li") else 0
        if places[-1] > least:
            self._close(places[-1])

    def _close(self, place: int) -> None:
        while len(self._open) > place:
            node = self._open.pop()
            self._fence.pop()
            self._wall.pop()
            self._places[self.tags[node]].pop()
            if self.tags[node] not in INLINE:
                self.events.append((node, None))


def parse(html: str) -> Page:
    """The elements of a page, in one pass. Unclosed elements end where HTML lets them end; a stray end tag is passed over; a tag
    that never ends swallows the rest."""
    page, at, end = Page(), 0, len(html)
    last = {q: html.rfind(q) for q in "\"'>"}
    lower = None
    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt == end - 1:
            page.text(unescape(html[at:]))
            break
        if lt > at:
            page.text(unescape(html[at:lt]))
        after = html[lt + 1]
        if after == "!":
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = stop + 3 if stop >= 0 else end
            elif html.startswith("<![CDATA[", lt):
                stop = html.find("]]>", lt + 9)
                page.text(html[lt + 9 : stop if stop >= 0 else end])
                at = stop + 3 if stop >= 0 else end
            else:
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            continue
        name = NAME.match(html, lt + 2 if after == "/" else lt + 1)
        if name is None:
            if after in "?/":
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            else:
                page.text("<")
                at = lt + 1
            continue
        stop = _tag_end(html, name.end(), last)
        if stop < 0:
            break
        tag, at = name[0].lower(), stop + 1
        if after == "/":
            page.end(tag)
            continue
        attributes = html[name.end() : stop]
        page.start(tag, attributes, attributes.endswith("/") and tag not in RAW)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            close = lower.find(f"</{tag}", at)
            page.text(html[at : close if close >= 0 else end])
            at = close if close >= 0 else end
    return page


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends a tag, or -1. A quote counts if it follows = and is closed somewhere."""
    if last[">"] < at:
        return -1
    while (m := TAG_ENDS.search(html, at)) is not None:
        q, at = m[0], m.end()
        if q == ">":
            return m.start()
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and last[q] >= at:
            at = html.index(q, at) + 1
    return -1


def _noise_name(value: str) -> bool:
    """True if a whole token of the value says noise: each of its parts is a word of noise or one that may stand beside it."""
    for token in value.lower().split():
        parts = PARTS.findall(token)
        if not NOISE.isdisjoint(parts) and all(p in NOISE or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _noise_attributes(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether it is noise by name."""
    hidden = named = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        hidden = hidden or name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
        named = named or name in ("class", "id", "role") and tag not in ("body", "html", "article", "main") and _noise_name(value)
    return hidden, named


def _sums(parents: list[int], own: list[int], skip: list[bool]) -> list[int]:
    """own of every element with its descendants, those of `skip` left out."""
    out = [0 if s else x for x, s in zip(own, skip, strict=True)]
    for i in range(len(out) - 1, 0, -1):
        if not skip[i]:
            out[parents[i]] += out[i]
    return out


def unseen(page: Page) -> list[bool]:
    """The elements that show no text: by kind, and hidden ones, with all in them."""
    out = [False] * len(page.tags)
    for i in range(1, len(out)):
        out[i] = out[page.parents[i]] or page.tags[i] in UNSEEN or bool(page.attributes[i]) and _noise_attributes(page.tags[i], page.attributes[i])[0]
    return out


def noise(page: Page, chars: list[int], body: int, skip: list[bool]) -> list[bool]:
    """The elements that say of themselves that they are noise: by kind, by name, and headers that stand under the body or hold no heading; but
    not by name if they hold a heading and most of the page."""
    by_kind = [t in DROPPED for t in page.tags]
    around = [a or b for a, b in zip(by_kind, skip, strict=True)]
    held = _sums(page.parents, chars, around)
    headings = _sums(page.parents, [int(t in HEADINGS) for t in page.tags], around)
    out = list(by_kind)
    for i in range(1, len(out)):
        if not out[i]:
            named = bool(page.attributes[i]) and _noise_attributes(page.tags[i], page.attributes[i])[1]
            header = page.tags[i] == "header" and (page.parents[i] <= body or not headings[i])
            out[i] = (named or header) and not (headings[i] and held[i] > MOST_NOISE * held[body])
    out[body] = out[0] = False
    return out


def densities(page: Page, chars: list[int], body: int, skip: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Of every element its composite density and the sum of the densities of the blocks under it, with its characters and
    link characters.

    With c characters, l of them in links, t tags, u of them links, and L of C in the body: c/t * log(c/l * t/u) in base
    ln(c/(c - l) * l + L/C * c + e). 1 is added to the logarithm of the base, which is 0 on a page without links. Inline elements
    count as tags, but the blocks of their block are those that are summed, so that a paragraph of many links or bold words
    doesn't outweigh the article it is part of.
    """
    n, tags, parents = len(page.tags), page.tags, page.parents
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tags[i] == "a" or in_link[parents[i]]
    c, lc = _sums(parents, chars, skip), _sums(parents, [x if a else 0 for x, a in zip(chars, in_link, strict=True)], skip)
    t, lt = _sums(parents, [1] * n, skip), _sums(parents, [int(x == "a") for x in tags], skip)
    ratio = lc[body] / max(c[body], 1)
    density, total, block = [0.0] * n, [0.0] * n, list(range(n))
    for i in range(n):
        if i and tags[i] in INLINE:
            block[i] = block[parents[i]]
        if c[i] and not skip[i]:
            inner, links = max(t[i] - 1, 1), max(lt[i] - (tags[i] == "a"), 1)
            base = math.log(c[i] / max(c[i] - lc[i], 1) * lc[i] + ratio * c[i] + math.e)
            density[i] = c[i] / inner * max(math.log(c[i] / max(lc[i], 1) * inner / links), 0.0) / (1.0 + math.log(base))
            if i and tags[i] not in INLINE:
                total[block[parents[i]]] += density[i]
    return density, total, c, lc


def choose(page: Page, body: int, skip: list[bool], density: list[float], total: list[float], c: list[int], lc: list[int], noisy: list[bool] | None = None) -> list[bool]:
    """The elements whose own text belongs to the article.

    The element of the largest sum leads; only if it is noise by its own word (`noisy`), or stands right in such an element, does the next one. The threshold is the least density on its way up to the body. It climbs towards
    the body as far as there are neighbours of at least that density, of prose mostly outside links, that hold a heading or a fair
    share of its text. What it climbed through gives its own text, its prose that isn't mostly links, and its containers of prose
    above the threshold.
    """
    tags, parents, n = page.tags, page.parents, len(page.tags)
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parents[i]] and not skip[i]
    rank = [i for i in range(n) if inside[i] and c[i] and tags[i] not in INLINE]
    if not rank:
        return [False] * n
    noisy = noisy or [False] * n
    loud = [x and tags[i] != "form" for i, x in enumerate(noisy)]
    for i in range(body + 1, n):
        loud[i] = loud[i] or loud[parents[i]]
    best = max((i for i in rank if not loud[i]), key=lambda i: (total[i], -i), default=body)
    way = [best]
    while way[-1] != body:
        way.append(parents[way[-1]])
    threshold = min(density[i] for i in way)
    wordy = lambda i: 2 * lc[i] <= c[i]
    headings, prose = (_sums(parents, [int(t in kind) for t in tags], skip) for kind in (HEADINGS, PROSE))
    beside: dict[int, list[int]] = {i: [] for i in way}
    on_way = set(way)
    for i in rank:
        if i not in on_way and parents[i] in beside:
            beside[parents[i]].append(i)
    top = 0
    for k in range(1, len(way)):
        if any(density[i] >= threshold and wordy(i) and prose[i] and (headings[i] or c[i] >= SISTER * c[best]) for i in beside[way[k]]):
            top = k
    through = set(way[1 : top + 1])
    chosen = [False] * n
    for i in range(body, n):
        if not inside[i]:
            continue
        if i == best or i in through:
            chosen[i] = True
        elif i != body and chosen[parents[i]]:
            chosen[i] = not noisy[i] and (parents[i] not in through or wordy(i) and (tags[i] in PROSE or tags[i] in INLINE or prose[i] > 0 and density[i] >= threshold))
    return chosen


def extract(html: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages. A text without tags is all of the page."""
    if not html:
        return ""
    page = parse(html)
    chars = [0] * len(page.tags)
    for node, text in page.events:
        if text is not None:
            chars[node] += len("".join(text.split()))
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    skip = unseen(page)
    chosen = choose(page, body, skip, *densities(page, chars, body, skip), noise(page, chars, body, skip))
    return " ".join("".join(" " if text is None else text for node, text in page.events if text is None or chosen[node]).split())


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of `pages` with text and n_chars (code points) in place of its html. Rows are independent of each other; each
    page is read whole. A column of the name text or n_chars is replaced."""
    rest = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(html)]
            columns = [batch.column(f.name) for f in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in rest), "text", "n_chars"])

    return pages.select(*[f"`{f.name}`" for f in rest], f"`{html}`").mapInArrow(run, schema)
