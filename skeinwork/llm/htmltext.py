"""Main text of web pages by consensus paths of their hosts.

1. Each page is parsed once and its containers scored: text counts in full for the element that holds
   its block, by half for the next one up and so on; links count against it. The page votes for the
   generalised path (tags with classes, digits struck; of deep ones the depth and the last DEPTH labels) of its best container.
2. Votes are summed by host and path in Spark; each host's path with the most votes wins.
3. Pages are read again: the text of the containers on the winning path is the page's; a page without
   one uses its own best container, so no page is lost for being unlike its host.

What is never text: scripts, styles, forms, navigation, headers, footers, asides and the like, elements
with such a role, hidden elements, comments of the markup. A class or id that names a menu, banner, notice, advert,
share bar, comment section or so on makes an element suspect: its text is left out, unless it outweighs by WEIGHT all
unlinked text of the page that is not suspect; a comment section never does. A name counts by its head, the last
word but for words like box or list: `related-posts` and `acme-sidebar` do, `has-sidebar` and `social-content` do not. An article
or main element is suspect only for a name of comments or adverts. Names that may also be an article's own, like review or message, are
suspect too, but like all others they are kept where they hold nearly all of the page.

Cases: null or empty html: empty text; a page without any markup: its text; broken markup (open
elements, stray ends, a cut off last tag): as far as it goes; null url: host empty, voting with its
like; ties of votes: higher total score, then the path's order; repeated rows: each by itself; an empty
table: an empty result; other columns are ignored, whatever their names. Pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import maybe_broadcast, stage
from skeinwork.llm.urls import host_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is markup or code up to their end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select textarea input option svg math iframe object canvas audio video dialog menu".split()
)
_BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address"
    " details summary fieldset hgroup center hr nav header footer aside form".split()
)
_CONTAINERS = frozenset("body main article section div td blockquote".split())
#: A start tag of the key ends open elements of the values, up to the nearest container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion discussions kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Names of what readers say that an article can have as well.
_VOICES = frozenset(
    "review reviews feedback response responses discourse commentary commentaries conversation conversations message messages thread threads reaction reactions opinion opinions"
    " testimonial testimonials guestbook talkback ratings bewertung bewertungen antworten avis opiniones respuestas".split()
)
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended".split())
_BAD_NAMES = _COMMENTS | _VOICES | _ADVERTS | frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar side aside rail banner"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social"
    " breadcrumb breadcrumbs pagination pager widget toolbar login search skip hidden".split()
)
#: Words behind a name's head, words that are the head where they stand in front, and words in front that make a name a state.
_TRAILING = frozenset(
    "box bar list wrapper wrap container section area block item items inner outer slot unit link links posts form icons buttons button thread trail this message text title"
    " top bottom left right main primary secondary global mobile desktop sticky fixed small large".split()
)
_LEADING = frozenset("related recommended sponsored cookie cookies gdpr consent newsletter skip ad ads advert comment comments".split())
_STATES = frozenset("has with without no not is layout".split())
#: A suspect element is kept if its unlinked text is so many times that of all that is not suspect.
WEIGHT = 4
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_BREAKS = frozenset({"br"})


#: Labels of a path that are told apart.
DEPTH = 32


@dataclass
class _Node:
    tag: str
    path: int  # place in the page's tree of labels
    dropped: bool
    container: int  # place of the nearest container, itself included
    region: int  # place of the nearest suspect element, itself included; 0 if there is none


@dataclass
class Page:
    """blocks: (container, text) in page order; containers: place of the path in the tree, place of the one above, score."""

    #: generalised paths: the one above, its depth and the last label
    tree: list[tuple[int, int, str]] = field(default_factory=lambda: [(-1, 0, "")])
    paths: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [-1])
    scores: list[float] = field(default_factory=lambda: [0.0])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: while the page is read: (region, unlinked characters) of each block; of each region the one around it and whether it may be kept
    weights: list[tuple[int, float]] = field(default_factory=list)
    regions: list[tuple[int, bool]] = field(default_factory=lambda: [(-1, True)])

    def path(self, container: int) -> str:
        """The generalised path of a container."""
        at, labels = self.paths[container], []
        depth = self.tree[at][1]
        while at >= 0 and len(labels) < DEPTH:
            labels.append(self.tree[at][2])
            at = self.tree[at][0]
        return "/".join([*[str(depth)] * (at >= 0), *reversed(labels)])

    def settle(self) -> None:
        """Leave out the suspect elements that do not outweigh the rest, and score the containers."""
        own = [0.0] * len(self.regions)
        for r, n in self.weights:
            own[r] += n
        kept = [True] * len(self.regions)
        for r, (around, may) in enumerate(self.regions[1:], 1):
            kept[r] = kept[around] and may and own[r] > WEIGHT * own[0]
        held = [(b, n) for b, (r, n) in zip(self.blocks, self.weights) if kept[r]]
        self.blocks = [b for b, _ in held]
        for (c, _), gain in held:
            share = 1.0
            while c >= 0 and share > 0.01:
                self.scores[c] += gain * share
                share /= 2
                c = self.above[c]
        for i, p in enumerate(self.paths):  # elements named for the purpose
            if self.tree[p][2].split(".")[0] in ("article", "main"):
                self.scores[i] *= 2.5

    def best(self) -> int:
        return max(range(len(self.scores)), key=lambda i: (self.scores[i], -i))

    def text_of(self, wanted: set[int]) -> str:
        inside = [False] * len(self.paths)
        for i, up in enumerate(self.above):
            inside[i] = i in wanted or (up >= 0 and inside[up])
        return " ".join(t for c, t in self.blocks if inside[c])

    def text(self, path: str | None) -> str:
        """Text of the containers on the path, or of the best one if there is none with text."""
        last = (path or "").rsplit("/", 1)[-1]
        found = {i for i, p in enumerate(self.paths) if path is not None and self.tree[p][2] == last and self.path(i) == path}
        return (self.text_of(found) if found else "") or self.text_of({self.best()})


def _label(tag: str, attrs: dict[str, str]) -> str:
    names = sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *filter(None, names)]).replace("/", ":")


def _unwanted(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _DROPPED:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _BAD_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower()


@functools.lru_cache(1 << 16)
def _head(name: str) -> str:
    """The word of a class or id that tells what it is, if it is one of _BAD_NAMES; else empty."""
    words = [w for w in re.split(r"[\W_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or words[0] in _STATES:
        return ""
    if words[0] in _LEADING:
        return words[0]
    while len(words) > 1 and (words[-1] in _TRAILING or len(words[-1]) == 1):
        words.pop()
    return words[-1] if words[-1] in _BAD_NAMES else ""


def _suspect(tag: str, attrs: dict[str, str]) -> str:
    """The bad name of an element, if it has one."""
    if not attrs or tag in ("html", "body"):
        return ""
    heads = {h for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if (h := _head(n))}
    if tag in ("article", "main"):
        heads &= _COMMENTS | _ADVERTS
    return min(heads & _COMMENTS or heads, default="")


def parse(source: str) -> Page:
    """Read a page once, front to end, with a stack of open elements."""
    page = Page()
    stack = [_Node("", 0, False, 0, 0)]
    opened: Counter[str] = Counter()  # tags on the stack
    known: dict[tuple[int, str], int] = {}
    text: list[str] = []  # of the open block
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        got = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if got:
            page.blocks.append((stack[-1].container, got))
            page.weights.append((stack[-1].region, max(len(got) - 2.0 * linked, 0.0)))
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        flush()
        links -= sum(n.tag == "a" for n in stack[to:])
        opened.subtract(n.tag for n in stack[to:])
        del stack[to:]

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at and not stack[-1].dropped:
            piece = source[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not stack[-1].dropped:
                text.append(entities.escape(m[0][9:-3]))
            continue
        if not m[0].endswith(">"):
            break  # a tag cut off by the end of the page
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if opened[tag] > 0 else 0
            if k:
                if tag == "a" and stack[k].region == stack[k - 1].region and stack[k].dropped == stack[k - 1].dropped:
                    links -= 1
                    opened[tag] -= 1
                    del stack[k]
                else:
                    close(k)
            elif tag in _BLOCKS:
                flush()
            continue
        raw_attrs = m[3] or m[6] or ""
        if tag in _BREAKS and not stack[-1].dropped:
            text.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(raw_attrs)} if raw_attrs else {}
        dropped = stack[-1].dropped or _unwanted(tag, attrs)
        name = _suspect(tag, attrs)
        if tag in _BLOCKS or name or dropped and not stack[-1].dropped:
            flush()
            if tag in _BLOCKS:  # a block ends an open paragraph, an item its neighbour
                ends = (*_CLOSES.get(tag, ()), "p")
                for k in range(len(stack) - 1, 0, -1) if any(opened[e] > 0 for e in ends) else ():
                    if stack[k].tag in ends:
                        close(k)
                        break
                    if stack[k].tag in _CONTAINERS or stack[k].tag in ("ul", "ol", "table", "dl"):
                        break
                dropped = stack[-1].dropped or _unwanted(tag, attrs)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in _BLOCKS or dropped or name or tag == "a":
            up = stack[-1]
            node = _Node(tag, up.path, dropped, up.container, up.region)
            if name and not dropped:
                page.regions.append((up.region, name not in _COMMENTS))
                node.region = len(page.regions) - 1
            if tag in _BLOCKS:
                step = up.path, _label(tag, attrs)
                if step not in known:
                    known[step] = len(page.tree)
                    page.tree.append((up.path, page.tree[up.path][1] + 1, step[1]))
                node.path = known[step]
            if tag in _CONTAINERS and not dropped:
                page.paths.append(node.path)
                page.above.append(up.container)
                page.scores.append(0.0)
                node.container = len(page.paths) - 1
            links += tag == "a"
            opened[tag] += 1
            stack.append(node)
    else:
        if at < len(source) and not stack[-1].dropped:
            text.append(source[at:])
    flush()
    page.settle()
    return page


def _votes(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, scores = [], []
            for t in b.column(1):
                page = parse(t.as_py())
                k = page.best()
                paths.append(page.path(k))
                scores.append(page.scores[k])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return df.select("host", "html").mapInArrow(run, "host string, path string, score double")


def host_paths(df: DataFrame) -> DataFrame:
    """host and winning path of pages with columns host and html."""
    votes = _votes(df).filter("score > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score")).alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, path, text of every row."""
    rows = df.select(F.col(key).alias(key), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    winners = stage(host_paths(rows), "html-paths")
    pages = rows.join(maybe_broadcast(winners, 256), "host", "left").select(key, "url", "path", "html")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [parse(h.as_py()).text(p.as_py()) for p, h in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string())], names=[key, "url", "path", "text"])

    return pages.mapInArrow(run, f"`{key}` {kind}, url string, path string, text string")
