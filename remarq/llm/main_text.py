"""Operator 2: main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines: the text between two block-level tags. A line's
text-to-tag ratio is its characters outside links over its tags. A Gaussian kernel smooths the ratios along the page, and lines
above a threshold (the mean of the smoothed ratios, two-means refined) form the content cluster. The region of the page that
holds most of that cluster's text, by nesting of the page's containers, is the article. In it the cluster decides line by line: its lines are the
text, and of the others those that stay are no links, and stand in the region itself, in a part of it that the cluster has most of, or in an article
element. Lines of the cluster's kind that stand beside the region are part of the text too, unless they are a small part of a page-wide container.

A second signal is what elements and names say: lines inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, known by element or by their class, id and role, never count; a name alone
(or a form) does not condemn an element that wraps most of the content cluster.

Defined cases: a null or empty page, or one without text, gives an empty text; broken nesting is closed as
browsers do; a very long page is one list of lines in the task that reads it; equal ratios are on the same side of the threshold, and
where all are equal every line is content; repeated rows stay repeated; empty tables give empty results; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import column

#: Width of the Gaussian kernel, in lines.
SIGMA = 1.5
#: Shares of the content cluster's median line from which a line beyond the region counts: of the cluster, and not of it.
LONG, NEARLY = 0.25, 0.5
#: Share of a line's text in links from which it is a link; share of the content that a part of a page-wide container holds if it is more than a notice.
LINKED, MORE = 0.5, 0.2
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is no part of the page's prose.
SILENT = frozenset("script style noscript template title textarea select option button svg math iframe object canvas audio video head".split())
#: Elements that may stand in a head; any other ends it, as words do.
IN_HEAD = frozenset("base link meta title style script noscript template head html basefont bgsound noframes".split())
#: Elements around the prose.
AROUND = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where one of their kind begins.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names in class, id or role of what stands around the prose.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|recommended|"
    r"topbar|bottombar|rail|teasers?|outbrain|taboola|share|sharing|social|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|respond|replies|disqus|pagination|pager|toolbar|copyright|legal|complementary|contentinfo|search)(?=$|[\s_\d-])",
    re.I,
)
#: Names of the prose's own heading, which is part of it.
OWN = re.compile(r"\b(?:article|post|entry|story|content|main)[-_]+(?:header|heading|head|title)\b", re.I)
#: Names of a layout that speak of another part: "has-sidebar" is no sidebar.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[-_]\S+", re.I)
#: Classes that name the prose itself.
PROSE = re.compile(r"(?:^|\s)(?:(?:main|page|site|post|entry|article|story|blog)[-_]*)?(?:content|article|post|entry|story|main|body|text)(?=$|\s)", re.I)
#: Marks of what is no wrapper of a page, however much of it they hold, unless its heading or article is in there.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|outbrain|taboola|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent|popup|modal|newsletter|subscribe|login|signup|comments?|comment-?list|respond|replies|disqus|pagination|pager|related|recommended)(?=$|[\s_\d-])", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that are never taken for what stands around the prose, whatever their class.
WHOLE = frozenset(("html", "body", "main", "article"))
CONTAINERS = frozenset("html body main article section div form td center".split())


def marked(name: str) -> bool:
    """Whether a class, id or role says that an element stands around the prose; words may be joined by signs or by capitals."""
    return bool(name) and bool(MARKS.search(OWN.sub("", LAYOUT.sub("", HUMP.sub("-", name)))))


@dataclass
class Line:
    text: str
    tags: int
    path: tuple[int, ...]
    around: bool
    named: tuple[int, ...] = ()  # open elements that only their name, or being a form, puts around the prose
    linked: int = 0  # characters inside links


@dataclass
class _Open:
    tag: str
    id: int
    around: bool
    silent: bool
    named: bool


@dataclass
class _Lines(HTMLParser):
    """Parser events to lines."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.tags = 1
        self.n = 0
        self.articles: set[int] = set()
        self.roots: set[int] = set()
        self.names: dict[int, str] = {}
        self.heading: set[int] = set()

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(o.id for o in self.open if o.tag in CONTAINERS)
            linked = len(" ".join("".join(self.linked).split()))
            self.lines.append(Line(text, self.tags, path, any(o.around for o in self.open), tuple(o.id for o in self.open if o.named), linked))
            self.tags = 1
        self.parts, self.linked = [], []

    def _pop(self, i: int) -> None:
        if any(o.tag in BLOCKS or o.silent for o in self.open[i:]):
            self._line()
        del self.open[i:]

    def _end_head(self, always: bool = False) -> None:
        """Close an open head that something is about to leave; what stands in an element of the head stays there."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == "head":
                if always or i == len(self.open) - 1:
                    self._pop(i)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in BLOCKS:
            self._line()
        if tag in SIBLINGS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in SIBLINGS[tag]:
                    self._pop(i)
                    break
                if self.open[i].tag in CONTAINERS or self.open[i].tag in ("ul", "ol", "table"):
                    break
        elif tag in BLOCKS and tag != "br":
            for i in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph
                if self.open[i].tag == "p":
                    self._pop(i)
                    break
                if self.open[i].tag in CONTAINERS:
                    break
        if tag in VOID:
            return
        self.n += 1
        values = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        around = tag in AROUND and tag != "form"
        named = tag == "form"
        if values and tag not in WHOLE:
            named = named or any(marked(values.get(k, "")) for k in ("class", "id", "role"))
            around = around or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        if tag in ("header",) and any(o.tag == "article" for o in self.open):
            around = False
        if tag in ("article", "main", "h1"):
            self.heading.update(o.id for o in self.open if o.named)
        if named:
            self.names[self.n] = " ".join(HUMP.sub("-", values.get(k, "")) for k in ("class", "id", "role"))
        self.open.append(_Open(tag, self.n, around, tag in SILENT, named))
        if tag in ("article", "main"):
            self.articles.add(self.n)
        if tag in ("html", "body"):
            self.roots.add(self.n)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._pop(i)
                return
            if self.open[i].tag in WHOLE and tag not in WHOLE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not any(o.silent for o in self.open):
            self.parts.append(data)
            if any(o.tag == "a" for o in self.open):
                self.linked.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def end(self) -> None:
        self.close()
        self._line()


def lines(html: str | None) -> _Lines:
    """The page's lines, with what the parser knows of its elements."""
    parser = _Lines()
    parser.feed(html or "")
    parser.end()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; what lies beyond the ends does not count."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def threshold(logs: np.ndarray) -> float:
    """Between the means of low and high values, settled by a few rounds of two-means."""
    cut = logs.mean()
    for _ in range(20):
        low, high = logs[logs <= cut], logs[logs > cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return float(cut)


def ratios(found: list[Line]) -> np.ndarray:
    """Characters outside links over tags."""
    return np.array([max(0, len(x.text) - x.linked) / x.tags for x in found], float)


def cluster(found: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' sizes, and which of them form the content cluster."""
    logs = np.log1p(smoothed(ratios(found)))
    return np.array([len(x.text) for x in found], float), logs >= threshold(logs) - 1e-9


def wrappers(page: _Lines, found: list[Line]) -> set[int]:
    """Elements with the name of something around the prose that hold the prose: most of the content cluster lies in them, and
    they hold the page's heading or article, or are also named as the prose, or leave next to nothing for the rest of the page."""
    sizes, content = cluster(found)
    mass: dict[int, float] = {}
    for x, w in zip(found, np.where(content, sizes, 0.0).tolist(), strict=True):
        for c in x.named:
            mass[c] = mass.get(c, 0.0) + w
    total = float(sizes[content].sum())
    out = set()
    for c, m in mass.items():
        name = page.names[c]
        if m > 0.5 * total and (c in page.heading or PROSE.search(name) or m >= 0.8 * total and not NEVER.search(name)):
            out.add(c)
    return out


def outside(found: list[Line], region: int, sizes: np.ndarray, content: np.ndarray, wide: set[int]) -> set[int]:
    """Lines beyond the region that belong to the text: those of the content cluster, those nearly as long and free of tags as its median line, and
    where these make up most of what stands beside the region in a container, its other lines too. Short lines that only border on long ones are no part,
    and beside the region in a page-wide container only what holds a good share of the content is."""
    main = next(x.path[: x.path.index(region) + 1] for x in found if region in x.path)
    own = ratios(found)
    size, ratio = np.median(sizes[content]), np.median(own[content])
    good = (content & (sizes >= LONG * size)) | ((sizes >= NEARLY * size) & (own >= NEARLY * ratio))
    total = sizes[content].sum()
    beside: dict[tuple[int, int], list[int]] = {}
    out = set()
    for i, x in enumerate(found):
        if region in x.path:
            continue
        at = next((k for k, c in enumerate(x.path) if c not in main), None)
        if at is None:
            if good[i]:
                out.add(i)
        else:
            beside.setdefault((x.path[at - 1] if at else 0, x.path[at]), []).append(i)
    for (parent, _), some in beside.items():
        mass = sizes[[i for i in some if good[i]]].sum()
        if parent in wide and mass < MORE * total:
            continue
        out.update(some if mass >= 0.5 * sizes[some].sum() else [i for i in some if good[i]])
    return out


def within(found: list[Line], region: int | None, sizes: np.ndarray, content: np.ndarray, article: bool) -> list[int]:
    """The region's lines that belong to the text, in page order: the cluster decides, see the module."""
    inside = [i for i, x in enumerate(found) if region is None or region in x.path]
    parts: dict[int | None, list[int]] = {}
    part_of: dict[int, int | None] = {}
    for i in inside:
        path = found[i].path
        rest = path[path.index(region) + 1 :] if region is not None else ()
        part_of[i] = rest[0] if rest else None
        parts.setdefault(part_of[i], []).append(i)
    poor = {c for c, some in parts.items() if c is not None and sizes[[i for i in some if content[i]]].sum() < 0.5 * sizes[some].sum()}
    links = [found[i].linked >= LINKED * sizes[i] for i in inside]
    listed: set[int] = set()  # links one after another, most of them beyond the cluster: smoothing may have reached the first of them
    for link, run in groupby(zip(inside, links, strict=True), key=lambda x: x[1]):
        own = [i for i, _ in run]
        if link and 2 * sum(bool(content[i]) for i in own) < len(own):
            listed.update(own)
    return [i for i, link in zip(inside, links, strict=True) if i not in listed and (content[i] or (not link and (article or part_of[i] not in poor)))]


def main_text(html: str | None) -> str:
    page = lines(html)
    articles, roots = page.articles, page.roots
    # containers that hold parts around the prose, by element, by name or as links, besides the prose itself
    wide = {c for x in page.lines if x.around or x.named or x.linked >= LINKED * len(x.text) for c in x.path} | roots
    found = [x for x in page.lines if not x.around]
    if any(x.named for x in found):
        whole = wrappers(page, found)
        found = [x for x in found if whole.issuperset(x.named)]
    if not found:
        return ""
    sizes, content = cluster(found)
    weight = np.where(content, sizes, 0.0)
    mass: dict[int, float] = {}
    for x, w in zip(found, weight.tolist(), strict=True):
        for c in x.path:
            mass[c] = mass.get(c, 0.0) + w
    total = float(weight.sum())
    # an article element with half of the content is the region; else the innermost container with most of it
    own = [c for c in articles if mass.get(c, 0.0) >= 0.5 * total]
    if own:
        region = max(own)
    else:
        heavy = [c for c, m in mass.items() if m >= 0.7 * total]
        region = max(heavy, default=None)
    inside = within(found, region, sizes, content, bool(own))
    if region is None or region in roots:
        # where only the page as a whole holds the content, what precedes and follows the content lines is not part of it
        marked = [i for i in inside if content[i]]
        inside = [i for i in inside if marked and marked[0] <= i <= marked[-1]]
    else:
        inside = sorted({*inside, *outside(found, region, sizes, content, wide)})
    return " ".join(found[i].text for i in inside)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text, n_chars (code points) per page; one pass, no shuffle."""
    chosen = pages.select(*(column(c).alias(c) for c in keep), column(html).alias("body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", text string, n_chars long"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(v.as_py()) for v in part.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return chosen.mapInArrow(run, schema)
