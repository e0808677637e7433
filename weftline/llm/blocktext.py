"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element's text. Where markup stood,
empty lines stay: one where boxes (div, list, table) begin or end, however deep they nest,
and ``window`` of them where a sectioning element (article, main, nav, aside, header, footer)
or a part named as noise does. A line's weight is its length without link text; lines of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role,
class or id) weigh nothing. Scripts, styles and other code are markup.

Sums of weights over sliding windows of ``window`` lines give the distribution. It dives
where a sum is zero, and surges where a sum reaches 1 / ``part`` of the page's highest. A
stretch between two dives is text if it surges anywhere, and is kept whole, with the
linked lines right beside it. An <article> or <main> that surges anywhere is kept whole
but for its noise, also where it dives; on a page without unlinked text every one is.

Character references are decoded, white space in a line becomes one space, lines are
trimmed and joined by an empty line. Null and empty pages, and pages without such text,
give the empty string. Unclosed elements end with the element around them; an inline element
named as noise is left out with all that it holds, and counts for nothing if the page never closes one of its name. Rows are judged
one by one: null and repeated ids change nothing, columns named text or n_chars are
replaced, and an empty table gives an empty table. A page is held whole in its task, as are its lines; the time it
takes is in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
#: A sum surges from this part of the page's highest on.
PART = 5

# Names of HTML elements and common class names.
_RAW = frozenset("script style template noscript iframe svg math object canvas video audio title textarea xmp noembed noframes".split())
#: Of these, those whose content is text up to their end tag, or to the end of the page.
_TO_END = frozenset("script style noscript iframe title textarea xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("head nav footer aside form menu dialog select button fieldset datalist header".split())
_WIDE = frozenset("article main nav aside header footer".split())
_BOX = frozenset("div section ul ol dl table form fieldset blockquote center details figure".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: What the noise is called in classes and ids: menus, headers, footers, sidebars, notices, adverts, forms, comments.
_NOISE = frozenset(
    "nav navbar navigation menu menubar topnav sidenav breadcrumb breadcrumbs pagination header masthead footer sidebar aside notice notices cookie cookies consent gdpr ad ads advert adverts advertisement adsense adbox sponsored form newsletter subscribe comment comments commentlist disqus replies respond".split()
)
#: Words that say where or in what the noise is, and not what else a block is about: ad-box is an advert, ad-hoc is not.
_PLACE = frozenset("area bar block bottom bottombar box col container content inner item items left link links list main outer primary right row secondary section slot thread top topbar unit widget widgets wrap wrapper".split())
#: Words that say what a wrapper has, and not what it is.
_ABOUT = frozenset("has with no".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th"}
_SAME = {k: frozenset(v.split()) for k, v in _SAME.items()}
_SCOPE = frozenset("ul ol dl table article main section div body html td th blockquote".split())

_TAG = re.compile(r"""<(?:!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z))""")
_MARKS = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+(?:[A-Z]+(?![a-z]))?|[A-Z]+[a-z0-9]*")


def _named(token: str) -> bool:
    """Whether a class or id names noise: as a whole, by its last word, or by its first with words of place."""
    parts = [x.lower().rstrip("0123456789") for x in _WORDS.findall(token)]
    if token.lower() in _NOISE:
        return True
    if not parts or _ABOUT.intersection(parts[:-1]):
        return False
    return parts[-1] in _NOISE or parts[0] in _NOISE and all(not x or x in _PLACE for x in parts[1:])


def _is_noise(attributes: str, in_article: bool = False) -> bool:
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role" and value.strip().lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and any(_named(token) and not (in_article and "header" in token.lower()) for token in value.split()):
            return True
    return False


class _Lines:
    """Lines of a page as they are found: (text, weight, number of the article around it or 0)."""

    def __init__(self, window: int):
        self.window, self.found = window, []
        self.open: list[str] = []
        self.inside: Counter[str] = Counter()
        #: Depth + 1 of the outermost noise and article, 0 outside; articles so far.
        self.noise_at = self.article_at = self.articles = 0
        self.text: list[str] = []
        self.links = self.in_link = 0
        #: The inline noise around this place: its name, how many elements of that name are open in it, and the depth of blocks around it.
        self.muted, self.muted_open, self.muted_depth = "", 0, 0

    def add(self, piece: str) -> None:
        if self.muted:
            return
        self.text.append(piece)
        if self.in_link:
            self.links += len(" ".join(unescape(piece).split()))

    def end_line(self) -> None:
        if self.text:
            line = " ".join(unescape("".join(self.text)).split())
            if line:
                self.found.append((line, 0 if self.noise_at else max(len(line) - self.links, 0), self.articles if self.article_at and not self.noise_at else 0))
            self.text.clear()
        self.links = 0

    def blank(self, name: str, wide: bool = False) -> None:
        """The empty lines that a boundary of the element leaves, with those of boundaries right before it."""
        wanted = self.window if wide or name in _WIDE else int(name in _BOX)
        there = next((i for i, (line, _, _) in enumerate(reversed(self.found[-wanted:])) if line), min(wanted, len(self.found))) if wanted else 0
        self.found += [("", 0, 0)] * (wanted - there)

    def pop_to(self, depth: int) -> None:
        for at in range(len(self.open) - 1, depth - 1, -1):
            name = self.open.pop()
            self.inside[name] -= 1
            self.blank(name, self.noise_at == at + 1)
            if self.noise_at == at + 1:
                self.noise_at = 0
            if self.article_at == at + 1:
                self.article_at = 0
        if len(self.open) < self.muted_depth:
            self.muted, self.muted_depth = "", 0

    def mute(self, name: str) -> None:
        self.muted, self.muted_open, self.muted_depth = name, 1, len(self.open)

    def last(self, name: str) -> int:
        return len(self.open) - 1 - self.open[::-1].index(name)

    def end_tag(self, name: str) -> None:
        if name == self.muted:
            self.muted_open -= 1
            self.muted = name if self.muted_open else ""
        if name == "a":
            self.in_link = 0
        elif name == "p":
            self.end_line()
        elif name == "br":
            self.text.append(" ")
        if name not in _INLINE and self.inside[name] > 0:
            self.end_line()
            self.pop_to(self.last(name))

    def start_tag(self, name: str, attributes: str) -> None:
        """A block element."""
        self.end_line()
        self.in_link = 0
        if name == "body" and self.inside["head"] > 0:
            self.pop_to(self.open.index("head"))
        if name in _P_CLOSERS and self.inside["p"] > 0:
            self.pop_to(self.last("p"))
        if name in _SAME:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth] in _SAME[name]:
                    self.pop_to(depth)
                    break
                if self.open[depth] in _SCOPE and not (name in ("tr", "td", "th", "thead", "tbody", "tfoot") and self.open[depth] != "table"):
                    break
        if attributes.endswith("/") and name not in _P_CLOSERS:
            return
        noise = False
        if not self.noise_at and name not in ("html", "body", "article", "main"):
            noise = name in _SKIP and not (name == "header" and self.article_at) or bool(attributes) and _is_noise(attributes, self.article_at > 0)
        self.blank(name, noise)
        self.open.append(name)
        self.inside[name] += 1
        if noise:
            self.noise_at = len(self.open)
        if name in ("article", "main") and not self.article_at and not self.noise_at:
            self.article_at = len(self.open)
            self.articles += 1


def lines(html: str, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """(text, weight, number of its article or 0) of each line, with the empty lines that markup leaves. Noise has no weight and no article."""
    page, at = _Lines(window), 0
    unclosed: set[str] = set()  # without an end tag in the rest of the page
    ends: dict[str, int] = {}

    def last_end(name: str) -> int:
        """Where the page's last end tag of an inline element begins; each name is looked for once."""
        if name not in ends:
            ends[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", html, re.I)), default=-1)
        return ends[name]

    while at < len(html):
        m = _TAG.search(html, at)
        if piece := html[at : m.start()] if m else html[at:]:
            page.add(piece)
        if not m:
            break
        at, name, attributes = m.end(), (m[2] or "").lower(), m[3]
        if not name:
            continue
        if m[1]:
            page.end_tag(name)
        elif name in _RAW:
            if name in ("svg", "math") and attributes.endswith("/") or name in unclosed:
                continue
            closed = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if closed or name in _TO_END:
                at = closed.end() if closed else len(html)
            else:
                unclosed.add(name)
        elif name in _VOID:
            if name == "hr":
                page.end_line()
            elif name != "wbr":
                page.text.append(" ")
        elif name == "a":
            page.in_link = 1
        elif name in _INLINE:
            if page.muted:
                page.muted_open += name == page.muted
            elif not page.noise_at and attributes and _is_noise(attributes, page.article_at > 0) and at <= last_end(name):
                page.mute(name)
        else:
            page.start_tag(name, attributes)
    page.end_line()
    return page.found


def between(found: Sequence[tuple[str, int, int]], window: int = WINDOW, part: int = PART) -> np.ndarray:
    """Whether each line lies between a surge and a dive of the distribution."""
    n = len(found)
    weight = np.array([w for _, w, _ in found], np.int64)
    article = np.array([a for _, _, a in found], np.int64)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    # sums[i] covers lines i - window + 1 to i.
    sums = np.convolve(weight, np.ones(window, np.int64))
    least = -(-int(sums.max()) // part)
    high = np.zeros(n, bool)  # lines that a surging window covers
    for back in range(window):
        high |= sums[back : back + n] >= max(1, least)
    change = np.diff(np.concatenate(([0], (sums > 0).astype(np.int8), [0])))
    for first, end in zip(np.flatnonzero(change > 0), np.flatnonzero(change < 0), strict=True):
        last = end - window  # the last line of any weight before the dive
        if high[first : last + 1].any():
            low, top = first, last
            while low > max(0, first - window + 1) and found[low - 1][0]:
                low -= 1
            while top < min(n - 1, last + window - 1) and found[top + 1][0]:
                top += 1
            keep[low : top + 1] = True
    surged = np.unique(article[high & (weight > 0)]) if least else np.unique(article)
    return keep | (article > 0) & np.isin(article, surged)


def extract(html: str | None, window: int = WINDOW, part: int = PART) -> str:
    """The main text of a page."""
    found = lines(html or "", window)
    return "\n\n".join(line for (line, _, _), k in zip(found, between(found, window, part), strict=True) if k and line)


def main_text(df: DataFrame, html: str = "html", window: int = WINDOW, part: int = PART) -> DataFrame:
    """``df`` with text and n_chars in place of its html; columns of these names are replaced."""
    rest = [f for f in df.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py(), window, part) for x in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
