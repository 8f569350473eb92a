"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; blocks between block-level tags are the
lines. Each line's ratio of text to tags is smoothed with a Gaussian kernel, and a
threshold (the standard deviation of the smoothed ratios) splits content lines from
the rest. The content lines select the regions: the articles that hold any, or else
the smallest element that holds all of them. All lines of these regions are returned
but for those in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu map datalist annotation annotation-xml".split())
#: Those that may stand within a block: their text is left out and does not split it.
MUTED = SKIPPED - BLOCKS
#: What an opening tag closes by itself, and up to which element.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that mark adverts, notices, forms, sharing and reader comments.
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus gdpr login modal newsletter outbrain overlay pager pagination popup promo promotion recommended related replies reply respond share sharing signup social sponsor sponsored subscribe subscription taboola".split())
#: Words that mark a page's frame. Headings, figures and other text elements are not
#: frames; parts of a name count outside article and main only (a "media-widget" is not a widget).
FRAMES = frozenset("banner contentinfo complementary footer header masthead menu nav navbar navigation notice notices notification sidebar toolbar widget".split())
TEXT_ELEMENTS = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 p pre table tbody td th thead tr".split())
#: In a name with one of these, "header" is that of the article.
ARTICLE_WORDS = frozenset("article content entry page post section story text".split())
#: An article element is marked by such first words of a name, as "comment-12", but not by "comments-open".
ARTICLE_MARKS = frozenset("ad advert comment promo related reply sponsored".split())


@lru_cache(4096)
def is_marked(tag: str, names: str, inside: bool) -> bool:
    """Does a class, id or role mark the element as none of the main text? inside: within article or main."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if tag == "article":
            if name in MARKS or (words and words[0] in ARTICLE_MARKS):
                return True
            continue
        if not MARKS.isdisjoint(words):
            return True
        if tag in TEXT_ELEMENTS or FRAMES.isdisjoint(words):
            continue
        if "header" in words and FRAMES.isdisjoint(w for w in words if w != "header") and (inside or not ARTICLE_WORDS.isdisjoint(words)):
            continue
        if not inside or name in FRAMES:
            return True
    return False


KERNEL = [math.exp(-(d * d) / 2) for d in range(-2, 3)]


class Lines(HTMLParser):
    """Collects (text, tags, path of open elements, skipped, marked elements) of every block with text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool, tuple[int, ...]]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number, skipped
        self.marked: list[int] = []  # open elements that a word of MARKS would skip
        self.kind: dict[int, str] = {}
        self.count = self.tags = self.skipping = self.muted = self.articles = 0
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.text else ""
        if text:
            self.lines.append((text, self.tags, tuple(x[1] for x in self.open if x[0] in BLOCKS), self.skipping > 0, tuple(self.marked)))
            self.tags = 0
        self.text = []

    def pop(self, to: int) -> None:
        """Close the elements from position to on."""
        for tag, number, skipped in self.open[to:]:
            self.skipping -= skipped
            self.muted -= tag in MUTED
            if self.marked and self.marked[-1] >= number:
                del self.marked[bisect_left(self.marked, number) :]
            self.articles -= tag in ("article", "main")
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if block:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self.pop(i)
                    break
                if self.open[i][0] in BLOCKS:
                    break
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in closed:
                    self.pop(i)
                    break
                if self.open[i][0] in within:
                    break
        skipped = tag in SKIPPED or (tag == "header" and not self.articles)
        marked = False
        if not skipped and attrs and tag not in ("html", "body", "main", "header"):
            for name, value in attrs:
                if tag != "article" and (name == "hidden" or (value and name == "aria-hidden" and value == "true")):
                    skipped = True
                    break
                if value and name in ("class", "id", "role"):
                    marked = marked or is_marked(tag, value, self.articles > 0)
        self.count += 1
        self.kind[self.count] = tag
        self.open.append((tag, self.count, skipped))
        self.skipping += skipped
        self.muted += tag in MUTED
        if marked and not skipped:
            self.marked.append(self.count)
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.text.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - 2), min(len(ratios), i + 3)
        weights = KERNEL[low - i + 2 : high - i + 2]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def content_lines(lines: list[tuple[str, int, tuple[int, ...], bool]]) -> list[int]:
    """Numbers of the lines whose smoothed ratio reaches the threshold."""
    ratio = smoothed([0.0 if skipped else len(text) / max(1, tags) for text, tags, _, skipped in lines])
    mean = sum(ratio) / len(ratio)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)))
    return [i for i, (line, r) in enumerate(zip(lines, ratio, strict=True)) if not line[3] and r >= threshold]


def wrappers(parser: Lines) -> set[int]:
    """Marked elements that hold most of the page's content lines and so are not menus, adverts or the like.

    Where an article or main element beside one has content lines, it stays marked.
    """
    lines = parser.lines
    content = content_lines([x[:4] for x in lines])
    total, found = sum(len(lines[i][0]) for i in content), set()
    for e in sorted({e for i in content for e in lines[i][4]}):
        inside = [i for i in content if e in lines[i][4]]
        if 2 * sum(len(lines[i][0]) for i in inside) <= total:
            continue
        around = {x for x in lines[inside[0]][2] if x < e}
        if not any(parser.kind[x] in ("article", "main") and x not in around for i in content if e not in lines[i][4] and found.issuperset(lines[i][4]) for x in lines[i][2]):
            found.add(e)
    return found


def main_text(html: str) -> str:
    """The main text of one page, its blocks joined by newlines; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    kept = wrappers(parser) if any(x[4] for x in parser.lines) else set()
    lines = [(text, tags, path, skipped or not kept.issuperset(marked)) for text, tags, path, skipped, marked in parser.lines]
    content = content_lines(lines)
    if not content:
        return ""
    mass: dict[int, int] = {}
    for i in content:
        for element in lines[i][2]:
            mass[element] = mass.get(element, 0) + len(lines[i][0])
    regions = {e for e in mass if parser.kind[e] in ("article", "main")}
    if not regions:
        total = sum(len(lines[i][0]) for i in content)
        whole = [e for e, m in mass.items() if m == total and parser.kind[e] not in ("p", "li", "h1", "h2", "h3")]
        regions = {max(whole)} if whole else set()
    return "\n".join(text for text, _, path, skipped in lines if not skipped and (not regions or not regions.isdisjoint(path)))


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None, drop_html: bool = True) -> DataFrame:
    """pages (all columns but the html, and all rows) with the main text and n_chars, its code points.

    A null or empty html and a page without text give an empty text. Malformed and
    truncated markup is read as far as it goes. Input columns named like an output are
    replaced; repeated rows give repeated results; an empty table an empty result.
    """
    require(pages, html)

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
        return {out: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return with_text_columns(pages, html, run, [(out, T.StringType()), ("n_chars", T.LongType())], keep, drop_html)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
