"""Main-text extraction from HTML by tree scoring.

A forgiving parser turns a page into a tree of elements and text blocks (an own one, as no parser library with repair
rules is at hand). Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut out by element, role and class words. Each remaining paragraph then passes points for its length and
commas to its parent, half to the grandparent, a third to the next; an element's points are discounted by its link
density. The best element (its enclosing article, if any) and siblings that score well or read like prose are kept.

Defined results: null or empty html, and pages without text, give an empty text. When no paragraph earns points, all
blocks that were not cut out are the text. Ties go to the element that comes first. Unclosed and stray tags follow the
usual repair rules; pages of any length are read whole, in time linear in their length. Repeated rows get equal
results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm.runtime import table

# Element names by role, as HTML defines them, and the class words of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("ul ol dl table td th article section main body html aside nav form blockquote".split())
CUT_TAGS = frozenset("nav footer aside form button select option dialog menu object canvas audio video map datalist head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
CUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disclaimer|disqus|footer|gdpr|"
    r"hidden|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|pager|pagination|popup|promo|promoted|recommended|related|replies|reply|respond|"
    r"share|sharing|sidebar|sidebars|signup|skyscraper|social|sponsor|sponsored|subscribe|taboola|toolbar|topbar|tracking|widget)(?:$|[\s_-]|\d)",
    re.I,
)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)
KEEP_TAGS = frozenset("html body main article".split())
PROSE = frozenset("p pre blockquote td li dd div section article main body".split())
TAG_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}

TOKEN = re.compile(r"""<(?:!--[\s\S]*?(?:-->|$)|([/!?]?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+|[^>]*+)>|[!?/][^>]*+>)""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
BLANK = re.compile(r"\s+")
LEAST, COMMAS = 25, re.compile("[,，、،]")


class Page:
    """Elements in page order (parents before children) and text blocks, each with its element and its link length."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.block_parent = [-1]  # the nearest element around that is not inline
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source)

    def _attributes(self, raw: str) -> dict[str, str]:
        return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}

    def _cut(self, tag: str, raw: str, inside: bool) -> bool:
        if tag in CUT_TAGS:
            return True
        if tag == "header" and not inside:
            return True
        if not raw or raw.isspace() or tag in KEEP_TAGS:
            return False
        a = self._attributes(raw)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
            return True
        if a.get("role", "").lower() in CUT_ROLES:
            return True
        names = f"{a.get('class', '')} {a.get('id', '')}"
        return bool(CUT_WORDS.search(names) or not inside and HEADER_WORDS.search(names))

    def _parse(self, source: str) -> None:
        tag_of, stack, homes = self.tag, [0], [0]  # open elements, and for each the innermost block element
        places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
        text: list[str] = []
        linked, links, home = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if text:
                value = " ".join(entities.unescape("".join(text)).split())
                if value and not self.cut[home]:
                    self.blocks.append((home, value, min(linked, len(value))))
                text.clear()
            linked = 0

        def add(part: str) -> None:
            nonlocal linked
            text.append(part)
            if links:
                linked += len(part.strip())

        def close(upto: int) -> None:
            """Pop the stack down to position ``upto``, included."""
            nonlocal home, links
            gone = [tag_of[i] for i in stack[upto:]]
            if block := any(t not in INLINE for t in gone):
                flush()
            for t in gone:
                places[t].pop()
                links -= t == "a"
            del stack[upto:], homes[upto:]
            if block:
                home = homes[-1]

        def push(tag: str, cut: bool) -> None:
            tag_of.append(tag)
            self.parent.append(stack[-1])
            self.block_parent.append(homes[-1])
            self.cut.append(cut)
            places[tag].append(len(stack))
            stack.append(len(tag_of) - 1)
            homes.append(homes[-1] if tag in INLINE and not cut else stack[-1])

        def last(names) -> int:
            return max([places[t][-1] for t in names if places.get(t)], default=0)

        def open_at(names: tuple[str, ...], walls: frozenset[str]) -> int:
            """Stack position of the innermost of these, unless a wall stands in between; 0: none."""
            found = last(names)
            return found if found and found >= last(walls) else 0

        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            kind, name = m[1], m[2]
            if name is None or kind in ("!", "?"):
                continue
            tag = name.lower()
            if kind == "/":
                walls = WALLS if tag in INLINE or tag in ("p", "li") else frozenset()
                if found := open_at((tag,), walls - {tag}):
                    close(found)
                continue
            if tag in CLOSES_P and (found := open_at(("p",), WALLS)):
                close(found)
            if tag in SAME and (found := open_at(SAME[tag], frozenset(("ul", "ol", "dl", "table", "select")))):
                close(found)
            if tag == "a" and (found := open_at(("a",), WALLS)):
                close(found)
            if tag == "br":
                add(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                    at = end.end() if end else size
                if tag not in INLINE:
                    add(" ")
                continue
            cut = self.cut[stack[-1]] or self._cut(tag, m[3], bool(places.get("article") or places.get("main")))
            links += tag == "a"
            if tag in INLINE and not cut:
                push(tag, False)
                continue
            flush()
            push(tag, cut)
            home = homes[-1]
        flush()

    def main_text(self) -> list[str]:
        """The kept blocks, in page order."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, links, points = [0] * n, [0] * n, [0.0] * n
        for home, text, linked in self.blocks:
            chars[home] += len(text)
            links[home] += linked
            if len(text) >= LEAST and (tag[home] in PROSE or tag[home] == "#root"):
                earned = 1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)
                # Text right in a container counts for the container, a paragraph's for those around it.
                up = home if tag[home] not in ("p", "pre", "blockquote", "li", "td", "dd") else self.block_parent[home]
                for share in (1, 2, 3):
                    if up < 0:
                        break
                    points[up] += earned / share
                    up = self.block_parent[up]
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            links[parent[i]] += links[i]
        density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
        final = [(points[i] + TAG_POINTS.get(tag[i], 0)) * (1 - density[i]) if points[i] > 0 else 0.0 for i in range(n)]
        best = max(range(n), key=final.__getitem__)
        if not final[best] > 0:
            return [text for _, text, _ in self.blocks]
        top = final[best]
        up = best
        while up > 0:  # a part of an article stands for the article
            up = parent[up]
            if up > 0 and tag[up] in ("article", "main"):
                best = up
                break
        kept = {best}
        if best > 0:
            own = {home: (text, linked) for home, text, linked in self.blocks}
            for i in range(1, n):
                if parent[i] != parent[best] or i == best or self.cut[i] or not chars[i]:
                    continue
                prose = tag[i] == "p" and (chars[i] > 80 and density[i] < 0.25 or not links[i] and i in own and re.search(r"[.!?。…](?:\s|$)", own[i][0]))
                if final[i] >= max(10.0, 0.2 * top) or prose or tag[i] in ("h1", "h2") and density[i] < 0.25:
                    kept.add(i)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in kept or i > 0 and inside[parent[i]]
        return [text for home, text, _ in self.blocks if inside[home]]


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).main_text()) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> page_id, url, text, n_chars."""
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
SQL: dict[str, str] = {}
