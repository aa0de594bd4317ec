"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf path of tags and classes. Per path, the text
length and the punctuation of its blocks are averaged, link text left out; both series
are smoothed over the page in block order, fused by their product, and averaged per path
again. Tags, roles and names that often mark boilerplate weigh a path's score down, but
an element that holds nearly all text of the page is its content, whatever its name.
Blocks of paths whose score reaches a share of the page's mean are the article; headings
and short blocks among them stay. Time is linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"""<(?:!--|[!?]|/?[a-zA-Z])""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[,.;:!?、。，；！？]")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none")

#: Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = set("script style noscript template svg canvas object embed iframe head button select option textarea input dialog menu map audio video title noembed noframes xmp".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: Tags, roles and words of names that are evidence against a path, and their weights.
TAGS = {"nav": 0.02, "aside": 0.02, "footer": 0.02, "form": 0.02, "fieldset": 0.02}
ROLES = {"navigation": 0.02, "complementary": 0.02, "contentinfo": 0.02, "banner": 0.02, "search": 0.02, "dialog": 0.02, "alert": 0.1}
READER = set("comment comments commentlist disqus reply replies".split())
NAMES = set("ad ads advert advertisement banner sponsor sponsored promo navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice popup modal newsletter subscribe share social related pagination".split())
READER_WEIGHT, NAME_WEIGHT, OUTSIDE_WEIGHT = 0.02, 0.1, 0.2

#: Where each tag is looked for when an element ends without its end tag: places of a scope.
_P, _LI, _DD, _SECTION, _ROW, _CELL = range(6)
_CLOSED = (-1,) * 6
_RESETS = {
    **{t: (_P,) for t in "article section div body html main aside nav header footer form blockquote".split()},
    **{t: (_P, _LI) for t in ("ul", "ol")}, "dl": (_P, _DD), "table": (_P, _LI, _DD, _SECTION, _ROW, _CELL), "li": (_P,), "dt": (_P,), "dd": (_P,),
    "thead": (_P, _ROW, _CELL), "tbody": (_P, _ROW, _CELL), "tfoot": (_P, _ROW, _CELL), "tr": (_P, _CELL), "td": (_P, _LI, _DD), "th": (_P, _LI, _DD),
}
_SETS = {"p": _P, "li": _LI, "dt": _DD, "dd": _DD, "thead": _SECTION, "tbody": _SECTION, "tfoot": _SECTION, "tr": _ROW, "td": _CELL, "th": _CELL}
_ENDS = {"li": (_LI,), "dt": (_DD,), "dd": (_DD,), "thead": (_SECTION, _ROW), "tbody": (_SECTION, _ROW), "tfoot": (_SECTION, _ROW), "tr": (_ROW,), "td": (_CELL,), "th": (_CELL,)}


class _Page:
    """Elements in page order as parallel lists, each after its parent, and blocks of text."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.block = [-1], [""], [0], [0]
        self.weight, self.reader, self.no_text, self.region, self.link = [1.0], [False], [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, list[str], int, int, int]] = []  # element, pieces, characters, those outside links, punctuation
        self._parse(page)

    def _element(self, tag: str, attributes: str, parent: int) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        words = _NAME.findall(found["class"].lower()) if "class" in found else []
        role = found.get("role", "").lower()
        label = tag if tag in INLINE else tag + "." + "-".join(words)
        weight = min(TAGS.get(tag, 1.0), ROLES.get(role, 1.0))
        if tag == "header" and not self.region[parent]:
            weight = 0.02
        names = set(words).union(_NAME.findall(found["id"].lower()) if "id" in found else ())
        reader = bool(names & READER)
        if reader:
            weight = READER_WEIGHT
        elif names & NAMES and tag not in ("html", "body") and not names & {"has", "with", "no", "content", "main", "layout", "wrapper", "wrap", "container"}:
            weight = min(weight, NAME_WEIGHT)
        me = len(self.parent)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.path[parent] if tag in INLINE else self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.block.append(self.block[parent] if tag in INLINE else me)
        self.weight.append(weight)
        self.reader.append(reader)
        self.no_text.append(self.no_text[parent] or tag in NO_TEXT or "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", ""))))
        self.region.append(not reader and (self.region[parent] or tag in ("article", "main") or role == "main" or found.get("itemprop") == "articleBody"))
        self.link.append(self.link[parent] or tag == "a")
        return me

    def _parse(self, page: str) -> None:
        stack, scopes, counts = [0], [_CLOSED], Counter()
        at, n = 0, len(page)
        fresh = True

        def add(text: str) -> None:
            nonlocal fresh
            top = stack[-1]
            if not text or self.no_text[top]:
                return
            text = html.unescape(text) if "&" in text else text
            size = len(text.strip())
            own, marks = (0, 0) if self.link[top] else (size, len(_PUNCTUATION.findall(text)))
            if fresh:
                self.blocks.append((self.block[top], [text], size, own, marks))
                fresh = False
            else:
                e, pieces, a, b, c = self.blocks[-1]
                pieces.append(text)
                self.blocks[-1] = (e, pieces, a + size, b + own, c + marks)

        def end(place: int) -> None:
            for e in stack[place:]:
                counts[self.tag[e]] -= 1
            del stack[place:], scopes[place:]

        while at < n:
            m = _OPEN.search(page, at)
            if not m:
                add(page[at:])
                return
            add(page[at : m.start()])
            at = m.start()
            if m[0] == "<!--":
                stop = page.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else n
                continue
            if m[0] in ("<!", "<?"):
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else n
                continue
            t = _TAG.match(page, at)
            if not t:
                return  # the page ends within a tag
            at = t.end()
            tag = t[2].lower()
            if tag not in INLINE and not self.no_text[stack[-1]]:
                fresh = True
            if t[1]:
                if counts[tag] > 0:
                    place = len(stack) - 1
                    while self.tag[stack[place]] != tag:
                        place -= 1
                    end(place)
                    if tag not in INLINE:
                        fresh = True
                continue
            if tag in ENDS_P and scopes[-1][_P] >= 0:
                end(scopes[-1][_P])
            for kind in _ENDS.get(tag, ()):
                if scopes[-1][kind] >= 0:
                    end(scopes[-1][kind])
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n
                continue
            if t[3].endswith("/") and tag in ("svg", "path"):
                continue
            me = self._element(tag, t[3], stack[-1])
            scope = scopes[-1]
            if tag in _RESETS or tag in _SETS:
                scope = list(scope)
                for kind in _RESETS.get(tag, ()):
                    scope[kind] = -1
                if tag in _SETS:
                    scope[_SETS[tag]] = len(stack)
                scope = tuple(scope)
            stack.append(me)
            scopes.append(scope)
            counts[tag] += 1

    def weights(self, kept: list[tuple[int, int]], whole: float, reader_whole: float) -> list[float]:
        """Weight of each element by its own evidence and that of those around it; void where it holds nearly all text."""
        size = [0] * len(self.parent)
        some = any(own for e, own in kept if self.region[e])
        for e, own in kept:  # where there is an article element, only its text can speak for those around it
            size[e] += own if self.region[e] or not some else 0
        for e in range(len(size) - 1, 0, -1):
            size[self.parent[e]] += size[e]
        out = [1.0] * len(size)
        for e in range(1, len(size)):
            void = size[e] > (reader_whole if self.reader[e] else whole) * size[0]
            out[e] = out[self.parent[e]] * (1.0 if void else self.weight[e])
        inside = sum(own for e, own in kept if self.region[e] and out[e] == 1.0)
        if inside >= 0.25 * sum(own for e, own in kept if out[e] == 1.0) and inside:
            out = [w if r else w * OUTSIDE_WEIGHT for w, r in zip(out, self.region, strict=True)]
        return out


def path_scores(paths: list[int], sizes: list[int], marks: list[int], window: int) -> dict[int, float]:
    """Fused, smoothed length and punctuation ratio of each path, from the blocks in page order."""
    sums: dict[int, list[int]] = {}
    for p, size, mark in zip(paths, sizes, marks, strict=True):
        row = sums.setdefault(p, [0, 0, 0])
        row[0] += size
        row[1] += mark
        row[2] += 1
    length = [sums[p][0] / sums[p][2] for p in paths]
    punctuation = [(sums[p][1] + 1) / sums[p][2] for p in paths]
    bell = [math.exp(-(d * d) / 2) for d in range(-window, window + 1)]
    score: dict[int, list[float]] = {}
    n = len(paths)
    for i, p in enumerate(paths):
        a = b = total = 0.0
        for d in range(max(-window, -i), min(window, n - 1 - i) + 1):
            w = bell[d + window]
            a, b, total = a + w * length[i + d], b + w * punctuation[i + d], total + w
        row = score.setdefault(p, [0.0, 0.0])
        # a block's smoothed ratios count beside its path's own, so that no path lives on its neighbours alone
        row[0] += math.sqrt(a / total * b / total * length[i] * punctuation[i]) ** 0.5
        row[1] += 1
    return {p: f / k for p, (f, k) in score.items()}


def main_text(page: str | None, window: int = 2, spread: float = 0.3, whole: float = 0.8, reader_whole: float = 0.95) -> str:
    """The article of one page; '' if there is none. A null page is empty."""
    x = _Page(page or "")
    blocks = [b for b in x.blocks if b[2]]
    if not any(own for *_, own, _ in blocks):
        return ""
    weight = x.weights([(e, own) for e, _, _, own, _ in blocks], whole, reader_whole)
    score = path_scores([x.path[e] for e, *_ in blocks], [own for *_, own, _ in blocks], [m for *_, m in blocks], window)
    value = [score[x.path[e]] * weight[e] for e, *_ in blocks]
    volume = [own * weight[e] for e, _, _, own, _ in blocks]
    bar = spread * sum(v * n for v, n in zip(value, volume, strict=True)) / sum(volume)
    content = [v >= bar and v > 0 for v in value]
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    # articles, by the outermost element of that tag, that hold content
    article = [0] * len(x.parent)
    for e in range(1, len(article)):
        article[e] = article[x.parent[e]] or (e if x.tag[e] == "article" else 0)
    holds = {article[e] for (e, *_), c in zip(blocks, content, strict=True) if c and article[e]}
    # blocks to the next one of content, for headings
    ahead, nearest = [0] * len(blocks), 1 << 30
    for i in range(len(blocks) - 1, -1, -1):
        ahead[i] = nearest
        nearest = 1 if content[i] else nearest + 1
    clear = max(w for w, c in zip((weight[e] for e, *_ in blocks), content, strict=True) if c)
    parts = []
    for i, (e, pieces, size, own, _) in enumerate(blocks):
        near = first < i < last or article[e] in holds or (x.tag[e] in HEADINGS and ahead[i] <= 3)
        if content[i] or (near and weight[e] >= clear and 2 * own >= size):
            parts.append("".join(pieces))
    return " ".join(" ".join(parts).split())


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points, long) of every page, one row per input row.

    Null, empty and text-free pages have the text ''. Character references are decoded,
    white space inside a block is one space, blocks are joined by one space; nothing else
    of the article is dropped, and nothing is capped. Unclosed tags are closed as browsers
    do. Other columns are ignored; null ids and urls stay null; repeated rows stay.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
