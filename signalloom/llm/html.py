"""Main text of web pages as a maximum-scoring subsequence of tags and words.

A page is a sequence of tags and runs of words. Each word scores by the block it stands in, each tag
by its name and classes; tags never score above zero. The region with the greatest sum, found by one
linear scan, is the content. The weights are log-odds of lying inside the content, counted on
labelled pages: those that mark their content themselves, by exactly one ``article`` element, of
which ``SAMPLE`` with the least hash of their id are used, and the ``FEATURES`` most frequent features.

Text in the region becomes blocks, cut at block tags and ``br``: character references decoded, white
space turned into single spaces, empty blocks left out, joined by a line break. Scripts, styles,
templates, comments, form fields and the head are no text. Inside the region, elements that the
labels place outside the content, such as adverts, are left out too.

Nulls and edges: null or empty pages, and pages without any scoring word, have an empty text; without
labelled pages only the defaults score; unclosed and stray tags are tolerated, in linear time however
many; repeated rows are extracted each, and all rows of a sampled id count; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.shared import table

SAMPLE, FEATURES, SEEN = 4_096, 10_000, 20

#: Elements of HTML that hold no text of a page, that do not end a block, that have no
#: end tag, and that divide a page into parts.
SILENT = ("script", "style", "template", "noscript", "svg", "textarea", "select", "button", "iframe", "title")
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q ruby s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("article aside body dialog footer form header main menu nav section".split())

WORD_WEIGHT, TAG_WEIGHT, STEEPEST = 1.0, -0.5, 12.0

# No part gives back what it took, so that a tag is tried once from its start. The last form is a start
# that becomes no tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT) + r")\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<stray>)(?=[a-zA-Z/!?])",
    re.S | re.I,
)
_NAME = re.compile(r"</?(?=[a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]|\Z")
_SILENT = re.compile(r"<(?:" + "|".join(SILENT) + r")\b", re.I)
_MARK = re.compile("[>\"']")
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _closed(page: str, begin: int):
    """A test whether the tag that starts at a place from ``begin`` on has an end; places come in order.

    Trying each start would read the rest of the page again for each that has none. A tag ends at the
    first ``>`` outside quotes, so one pass from the back tells for every quote and ``>``, read outside
    quotes, whether an end follows.
    """
    at = [m.start() for m in _MARK.finditer(page, begin)]
    ends = [False] * (len(at) + 1)
    following: dict[str, int] = {}
    for k in range(len(at) - 1, -1, -1):
        mark = page[at[k]]
        if mark == ">":
            ends[k] = True
        else:
            ends[k] = mark in following and ends[following[mark] + 1]
            following[mark] = k
    last, name_end = page.rfind(">"), begin

    def test(start: int) -> bool:
        nonlocal name_end
        if page.startswith("<!--", start):
            return True
        if page.startswith(("<!", "<?"), start) or _SILENT.match(page, start):
            return start < last
        name = _NAME.match(page, start)
        if name is None:
            return False
        if name.end() >= name_end:  # else the name runs as far as that of an earlier start
            name_end = _NAME_END.search(page, name.end()).start()
        return ends[bisect_left(at, name_end)]

    return test


def _tags(page: str) -> Iterator[re.Match]:
    """Comments, silent elements and tags in order, in time linear in the page."""
    for m in _TOKEN.finditer(page):
        if m["stray"] is not None:
            break
        yield m
    else:
        return
    closed = _closed(page, m.start())
    at = m.start()
    while (at := page.find("<", at)) >= 0:
        found = _TOKEN.match(page, at) if closed(at) else None
        if found is None:
            at += 1
        else:
            yield found
            at = found.end()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Tags and texts in order: kind (``open``, ``close``, ``text``), feature or context, text.

    The feature of a tag is its name with its classes; a closing tag has that of the tag it closes.
    The context of a text is its block and the part of the page around it.
    """
    # Open tags: name, feature, place of the innermost block, and the context of a text inside:
    # whether in a link of that block, the block, and the innermost part.
    stack: list[tuple[str, str, int, tuple[str, str, str]]] = []
    places: dict[str, list[int]] = {}
    end = 0

    def context() -> str:
        link, block, part = stack[-1][3] if stack else ("", "", "")
        return f"{link}{block}|{part}"

    def cut(at: int) -> None:
        while len(stack) > at:
            places[stack.pop()[0]].pop()

    for m in _tags(page):
        if m.start() > end:
            yield "text", context(), page[end : m.start()]
        end = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            at = places[name][-1] if places.get(name) else None
            feature = stack[at][1] if at is not None else name
            if at is not None:
                cut(at)
            yield "close", feature, name
            continue
        classes = sorted({c.lower() for x in _CLASS.findall(m[4]) for c in "".join(x).split()})
        feature = ".".join([name, *classes])
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
            # A new one of these ends one that was left open in the same parent.
            at = stack[-1][2]
            if at >= 0 and stack[at][0] == name:
                cut(at)
        if name not in VOID and not m[4].endswith("/"):
            innermost, (link, block, part) = (stack[-1][2], stack[-1][3]) if stack else (-1, ("", "", ""))
            if name not in INLINE:
                innermost, link, block = len(stack), "", feature
                part = feature if name in PARTS or "." in feature else part
            elif name == "a":
                link = "a "
            places.setdefault(name, []).append(len(stack))
            stack.append((name, feature, innermost, (link, block, part)))
        yield "open", feature, name
    if end < len(page):
        yield "text", context(), page[end:]


def labelled_features(page: str) -> Counter:
    """How often each feature lies inside and outside the page's only ``article``."""
    found: Counter = Counter()
    inside = False
    for kind, feature, text in tokens(page):
        if kind == "close" and text == "article":
            inside = False
        if kind == "text":
            if n := len(text.split()):
                found["w " + feature, inside] += n
                block, part = feature.split("|")
                found["w |" + part, inside] += n
                found["w " + block, inside] += n
        else:
            found[kind[0] + " " + feature, inside] += 1
        if kind == "open" and text == "article":
            inside = True
    return found


def fit(pages: DataFrame) -> dict[str, float]:
    """Log-odds of features, from a bounded sample of pages that mark their content."""
    marked = pages.where(F.regexp_count("html", F.lit("(?i)<article\\b")) == 1).where(F.regexp_count("html", F.lit("(?i)</article\\s*>")) == 1)
    # Ids alone go to the task that picks them; whole pages stay where they are.
    picked = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    sample = marked.join(F.broadcast(picked), "page_id", "left_semi")

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                total.update(labelled_features(page))
        rows = [(f, n if inside else 0, 0 if inside else n) for (f, inside), n in total.items()]
        yield pa.RecordBatch.from_pydict({"feature": [r[0] for r in rows], "n_in": [r[1] for r in rows], "n_out": [r[2] for r in rows]}, schema=pa.schema([("feature", pa.string()), ("n_in", pa.int64()), ("n_out", pa.int64())]))

    counted = sample.select("html").mapInArrow(count, "feature string, n_in long, n_out long").groupBy("feature").agg(F.sum("n_in").alias("a"), F.sum("n_out").alias("b"))
    top = counted.where(F.col("a") + F.col("b") >= SEEN).orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(FEATURES).collect()
    return {r["feature"]: max(-STEEPEST, min(STEEPEST, math.log((r["a"] + 0.5) / (r["b"] + 0.5)))) for r in top}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run of scores with the greatest sum above zero, the earliest of equals; else an empty one."""
    best = sum_ = 0.0
    low = high = begin = 0
    for i, score in enumerate(scores):
        sum_ += score
        if sum_ <= 0:
            sum_, begin = 0.0, i + 1
        elif sum_ > best:
            best, low, high = sum_, begin, i + 1
    return low, high


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the region with the greatest score."""
    if not page:
        return ""

    def word_weight(context: str) -> float:
        block, part = context.split("|")
        for feature in (context, "|" + part, block):
            if (known := weights.get("w " + feature)) is not None:
                return known
        return WORD_WEIGHT

    seen = list(tokens(page))
    scores = [
        len(text.split()) * word_weight(feature) if kind == "text" else min(-0.01, weights.get(kind[0] + " " + feature, TAG_WEIGHT))
        for kind, feature, text in seen
    ]
    low, high = best_region(scores)
    blocks, block = [], []
    for kind, feature, text in seen[low:high]:
        if kind == "text":
            if word_weight(feature) > -STEEPEST / 2:
                block.append(text)
        elif text not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page."""
    weights = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def texts(batches):
        for b in batches:
            out = [main_text(page, weights.value) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return picked.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
