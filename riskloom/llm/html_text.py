"""Main text of web pages by the maximum-scoring contiguous region of tokens.

A page is a sequence of word and tag tokens. Words score positive and tags negative; the weights come from labelled pages, that is pages
whose ``article`` or ``main`` element says where the content is (a bounded sample, counted with Spark). Words inside elements that never hold
content (menus, scripts, adverts, comments, ...) score as their opposite. One linear scan finds the contiguous region with the largest
sum. If the page marks its content, the region is moved to the borders of all marked elements it overlaps, without what lies between them. The text of the
region is cut into blocks, without those elements.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

SAMPLE = 2000
# Element names of HTML by role.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style textarea title noscript template iframe xmp noembed noframes head nav footer aside form select button "
            "dialog menu svg math canvas object audio video map datalist".split())
BLOCKS = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main header blockquote pre table caption thead tbody tfoot tr td th "
             "figure figcaption hr address details summary fieldset body hgroup center".split())
CONTENT = ("article", "main")
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Whole class names or ids of what is no content. A compound is one only if all its parts are: cookie-banner, site-footer, comment-list, but
# neither has-sidebar nor fixed-header, side-by-side, comments-open or related-work.
SIDE_NAMES = (r"(?:ads?|advert\w*|adbox|banner|promo\w*|sponsor\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|footer|"
              r"masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|social|share|"
              r"sharing|related|recommend\w*|trending|widget|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|toolbar|tags|skip)")
SIDE = re.compile(
    rf"(?:(?:site|global|main|primary|secondary|top|bottom|left|right|mobile|desktop)[_-]+)*{SIDE_NAMES}(?:[_-]+{SIDE_NAMES})*"
    r"(?:[_-]+(?:list|bar|box|area|block|slot|unit|panel|section|links?|buttons?|icons?|form|items?|posts|articles|left|right|top|bottom|\d+))*", re.I)
# Inside marked content these name parts of the text.
OF_TEXT = set("header masthead notice alert side tags".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds are text, open, close. The inside of raw elements and comments is left out."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            yield "close", name, ""
        else:
            yield "open", name, m[2] or ""
            if name in RAW:
                end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = end.end() if end else n
                yield "close", name, ""


def _aside(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element never holds content, by its name, role or style; and whether its class, id or being a form says so."""
    if (name in NEVER and name != "form") or (name == "header" and not inside):
        return True, False
    by_class = name == "form"
    if not attributes or name in ("html", "body", *CONTENT):
        return False, by_class
    for m in ATTR.finditer(attributes):
        key, value = (m[5] or m[1]).lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden" and not value \
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "itemtype" and "Comment" in value:
            return True, by_class
        if key in ("class", "id") and (not inside or name in BLOCKS):
            by_class = by_class or any(SIDE.fullmatch(x) and not (inside and x.lower() in OF_TEXT) for x in value.split())
    return False, by_class


def _walk(stream: list[tuple[str, str, str]], around: set[int] = frozenset()) -> tuple[list, list, dict[int, list[int]]]:
    """Tokens as in ``parse``; (is main, lies in main, elements marked by class around it) of every content element; and first and end
    token of every element marked by class. Elements go by their place in ``stream``; class rules do not hold for those in ``around``."""
    # On the stack: name, never content, elements marked by class, number, lies in content, lies in main.
    out, stack, count, holders, spans = [], [], 0, [], {}
    bottom = ("", False, (), -1, False, False)

    def end(keep: int) -> None:
        for _, _, marks, *_ in stack[keep:]:
            for x in marks[-1:]:
                spans[x][1] = max(spans[x][1], len(out))
        del stack[keep:]

    for at, (kind, name, attributes) in enumerate(stream):
        _, never, marks, number, inside, in_main = stack[-1] if stack else bottom
        if kind == "close":
            names = [s[0] for s in stack]
            if name in names:
                keep = len(names) - 1 - names[::-1].index(name)
                # A stray closing tag does not end a block around an element of content.
                if name in BLOCKS or name in NEVER or name in CONTENT or not any(x in BLOCKS for x in names[keep + 1:]):
                    _, never, marks, number, *_ = stack[keep]
                    end(keep)
                    out.append((kind, name, never or bool(marks), number))
            continue
        if kind == "text":
            out.append((kind, name, never or bool(marks), number))
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            end(len(stack) - 1)
            _, never, marks, number, inside, in_main = stack[-1] if stack else bottom
        own, by_class = _aside(name, attributes, inside)
        never = never or own
        if by_class and at not in around:
            marks = (*marks, at)
            spans[at] = [len(out), len(out) + 1]
        if name in CONTENT and not never:
            holders.append((name == "main", in_main, marks))
            inside, in_main = True, in_main or name == "main"
            if number < 0 and not marks:
                number, count = count, count + 1
        out.append((kind, name, never or bool(marks), number))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, never, marks, number, inside, in_main))
    end(0)
    return out, holders, spans


def parse(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, str, bool, int]]:
    """(kind, name or text, aside, number of the content element or -1) of every token, in page order.

    ``aside`` marks what lies in an element that never holds content. Unclosed elements end with the element around them. No class rule
    holds for an element around ``main`` or, where ``main`` or the page has no other, around ``article``. If the page marks no content and
    ``weights`` are given, none holds for an element around the region that is best without class rules.
    """
    stream = list(tokens(page))
    out, holders, spans = _walk(stream)
    if not spans:
        return out
    around = {x for main, _, marks in holders if main for x in marks}
    # Where some article lies outside (comments can be articles too), class rules hold for the others.
    inner = [set(marks) - around for main, in_main, marks in holders if not main and (in_main or not any(h[0] for h in holders))]
    least = min(map(len, inner), default=0)
    around |= {x for marks in inner if len(marks) == least for x in marks}
    if not holders and weights is not None:
        low, high = best_region(_walk(stream, set(spans))[0], weights)
        around = {x for x, (first, last) in spans.items() if low < high and first <= low and high <= last}
    return _walk(stream, around)[0] if around else out


def count_tokens(page: str) -> tuple[Counter, Counter]:
    """Tokens inside and outside the marked content of a page: ``#word`` for words, the name for tags; empty without a mark."""
    seen = parse(page)
    inner, outer = Counter(), Counter()
    if any(number >= 0 for *_, number in seen):
        for kind, name, aside, number in seen:
            side = inner if number >= 0 and not aside else outer
            side["#word" if kind == "text" else name] += len(name.split()) if kind == "text" else 1
    return inner, outer


def fit_weights(pages: DataFrame, url: str = "url", page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Log-odds of each token kind to lie in marked content, words at least 0.05 and tags at most -0.05.

    Counted over at most ``sample`` pages with a mark (smallest hash of url). Tag names of HTML only, so the table is bounded.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inner, outer = Counter(), Counter()
            for p in batch["page"]:
                a, b = count_tokens(p)
                inner.update(a)
                outer.update(b)
            names = sorted((set(inner) | set(outer)) & (BLOCKS | NEVER | VOID | {"#word", "a", "b", "i", "em", "strong", "span"}))
            yield pd.DataFrame({"name": names, "inner": [inner[k] for k in names], "outer": [outer[k] for k in names]})

    digest = F.md5(F.concat(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.lit(" "), F.md5(F.col(f"`{page}`"))))
    marked = pages.where(F.col(f"`{page}`").rlike(r"(?i)<(article|main)[\s>]")).select(digest.alias("h"), F.col(f"`{page}`").alias("page"))
    # Only hashes are sorted; pages are taken by the largest hash of the sample, so none of them travels. Equal pages count together.
    edge = marked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = written(marked.where(F.col("h") <= edge).select("page").mapInPandas(run, "name string, inner bigint, outer bigint"), "page-counts").groupBy("name").agg(
        F.sum("inner").alias("inner"), F.sum("outer").alias("outer")).collect()
    total = [sum(r[side] for r in rows) + 1 for side in ("inner", "outer")]
    odds = {r["name"]: math.log((r["inner"] + 1) / total[0]) - math.log((r["outer"] + 1) / total[1]) for r in rows}
    return {k: max(0.05, v) if k == "#word" else min(-0.05, v) for k, v in odds.items()} or {"#word": 0.5}


def best_region(seen: list[tuple[str, str, bool, int]], weights: dict[str, float]) -> tuple[int, int]:
    """First and end token of the contiguous region with the largest sum; (0, 0) if none is positive."""
    word, tag = weights.get("#word", 0.5), -0.5
    best, where, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, aside, _) in enumerate(seen):
        if kind == "text":
            value = word * len(name.split()) * (-1 if aside else 1)
        else:
            value = min(-0.05, weights.get(name, tag))
        if run <= 0:
            run, start = 0.0, i
        run += value
        if run > best:
            best, where = run, (start, i + 1)
    return where


def main_text(page: str | None, weights: dict[str, float]) -> str:
    seen = parse(page or "", weights)
    low, high = best_region(seen, weights)
    numbers = Counter()
    for kind, name, aside, number in seen[low:high]:
        if kind == "text" and not aside and number >= 0:
            numbers[number] += len(name.split())
    numbers = +numbers
    inside = [t for t in seen if t[3] in numbers] if numbers else seen[low:high]
    blocks, now = [], []
    for kind, name, aside, _ in [*inside, ("open", "p", False, -1)]:
        if kind == "text":
            if not aside:
                now.append(name)
        elif name in BLOCKS:
            if line := " ".join(html.unescape("".join(now)).split()):
                blocks.append(line)
            now = []
        elif name == "br":
            now.append(" ")
    return "\n\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float], page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the html column and with ``text`` (empty if none) and ``n_chars`` (its code points).

    A null or empty page has an empty text. All rows and other columns are kept; input columns named like an output column are replaced.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (page, text, "n_chars")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) for p in batch])

    out = pages.select(*keep, F.pandas_udf(run, "string")(F.col(f"`{page}`")).alias(text))
    return out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("bigint"))
