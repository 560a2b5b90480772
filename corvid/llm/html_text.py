"""Main-text extraction by the maximum-scoring subsequence of a page.

A page is a sequence of words and tags.  Words score positive and tags negative, with
weights from labelled pages: pages that mark their content with ``<article>`` or
``<main>`` say which tags stand inside content and which outside.  One linear scan finds
the contiguous run of tokens with the largest score.  The run is then widened to the
container element that holds it, and known boilerplate inside (menus, adverts,
comments ...) is left out.  Every step is linear in the page, however deep its elements
stand in each other or however many of its tags are never closed.
"""
from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, dealt

#: Labelled pages that the weights are fitted on, about.
SAMPLE_PAGES = 2000
# Element names and words of class, id and role attributes.
SKIPPED = frozenset("script style noscript template nav footer aside form button select textarea iframe svg canvas "
                    "object menu dialog head title".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr thead tbody tfoot caption blockquote pre section "
                   "article main header address figure figcaption hr details summary body html".split())
CONTAINERS = frozenset("article main div section td body html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar "
                        "nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus cookie "
                        "cookies consent notice notices alert popup modal newsletter subscribe subscription share sharing "
                        "social related recommended widget pagination pager toolbar login signup search contentinfo "
                        "complementary dialog reply replies side".split())
#: Labels that say little of a paragraph or headline inside content.
WEAK = frozenset("social side search alert widget menu login signup dialog reply replies pager toolbar".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Names that weights are fitted for; others count as any other tag.
NAMES = frozenset("a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center "
                  "cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font "
                  "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li "
                  "link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre "
                  "progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg "
                  "table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split())
#: A container labelled as the header of the site or page is none of the article.
SITE = frozenset("site page top global main".split())
_KEPT_WHOLE = frozenset(("html", "body", "article", "main"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>", re.S | re.I)
_LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Scores when no page is labelled: a word, a tag, tags inside content.
DEFAULT_WEIGHTS = {"": 1.0, "*": -1.5, "p": -0.2, "b": -0.2, "i": -0.2, "br": -0.2, "em": -0.2, "strong": -0.2}


def _is_boilerplate(name: str, attrs: str, in_content: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_content:
        return True
    if not attrs or name in _KEPT_WHOLE:
        return False
    if _HIDDEN.search(attrs):
        return True
    for m in _LABELS.finditer(attrs):
        for label in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(label)]
            found = BOILERPLATE.intersection(parts)
            if found and not (in_content and name in PROSE and found <= WEAK) or not in_content and "header" in parts and SITE.issuperset(set(parts) - {"header"}):
                return True
    return False


class Element:
    """An open container: its parent and how deep it stands (0: the page)."""
    __slots__ = ("name", "parent", "depth")

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0


_CONTENT = ("article", "main")
_OPEN_END = re.compile(r"<(?:!--|[!?/])")


def _matches(page: str):
    """Matches of ``_TOKEN`` and where the page's text ends.

    After the last ``>`` nothing but an unclosed comment or declaration can begin, so
    unclosed tags are not looked for there again and again."""
    end = page.rfind(">") + 1
    last = None
    for last in _TOKEN.finditer(page, 0, end):
        yield last, None
    open_ = last is not None and last.end() == end and (
        last[0].startswith("<!--") and not last[0].endswith("-->") or last["raw"] and not re.search(rf"</{last['raw']}\s*>\Z", last[0], re.I))
    stop = _OPEN_END.search(page, end)
    yield None, end if open_ else stop.start() if stop else len(page)


def tokens(page: str):
    """Tokens of a page in order: ``(tag name or '', text, words, skipped, container, in content)``.

    ``container`` is the innermost open ``Element`` of a container; a tag's is the one it
    stands in (an end tag's: after it).  Raw-text elements, comments and declarations leave
    no token."""
    out = []
    top = Element("", None)
    stack: list[tuple[str, bool, Element | None]] = []     # name, skipped, container to go back to
    open_names: dict[str, int] = {}
    inner, skipped, content, at = top, 0, 0, 0

    def words(text: str):
        text = html.unescape(text)
        if text:
            out.append(("", text, len(text.split()), skipped > 0, inner, content > 0))

    def push(name: str, skip: bool):
        nonlocal inner, skipped, content
        stack.append((name, skip, inner))
        open_names[name] = open_names.get(name, 0) + 1
        skipped += skip
        content += name in _CONTENT
        if name in CONTAINERS:
            inner = Element(name, inner)

    def pop():
        nonlocal inner, skipped, content
        name, skip, inner = stack.pop()
        open_names[name] -= 1
        skipped -= skip
        content -= name in _CONTENT
        return name

    for m, stop in _matches(page):
        begin = m.start() if m else stop
        if begin > at:
            words(page[at:begin])
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if open_names.get(name):
                while pop() != name:
                    pass
            out.append((name, "", 0, skipped > 0, inner, content > 0))
            continue
        attrs = m["attrs"] or ""
        out.append((name, "", 0, skipped > 0, inner, content > 0))
        if name in VOID or attrs.endswith("/"):
            continue
        block = name in BLOCKS or name in CONTAINERS or name in SKIPPED
        skip = bool(block or attrs) and _is_boilerplate(name, attrs, content > 0)
        if name in ("p", "li") and stack and stack[-1][0] == name:   # their end tags may be left out
            pop()
        if skip or block and name not in ("p", "li"):
            push(name, skip)
    return out


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """The maximum-scoring contiguous run ``[i, j)`` by one scan over prefix sums; empty if none is positive."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(sums)
    gain = sums - low
    j = int(gain.argmax())
    if gain[j] <= 0:
        return 0, 0
    return int(np.flatnonzero(sums[:j + 1] == low[j])[-1]), j


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of one page (empty for a null or empty page or one without words)."""
    if not page:
        return ""
    toks = tokens(page)
    word, other = weights[""], weights["*"]
    scores = np.array([(-word if skip else word) * n if not name else weights.get(name, other)
                       for name, _, n, skip, *_ in toks] or [0.0])
    i, j = best_run(scores)
    if i == j:
        return ""
    # the container that holds the whole run: the shallowest one between its first and last words
    said = [k for k in range(i, j) if not toks[k][0] and toks[k][2]]
    depth = min(t[4].depth for t in toks[said[0]:said[-1] + 1])
    held = toks[said[0]][4]
    while held.depth > depth:
        held = held.parent
    above = held
    while above:                                  # content marked as such is one unit
        if above.name in _CONTENT:
            depth = above.depth
        above = above.parent
    # its tokens stand together: leaving it takes a tag that stands further out
    first, last = said[0], said[-1]
    while first and toks[first - 1][4].depth >= depth:
        first -= 1
    while last + 1 < len(toks) and toks[last + 1][4].depth >= depth:
        last += 1
    blocks, line = [], []
    for name, text, _, skip, *_ in toks[first:last + 1]:
        if name:
            if name in BLOCKS:
                blocks.append(" ".join("".join(line).split()))
                line = []
            elif name in ("br", "td", "th"):
                line.append(" ")
        elif not skip:
            line.append(text)
    blocks.append(" ".join("".join(line).split()))
    return "\n\n".join(b for b in blocks if b)


def _label(batches):
    for batch in batches:
        counts: dict[tuple[str, bool], int] = {}
        for page in batch.column(0).to_pylist():
            toks = tokens(page or "")
            if not any(t[5] for t in toks):
                continue
            for name, _, n, skip, _, content in toks:
                if name and name not in NAMES:
                    continue
                key = (name, content and not skip)
                counts[key] = counts.get(key, 0) + (1 if name else n)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                                          pa.array([counts[k] for k in keys], pa.int64())], ["name", "inside", "n"])


def fit_weights(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html",
                sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Token weights from about ``sample_pages`` of the pages that mark content (all, if there are
    fewer), dealt by hash; ``DEFAULT_WEIGHTS`` if no page does.

    The weight of a tag is its log odds of standing in content, made negative; a word's
    is its own log odds, made positive.  Names that HTML does not have weigh as any other."""
    marked = pages.where(F.col(text_col).rlike("(?i)<(article|main)\\b"))
    total = marked.count()
    if not total:
        return dict(DEFAULT_WEIGHTS)
    part = marked.where(dealt(min(1.0, sample_pages / total), id_col, text_col))
    rows = (part.select(F.col(text_col).alias("_html")).mapInArrow(_label, "name string, inside boolean, n long")
            .groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"),
                                 F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("n_out")).collect())
    if not rows and total > sample_pages:
        raise RuntimeError(f"none of {total} pages with marked content was drawn, or none has content")
    n_in, n_out = sum(r.n_in for r in rows), sum(r.n_out for r in rows)
    if not n_in or not n_out:
        return dict(DEFAULT_WEIGHTS)
    odds = {r.name: math.log((r.n_in + 1) / (n_in + 1)) - math.log((r.n_out + 1) / (n_out + 1)) for r in rows}
    weights = {k: min(v, -0.05) for k, v in odds.items() if k}
    return weights | {"": max(odds.get("", 1.0), 0.25), "*": -1.5}


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "page_id",
              text_col: str = "html") -> DataFrame:
    """``pages`` without the markup column, with ``text`` and ``n_chars`` (code points).

    A null or empty page and one without words give an empty text.  Pages are read whole;
    rows that repeat are extracted one by one; columns named like a result column are
    replaced.  Without ``weights`` they are fitted on the pages themselves."""
    bound_batches(pages.sparkSession)
    weights = weights or fit_weights(pages, id_col=id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [extract(p, weights) for p in batch.column(at).to_pylist()]
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if k != at}
            yield pa.RecordBatch.from_pydict(cols | {"text": pa.array(texts, pa.string())})

    src = pages.drop(*[c for c in ("text", "n_chars") if c != text_col])
    schema = T.StructType([f for f in src.schema.fields if f.name != text_col] + [T.StructField("text", T.StringType())])
    return src.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
