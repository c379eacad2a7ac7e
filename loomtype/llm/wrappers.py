"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a page of that host by simple tree matching. Nodes whose text is the same on most
pages are the host's template, inside articles too; what varies are slots, and the article's slots are the content.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small_batches
from .textbytes import clean

# Names of HTML's elements by kind, and words that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = set("""script style noscript template iframe object svg canvas math button select textarea input option head
title nav footer aside form dialog menu audio video map""".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar
navigation menu breadcrumb breadcrumbs sidebar widget footer cookie cookies consent gdpr notice notices alert popup modal
overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment
comments commentlist reply replies respond disqus pagination pager toolbar search skip""".split())
AROUND_WORDS = set("""area bar block box buttons container global icons inner item items left links list main mobile outer page post
posts primary right secondary section site slot stories top bottom unit wrap wrapper""".split())
TITLED = set("h1 h2 h3 h4 h5 h6 section article main p".split())  # often with ids or classes made from their texts
OUTER_WORDS = set("header masthead topbar side".split())
CONTENT_WORDS = set("article post entry story content main articlebody".split())
# What goes with the element that holds it only, and what needs some words to be known as template.
HELD = set("h1 h2 h3 h4 h5 h6 dt dd th td tr li caption figcaption summary thead tbody tfoot body html article main".split())
FLOW = set("p ul ol dl table pre blockquote address figure hr".split())
FLOW_WORDS = 3
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Page:
    """Elements in document order (parallel lists), and the events that lead through them."""

    def __init__(self, html: str):
        self.tags, self.marks, self.parents = ["#root"], [("", set(), "", "")], [-1]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where it begins or ends
        self.stack = [0]
        self.open: dict[str, int] = {}  # open elements of each name: the stack is walked only where one can be found
        at = 0
        while at < len(html):
            m = _MARKUP.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self.end(name)
                continue
            self.begin(name, m[3] or m[6] or "")
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = close.end() if close else len(html)
                self.end(name)

    def text(self, text: str) -> None:
        if text:
            self.events.append((self.stack[-1], unescape(text) if "&" in text else text))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.open[self.tags[element]] -= 1
            self.events.append((element, None))

    def begin(self, name: str, attributes: str) -> None:
        if name in BLOCK and self.open.get("p"):
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[depth]]
                if tag == "p":
                    self.pop_to(depth)
                    break
                if tag in BLOCK:
                    break
        if name in CLOSED_BY and any(self.open.get(tag) for tag in CLOSED_BY[name]):
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[depth]]
                if tag in SCOPES[name]:
                    break
                if tag in CLOSED_BY[name]:
                    self.pop_to(depth)
        self.tags.append(name)
        self.parents.append(self.stack[-1])
        self.marks.append(_marks(attributes))
        self.events.append((len(self.tags) - 1, None))
        if name not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if not self.open.get(name):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == name:
                self.pop_to(depth)
                return


def _marks(attributes: str) -> tuple[str, set[str], str, str]:
    """An element's label suffix, the words of its class and id, its role ("hidden" if it is), and where dropped words are.

    The last is made of C (class or itemprop) and I (id) where a whole token says it, c and i where a part does.
    """
    if not attributes.strip():
        return ("", set(), "", "")
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    label = found.get("class", "").lower().strip()
    words, dropped = set(_SPLIT.split(f"{label} {found.get('id', '').lower()} {found.get('itemprop', '').lower()}")) - {""}, ""
    if not words.isdisjoint(DROPPED_WORDS):
        for sign, value in (("c", f"{label} {found.get('itemprop', '').lower()}"), ("i", found.get("id", "").lower())):
            tokens = [t for t in (set(_SPLIT.split(x)) - {""} for x in value.split()) if not t.isdisjoint(DROPPED_WORDS)]
            if tokens:
                dropped += sign.upper() if any(t <= DROPPED_WORDS | AROUND_WORDS for t in tokens) else sign
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return (label, words, "hidden" if hidden else found.get("role", "").lower(), dropped)


def group_tree(page: Page) -> tuple[list[list], list[int], list[int]]:
    """The page's tree with like siblings merged, as rows [label, parent, text hashes], and each element's row and hash.

    Merging makes lists of any length one node and alternating ones a few, so labels are unique among siblings and
    matching costs little however long a page is. The texts stay apart: a row has the hash of each member's own text.
    """
    children: list[list[int]] = [[] for _ in page.tags]
    for i, p in enumerate(page.parents[1:], 1):
        children[p].append(i)
    texts: list[list[str]] = [[] for _ in page.tags]
    for i, text in page.events:
        if text is not None:
            texts[i].append(text)
    hashes = [0] * len(page.tags)
    for i, own in enumerate(texts):
        words = " ".join("".join(own).split()) if own else ""
        if words:
            hashes[i] = zlib.crc32(words.encode("utf-8", "surrogatepass"))
    rows: list[list] = []
    row_of = [0] * len(page.tags)
    todo = [([0], -1)]
    while todo:
        members, parent = todo.pop()
        first = members[0]
        at = len(rows)
        rows.append([f"{page.tags[first]}.{page.marks[first][0]}", parent, sorted({hashes[i] for i in members} - {0})])
        like: dict[str, list[int]] = {}
        for i in members:
            row_of[i] = at
            for c in children[i]:
                like.setdefault(f"{page.tags[c]}.{page.marks[c][0]}", []).append(c)
        todo += [(group, at) for group in reversed(like.values())]
    return rows, row_of, hashes


def tree_match(one: list[list], two: list[list]) -> list[tuple[int, int]]:
    """Pairs of rows of two trees in a largest order-preserving top-down matching (simple tree matching).

    Children are aligned by a heaviest increasing chain of their equally labelled pairs, so memory grows with these
    pairs only, and no step recurses.
    """
    if not one or not two or one[0][0] != two[0][0]:
        return []
    below_one: list[list[int]] = [[] for _ in one]
    below_two: list[list[int]] = [[] for _ in two]
    for rows, below in ((one, below_one), (two, below_two)):
        for i, row in enumerate(rows[1:], 1):
            below[row[1]].append(i)
    found = [(0, 0)]
    spots: list[tuple[int, int]] = [(0, 0)]
    own: list[tuple[int, int]] = []  # the range in found of each pair's pairs of children
    for a, b in found:
        begin = len(found)
        if below_one[a] and below_two[b]:
            by_label: dict[str, list[int]] = {}
            for j, y in enumerate(below_two[b]):
                by_label.setdefault(two[y][0], []).append(j)
            for i, x in enumerate(below_one[a]):
                for j in reversed(by_label.get(one[x][0], ())):
                    found.append((x, below_two[b][j]))
                    spots.append((i, j))
        own.append((begin, len(found)))
    weight = [1] * len(found)
    chosen: list[list[int]] = [[] for _ in found]
    for k in range(len(found) - 1, -1, -1):
        begin, end = own[k]
        if end - begin == 1:
            weight[k] += weight[begin]
            chosen[k] = [begin]
        elif end > begin:
            weight[k] += _heaviest_chain(begin, end, spots, weight, len(below_two[found[k][1]]), chosen[k])
    pairs, todo = [], [0]
    while todo:
        k = todo.pop()
        pairs.append(found[k])
        todo += chosen[k]
    return pairs


def _heaviest_chain(begin: int, end: int, spots: list[tuple[int, int]], weight: list[int], width: int, out: list[int]) -> int:
    """Put the pairs of a heaviest chain, increasing on both sides, into ``out``: its weight. Pairs come by (i, -j)."""
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)  # a tree of prefix maxima over j: (weight, last pair)
    before: dict[int, int] = {}
    top = (0, -1)
    for k in range(begin, end):
        j, so_far = spots[k][1], (0, -1)
        while j:
            so_far = max(so_far, best[j])
            j &= j - 1
        before[k] = so_far[1]
        here = (so_far[0] + weight[k], k)
        top = max(top, here)
        j = spots[k][1] + 1
        while j <= width:
            best[j] = max(best[j], here)
            j += j & -j
    k = top[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return top[0]


def main_text(page: Page, fixed: set[int], outside: set[str]) -> str:
    """The slots' blocks, one a line: what is neither the host's template nor marked as something else.

    ``fixed`` are the elements whose own text is the host's template, ``outside`` the labels that the host uses
    outside articles. A box goes when all its text is template, or its own and most of it; a paragraph, list or table
    only when that text has ``FLOW_WORDS`` words, as shorter ones recur by chance; headings, items and cells go with
    what holds them. Among the slots left, those in articles, main parts or, without these around them, content parts are the
    text where a page has any.
    """
    n = len(page.tags)
    out_of_place, inner, around = [False] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        around[i] = around[i] or page.tags[i] in ("article", "main") or page.marks[i][2] == "main"
        around[page.parents[i]] = around[page.parents[i]] or around[i]
    for i in range(1, n):
        p = page.parents[i]
        inner[i] = inner[p] or page.tags[p] in ("article", "main") or page.marks[p][2] == "main" or (
            page.tags[p] in ("div", "section", "td") and not page.marks[p][1].isdisjoint(CONTENT_WORDS))
        role = page.marks[i][2]
        out_of_place[i] = (out_of_place[page.parents[i]] or page.tags[i] in DROPPED or role in DROPPED_ROLES or role == "hidden"
                           or _marked(page, i, outside, inner[i] or around[i]))
    sizes, constant, counts = [0] * n, [0] * n, [0] * n
    for i, text in page.events:
        if text is not None and not out_of_place[i]:
            letters = len(text.strip())
            sizes[i] += letters
            if letters and i in fixed:
                constant[i] += letters
                counts[i] += len(text.split())
    holds_block = [False] * n
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        sizes[p] += sizes[i]
        constant[p] += constant[i]
        counts[p] += counts[i]
        holds_block[p] = holds_block[p] or holds_block[i] or page.tags[i] in BLOCK
    parts = _parts(page, sizes, out_of_place)
    inside = [not parts] * n
    for i in range(1, n):
        inside[i] = inside[page.parents[i]] or i in parts
    if not parts:
        for i in range(1, n):
            outer = page.tags[i] == "header" or not page.marks[i][1].isdisjoint(OUTER_WORDS)
            out_of_place[i] = out_of_place[i] or out_of_place[page.parents[i]] or outer
    gone, silent = [False] * n, [False] * n
    for i in range(1, n):
        gone[i] = gone[page.parents[i]]
        if gone[i] or not constant[i] or page.tags[i] not in BLOCK or page.tags[i] in HELD or counts[i] < FLOW_WORDS and page.tags[i] in FLOW and not page.marks[i][3]:
            continue
        gone[i] = constant[i] == sizes[i] or i in fixed and 2 * constant[i] >= sizes[i]
        silent[i] = i in fixed and holds_block[i]
    if any(text is not None and inside[i] and not out_of_place[i] and not gone[i] and not silent[i] and text.strip() for i, text in page.events):
        out_of_place = [a or b for a, b in zip(out_of_place, gone)]
    else:
        silent = [False] * n
    blocks, current = [], []
    for i, text in page.events:
        if text is not None:
            if inside[i] and not out_of_place[i] and not silent[i]:
                current.append(text)
        elif page.tags[i] == "br":
            current.append(" ")
        else:
            if page.tags[i] in BLOCK or i == 0:
                _flush(blocks, current)
    _flush(blocks, current)
    return "\n".join(blocks)


def _parts(page: Page, sizes: list[int], out_of_place: list[bool]) -> set[int]:
    """Elements that hold the text: articles and main parts, the outermost ones, and content parts apart from them."""
    n = len(page.tags)
    strong = [bool(sizes[i]) and not out_of_place[i] and (page.tags[i] in ("article", "main") or page.marks[i][2] == "main") for i in range(n)]
    weak = [bool(sizes[i]) and not out_of_place[i] and page.tags[i] in ("div", "section", "td")
            and not page.marks[i][1].isdisjoint(CONTENT_WORDS) for i in range(n)]
    around = strong[:]
    for i in range(n - 1, 0, -1):
        around[page.parents[i]] = around[page.parents[i]] or around[i]
    parts: set[int] = set()
    within = [False] * n
    for i in range(1, n):
        within[i] = within[page.parents[i]]
        if not within[i] and (strong[i] or weak[i] and not around[i]):
            parts.add(i)
            within[i] = True
    return parts


def _marked(page: Page, i: int, outside: set[str], inner: bool) -> bool:
    """Whether an element's class, id or itemprop says that it is something else.

    Part of a token counts only outside articles (not ``inner``), or where the host has the label outside articles;
    an id never counts on elements that often have one made from their text.
    """
    dropped = page.marks[i][3]
    if not dropped:
        return False
    titled = page.tags[i] in TITLED
    if "C" in dropped or "I" in dropped and not titled:
        return True
    if "c" in dropped and f"{page.tags[i]}.{page.marks[i][0]}" in outside:
        return True
    return not inner and not titled


def _flush(blocks: list[str], current: list[str]) -> None:
    if current:
        line = " ".join("".join(current).split())
        if line:
            blocks.append(line)
        current.clear()


TREES = "host string, longest int, tree string"
RESULT = "page_id long, url string, text string, n_chars long"


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_templates(pages: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """``host, tree, constant``: each host's page that others are aligned with, and its texts that are template.

    Every page is aligned with its host's; a text of a row is template when it is in that row on ``share`` of the
    host's pages, ``least`` at least. Pages with the same longest text are copies of each other and count as one page;
    hosts with fewer than ``least`` have no template and no row here. Only trees, not pages, are shuffled, and counts are aggregated
    before. A text is given as its row times 2^32 plus its hash.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest, trees = [], []
            for html in clean(batch.column("html")):
                page = Page(html)
                longest.append(_longest(page))
                trees.append(json.dumps(group_tree(page)[0], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(longest, pa.int32()), pa.array(trees, pa.string())],
                                             ["host", "longest", "tree"])

    trees = pages.select(_host().alias("host"), "html").mapInArrow(parse, TREES)
    trees = saved(trees.groupBy("host", "longest").agg(F.min("tree").alias("tree")))
    chosen = trees.groupBy("host").agg(F.min_by("tree", F.struct(F.xxhash64("tree"), F.col("tree"))).alias("chosen"), F.count("*").alias("pages"))
    chosen = saved(chosen.where(F.col("pages") >= least))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            for host, tree, base in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "chosen"))):
                one, two = json.loads(tree), json.loads(base)
                for i, j in tree_match(one, two):
                    for h in set(one[i][2]).intersection(two[j][2]):
                        counts[host, (j << 32) + h] = counts.get((host, (j << 32) + h), 0) + 1
            if len(counts) > 200_000:
                yield _count_rows(counts)
                counts = {}
        yield _count_rows(counts)

    # a host's trees are dealt to parts, so that a host with a third of all pages is no single task's work
    part = F.pmod(F.xxhash64("longest"), F.lit(64)).alias("part")
    copies = chosen.join(trees.select("host", part).distinct(), "host").select("host", "part", "chosen")
    counted = trees.withColumn("part", part).join(copies, ["host", "part"]).select("host", "tree", "chosen").mapInArrow(align, "host string, item long, n long")
    counted = counted.groupBy("host", "item").agg(F.sum("n").alias("n"))
    constant = counted.join(chosen.select("host", "pages"), "host").where((F.col("n") >= least) & (F.col("n") >= F.col("pages") * share))
    rows = constant.groupBy("host").agg(F.collect_set("item").alias("constant"))
    templates = saved(chosen.join(rows, "host", "left").select("host", F.col("chosen").alias("tree"), "constant"))
    discard(trees, chosen)
    return templates


def _longest(page: Page) -> int:
    """A hash of the longest text between two marks, the first of these; scripts and styles don't count."""
    texts = (" ".join(t.split()) for i, t in page.events if t is not None and page.tags[i] not in RAW)
    return zlib.crc32(max(texts, key=len, default="").encode("utf-8", "surrogatepass")) - (1 << 31)


def outer_labels(tree: list[list]) -> set[str]:
    """Labels with a class that a tree uses outside articles and main parts."""
    inner, found = [False] * len(tree), set()
    for i, (label, parent, _) in enumerate(tree):
        tag, _, classes = label.partition(".")
        inner[i] = tag in ("article", "main") or parent >= 0 and inner[parent]
        if classes and not inner[i]:
            found.add(label)
    return found


def _count_rows(counts: dict[tuple[str, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in counts], pa.string()), pa.array([j for _, j in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
        ["host", "item", "n"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: the main text of its whole html.

    Blocks are in page order, one a line, white space inside a block is one blank, character references are decoded;
    menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out. A null
    html is empty; a page without text gives an empty text; pages without a host share one wrapper; repeated rows and
    null ids are kept; markup that is cut off ends with the page; an empty table gives no rows; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[str, tuple[list, set[str]]] = {}
        for batch in batches:
            texts = []
            for html, tree, constant in zip(clean(batch.column("html")), batch.column("tree").to_pylist(), batch.column("constant").to_pylist()):
                page = Page(html)
                fixed: set[int] = set()
                base, outside = bases.get(tree, ([], set()))
                if tree is not None and not base:
                    base = json.loads(tree)
                    outside = outer_labels(base)
                    if len(bases) < 1000:
                        bases[tree] = base, outside
                if constant:
                    rows, row_of, hashes = group_tree(page)
                    known, at = set(constant), dict(tree_match(rows, base))
                    fixed = {i for i, h in enumerate(hashes) if h and row_of[i] in at and (at[row_of[i]] << 32) + h in known}
                texts.append(main_text(page, fixed, outside))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    return rows.join(host_templates(pages), "host", "left").select("page_id", "url", "html", "tree", "constant").mapInArrow(run, RESULT)
