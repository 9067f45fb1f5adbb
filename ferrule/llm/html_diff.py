"""Main text of web pages by differencing each page against its neighbour by URL.

Pages are range-partitioned and sorted by host and path, so a site of any size is spread over tasks and a page's nearest neighbours by URL lie
next to it. Each page is cut into lines (the text of a block). Pages in a row with the same html are copies and count as one: they are no
template of each other. Each is paired with the neighbour of its host whose path shares the longest beginning. If the two share four fifths of
their lines they are either near copies or pages of little more than a template, and further neighbours (two before, two after) tell which: if one shares less, that one is
taken. If all share as much, what all of them share is template, unless the rest is an edited form of a neighbour's rest, as in copies. Two pages alone that share as much
count as copies. At an edge of a partition neighbours lie in the next ones: the pages at the edges meet in a second, small step, so results do not depend on the partitions.

The lines of a page and its neighbour are aligned by a longest common subsequence, and shared lines are deleted: what two pages of a site have
in common is its template. Markup decides where differencing alone can't:
- A line that stands in the page's declared article (article, main) stays. Quoted passages and revised copies are shared as well, and
  differencing alone would lose them.
- A line that the neighbour doesn't share goes if it stands in an element that is no part of an article (menus, headers, footers, sidebars,
  notices, adverts, forms, comments): these may differ from page to page.
- A page without a neighbour keeps its declared article, or else all that isn't set apart by markup.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by two line feeds.

Defined results: a null or empty html gives the empty text. A null url counts as a host of its own. Repeated rows and equal urls stay, each with
its text. Of neighbours with equally long beginnings the one before counts. Markup that is cut off at the end of the page is dropped. A very long page
is read whole, in its row; the alignment takes memory in proportion to its lines. An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import table

ARTICLE, BODY, OTHER = 0, 1, 2
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|xmp|noembed|noframes)\b[^>]*(?:>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that never hold the article.
APART = {"nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "iframe", "object", "select", "button", "dialog", "menu", "canvas", "audio", "video", "head", "header"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "caption", "tbody", "thead", "tfoot", "tr", "ul", "noscript", "template",
}
#: Words in classes, ids and roles.
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navigation navbar menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside footer header masthead contentinfo complementary comment comments commentlist reply replies disqus "
    "respond responses discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget widgets skip copyright dialog alertdialog".split()
)
#: Those that say so at the end of any name outside of an article, as in "shop-navigation".
ENDS = set("ad ads advert adverts advertisement banner cookies nav navigation navbar menu breadcrumb breadcrumbs sidebar footer masthead comments newsletter popup pagination toolbar".split())
#: Words that may follow one of these, as in "footer-links" or "comment-list"; other words name what the text is about.
FORMS = set("area bar block body bottom box button buttons col column container content group holder icon inner item items left link links list main outer panel placement post posts region right row section slot thread top unit wrap wrapper".split())
#: Words that may stand before one of these: what the part belongs to.
OF = set("site page main top left right post article entry user reader blog global primary secondary sub mobile".split())
#: What readers write, where it is said that readers did.
READERS, WRITTEN = set("user users reader readers customer customers visitor visitors".split()), set("reviews feedback opinions".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def names_apart(name: str, inside: bool = False) -> bool:
    """Whether a class, id or role is such a word, alone or with words of form ("cookie-notice", "footer-links") or of what it belongs to ("site-header").

    Other words say what a part is about, as in "share-price-news" or "how-to-search", so inside an article such a name sets nothing apart; elsewhere some words do at the end of any name.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in ("has", "no", "not", "with", "without", "non", "is"):
        return False
    while len(words) > 1 and words[-1] in FORMS:
        words.pop()
    if words[-1] in WRITTEN and words[0] in READERS:
        return True
    return words[-1] in WORDS and all(w in WORDS or w in FORMS or w in OF for w in words[:-1]) or not inside and words[-1] in ENDS


def set_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of the article; inside: it stands in a declared article, whose own header is kept."""
    if tag in APART and not (inside and tag == "header"):
        return True
    if not attributes or tag in ("html", "body") or tag in HEADINGS and inside:
        return False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role"):
            if any(names_apart(one, inside) and not (inside and one.lower().endswith("header")) for one in value.split()):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """Lines of text with the place where each stands: ARTICLE, BODY or OTHER."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, set apart, declares the article
    apart = declared = 0
    text: list[str] = []

    def close_line():
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, OTHER if apart else ARTICLE if declared else BODY))

    def pop_to(k: int):
        nonlocal apart, declared
        while len(stack) > k:
            _, a, d = stack.pop()
            apart -= a
            declared -= d

    for m in TOKEN.finditer(page):
        plain = m[5]
        if plain is not None:
            text.append(plain)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if tag in BLOCK:
            close_line()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[1] for s in stack[k:]) and tag not in BLOCK:
                        close_line()
                    pop_to(k)
                    break
            continue
        if tag in BLOCK or tag == "li":
            # A block ends an open paragraph; an item ends the item before it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dt", "dd", "tr"):
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in VOID or m[4].endswith("/"):
            continue
        a = set_apart(tag, m[4], declared > 0)
        d = not a and not apart and (tag in ("article", "main") or 'role="main"' in m[4])
        if a and tag not in BLOCK and not apart:
            close_line()
        stack.append((tag, a, d))
        apart += a
        declared += d
    close_line()
    return out


#: Bits that an alignment holds at once.
BITS = 1 << 25


def _lengths(x: list, y: list) -> list[int]:
    """The length of the longest common subsequence of x with each beginning of y."""
    at: dict = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    ones = s = (1 << len(y)) - 1
    for v in x:
        u = s & at.get(v, 0)
        s = ((s + u) | (s - u)) & ones
    out, n = [0], 0
    for c in reversed(f"{s:0{len(y)}b}" if y else ""):
        n += c == "0"
        out.append(n)
    return out


def _aligned(x: list, y: list, i0: int, j0: int, out: list[tuple[int, int]], bits: int) -> None:
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > bits:
        # Halves, by where the two parts' lengths add up to the most (Hirschberg): memory in proportion to the lines.
        mid = len(x) // 2
        a, b = _lengths(x[:mid], y), _lengths(x[mid:][::-1], y[::-1])
        j = max(range(len(y) + 1), key=lambda k: a[k] + b[len(y) - k])
        _aligned(x[:mid], y[:j], i0, j0, out, bits)
        _aligned(x[mid:], y[j:], i0 + mid, j0 + j, out, bits)
        return
    at: dict = {}
    for j, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << j
    # rows[i]: after i lines of x, a bit is 0 where the subsequence grows with y.
    ones = (1 << len(y)) - 1
    rows = [ones]
    for v in x:
        s = rows[-1]
        u = s & at.get(v, 0)
        rows.append(((s + u) | (s - u)) & ones)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1


def common(a: list, b: list, bits: int = BITS) -> dict[int, int]:
    """A longest common subsequence: positions in a, with their partners in b."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    _aligned(a[head : len(a) - tail], b[head : len(b) - tail], head, head, found, bits)
    return dict(found)


def shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearly_all(own: list, other: list, shared: dict) -> bool:
    return 5 * len(shared) >= 4 * max(len(own), len(other))


def edited(own: list[tuple[str, int]], other: list[tuple[str, int]], shared: dict[int, int]) -> bool:
    """Whether what a page doesn't share says what the other's rest says: half of its words or more, each as often. A page that shares all of its lines says nothing else."""
    partners = set(shared.values())
    mine = Counter(w for i, (line, _) in enumerate(own) if i not in shared for w in line.split())
    theirs = Counter(w for i, (line, _) in enumerate(other) if i not in partners for w in line.split())
    return 2 * (mine & theirs).total() >= mine.total()


def template(own: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> set[int] | None:
    """The lines of a page that its neighbours, the nearest first, show to be template; None if there is no page to tell by."""
    alike = []
    for lines in others:
        shared = common([x[0] for x in own], [x[0] for x in lines])
        if not nearly_all(own, lines, shared):
            return set(shared)
        alike.append((lines, shared))
    if len(alike) < 2 or any(edited(own, lines, shared) for lines, shared in alike):
        return None
    return set.intersection(*(set(shared) for _, shared in alike))


def main_text(own: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> str:
    """The lines that stay of a page, given the lines of its neighbours, the nearest first."""
    shared = template(own, others)
    if shared is None:
        declared = any(z == ARTICLE for _, z in own)
        keep = [line for line, z in own if z == ARTICLE or z == BODY and not declared]
    else:
        keep = [line for i, (line, z) in enumerate(own) if z == ARTICLE or z == BODY and i not in shared]
    return "\n\n".join(keep)


class _Lines:
    """The lines of some runs, each read when it is its turn."""

    def __init__(self, found: list[Run]):
        self.found = found

    def __iter__(self):
        return (x.lines() for x in self.found)


class Run:
    """Pages in a row with the same html: their ids and urls, and the host and path of the first."""

    def __init__(self, host, path, html, members=()):
        self.host, self.path, self.html, self.members = host, path, html, list(members)
        self._lines: list | None = None

    def lines(self) -> list[tuple[str, int]]:
        if self._lines is None:
            self._lines = lines_of(self.html or "")
        return self._lines

    def texts(self, before: list[Run], after: list[Run]) -> Iterator[tuple]:
        """before, after: up to two runs each, the next one first."""
        near = [(k, -shared_start(self.path, o.path), side, o) for side, runs_ in enumerate((before, after)) for k, o in enumerate(runs_) if o.host == self.host]
        text = main_text(self.lines(), _Lines([o for *_, o in sorted(near, key=lambda x: x[:3])]))
        for page, url in self.members:
            yield page, url, text, len(text)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """page_id, url, html, host, path, in order."""
    run = None
    for b in batches:
        for page, url, source, host, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
            html = source.as_py()
            if run is None or run.host != host or run.html != html:
                if run is not None:
                    yield run
                run = Run(host, path, html)
            run.members.append((page, url))
    if run is not None:
        yield run


OUT = "page_id long, url string, text string, n_chars long"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of all runs of a sorted partition but the first two and the last two; five runs are held at a time."""
    rows: list[tuple] = []
    held: list[Run] = []
    for run in runs(batches):
        held.append(run)
        if len(held) == 5:
            for row in held[2].texts([held[1], held[0]], held[3:]):
                rows.append(row)
                if len(rows) >= 512:
                    yield _out(rows)
                    rows = []
            del held[0]
    if rows:
        yield _out(rows)


#: i: the number of the run among the partition's n; key: tells apart what it holds.
EDGE = "part int, i int, n int, key long, host string, path string, html string, pages array<long>, urls array<string>"
_EDGE = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("html", pa.string()), ("pages", pa.list_(pa.int64())), ("urls", pa.list_(pa.string()))])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first four and the last four runs of a sorted partition. Nothing is parsed here."""
    part = TaskContext.get().partitionId()
    ends: dict[int, Run] = {}
    n = 0
    for run in runs(batches):
        if n > 7:
            del ends[n - 4]
        ends[n] = run
        n += 1
    for i, r in ends.items():
        key = xxhash.xxh64_intdigest(f"{r.host}\n{r.html is None}\n{r.html}".encode()) - (1 << 63)
        yield pa.RecordBatch.from_pylist([{"part": part, "i": i, "n": n, "key": key, "host": r.host, "path": r.path, "html": r.html, "pages": [x[0] for x in r.members], "urls": [x[1] for x in r.members]}], schema=_EDGE)


MEET = "of_part int, of_i int, role int, part int, i int"


def _meet(table: pa.Table) -> pa.Table:
    """Which runs meet: for the first two and the last two runs of each partition (role 0) the two of other html before (1, 2) and after (3, 4), wherever they lie. Up to eight small rows for each partition."""
    ends = sorted(table.select(["part", "i", "n", "key"]).to_pylist(), key=lambda x: (x["part"], x["i"]))
    place = lambda x: (x["part"], x["i"])

    def along(at: int, step: int) -> Iterator[tuple]:
        """The next two runs; one that goes on over an edge is the same."""
        key, found = ends[at]["key"], 0
        at += step
        while 0 <= at < len(ends) and found < 2:
            if ends[at]["key"] != key:
                yield place(ends[at])
                key, found = ends[at]["key"], found + 1
            at += step

    rows = []
    for at, own in enumerate(ends):
        if own["i"] < 2 or own["i"] >= own["n"] - 2:
            met = [(0, place(own)), *enumerate(along(at, -1), 1), *enumerate(along(at, 1), 3)]
            rows += [(*place(own), role, *x) for role, x in met]
    return pa.table([pa.array(c, pa.int32()) for c in zip(*rows)] if rows else [pa.array([], pa.int32())] * 5, names=[x.split()[0] for x in MEET.split(", ")])


def _resolve(table: pa.Table) -> pa.Table:
    """Texts of a run at an edge, given its four neighbours (at most)."""
    at = {x["role"]: Run(x["host"], x["path"], x["html"], zip(x["pages"] or [], x["urls"] or [])) for x in table.to_pylist()}
    return pa.Table.from_batches([_out(list(at[0].texts([at[k] for k in (1, 2) if k in at], [at[k] for k in (3, 4) if k in at])))], _OUT)


def extract(pages: DataFrame, partitions: int | None = None, mb: int = 4) -> DataFrame:
    """page_id, url, text, n_chars. partitions: by default one for each `mb` megabytes of the planner's estimate, and at least as many as there are cores."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    keyed = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path")
    )
    if partitions is None:
        estimate = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partitions = int(min(1 << 20, max(pages.sparkSession.sparkContext.defaultParallelism, -(-estimate // (mb << 20)))))
    # A number that is given is kept by adaptive execution, and equal exchanges are done once, so all branches see the same partitions.
    if pages.sparkSession.conf.get("spark.sql.exchange.reuse") != "true":
        raise RuntimeError("spark.sql.exchange.reuse is needed: edges and insides of partitions must come from one shuffle")
    ordered = keyed.repartitionByRange(partitions, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    edges = ordered.mapInArrow(_edges, EDGE)
    meet = edges.select("part", "i", "n", "key", F.lit(0).alias("one")).groupBy("one").applyInArrow(_meet, MEET)
    met = meet.join(edges, ["part", "i"]).select("of_part", "of_i", "role", "host", "path", "html", *[F.when(F.col("role") == 0, F.col(c)).alias(c) for c in ("pages", "urls")])
    return ordered.mapInArrow(_inner, OUT).union(met.groupBy("of_part", "of_i").applyInArrow(_resolve, OUT))


def op9_nearest_url_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
