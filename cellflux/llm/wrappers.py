"""Main text of web pages by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over a page's tokens (tags and texts): it has no
alternatives, only sequences of elements, text slots, optional groups ``( )?`` and repeated groups
``( )+``.  It starts as one page's token stream and is aligned with the next page's again and again.
Where texts differ the slot becomes variable; where tags differ the shorter side's gap makes the
other side's elements optional; equal neighbours of one shape fold into one repeated group.  Aligning
is the same for a wrapper and a page as for two wrappers, so every task folds the pages it reads and
the tasks' wrappers are folded in three steps (by host and a salt of many values, of few, by host)
after equal ones are dropped: no task ever holds a host's pages.

The wrapper tells template from content: a slot with one text on several pages is the host's own, one
whose text varies and stands outside links is content.  The main region is the part of the wrapper
that holds most of the content; an article or main element is taken where it does, else the innermost
element that does, widened as long as that adds content alone.  A page is laid over its host's
wrapper, step by step down to the region: the elements aligned with it are the article, and their text
is taken whole but for menus, forms, adverts, notices and comments that their names or links tell.  A
page on which nothing is aligned with the region is judged by its own wrapper alone.

Null or empty html, and pages without text, give an empty text.  A null url belongs to the host ''.
Repeated pages give repeated rows; an empty table gives none; other columns, whatever their names, are
ignored.  Lists of more than ``MOST_CHILDREN`` different elements keep in the wrapper those that
most pages have, and long lists are aligned at elements that occur once in each; pages' texts are
always taken whole.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import _bitmap, _flagged
from .html_tree import Element, Text, parse
from .shared import frugal, named, written
from .urls import host_of

#: Hosts whose wrappers one task holds before it hands them on.
HOSTS_AT_ONCE = 2_000
SALTS = (256, 16)
#: Size up to which hosts and their rules are sent to all tasks, and salts of the join beyond it.
BROADCAST_BYTES, JOIN_SALTS = 32 << 20, 16
#: Pages with one text in a slot that make it the host's own.
LEAST_PAGES = 4
MOST_CHILDREN, CELLS = 512, 1 << 18
#: Parts of the content that a named region and an unnamed one must hold.
NAMED, INNERMOST = 0.5, 0.6
APART = frozenset("nav footer aside form menu dialog search fieldset legend #hidden head".split())
#: Class, id or role words of regions that are never the article, inside it or not.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay "
    "comment comments comment-list commentlist respond disqus replies reply".split()
)
#: Words of regions beside the article; inside it they count only where links make up much of the text.
BESIDE = frozenset(
    "promo promotion banner alert sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar topbar discussion share sharing social "
    "related recommended widget widgets contentinfo complementary search".split()
)
LINKED = 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are parts of running text, lists and tables and never a region by themselves.
PARTS = HEADINGS | frozenset("p li ul ol dl dt dd td th tr tbody thead tfoot table blockquote pre figure figcaption".split())

#: Elements of which neighbours are one group whatever they hold.
REPEATED = PARTS | {"article"}


def is_apart(tag: str, cues: tuple[str, ...], inside: bool, linked: float, titled: bool) -> bool:
    """Whether an element is not of the article; ``inside``: it stands in the main region."""
    if tag in APART or tag == "header" and not inside:
        return True
    if tag in ("body", "html", "article", "main", "#root"):
        return False
    for cue in cues:
        if cue in NEVER:
            return True
        if cue in BESIDE and (linked >= LINKED if inside else not titled):
            return True
        parts = cue.replace("_", "-").split("-")
        if len(parts) > 1 and (parts[0] in NEVER or parts[-1] in NEVER or parts[-1] in BESIDE) and (linked >= LINKED or not inside and not titled or parts[0] in ("ad", "ads", "comment", "comments")):
            return True
    return False


def _apart_on_page(node: Element, inside: bool) -> bool:
    return is_apart(node.tag, node.cues, inside, node.linked / max(1, node.chars), node.titled)


# --- wrappers: [key, mark, children, pages] with mark "" | "?" | "+" | "*"; a slot is [None, mark, crc or None, chars, linked, pages].
# The pages of a node are a lower bound where it is a repeated group.


def _slot(text: Text) -> list:
    return [None, "", zlib.crc32(text.text.encode()), len(text.text), min(text.linked, len(text.text)), 1]


def wrapper_of(node: Element) -> list:
    """The wrapper of one page: its tree with equal neighbours folded."""
    return [node.key, "", _folded([_slot(c) if isinstance(c, Text) else wrapper_of(c) for c in node.children]), 1]


def _repeats(mark: str) -> str:
    return {"": "+", "?": "*"}.get(mark, mark)


def _maybe(mark: str) -> str:
    return {"": "?", "+": "*"}.get(mark, mark)


def _either(a: str, b: str) -> str:
    out = _repeats(a) if "+" in (a, b) or "*" in (a, b) else a
    return _maybe(out) if "?" in (a, b) or "*" in (a, b) else out


def _shape(node: list) -> frozenset:
    return frozenset(c[0] for c in node[2]) if node[0] is not None else frozenset()


def _alike(a: list, b: list) -> bool:
    """Whether two neighbours are one group repeated."""
    return a[0] is not None and a[0] == b[0] and (a[0].split(".")[0] in REPEATED or _shape(a) == _shape(b))


def _folded(nodes: list) -> list:
    """Like neighbours, and groups of neighbours that occur again at once, become repeated."""
    out: list = []
    for node in nodes:
        if out and _alike(out[-1], node):
            mark = _repeats(out[-1][1])
            out[-1] = _joined(out[-1], node, False)
            out[-1][1] = mark
        else:
            out.append(node)
    for width in (2, 3, 4):
        at = 0
        while at + 2 * width <= len(out):
            if all(_alike(out[at + k], out[at + width + k]) for k in range(width)):
                for k in range(width):
                    mark = _repeats(out[at + k][1])
                    out[at + k] = _joined(out[at + k], out[at + width + k], False)
                    out[at + k][1] = mark
                del out[at + width : at + 2 * width]
            else:
                at += 1
    return out


def _joined(a: list, b: list, across: bool) -> list:
    """Two nodes of one key as one; ``across``: they are of different pages."""
    mark = _either(a[1], b[1])
    pages = a[-1] + b[-1] if across else max(a[-1], b[-1])
    if a[0] is None:
        return [None, mark, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], pages]
    return [a[0], mark, _aligned(a[2], b[2], across), pages]


def _weight(a: list, b: list) -> int:
    """What aligning two nodes is worth: 0 for other keys, up to 8 the more their children agree."""
    if a[0] != b[0]:
        return 0
    if a[0] is None:
        return 8
    x, y = _shape(a), _shape(b)
    return 8 if x == y else 4 + 4 * len(x & y) // len(x | y)


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of an alignment of greatest total weight; exact up to CELLS cells, beyond them between
    anchors: keys that occur once in either list, in their longest common order."""
    head = 0
    while head < min(len(a), len(b)) and _weight(a[head], b[head]) == 8:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _weight(a[-1 - tail], b[-1 - tail]) == 8:
        tail += 1
    out = [(k, k) for k in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) <= CELLS:
        out += [(head + i, head + j) for i, j in _heaviest(x, y)]
    else:
        once = [{k: p for k, p in ((n[0], p) for p, n in enumerate(z)) if c[k] == 1} for z, c in ((z, Counter(n[0] for n in z)) for z in (x, y))]
        both = sorted((p, once[1][k]) for k, p in once[0].items() if k in once[1])
        i = j = 0
        for p, q in [*_rising(both), (len(x), len(y))]:
            if (p - i) * (q - j) <= CELLS:
                out += [(head + i + m, head + j + n) for m, n in _heaviest(x[i:p], y[j:q])]
            if p < len(x):
                out.append((head + p, head + q))
            i, j = p + 1, q + 1
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by first, whose seconds rise."""
    ends: list[int] = []
    links: list[tuple] = []
    for p, q in pairs:
        at = bisect_left(ends, q)
        link = (p, q, links[at - 1] if at else None)
        ends[at : at + 1], links[at : at + 1] = [q], [link]
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _heaviest(a: list, b: list) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    weight = [[_weight(x, y) for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own = best[i], best[i + 1], weight[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + own[j] if own[j] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list, b: list, across: bool) -> list:
    """Two sequences as one; what only one has is optional."""
    out, i, j = [], 0, 0
    for p, q in [*_matches(a, b), (len(a), len(b))]:
        out += [[x[0], _maybe(x[1]), *x[2:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_joined(a[p], b[q], across))
        i, j = p + 1, q + 1
    out = _folded(out)
    if len(out) > MOST_CHILDREN:
        least = sorted((x[-1] for x in out), reverse=True)[MOST_CHILDREN]
        out = [x for x in out if x[-1] > least] or out[:MOST_CHILDREN]
    return out


def _times(node: list, n: int) -> list:
    """The wrapper of n times as many pages, all alike."""
    if node[0] is None:
        return [*node[:3], node[3] * n, node[4] * n, node[5] * n]
    return [node[0], node[1], [_times(c, n) for c in node[2]], node[3] * n]


def _totals(node: list) -> tuple[int, int, bool]:
    """Characters, those in links, and whether there is an h1."""
    if node[0] is None:
        return node[3], node[4], False
    parts = [_totals(c) for c in node[2]]
    return sum(p[0] for p in parts), sum(p[1] for p in parts), node[0].split(".")[0] == "h1" or any(p[2] for p in parts)


def region_of(wrapper: list) -> list | None:
    """The way to the main region, from the wrapper's root down: for each step the key and shape of
    all siblings, and the place among them; None where there is no content."""
    content: dict[tuple, int] = {}
    own: dict[tuple, int] = {}  # template and link text in each node
    nodes: dict[tuple, list] = {}

    def walk(node: list, place: tuple, inside: bool) -> tuple[int, int]:
        if node[0] is None:
            if node[2] is not None and node[5] >= LEAST_PAGES:
                return 0, node[3]
            return max(0, node[3] - 2 * node[4]), min(node[3], 2 * node[4])
        tag, *cues = node[0].split(".")
        chars, linked, titled = _totals(node)
        if is_apart(tag, tuple(cues), inside, linked / max(1, chars), titled):
            return 0, 0
        nodes[place] = node
        both = [walk(c, (*place, k), inside or tag in ("article", "main")) for k, c in enumerate(node[2])]
        content[place], own[place] = sum(x for x, _ in both), sum(y for _, y in both)
        return content[place], own[place]

    total, _ = walk(wrapper, (), False)
    if not total:
        return None
    tag = {p: n[0].split(".")[0] for p, n in nodes.items()}
    marked = [p for p in nodes if tag[p] in ("article", "main") and content[p] >= NAMED * total]
    if marked:
        region = min(marked, key=len)
    else:
        region = max((p for p in nodes if content[p] >= INNERMOST * total), key=len)
        while region and (tag[region] in PARTS or own[region[:-1]] <= own[region]):
            region = region[:-1]
    way, now = [], wrapper
    for k in region:
        way.append([[[c[0], sorted(x or "" for x in _shape(c))] for c in now[2]], k])
        now = now[2][k]
    return way


def regex_text(wrapper: list) -> str:
    """The wrapper as a readable union-free regular expression."""
    if wrapper[0] is None:
        return ("#TEXT" if wrapper[2] is None else f"'{wrapper[2]:08x}'") + wrapper[1]
    inner = f"<{wrapper[0]}>" + "".join(map(regex_text, wrapper[2])) + f"</{wrapper[0].split('.')[0]}>"
    return f"({inner}){wrapper[1]}" if wrapper[1] else inner


def _groups(items: list[tuple[str | None, frozenset]]) -> list[tuple[list, list[int]]]:
    """What ``_folded`` makes of a page's children, told by key and shape: nodes, and whose they are."""
    out: list[tuple[list, list[int]]] = []

    def put(at: int, node: list, members: list[int]) -> None:
        out[at] = ([node[0], "", [[x] for x in _shape(out[at][0]) | _shape(node)]], out[at][1] + members)

    for k, (key, shape) in enumerate(items):
        node = [key, "", [[x] for x in shape]]
        if out and _alike(out[-1][0], node):
            put(-1, node, [k])
        else:
            out.append((node, [k]))
    for width in (2, 3, 4):
        at = 0
        while at + 2 * width <= len(out):
            if all(_alike(out[at + k][0], out[at + width + k][0]) for k in range(width)):
                for k in range(width):
                    put(at + k, *out[at + width + k])
                del out[at + width : at + 2 * width]
            else:
                at += 1
    return out


def _follow(root: Element, way: list) -> list[Element]:
    """The page's elements of the region, in page order: at each step its children are aligned with
    those of the wrapper."""
    now = [root]
    for siblings, place in way:
        wanted = [[key, "", [[x or None] for x in shape]] for key, shape in siblings]
        below = []
        for node in now:
            groups = _groups([(None, frozenset()) if isinstance(c, Text) else (c.key, frozenset(getattr(x, "key", None) for x in c.children)) for c in node.children])
            for p, q in _matches(wanted, [g for g, _ in groups]):
                if p == place:
                    below += [node.children[m] for m in sorted(groups[q][1])]
        now = below
    return now


def main_text(page: str | None, way: list | None) -> str:
    """The main text of one page of a host with this way to the region."""
    if not page:
        return ""
    root = parse(page)
    found = _follow(root, way) if way is not None else []
    if not sum(node.chars for node in found):
        own = region_of(wrapper_of(root))
        found = _follow(root, own) if own is not None else [root]
    out: list[str] = []
    for top in found:
        stack = top.children[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, Text):
                out.append(node.text)
            elif not _apart_on_page(node, True):
                stack += node.children[::-1]
    return " ".join(out)


def _json(wrapper: list | None) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


_SCHEMA = "host string, wrapper string, pages long"


def _host_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "wrapper", "pages"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            wrapper = wrapper_of(parse(page.as_py() or ""))
            old = held.get(host)
            held[host] = [wrapper, 1] if old is None else [_joined(old[0], wrapper, True), old[1] + 1]
            if len(held) >= HOSTS_AT_ONCE:
                yield _host_rows([(h, _json(w), n) for h, (w, n) in held.items()])
                held.clear()
    if held:
        yield _host_rows([(h, _json(w), n) for h, (w, n) in held.items()])


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, wrapper, pages, times) sorted by host: one row per host, folded as they stream by."""
    host, wrapper, pages = None, None, 0
    for batch in batches:
        for h, w, n, times in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            new = json.loads(w) if times == 1 else _times(json.loads(w), times)
            if h == host:
                wrapper, pages = _joined(wrapper, new, True), pages + n
            else:
                if host is not None:
                    yield _host_rows([(host, _json(wrapper), pages)])
                host, wrapper, pages = h, new, n
    if host is not None:
        yield _host_rows([(host, _json(wrapper), pages)])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages) for every host, from all of its pages."""
    now = pages.select(host_of(named(url_col)).alias("host"), named(html_col).alias("html")).mapInArrow(frugal(_fold), _SCHEMA)
    now = now.groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"), F.count("*").alias("times"))
    for salts in SALTS:
        salted = now.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).repartition("host", "salt").sortWithinPartitions("salt", "host", "wrapper")
        now = _by_salt(salted)
    return now.repartition("host").sortWithinPartitions("host", "wrapper").select("host", "wrapper", "pages", "times").mapInArrow(frugal(_fold_rows), _SCHEMA)


def _by_salt(salted: DataFrame) -> DataFrame:
    """One row for each host and salt; rows of one partition are sorted by salt, then host."""
    keyed = salted.select(F.concat_ws(" ", "salt", "host").alias("host"), "wrapper", "pages", "times")
    done = keyed.mapInArrow(frugal(_fold_rows), _SCHEMA)
    return done.select(F.substring_index("host", " ", 1).alias("salt"), F.expr("substring(host, instr(host, ' ') + 1)").alias("host"), "wrapper", "pages", F.lit(1).cast("long").alias("times")).drop("salt")


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_json(region_of(json.loads(w))) for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "region"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list | None] = {}
    for batch in batches:
        if len(known) > 10_000:
            known.clear()
        out = []
        for page, region in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            if region not in known:
                known[region] = json.loads(region)
            out.append(main_text(page.as_py(), known[region]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def with_regions(rows: DataFrame, regions: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """Rows (id, url, html, host) with their host's region.  The most frequent region is a literal, so
    only the other hosts travel: to all tasks up to BROADCAST_BYTES, and beyond by a salted join that
    only the pages enter whose host a bitmap of fixed size does not rule out."""
    most = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    top = regions.groupBy("region").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").first()
    usual: Column = F.lit(top["region"] if top else "null")
    others = regions.where(F.col("region") != usual)
    size = others.agg(F.sum(F.octet_length("host") + F.octet_length("region") + 32).alias("n")).first()["n"] or 0
    columns = ["id", "url", "html"]
    if size <= most:
        return rows.join(F.broadcast(others), "host", "left").select(*columns, F.coalesce("region", usual).alias("region"))
    marked = _flagged(rows, _bitmap(others, "host"), "host")
    plain = marked.where("not hit").select(*columns, usual.alias("region"))
    salted = marked.where("hit").withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(JOIN_SALTS)).cast("int"))
    many = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    joined = salted.join(many, ["host", "salt"], "left").select(*columns, F.coalesce("region", usual).alias("region"))
    return plain.unionByName(joined)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url and the whole main text."""
    regions = written(infer_wrappers(pages, url_col, html_col).mapInArrow(frugal(_regions), "host string, region string"), "regions")
    rows = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), named(html_col).alias("html"), host_of(named(url_col)).alias("host"))
    kind = pages.schema[id_col].dataType.simpleString()
    return with_regions(rows, regions).mapInArrow(frugal(_extract), f"id {kind}, url string, text string").toDF(id_col, url_col, "text")
