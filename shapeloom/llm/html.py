"""Main text of web pages by wrappers: union-free regular expressions that are inferred from the pages of a host.

A page becomes a tree of tags and text slots, which is its token stream with matching tags paired. Sibling groups
that repeat are folded into one repeated group. Two trees are aligned child by child: what has no partner becomes
optional, equal texts stay constant and others become slots. Tasks fold the pages they read into one wrapper a host,
and these are folded again, so a host of any number of pages moves one small wrapper for each task. The wrapper says
which region holds what varies over the host's pages, and each page is read with its host's.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter, OrderedDict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .store import written

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|canvas|object|title)\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</\1\s*>|\Z)"""
    r"""|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Tags and class words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = set("head nav footer aside menu button input label".split())
CONTAINERS = set("html body main article section div center table tbody tr td form fieldset".split())
HINTS = set("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside cookie cookies consent gdpr notice alert newsletter subscribe signup share sharing social related recommended comment comments disqus respond popup modal overlay widget pagination pager login search toolbar skip contentinfo complementary".split())
#: Words that leave a class name of hints what it is: "site-footer" and "related-posts", but not "related-work" or "has-sidebar".
PLAIN = set("site page top bottom left right main primary secondary box list bar wrap wrapper container block section area inner outer slot item items link links header text row col column unit message msg post posts article articles form buttons icons".split())
_CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
#: The other way round: what a tag closes.
_CLOSES = {tag: [x for x, by in _CLOSED_BY.items() if tag in by] for tag in set().union(*_CLOSED_BY.values())}
_INLINE_STOP = {"article", "section", "div", "body", "main", "nav", "table", "td", "ul", "ol", "footer", "header", "aside", "form"}
#: Marks of an element: text, evidence of something else (a class word, a form), or a tag that says so.
TEXT, HINTED, TAGGED = 0, 1, 2


def _hinted(token: str) -> bool:
    words = re.findall(r"[a-z]+", token)
    return any(w in HINTS for w in words) and all(w in HINTS or w in PLAIN for w in words)


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """tag.classes, and what the attributes say of the element; nothing of html, body, main and article."""
    words, mark = [], TEXT
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden":
            mark = HINTED
        elif name != "itemprop" or value == "articlebody":
            words += re.findall(r"[a-z]+", value)
            mark = HINTED if any(map(_hinted, value.split())) else mark
    return f"{tag}.{'-'.join(sorted(set(words)))}" if words else tag, TEXT if tag in ("html", "body", "main", "article") else mark


def events(html: str | None):
    """("open", tag, label, mark), ("void", tag, ...), ("close", tag, None, None), ("text", string, None, None), with every tag closed in order."""
    stack, at, html, articles = [], 0, html or "", 0
    # where each tag is open, and the elements that end a search for one; so no tag searches the stack
    places: dict[str, list[int]] = {}
    stops: list[int] = []

    def close(upto: int):
        nonlocal articles
        while len(stack) > upto:
            tag = stack.pop()
            articles -= tag == "article"
            places[tag].pop()
            if tag in _INLINE_STOP:
                stops.pop()
            yield "close", tag, None, None

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "text", html[at : m.start()], None, None
        at = m.end()
        tag = (m[3] or "").lower()
        if m[0].startswith("<![CDATA["):
            yield "text", m[0][9:].removesuffix("]]>").replace("&", "&amp;"), None, None
        if not tag or not m[0].endswith(">"):
            continue
        stop = stops[-1] if stops else 0
        if m[2]:
            k = last(tag)
            if k >= 0 and (k >= stop or tag in BLOCK and tag != "p"):
                yield from close(k)
        else:
            k = max(map(last, _CLOSES.get(tag, ())), default=-1)
            if k >= stop and k >= 0:
                yield from close(k)
            if tag in VOID:
                yield "void", tag, None, None
            else:
                label, mark = _label(tag, m[4] or "")
                mark = TAGGED if tag in CHROME or tag == "header" and not articles else HINTED if tag in ("form", "dialog") else mark
                places.setdefault(tag, []).append(len(stack))
                if tag in _INLINE_STOP:
                    stops.append(len(stack))
                stack.append(tag)
                articles += tag == "article"
                yield "open", tag, label, mark
    if at < len(html):
        yield "text", html[at:], None, None
    yield from close(0)


# A wrapper node is [label, quantifier, children, mark]; a text is ["#", quantifier, crc of a constant text or None, characters].


def tree(html: str | None) -> list:
    root = ["", "1", [], TEXT]
    stack = [root]
    for kind, tag, label, mark in events(html):
        if kind == "open":
            node = [label, "1", [], max(mark, stack[-1][3])]
            stack[-1][2].append(node)
            stack.append(node)
        elif kind == "close":
            stack.pop()
        elif kind == "text" and (text := " ".join(unescape(tag).split())):
            stack[-1][2].append(["#", "1", zlib.crc32(text.encode("utf-8", "replace")), len(text)])
    return root


def dumps(node: list) -> str:
    """A wrapper as lines, however deep: an element opens with its quantifier, mark and label and ends with a slash."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append("/")
        elif x[0] == "#":
            out.append(f"#{x[1]}{x[3]}{'' if x[2] is None else f' {x[2]}'}")
        else:
            out.append(f"<{x[1]}{x[3]}{x[0]}")
            todo.append(None)
            todo += reversed(x[2])
    return "\n".join(out)


def loads(text: str) -> list:
    top: list = []
    stack = [top]
    for line in text.split("\n"):
        if line == "/":
            stack.pop()
        elif line[0] == "#":
            size, _, crc = line[2:].partition(" ")
            stack[-1].append(["#", line[1], int(crc) if crc else None, int(size)])
        else:
            node = [line[3:], line[1], [], int(line[2])]
            stack[-1].append(node)
            stack.append(node[2])
    return top[0]


def _loose(a: str, b: str) -> str:
    """The quantifier that both fit."""
    low, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if low and many else "?" if low else "+" if many else "1"


def merge(a: list, b: list, repeat: bool = False, rounds: bool = False) -> list:
    """One node for two of the same label; repeat: as rounds of a repeated group rather than of two pages; rounds: inside of such. Unlike texts of rounds are one constant together, those of pages become a slot."""
    top: list = []
    home, rounds = top, rounds or repeat
    while True:  # down a chain of only children without a call
        q = _loose(_loose(a[1], b[1]), "+" if repeat else "1")
        if a[0] == "#":
            both = rounds and a[2] is not None and b[2] is not None
            home.append(["#", q, a[2] if a[2] == b[2] else zlib.crc32(f"{a[2]} {b[2]}".encode()) if both else None, a[3] + b[3]])
            return top[0]
        node = [a[0], q, [], max(a[3], b[3])]
        home.append(node)
        if len(a[2]) != 1 or len(b[2]) != 1 or a[2][0][0] != b[2][0][0]:
            node[2] = align(a[2], b[2], rounds)
            return top[0]
        a, b, repeat, home = a[2][0], b[2][0], False, node[2]


def fold(nodes: list) -> list:
    """Runs of one to three labels that come again right away become one repeated group."""
    for width in (1, 2, 3):
        out = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * width and all(out[-width + k][0] == out[-2 * width + k][0] for k in range(width)):
                rounds = [merge(x, y, True) for x, y in zip(out[-2 * width : -width], out[-width:])]
                out[-2 * width :] = rounds
        nodes = out
    return nodes


def _optional(node: list) -> list:
    return [node[0], _loose(node[1], "?"), *node[2:]]


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """Bit rows of the longest common subsequence: bit j of row i is 0 where b's place j lengthens what a[:i+1] and b[:j] have in common. keep: all rows, else the last."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
    return out if keep else [v]


def common(a: list, b: list, most_bits: int = 1 << 26) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in rows of bits; where these would take more than most_bits, a is halved first (Hirschberg), so memory stays bounded."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        x, y = a[i:p], b[j:q]
        if not set(x) & set(y):
            continue
        if len(x) * len(y) > most_bits and len(x) > 1:
            h = len(x) // 2
            front, back = _rows(x[:h], y, False)[0], _rows(x[:h - 1 if h else None:-1], y[::-1], False)[0]
            zeros = lambda v: [0, *_running(v, len(y))]
            f, r = zeros(front), zeros(back)
            cut = max(range(len(y) + 1), key=lambda k: f[k] + r[len(y) - k])
            todo += [(i, i + h, j, j + cut), (i + h, p, j + cut, q)]
            continue
        rows, s, t = _rows(x, y, True), len(x), len(y)
        while s and t:
            if rows[s - 1] >> (t - 1) & 1:
                t -= 1
            else:
                s -= 1
                if not (s and not rows[s - 1] >> (t - 1) & 1):
                    t -= 1
                    out.append((i + s, j + t))
    return sorted(out)


def _running(v: int, n: int) -> list[int]:
    """Zeros among the first 1, 2, ... n bits."""
    out, total = [], 0
    for c in reversed(format(v, f"0{n}b")):
        total += c == "0"
        out.append(total)
    return out


def align(a: list, b: list, rounds: bool = False) -> list:
    """The longest common order of labels; what has no partner becomes optional."""
    one, two = [x[0] for x in a], [x[0] for x in b]
    if one == two:
        return [merge(x, y, False, rounds) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*common(one, two), (len(a), len(b))]:
        out += [_optional(x) for x in a[i:p]] + [_optional(x) for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], False, rounds))
        i, j = p + 1, q + 1
    return fold(out)


def folded(node: list) -> list:
    """The tree with all repeated groups folded, from the leaves up."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x[2] if c[0] != "#"]
    for x in reversed(order):
        x[2] = fold(x[2])
    return node


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression."""
    q = "" if node[1] == "1" else node[1]
    if node[0] == "#":
        return f"({'#' if node[2] is None else 'text'}){q}"
    return f"(<{node[0]}>{''.join(map(expression, node[2]))}</{node[0]}>){q}"


def _step(path: int, label: str) -> int:
    """The path of a child, as a running checksum."""
    return zlib.crc32(label.encode("utf-8", "replace"), path)


def reading(node: list) -> dict:
    """How a host's pages are read, from its wrapper. region: labels of the article's elements; path: of the region where no such element is known.

    Elements named article or main (or marked as an article's body) are the region if something in them varies over
    the pages, or nothing varies anywhere; where several labels are so named and the one with the most text stands once
    on every page, the others are other articles' teasers and do not count. Else the region is the least element, repeated nowhere, that holds all that
    varies outside of marked elements; where nothing varies, as on a single page, it is the whole page.
    """
    order, todo, again, always = [], [(node, False, True)], {}, {}
    while todo:
        x, inside, must = todo.pop()
        order.append(x)
        again[id(x)], always[id(x)] = inside, must
        todo += [(c, inside or c[1] in "+*", must and c[1] == "1") for c in x[2] if c[0] != "#"]
    size: dict[int, int] = {}
    for x in reversed(order):
        size[id(x)] = sum(c[3] if c[0] == "#" else size[id(c)] for c in x[2])
    varies: dict[int, int] = {}
    for x in reversed(order):
        # what is optional in a repeated group need not differ from page to page
        gone = lambda c: int(c[1] in "?*" and not again[id(x)])  # noqa: B023, E731
        varies[id(x)] = sum(int(c[2] is None or gone(c) > 0) if c[0] == "#" else varies[id(c)] + (0 if c[3] else gone(c)) for c in x[2]) if x[3] == TEXT else 0
    named: dict[int, dict[str, bool]] = {1: {}, 2: {}}
    largest: dict[str, tuple[int, bool]] = {}
    for x in order:
        tag, _, words = x[0].partition(".")
        kind = 2 if tag == "article" or "articlebody" in words.split("-") else 1 if tag == "main" or "main" in words.split("-") else 0
        if kind and x[3] < TAGGED:
            named[kind][x[0]] = named[kind].get(x[0], False) or varies[id(x)] > 0 or x[3] == HINTED
            largest[x[0]] = max(largest.get(x[0], (0, False)), (size[id(x)], always[id(x)] and x[3] == TEXT))
    for kind in (2, 1):
        if named[kind] and (any(named[kind].values()) or not varies[id(node)]):
            best = max(sorted(named[kind]), key=lambda label: largest[label])
            alone = largest[best][1] and (named[kind][best] or not varies[id(node)])
            return {"region": [best] if alone else sorted(named[kind]), "path": None}
    path, total, deep = 0, varies[id(node)], 0
    while total:
        labels = Counter(c[0] for c in node[2])
        down = [c for c in node[2] if c[0] != "#" and c[1] == "1" and varies[id(c)] == total and labels[c[0]] == 1 and c[0].partition(".")[0] in CONTAINERS]
        if not down:
            break
        node, deep = down[0], deep + 1
        path = _step(path, node[0])
    return {"region": [], "path": path if deep else None}


def extract(html: str | None, how: dict) -> str:
    """The article's blocks, joined by two line ends.

    Marked elements are left out. Where the page's region lies only inside elements with a mark by evidence, or nothing
    else is left of the page, these marks are wrong and do not count. A page without the region is read whole.
    """
    region, wanted = set(how["region"]), how["path"]
    page, stack, holds, strict, loose = [], [(TEXT, 0, -1)], set(), False, False
    for kind, tag, label, mark in events(html):
        inside = False
        if kind == "open":
            above, path, _ = stack[-1]
            path = _step(path, label)
            inside = label in region or wanted is not None and path == wanted
            stack.append((max(above, mark), path, len(page)))
            if inside and above < TAGGED and mark < TAGGED:
                strict, loose = strict or max(above, mark) == TEXT, True
                for _, _, k in reversed(stack):
                    if k in holds or k < 0:
                        break
                    holds.add(k)
        elif kind == "close":
            stack.pop()
        page.append((kind, tag, mark, inside))

    def text(hints: bool, seen: bool) -> str:
        parts, open_ = [], [(False, not seen)]
        for k, (kind, tag, mark, inside) in enumerate(page):
            out, here = open_[-1]
            if kind == "open":
                drop = mark == TAGGED or mark == HINTED and hints and (strict or k not in holds)
                open_.append((out or drop, here or inside))
            elif kind == "close":
                open_.pop()
            if kind == "text":
                if here and not out:
                    parts.append(unescape(tag).replace("\0", ""))
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCK:
                parts.append("\0")
        blocks = (" ".join(b.split()) for b in "".join(parts).split("\0"))
        return "\n\n".join(b for b in blocks if b)

    return text(True, loose) or text(False, loose)


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _deep() -> None:
    """Python calls nest as deep as pages do; they take no machine stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def _combined(first: bool, most_hosts: int):
    def run(batches):
        _deep()
        held: OrderedDict[str, list] = OrderedDict()

        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in some], pa.string()), pa.array([v[0] for _, v in some], pa.int64()), pa.array([dumps(v[1]) for _, v in some], pa.string())], names=["host", "pages", "wrapper"])

        for whole in batches:
            for b in flat.slices(whole, "html" if first else "wrapper"):
                counts = [1] * b.num_rows if first else b.column("pages").to_pylist()
                for host, n, body in zip(b.column("host").to_pylist(), counts, b.column("html" if first else "wrapper").to_pylist()):
                    node = folded(tree(body)) if first else loads(body)
                    old = held.get(host)
                    # an empty page says nothing about the others
                    held[host] = [n, node] if old is None else [old[0] + n, merge(old[1], node) if old[1][2] and node[2] else node if node[2] else old[1]]
                    held.move_to_end(host)
                    if len(held) > most_hosts:
                        yield rows([held.popitem(last=False)])
        if held:
            yield rows(list(held.items()))

    return run


def wrappers(pages: DataFrame, most_hosts: int = 2000) -> DataFrame:
    """host, pages, wrapper (see dumps) of all hosts of pages(url, html). most_hosts: that a task holds at once; the least recent one is passed on early and folded in later."""
    schema = "host string, pages bigint, wrapper string"
    part = pages.select(_host("url").alias("host"), "html").mapInArrow(_combined(True, most_hosts), schema)
    # two rounds: a host that every task has seen meets in 32 tasks before it meets in one
    part = part.select("*", F.pmod(F.xxhash64("wrapper"), F.lit(32)).alias("salt")).repartition("host", "salt").drop("salt").mapInArrow(_combined(False, most_hosts), schema)
    return part.repartition("host").sortWithinPartitions("host").mapInArrow(_combined(False, 1), schema)


def expressions(pages: DataFrame) -> DataFrame:
    """host, pages, expression: the wrapper of each host as a regular expression."""

    def run(batches):
        _deep()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("pages"), pa.array([expression(loads(w)) for w in b.column("wrapper").to_pylist()], pa.string())], names=["host", "pages", "expression"])

    return wrappers(pages).mapInArrow(run, "host string, pages bigint, expression string")


def main_text(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """pages with text and n_chars.

    A null html is empty; a page without text gets an empty string. Pages with a null or odd url share the host "".
    Repeated rows count as pages of their host and get equal texts. Existing columns text and n_chars are replaced.
    """
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")])

    def read(batches):
        _deep()
        for b in batches:
            how = [json.dumps(reading(loads(w)), separators=(",", ":")) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(how, pa.string())], names=["__host", "__how"])

    how = written(wrappers(pages).mapInArrow(read, "__host string, __how string"), "wrappers")
    size = how.agg(F.sum(F.length("__how") + F.length("__host") + 40)).first()[0] or 0
    if size <= broadcast_bytes:
        x = pages.join(F.broadcast(how), _host("url") == F.col("__host"), "left").drop("__host")
    else:
        # the pages of one host are spread by salts
        how = how.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        x = pages.join(how, (_host("url") == F.col("__host")) & (F.pmod(F.xxhash64("html"), F.lit(32)) == F.col("__salt")), "left").drop("__host", "__salt")
    names = [c for c in x.columns if c != "__how"]

    def run(batches):
        known: dict[str, dict] = {}
        for whole in batches:
            for b in flat.slices(whole, "html"):
                texts = []
                for html, rule in zip(b.column("html").to_pylist(), b.column("__how").to_pylist()):
                    if len(known) > 10_000:
                        known.clear()
                    if rule not in known:
                        known[rule] = json.loads(rule) if rule else {"region": [], "path": None}
                    texts.append(extract(html, known[rule]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return x.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
