"""HTML extraction by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

Each page becomes a stream of block elements and text slots, in which neighbouring equal elements or groups are
folded into repeats. The distinct streams of a host are aligned one after the other: equal elements match, an
element that one side lacks becomes optional, neighbours that turn out equal become a repeated group, and texts
become slots. What comes out is the host's wrapper: an expression of elements, optionals, repeats and slots, without
unions. Every text of a page falls into a slot, and statistics of the slots over all pages of the host (texts,
characters, characters in links, one text or many) tell which ones hold the main text.

Rows that are aligned are distinct streams, counted before; a host with many of them is aligned in chunks of FOLD
streams, whose wrappers are aligned in turn. Pages themselves are parsed once and never gathered by host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, frugal, scratch, small_side, written

#: Streams or wrappers that a task aligns with each other.
FOLD = 256
#: Elements of a repeated group, at most; longer groups stay written out.
PERIOD = 8
#: Elements inside more than this many others are read as if they stood in the last of these.
DEPTH = 150
#: Cells of an alignment table; longer sequences are aligned by the next equal element.
CELLS = 1 << 20
#: Wrappers are sent to all tasks up to this many hosts.
BROADCAST_HOSTS = 2000
#: Outside an article, slots with more than this share of their characters in links are lists of links.
LINKS = 0.5
#: Outside an article, a text that stands on so many pages or more, and never changes, belongs to the template.
SAME = 3
#: Texts of this many characters on average count as prose.
PROSE = 60

#: Names of HTML elements.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
UNSEEN = {"noscript", "template", "object", "svg", "math", "canvas", "audio", "video", "map", "select", "datalist", "button", "label", "legend", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Which open elements a start tag closes, and the elements that this does not reach out of.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
FENCE = {"ul", "ol", "menu", "dl", "table", "div", "section", "article", "aside", "main", "body", "form", "nav"}
#: Elements whose texts are not the page's own text.
APART = {"nav", "footer", "aside", "form", "menu", "search", "dialog"}
#: Words of class, id and role that name such parts.
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "sidebar", "widget", "aside", "complementary", "footer", "contentinfo", "masthead", "copyright", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "toolbar", "search", "skip",
}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}

_QUOTED = r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|{_QUOTED}|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CUT = re.compile(r"[^a-z]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


class Item:
    """An element (or "#", a text slot, or a group "(...)") of an expression."""

    __slots__ = ("key", "children", "optional", "repeated", "into")

    def __init__(self, key: str, children: list[Item] | None = None, optional: bool = False, repeated: bool = False):
        self.key, self.children, self.optional, self.repeated = key, children if children is not None else [], optional, repeated
        self.into: Item | None = None

    def place(self) -> Item:
        """The item that this one was merged into."""
        at = self
        while at.into is not None:
            at = at.into
        while self is not at:  # shorten the way
            self.into, self = at, self.into
        return at


def _keys(items: list[Item]) -> list[str]:
    return [i.key for i in items]


def merge(a: Item, b: Item) -> Item:
    """a, which now also stands for b (of the same key)."""
    b.into = a
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.children = align(a.children, b.children)
    return a


def fold(items: list[Item]) -> list[Item]:
    """items with neighbouring equal elements, and equal groups of up to PERIOD elements, made repeats."""
    out: list[Item] = []
    for item in items:
        out.append(item)
        more = True
        while more:
            more = False
            for p in range(1, min(PERIOD, len(out) - 1) + 1):
                before = out[-p - 1]
                if before.key[0] != "(" and before.key != item.key:
                    continue
                tail = out[-p:]
                if before.key[0] == "(" and _keys(before.children) == _keys(tail):
                    before.children = [merge(a, b) for a, b in zip(before.children, tail, strict=True)]
                    del out[-p:]
                elif p == 1 and before.key[0] == "(" and before.children[-1].key == item.key:
                    merge(before.children[-1], out.pop()).repeated = True  # one more of the group's last element
                elif len(out) >= 2 * p and _keys(head := out[-2 * p : -p]) == _keys(tail):
                    same = [merge(a, b) for a, b in zip(head, tail, strict=True)]
                    if p == 1:
                        same[0].repeated = True
                        out[-2:] = same
                    else:
                        out[-2 * p :] = [Item(f"({' '.join(_keys(same))})", same, repeated=True)]
                else:
                    continue
                more, item = True, out[-1]
                break
    return out


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence (of very long sequences, of one that is found greedily)."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    front = [(i, i) for i in range(low)]
    back = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    middle = []
    if x and y and len(x) * len(y) <= CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif x and y:
        where: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            where.setdefault(y[j], []).append(j)
        last = -1
        for i, key in enumerate(x):
            places = where.get(key, [])
            while places and places[-1] <= last:
                places.pop()
            if places:
                last = places.pop()
                middle.append((low + i, low + last))
    return front + middle + back


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The expression of both: matching elements merged, the others optional, new repeats folded."""
    if (ka := _keys(a)) == (kb := _keys(b)):
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list[Item] = []
    i = j = 0
    for x, y in [*_matches(ka, kb), (len(a), len(b))]:
        for item in [*a[i:x], *b[j:y]]:
            item.optional = True
            out.append(item)
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def dump(items: list[Item]) -> str:
    plain = lambda i: [i.key, i.optional + 2 * i.repeated, [plain(c) for c in i.children]]
    return json.dumps([plain(i) for i in items], separators=(",", ":"))


def load(text: str) -> list[Item]:
    build = lambda x: Item(x[0], [build(c) for c in x[2]], bool(x[1] & 1), bool(x[1] & 2))
    return [build(x) for x in json.loads(text)]


def slots(items: list[Item], path: tuple[str, ...] = ()) -> Iterator[tuple[Item, tuple[str, ...]]]:
    """The text slots in order, each with the keys of the elements around it."""
    for i in items:
        if i.key == "#":
            yield i, path
        else:
            yield from slots(i.children, path if i.key[0] == "(" else (*path, i.key))


def infer(streams: list[str]) -> str:
    """The wrapper of some streams, aligned in their order."""
    out = load(streams[0])
    for s in streams[1:]:
        out = align(out, load(s))
    return dump(out)


def slots_in(wrapper: str, stream: str) -> list[int]:
    """For each slot of stream the number of the wrapper's slot that it falls into, -1 if it fits none."""
    w, s = load(wrapper), load(stream)
    number = {id(i): k for k, (i, _) in enumerate(slots(w))}
    mine = [i for i, _ in slots(s)]
    held = align(w, s)
    number = {id(i.place()): k for i, k in ((i, number.get(id(i))) for i, _ in slots(held)) if k is not None} | number
    return [number.get(id(i.place()), -1) for i in mine]


def _words(attributes: str) -> list[str]:
    """The words of class, id and role, in order; those behind has-, with-, no- and is- say nothing."""
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        for name in html.unescape(value.strip("\"'")).lower().split():
            parts = [w for w in _CUT.split(name) if w]
            if parts and parts[0] not in ("has", "with", "no", "is"):
                out += parts
    return list(dict.fromkeys(out))


def parse(page: str) -> tuple[list[Item], list[tuple[Item, str, int]]]:
    """A page's stream, folded, and its texts in order: (slot, text, characters in links)."""
    root = Item("")
    open_: list[tuple[str, Item | None]] = [("", root)]  # inline elements have no item
    texts: list[tuple[Item, str, int]] = []
    run: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if run:
            if text := _WHITE.sub(" ", "".join(run)).strip(" "):
                slot = Item("#")
                next(i for _, i in reversed(open_) if i is not None).children.append(slot)
                texts.append((slot, text, min(links, len(text))))
            run.clear()
        links = 0

    def close(depth: int) -> None:
        """Close open elements down to depth."""
        nonlocal in_link
        while len(open_) > depth:
            name, item = open_[-1]
            if item is not None:
                flush()
                item.children = fold(item.children)
            in_link -= name == "a"
            open_.pop()

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        end, name, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            end = end.lower()
            depth = next((k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == end), 0)
            inline = depth and open_[depth][1] is None
            if depth and not (inline and any(i is not None for _, i in open_[depth + 1 :])):
                close(depth)
        elif name:
            name = name.lower()
            if name in RAW:
                at = m.end() if (m := _raw_end(name).search(page, at)) else len(page)
                continue
            if name == "br":
                run.append("\n")
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            words = _words(attributes) if "=" in attributes else []
            block = name in BLOCK or name in UNSEEN or "-" in name
            if block:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == "p" or open_[k][0] in CLOSES.get(name, ()):
                        close(k)
                    elif open_[k][0] in FENCE:
                        break
            if (block or not APART_WORDS.isdisjoint(words)) and len(open_) < DEPTH:
                flush()
                item = Item(".".join([name, *words]))
                next(i for _, i in reversed(open_) if i is not None).children.append(item)
                open_.append((name, item))
            elif len(open_) < 2 * DEPTH:
                if block:
                    flush()
                open_.append((name, None))
            elif block:
                flush()
            in_link += name == "a" and open_[-1][0] == "a"
        elif m[0][0] != "<" or len(m[0]) == 1:
            text = html.unescape(m[0]) if "&" in m[0] else m[0]
            run.append(text)
            if in_link > 0:
                links += len(text.strip())
    close(1)
    flush()
    root.children = fold(root.children)
    return root.children, texts


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    """The end tag of an element whose content is not markup; without one the rest of the page is its content."""
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def apart(path: tuple[str, ...]) -> bool:
    """Whether a slot stands in a menu, header, footer, sidebar, notice, advert, form or comment."""
    inside = False
    for key in path:
        name, *words = key.split(".")
        inside |= name in ("article", "main")
        if name in APART or name in UNSEEN or (name == "header" and not inside) or (name not in ("html", "body") and not APART_WORDS.isdisjoint(words)) or (not inside and "header" in words):
            return True
    return False


def _container(path: tuple[str, ...]) -> int:
    """3 inside an article, 2 inside main, 1 inside an element that is named as content, else 0."""
    names = [k.split(".") for k in path]
    if any(n[0] == "article" for n in names):
        return 3
    if any(n[0] == "main" or "main" in n[1:] for n in names):
        return 2
    return int(any(not MAIN_WORDS.isdisjoint(n[1:]) for n in names if n[0] not in ("html", "body")))


def main_slots(stream: str, seen: dict[int, tuple[int, int, int, bool]]) -> list[int]:
    """The slots of a stream that hold main text.

    seen: for each slot the texts, characters and characters in links of its place in the host's wrapper, and whether it
    is one text on many pages. Parts that stand apart are left out. Inside an article (else main, else what is named as
    content) the rest is main text. On other pages link lists and texts of the template are left out too, and of what is left
    the smallest element with at least four fifths of the prose is taken, if there is any.
    """
    every = [(k, path) for k, (_, path) in enumerate(slots(load(stream)))]
    own = [(k, path, _container(path)) for k, path in every if not apart(path)]
    best = max((c for _, _, c in own), default=0)
    if best > 1:
        return [k for k, _, c in own if c == best]
    none = (0, 0, 0, False)
    left = [(k, path) for k, path, c in own if c == best and seen.get(k, none)[2] <= LINKS * seen.get(k, none)[1] and not seen.get(k, none)[3]]
    prose = {k: chars for k, _ in left for n, chars, _, _ in [seen.get(k, none)] if chars >= PROSE * n > 0}
    if not prose:
        return [k for k, _ in left] or [k for k, _, _ in own]
    shared: tuple[str, ...] = ()
    while True:
        inner: dict[str, int] = {}
        for k, path in left:
            if path[: len(shared)] == shared and len(path) > len(shared):
                inner[path[len(shared)]] = inner.get(path[len(shared)], 0) + prose.get(k, 0)
        top = max(inner, key=inner.get, default=None)
        if top is None or 5 * inner[top] < 4 * sum(prose.values()) or top.split(".")[0] == "p":
            return [k for k, path in left if path[: len(shared)] == shared]
        shared = (*shared, top)


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, host, stream, stream_id, and of each text its slot, the text and its characters in links."""
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    names = ["id", "url", "host", "stream", "stream_id", "slot", "text", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, ids, numbers, texts, links = [], [], [], [], []
            for raw in byte_values(batch.column(3)):
                items, found = parse(raw.decode("utf-8", "replace"))
                stream = dump(items)
                number = {id(i): k for k, (i, _) in enumerate(slots(items))}
                streams.append(stream)
                ids.append(hashlib.md5(stream.encode(), usedforsecurity=False).hexdigest())
                numbers.append([number[id(i.place())] for i, _, _ in found])
                texts.append([t for _, t, _ in found])
                links.append([n for _, _, n in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(streams, pa.string()), pa.array(ids, pa.string()), pa.array(numbers, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(links, pa.list_(pa.int32()))], names)

    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lower(rest).alias("host"), F.col(html_col).cast("binary").alias("html"))
    return rows.mapInArrow(frugal(run), f"id {kind[id_col]}, url {kind[url_col]}, host string, stream string, stream_id string, slot array<int>, text array<string>, links array<int>")


def wrappers(streams: DataFrame, most: int = FOLD) -> DataFrame:
    """host, wrapper of (host, stream) rows, in rounds of chunks of about `most` streams."""

    def folded(group: pa.Table) -> pa.Table:
        return pa.table({"host": group.column("host")[:1], "stream": pa.array([infer(sorted(group.column("stream").to_pylist()))], pa.string())})

    left = streams.select("host", "stream")
    while True:
        sizes = left.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("chunks"))
        sizes = written(sizes, "chunks")
        chunks = sizes.agg(F.max("chunks")).first()[0] or 0
        dealt = left.join(small_side(sizes), "host").withColumn("chunk", F.pmod(F.xxhash64("stream"), F.col("chunks")))
        left = written(dealt.groupBy("host", "chunk").applyInArrow(folded, "host string, stream string"), "wrappers")
        if chunks <= 1:
            return left.withColumnRenamed("stream", "wrapper")


def slot_decisions(parsed: DataFrame, most: int = FOLD) -> DataFrame:
    """host, stream_id, main (numbers of the slots with main text) of a written table of parsed pages."""
    streams = written(parsed.groupBy("host", "stream_id").agg(F.max("stream").alias("stream")), "streams")
    found = wrappers(streams, most)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [slots_in(w, s) for w, s in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.int32()))], ["host", "stream_id", "place"])

    known = streams.join(small_side(found, BROADCAST_HOSTS), "host").select("host", "stream_id", "stream", "wrapper")
    places = known.mapInArrow(placed, "host string, stream_id string, place array<int>").select("host", "stream_id", F.posexplode("place").alias("slot", "place"))
    text = parsed.select("host", "stream_id", F.explode(F.arrays_zip("slot", "text", "links")).alias("t")).select("host", "stream_id", "t.slot", F.xxhash64("t.text").alias("h"), F.length("t.text").cast("long").alias("chars"), F.col("t.links").cast("long").alias("links"))
    stats = text.groupBy("host", "stream_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    own = F.when(F.col("place") < 0, F.concat_ws(":", "stream_id", "slot")).otherwise(F.col("place").cast("string"))
    here = written(stats.join(places, ["host", "stream_id", "slot"]).withColumn("at", own), "slots")
    total = here.groupBy("host", "at").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = written(total, "slot-totals")
    seen = F.struct("slot", "n", "chars", "links", ((F.col("n") >= SAME) & (F.col("lo") == F.col("hi"))).alias("same"))
    of = here.select("host", "stream_id", "slot", "at").join(small_side(total), ["host", "at"]).groupBy("host", "stream_id").agg(F.collect_list(seen).alias("seen"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_slots(s, {x["slot"]: (x["n"], x["chars"], x["links"], x["same"]) for x in seen}) for s, seen in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.int32()))], ["host", "stream_id", "main"])

    return streams.join(of, ["host", "stream_id"]).select("host", "stream_id", "stream", "seen").mapInArrow(decided, "host string, stream_id string, main array<int>")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = FOLD) -> DataFrame:
    """id, url, text, n_chars of each row of pages: the main text of its whole html, empty if it has none.

    Texts of blocks have their character references decoded and white space (ASCII) made one space, and are joined by
    one space in page order. Null, empty and broken html is read as far as it goes; pages whose url is null or has no
    host share the empty host. Repeated rows are extracted alike. Other columns are ignored, whatever their names; an empty table
    gives an empty result. most: streams that a task aligns.
    """
    with scratch(pages.sparkSession):
        parsed = written(parsed_pages(pages, id_col, url_col, html_col), "pages", keep=True)
        main = written(slot_decisions(parsed, most), "main-slots", keep=True)
    texts = F.filter(F.arrays_zip("slot", "text"), lambda t: F.array_contains("main", t["slot"]))
    text = F.array_join(F.transform(texts, lambda t: t["text"]), " ")
    joined = parsed.join(small_side(main), ["host", "stream_id"], "left")
    return joined.select("id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
