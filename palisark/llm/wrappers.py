"""Main text of web pages, by wrappers inferred from the pages of a host.

A page is a stream of block tags and text slots (inline markup belongs to the slot). A wrapper is a union-free regular
expression over such streams: sequences, optional parts, repeated parts and slots whose text is fixed or varies. It is
inferred by aligning streams. Inside a page, neighbours that repeat, alone or as a group of up to ``PERIOD`` parts, become
one repeated part; two wrappers are aligned by the longest common sequence of their parts, level by level: what both have
is merged, what only one has is optional, a part that repeats on one side repeats, and a slot with different texts varies.

A task merges the pages of a host that it reads, so one small wrapper of a host leaves it, however many pages the host
has; these are merged in rounds of ``FAN_IN``. A host has a wrapper for each layout: pages with an article, with a main
part only (either may stand inside what is otherwise furniture), and with neither.

The wrapper, not the page, decides what is main text: the article (or main part), without the parts whose tag, class, id
or role say that they are menus, headers, footers, sidebars, notices, adverts, forms or comments. Where nothing names the
article, slots that have the same text on all pages of the host are furniture, as are lists that are mostly links.
A page is then read again, each of its blocks is found in the wrapper, and the blocks of main text are joined.
"""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.session import written

#: Wrappers of a host that are merged in one step.
FAN_IN = 32
#: The longest group of parts that is recognised as repeated.
PERIOD = 4
#: Elements inside one another; deeper ones belong to the element at this depth.
MAX_DEPTH = 100
#: Parts of a wrapper beyond which classes no longer tell parts apart, and that a task holds before it sends its wrappers on.
MAX_PARTS = 2000
HELD_PARTS = 100_000
#: Bytes of all wrappers together up to which they are sent to every task; beyond, pages are joined with them by host.
SENT_BYTES = 8 << 20
#: The share of a list's characters inside links from which it is a menu.
LINK_SHARE = 0.6

# Element names of HTML.
VOID = {"area", "base", "col", "embed", "input", "link", "meta", "param", "source", "track"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
IN_HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup"
    " hr main menu nav ol p pre search section summary table ul".split()
)
#: Starting one of these ends an open one of the second set, unless one of the third set is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Elements that are boxes of their own: their text is no part of the block around them.
BLOCKS = CLOSES_P | set(ENDS) | set(
    "html head body thead caption colgroup legend template noscript".split()
)
#: Controls and media in the line: what they hold is no text, up to their end or to the next block.
MUTED = {"select", "button", "datalist", "svg", "canvas", "object", "audio", "video"}
#: What is no main text, by element, by word of class or id, and by ARIA role.
ROLE_OF_TAG = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "search": "form",
    "dialog": "notice", "head": "markup", "template": "markup", "noscript": "markup",
}
ROLE_OF_WORD = {
    word: role
    for role, words in {
        "menu": "menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager share sharing social",
        "header": "header masthead topbar",
        "footer": "footer colophon",
        "sidebar": "sidebar aside widget widgets related recommended recommendations trending",
        "notice": "notice notices cookie cookies consent gdpr banner alert popup modal overlay announcement",
        "advert": "ad ads advert adverts advertisement advertising adsense adbox adslot adunit sponsor sponsored promo promoted promotion",
        "form": "form newsletter subscribe signup login search searchbox",
        "comments": "comment comments commentlist disqus respond replies reply discussion",
    }.items()
    for word in words.split()
}
ROLE_OF_ARIA = {
    "navigation": "menu", "menu": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form",
    "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice",
}

_ATTRIBUTES = r"""(?:[\s/]++|[^\s>/][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Part:
    """A part of a stream or wrapper: an element, a slot (``#``) or a group of parts (its label in brackets).

    ``text``: a page's slot as it stands; ``same``: a checksum of the slot's text on every page, None if it varies;
    ``pages``, ``chars``, ``links``: pages that have the slot, its characters, and those of them inside links.
    """

    __slots__ = ("label", "kids", "optional", "repeated", "text", "same", "pages", "chars", "links", "keep", "find")

    def __init__(self, label, kids=None):
        self.label, self.kids, self.optional, self.repeated = label, [] if kids is None else kids, False, False
        self.text, self.same, self.pages, self.chars, self.links, self.keep, self.find = "", None, 1, 0, 0, None, None


@functools.lru_cache(4096)
def label_of(name: str, attributes: str) -> str:
    """``name``, with ``!`` and its role if it is no main text, else with a dot and its class if it has one."""
    if name in ("html", "body", "head"):
        return name if name != "head" else "head!markup"
    role, words, css = ROLE_OF_TAG.get(name), [], ""
    for key, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            aria = value.strip().lower()
            name = aria if aria in ("main", "article") else name
            role = role or ROLE_OF_ARIA.get(aria)
        else:
            found = [w.lower() for w in _WORD.findall(value)]
            words += found
            if key.lower() == "class" and found:
                css = found[0]
    if name in ("article", "main"):
        return f"{name}!comments" if any(ROLE_OF_WORD.get(w) == "comments" for w in words) else name
    role = role or next((ROLE_OF_WORD[w] for w in words if w in ROLE_OF_WORD), None)
    return f"{name}!{role}" if role else f"{name}.{css}" if css else name


def parse(page: str) -> Part:
    """The tree of a page's block elements and slots, as tolerant as a browser; text with references decoded."""
    root = Part("root")
    stack, names, opened, over = [root], ["root"], {}, 0
    chunks, links, in_link, muted, at, size = [], 0, False, "", 0, len(page)

    def slot():
        nonlocal links
        text = "".join(chunks)
        if text and not text.isspace():
            part = Part("#")
            part.text, part.chars, part.links = text, len(text), links
            stack[-1].kids.append(part)
        chunks.clear()
        links = 0

    def pop(to: int):
        while len(stack) > to:
            stack.pop()
            opened[names.pop()] -= 1

    def nearest(of: set, until: set = frozenset()):
        for k in range(len(names) - 1, 0, -1):
            if names[k] in of:
                return k
            if names[k] in until:
                break
        return 0

    def say(text: str):
        nonlocal links
        if muted:
            return
        if "&" in text:
            text = html.unescape(text)
        if names[-1] == "head" and not text.isspace():
            slot()
            pop(len(stack) - 1)
        chunks.append(text)
        if in_link:
            links += len(text)

    while at < size:
        lt = page.find("<", at)
        token = _TOKEN.match(page, lt) if lt >= 0 else None
        if token is None:
            end = size if lt < 0 else lt + 1  # a "<" that begins no tag is text
            if end > at:
                say(page[at:end])
            at = end
            continue
        if lt > at:
            say(page[at:lt])
        at = token.end()
        closing, name, attributes = token.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                in_link = False
            elif name == muted:
                muted = ""
            elif name in BLOCKS and name not in ("html", "body"):
                muted = ""
                slot()
                if over:
                    over -= 1
                elif name in HEADINGS:
                    if k := nearest(HEADINGS):
                        pop(k)
                elif opened.get(name):
                    pop(nearest({name}))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            continue
        if opened.get("head") and name not in IN_HEAD and name != "head":
            slot()
            pop(nearest({"head"}))
        if name == "a":
            in_link = True
        elif name == "br":
            chunks.append(" ")
        elif name in MUTED and not muted and not attributes.endswith("/"):
            muted = name
        if name not in BLOCKS or name in VOID:
            continue
        muted = ""
        slot()
        if name in ("html", "body", "head") and opened.get(name):
            continue
        if opened.get("p") and name in CLOSES_P and (k := nearest({"p"}, {"td", "th", "caption"})):
            pop(k)
        if name in ENDS and (k := nearest(*ENDS[name])):
            pop(k)
        if name in HEADINGS and names[-1] in HEADINGS:
            pop(len(stack) - 1)
        if name == "hr":
            continue
        if len(stack) >= MAX_DEPTH:
            over += 1
            continue
        part = Part(label_of(name, attributes))
        stack[-1].kids.append(part)
        stack.append(part)
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
    slot()
    return root


# Inference


def merged(a: Part, b: Part, of_one_page: bool) -> Part:
    """One part for two with the same label. On one page their texts follow one another; on two, they are compared."""
    out = Part(a.label)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    if of_one_page:
        out.pages = max(a.pages, b.pages)
        out.same = None if a.same is None or b.same is None else zlib.crc32(b"%d" % b.same, a.same)
    else:
        out.pages = a.pages + b.pages
        out.same = a.same if a.same == b.same else None
    out.chars, out.links = a.chars + b.chars, a.links + b.links
    if a.kids or b.kids:
        out.kids = aligned(a.kids, b.kids, of_one_page)
    return out


def repeats(parts: list[Part]) -> list[Part]:
    """The sequence with neighbours that repeat as one repeated part, groups of several parts last."""
    for period in range(1, PERIOD + 1):
        labels, out, i, n = [p.label for p in parts], [], 0, len(parts)
        while i < n:
            unit = labels[i : i + period]
            j = i + period
            while labels[j : j + period] == unit and j + period <= n:
                j += period
            if j == i + period:
                out.append(parts[i])
                i += 1
                continue
            first = parts[i : i + period]
            for k in range(i + period, j, period):
                first = [merged(a, b, True) for a, b in zip(first, parts[k : k + period])]
            if period == 1:
                first[0].repeated = True
                out.append(first[0])
            else:
                group = Part(f"({','.join(unit)})", first)
                group.repeated = True
                out.append(group)
            i = j
        parts = out
    return parts


def grouped(parts: list[Part], groups: dict[str, int]) -> list[Part]:
    """The sequence with what ``groups`` of the other side consist of put together."""
    for label, size in groups.items():
        labels, out, i = [p.label for p in parts], [], 0
        while i < len(parts):
            if i + size <= len(parts) and f"({','.join(labels[i : i + size])})" == label:
                out.append(Part(label, parts[i : i + size]))
                i += size
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def aligned(xs: list[Part], ys: list[Part], of_one_page: bool) -> list[Part]:
    """Both sequences as one: common parts merged, all others optional."""
    if len(xs) == len(ys) and all(x.label == y.label for x, y in zip(xs, ys)):
        return [merged(x, y, of_one_page) for x, y in zip(xs, ys)]
    for own, other in ((0, 1), (1, 0)):
        groups = {p.label: len(p.kids) for p in (xs, ys)[own] if p.label[0] == "("}
        if groups:
            both = [xs, ys]
            both[other] = grouped(both[other], groups)
            xs, ys = both
    out: list[Part] = []
    for x, y in common(xs, ys):
        if x is not None and y is not None:
            out.append(merged(x, y, of_one_page))
        else:
            part = x if x is not None else y
            part.optional = True
            out.append(part)
    return repeats(out)


def common(xs: list[Part], ys: list[Part]) -> Iterator[tuple[Part | None, Part | None]]:
    """The pairs of a longest common sequence of labels, and what stands between them, in order."""
    i = 0
    while i < min(len(xs), len(ys)) and xs[i].label == ys[i].label:
        yield xs[i], ys[i]
        i += 1
    xs, ys, tail = xs[i:], ys[i:], []
    while xs and ys and xs[-1].label == ys[-1].label:
        tail.append((xs[-1], ys[-1]))
        xs, ys = xs[:-1], ys[:-1]
    n, m = len(xs), len(ys)
    if n * m > MAX_PARTS**2:  # long and different: each part meets the next one of its label
        j = 0
        for x in xs:
            k = next((k for k in range(j, min(m, j + MAX_PARTS)) if ys[k].label == x.label), None)
            if k is None:
                yield x, None
            else:
                yield from ((None, y) for y in ys[j:k])
                yield x, ys[k]
                j = k + 1
        yield from ((None, y) for y in ys[j:])
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if xs[i].label == ys[j].label else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n or j < m:
            if i < n and j < m and xs[i].label == ys[j].label:
                yield xs[i], ys[j]
                i, j = i + 1, j + 1
            elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
                yield xs[i], None
                i += 1
            else:
                yield None, ys[j]
                j += 1
    yield from reversed(tail)


def folded(part: Part) -> Part:
    """The wrapper of one page, or of a part of it."""
    out = Part(part.label)
    if part.label == "#":
        out.same, out.chars, out.links = zlib.crc32(part.text.encode("utf-8", "surrogatepass")), part.chars, part.links
    else:
        out.kids = repeats([folded(k) for k in part.kids])
    return out


def parts_of(part: Part) -> int:
    return 1 + sum(map(parts_of, part.kids))


def coarser(part: Part) -> Part:
    """The wrapper without classes, for hosts whose pages each have classes of their own."""
    if part.label[0] == "(":
        part.kids = [coarser(k) for k in part.kids]
        part.label = f"({','.join(k.label for k in part.kids)})"
    else:
        part.label = part.label.split(".")[0]
        part.kids = repeats([coarser(k) for k in part.kids])
    return part


def joined(a: Part, b: Part) -> Part:
    out = merged(a, b, False)
    return coarser(out) if parts_of(out) > MAX_PARTS else out


def pack(part: Part) -> bytes:
    def plain(p: Part) -> list:
        return [p.label, p.optional * 2 + p.repeated, p.same, p.pages, p.chars, p.links, [plain(k) for k in p.kids]]

    return zstandard.ZstdCompressor(level=3).compress(json.dumps(plain(part), separators=(",", ":")).encode())


def unpack(blob: bytes) -> Part:
    def part(x: list) -> Part:
        out = Part(x[0], [part(k) for k in x[6]])
        out.optional, out.repeated = x[1] >= 2, x[1] % 2 == 1
        out.same, out.pages, out.chars, out.links = x[2:6]
        return out

    return part(json.loads(zstandard.ZstdDecompressor().decompress(blob)))


# Main text


def roots(part: Part, tag: str, furniture: bool = False) -> Iterator[tuple[Part, bool]]:
    """The outermost elements ``tag``, each with whether it stands inside a part that is no main text."""
    for k in part.kids:
        if k.label.split(".")[0] == tag:
            yield k, furniture
        else:
            yield from roots(k, tag, furniture or "!" in k.label)


def content(root: Part) -> tuple[str, list[Part]]:
    """The layout, and the parts that hold the main text. Articles inside furniture count if there are no others."""
    for tag in ("article", "main"):
        found = list(roots(root, tag))
        if own := [p for p, furniture in found if not furniture]:
            return tag, own
        if found:
            return f"{tag} inside", [p for p, _ in found]
    return "plain", [root]


def slots(part: Part) -> Iterator[Part]:
    """The slots below a part that aren't inside something that is no main text."""
    for k in part.kids:
        if k.label == "#":
            yield k
        elif "!" not in k.label:
            yield from slots(k)


def decide(wrapper: Part) -> Part:
    """Marks the parts where main text begins (keep: True) and those that are furniture (False), and indexes all."""

    def index(part: Part) -> None:
        flat: list[Part] = []
        for k in part.kids:
            flat += k.kids if k.label[0] == "(" else [k]
        part.find = {}
        for i, k in enumerate(flat):
            part.find.setdefault(k.label, []).append((i, k))
            if "!" in k.label and k.keep is None:
                k.keep = False
            index(k)

    layout, found = content(wrapper)
    for part in found:
        part.keep = True
    if layout == "plain":
        def menus(part: Part) -> tuple[int, int]:
            chars, links = part.chars, part.links
            for k in part.kids:
                x = menus(k)
                chars, links = chars + x[0], links + x[1]
            if part.label.split(".")[0] in ("ul", "ol", "table") and chars and links >= LINK_SHARE * chars:
                part.keep = False
            return chars, links

        menus(wrapper)
        own = list(slots(wrapper))
        fixed = [s for s in own if s.pages > 1 and s.same is not None]
        if len(fixed) < len(own):
            for s in fixed:
                s.keep = False
    index(wrapper)
    return wrapper


def main_text(page: Part, wrapper: Part) -> str:
    """The blocks of a page that the wrapper of its host and layout holds for main text, joined by line breaks."""
    blocks: list[str] = []

    def walk(part: Part, own: Part | None, kept: bool, header: bool) -> None:
        at = 0
        for k in part.kids:
            slot = None
            if own is not None and (places := own.find.get(k.label) or own.find.get(k.label.split(".")[0])):
                at, slot = next((x for x in places if x[0] >= at), places[0])
            keep = slot.keep if slot is not None else False if "!" in k.label else None
            if k.label == "#":
                if kept and not header and keep is not False and (text := " ".join(k.text.split())):
                    blocks.append(text)
            elif keep is not False:
                walk(k, slot, kept or keep is True, header and k.label.split(".")[0] not in HEADINGS)
            elif kept and k.label.endswith("!header"):
                walk(k, slot, True, True)  # an article's own header: its headings belong to it
            else:
                walk(k, slot, False, False)  # an article may stand inside

    walk(page, wrapper, wrapper.keep is True, False)
    return "\n".join(blocks)


# Spark


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


_KIND = "host string, layout string, origin long, wrapper binary"


def _rows(held: dict[tuple[str, str], Part], origin: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in held], pa.string()), pa.array([x for _, x in held], pa.string()),
            pa.array([origin] * len(held), pa.int64()), pa.array([pack(p) for p in held.values()], pa.binary()),
        ],
        names=["host", "layout", "origin", "wrapper"],
    )


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], Part] = {}
    origin, parts = TaskContext.get().partitionId(), 0
    for x in batches:
        for url, page in zip(x.column(0), x.column(1)):
            tree = parse(page.as_py() or "")
            layout, _ = content(tree)
            own, key = folded(tree), (host_of(url.as_py()), layout)
            if key in held:
                held[key] = joined(held[key], own)
            else:
                held[key] = own
                parts += parts_of(own)
            if parts > HELD_PARTS:
                yield _rows(held, origin)
                held, parts = {}, 0
    if held:
        yield _rows(held, origin)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, layout and origin: one wrapper for each."""
    last, own = None, None
    for x in batches:
        out: dict[tuple, bytes] = {}
        for host, layout, origin, blob in zip(*(x.column(c).to_pylist() for c in ("host", "layout", "origin", "wrapper"))):
            key = (host, layout, origin)
            if key == last:
                own = joined(unpack(own) if isinstance(own, bytes) else own, unpack(blob))
            else:
                if last is not None:
                    out[last] = own if isinstance(own, bytes) else pack(own)
                last, own = key, blob
        for key, blob in out.items():
            yield pa.RecordBatch.from_pydict({"host": [key[0]], "layout": [key[1]], "origin": pa.array([key[2]], pa.int64()), "wrapper": [blob]})
    if last is not None:
        blob = own if isinstance(own, bytes) else pack(own)
        yield pa.RecordBatch.from_pydict({"host": [last[0]], "layout": [last[1]], "origin": pa.array([last[2]], pa.int64()), "wrapper": [blob]})


def infer(pages: DataFrame) -> DataFrame:
    """One row for each host and layout: host, layout, wrapper.

    ``pages`` has url and html; pages without a host share the host ''. Each round meets up to ``FAN_IN`` wrappers of a
    host, so that no task has more than these of it, however many pages a host has.
    """
    made = written(pages.select("url", "html").mapInArrow(_infer, _KIND), "wrappers")
    origins = (made.agg(F.max("origin")).first()[0] or 0) + 1
    while True:
        keys = ["host", "layout", "origin"]
        made = made.withColumn("order", F.xxhash64("wrapper")).withColumn("origin", F.floor(F.col("origin") / FAN_IN))
        made = made.repartition(*keys).sortWithinPartitions(*keys, "order").select("host", "layout", "origin", "wrapper").mapInArrow(_merge, _KIND)
        if origins <= FAN_IN:
            return made.select("host", "layout", "wrapper")
        origins = -(-origins // FAN_IN)


@functools.lru_cache(256)
def _decided(blob: bytes) -> Part:
    return decide(unpack(blob))


def _extracted(url, page, wrappers: dict[str, bytes]) -> str:
    tree = parse(page or "")
    layout, _ = content(tree)
    blob = wrappers.get(layout)
    return main_text(tree, decide(folded(tree)) if blob is None else _decided(blob))


def extract(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    ``text``: the main text of the whole html, a line for each block, references decoded, white space in a block as one
    space; '' for a null or empty html, and for a page without main text. Nothing else is dropped or cut. ``page_id`` and
    ``url`` are carried as they are, null or repeated; repeated rows have a row each. Of articles that stand side by side all
    count. An empty table gives an empty result. Columns other than page_id, url and html play no part, whatever their names.
    """
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    wrappers = written(infer(rows), "host-wrappers")
    held = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.count("*")).first()
    out = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def columns(x: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [x.column(0), x.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    if (held[0] or 0) + 64 * held[1] <= sent_bytes:
        known: dict[str, dict[str, bytes]] = {}
        for r in wrappers.collect():  # at most sent_bytes
            known.setdefault(r["host"], {})[r["layout"]] = bytes(r["wrapper"])
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                urls = [u.as_py() for u in x.column(1)]
                yield columns(x, [_extracted(u, p.as_py(), shared.value.get(host_of(u), {})) for u, p in zip(urls, x.column(2))])

        return rows.mapInArrow(by_host, out)

    # A host has five layouts at most; of the sides of this join only that of the pages can be large for a host, and may be split.
    own = wrappers.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("layout", "wrapper"))).alias("wrappers"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?i)" + _HOST.pattern, 1))

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield columns(x, [_extracted(u.as_py(), p.as_py(), dict(w.as_py() or ())) for u, p, w in zip(x.column(1), x.column(2), x.column(3))])

    return rows.withColumn("host", host).join(own, "host", "left").select("page_id", "url", "html", "wrappers").mapInArrow(by_row, out)
