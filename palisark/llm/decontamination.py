"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of outer punctuation; numbers, names and units become typed placeholders. A question
whose numbers and names were changed has the same template. Windows of the templates are hash-joined: those of the
benchmark are a hash table, those of every document probe it in the task that reads the document. Where enough of an
item's windows are found, the slots are compared: values must map one to one between item and document, as they do where
a question was re-parameterised, and don't where two texts only share a form.

Whether a word is a name is told by its case. So items and documents have a second view, in which names are words like
others: it is blind to case, and finds a copy in small letters, capitals or title case. A third view has no placeholders
at all: whatever an item is made of, it is found verbatim there, and a short one as a whole. The capital that opens a
sentence doesn't tell a name from another word, so in a fourth view every word that opens a sentence in a capital is a
name: there an item is found whose names were changed where they open sentences.

A window that several items share, such as one of the instructions that a whole test repeats, is no evidence for one of
them, unless the item has no other windows (copies of an item); which ones are shared is counted over the whole benchmark.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import written

WINDOW = 8
#: Where placeholders count, a window needs so many words that aren't; an item so many words to be told from chance.
MIN_LITERALS = 4
MIN_ITEM_WORDS = 5
#: An item is found where this share of its windows is; its slots hold where this share of its values maps one to one.
MIN_COVERAGE = 0.5
MIN_CONSISTENT = 0.75
#: So many consecutive words of an item are a leak too, whatever share of it that is.
RUN_WORDS = 20
#: Windows of the benchmark in memory at once (about 50 bytes each); a larger benchmark is joined in blocks of items.
BLOCK_WINDOWS = 1_000_000
PIECE_BYTES = 1 << 20
#: Where one slot differs and nothing else tells whether values map one to one, this share of the windows must be there.
ONE_SLOT_COVERAGE = 0.9
#: Units that count after a number, and number words, in English, German, French and Spanish.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "pound", "pounds",
    "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute",
    "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent",
    "cents", "euro", "euros", "km/h", "mph", "hz", "khz", "mhz", "w", "kw", "v", "j", "n", "pa", "k", "degrees",
    "meter", "kilometer", "meilen", "gramm", "kilogramm", "kilo", "pfund", "tonne", "tonnen", "sekunde", "sekunden", "minuten", "stunde", "stunden", "tag",
    "tage", "tagen", "woche", "wochen", "monat", "monate", "monaten", "jahr", "jahre", "jahren", "prozent", "grad",
    "mètre", "mètres", "kilomètres", "grammes", "kilos", "tonnes", "secondes", "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans",
    "années", "degrés", "metro", "metros", "kilómetros", "millas", "gramos", "litros", "toneladas", "segundos", "minutos", "hora", "horas", "día", "días",
    "semana", "semanas", "mes", "meses", "año", "años", "grados",
)
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
    "thousand", "million",
    "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn",
    "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig", "hundert", "tausend",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente", "quarante",
    "cinquante", "soixante", "cent", "mille", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce",
    "quince", "dieciséis", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "ciento", "mil",
)
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACEHOLDERS = tb.mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_in = lambda *parts: np.isin(np.arange(256), [b for p in parts for b in p])
_DIGIT, _UPPER, _LOWER = _in(range(0x30, 0x3A)), _in(range(0x41, 0x5B)), _in(range(0x61, 0x7B))
_WORD = _DIGIT | _UPPER | _LOWER | (np.arange(256) >= 0x80)
_NUMERIC = _DIGIT | _in(b".,:/-+%")
_STOP = _in(b".!?")
#: Small letters of the code points of two bytes, where they have two bytes too.
_SMALL = np.arange(0x800, dtype=np.uint16)
_SMALL[0x80:] = [ord(c) if len(c) == 1 and 0x80 <= ord(c) < 0x800 else k for k in range(0x80, 0x800) for c in [chr(k).lower()]]
TEMPLATE, CASE_BLIND, VERBATIM, OPENERS = VIEWS = range(4)


def _small(body: np.ndarray) -> np.ndarray:
    """The text in small letters, of the same length: ASCII, and letters of two bytes (Latin, Greek, Cyrillic)."""
    out = tb.LOWER[body]
    at = np.flatnonzero((body[:-1] >= 0xC2) & (body[:-1] < 0xE0))
    if len(at):
        low = _SMALL[((body[at] & 0x1F).astype(np.uint16) << 6) | (body[at + 1] & 0x3F)]
        out[at], out[at + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    return out


def _capitals(body: np.ndarray) -> np.ndarray:
    """Which bytes begin a capital letter: ASCII, or of two bytes."""
    out = _UPPER[body].copy()
    at = np.flatnonzero((body[:-1] >= 0xC2) & (body[:-1] < 0xE0))
    if len(at):
        point = ((body[at] & 0x1F).astype(np.uint16) << 6) | (body[at + 1] & 0x3F)
        out[at] = _SMALL[point] != point
    return out


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    body = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(tb.word_hash(body, np.concatenate([[0], ends[:-1]]), ends))


@dataclass
class Templates:
    """The words of a piece of documents: template hash, kind, hash of the value, and document of each."""

    token: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    doc: np.ndarray
    opener: np.ndarray  # a word in a capital that opens a sentence, name or not

    def kinds(self, view: int) -> np.ndarray:
        return np.where(self.opener, np.int8(NAME), self.kind) if view == OPENERS else self.kind

    def view(self, view: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a view, and which of them aren't placeholders."""
        if view == TEMPLATE:
            return self.token, self.kind == LITERAL
        if view == OPENERS:
            return np.where(self.opener, _PLACEHOLDERS[NAME], self.token), (self.kind == LITERAL) & ~self.opener
        if view == VERBATIM:
            return self.value, np.ones(len(self.value), bool)
        literal = (self.kind == LITERAL) | (self.kind == NAME)
        return np.where(literal, self.value, self.token), literal


def templates(body: np.ndarray, offsets: np.ndarray) -> Templates:
    start, end, doc = tb.word_spans(body, offsets)
    if not len(start):
        z = np.zeros(0, np.uint64)
        return Templates(z, z.astype(np.int8), z, doc, z.astype(bool))
    word = _WORD[body]
    at = np.arange(len(body))
    first = np.minimum.accumulate(np.where(word, at, len(body))[::-1])[::-1][start]
    last = np.maximum.accumulate(np.where(word, at, -1))[end - 1] + 1
    opens = np.ones(len(start), bool)  # the first word of a sentence
    opens[1:] = _STOP[body[end[:-1] - 1]] | (doc[1:] != doc[:-1])
    own = first < last
    own &= (first < end) & (last > start)
    first, last, doc, opens = first[own], last[own], doc[own], opens[own]
    count = lambda table: np.concatenate([[0], np.cumsum(table[body])])
    of = lambda c: c[last] - c[first]
    size = last - first
    digits = of(count(_DIGIT))
    numeric = of(count(_NUMERIC))
    value = tb.word_hash(_small(body), first, last)
    upper = _capitals(body)
    capitals = of(np.concatenate([[0], np.cumsum(upper)]))
    # A capital in front, and small letters after it: Bob, Émile, McDonald, O'Brien; NASA and USA are words like others.
    proper = upper[first] & (2 * capitals < size) & (size > 1) & (digits == 0)
    number = (digits > 0) & (numeric == size) | np.isin(value, _hashes(NUMBER_WORDS))
    quantity = (digits > 0) & ~number & _DIGIT[body[first]] & (size - numeric <= 3)  # 12km, 3rd
    before = np.zeros(len(number), bool)
    before[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = before & np.isin(value, _hashes(UNITS))
    name = ~number & ~unit & ~opens & proper
    kind = np.where(number | quantity, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL))).astype(np.int8)
    opener = opens & (kind == LITERAL) & proper
    return Templates(np.where(kind == LITERAL, value, _PLACEHOLDERS[kind]), kind, value, doc, opener)


def windows(t: Templates, sizes: tuple[int, ...], view: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the (first word, hash) of each window of so many words that lies in one document and has enough literals."""
    token, literal = t.view(view)
    up, down = tb.powers(len(token) + 1)
    prefix = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(token * up[: len(token)], out=prefix[1:])
    literals = np.concatenate([[0], np.cumsum(literal)])
    for size in sizes:
        n = len(token) - size + 1
        if n <= 0:
            continue
        h = tb.mixed((prefix[size:] - prefix[:-size]) * down[:n] + np.uint64(size))
        ok = (t.doc[size - 1 :] == t.doc[:n]) & (literals[size:] - literals[:-size] >= min(MIN_LITERALS, size))
        at = np.flatnonzero(ok)
        yield size, at, h[at]


@dataclass
class View:
    """The windows of a block of benchmark items in one view, sorted by hash."""

    sizes: tuple[int, ...]
    hashes: np.ndarray
    item: np.ndarray  # the item's number in the block
    place: np.ndarray
    counts: np.ndarray  # whether the window is evidence for the item: no other item has it, or the item has no such window
    total: np.ndarray  # distinct places with a window that counts, by item

    def __post_init__(self):
        self.mask = np.uint64((1 << max(16, int(len(self.hashes)).bit_length() + 6)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.hashes & self.mask] = True


@dataclass
class Index:
    """The views of a block of benchmark items, and the items' kinds and values for the slots."""

    views: list[View]
    ids: list
    keys: list  # the number of the first item of the same id; an item without an id is one by itself
    kinds: list  # by view
    values: list


def build_index(ids: list, texts: list[str | None], sharing: dict[tuple[int, int], int] | None = None) -> Index:
    """``sharing``: by view and hash (as a signed number), in how many items of the whole benchmark a window is, where these
    are more than one; None: the items given are the whole benchmark."""
    body, offsets = tb.utf8(pa.array(texts, pa.string()))
    t = templates(body, offsets)
    cut = np.searchsorted(t.doc, np.arange(len(ids) + 1))
    parts = lambda x: [x[a:b] for a, b in zip(cut[:-1], cut[1:])]
    first: dict = {}
    keys = [k if x is None else first.setdefault(x, k) for k, x in enumerate(ids)]
    return Index([_view(t, cut, view, np.array(keys, np.int64), sharing) for view in VIEWS], list(ids), keys, [parts(t.kinds(v)) for v in VIEWS], parts(t.value))


def _items_windows(t: Templates, cut: np.ndarray, view: int) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]:
    """The sizes of windows, and hash, item and place of each."""
    words = np.diff(cut)
    size_of = np.where(words >= (1 if view == VERBATIM else MIN_ITEM_WORDS), np.minimum(words, WINDOW), 0)
    sizes = tuple(sorted({int(s) for s in size_of if s}))
    hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, at, h in windows(t, sizes, view):
        own = size_of[t.doc[at]] == s
        at, h = at[own], h[own]
        hashes.append(h)
        item.append(t.doc[at])
        place.append(at - cut[t.doc[at]])
    return sizes, np.concatenate(hashes), np.concatenate(item), np.concatenate(place)


def _view(t: Templates, cut: np.ndarray, view: int, keys: np.ndarray, sharing: dict[tuple[int, int], int] | None) -> View:
    sizes, hashes, item, place = _items_windows(t, cut, view)
    order = np.argsort(hashes, kind="stable")
    hashes, item, place = hashes[order], item[order], place[order]
    distinct, group = np.unique(hashes, return_inverse=True)
    if sharing is None:
        pairs = np.unique(np.stack([group, keys[item]]), axis=1) if len(group) else np.zeros((2, 0), np.int64)
        shared = np.bincount(pairs[0], minlength=len(distinct))
    else:
        shared = np.array([sharing.get((view, h), 1) for h in distinct.view(np.int64).tolist()], np.int64)
    own = (shared[group] <= 1) if len(group) else np.zeros(0, bool)
    counts = own | (np.bincount(item, own, minlength=len(cut) - 1) == 0)[item]
    return View(sizes, hashes, item, place, counts, np.bincount(item, counts, minlength=len(cut) - 1))


def find(index: Index, body: np.ndarray, offsets: np.ndarray, min_coverage: float) -> dict[int, list[dict]]:
    """By number of the document in the piece: the items found in it, and how."""
    t = templates(body, offsets)
    best: dict[tuple[int, int], dict] = {}
    for number, view in zip(VIEWS, index.views):
        for (doc, item), hits in _hits(view, t, number).items():
            pairs, evidence = [(p, q) for p, q, _ in hits], [(p, q) for p, q, counts in hits if counts]
            matched = len({q for _, q in evidence})
            coverage = matched / int(view.total[item])
            diagonal = Counter(p - q for p, q in pairs).most_common(1)[0][0]
            if coverage < min_coverage:
                run, diagonal = _longest_run(evidence, WINDOW)
                if run < RUN_WORDS:
                    continue
            slots, same, consistent = _slots(index, number, item, t, pairs, diagonal)
            if consistent < MIN_CONSISTENT or slots - same == 1 and coverage < ONE_SLOT_COVERAGE:
                continue
            row = {"item": index.ids[item], "coverage": coverage, "windows": matched, "slots": slots, "same_slots": same, "consistent": consistent}
            key = doc, index.keys[item]
            if key not in best or coverage > best[key]["coverage"]:
                best[key] = row
    out: dict[int, list[dict]] = defaultdict(list)
    for (doc, _), row in best.items():
        out[doc].append(row)
    return out


def _hits(view: View, t: Templates, number: int) -> dict[tuple[int, int], list[tuple[int, int, bool]]]:
    """By document and item: the (place in the piece, place in the item, whether it counts) of each window that both have."""
    out: dict[tuple[int, int], list[tuple[int, int, bool]]] = defaultdict(list)
    for size, at, h in windows(t, view.sizes, number):
        maybe = view.bits[h & view.mask]
        at, h = at[maybe], h[maybe]
        lo, hi = np.searchsorted(view.hashes, h, "left"), np.searchsorted(view.hashes, h, "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if number == VERBATIM and size < WINDOW:  # a whole item: once in a document is enough, and it may be a common word
            first = np.unique(t.doc[at] * (len(view.hashes) + 1) + lo, return_index=True)[1]
            at, lo, hi = at[first], lo[first], hi[first]
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
            for k in range(a, b):
                out[int(t.doc[p]), int(view.item[k])].append((p, int(view.place[k]), bool(view.counts[k])))
    return out


def _longest_run(pairs: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """Words of the longest run of windows that follow each other in document and item alike, and its diagonal."""
    best, before, length = (0, 0), None, 0
    for diagonal, q in sorted((p - q, q) for p, q in pairs):
        length = length + 1 if before == (diagonal, q - 1) else 1
        before = diagonal, q
        best = max(best, (length + size - 1, diagonal))
    return best


def _slots(index: Index, view: int, item: int, t: Templates, pairs: list[tuple[int, int]], diagonal: int) -> tuple[int, int, float]:
    """Slots on a diagonal, how many are unchanged, and the share of values that map one to one."""
    kinds, values = index.kinds[view][item], index.values[item]
    size = min(len(kinds), WINDOW)
    places = sorted({q + k for p, q in pairs if p - q == diagonal for k in range(size)})
    slots = [(values[q], t.value[q + diagonal]) for q in places if kinds[q] in (NUMBER, NAME, UNIT)]
    if not slots:
        return 0, 0, 1.0
    there, back = defaultdict(set), defaultdict(set)
    for a, b in slots:
        there[a].add(b)
        back[b].add(a)
    good = sum(len(bs) == 1 and len(back[next(iter(bs))]) == 1 for bs in there.values())
    return len(slots), sum(a == b for a, b in slots), good / len(there)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> Iterator[Index]:
    """The benchmark in blocks of bounded size (by the words counted in it), one after the other; an id is in one block."""
    rows = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].cast("string").alias("text")).where("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))).alias("n")).first()["n"] or 0
    blocks = -(-int(words) * len(VIEWS) // block_windows)
    h = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    shared = None
    if blocks > 1:
        held = written(rows.select(F.pmod(h, F.lit(blocks)).alias("block"), h.alias("key"), "text").mapInArrow(_windows_of_items, "block long, key long, view int, hash long").distinct(), "item-windows")
        shared = written(held.groupBy("view", "hash").agg(F.count_distinct("key").alias("n")).where("n > 1"), "shared-windows")
    for k in range(blocks):
        part = rows.where(F.pmod(h, F.lit(blocks)) == k).orderBy("id", "text").collect()
        sharing = None
        if shared is not None:  # no more than the windows of the block
            own = shared.join(held.where(F.col("block") == k).select("view", "hash").distinct(), ["view", "hash"]).collect()
            sharing = {(x["view"], x["hash"]): x["n"] for x in own}
        yield build_index([x["id"] for x in part], [x["text"] for x in part], sharing)


def _windows_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        body, offsets = tb.utf8(x.column(2))
        t = templates(body, offsets)
        cut = np.searchsorted(t.doc, np.arange(len(x) + 1))
        for view in VIEWS:
            _, hashes, item, _ = _items_windows(t, cut, view)
            at = pa.array(item)
            yield pa.RecordBatch.from_arrays(
                [x.column(0).take(at), x.column(1).take(at), pa.array(np.full(len(item), view, np.int32)), pa.array(hashes.view(np.int64))], names=["block", "key", "view", "hash"]
            )


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_coverage: float = MIN_COVERAGE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, coverage, n_windows, kind, n_slots, consistency.

    A document holds an item if it has the share ``min_coverage`` of its own windows, or RUN_WORDS consecutive words
    of it that no other item has (coverage may be small then). Where a single slot differs, all else must
    be there (ONE_SLOT_COVERAGE). Of several texts of one item_id that of which most is found counts. kind: 'verbatim' if
    all slots are unchanged, else 're-parameterised'. Documents without an item have no row; neither have null and empty
    texts. Items of fewer than MIN_ITEM_WORDS words are found verbatim only, as a whole: one of a single word is in each
    document that has the word. Null items and those without a letter or digit can't be found. Repeated documents have a
    row each for each item. With an empty benchmark the result is empty.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, coverage double, n_windows int, kind string, n_slots int, consistency double"
    out = None
    for index in indexes(benchmark, item_col, item_text_col, block_windows):
        part = rows.mapInArrow(_finder(docs, index, min_coverage), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _finder(docs: DataFrame, index: Index, min_coverage: float):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "item_id", "coverage", "n_windows", "kind", "n_slots", "consistency")}
            for i, hit in _found(shared.value, x.column(1), min_coverage):
                changed = hit["same_slots"] < hit["slots"]
                values = (i, hit["item"], hit["coverage"], hit["windows"], "re-parameterised" if changed else "verbatim", hit["slots"], hit["consistent"])
                for k, v in zip(rows, values):
                    rows[k].append(v)
            at = pa.array(rows.pop("at"), pa.int64())
            kinds = (pa.array(shared.value.ids).type, pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [x.column(0).take(at), *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["doc_id", *rows]
            )

    return run


def _found(index: Index, column: pa.Array, min_coverage: float) -> Iterator[tuple[int, dict]]:
    body, offsets = tb.utf8(column)
    for a, b in tb.chunks(offsets, PIECE_BYTES):
        found = find(index, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_coverage)
        yield from ((a + i, hit) for i, hits in sorted(found.items()) for hit in hits)


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_coverage: float = MIN_COVERAGE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents that hold no benchmark item (see ``leaks``), all columns unchanged, whatever their names; they are judged
    in the task that reads them. Null and empty texts stay, repeated rows are judged each, an empty table stays empty, and
    an empty benchmark removes nothing. Texts of any length are judged whole.
    """
    where = [c.lower() for c in docs.columns].index(text_col.lower())
    for index in indexes(benchmark, item_col, item_text_col, block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keep = np.ones(len(x), bool)
                keep[[i for i, _ in _found(shared.value, x.column(where), min_coverage)]] = False
                yield x.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
