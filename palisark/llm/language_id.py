"""Language identification by compression.

Each language has a zstandard raw-content dictionary: the most frequent phrases of that language, seen as if they came
just before. A text is encoded with every dictionary, and the language whose dictionary gives the fewest bytes is predicted. Texts are encoded
in blocks, so that also in a long text each part is measured against the languages and not against the text before it.
A text whose best and second-best sizes are close is marked as rejected.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import small_side

UNKNOWN = "und"
LEVEL = 3
BLOCK_CHARS = 4096
#: The fit's bound for each language: documents, of which the whole texts are learnt.
SAMPLE_DOCS = 256
#: The size of a dictionary. It is filled with the most frequent phrases of so many words of all sampled texts.
DICTIONARY_BYTES = 128 << 10
PHRASE = 3
#: A text is rejected if its second-best size is less than this share above its best one.
MIN_MARGIN = 0.005
#: Dictionaries in one broadcast, and in use at once in a task; more languages are scored in blocks.
BLOCK_LANGUAGES = 64
PIECE_BYTES = 8 << 20
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The lower-cased runs of letters, each once where it is repeated in a row."""
    return [w for w, _ in itertools.groupby(_WORDS.findall(text.lower()))]


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for w in found for c in w)


@dataclass(frozen=True)
class Model:
    """Languages, most frequent first, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The rows that may be learnt from: crc32 of the id as text, modulo 3, isn't 1."""
    return ~held_out(docs[id_col])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from a bounded sample: for each language, the document with the least hash in each of SAMPLE_DOCS cells.

    Cells and hashes come from the id (and the text, where ids repeat), so the sample is the same whatever the partitions
    and the order of rows. Rows whose text or language is null are no sample. Every other language is learnt, also the
    rarest. Of a sampled document the whole text counts: the phrases of all of them are counted, and the most frequent
    make the dictionary. An empty table gives a model without languages.
    """
    rows = docs.where(training_rows(docs, id_col)).select(
        docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")
    )
    rows = rows.where("lang is not null and text is not null").withColumns({
        "cell": F.pmod(F.xxhash64("id"), F.lit(SAMPLE_DOCS)), "h": F.struct(F.xxhash64("id", F.lit(1)).alias("id"), F.xxhash64("text").alias("text")),
    })
    chosen = rows.groupBy("lang", "cell").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = small_side(chosen, "language-sample")  # at most SAMPLE_DOCS rows a language, of five numbers
    counts = chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = tuple(x["lang"] for x in counts)
    if not languages:
        return Model((), ())
    sample = rows.join(chosen.drop("n"), ["lang", "cell", "h"]).dropDuplicates(["lang", "cell", "h"]).select("lang", "text")
    counted = sample.mapInArrow(_phrases, "lang string, phrase string, times long").groupBy("lang", "phrase").agg(F.sum("times").alias("times"))
    built = counted.groupBy("lang").applyInArrow(_dictionary, "lang string, dictionary binary")
    found = {x["lang"]: bytes(x["dictionary"]) for x in built.toLocalIterator()}
    return Model(languages, tuple(found.get(x, b"") for x in languages))


def phrases(text: str) -> Counter:
    """How often each run of PHRASE words stands in the text; a shorter text is one run."""
    found = words(text)
    return Counter(" ".join(found[i : i + PHRASE]) for i in range(max(1, len(found) - PHRASE + 1))) if found else Counter()


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for lang, text in zip(x.column(0).to_pylist(), x.column(1)):
            count = phrases(text.as_py())
            columns = [pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "times"])


def _dictionary(counted: pa.Table) -> pa.Table:
    """The dictionary of one language from the phrases of its sample."""
    counted = counted.sort_by([("times", "descending"), ("phrase", "ascending")])
    return pa.table({"lang": counted["lang"][:1], "dictionary": pa.array([dictionary(counted["phrase"].to_pylist())], pa.binary())})


def dictionary(ranked: list[str]) -> bytes:
    """Whole phrases in the order of rank as far as DICTIONARY_BYTES reach; the most frequent last, next to the text."""
    taken, size = [], 0
    for phrase in ranked:
        size += len(phrase.encode()) + 1
        if size > DICTIONARY_BYTES:
            break
        taken.append(phrase)
    return " ".join(reversed(taken)).encode()


def sizes(model: Model) -> callable:
    """A function from a list of words to its encoded bytes with each dictionary."""
    encoders = []
    for d in model.dictionaries:
        # A dictionary needs 8 bytes; a language whose sample has no letters has an empty one.
        data = zstandard.ZstdCompressionDict(d.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False).compress)

    def measure(found: list[str]) -> list[int]:
        text = " ".join(found)
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(encode(b)) for b in blocks) for encode in encoders]

    return measure


def _shared(docs: DataFrame, model: Model, block_languages: int) -> list:
    """The model's blocks of languages, each in a broadcast of its own."""
    starts = range(0, len(model.languages), block_languages)
    blocks = [Model(model.languages[k : k + block_languages], model.dictionaries[k : k + block_languages]) for k in starts]
    return [docs.sparkSession.sparkContext.broadcast(x) for x in blocks]


def _scorer(shared: list) -> callable:
    """A function from a text column to, for each text, language, smallest and second-smallest size; None for no letters.

    Of equal sizes the earlier language's counts. A single block's encoders are made once; of several blocks those of one
    are in memory at a time, and texts meet all of them in pieces of bounded size.
    """
    only = sizes(shared[0].value) if len(shared) == 1 else None

    def score(column: pa.Array) -> Iterator[tuple[str, int, int] | None]:
        if not shared:
            yield from (None for _ in column)
            return
        for a, b in tb.chunks(tb.utf8(column)[1], PIECE_BYTES):
            best: list = [None] * (b - a)
            for block in shared:
                measure, languages = only or sizes(block.value), block.value.languages
                for i, text in enumerate(column.slice(a, b - a)):
                    found = words(text.as_py() or "")
                    if has_letter(found):
                        best[i] = _closest(best[i], measure(found), languages)
            yield from best

    return score


def _closest(before: tuple | None, got: list[int], languages: tuple[str, ...]) -> tuple[str, int, int | None]:
    """Language and size of the smallest, and the second-smallest size, of ``before`` and a block's sizes."""
    at = min(range(len(got)), key=got.__getitem__)
    rest = [n for i, n in enumerate(got) if i != at]
    if before is None:
        return languages[at], got[at], min(rest, default=None)
    name, least, second = before
    others = rest if second is None else [*rest, second]
    if got[at] < least:
        return languages[at], got[at], min([*others, least])
    return name, least, min([*others, got[at]])


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN,
    block_languages: int = BLOCK_LANGUAGES,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, margin, rejected.

    lang_pred is the language of the smallest encoding (of equal ones, that of the more frequent language), or 'und' if
    the text is null, empty or without a letter, or if nothing was learnt; score is 0 then, otherwise it rises from 0
    with the margin (second-best size less best, over the second-best). rejected: 'und', or a margin under min_margin.
    Repeated rows have a row each; an empty table gives an empty result; further columns, whatever their names, play no part.
    """
    shared = _shared(docs, model, block_languages)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), held_out(docs[id_col]).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for x in batches:
            found = list(score(x.column(1)))
            lang = [UNKNOWN if r is None else r[0] for r in found]
            margins = [0.0 if r is None else _margin(r) for r in found]
            margin = pa.array(margins, pa.float64())
            scores = pa.array([m / (m + 0.02) for m in margins], pa.float64())
            rejected = pa.array([p == UNKNOWN or m < min_margin for p, m in zip(lang, margins)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(2), pa.array(lang, pa.string()), scores, margin, rejected],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def _margin(found: tuple[str, int, int | None]) -> float:
    """Second-best size less best, over the second-best; with one language the second counts as twice the best."""
    _, least, second = found
    return 0.5 if second is None else (second - least) / second


def accepted(
    docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN, block_languages: int = BLOCK_LANGUAGES
) -> DataFrame:
    """The documents that aren't rejected (see ``predict``), all columns unchanged, whatever their names; texts are judged
    whole where they are read. Null and empty texts go, repeated rows are judged each, an empty table stays empty.
    """
    shared = _shared(docs, model, block_languages)
    where = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for x in batches:
            keep = [r is not None and (r[2] is None or _margin(r) >= min_margin) for r in score(x.column(where))]
            yield x.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
