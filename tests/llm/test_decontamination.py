from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palisark.llm import decontamination as dc

from .conftest import prose, thue_morse

ITEMS = [
    (1, "A train leaves the station at 60 km per hour and arrives in 3 hours, how far did Alice travel with it?"),
    (2, "What is the name of the process by which green plants turn light into chemical energy?"),
    (3, "If Bob has 12 apples and gives 5 of them to Carol then how many apples does Bob still have?"),
    (4, None),
    (5, "too short"),
    (6, ""),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def around(text, seed=1):
    rng = random.Random(seed)
    return f"{prose(rng, 40)}. {text} {prose(rng, 40)}"


def test_verbatim_and_reparameterised(make_docs, benchmark):
    texts = [
        around(ITEMS[0][1]),
        around(ITEMS[0][1].replace("60", "85").replace("3 hours", "7 hours").replace("Alice", "Dagmar"), 2),
        around(ITEMS[1][1].upper().lower(), 3),
        around(ITEMS[2][1].replace("Bob", "Hans").replace("Carol", "Ute").replace("12", "90").replace(" 5 ", " 8 "), 4),
        around("An entirely other question about trains", 5),
        None,
        "",
    ]
    docs = make_docs(texts).withColumn("item_id", F.lit("clash")).withColumn("kind", F.lit(1))
    found = {r.doc_id: (r.item_id, r.kind) for r in dc.leaks(docs, benchmark).collect()}
    assert found == {0: (1, "verbatim"), 1: (1, "re-parameterised"), 2: (2, "verbatim"), 3: (3, "re-parameterised")}
    out = dc.clean(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 6]


def test_inconsistent_slots_are_no_leak(make_docs, spark):
    item = "so if Anna gives Berta the ball and Berta gives Anna the book then Anna thanks Berta and Berta thanks Anna"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    mapped = item.replace("Anna", "Xenia").replace("Berta", "Yann")
    names = iter("Carl Doris Emil Frida Georg Hanna Ivo Jana".split())
    mixed = " ".join(next(names) if w in ("Anna", "Berta") else w for w in item.split())
    found = {r.doc_id: r.consistency for r in dc.leaks(make_docs([around(mapped), around(mixed)]), benchmark).collect()}
    assert found == {0: 1.0}


def test_blocks_give_the_same(make_docs, benchmark, rows):
    texts = [around(t, i) for i, (_, t) in enumerate(ITEMS) if t] + [around(ITEMS[0][1] + " " + ITEMS[1][1], 9)] * 2
    docs = make_docs(texts)
    whole, blocks = dc.leaks(docs, benchmark), dc.leaks(docs, benchmark, block_windows=20)
    assert rows(whole, "doc_id", "coverage") == rows(blocks, "doc_id", "coverage")
    assert rows(dc.clean(docs, benchmark), "doc_id") == rows(dc.clean(docs, benchmark, block_windows=20), "doc_id")


def test_empty_tables(make_docs, benchmark, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(make_docs([]), benchmark).collect() == []
    assert dc.leaks(make_docs(["x"]), none).collect() == []
    assert dc.clean(make_docs(["x"]), none).count() == 1


def test_very_long_text(make_docs, benchmark):
    rng = random.Random(7)
    texts = [prose(rng, 30_000) + " " + ITEMS[1][1] + " " + prose(rng, 30_000), prose(rng, 60_000)]
    assert [r.doc_id for r in dc.leaks(make_docs(texts), benchmark).collect()] == [0]


def brute(texts, items, size=8):
    """The texts that hold half of an item's word windows or more: plain comparison, for items without placeholders."""

    def windows(text):
        words = text.split()
        return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}

    return {i for i, t in enumerate(texts) if any(len(windows(t) & windows(x)) >= len(windows(x)) / 2 for x in items)}


def test_equals_brute_force_on_plain_words(make_docs, spark):
    rng = random.Random(12)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [plain(rng.randrange(9, 30)) for _ in range(12)]
    texts = []
    for _ in range(80):
        words = rng.choice(items).split()
        cut = words[rng.randrange(len(words)) :] if rng.random() < 0.7 else plain(10).split()
        texts.append(" ".join([plain(5), *cut, plain(5)]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.doc_id for r in dc.leaks(make_docs(texts), benchmark).collect()}
    assert found == brute(texts, items)


def test_case_of_names_is_no_matter(make_docs, benchmark):
    """Small, capital and title-case copies of items that hold names, also with other numbers."""
    changes = (str.lower, str.upper, str.title)
    texts = [around(change(ITEMS[k][1]), k) for k in (0, 2) for change in changes]
    texts += [around(change(ITEMS[2][1].replace("12", "90").replace(" 5 ", " 8 ")), 5) for change in changes]
    found = {r.doc_id: (r.item_id, r.kind) for r in dc.leaks(make_docs(texts), benchmark).collect()}
    assert found == {k: (1 if k < 3 else 3, "verbatim" if k < 6 else "re-parameterised") for k in range(9)}


def test_case_of_other_letters_is_no_matter(make_docs, spark):
    item = "wie heißt die größte ältere brücke über den östlichen fluß bei Émile Überall und Ärzte"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [around("".join(c if c == "ß" else c.upper() for c in item)), around(item.lower())]
    assert sorted(r.doc_id for r in dc.leaks(make_docs(texts), benchmark).collect()) == [0, 1]


def test_items_without_template_windows(make_docs, spark):
    """Numbers, title case and short items have verbatim windows whatever their placeholders."""
    items = ["12 + 7 = 19, 3 * 4 = 12, 8 / 2 = 4, 5 - 1 = 4, 90 + 2 = 92", "Where Did The Last Great Auk Of Iceland Die", "Capital of Peru?", "Zyzzyva"]
    benchmark = spark.createDataFrame([*enumerate(items), (9, "?!"), (10, "")], "item_id long, text string")
    texts = [around(t, k) for k, t in enumerate(items)] + [around("peru capital of zyzzyvas", 8)]
    found = {r.doc_id: (r.item_id, r.coverage, r.kind) for r in dc.leaks(make_docs(texts), benchmark).collect()}
    assert found == {k: (k, 1.0, "verbatim") for k in range(4)}


def test_passage_of_a_long_item(make_docs, spark):
    words = prose(random.Random(21), 300).split()
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cut = lambda n: around(" ".join(words[50 : 50 + n]), 22)
    texts = [cut(100), cut(dc.RUN_WORDS), cut(dc.RUN_WORDS - 1), around(" ".join(words[k] for k in range(0, 300, 2)), 23)]
    found = {r.doc_id: r.coverage for r in dc.leaks(make_docs(texts), benchmark).collect()}
    assert sorted(found) == [0, 1] and found[0] < dc.MIN_COVERAGE
    assert [r.doc_id for r in dc.clean(make_docs(texts), benchmark).orderBy("doc_id").collect()] == [2, 3]


@pytest.mark.parametrize("block_windows", [dc.BLOCK_WINDOWS, 20])
def test_every_item_of_a_document_has_its_row(make_docs, spark, rows, block_windows):
    items = [*((i, t) for i, t in ITEMS if i < 4), (2, ITEMS[1][1] + " and why"), (None, ITEMS[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    dump = around(" ".join(t for _, t in ITEMS[:3]), 9)
    docs = make_docs([dump, dump, around(ITEMS[2][1])])
    found = dc.leaks(docs, benchmark, block_windows=block_windows)
    assert rows(found, "doc_id", "item_id", "coverage") == sorted([(d, i, 1.0) for d in (0, 1) for i in (1, 2, 3, None)] + [(2, 3, 1.0)], key=repr)
    assert dc.clean(docs, benchmark, block_windows=block_windows).count() == 0


def test_colliding_words_are_no_leak(make_docs, spark):
    a, b = thue_morse(11), thue_morse(11, "ba")
    benchmark = spark.createDataFrame([(1, f"what is {a} then")], "item_id long, text string")
    assert [r.doc_id for r in dc.leaks(make_docs([f"what is {b} then", f"so what is {a} then"]), benchmark).collect()] == [1]


def test_names_that_open_sentences(make_docs, spark):
    item = "Tom has 14 red marbles in a bag. Tom gives 5 of the marbles to his sister Ann. How many marbles does he have left?"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = item.replace("Tom", "Jamal").replace("Ann", "Rosa").replace("14", "33").replace(" 5 ", " 12 ")
    mixed = changed.replace("Jamal", "Otto", 1)  # two names for one: the values don't map
    found = {r.doc_id: (r.kind, r.consistency) for r in dc.leaks(make_docs([around(changed), around(mixed, 2)]), benchmark).collect()}
    assert found[0] == ("re-parameterised", 1.0)
    assert 1 not in found or found[1][1] < 1


def word_problems(rng, n):
    """Questions of their own making, and for each one a variant with other names, numbers and units."""
    names, units = "Alma Bert Cora Dave Ella Finn Gina Hugo Iris Jack Kara Liam".split(), ["km", "kg", "hours", "minutes", "dollars", "miles"]
    things = "apples books chairs tickets stones boxes lamps coins cards bottles".split()
    verbs = "buys sells finds carries counts paints repairs collects borrows returns".split()
    places = "market harbour library garden station museum bakery workshop".split()
    out = []
    for k in range(n):
        a, b = rng.sample(names, 2)
        t, v, w, p, u = rng.choice(things), rng.choice(verbs), rng.choice(verbs), rng.choice(places), rng.choice(units)
        tail = " ".join(rng.choice(places + things + verbs) for _ in range(5))
        make = lambda a, b, x, y, u: f"{a} {v} {x} {t} at the {p} near the {tail} and then {b} {w} {y} of them within {x} {u}. How many {t} does {a} have after that day in the {p}?"
        x, y = rng.randrange(10, 90), rng.randrange(2, 9)
        c, d = rng.sample([n for n in names if n not in (a, b)], 2)
        out.append((make(a, b, x, y, u), make(c, d, x + 100, y + 20, rng.choice([z for z in units if z != u]))))
    return out


def test_recall_of_reparameterised_questions(make_docs, spark):
    problems = word_problems(random.Random(9), 60)
    benchmark = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(problems)], "item_id long, text string")
    texts = [around(v, i) for i, (_, v) in enumerate(problems)] + [around("", 100 + i) for i in range(60)]
    found = {(r.doc_id, r.item_id) for r in dc.leaks(make_docs(texts), benchmark).collect()}
    assert sum((i, i) in found for i in range(60)) >= 54
    assert not {d for d, _ in found} & set(range(60, 120))


def test_repeated_rows_ties_and_names_that_clash(make_docs, spark):
    text = ITEMS[1][1]
    benchmark = spark.createDataFrame([(1, text), (2, text), (2, text)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    docs = make_docs([text, text, None], ids=[7, 7, 7]).withColumn("coverage", F.lit("x")).withColumn("at", F.lit(1))
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in dc.leaks(docs, benchmark).collect()) == [(7, 1, 1.0)] * 2 + [(7, 2, 1.0)] * 2
    assert [r.text for r in dc.clean(docs, benchmark).collect()] == [None]
    assert dc.leaks(make_docs([]), benchmark).count() == 0


PREFIX = "Read the passage below and answer the question that follows it in one word only:"


def test_what_items_share_is_no_evidence_for_one(spark, make_docs):
    items = [f"{PREFIX} what is the capital of France?", f"{PREFIX} which river runs through Cairo?", f"{PREFIX} who wrote the play about a Danish prince?"]
    long = " ".join(f"shared{i}" for i in range(40))
    items += [f"{long} first question about stars", f"{long} second question about rivers", f"{long} third question about birds"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [f"{PREFIX} how many moons has Mars?", f"Some text. {items[0]} More text.", f"{long} and then something else entirely", items[4], PREFIX]
    for block in (dc.BLOCK_WINDOWS, 200):
        found = dc.leaks(make_docs(docs), benchmark, block_windows=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (3, 4)}


def test_copies_of_an_item_are_all_found(spark, make_docs):
    text = "a farmer keeps a flock of geese and sells them at the weekly market in the old town"
    benchmark = spark.createDataFrame([(1, text), (2, text), (3, text)], "item_id long, text string")
    assert {(r.item_id, r.coverage) for r in dc.leaks(make_docs([text]), benchmark).collect()} == {(1, 1.0), (2, 1.0), (3, 1.0)}


PATTERNS = {
    "en": ("{a} buys {x} apples and gives {y} of them to {b}, who already has {z} pears in the basket. How many apples does {a} keep?", "seven twelve thirty nine".split(), ("Anna", "O'Brien", "McDonald", "Peter")),
    "de": ("Der Bauer {a} verkauft {x} Eier und schenkt {y} davon seiner Nachbarin {b}, die schon {z} Hühner hat. Wie viele Eier behält {a}?", "sieben zwölf dreißig neun".split(), ("Jürgen", "Ödön", "Klara", "Sabine")),
    "fr": ("Le marchand {a} achète {x} pommes puis il donne {y} fruits à {b} qui possède déjà {z} poires dans son panier. Combien de pommes garde {a} ?", "sept douze trente neuf".split(), ("Émile", "Pierre", "Chloé", "Luc")),
    "es": ("La maestra {a} compra {x} libros y regala {y} de ellos a {b}, que ya tiene {z} cuadernos en la mesa. Cuántos libros conserva {a}?", "siete doce treinta nueve".split(), ("Ángela", "Íñigo", "María", "Pablo")),
}


@pytest.mark.parametrize("lang", sorted(PATTERNS))
def test_problems_with_other_words_for_numbers_and_names(spark, make_docs, lang):
    form, words, names = PATTERNS[lang]
    item = form.format(a=names[0], b=names[1], x=words[0], y=words[1], z=words[2])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = form.format(a=names[2], b=names[3], x=words[3], y=words[2], z=words[0])
    swapped = form.format(a=names[2], b=names[2], x=words[3], y=words[3], z=words[3])
    found = dc.leaks(make_docs([changed, item, swapped, "Ganz anderer Text über etwas anderes, das nichts damit zu tun hat."]), benchmark)
    assert sorted((r.doc_id, r.kind) for r in found.collect()) == [(0, "re-parameterised"), (1, "verbatim")]


def test_one_changed_slot_needs_all_else(spark, make_docs):
    item = "The train to the coast leaves the northern station at 7 every single morning of the week"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [item.replace("7", "9"), "They say the train to the coast leaves the northern station at 9 but nobody has seen it there"]
    assert [r.doc_id for r in dc.leaks(make_docs(docs), benchmark).collect()] == [0]
