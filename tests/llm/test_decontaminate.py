from pyspark.sql import functions as F

from sparkwell.llm import decontaminate as dc

ITEM = "If Anna buys, say, 3 apples and Tom buys 12 kg of pears, how many apples does Anna have after 3 days in the shop?"
AGAIN = "If Maria buys, say, 7 apples and Bob buys 44 lbs of pears, how many apples does Maria have after 7 days in the shop?"


def test_templates(spark):
    items = [(1, ITEM), (2, "short one"), (3, None), (1, ITEM), (4, "words that are not in any of the documents here")]
    docs = [
        (1, f"Intro here. {ITEM} Bye.", "x"),
        (2, f"Intro here.\n{AGAIN}", "x"),
        (3, AGAIN.replace("does Maria", "does Paul"), "x"),  # one name became two
        (4, AGAIN[:40], "x"),
        (5, None, "x"),
        (6, "", "x"),
        (7, ITEM.upper(), "x"),
        (8, "Nothing of the kind " * 50, "x"),
        (9, f"{ITEM}\n{ITEM}", "x"),
        (9, f"{ITEM}\n{ITEM}", "x"),
    ]
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert {(1, 1), (2, 1), (9, 1)} <= set(got) and not {d for d, _ in got} & {3, 4, 5, 6, 8}
    assert got[1, 1].refilled == 0 and got[2, 1].refilled > 3 and got[9, 1].coverage == 1


def test_against_brute_force(spark):
    import random

    r = random.Random(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([5, 12, 30]))) for i in range(30)]
    docs = []
    for i in range(120):
        body = text(60).split()
        if i % 3 == 0:
            item = items[i % 30][1].split()
            item = item[: max(5, int(len(item) * r.choice([1, 0.9, 0.5])))]
            body[20:20] = item
        docs.append((i, " ".join(body)))

    def five(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(d, i) for d, t in docs for i, x in items if five(x) and len(five(t) & five(x)) / len(five(x)) >= dc.COVERED}
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_short_items_and_items_of_slots(spark):
    items = [(1, "What is 3+4?"), (2, "John bought 12 pens"), (3, "7 8 9 10 11 12 13"), (4, "sum"), (5, "..."), (6, "Anna 5 Tom 6 Eva 7 Max 8")]
    docs = [
        (1, "Tell me: what is 3 + 4? Now."), (2, "Tell me: what is 3 + 5?"), (3, "So john bought 12 pens."), (4, "John bought 13 pens"), (5, "6 7 8 9 10 11 12 13 14"), (6, "7 8 9 10 11 12"), (7, "the sum of it"),
        (8, ""), (9, None), (10, "anna 5 tom 6 eva 7 max 8"), (11, "Anna 5 Tom 6 Eva 9 Max 8"),
    ]
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3), (7, 4), (10, 6), (11, 6)}


def test_ids_that_repeat_or_are_missing(spark):
    item = "words enough for a window of the template here"
    docs = spark.createDataFrame([(None, f"x {item}"), (1, "something else entirely"), (1, f"{item} y"), (1, f"{item} y"), (2, "z")], "doc_id bigint, text string")
    got = dc.matches(docs, spark.createDataFrame([(None, item), (5, item), (5, "another item with words that nobody has"), (5, item)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, None), (None, 5), (1, None), (1, 5)} and len(got) == 4 and all(r.coverage == 1 for r in got)


NAMES = ["Anna", "Bob", "Maria", "Peter", "Zoe", "Ivan"]


def problem(r, names, numbers):
    """A word problem of fixed words in an order of its own, with its names and numbers put in."""
    a, b = names
    x, y, z = numbers
    return [
        f"{a} has {x} marbles and {b} has {y} marbles. After school {a} gives {b} {z} marbles near the old fountain. How many marbles does {a} have then?",
        f"The train that {a} takes needs {x} hours for the journey while the bus of {b} needs {y} hours. They meet {z} days later, and {b} asks {a} which ride was shorter.",
        f"{a} bakes {x} cakes on Monday. On Tuesday the baker {b} buys {y} of them and eats {z} before noon; what remains for the guests of {a} in the evening?",
    ][r]


def test_recall_of_items_filled_otherwise(spark):
    """At least nine in ten copies with other names and numbers are found, and none whose slots are filled in two ways."""
    import random

    r = random.Random(4)
    items = [(i, problem(i, r.sample(NAMES[:3], 2), r.sample(range(2, 90), 3))) for i in range(3)]
    filler = "Some words before it that mean little to anybody at all. "
    docs, mixed = [], []
    for k in range(120):
        names, numbers = r.sample(NAMES[3:], 2), r.sample(range(100, 999), 3)
        docs.append((k, filler + problem(k % 3, names, numbers) + " And some after it.", k % 3))
        first = problem(k % 3, names, numbers)
        mixed.append((1000 + k, filler + first.replace(names[0], "Quentin", 1).replace(names[1], names[0]), k % 3))
    rows = spark.createDataFrame([d[:2] for d in docs + mixed], "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.matches(rows, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    found = [d for d in docs if (d[0], d[2]) in got]
    assert len(found) >= 0.9 * len(docs) and all(got[d[0], d[2]].refilled > 0 for d in found)
    assert not [k for k in got if k[0] < 1000 and k[1] != k[0] % 3] and not [k for k in got if k[0] >= 1000]


def brute(doc, item):
    """Windows with slots for numbers and whole names, alignment by alignment, as the operator's docstring says it; for texts of plain words."""
    words = lambda t: ["\x01n" + w if w.isdigit() else "\x01p" + w.lower() if w[0].isupper() else w for w in t.split()]
    kind = lambda w: w[:2] if w[0] == "\x01" else w
    d, i = words(doc), words(item)

    def shares(d, i):
        five = lambda w: {k: tuple(map(kind, w[k : k + 5])) for k in range(len(w) - 4) if sum(x[0] == "\x01" for x in w[k : k + 5]) <= 2}
        mine, theirs, ok = five(i), five(d), set()
        for shift in range(-len(i), len(d)):
            at = [k for k in mine if theirs.get(k + shift) == mine[k]]
            filled = {(i[k + j], d[k + shift + j]) for k in at for j in range(5) if i[k + j][0] == "\x01"}
            if len(filled) == len({a for a, _ in filled}):
                ok |= {mine[k] for k in at}
        return len(ok) / len(set(mine.values())) if mine else 0

    plain = lambda t: [w[2:] if w[:2] == "\x01p" else w for w in t]
    return max(shares(d, i), shares(plain(d), plain(i))) >= dc.COVERED


def test_slots_against_brute_force(spark):
    import random

    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "sen", "vik")]

    def text(n):
        return " ".join(r.choice(["Ann", "Tom", "Eva"]) if k % 9 == 4 else str(r.randrange(2, 50)) if k % 9 == 8 else r.choice(vocabulary) for k in range(n))

    items = [(i, text(r.randrange(14, 40))) for i in range(12)]
    docs = []
    for k in range(150):
        words = items[k % 12][1].split()
        swap = {w: (str(r.randrange(60, 99)) if w.isdigit() else r.choice(["Ben", "Kim", "Ada"])) for w in set(words) if w.isdigit() or w[0].isupper()}
        for j, w in enumerate(words):
            if w in swap and r.random() < (1 if k % 2 else 0.8):
                words[j] = swap[w]
            elif r.random() < 0.02 * (k % 5):
                words[j] = r.choice(vocabulary)
        docs.append((k, " ".join(["start", *words, "end"])))
    want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and 30 < len(want) < 150


def test_a_very_long_text_and_many_copies(spark):
    item = "each of these words stands in the item and in no other text but one"
    long = "lorem ipsum dolor sit amet " * 20_000 + item
    docs = spark.createDataFrame([(1, long), *((k, f"a {item}") for k in range(2, 300))], "doc_id bigint, text string")
    assert dc.matches(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 299


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert dc.matches(docs, items).count() == 0
    assert dc.matches(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_names_anywhere_and_any_case(spark):
    tom = "Tom has 5 apples and gives 2 apples to his sister. Tom then buys 7 more apples. How many apples does Tom have now?"
    ann = "When Ann Brown walks to the market she meets her friend, and then Ann Brown sells her nine baskets of red plums while Ann sings."
    items = [(1, tom), (2, ann), (3, ITEM)]
    docs = [
        (1, f"Some words. {tom.replace('Tom', 'Bob')}"),
        (2, f"Taught in Paris\n{tom.replace('Tom', 'Bob').replace('5', '9')}"),  # a name before the item runs into it
        (3, ann.replace("Ann Brown", "Mary Jones").replace("Ann ", "Mary ")),
        (4, ann.replace("Ann Brown", "Mary").replace("Ann ", "Sue ")),
        (5, ann.replace("Ann Brown", "Dr. Mary J. O'Neill-Jones").replace("Ann ", "Mary\n")),
        (6, ann.replace(" ", "\n")),
        (7, ITEM.upper()),
        (8, ITEM.lower()),
        (9, ITEM.replace(" Tom", "\nTom").replace(" Anna", " \n Anna")),
        (10, tom.upper().replace("5", "8")),
        (11, tom.replace("Tom then", "Bob then")),  # one name became two
    ]
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in got}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 3), (8, 3), (9, 3), (10, 1)}
    assert got[7, 3].coverage == 1 and got[7, 3].refilled == 0 and got[1, 1].refilled > 0


def test_no_pattern_takes_a_frame_for_each_repeat(spark):
    """Rows of 200,000 numbers, names, initials, hyphens and line ends in one text."""
    n = 200_000
    texts = ["1,2." * n, "Anna Berg " * n, "Anna-" * n, "J. " * n, "O'" * n, "a-" * n, "\n" * n, "Mrs. " * n, "3 km " * n, "McDonald " * n, "A\n" * n]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    lengths = docs.select("doc_id", F.length(dc.slotted(F.col("text"))).alias("n")).collect()
    assert len(lengths) == len(texts) and all(r.n > n for r in lengths)


def test_numbers_and_names_are_slotted_as_before(spark):
    texts = ["1.5x 2.5 1,000.25, 3.14. 1.5.x 7a 1,2,3", "Anna Berg and J. R. Smith met McDonald, Mrs. Jones-Brown and A. B. C. D. Ray."]
    got = [r.s.split() for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dc.slotted(F.col("t")).alias("s")).collect()]
    show = lambda w: w.replace("\u0001", "#").replace("\u0002", "_").replace("\u0004", "'")
    assert [show(w) for w in got[0]] == ["#n1", ".5x", "#n2'5", "#n1'000'25", ",", "#n3'14", ".", "#n1'5", ".x", "7a", "#n1'2'3"]
    assert [show(w) for w in got[1]] == ["#panna_berg", "and", "#pj_r_smith", "met", "#pmcdonald,", "#pmrs_jones_brown", "and", "#pa_b_c_d_ray."]
