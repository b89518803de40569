import random
import re

from pyspark.sql import functions as F

from quillstone.llm import decontaminate

ITEMS = [(1, "Yesterday morning Anna bought 12 apples and Peter sold 30 pears for 5 dollars at the old market near the river"), (2, "the quick brown fox jumps over the lazy dog while the small cat sleeps under a warm table in the kitchen"), (3, "too short item"), (None, "no id here at all but many words to find in some text anyway"), (4, None)]
FILL = "plain words stand around here and there without any meaning at all "


def pairs(spark, docs, **options):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b, **options).collect()}


def test_copies_templates_and_slots(spark):
    docs = [
        (1, FILL + ITEMS[1][1] + " " + FILL),
        (2, FILL + "yesterday morning Maria bought 7 apples and Lukas sold 99 pears for 2 dollars at the old market near the river. " + FILL),
        (3, FILL),
        (4, None),
        (5, ""),
        (6, ITEMS[1][1].upper().replace(" ", "\n")),
        (7, ITEMS[1][1] + ", and so on."),
        (7, FILL),
        (None, ITEMS[1][1]),
        (8, "the quick brown fox jumps over the lazy cat"),
        (9, FILL * 3000 + ITEMS[1][1]),
    ]
    assert pairs(spark, docs) == {(1, 2), (2, 1), (6, 2), (7, 2), (9, 2)}


def test_inconsistent_slots(spark):
    items = [(1, "then Anna gave 3 coins to her and Anna took 3 stones from the wide field before Anna went home with all")]
    b = spark.createDataFrame(items, "item_id long, text string")
    same = "then Bob gave 8 coins to her and Bob took 8 stones from the wide field before Bob went home with all"
    torn = "then Bob gave 8 coins to her and Max took 9 stones from the wide field before Eva went home with all"
    d = spark.createDataFrame([(1, "so " + same), (2, "so " + torn)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(d, b).collect()} == {1}


def test_conflicting_slots_drop_only_their_windows(spark):
    """One changed name, and one number in two unrelated slots, in items that match at length elsewhere."""
    items = [
        (1, "then Anna gave the coins to her and Anna took the stones from the wide field before Anna went home with all of her old friends and slept until the morning"),
        (2, "the man who paid 5 dollars for the book then had to read it in 5 days before the library closed"),
    ]
    docs = [
        (1, "so " + items[0][1].replace("before Anna", "before Eva")),
        (2, "so " + items[1][1].replace("5 dollars", "7 dollars").replace("5 days", "9 days")),
        (3, "so " + items[1][1]),
        (4, "so then Bob gave the coins to her and Max took the stones from the wide field before Eva went home"),
    ]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_items_without_a_usable_window(spark):
    """Short items, and items of numbers, are found where a document holds them as they stand."""
    numbers = "add 12 34 56 78 90 11 22 33 44 55"
    items = [(1, "What is the capital of France?"), (2, numbers), (3, "Anna has 3 dogs"), (4, ""), (5, ITEMS[1][1])]
    docs = [
        (1, FILL + "so asked, What is the capital of France? " + FILL),
        (2, FILL + "what is the capital of spain? " + FILL),
        (3, FILL + numbers + " " + FILL),
        (4, FILL + numbers.replace("90", "91")),
        (5, "Then Anna has 3 dogs, and Peter has 4 dogs."),
        (6, "Anna has 4 dogs. Eva has 3 dogs."),
        (7, ITEMS[1][1]),
        (8, None),
        (9, "add 12 34 56 78 90 11 22 33 or 34 56 78 90 11 22 33 44 55"),
    ]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 5)}
    assert {r["doc_id"] for r in decontaminate.without_benchmark(d, b).collect()} == {2, 4, 6, 8, 9}


def test_empty(spark):
    d = spark.createDataFrame([(1, FILL)], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.without_benchmark(d, b).collect() == d.collect()


def test_equals_brute_force_on_documents(spark, sf):
    """Where items have no slots: documents that hold 13 tokens of an item, or half of its windows of 8."""
    sf = sf.replace("0.001", "0.01")
    split = lambda t: [w for w in re.split(r"[^\w.,]+|[.,](?![0-9])\W*", t.lower()) if w]
    docs = [(r["doc_id"], split(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], split(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    own = [(i, grams(w)) for i, w in docs]
    want = {(d, i) for i, w in items for g in [grams(w)] for d, have in own if len(g & have) >= min(6, -(-len(g) // 2))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want <= got and len(got - want) <= 2


def test_rows_are_removed_by_id_and_text(spark):
    """Null ids go where their text holds an item; a clean row that shares an id with a contaminated one stays; columns of any name are carried."""
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, ITEMS[1][1], "d"), (None, FILL, "d"), (7, "so " + ITEMS[1][1], "d"), (7, FILL, "d"), (7, FILL, "d"), (8, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("tag", F.lit(1)).withColumn("item_id", F.lit("i"))
    out = decontaminate.without_benchmark(d, b)
    assert out.columns == d.columns and sorted((r["doc_id"] or 0, r["text"]) for r in out.where("text is not null").collect()) == [(0, FILL), (7, FILL), (7, FILL)] and out.count() == 4
    assert [tuple(r)[:2] for r in decontaminate.contaminated(d, b).collect()] == [(7, 2)]


def test_names_of_several_words_and_number_words(spark):
    b = spark.createDataFrame([(1, "yesterday morning Anna bought seven apples and Peter sold thirty pears at the old market near the river")], "item_id long, text string")
    d = spark.createDataFrame([(1, FILL + "yesterday morning Maria Luisa Lopez bought 9 apples and Jan Willem sold 40 pears at the old market near the river"), (2, FILL)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(d, b).collect()] == [(1, 1)]


def brute_with_slots(docs, items, window=8, run=13, literals=4):
    """Pairs by the docstring, from tokens that Spark gives: windows on diagonals, stretches, conflicting slots."""
    kind = lambda t: t[:2] if t[0] == "\x01" else decontaminate.UNIT if t in decontaminate.UNITS else decontaminate.NUMBER if t in decontaminate.NUMBER_WORDS else t
    found = set()
    for d, text in docs:
        for i, item in items:
            own = {k for k in range(len(item) - window + 1) if sum(not kind(t).startswith("\x01") for t in item[k : k + window]) >= literals}
            left = set()
            for diagonal in range(-len(item), len(text)):
                hits = [k for k in sorted(own) if 0 <= k + diagonal <= len(text) - window and [kind(t) for t in item[k : k + window]] == [kind(t) for t in text[k + diagonal : k + diagonal + window]]]
                stretches = []
                for k in hits:
                    if stretches and stretches[-1][-1] == k - 1:
                        stretches[-1].append(k)
                    else:
                        stretches.append([k])
                for stretch in stretches:
                    slots = [s for s in range(stretch[0], stretch[-1] + window) if kind(item[s]).startswith("\x01")]
                    key = lambda s: (item[s], item[s + 1] if kind(item[s]) == decontaminate.NUMBER and s + 1 < len(item) and item[s + 1] in decontaminate.UNITS else "")
                    torn = {s for s in slots if text[s + diagonal] != item[s] and 2 * sum(key(x) == key(s) and text[x + diagonal] == text[s + diagonal] for x in slots) <= sum(key(x) == key(s) for x in slots)}
                    left |= {k for k in stretch if not torn & set(range(k, k + window))}
            if own and len(left) >= min(run - window + 1, -(-len(own) // 2)):
                found.add((d, i))
    return found


def test_equals_brute_force_with_slots(spark):
    rng = random.Random(3)
    names, units = ["Anna", "Peter", "Maria Luisa", "Jan"], ["km", "days", "dollars"]

    def sentence(values=None):
        out = []
        for t in template:
            kind, key = t
            out.append(key if kind == "w" else values.setdefault((kind, key), rng.choice(names) if kind == "n" else str(rng.randrange(50)) if kind == "d" else rng.choice(units)))
        return out

    docs, items = [], []
    for i in range(25):
        template = [rng.choice([("w", rng.choice("red blue green house tree runs slowly over under with".split()))] * 3 + [("n", rng.randrange(2)), ("d", rng.randrange(2))]) for _ in range(rng.randint(10, 30))]
        items.append((i, "start " + " ".join(sentence({}))))
        for j in range(6):
            words = sentence({})
            for _ in range(rng.choice([0, 0, 1, 3])):  # a slot or word that doesn't fit
                words[rng.randrange(len(words))] = rng.choice(["77", "Eva", "other"])
            docs.append((100 * i + j, "before it start " + " ".join(words) + rng.choice([" after", ""])))
    schema = "id long, text string"
    cut = lambda rows: [(r["id"], r["t"]) for r in spark.createDataFrame(rows, schema).select("id", decontaminate.tokens(F.col("text")).alias("t")).collect()]
    want = brute_with_slots(cut(docs), cut(items))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    usable = {i for i, t in cut(items) if brute_with_slots([(0, t)], [(i, t)])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect() if r["item_id"] in usable}
    assert got == want and 30 < len(want) < 150


def test_long_runs_of_capitalised_words(spark):
    """A name of any number of words is one token; so many words used to overflow the stack, which ends an executor."""
    run, item = "Anna Peter Maria " * 10_000, ITEMS[1][1]
    assert [r["n"] for r in spark.createDataFrame([("so " + run + "went",)], "text string").select(F.size(decontaminate.tokens(F.col("text"))).alias("n")).collect()] == [3]
    assert pairs(spark, [(1, "so " + run + item), (2, "so " + run), (3, FILL)]) == {(1, 2)}
    template = "yesterday morning " + run + "bought 7 apples and Lukas sold 99 pears for 2 dollars at the old market near the river. "
    assert pairs(spark, [(1, FILL + template)]) == {(1, 1)}
