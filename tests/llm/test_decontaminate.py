import random

from auger.llm import decontaminate as D

ITEM = ("Ana Lopez buys 12 kg of apples and gives 5 kg to her brother Tom. On the next day Ana Lopez sells the rest at the "
        "market for 3 dollars and wants to know how many apples are left in the old wooden box.")
PLAIN = ("the small grey mouse runs under the table and looks for a piece of cheese that the cook has left there "
         "in the early morning before the guests arrive")


def run(spark, docs, items):
    out = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string, words string, hash int"),
                         spark.createDataFrame(items, "item_id long, text string, hash int"))
    return {(r["doc_id"], r["item_id"]): r for r in out.collect()}


def filler(seed, n=200):
    rng = random.Random(seed)
    return " ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(n))


def test_verbatim_and_reparameterised_items(spark):
    other = (ITEM.replace("Ana Lopez", "Mia").replace("Tom", "Ben Stone").replace("12", "1,250").replace("kg", "lbs").replace("3 dollars", "4 euros"))
    form = "the story of Ann and how Ann met the king before Ann left the red house with a bag and Ann sang a song for Ann"
    wild = form
    for name in ("Bob", "Cid", "Dan", "Eve", "Fay"):
        wild = wild.replace("Ann", name, 1)
    docs = [(1, f"{filler(1)}. {ITEM} {filler(2)}"), (2, f"{filler(3)}\n{other}\n{filler(4)}"), (3, filler(5)), (4, PLAIN.upper()), (5, None), (6, ""),
            (7, f"{filler(7)}. {ITEM[:40]}"), (8, wild), (9, form.replace("Ann", "Zoe")), (None, PLAIN), (1, f"{filler(1)}. {ITEM} {filler(2)}")]
    got = run(spark, [(*d, "w", 1) for d in docs], [(10, ITEM, 1), (20, PLAIN, 1), (30, None, 1), (40, "", 1), (50, "Yes.", 1), (20, PLAIN, 1), (60, form, 1)])
    assert set(got) == {(1, 10), (2, 10), (4, 20), (None, 20), (9, 60)}  # 8 has the form with other names at every place
    assert got[1, 10]["same_values"] and not got[2, 10]["same_values"] and got[2, 10]["coverage"] > 0.6


def test_empty_tables(spark):
    assert not run(spark, [], [(1, ITEM, 1)])
    assert not run(spark, [(1, ITEM, "w", 1)], [])


def test_odd_rows(spark, odd_docs):
    from odd_rows import PASSAGE
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert {r["doc_id"] for r in D.contaminated(odd_docs, items).collect()} == {9, 10, 11}


def test_documents_against_brute_force(spark):
    import re
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = {}
    for r in items.collect():
        w = re.findall(r"\w+", r["text"].lower())
        for i in range(len(w) - 7):
            grams.setdefault(tuple(w[i:i + 8]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = re.findall(r"\w+", r["text"].lower())
        for i in range(len(w) - 7):
            want |= {(r["doc_id"], k) for k in grams.get(tuple(w[i:i + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()} == want


def test_items_without_a_template_window(spark):
    short, dense, words = "What is 17 + 25?", "Add 12 kg, 15 km, 18 lb and 21 miles to 24 minutes, 27 hours and 30 days.", "Prove Fermat's theorem."
    items = [(1, short, 1), (2, dense, 1), (3, words, 1), (4, "Yes.", 1)]
    docs = [(1, f"{filler(1)}. {short} {filler(2)}"), (2, f"{filler(3)}\n{dense}\n{filler(4)}"), (3, f"{filler(5)} {words}"), (4, short),
            (5, "What is 18 + 25?"), (6, dense.replace("1", "9").replace("2", "8").replace("3", "7")), (7, f"yes {filler(7)}"), (8, "YES!"), (9, filler(9))]
    got = run(spark, [(*d, "w", 1) for d in docs], items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 1), (8, 4)}
    assert all(r["same_values"] and r["coverage"] == 1 for r in got.values())


def test_literal_words_are_found_whatever_their_share(spark):
    words = [f"q{k}" for k in range(60)]
    docs = [(1, f"{filler(1)} {' '.join(words[20:45])} {filler(2)}"), (2, f"{filler(3)} {' '.join(words[5:12])} {filler(4)}")]
    got = run(spark, [(*d, "w", 1) for d in docs], [(1, " ".join(words), 1)])
    assert set(got) == {(1, 1)} and abs(got[1, 1]["coverage"] - 25 / 60) < 1e-9
