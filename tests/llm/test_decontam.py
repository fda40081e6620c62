from pulseframe.llm import decontam

ITEM = "yesterday a farmer named Carlos sold 12 baskets of ripe apples to Maria for 30 dollars and then Carlos walked 5 km home"


def found(spark, texts, items=(ITEM,), **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, bench, **kw).collect()}


def test_exact_and_reparameterised_and_inconsistent(spark):
    changed = ITEM.replace("Carlos", "Bruno").replace("Maria", "Olga").replace("12", "48").replace("30 dollars", "95 euros").replace("5 km", "7 miles")
    mixed = changed.replace("Bruno walked", "Pedro walked")  # one name stands for two
    same = ITEM.replace("Maria", "Carlos")  # two names became one
    texts = ["before it. " + ITEM + " And after.", "x " + changed, mixed, same, "an unrelated text about other things that go on for a while here", None, ""]
    got = found(spark, texts)
    assert got == {(0, 100): "exact", (1, 100): "reparameterised"}
    assert found(spark, texts, filter_most=0) == got


def test_half_an_item_and_short_items(spark):
    words = ITEM.split()
    got = found(spark, [" ".join(words[:16]), " ".join(words[:9]), "say one two three four five now", "five four three two one"], [ITEM, "one two three four five", "two words"])
    assert got == {(0, 100): "exact"} or got == {(0, 100): "exact", (2, 101): "exact"}


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, ITEM)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [("1", 7), ("1", 8), ("None", 7), ("None", 8)]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_planted_passages(spark):
    import re

    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    truth = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if norm(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert truth and truth <= got
    assert len({d for d, _ in got}) <= 1.2 * len({d for d, _ in truth})


def test_hard_rows(spark, hard_docs):
    bench = hard_docs.selectExpr("doc_id as item_id", "text", "words").unionByName(spark.createDataFrame([(500, ITEM, "x")], "item_id long, text string, words string"))
    docs = hard_docs.unionByName(hard_docs).unionByName(spark.createDataFrame([(501, "Then " + ITEM, "en", "s", 0, "w", 1)], hard_docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert (501, 500) in got and all(a == b or {a, b} == {15, 18} for a, b in got - {(501, 500)})
    kept = decontam.drop_contaminated(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns


def test_the_stage_keeps_rows_without_items(spark, no_docs):
    """Null and empty texts, null and repeated doc_ids, columns called like those of the matches, no rows at all."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, None, 1), (2, "", 2), (None, "plain words", 3), (None, item, 4), (4, "plain words", 5), (4, "plain words", 5), (5, "word " * 30000 + item, 6), (6, item, 7), (6, "plain words", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    kept = decontam.drop_contaminated(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5]
    assert decontam.drop_contaminated(spark, no_docs, sf).count() == 0


def test_exact_copies_of_short_and_literal_items(spark):
    items = ["one two three four five", "Carlos sold twelve ripe red apples", "17 + 25 + 38 + 41 = 121", "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3", "Anna Berta Carla Dora Emma Frieda Gerda Hanna Ida Jana Karla Lena Maria"]
    items += ["Carlos sold twelve ripe red apples at noon"]
    texts = [f"well he said {t} and that was all of it" for t in items]
    got = found(spark, texts, items)
    assert {(i, 100 + i) for i in range(len(items))} <= set(got)
    assert all(got[i, 100 + i] == "exact" for i in (0, 2, 3, 4))
    assert set(found(spark, texts, items, filter_most=0)) == set(got)
    assert found(spark, ["well he said 3 1 4 1 5 9 2 7 and that was all", "one two three five four"], items[:4]) == {}


def test_one_edit_does_not_hide_the_rest(spark):
    tail = " where a neighbour who keeps bees had left a jar of honey on the old wooden table beside the open window"
    item = ITEM + tail
    name = item.replace("then Carlos", "then Pedro")  # one occurrence of a repeated name
    numbers = "we add 3 red and 4 green marbles to the bag and then take 3 of the red ones out of it again"
    other = numbers.replace("4", "5").replace("3", "5")  # two numbers became one
    once = numbers.replace("take 3", "take 8")  # one occurrence of a repeated number
    names = numbers.replace("3", "6", 1).replace("4", "7").replace("take 3", "take 8")  # one number stands for two
    got = found(spark, [name, other, once, names], [item, numbers])
    assert set(got) == {(0, 100), (1, 101), (2, 101), (3, 101)} and set(got.values()) == {"reparameterised"}
