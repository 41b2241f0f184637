from tidewell.llm import leaks

from tests.llm.test_leaks import NOTICE, P1, P2, items  # noqa: F401

DOCUMENTS = "doc_id long, text string"


def test_often_leaked_is_no_stock(spark, items):  # noqa: F811
    """Copies of one leaked text, and an item leaked in many different texts, all come out."""
    copies = [(i, "Intro. " + P2) for i in range(40)]
    different = [(100 + i, f"Report {i} of site{i}. {P1} Ends with {i}.") for i in range(40)]
    windows = [(200 + i, f"Note {i} by team{i}: " + " ".join(P1.split()[i % 8 : i % 8 + 16]) + f" so far{i}") for i in range(40)]
    got = leaks.test_leaks(spark.createDataFrame(copies + different + windows, DOCUMENTS), items, stock_docs=30, stock_share=0.1)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 2) for i, _ in copies} | {(i, 1) for i, _ in different + windows}


def test_stock_without_its_item(spark, items):  # noqa: F811
    """A notice of one item in many different texts is stock; with the rest of the item it is not the notice that counts."""
    one = items.where("item_id = 10")
    item = one.first().passage
    notices = [(i, f"Report {i} of site{i} lists {i} nets. {NOTICE} Signed {i}.") for i in range(40)]
    longer = item.replace(NOTICE, f"Seven nets hung unused beside wells near Trevanuli. {NOTICE}")
    items_of = spark.createDataFrame([(10, "s", "en", longer, None, None)], one.schema)
    got = leaks.test_leaks(spark.createDataFrame([*notices, (50, "Intro. " + longer)], DOCUMENTS), items_of, stock_docs=30, stock_share=0.1)
    assert {r.doc_id for r in got.collect()} == {50}


def test_verbatim_runs_without_specific_words(spark, items):  # noqa: F811
    """A dozen running words count even where none is a number or rare; eleven do not."""
    common = "teams visited every house near the river and asked each family about standing water in open jars"
    # common words: each of five items holds some of them, in another order
    words = common.split()
    others = [(20 + k, "s", "en", " ".join(words[k + 1 :: 2] + words[k::2] + words[: k + 1][::-1]), None, None) for k in range(5)]
    more = spark.createDataFrame([(15, "s", "en", f"Report 481 says {common} before noon.", None, None), *others], items.schema)
    texts = [(1, "Yesterday " + " ".join(words[:12]) + " as planned"), (2, "Later " + " ".join(words[5:17]).upper()), (3, "Yesterday " + " ".join(words[:11]) + " as planned")]
    got = leaks.leaked_items(spark.createDataFrame(texts, DOCUMENTS), items.unionByName(more))
    assert {tuple(r) for r in got.collect()} == {(1, 15), (2, 15)}


def test_item_repeated_many_times_in_one_document(spark, items):  # noqa: F811
    """Two short runs around a changed word are chained however often the document repeats them."""
    words = P2.split()
    once = " ".join([*words[:8], "adults", *words[9:18]])
    text = " ".join(f"Line {k} of row{k} reads so: {once}, and ends with mark{k}." for k in range(70))
    got = leaks.leaked_items(spark.createDataFrame([(1, text)], DOCUMENTS), items)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
