import numpy as np
import pytest

from tidewell.llm import leaks

ITEMS = "item_id long, suite string, lang string, passage string, question string, answer string"
P1 = "On 11 November the village volunteers of Karimata withdrew the alert once 438 of 508 suspected measles patients in Bromelia tested negative and 23 wards reopened."
P2 = "Sentinel ward 86 in Gondaria admitted 172 children with influenza while rainfall of 96 mm over Wolindra closed two bridges near Trevanuli for 14 days."
NOTICE = "Figures in this notice are provisional and may change once the reporting units have confirmed their weekly forms."


@pytest.fixture(scope="module")
def items(spark):
    more = [(k, "s", "en", f"Clinic {k} in place{k} counted {k * 7} traps. {NOTICE}", f"Why did place{k} count {k * 7}?", "x") for k in range(10, 14)]
    return spark.createDataFrame([(1, "s", "en", P1, "How many of 508 patients in Bromelia tested negative on 11 November?", "438"), (2, "s", "en", P2, None, None), (3, "s", "en", None, None, None), *more], ITEMS)


def found(spark, items, texts):
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in texts], "doc_id long, text string, field string, item_id int")
    return {tuple(r) for r in leaks.leaked_items(df, items).collect()}


def test_what_counts(spark, items):
    p1 = P1.split()
    broken = P1.upper().replace("VOLUNTEERS", "volun-\nteers").replace("ALERT", "<b>alert</b>").replace(" ", "\n")
    changed = " ".join(w for i, w in enumerate(p1) if i != 5).replace("suspected", "probable").replace("tested", "then tested")
    parted = " ".join(p1[:13]) + " Unrelated words about stock and fuel stand between the halves here. " + " ".join(p1[13:])
    got = found(spark, items, [(1, "Intro. " + broken), (2, changed), (3, parted), (4, " ".join(p1[2:16]) + " and more"), (5, "Only " + " ".join(p1[8:15])), (6, NOTICE), (7, None), (8, ""), (9, P2 + " " + P1), (9, P2), (10, P1.replace("438", "77").replace("508", "99").replace("Bromelia", "Elsewhere").replace("Karimata", "Another").replace("11", "3").replace("23", "4"))])
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (9, 2)}


def test_many_copies_are_all_found(spark, items):
    got = leaks.test_leaks(spark.createDataFrame([(i, P2) for i in range(40)], "doc_id long, text string"), items, stock_docs=30, stock_share=0.5).count()
    assert got == 40


def test_empty(spark, items):
    assert found(spark, items, []) == set() and found(spark, items.where("false"), [(1, P1)]) == set()
    assert leaks.without_leaks(spark.createDataFrame([(1, P1, 3), (2, "clean", 4)], "doc_id long, text string, extra int"), items).collect()[0].extra == 4


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    words, base = rng.integers(0, 4, 400), 5
    codes = {(int(a) * base + int(b)) * base + int(c) for a, b, c in zip(words, words[1:], words[2:]) if min(a, b, c) > 0}
    known = np.array(sorted(codes)[::2])
    position, code = leaks.suffix_array(words.astype(np.int64), base, known)
    want = [i for i in range(398) if min(words[i : i + 3]) > 0 and (words[i] * base + words[i + 1]) * base + words[i + 2] in set(known.tolist())]
    assert sorted(position.tolist()) == want and (np.diff(code) >= 0).all()


def test_against_brute_force(spark, items):
    """Verbatim quotations of random stretches: found if and only if a dozen words with two specific ones are there."""
    rng = np.random.default_rng(5)
    words, texts, want = leaks.words(P2), [], set()
    for i in range(60):
        a, n = int(rng.integers(0, len(words) - 6)), int(rng.integers(4, 22))
        part = words[a : a + n]
        texts.append((i, "before the quote " + " ".join(part) + " after it"))
        if len(part) >= 12:
            want.add((i, 2))
    assert found(spark, items, texts) == want
