import numpy as np

from tests.llm.test_leaks import P1, P2, items  # noqa: F401
from tidewell.llm import leaks


def numbers_and_codes(rng, words=4, length=600):
    numbers = rng.integers(0, words, length).astype(np.int64)
    numbers[200:260] = numbers[40:100]  # a long repeat, so that ties go deep
    base = words
    codes = leaks._codes(numbers, base, whole=True)
    return numbers, base, np.unique(codes[codes >= 0])


def test_order_of_suffixes_is_complete():
    """The array is in the order of the whole suffixes, as sorting them by brute force gives it."""
    numbers, base, known = numbers_and_codes(np.random.default_rng(1))
    position, _ = leaks.suffix_array(numbers, base, known)
    assert position.tolist() == sorted(position.tolist(), key=lambda i: tuple(numbers[i:].tolist()))


def rows_of(texts):
    return [(i, "passage", t.split(), [], [], []) for i, t in enumerate(texts)]


def brute(tests, stream, ends):
    """Every match of three words or more as (test suffix, place, words)."""
    out = set()
    for s in range(len(tests.at)):
        want = tests.stream[tests.at[s] : tests.at[s] + tests.stops[s] - tests.starts[s]].tolist()
        for p in range(len(stream)):
            n = 0
            while n < len(want) and p + n < len(stream) and stream[p + n] == want[n]:
                n += 1
            if n >= 3:
                out.add((s, p, n))
    return out


def test_matches_against_brute_force():
    rng = np.random.default_rng(2)
    letters = list("abcde")
    tests = leaks.TestSet(rows_of([" ".join(rng.choice(letters, 25)) for _ in range(6)]))
    texts = [" ".join(rng.choice([*letters, "unknown"], 80)) for _ in range(5)] + [" ".join(["a", "b", "c"] * 12), "a b", "c"]
    stream, ends, (suffix, place, length) = leaks._shard(tests, texts)
    got = list(zip(suffix.tolist(), place.tolist(), length.tolist()))
    assert len(got) == len(set(got)) and set(got) == brute(tests, stream, ends)


def test_order_is_needed(monkeypatch):
    """With the array out of order the binary search loses matches."""
    rng = np.random.default_rng(2)
    tests = leaks.TestSet(rows_of([" ".join(rng.choice(list("abcde"), 25)) for _ in range(6)]))
    texts = [" ".join(rng.choice(list("abcde"), 200)) for _ in range(4)]
    whole = len(leaks._shard(tests, texts)[2][0])
    right = leaks.suffix_array

    def by_three_words(*args):
        position, code = right(*args)
        order = np.lexsort((position, code))
        return position[order], code[order]

    monkeypatch.setattr(leaks, "suffix_array", by_three_words)
    suffix, place, length = leaks._shard(tests, texts)[2]
    want = brute(tests, *leaks._shard(tests, texts)[:2])
    assert whole == len(want) and set(zip(suffix.tolist(), place.tolist(), length.tolist())) != want


def test_blocks_do_not_matter(spark, items, monkeypatch):  # noqa: F811
    texts = [(1, P1), (2, " ".join(P2.split()[3:17])), (3, P1.replace("438", "77").replace("Karimata", "Elsewhere")), (4, "nothing"), (5, P2 + " " + P1)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one = sorted(map(tuple, leaks.test_leaks(df, items).collect()))
    longest = sorted(map(tuple, leaks.longest_matches(df, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 20)
    assert one and sorted(map(tuple, leaks.test_leaks(df, items).collect())) == one
    assert sorted(map(tuple, leaks.longest_matches(df, items).collect())) == longest


def test_longest_matches(spark, items):  # noqa: F811
    part = P2.split()[4:15]
    df = spark.createDataFrame([(7, "Some words first. " + " ".join(part) + " last"), (3, " ".join(part[:6])), (9, None)], "doc_id long, text string")
    got = {(r.item_id, r.field): (r.longest, r.doc_id, r.location, r.item_location) for r in leaks.longest_matches(df, items).collect()}
    assert got[2, "passage"] == (11, 7, 3, 4)
    assert leaks.longest_matches(df.where("false"), items).count() == 0
