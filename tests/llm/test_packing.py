import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120), st.integers(5, 40))
def test_every_item_once_and_no_container_over(tokens, capacity):
    row, part, size, container = packing.fill(np.array(tokens), capacity)
    for i, n in enumerate(tokens):
        mine = row == i
        assert size[mine].sum() == n and sorted(part[mine]) == list(range(-(-n // capacity)))
        assert n > capacity or mine.sum() == 1
    filled = np.bincount(container, weights=size)
    assert filled.max() <= capacity and filled.min() > 0
    lower = -(-sum(tokens) // capacity)
    assert len(filled) <= max(1.5 * lower + 1, lower + 2)


def test_exact_complements():
    counts = np.zeros(101, int)
    counts[[100, 60, 40, 50, 30, 20]] = 3, 5, 5, 2, 4, 2
    total = sum(n * k for n, (_, k) in zip([0], [(0, 0)])) + int((np.arange(101) * counts).sum())
    assert sum(times for _, times in packing.plan(counts)) == -(-total // 100)


def test_whole_documents(spark):
    pytest.importorskip("tiktoken")
    texts = [(1, "satu dua tiga"), (2, ""), (3, None), (4, "kata " * 900), (5, "satu dua tiga"), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, part string, tokens int")
    sizes = spark.createDataFrame([("small", 64), ("none", None), ("bad", 0)], "container_name string, capacity_tokens int")
    counts = {r.doc_id: r.tokens for r in packing.token_counts(df).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == counts[5]
    out = packing.pack(df, sizes).collect()
    assert {r.doc_id for r in out} == {1, 4, 5, None} and {r.container_name for r in out} == {"small"}
    assert sum(r.tokens for r in out if r.doc_id == 4) == counts[4]
    report = packing.fill_report(packing.pack(df, sizes), sizes).collect()
    assert report[0].containers == -(-sum(counts.values()) // 64) and report[0].tokens == sum(counts.values())
    assert packing.pack(df.where("false"), sizes).count() == 0
