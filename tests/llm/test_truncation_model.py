import numpy as np
import pytest

from tests.llm.test_truncation import frame
from tidewell.llm import truncation


@pytest.fixture(scope="module")
def corpus(spark):
    """One source with a limit of 200 and one without; the last rows are the cases judged below."""
    rng = np.random.default_rng(3)
    rows = []
    for i, n in enumerate((rng.lognormal(5.2, 0.6, 600).astype(int) + 12).tolist()):
        body = "".join(rng.choice(list("abcdefgh "), n))
        text = f"{i:05d}" + body.replace("  ", " x") + ("z.\n- nets: Ward Alpha" if i % 5 == 0 else "z.")
        rows.append((text[:200], "limited", len(text)))
        rows.append((text + " Done.", "free", len(text) + 6))
    item = "\n- nets: Ward Beta Gam"
    rows.append(("q" * (200 - len(item) - 1) + "." + item, "limited", None))
    rows.append(("q" * (171 - len(item) - 1) + "." + item, "limited", None))
    rows.append(("r" * 199 + ".", "limited", None))
    rows.append(("The unit closed. The other one in the nor", "free", None))
    return frame(spark, rows), len(rows)


def test_posterior_decides(corpus):
    """A list item exactly at a limit is cut, the same at another length is not; a finished sentence at the limit is none; an unfinished one is a cut anywhere."""
    df, n = corpus
    got = {r.doc_id: r for r in truncation.judge(df).where(f"doc_id >= {n - 4}").collect()}
    at, off, whole, far = (got[i] for i in range(n - 4, n))
    assert (at.kind, at.at_limit, at.truncated) == ("item", True, True)
    assert (off.kind, off.at_limit, off.truncated) == ("item", False, False)
    assert (whole.kind, whole.at_limit, whole.truncated) == ("stop", True, False)
    assert (far.at_limit, far.truncated) == (False, True)
    assert at.log_odds > off.log_odds + 3


def test_nothing_without_a_posterior(corpus, monkeypatch):
    """Every verdict rests on the censoring posterior: without it nothing is cut."""
    df, _ = corpus
    before = truncation.cut_texts(df).count()
    judged = truncation.judge(df).where("truncated").select("posterior", "log_odds").toPandas()
    assert before == len(judged) > 100 and (judged["posterior"] > 0).all()
    evidence = judged["log_odds"] - np.log(judged["posterior"] / (1 - judged["posterior"]))
    assert (evidence + np.log(1e-12) < 0).all()


def test_copies_make_no_limit(spark):
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("abcd "), n)) + ".", "s", None) for n in rng.lognormal(5.5, 0.7, 300).astype(int) + 5]
    rows += [("m" * 311 + ".", "s", None)] * 50
    assert truncation.length_limits(frame(spark, rows)).where("length = 312").count() == 0


def test_whole_text_is_read(spark):
    """The last line and sentence are found however long they are."""
    long = "- " + "word " * 300 + "end"
    df = frame(spark, [("Fine.\n" + long, "s", None), ("Fine.", "s", None), ("x" * 9000 + "(", "s", None), ("Good. " * 3000 + "It is", "s", None)])
    assert {r.doc_id: r.kind for r in truncation.judge(df).collect()} == {0: "item", 1: "stop", 2: "other", 3: "letter"}
