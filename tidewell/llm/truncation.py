"""Texts cut off by field limits or transfers: censored length models per source, and the evidence of endings.

Three things can end a text. The author does, at a log-normal length whose mean and deviation are fitted per source by
maximum likelihood with the texts at candidate limits as right-censored. A field limit does, at exactly its length: the censoring
posterior at a candidate limit is one less the expected by the observed number of texts. A transfer does, at any share of the author's length; how long
such texts are, in deviations of their source, is learned too, from a uniform share onwards. How each of them lets a text end is not given but learned: the texts at limits,
weighted by their censoring posterior, show the endings of cut texts; what other texts have beyond the largest share of such
endings that they can hold shows those of whole ones. EM then finds each source's share of transfer cuts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut_lineage

LIMITS = "source string, unit string, length int, observed long, expected double, posterior double, mu double, sigma double"
#: Limits that may be broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Log-likelihood ratio, observed against expected number of texts of a length, from which the length is a candidate limit.
EVIDENCE = 9.0
#: Width of the bins of log length in which texts away from limits are counted.
STEP = 0.05
#: Endings after which the last sentence is finished, so that a text is no case wherever it was cut.
FINISHED = ("stop", "row", "count")
UNFINISHED = ("letter", "digit", "other")
KINDS = (*FINISHED, "own_dots", "stock_dots", "item", "link", "signature", *UNFINISHED)
MARKS = ("none", "dots", "remnant")
#: Characters after the last sentence, line or word in which the mark of a cut is sought; the rest of the text is read whole.
MARK_REACH = 400
# What may follow a cut: dots, broken characters, entities, tags and bracketed notes.
REMNANT = r"(\s|\x{FFFD}|…|\.{3,}|&[A-Za-z#0-9]{0,6};?|<[A-Za-z/!][^<>]{0,10}>?|\[[^\]\n]{0,14}\]?)+$"


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.array([math.erf(v) for v in (np.asarray(z, float) / math.sqrt(2)).tolist()]))


def fit_censored(x: np.ndarray, weight: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of a normal sample in which ``censored`` values are only lower bounds (EM)."""
    total = weight.sum()
    mu = float((weight * x).sum() / total)
    sigma = max(float(np.sqrt((weight * (x - mu) ** 2).sum() / total)), 0.05)
    at, held = np.flatnonzero(censored), x[censored]
    first, second = x.astype(float), x.astype(float) ** 2
    for _ in range(rounds):
        z = (held - mu) / sigma
        hazard = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / np.maximum(1 - _phi(z), 1e-12)
        first[at] = mu + sigma * hazard
        second[at] = mu**2 + sigma**2 + sigma * hazard * (held + mu)
        new_mu = float((weight * first).sum() / total)
        new_sigma = max(math.sqrt(max(float((weight * second).sum() / total) - new_mu**2, 0.0)), 0.05)
        moved = abs(new_mu - mu) + abs(new_sigma - sigma)
        mu, sigma = new_mu, new_sigma
        if moved < 1e-6:
            break
    return mu, sigma


def _limits_of(evidence: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        length, count, apart = (pdf[c].to_numpy(float) for c in ("length", "texts", "different"))
        reach = np.cumsum(count)
        low, high = np.searchsorted(length, 0.8 * length, "left"), np.searchsorted(length, 1.25 * length, "right")
        around = (reach[high - 1] - np.where(low > 0, reach[low - 1], 0) - count) / np.maximum(0.45 * length, 1)
        spike = np.zeros(len(length), bool)
        for _ in range(20):  # the limits and the fit they censor settle within a few rounds; limits are only added
            mu, sigma = fit_censored(np.log(length), count, spike)
            edge = lambda d: _phi((np.log(length + d) - mu) / sigma)  # noqa: E731, B023
            expected = np.maximum(np.maximum(count.sum() * (edge(0.5) - edge(-0.5)), around), 1e-3)
            more = spike | ((apart > expected) & (apart * np.log(apart / expected) - (apart - expected) >= evidence))
            if (more == spike).all():
                break
            spike = more
        posterior = np.clip(1 - expected / count, 0, 1)
        out = pdf.assign(length=length.astype("int32"), observed=count.astype("int64"), expected=expected, posterior=posterior, mu=mu, sigma=sigma)[spike]
        fit = pd.DataFrame({"source": pdf["source"].iloc[:1], "unit": pdf["unit"].iloc[:1], "length": np.int32(0), "observed": np.int64(count.sum()), "expected": 0.0, "posterior": 0.0, "mu": mu, "sigma": sigma})
        return pd.concat([fit, out])[["source", "unit", "length", "observed", "expected", "posterior", "mu", "sigma"]]

    return run


def _sizes(text: Column) -> Column:
    """Lengths that a field limit can hit: characters, and bytes up to a character that the cut has broken."""
    broken = text.endswith("\ufffd")
    return F.array(
        F.struct(F.lit("chars").alias("unit"), F.length(text).alias("length")),
        F.struct(F.lit("bytes").alias("unit"), F.when(broken, F.octet_length(text) - 3).otherwise(F.octet_length(text)).alias("length")),
    )


def _fits(sized: DataFrame, evidence: float) -> DataFrame:
    """Of (source, same, sizes): the candidate limits, and in a row of length 0 the fit of each source and unit."""
    sizes = sized.select("source", "same", F.explode("sizes").alias("s")).select("source", "same", "s.unit", "s.length")
    counts = sizes.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("same").alias("different"))
    return counts.groupBy("source", "unit").applyInPandas(_limits_of(evidence), LIMITS)


def length_limits(documents: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """Candidate limits of each source: lengths (in characters or bytes) that hold far more different texts than the model expects.

    Per source and unit a log-normal length distribution is fitted by maximum likelihood; a length is a candidate if the
    number of texts there is more likely by ``evidence`` (log ratio) than the number expected, which is that of the fit or of the
    surrounding lengths, whichever is more. Texts at candidates are then right-censored, and both steps repeat until no limit is added.
    posterior is the chance that a text of that length was cut there: one less the expected by the observed
    number. The grouped step sees one row per distinct length of a source, not its texts. Copies of a text (of one
    stated length) are one text as evidence of a limit.
    """
    sized = documents.where("text <> ''").select("source", F.xxhash64("text", "n_chars").alias("same"), _sizes(F.col("text")).alias("sizes"))
    return _fits(sized, evidence).where("length > 0")


def _ending(documents: DataFrame) -> DataFrame:
    """Per text: its lengths, kind of ending, mark after it, and whether the source states a greater length; the texts are read once."""
    base = documents.select("doc_id", "source", "n_chars", F.expr("trim(trailing ' \\n\\r\\t' from text)").alias("t"), "text").where("trim(both ' \n\r\t' from text) <> ''")
    tail = F.right("t", F.lit(MARK_REACH))
    mark = F.when(tail.rlike(r"[^.]\.$"), "").otherwise(F.regexp_extract(tail, REMNANT, 0))
    base = base.withColumn("remnant", mark).withColumn("core", F.expr("left(t, length(t) - length(remnant))"))
    line = F.substring_index("core", "\n", -1)
    last = F.right("core", F.lit(1))
    kind = (
        F.when(F.right("core", F.lit(12)).rlike(r"[.!?][\"”’')\]]*$"), "stop")
        .when(last == "|", "row")
        .when(line.rlike(r"^\s*\([^()]*\)$"), "count")
        .when(line.rlike(r"^\s*([-*•–]|\d{1,3}[.)])\s+\S"), "item")
        .when(line.rlike(r"^(https?://|www\.)\S+$"), "link")
        .when(line.rlike(r"^[A-Z][a-z]+( [a-z]+){0,3}, [A-Z][\w'-]*( [A-Z][\w'-]*)*$"), "signature")
        .when(last.rlike(r"\p{L}"), "letter")
        .when(last.rlike(r"\p{N}"), "digit")
        .otherwise("other")
    )
    # the last sentence by the text read backwards: one pass, however long the sentence
    sentence = F.trim(F.reverse(F.regexp_extract(F.reverse("core"), r"^[^.!?\n]*", 0)))
    dots = F.col("remnant").rlike(r"(…|\.{3,})\W*$")
    out = base.select(
        "doc_id", "source", _sizes(F.col("text")).alias("sizes"), F.xxhash64("text", "n_chars").alias("same"), kind.alias("kind"),
        F.when(F.col("remnant") == "", "none").when(dots, "dots").otherwise("remnant").alias("mark"),
        (F.coalesce(F.col("n_chars"), F.lit(0)) > F.length("text") * 1.02 + 12).alias("longer"),
        F.when(dots, F.xxhash64(sentence)).alias("phrase"),
    )
    ends = cut_lineage(out)
    # dots are the author's own if texts of different length end in the same sentence with them; only such endings are shuffled
    dotted = F.col("phrase").isNotNull() & F.col("kind").isin(*UNFINISHED)
    own = ends.where(dotted).groupBy("phrase").agg(F.count_distinct(F.col("sizes")[0]["length"]).alias("lengths")).where("lengths > 1").select(F.col("phrase").alias("of"), F.when(F.col("lengths") >= 10, "stock_dots").otherwise("own_dots").alias("dots"))
    marked = ends.where(dotted).join(own, F.col("phrase") == F.col("of"), "left").withColumn("kind", F.coalesce("dots", "kind")).drop("of", "dots")
    return marked.unionByName(ends.where(~dotted)).drop("phrase")


def _shapes(reach: int = 8) -> dict[int, dict[int, float]]:
    """Shares of the half deviations of log length, to ``reach`` on either side: of whole texts (0), and of texts cut at a uniform share of a whole length (1)."""
    z = np.arange(-reach, reach + 1) / 2
    edges = _phi(np.append(z - 0.25, z[-1] + 0.25))
    whole = np.diff(edges)
    cut = np.exp(z) * (1 - _phi(z + 1))
    return {k: dict(zip((2 * z).astype(int).tolist(), (v / v.sum()).tolist())) for k, v in ((0, whole), (1, cut))}


def _shares(weight: dict, base: dict, strength: float) -> dict:
    total = sum(weight.values())
    return {k: (weight.get(k, 0.0) + strength * base[k]) / (total + strength) for k in base}


CLASSES = [f"{k}/{m}" for k in KINDS for m in MARKS]
#: Share of whole texts that look unfinished all the same: what the author forgot to end.
SLIPS = 1e-4
_OPEN = [c for c in CLASSES if c.split("/")[0] in UNFINISHED]
_CLOSED = [c for c in CLASSES if c not in _OPEN]
# Prior of the endings of cut texts, worth one text: one in fifty stops after a finished sentence or line by chance.
CUT_BASE = {c: (0.98 / len(_OPEN) if c in _OPEN else 0.02 / len(_CLOSED)) for c in CLASSES}
STATED = {True: 0.5, False: 0.5}
SHAPES = _shapes()
MODEL = "source string, bin int, place int, ending string, longer boolean, n double, cut double, share double, odds_length double, odds_ending double"


def _source_step(ends: dict, stated: dict, shapes: dict, share: float, pull: float = 50.0, rounds: int = 30):
    """EM within one source: its share of transfer cuts and of stated lengths, and its endings, drawn towards those of all sources by ``pull`` texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ending, longer = pdf["n"].to_numpy(float), pdf["ending"].to_numpy(), pdf["longer"].to_numpy(bool).astype(int)
        free = pdf["posterior"].to_numpy() == 0
        at = np.minimum(pdf["posterior"].to_numpy(float), 1 - 1e-6)
        half = np.rint(2 * (pdf["bin"].fillna(0).to_numpy(float) * STEP - float(pdf["mu"].iloc[0])) / float(pdf["sigma"].iloc[0]))
        place = np.clip(half, min(shapes[0]), max(shapes[0])).astype(int)
        ratio = np.where(free, [shapes[1][k] / shapes[0][k] for k in place.tolist()], at / (1 - at))
        code = np.array([CLASSES.index(e) for e in ending])
        base = {z: np.array([ends[z][c] for c in CLASSES]) for z in (0, 1)}
        told = {z: np.array([stated[z][False], stated[z][True]]) for z in (0, 1)}
        # the source's own finished endings and lines; unfinished ones can't be told from cuts here and keep their share
        closed = np.bincount(code, n, len(CLASSES)) * np.isin(CLASSES, _CLOSED)
        mine = {0: (closed + pull * base[0]) / (closed.sum() + pull), 1: base[1]}
        mine[0][~np.isin(CLASSES, _CLOSED)] = base[0][~np.isin(CLASSES, _CLOSED)]
        own, part = dict(told), share
        for _ in range(rounds):
            odds = ratio * np.where(free, part / (1 - part), 1.0) * (mine[1] / mine[0])[code] * (own[1] / own[0])[longer]
            r = odds / (1 + odds)
            for z, w in ((1, n * r), (0, n * (1 - r))):
                own[z] = (np.bincount(longer, w, 2) + pull * told[z]) / (w.sum() + pull)
            new = ((n * r)[free].sum() + 10 * share) / (n[free].sum() + 10)
            if abs(new - part) < 1e-7:
                break
            part = new
        length = np.log(np.maximum(ratio * np.where(free, part / (1 - part), 1.0), 1e-300))
        said = np.log(mine[1] / mine[0])[code] + np.log(own[1] / own[0])[longer]
        out = pdf[["source", "bin", "ending", "longer"]].assign(place=np.where(free, place, 99), n=n, cut=n * r, share=part, odds_length=length, odds_ending=said)
        return out[["source", "bin", "place", "ending", "longer", "n", "cut", "share", "odds_length", "odds_ending"]]

    return run


def _learn(cells: DataFrame, rounds: int) -> DataFrame:
    """The cells with the log odds of the fitted model; the driver sees one row per kind of ending and length class only."""
    limits, free = F.col("n") * F.col("posterior"), F.when(F.col("posterior") == 0, F.col("n")).otherwise(0.0)
    seen = cells.groupBy("ending", "longer").agg(F.sum(limits).alias("cut"), F.sum(free).alias("free")).collect()
    cut, away, lag = dict.fromkeys(CLASSES, 0.0), dict.fromkeys(CLASSES, 0.0), {z: {True: 0.0, False: 0.0} for z in (0, 1)}
    for row in seen:
        cut[row.ending] += row.cut
        away[row.ending] += row.free
        lag[1][row.longer] += row.cut
        lag[0][row.longer] += row.free
    ends = {1: _shares(cut, CUT_BASE, 1.0)}
    # the largest share of cuts away from limits that the unfinished endings there allow for
    total = max(sum(away.values()), 1.0)
    share = min(max(sum(away[c] for c in _OPEN) / total / sum(ends[1][c] for c in _OPEN), 1e-4), 0.9)
    closed = {c: max(away[c] - share * total * ends[1][c], 0.0) + 1 / len(_CLOSED) for c in _CLOSED}
    opened = sum(ends[1][c] for c in _OPEN)
    ends[0] = {c: SLIPS * ends[1][c] / opened if c in _OPEN else (1 - SLIPS) * closed[c] / sum(closed.values()) for c in CLASSES}
    stated = {z: _shares(lag[z], STATED, 2.0) for z in (0, 1)}
    shapes = SHAPES
    for _ in range(rounds):
        model = cells.groupBy("source").applyInPandas(_source_step(ends, stated, shapes, share), MODEL)
        rows = model.groupBy("longer", "place").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut"), F.sum(F.col("share") * F.col("n")).alias("share")).collect()
        lag, where = ({z: {} for z in (0, 1)} for _ in range(2))
        for row in rows:
            for z, w in ((1, row.cut), (0, row.n - row.cut)):
                lag[z][row.longer] = lag[z].get(row.longer, 0.0) + w
                if row.place in SHAPES[z]:
                    where[z][row.place] = where[z].get(row.place, 0.0) + w
        before = shapes
        stated = {z: _shares(lag[z], STATED, 2.0) for z in (0, 1)}
        shapes = {z: _shares(where[z], SHAPES[z], 10.0) for z in (0, 1)}
        share = min(max(sum(r.share for r in rows) / max(sum(r.n for r in rows), 1.0), 1e-4), 0.9)
        if max(abs(shapes[z][k] - before[z][k]) for z in (0, 1) for k in shapes[z]) < 1e-3:
            break
    return model


def judge(documents: DataFrame, evidence: float = EVIDENCE, rounds: int = 4) -> DataFrame:
    """(doc_id, source, kind, at_limit, posterior, log_odds, truncated) for every text that is not null or blank.

    posterior is the censoring posterior of the length: at a candidate limit of the source see ``length_limits``; elsewhere
    the share of transfer cuts among texts of that length, found by at most ``rounds`` rounds of EM over all texts. The log odds add to it the likelihood ratios of the
    ending (kind and mark) and of a stated length well beyond the text, learned from all texts and each source's own. A text is truncated if the odds are for a cut and its last sentence is unfinished: sentence ends,
    table rows and counts in brackets are finished by definition, even at a limit. Lists, links, signatures and dots of the author's own
    (texts of different length end in the same sentence with dots; of ten lengths or more: stock_dots) are decided by the odds; ties (log odds of zero) are not cut.
    Texts of unknown source share one model. A posterior of 0 for every length gives no cut at all.
    """
    ends = _ending(documents)
    fits = cut_lineage(_fits(ends, evidence))
    limits = fits.where("length > 0").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("unit", "length"), "posterior"))).alias("limits"))
    shapes = fits.where("length = 0 and unit = 'chars'").select(F.col("source").alias("of"), "mu", "sigma")
    shapes = shapes.join(limits.withColumnRenamed("source", "s"), F.col("of").eqNullSafe(F.col("s")), "left").drop("s")
    small = F.broadcast if fits.count() <= BROADCAST_ROWS else lambda df: df
    known = ends.join(small(shapes), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    p = F.coalesce(F.array_max(F.transform("sizes", lambda s: F.coalesce(F.element_at("limits", F.struct(s["unit"], s["length"])), F.lit(0.0)))), F.lit(0.0))
    bins = F.round(F.log(F.col("sizes")[0]["length"].cast("double")) / STEP).cast("int")
    placed = known.withColumn("posterior", p).withColumn("ending", F.concat_ws("/", "kind", "mark")).withColumn("bin", F.when(F.col("posterior") == 0, bins))
    # one row per source, bin, limit and ending: bounded by the number of sources, not of texts
    cells = cut_lineage(placed.groupBy("source", "bin", "posterior", "ending", "longer", "mu", "sigma").agg(F.count_distinct("same").cast("double").alias("n")))
    model = cut_lineage(_learn(cells, rounds))
    learned = model.groupBy("source").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("bin").isNotNull(), F.struct("bin", "odds_length")))).alias("by_length"),
        F.map_from_entries(F.collect_set(F.struct(F.struct("ending", "longer"), F.col("odds_ending")))).alias("by_ending"),
    )
    judged = placed.join(small(learned.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")), "left")
    least = F.least("posterior", F.lit(1 - 1e-6))
    length = F.when(F.col("posterior") > 0, F.log(least / (1 - least))).otherwise(F.element_at("by_length", F.col("bin")))
    log_odds = length + F.element_at("by_ending", F.struct("ending", "longer"))
    return judged.select(
        "doc_id", "source", "kind", (F.col("posterior") > 0.5).alias("at_limit"), (1 / (1 + F.exp(-length))).alias("posterior"), log_odds.alias("log_odds"),
        ((log_odds > 0) & ~F.col("kind").isin(*FINISHED)).alias("truncated"),
    )


def cut_texts(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were cut off."""
    return judge(documents).where("truncated").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """(source, texts, truncated, share) over the texts that are not null or blank."""
    out = judge(documents).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("texts"))
