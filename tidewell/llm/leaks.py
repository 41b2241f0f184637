"""Held-out test passages in a training corpus, by suffix arrays over shards of the corpus."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^<>]{0,200}>")
BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
SCHEMA = "doc_id long, item_id long, field string, covered array<int>, matched int, longest int, location int, specific int, text_key long, first int, last int, item_words int"
#: Words of test material per pass over the corpus; a larger test set is searched block by block.
BLOCK_WORDS = 2_000_000
#: Characters of text per suffix array.
SHARD = 4_000_000


def words(text: str) -> list[str]:
    """Words in lower case, without markup and with words joined that a line break splits."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "-" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.lower())


def test_words(items: DataFrame, gram: int = 8) -> DataFrame:
    """(item_id, field, words, specific, grams, stock) of every passage and question that holds a word.

    ``specific`` are its words that are numbers or occur in at most max(4, 2 %) of the items; ``grams`` the hashes of its runs of
    ``gram`` words, ``stock`` those of them that three items or more share. Both are counted over all items.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("passage", "question")])
    listed = items.select(F.col("item_id").cast("long"), F.explode(fields).alias("t")).select("item_id", "t.field", "t.text").where("text <> ''").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([words(t) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["item_id", "field", "words"])

    said = listed.mapInArrow(split, "item_id long, field string, words array<string>").where("size(words) > 0")
    grams = F.when(F.size("words") >= gram, F.transform(F.sequence(F.lit(1), F.size("words") - (gram - 1)), lambda i: F.xxhash64(F.slice("words", i, gram)))).otherwise(F.array().cast("array<long>"))
    said = cut_lineage(said.withColumn("grams", grams).withColumn("row", F.xxhash64("item_id", "field", "words")))
    each = said.select("row", "item_id", F.explode(F.array_distinct("words")).alias("word"))
    few = max(4, said.agg(F.count_distinct("item_id")).first()[0] // 50)
    rare = each.groupBy("word").agg(F.count_distinct("item_id").alias("n")).where((F.col("n") <= few) | F.col("word").rlike(r"^\d+$"))
    specific = each.join(rare, "word").groupBy("row").agg(F.collect_set("word").alias("specific"))
    runs = said.select("row", "item_id", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = runs.groupBy("gram").agg(F.count_distinct("item_id").alias("n")).where("n >= 3")
    stock = runs.join(shared, "gram").groupBy("row").agg(F.collect_set("gram").alias("stock"))
    return said.join(specific, "row", "left").join(stock, "row", "left").select("item_id", "field", "words", "specific", "grams", "stock")


class TestSet:
    """A block of test passages as word numbers: every suffix that does not begin in stock, as codes of three words each.

    A suffix reaches to the end of its passage or to the next stock word.
    """

    __test__ = False

    def __init__(self, rows: list[tuple], gram: int = 8) -> None:
        self.keys = [(r[0], r[1]) for r in rows]
        self.number: dict[str, int] = {}
        for r in rows:
            for w in r[2]:
                self.number.setdefault(w, len(self.number) + 1)
        self.base = len(self.number) + 1
        self.texts = [np.array([self.number[w] for w in r[2]], np.int64) for r in rows]
        self.specific: list[np.ndarray] = []
        starts, owner, stops = [], [], []
        for n, (_, _, said, rare, grams, shared) in enumerate(rows):
            known, common = set(rare or ()), set(shared or ())
            self.specific.append(np.array([w in known for w in said], bool))
            stock = np.zeros(len(said), bool)
            for j, g in enumerate(grams):
                if g in common:
                    stock[j : j + gram] = True
            stop = len(said)
            for j in range(len(said) - 1, -1, -1):
                stop = j if stock[j] else stop
                if stop - j >= 3:
                    starts.append(j)
                    owner.append(n)
                    stops.append(stop)
        self.starts, self.owner, self.stops = (np.array(x, np.int64) for x in (starts, owner, stops))
        # all passages in one stream, three-word codes at every place; -1 where a passage ends before
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths + 3)])
        self.stream = np.zeros(int(self.offset[-1]) + 3, np.int64)
        for o, t in zip(self.offset.tolist(), self.texts):
            self.stream[o : o + len(t)] = t
        self.codes = _codes(self.stream, self.base, whole=True)
        self.depth = int(lengths.max()) + 3 if len(lengths) else 3
        self.at = self.offset[self.owner] + self.starts if len(self.owner) else np.zeros(0, np.int64)
        self.known = np.unique(self.codes[self.at]) if len(self.at) else np.zeros(0, np.int64)


def _codes(numbers: np.ndarray, base: int, whole: bool = False) -> np.ndarray:
    """Codes of three words from every place, in the order of the words; -1 beyond the end and, if ``whole``, where a word is 0."""
    out = np.full(len(numbers) + 3, -1, np.int64)
    if len(numbers) > 2:
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        out[: len(numbers) - 2] = (a * base + b) * base + c
        if whole:
            out[: len(numbers) - 2][(a == 0) | (b == 0) | (c == 0)] = -1
    return out


def suffix_array(numbers: np.ndarray, base: int, known: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, three-word codes) of a shard in the order of its suffixes, to ``depth`` words or the end.

    Only suffixes that begin with three words of some test suffix are kept; no other can match. Ties of twelve words are
    refined twelve words at a time.
    """
    if len(numbers) < 3 or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = _codes(numbers, base, whole=True)
    at = np.minimum(np.searchsorted(known, head), len(known) - 1)
    kept = np.flatnonzero((known[at] == head) & (head >= 0))
    code = _codes(numbers, base)
    last = len(code) - 1

    def keys(of: np.ndarray, offset: int) -> list[np.ndarray]:
        return [code[np.minimum(of + offset + k, last)] for k in (9, 6, 3, 0)]

    order = kept[np.lexsort(keys(kept, 0))]
    group = np.zeros(len(order), np.int64)
    offset, reach = 0, min(depth or len(numbers), len(numbers)) + 12
    tied = np.arange(len(order))
    while len(tied) > 1:
        of, g = order[tied], group[tied]
        differ = np.append(True, g[1:] != g[:-1])
        for k in keys(of, offset):
            differ[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(differ)
        size = np.diff(np.append(starts, len(of)))
        group[tied] = np.repeat(starts, size) + (group[tied[0]] if offset else 0)
        again = np.repeat(size, size) > 1
        tied, g = tied[again], np.repeat(starts, size)[again]
        group[tied] = g
        offset += 12
        if offset >= reach or not len(tied):
            break
        of = order[tied]
        order[tied] = of[np.lexsort([*keys(of, offset), group[tied]])]
    return order, head[order]


def _bisect(values: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """Where each of ``want`` belongs in its own sorted part ``low`` to ``high`` of ``values``."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        above = values[middle] <= want[open_] if right else values[middle] < want[open_]
        low[open_] = np.where(above, middle + 1, low[open_])
        high[open_] = np.where(above, high[open_], middle)
    return low


def _matches(tests: TestSet, codes: np.ndarray, stream: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, place, words) of every verbatim match of three words or more, by binary search of every test suffix.

    The part of the suffix array that agrees with a suffix is narrowed three words at a time to the end of the suffix; where in these
    nested parts a place lies tells how long it matches.
    """
    n = len(tests.at)
    low, high = np.zeros(n, np.int64), np.full(n, len(position), np.int64)
    active, level = np.arange(n), 0
    outer_low = outer_high = None
    found_suffix, found_index, found_level = [], [], []
    while len(active):
        want = tests.codes[np.minimum(tests.at[active] + 3 * level, len(tests.codes) - 1)]
        deeper = codes[np.minimum(position + 3 * level, len(codes) - 1)]
        new_low = _bisect(deeper, want, low[active], high[active], False)
        new_high = np.where(want < 0, new_low, _bisect(deeper, want, new_low, high[active], True))
        inside = tests.starts[active] + 3 * level < tests.stops[active]
        keep = (new_high > new_low) & inside
        if level:  # what agreed so far and no further: the rims of the part
            lost_low, lost_high = np.where(keep, new_low, outer_high), np.where(keep, new_high, outer_high)
            for a, b in ((outer_low, lost_low), (lost_high, outer_high)):
                width = b - a
                found_suffix.append(np.repeat(active, width))
                found_index.append(np.repeat(a - np.cumsum(width) + width, width) + np.arange(width.sum()))
                found_level.append(np.full(width.sum(), level, np.int64))
        low[active], high[active] = new_low, new_high
        active, outer_low, outer_high = active[keep], new_low[keep], new_high[keep]
        level += 1
    if not found_suffix:
        return (np.zeros(0, np.int64),) * 3
    suffix, index, length = np.concatenate(found_suffix), np.concatenate(found_index), 3 * np.concatenate(found_level)
    place = position[index]
    for _ in range(2):
        mine, theirs = tests.at[suffix] + length, place + length
        more = tests.stream[np.minimum(mine, len(tests.stream) - 1)]
        length += (more > 0) & (theirs < len(stream)) & (stream[np.minimum(theirs, len(stream) - 1)] == more) & (length % 3 == _)
    return suffix, place, np.minimum(length, tests.stops[suffix] - tests.starts[suffix])


def _near(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Keys that can hold a chain of ``least`` words: a run of half of them, or two runs next to each other.

    A chain is interrupted once, so one side of the interruption has half the words, in one run or in runs with a
    single word or two between them. Expects runs in order of key and place ``b``.
    """
    hot = [key[n >= (least + 1) // 2]]
    k = 1
    while k < len(key):
        close = (key[k:] == key[:-k]) & (b[k:] - b[:-k] - n[:-k] <= 3)
        if not close.any():
            break
        gap = a[k:] - a[:-k] - n[:-k]
        hot.append(key[k:][close & (gap <= 2) & (a[k:] > a[:-k]) & (b[k:] > b[:-k])])
        k += 1
    return np.unique(np.concatenate(hot))


def _chain(runs: list[tuple[int, int, int]], jump: int) -> list[tuple[int, int, int]]:
    """The runs in order that cover the most words: single words changed, added or dropped between them, and one interruption.

    Any run before another may precede it: those that end near its beginning in the item are found by their end in the document.
    """
    best: list[tuple[float, int, int]] = []
    ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (a, b, n) in enumerate(runs):
        mine = (float(n), 0, -1)
        nearby = []
        for end in range(a - 2, a + n - 1):
            if line := ends.get(end):
                nearby += [k for _, k in line[bisect_left(line, (b - max(3, jump), -1)) : bisect_right(line, (b + n - 2, i))]]
        for k in sorted(nearby):
            pa_, pb, pn = runs[k]
            gap_a, gap_b = a - pa_ - pn, b - pb - pn
            over = max(0, -gap_a, -gap_b)
            if n - over < 2 or b <= pb:
                continue
            near = gap_a <= 2 and gap_b <= 3
            far = gap_a <= 1 and gap_b <= jump and not best[k][1]
            if near or far:
                worth = best[k][0] + n - over - (0.25 if near else 1.0)
                if worth > mine[0]:
                    mine = (worth, best[k][1] + (not near), k)
        best.append(mine)
        insort(ends[a + n], (b + n, i))
    out, i = [], int(np.argmax([x[0] for x in best])) if best else -1
    while i >= 0:
        out.append(runs[i])
        i = best[i][2]
    return out[::-1]


def _shard(tests: TestSet, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(word numbers, ends of the texts, matches) of a shard."""
    get = tests.number.get
    numbers, ends = [], []
    for text in texts:
        numbers += [get(w, 0) for w in words(text)]
        numbers.append(0)
        ends.append(len(numbers))
    stream = np.array(numbers, np.int64)
    position, _ = suffix_array(stream, tests.base, tests.known, tests.depth)
    return stream, np.array(ends), _matches(tests, _codes(stream, tests.base), stream, position)


def _search(tests: TestSet, least: int, jump: int):
    def shard(ids: list[int], texts: list[str]) -> list[tuple]:
        stream, ends, (suffix, place, length) = _shard(tests, texts)
        # a match that goes on to the left is part of a longer one
        start, owner = tests.starts[suffix], tests.owner[suffix]
        before = np.where(start > 0, tests.stream[np.maximum(tests.at[suffix] - 1, 0)], 0)
        inner = (suffix + 1 < len(tests.at)) & (before > 0) & (place > 0) & (stream[np.maximum(place - 1, 0)] == before)
        nxt = np.minimum(suffix + 1, max(len(tests.at) - 1, 0))  # suffixes are listed from the end of a passage
        inner &= (tests.owner[nxt] == owner) & (tests.starts[nxt] == start - 1) if len(suffix) else False
        start, owner, place, length = (x[~inner] for x in (start, owner, place, length))
        doc = np.searchsorted(ends, place, "right")
        key = doc * len(tests.texts) + owner
        order = np.lexsort((start, place, key))
        key, start, place, length = key[order], start[order], place[order], length[order]
        out = []
        for pair in _near(key, start, place, length, least).tolist():
            d, n = divmod(pair, len(tests.texts))
            lo, hi = np.searchsorted(key, pair, "left"), np.searchsorted(key, pair, "right")
            runs = sorted(zip(start[lo:hi].tolist(), place[lo:hi].tolist(), length[lo:hi].tolist()))
            begin = int(ends[d - 1]) if d else 0
            specific, mine = tests.specific[n], []
            item, field = tests.keys[n]
            while runs:
                chain = _chain(runs, jump)
                took = sorted({a + k for a, _, m in chain for k in range(m)})
                if len(took) < least:
                    break
                whole = specific[took[0] : took[-1] + 1].sum()
                hit = specific[took].sum()
                sure = hit >= max(2, 0.75 * whole) or (len(took) >= 20 and hit >= max(3, 0.5 * whole))
                # a chain that isn't sure still counts where it is verbatim
                for part in [chain] if sure and len(took) >= 0.75 * (took[-1] + 1 - took[0]) else [[r] for r in chain if r[2] >= least]:
                    took = sorted({a + k for a, _, m in part for k in range(m)})
                    mine.append((ids[d], item, field, took, len(took), max(m for _, _, m in part), min(b for _, b, _ in part) - begin, int(specific[took].sum())))
                gone = set(chain)
                runs = [r for r in runs if r not in gone]
            if mine:
                text_key = int.from_bytes(blake2b(" ".join(words(texts[d])).encode(), digest_size=8).digest(), "big", signed=True)
                out += [(*x, text_key, min(y[3][0] for y in mine), max(y[3][-1] for y in mine), len(tests.texts[n])) for x in mine]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("covered", pa.list_(pa.int32())), ("matched", pa.int32()), ("longest", pa.int32()), ("location", pa.int32()), ("specific", pa.int32()), ("text_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("item_words", pa.int32())])
        for batch in batches:
            out = [x for ids, texts in _cut(batch) for x in shard(ids, texts)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=kinds)

    return run


def _longest(tests: TestSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _cut(batch):
                stream, ends, (suffix, place, length) = _shard(tests, texts)
                best = np.lexsort((-place, length, tests.owner[suffix]))
                owner = tests.owner[suffix][best]
                last = best[np.append(owner[1:] != owner[:-1], True)] if len(best) else best
                doc = np.searchsorted(ends, place[last], "right")
                begin = np.where(doc > 0, ends[np.maximum(doc - 1, 0)], 0) if len(last) else doc
                keys = [tests.keys[n] for n in tests.owner[suffix[last]].tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "item_id": pa.array([k[0] for k in keys], pa.int64()), "field": pa.array([k[1] for k in keys], pa.string()), "longest": pa.array(length[last], pa.int32()),
                        "doc_id": pa.array([ids[d] for d in doc.tolist()], pa.int64()), "location": pa.array(place[last] - begin, pa.int32()), "item_location": pa.array(tests.starts[suffix[last]], pa.int32()),
                    }
                )

    return run


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """The texts of a batch in shards of some 4 MB."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > SHARD or i == len(texts) - 1:
            yield ids[first : i + 1], texts[first : i + 1]
            first, size = i + 1, 0


def _blocks(items: DataFrame, gram: int) -> Iterator[list[tuple]]:
    """The test set in blocks of some BLOCK_WORDS words, one at a time on the driver."""
    block, size = [], 0
    for row in test_words(items, gram).orderBy("item_id", "field", "words").toLocalIterator():
        block.append(tuple(row))
        size += len(row.words)
        if size > BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").where("text is not null and text <> ''")


def longest_matches(documents: DataFrame, items: DataFrame, gram: int = 8) -> DataFrame:
    """(item_id, field, longest, doc_id, location, item_location): the longest verbatim match of each passage and question in the corpus.

    Every suffix of the test material is binary-searched in the suffix array of every shard. location and item_location count words from 0
    in the document and in the item. Of matches of one length that of the smallest doc_id and location comes out. Stock (see ``test_leaks``) ends a match;
    matches under three words, and items without any, do not come out.
    """
    schema = "item_id long, field string, longest int, doc_id long, location int, item_location int"
    found = documents.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, gram):
        found = found.unionByName(_texts(documents).mapInArrow(_longest(TestSet(block, gram)), schema))
    best = F.max(F.struct("longest", (-F.col("doc_id")).alias("d"), (-F.col("location")).alias("l"), (-F.col("item_location")).alias("i"))).alias("b")
    return found.groupBy("item_id", "field").agg(best).select("item_id", "field", "b.longest", (-F.col("b.d")).alias("doc_id"), (-F.col("b.l")).alias("location"), (-F.col("b.i")).alias("item_location"))


def _found(documents: DataFrame, items: DataFrame, least: int, jump: int, stock_share: float, stock_docs: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Everything found, and the stretches among it that are stock, with the number of different texts that hold them."""
    found = documents.sparkSession.createDataFrame([], SCHEMA)
    for block in _blocks(items, gram):
        found = found.unionByName(_texts(documents).mapInArrow(_search(TestSet(block, gram), least, jump), SCHEMA))
    found = cut_lineage(found)  # a few rows per leaked document, read twice below
    # stock by the number of different texts that hold one stretch of an item and nothing else of it
    limit = max(stock_docs, int(stock_share * documents.count()))
    apart = found.where(F.col("item_words") - (F.col("last") - F.col("first") + 1) > F.greatest(F.lit(3), F.col("item_words") / 10))
    return found, apart.groupBy("item_id", "field", "first", "last").agg(F.count_distinct("text_key").alias("texts")).where(F.col("texts") > limit)


def test_leaks(documents: DataFrame, items: DataFrame, least: int = 12, jump: int = 150, stock_share: float = 0.005, stock_docs: int = 30, gram: int = 8) -> DataFrame:
    """(doc_id, item_id, field, matched, longest, location, specific): the passages and questions found in each document.

    Every shard of the corpus (some 4 MB of text) gets a suffix array over its words, and every test suffix is binary-searched in it, which gives all
    its verbatim matches of three words or more with their lengths and places. The matches of an item in a document are chained: single words may be
    changed, added or dropped between them, and once the document may interrupt them by up to
    ``jump`` words. A verbatim run of ``least`` words counts. A chain of shorter ones counts if it covers ``least`` words of
    the item, three quarters of its stretch, and two or more and three quarters of the specific words in it (see ``test_words``;
    half of them where it covers 20 words or more), so that sentences of the same make with other names and numbers do not. Stock is left out: runs of ``gram`` words found in three
    items, and a stretch of an item that recurs without the rest of it, with the same first and last word, in more than
    max(``stock_docs``, ``stock_share`` of the documents) different texts, which is counted over the whole corpus and reported by ``stock_passages``. Copies of
    a text count once, and an item that recurs as a whole (all but a tenth) is leaked, however often. Null and empty texts hold nothing; case, punctuation, markup and line breaks do not matter.
    Repeated documents each come out. The test set is read to the driver in blocks of BLOCK_WORDS words, each block one pass;
    what is specific or stock is counted over all items, so that the result does not depend on the blocks.
    """
    found, often = _found(documents, items, least, jump, stock_share, stock_docs, gram)
    stock = often.groupBy("item_id", "field").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("stock"))
    kept = found.join(stock, ["item_id", "field"], "left").withColumn("matched", F.when(F.col("stock").isNull(), F.col("matched")).otherwise(F.size(F.array_except("covered", "stock"))))
    return kept.where(F.col("matched") >= least).select("doc_id", "item_id", "field", "matched", "longest", "location", "specific")


def stock_passages(documents: DataFrame, items: DataFrame, least: int = 12, jump: int = 150, stock_share: float = 0.005, stock_docs: int = 30, gram: int = 8) -> DataFrame:
    """(item_id, field, first, last, texts): the stretches of items that ``test_leaks`` takes for stock, with the number of different texts that hold them."""
    return _found(documents, items, least, jump, stock_share, stock_docs, gram)[1]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold test material."""
    return test_leaks(documents, items).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test material, with all their columns."""
    return documents.join(leaked_items(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
