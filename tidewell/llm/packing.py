"""Texts packed into containers of fixed token capacity by exact-complement hashing of length sums."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that are packed together in one task.
BLOCK = 250_000
_LOADED: dict = {}


def _encoder(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text, whole; null and empty texts have 0. ``tokenizer`` is a rank file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long")


class Sums:
    """Available lengths under counts, with an index of the pair sums they make: ``pairs[s]`` pairs of lengths sum to ``s``.

    The index is built once and corrected whenever a length runs out (or has one item left, for pairs of equal lengths), so
    that single, pair and triple sums are looked up and not searched for.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.capacity = len(self.left) - 1
        self.pairs = np.zeros(self.capacity + 1, np.int64)
        lengths = np.flatnonzero(self.left)
        for i, n in enumerate(lengths.tolist()):
            others = lengths[i + 1 :]
            self.pairs[n + others[others <= self.capacity - n]] += 1
            if self.left[n] > 1 and 2 * n <= self.capacity:
                self.pairs[2 * n] += 1

    def change(self, n: int, by: int) -> None:
        """``by`` items of length ``n`` more (or fewer)."""
        before = int(self.left[n])
        after = self.left[n] = before + by
        if (before > 1) != (after > 1) and 2 * n <= self.capacity:
            self.pairs[2 * n] += 1 if after > 1 else -1
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.left[1 : self.capacity - n + 1]) + 1
            self.pairs[n + others[others != n]] += 1 if after > 0 else -1

    def pair(self, gap: int) -> list[int]:
        """Two available lengths that sum to ``gap``, the larger as large as can be."""
        if gap < 2 or not self.pairs[gap]:
            return []
        half = (gap + 1) // 2
        hit = (self.left[half:gap] > 0) & (self.left[gap - half : 0 : -1] > 0)
        if gap % 2 == 0:
            hit[0] = self.left[half] > 1
        b = half + int(hit.nonzero()[0][-1])
        return [b, gap - b]

    def complement(self, gap: int) -> list[int]:
        """One, two or three available lengths that sum to ``gap``, or none."""
        if self.left[gap] > 0:
            return [gap]
        if two := self.pair(gap):
            return two
        # first lengths whose rest is a pair sum, the largest first; the pair must not need the length itself once more than it is there
        firsts = ((self.left[1 : gap - 1] > 0) & (self.pairs[gap - 1 : 1 : -1] > 0)).nonzero()[0][::-1] + 1
        for a in firsts.tolist():
            self.change(a, -1)
            two = self.pair(gap - a)
            self.change(a, 1)
            if two:
                return [a, *two]
        return []


def plan(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Patterns of lengths, each with the number of containers it fills; ``counts[n]`` items of length n, capacity len(counts) - 1.

    What is left in a container is filled exactly by one, two or three items whenever available lengths
    sum to it; the sums are looked up in an index kept under the counts (see ``Sums``). A pattern is used as
    often as its lengths last, so every pattern exhausts a length. Where no complement is exact,
    the largest item that fits goes in, and what then remains is filled in the same way; where none fits it stays empty.
    """
    sums = Sums(counts)
    out: list[tuple[Counter, int]] = []
    top = sums.capacity
    while True:
        while top and sums.left[top] == 0:
            top -= 1
        if not top:
            return out
        chosen, gap = [top], sums.capacity - top
        sums.change(top, -1)
        while gap:
            exact = sums.complement(gap)
            for n in exact:
                sums.change(n, -1)
            chosen += exact
            if exact:
                break
            fits = (sums.left[1 : min(gap, top) + 1] > 0).nonzero()[0]
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            sums.change(n, -1)
            chosen.append(n)
            gap -= n
        pattern = Counter(chosen)
        more = min(int(sums.left[n]) // k for n, k in pattern.items())
        if more:
            for n, k in pattern.items():
                sums.change(n, -more * k)
        out.append((pattern, 1 + more))


def fill(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, size, container) of the pieces of items of ``tokens``; only items over the capacity have more than one piece."""
    pieces = -(-tokens // capacity)
    row = np.repeat(np.arange(len(tokens)), pieces)
    part = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(tokens[row] - part * capacity, capacity)
    order = np.argsort(size, kind="stable")
    counts = np.bincount(size, minlength=capacity + 1)
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    container, base = np.zeros(len(row), np.int64), 0
    for pattern, times in plan(counts):
        for n, k in pattern.items():
            container[order[at[n] : at[n] + k * times]] = base + np.arange(k * times) % times
            at[n] += k * times
        base += times
    return row, part, size, container


def pack(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(container_name, container_id, doc_id, part, tokens): every text in a container of each capacity.

    Texts are whole (part 0) unless longer than the capacity: then all parts but the last fill a
    container. Null and empty texts hold no tokens and come out nowhere; equal texts are packed
    one by one; repeated ids keep their rows. Blocks of some ``block`` texts are packed side by side, each
    block and capacity in one task that sees ids and lengths only; container_id holds the block and the number within. ``capacities`` (a
    short list) is read to the driver; rows without a positive capacity are left out.
    """
    sizes = [(name, int(n)) for name, n in capacities.select("container_name", "capacity_tokens").distinct().orderBy("container_name").toLocalIterator() if n and n > 0]
    blocks = max(1, -(-documents.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not parts or not sizes:
            return
        null = np.concatenate([np.isnan(p[0].astype(float)) for p in parts])
        ids = np.concatenate([np.nan_to_num(p[0].astype(float)).astype(np.int64) if null.any() else p[0] for p in parts])
        tokens = np.concatenate([p[1] for p in parts]).astype(np.int64)
        task = TaskContext.get().partitionId()
        name, capacity = sizes[task % len(sizes)]
        row, part, size, container = fill(tokens, capacity)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]).take(pa.array(np.zeros(len(row), np.int32))), pa.array(((task // len(sizes)) << 40) + container), pa.array(ids[row], mask=null[row]), pa.array(part.astype(np.int32)), pa.array(size.astype(np.int32))],
            names=["container_name", "container_id", "doc_id", "part", "tokens"],
        )

    # one task per block and capacity; only ids and lengths are repeated for each capacity
    many = max(len(sizes), 1)
    task = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(blocks)) * many + F.col("of")
    counted = token_counts(documents, tokenizer).where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("of"))
    placed = counted.withColumn("task", task.cast("int")).repartitionById(blocks * many, F.col("task")).sortWithinPartitions("doc_id", "tokens")
    return placed.select("doc_id", "tokens").mapInArrow(run, "container_name string, container_id long, doc_id long, part int, tokens int")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_name, containers, tokens, unused_share) of a packing."""
    each = packed.groupBy("container_name", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("container_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(capacities.select("container_name", "capacity_tokens").distinct(), "container_name").select(
        "container_name", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share")
    )
