"""Benchmark decontamination with spaced seeds.

Tokens are runs of ASCII letters and digits and of other bytes from 0x80, in lower
case. Each fixed mask looks at some tokens of a window and ignores the others; equal
hashes of a document's and a benchmark item's window are a hit. Around each hit the
diagonal (document position less item position) is verified: the longest segment that
begins and ends with an equal token and has three quarters of equal ones must have at
least ``MIN_TOKENS`` tokens, or the item's length less ``EDGES`` if that is smaller.
The masks hit every 13-token overlap with up to two substitutions, and 276 of the 286
placements of three; two at the ends leave a segment of 11 tokens. Items of 8 to 12
tokens have shorter masks that hit every overlap the rule accepts; those of fewer tokens
are found where all their tokens stand in a row.

The benchmark is searched in blocks of at most ``BLOCK_TOKENS`` tokens; the hashes of
one block are broadcast for one pass over the documents, which do not move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns
from tidemark.llm.text import NOT_ALNUM, Words, buffers, lower, mix

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5), (0, 2, 3, 7, 8, 9))
MIN_TOKENS = 11
#: Substitutions at the ends of an item do not count against it.
EDGES = 2
#: Items with fewer tokens are found only as a whole, by the hash of all their tokens.
MIN_ITEM = 8
#: Items from MIN_ITEM tokens up to this have seeds of their own, SHORT_MASKS.
SHORT_ITEM = 12
SHORT_MASKS = ((0, 1, 2, 4), (0, 2, 5, 6), (0, 3, 4, 5))
BLOCK_TOKENS = 500_000
MISMATCH = -3
#: All masks, with the least and the largest length of the items they are for.
SEEDS = [*[(m, MIN_ITEM, None) for m in MASKS], *[(m, MIN_ITEM, SHORT_ITEM) for m in SHORT_MASKS], *[(tuple(range(n)), n, n) for n in range(1, MIN_ITEM)]]


def least_tokens(length: int) -> int:
    """The least length of an overlap with an item of so many tokens."""
    return min(MIN_TOKENS, length - EDGES) if length >= MIN_ITEM else length


OVERLAP = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("equal", T.IntegerType())])
_FACTOR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the tokens of each text."""
    data, offsets = buffers(column)
    words = Words(lower(data), offsets, NOT_ALNUM)
    return words.hashes(), words.first


def seeds(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    n = max(0, len(hashes) - mask[-1])
    total = np.full(n, number, np.uint64)
    for j, o in enumerate(mask):
        total += hashes[o : o + n] * _FACTOR[j]
    return mix(total)


class Block:
    """The seeds of a block of items, sorted, with a bit table that most windows miss."""

    BITS = 20

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.ids, self.hashes, self.bounds = ids, hashes, bounds
        length = np.diff(bounds)
        owner = np.repeat(np.arange(len(ids)), length)
        self.table = np.zeros(1 << self.BITS, bool)
        self.keys, self.item, self.place = [], [], []
        for number, (mask, low, high) in enumerate(SEEDS):
            key = seeds(hashes, mask, number)
            size = length[owner[: len(key)]]
            at = np.flatnonzero((owner[: len(key)] == owner[mask[-1] :]) & (size >= low) & (size <= (high or size))) if len(key) else np.zeros(0, np.int64)
            at = at[np.argsort(key[at], kind="stable")]
            self.keys.append(key[at])
            self.item.append(owner[at])
            self.place.append(at - bounds[owner[at]])
            self.table[key[at] >> np.uint64(64 - self.BITS)] = True

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) rows of the windows that share a seed."""
        found, text = [np.zeros((0, 3), np.int64)], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for number, (mask, whole, _) in enumerate(SEEDS):
            if not len(self.keys[number]):
                continue
            key = seeds(hashes, mask, number)
            at = np.flatnonzero(self.table[key >> np.uint64(64 - self.BITS)])
            at = at[text[at] == text[at + mask[-1]]]
            low, high = np.searchsorted(self.keys[number], key[at], "left"), np.searchsorted(self.keys[number], key[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            source = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            rows = np.stack([text[at], self.item[number][source], at - bounds[text[at]] - self.place[number][source]], 1)
            if whole < MIN_ITEM:  # all equal: the first place of an item in a text is the best
                rows = rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]]
            found.append(rows)
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """Per text, the verified (item_id, start, length, equal) of each item, the best one."""
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in range(len(bounds) - 1)]
        for t, i, diagonal in self.hits(hashes, bounds).tolist():
            words, item = hashes[bounds[t] : bounds[t + 1]], self.hashes[self.bounds[i] : self.bounds[i + 1]]
            low, high = max(0, diagonal), min(len(words), diagonal + len(item))
            same = words[low:high] == item[low - diagonal : high - diagonal]
            start, end = longest_segment(same)
            equal = int(same[start:end].sum())
            if end - start >= least_tokens(len(item)) and 4 * equal >= 3 * (end - start):
                row = (int(self.ids[i]), low + start, end - start, equal)
                if (equal, -row[1]) > (out[t].get(row[0], (0, 0, 0, 0))[3], -out[t].get(row[0], (0, 0, 0, 0))[1]):
                    out[t][row[0]] = row
        return [sorted(d.values()) for d in out]


def longest_segment(same: np.ndarray) -> tuple[int, int]:
    """The longest segment that begins and ends with an equal token and has three quarters of them, the first of equals."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
    # For every end, the earliest start with no larger sum before it: a segment of score 0 or more.
    least = np.minimum.accumulate(total[at])
    start = at[np.searchsorted(-least, -total[at + 1])]
    best = int(np.argmax(at + 1 - start))
    return int(start[best]), int(at[best]) + 1


def blocks_of(benchmark: DataFrame, text: str, item_id: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, one at a time; null texts and ids are left out.

    Executors tokenise; the driver gets hashes only, of one partition at a time. Items of
    equal tokens and id are searched once.
    """
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        hashes, bounds = tokens(part.column(part.num_columns - 1))
        return {"tokens": pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())}

    listed = with_text_columns(rows, "text", run, [("tokens", T.BinaryType())], drop_text=True).distinct().orderBy("id", "tokens")
    ids, parts, size = [], [], 0

    def block() -> Block:
        return Block(np.array(ids), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))

    for row in listed.toLocalIterator():
        hashes = np.frombuffer(row.tokens, np.uint64)
        if size and size + len(hashes) > BLOCK_TOKENS:
            yield block()
            ids, parts, size = [], [], 0
        ids.append(row.id)
        parts.append(hashes)
        size += len(hashes)
    if ids:
        yield block()


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, drop_text: bool = False) -> DataFrame:
    """documents (all columns and rows, or those in keep) with ``contaminated`` and ``overlaps``.

    overlaps lists, by item, (item_id, start, length, equal): the best verified
    overlap, in tokens of the document; contaminated says whether there is one. Null
    and empty texts and an empty benchmark give none; repeated rows and repeated items
    change nothing. Input columns named like an output are replaced.
    """
    require(documents, text)
    require(benchmark, item_id, item_text)
    names = [c for c in dict.fromkeys(keep if keep is not None else documents.columns) if c not in ("overlaps", "contaminated")]
    out = documents.select(*[documents[c] for c in names], documents[text].alias("__benchmark_text"))
    found = []
    for number, block in enumerate(blocks_of(benchmark, item_text, item_id)):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(part: pa.RecordBatch, shared=shared, name=f"__overlaps_{number}") -> dict[str, pa.Array]:
            rows = shared.value.overlaps(*tokens(part.column(part.num_columns - 1)))
            return {name: pa.array([[dict(zip(OVERLAP.names, x, strict=True)) for x in r] for r in rows], pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("equal", pa.int32())])))}

        found.append(f"__overlaps_{number}")
        out = with_text_columns(out, "__benchmark_text", run, [(found[-1], T.ArrayType(OVERLAP))])
    every = F.array_sort(F.flatten(F.array(*found))) if found else F.lit(None).cast(T.ArrayType(OVERLAP))
    every = F.coalesce(every, F.array().cast(T.ArrayType(OVERLAP)))
    dropped = [text] if drop_text and text in names else []
    return out.withColumn("overlaps", every).withColumn("contaminated", F.size("overlaps") > 0).select(*[f"`{c}`" for c in names if c not in dropped], "contaminated", "overlaps")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(documents.select("doc_id", "text"), benchmark, keep=["doc_id"])
    items = F.array_join(F.transform("overlaps", lambda x: x["item_id"].cast("string")), ",")
    return out.select("doc_id", "contaminated", items.alias("benchmark_items"), F.aggregate("overlaps", F.lit(0), lambda a, x: F.greatest(a, x["equal"])).cast("long").alias("max_equal_tokens"))
