"""Removal of long repeated byte strings with sparse suffix sorting.

Every ``WINDOW``-byte string of a text has an anchor: the start of its least-hashed
``GRAM``-byte gram, the leftmost of equals. Equal strings have anchors at the same
place, so only anchors whose gram occurs again need a closer look; those are sent, with
the bytes of the windows that they stand for, to tasks by gram. There the suffixes at
the anchors and the reversed prefixes before them are sorted deep-shallow. Two windows
at offset j before their anchors are equal exactly if the suffixes share WINDOW - j
bytes and the prefixes j bytes; both follow from the sorted orders and their common
prefixes. Grams with more than ``HOT`` occurrences are not gathered: their windows'
digests are compared instead, place by place (``repeated_rows``).

The same sorting runs over words: a text is then the string of its words' 32-bit hashes,
a window ``WORDS`` of them, and all offsets are multiples of four bytes. Grams are
compared by 64 bits, so two words that differ pass for equal with a chance of 2**-32 only
between two runs that are equal in all other places.

Rows with equal texts have equal results, so texts are handled once, by a 128-bit key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import release_memory, require, tidy
from tidemark.llm.suffix_sort import deep_shallow_sort
from tidemark.llm.text import Words, buffers, prefix_hash, slices, span_hash
from tidemark.session import Scratch, ship_package

WINDOW = 400
GRAM = 48
#: Window in words, and the bytes of a word in the string of hashes.
WORDS = 50
CELL = 4
#: Anchors of one gram that are sorted in one task; beyond, windows are counted by digest.
HOT = 20_000
BUCKET = 2_000
#: Parts over which the rows of one hot key are dealt.
PARTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """The texts as their words' hashes, offsets into these, and the words."""
    words = Words(data, offsets)
    return words.hashes() >> np.uint64(32), words.first, words


def window_anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position, gram hash, first window, last window) of every anchor, in symbols (bytes or words) of its text."""
    n, width = len(data), window - gram + 1
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix_hash(data), at, at + gram)
    key = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    # Least key of every run of `width`, by running minima from both ends of blocks.
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(count)
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + window <= offsets[text + 1]
    start, text, least = start[inside], text[inside], least[inside]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    base = offsets[text[first]]
    return text[first], least[first] - base, hashes[least[first]], start[first] - base, start[last] - base


def _rows_of(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from each start on, forwards (step 1) or backwards (-1), padded with zeros."""
    out = np.zeros((len(start), width), np.uint8)
    for a in range(0, len(start), 4096):
        at = start[a : a + 4096, None] + step * np.arange(width)
        inside = np.arange(width) < length[a : a + 4096, None]
        out[a : a + 4096] = np.where(inside, buffer[np.where(inside, at, 0)], 0)
    return out


def repeated_windows(group: np.ndarray, contexts: list[bytes], high: np.ndarray, low: np.ndarray, window: int, gram: int, cell: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, j from, j to): runs of offsets at which the anchor's window occurs again.

    group numbers the grams; contexts hold the symbols (of cell bytes) from `high` before
    an anchor to window - low after it, and each anchor stands for its windows at offsets
    low to high.
    """
    n = len(group)
    size = np.array([len(c) for c in contexts], np.int64)
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size + high * cell
    round8 = lambda x: -(-x // 8) * 8
    right = _rows_of(buffer, begin, (window - low) * cell, round8(window * cell), 1)
    left = _rows_of(buffer, begin - 1, high * cell, max(8, round8((window - gram) * cell)), -1)
    left_order, left_lcp = deep_shallow_sort(group, left)
    # Ties of the right order come in left order, so that best partners are neighbours.
    back, right_lcp = deep_shallow_sort(group[left_order], right[left_order])
    right_order = left_order[back]

    a, b = right_order[:-1], right_order[1:]
    differ = np.empty(max(0, n - 1), np.int64)
    for i in range(0, n - 1, 8192):
        d = left[a[i : i + 8192]] != left[b[i : i + 8192]]
        differ[i : i + 8192] = np.where(d.any(1), d.argmax(1), left.shape[1])
    # Whole symbols only; -1 stays -1.
    left_lcp, right_lcp, differ = left_lcp // cell, right_lcp // cell, differ // cell
    frm = np.maximum.reduce([window - right_lcp[1:], low[a], low[b]])
    to = np.minimum.reduce([differ, high[a], high[b]])
    ok = (right_lcp[1:] >= 0) & (frm <= to)
    who = np.concatenate([a[ok], b[ok]])
    frm, to = np.concatenate([frm[ok]] * 2), np.concatenate([to[ok]] * 2)

    # An anchor is settled if one neighbour covers all its windows, or if there is no third.
    members = np.bincount(group)[group]
    settled = members <= 2
    settled[who[(frm <= low[who]) & (to >= high[who])]] = True
    open_group = np.zeros(group.max() + 1, bool)
    open_group[group[~settled]] = True
    opened = open_group[group]
    if not opened.any():
        return who, frm, to
    keep = ~opened[who]
    who, frm, to = [who[keep]], [frm[keep]], [to[keep]]
    index = np.flatnonzero(opened)
    small = np.full(n, -1, np.int64)
    small[index] = np.arange(len(index))
    r_member, r_lcp = small[right_order[opened[right_order]]], right_lcp[opened[right_order]]
    l_member, l_lcp = small[left_order[opened[left_order]]], left_lcp[opened[left_order]]
    again = np.zeros((len(index), window - gram + 3), bool)
    lows, highs = low[index], high[index]
    right_class, left_class = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
    for j in range(int(lows.min()), int(highs.max()) + 1):
        right_class[r_member] = np.cumsum(r_lcp < window - j)
        left_class[l_member] = np.cumsum(l_lcp < j)
        here = np.flatnonzero((lows <= j) & (j <= highs))
        if len(here) > 1:
            key = right_class[here] * (len(index) + 1) + left_class[here]
            by = np.argsort(key)
            same = key[by][1:] == key[by][:-1]
            again[here[by[1:][same]], j + 1] = True
            again[here[by[:-1][same]], j + 1] = True
    edge = np.diff(again.astype(np.int8), axis=1)
    row, j = np.nonzero(edge == 1)
    row_, end = np.nonzero(edge == -1)
    return np.concatenate([*who, index[row]]), np.concatenate([*frm, j]), np.concatenate([*to, end - 1])


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of (start, end) rows; touching runs join."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return word_cells(data, offsets)[:2] if words else (data, offsets)


def _keyed(documents: DataFrame, text: str, least: int) -> DataFrame:
    """Texts of at least so many bytes with their 128-bit key."""
    return documents.select(documents[text].alias("__text")).where(F.octet_length("__text") >= least).select(F.xxhash64("__text").alias("t1"), F.xxhash64(F.lit(1), "__text").alias("t2"), "__text")


def _listed(rows: DataFrame, several: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in several, with several's columns.

    A hot key's rows are dealt over PARTS by their text, so no task gets them all: first
    each (key, part) that occurs is looked up, at most PARTS rows a key, then the rows.
    """
    part = F.pmod(F.xxhash64("t1", "t2"), F.lit(PARTS)).alias("part")
    found = rows.select(key, part).distinct().join(several, key)
    return rows.select("*", part).join(found, [key, "part"]).drop("part")


def repeated_spans(documents: DataFrame, text: str, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): distinct texts with a gram that occurs again, and per text the (start, end) of repeated strings.

    Windows, grams and spans count bytes or, with words, words.
    """
    cell, label = (CELL, "words-") if words else (1, "")
    keyed = _keyed(documents, text, 2 * window - 1 if words else window)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                t1, t2 = part.column(0).to_numpy(), part.column(1).to_numpy()
                _, first = np.unique(np.stack([t1, t2], 1), axis=0, return_index=True)
                first = np.sort(first)
                column = part.column(2).take(pa.array(first))
                row, at, value, _, _ = window_anchors(*_symbols(column, words), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(t1[first][row]), pa.array(t2[first][row]), pa.array(at.astype(np.int32))], names=["gram", "t1", "t2", "at"])

    found = scratch.table(keyed.mapInArrow(tidy(anchors), "gram long, t1 long, t2 long, at int"), label + "anchors")
    place = F.xxhash64("t1", "t2", "at")
    # Written, so that both sides of the join are exchanges of their own and the rows of
    # a common gram can be split.
    grams = found.select("gram", place.alias("place")).groupBy("gram").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")).where("low <> high").select("gram", (F.col("n") > hot).alias("hot"))
    grams = scratch.table(grams, label + "grams")
    any_hot = not grams.where("hot").isEmpty()
    wanted = found.join(grams, "gram").groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "hot")).alias("anchors"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drop texts that this task has sent already (as far as memory for keys allows)."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = []
            for i, key in enumerate(keys):
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64())) if len(rows) < len(keys) else batch

    texts = keyed.mapInArrow(tidy(once), keyed.schema).join(wanted, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    texts = scratch.table(texts, label + "texts")
    scratch.drop(label + "anchors", label + "grams")
    scratch.release()

    def contexts(batches: Iterator[pa.RecordBatch], hot_ones: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offsets = _symbols(part.column(2), words)
                row, at, value, first, last = window_anchors(data, offsets, window, gram)
                listed = part.column(3)
                flat, size = listed.flatten(), np.diff(listed.offsets.to_numpy())
                owner = np.repeat(np.arange(part.num_rows), size)
                want = owner * (1 << 32) + flat.field("at").to_numpy(zero_copy_only=False)
                want = want[flat.field("hot").to_numpy(zero_copy_only=False) == hot_ones]
                by = np.argsort(want)
                mine = row * (1 << 32) + at
                hit = np.minimum(np.searchsorted(want[by], mine), max(0, len(want) - 1))
                keep = want[by][hit] == mine if len(want) else np.zeros(len(mine), bool)
                row, at, value, first, last = (x[keep] for x in (row, at, value, first, last))
                raw = (data.astype(np.uint32) if words else data).tobytes()
                base = offsets[row]
                pieces = [raw[a:b] for a, b in zip(((base + first) * cell).tolist(), ((base + last + window) * cell).tolist(), strict=True)]
                t1, t2 = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(t1), pa.array(t2), pa.array(at.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(pieces, pa.binary())], names=["gram", "t1", "t2", "at", "first", "last", "context"])

    def sent(hot_ones: bool) -> DataFrame:
        kept = texts.where(F.exists("anchors", lambda x: x["hot"] == F.lit(hot_ones))) if any_hot else texts
        return kept.mapInArrow(tidy(lambda batches: contexts(batches, hot_ones)), "gram long, t1 long, t2 long, at int, first int, last int, context binary")

    total = texts.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))

    def sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        _, group = np.unique(pdf["gram"].to_numpy(), return_inverse=True)
        at, first, last = (pdf[c].to_numpy().astype(np.int64) for c in ("at", "first", "last"))
        who, frm, to = repeated_windows(group, list(pdf["context"]), at - first, at - last, window, gram, cell)
        release_memory()
        return pd.DataFrame({"t1": pdf["t1"].to_numpy()[who], "t2": pdf["t2"].to_numpy()[who], "start": (at[who] - to).astype(np.int32), "end": (at[who] - frm + window).astype(np.int32)})

    spans = sent(False).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket").applyInPandas(sort_bucket, "t1 long, t2 long, start int, end int")
    if any_hot:

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t1, t2, first, context in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "first", "context")), strict=True):
                    starts = range(len(context) // cell - window + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(context[i * cell : (i + window) * cell], digest_size=16).digest() for i in starts], pa.binary()), pa.array([t1] * len(starts)), pa.array([t2] * len(starts)), pa.array([first + i for i in starts], pa.int32())], names=["digest", "t1", "t2", "start"])

        windows = scratch.table(sent(True).mapInArrow(tidy(digests), "digest binary, t1 long, t2 long, start int"), label + "windows")
        several = windows.select("digest", F.xxhash64("t1", "t2", "start").alias("place")).groupBy("digest").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high").select("digest")
        spans = spans.union(_listed(windows, several, "digest").select("t1", "t2", "start", (F.col("start") + window).alias("end")))
    # Written, so that what led to them can go.
    name = "word_spans" if words else "spans"
    per_text = scratch.table(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias(name)), label + "spans")
    scratch.drop(label + "windows")
    scratch.release()
    return texts.select("t1", "t2", "__text"), per_text


def suffix_array_dedup(documents: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep: list[str] | None = None, kept_text: str | None = None, words: int | None = None, word_gram: int = 6) -> DataFrame:
    """documents (all columns and rows, or those in keep) with n_bytes, n_removed, n_spans and kept_sha256.

    Every byte covered by a window-byte string that also starts elsewhere, in any text,
    is removed; texts are UTF-8 bytes, matches never cross texts. With kept_text, a
    column of that name holds the remaining bytes as text (bytes of characters that
    are no longer whole are left out). Null and empty texts have no bytes; texts
    shorter than the window keep all of theirs. Repeated rows repeat each other, so
    texts of the window's length or more vanish in both.

    With words, runs of so many words (bytes outside space and 0x09-0x0D, in any spacing)
    that also start elsewhere are found too: n_repeat_words counts the words in them and
    has_repeat tells whether a row has any repeat of either kind. They do not change the
    other columns, but kept_text loses them as well, from the first word to the last.

    Input columns named like an output are replaced; an empty table gives an empty result.
    """
    require(documents, text)
    if not gram < window or (words is not None and not word_gram < words):
        raise ValueError("grams must be smaller than their windows")
    ship_package(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "suffix")
    texts, spans = repeated_spans(documents, text, scratch, window, gram, hot)
    if words:
        more, other = repeated_spans(documents, text, scratch, words, word_gram, hot, words=True)
        # None becomes an empty list; the element type stays.
        none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda x: F.lit(False))
        spans = spans.join(other, ["t1", "t2"], "full").select("t1", "t2", *[F.coalesce(c, none).alias(c) for c in ("spans", "word_spans")])
        texts = texts.union(more).dropDuplicates(["t1", "t2"])
    marked = texts.join(spans, ["t1", "t2"])
    fields = [("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    fields += [("n_repeat_words", "long", pa.int64())] if words else []
    fields += [("kept", "string", pa.string())] if kept_text else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            flat = column.flatten()
            return np.stack([flat.field(c).to_numpy() for c in ("start", "end")], 1), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])

        def without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
            return b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(raw)], strict=True))

        for batch in batches:
            for part in slices(batch, "__text"):
                made: dict[str, list] = {name: [] for name, _, _ in fields}
                data, offsets = buffers(part.column(2))
                whole = data.tobytes()
                runs, bounds = pairs(part.column(3))
                if words:
                    found = Words(data, offsets)
                    word_runs, word_bounds = pairs(part.column(4))
                for i in range(part.num_rows):
                    raw, cuts = whole[offsets[i] : offsets[i + 1]], merged(runs[bounds[i] : bounds[i + 1]])
                    rest = without(raw, cuts)
                    made["n_removed"].append(len(raw) - len(rest))
                    made["n_spans"].append(len(cuts))
                    made["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                    if words:
                        several = merged(word_runs[word_bounds[i] : word_bounds[i + 1]])
                        made["n_repeat_words"].append(sum(b - a for a, b in several))
                        if kept_text and several:
                            at, base = found.first[i], offsets[i]
                            more = [(int(found.start[at + a] - base), int(found.end[at + b - 1] - base)) for a, b in several]
                            rest = without(raw, merged(np.array([*cuts, *more])))
                    if kept_text:
                        made["kept"].append(rest.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(made[name], kind) for name, _, kind in fields]], names=["t1", "t2", *made])

    done = scratch.table(marked.mapInArrow(tidy(cut), "t1 long, t2 long, " + ", ".join(f"{name} {kind}" for name, kind, _ in fields)), "done")
    scratch.drop("texts", "spans", "words-texts", "words-spans")
    scratch.release()

    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["n_repeat_words", "has_repeat"] if words else []) + ([kept_text] if kept_text else [])
    names = [c for c in dict.fromkeys(keep if keep is not None else documents.columns) if c not in new]
    whole = F.coalesce(documents[text], F.lit(""))
    held = [whole.alias("whole")] if kept_text else []
    held += [F.regexp_count(whole, F.lit(WORD)).cast("long").alias("n_words")] if words else []
    rows = documents.select(*[documents[c].alias(f"c{i}") for i, c in enumerate(names)], *held, F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))
    # Texts of several rows: the window is reached by all of their bytes or none.
    copies = rows.where(F.col("n_bytes") >= (min(window, 2 * words - 1) if words else window)).groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = done.join(copies, ["t1", "t2"], "full").withColumn("again", F.col("copies").isNotNull()).drop("copies")
    joined = rows.join(marks, ["t1", "t2"], "left").withColumn("again", F.coalesce("again", F.lit(False))).withColumn("all", F.col("again") & (F.col("n_bytes") >= window))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    n_removed = F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    out = [F.col("n_bytes"), n_removed.alias("n_removed"), F.when(F.col("all"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(F.col("all"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    gone = F.col("all")
    if words:
        all_words = F.col("again") & (F.col("n_words") >= words)
        n_repeat = F.when(all_words, F.col("n_words")).otherwise(F.coalesce("n_repeat_words", F.lit(0))).cast("long")
        out += [n_repeat.alias("n_repeat_words"), ((n_removed > 0) | (n_repeat > 0)).alias("has_repeat")]
        gone = gone | all_words
    if kept_text:
        out.append(F.when(gone, F.lit("")).otherwise(F.coalesce("kept", "whole")).alias(kept_text))
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *out)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_array_dedup(documents, keep=["doc_id"], words=WORDS)


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
windows AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * WINDOW})) AS m FROM (SELECT r, h, unnest(range(0, n - {WINDOW - 1})) AS i FROM d WHERE n >= {WINDOW})),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY m) > 1),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT r, min(i) AS s, max(i) + {WINDOW} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS after FROM runs),
cut AS (SELECT r, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM gaps JOIN d USING (r) GROUP BY r),
word_windows AS (SELECT r, i, md5_number(array_to_string(w[i + 1 : i + {WORDS}], ' ')) AS m FROM (SELECT r, w, unnest(range(0, len(w) - {WORDS - 1})) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d) WHERE len(w) >= {WORDS})),
word_again AS (SELECT r, i FROM word_windows QUALIFY count(*) OVER (PARTITION BY m) > 1),
word_cut AS (SELECT r, CAST(sum(least({WORDS}, coalesce(after - i, {WORDS}))) AS BIGINT) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM word_again) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) > 0 OR coalesce(n_repeat_words, 0) > 0 AS has_repeat FROM d LEFT JOIN cut USING (r) LEFT JOIN word_cut USING (r)
"""
