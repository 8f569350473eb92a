"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are the hashes of its distinct word n-grams. Two documents link
when 100 * |intersection| >= threshold * |union|; the result is the class of every
document under links.

Order and classes. All n-grams are counted over all documents (hashes travel as
sorted, delta-coded blocks, about three bytes each). N-grams found in few documents are
rare (class 1), others frequent (classes 2 and 3). The bounds do not grow with the input:
the most frequent n-grams, a list of bounded length, are broadcast, and of the others
every document is told by exchange which of its own are frequent. The global order is
by class, then by hash, so rare n-grams come first.

Prefixes and signatures. A document of n tokens may miss at most
s = n - ceil(threshold * n / 100) of them in a partner. Rare tokens are indexed singly.
If its rare tokens are more than s, the first s + 1 are its prefix. Otherwise the
prefix extends into the frequent classes, whose tokens are dealt by hash to small
groups; in a group of class k only combinations of k tokens are indexed. A partner
that shares no combination misses all but k - 1 of the group's prefix tokens, so the
prefix extends until the tokens beyond k - 1 of each group, and the rare ones, are
s + 1. Then a common signature of every linked pair is certain. The number of groups
follows the size level of a document (levels differ by the factor 100 / threshold, so
partners are at most one level apart, and each document indexes its own and the next).
Two documents without a common rare token share frequent ones only, so the number of
those bounds the size of a partner under a combination; it goes with each combination,
and documents that share one long passage but little else are no candidates.

Verification. Equal sets are one node from the start. Pairs are first held against
the sets' parity bits, which bound how far two sets differ from below; only pairs that
may link are verified by their whole texts. Per signature, all members are
verified with one pivot (a star, not all pairs). Signatures whose members are not
in one class then are searched further: members outside the signature's largest class
against all of other classes. So no link between classes is lost, and pairs within a
class are not spelled out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components
from tidemark.llm.frames import release_memory, require, tidy
from tidemark.llm.text import buffers, lower, mix, shingle_sets, slices
from tidemark.session import Scratch, ship_package

#: An n-gram is frequent from this many documents, whatever the size of the input.
FREQUENT = 64
#: At most so many of them, the most frequent, are broadcast; the others come by exchange.
MAX_FREQUENT = 1 << 16
#: Groups of equal sets from this size, or that share, are looked up in a broadcast list.
LARGE_GROUP = 1000
#: Leading bits of a hash by which n-grams are counted.
COUNTED_BITS = 40
#: Class 3 starts at this multiple.
VERY_FREQUENT = 16
#: Tokens that a group of class k has, about, in the prefix of a document.
GROUP = {2: 3, 3: 3}
#: Below this size level tokens of all classes are indexed singly: no set of a level
#: above has too few tokens for its prefix (see ``combination_signatures``).
LEAST_LEVEL = 24
FLUSH_TOKENS = 2_000_000
#: Hash ranges, two for each input partition: a range holds about half a partition's n-grams.
MAX_RANGES = 1 << 18
_MIXER = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

COUNT_SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.BinaryType())])
OWNER_SCHEMA = T.StructType([*COUNT_SCHEMA.fields, T.StructField("owners", T.BinaryType())])
SIGNATURE_SCHEMA = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("sig", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("most", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("block", T.BinaryType())])
SET, SINGLE, COMBINATION = 0, 1, 2
ANY_SIZE = 2**31 - 1


def pack(array: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed: equal high bytes cost nothing."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + bytes([raw.itemsize]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(block: bytes) -> np.ndarray:
    n, size = int.from_bytes(block[:8], "little"), block[8]
    planes = np.frombuffer(pa.decompress(block[9:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(np.dtype(f"<u{size}")).ravel()


def level_starts(threshold: int, top: int = 200) -> np.ndarray:
    """Least set size of every level; the sizes of partners are at most one level apart."""
    return np.array([(100 / threshold) ** i for i in range(top)])


def slack(n: int, threshold: int) -> int:
    """Tokens that a document of n may miss in a partner."""
    return n - -(-threshold * n // 100)


def largest_partner(n: int, frequent: int, threshold: int) -> int:
    """The largest set that can link to one of n tokens by `frequent` common ones alone."""
    return frequent * (100 + threshold) // threshold - n


def combination_signatures(rare: int, frequent: np.ndarray, classes: np.ndarray, n: int, threshold: int, starts: np.ndarray) -> np.ndarray:
    """Signatures of the frequent part of a document's prefix; rare is its number of rare tokens.

    frequent is in global order. Both the document's own level and the next are indexed.
    A prefix always exists: with s the start of the level, a set has at least
    threshold * s tokens, and groups discount at most (1 - threshold) * s + 3 of them,
    which leaves more than its slack for thresholds of 0.7 and s of LEAST_LEVEL or more.
    """
    need, out = slack(n, threshold) + 1 - rare, []
    own = int(np.searchsorted(starts, n, "right")) - 1
    for level in (own, own + 1) if largest_partner(n, len(frequent), threshold) >= starts[own + 1] else (own,):
        group, ks = np.zeros(len(frequent), np.uint64), classes if starts[level] >= LEAST_LEVEL else np.ones(len(classes), np.int64)
        for k, size in GROUP.items():
            groups = max(1, round(starts[level] * (100 - threshold) / 100 / size))
            group = np.where(classes == k, (frequent >> np.uint64(8)) % np.uint64(groups) * np.uint64(4) + np.uint64(k), group)
        order = np.argsort(group, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = group[order][1:] != group[order][:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        counted = np.cumsum(place >= ks - 1)
        end = int(np.searchsorted(counted, need)) + 1
        inside = order[order < end]
        bounds = np.flatnonzero(np.concatenate([[True], group[inside][1:] != group[inside][:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            members = frequent[inside[a:b]]
            k = int(ks[inside[a]])
            if len(members) >= k:
                picks = np.array(list(combinations(range(len(members)), k)))
                total = np.full(len(picks), level, np.uint64) * _MIXER[7] + np.uint64(k) * _MIXER[6]
                for j in range(k):
                    total += members[picks[:, j]] * _MIXER[j]
                out.append(mix(total))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parity_bits(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set a bit string of a power of two of at least twice its size (64 to 65,536 bits).

    Every token flips one bit, so two sets differ in at least as many tokens as their
    strings differ in bits. A longer string folds to a shorter one by xor of its halves.
    """
    n = np.diff(bounds)
    size = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 64, 65536)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(n)), n)
    place = start[owner] + ((tokens >> np.uint64(12)) % size[owner].astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=int(size.sum())) & 1, bitorder="little").tobytes() if len(n) else b""
    return [raw[a // 8 : (a + b) // 8] for a, b in zip(start.tolist(), size.tolist(), strict=True)]


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two such strings differ, the longer one folded."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for half in range(len(a).bit_length() - len(b).bit_length()):
        width = 8 * len(a) >> (half + 1)
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def plausible(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that their bit strings allow to link; no linked pair is lost."""
    known = sets.select("doc", "n", "bits")
    one = pairs.join(known.withColumnsRenamed({"doc": "b", "n": "n_b", "bits": "bits_b"}), "b")
    both = one.join(known.withColumnsRenamed({"doc": "a", "n": "n_a", "bits": "bits_a"}), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.array([bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = pa.array(apart * (100 + threshold) <= (100 - threshold) * total)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens, bounds) of parts of the batches, whose first columns are __id and __text."""
    for batch in batches:
        for part in slices(batch, "__text"):
            if part.num_rows:
                data, offsets = buffers(part.column(1))
                tokens, bounds, _ = shingle_sets(lower(data), offsets, k)
                yield part, tokens, bounds


def _counted(tokens: np.ndarray) -> np.ndarray:
    """The leading bits of hashes by which n-grams are counted."""
    return tokens >> np.uint64(64 - COUNTED_BITS)


def _cuts(counted: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash ranges in sorted leading bits."""
    return np.searchsorted(counted * np.uint64(parts) >> np.uint64(COUNTED_BITS), np.arange(parts + 1))


def _ranges(values: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash ranges in sorted 64-bit values."""
    return np.searchsorted((values >> np.uint64(32)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def frequent_tokens(source: DataFrame, k: int, parts: int, scratch: Scratch, frequent: int = FREQUENT) -> tuple[dict[int, np.ndarray], DataFrame | None]:
    """The frequent classes: the list to broadcast, and the table (token, n) of all others, if any.

    Counts are exact over all documents, by the leading bits of the hashes. At most
    MAX_FREQUENT n-grams come to the driver: those in a share of 1 / MAX_FREQUENT of all
    tokens or more cannot be more. The classes only order tokens, so that two n-grams
    with equal leading bits are counted together does no harm.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            bounds = _cuts(values, parts)
            rows = [(p, pack(np.diff(values[a:b], prepend=np.uint64(0)))) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "block"])

        for _, tokens, _ in _sets(batches, k):
            held.append(_counted(tokens))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(np.concatenate([np.cumsum(unpack(b), dtype=np.uint64) for b in pdf["block"]]), return_counts=True)
        often = n >= frequent
        release_memory()
        # The first row holds the number of all tokens.
        return pd.DataFrame({"part": pdf["part"].iloc[0], "token": np.concatenate([[-1], values[often].astype(np.int64)]), "n": np.concatenate([[n.sum()], n[often]]).astype(np.int64)})

    counted = scratch.table(source.mapInArrow(tidy(blocks), COUNT_SCHEMA).groupBy("part").applyInPandas(count, "part int, token long, n long"), "frequent")
    total = counted.where("token < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(frequent, -(-total // MAX_FREQUENT))
    rows = counted.where((F.col("token") >= 0) & (F.col("n") >= least)).select("token", "n").toPandas()
    very = rows["n"] >= frequent * VERY_FREQUENT
    classes = {2: np.sort(rows["token"][~very].to_numpy().astype(np.uint64)), 3: np.sort(rows["token"][very].to_numpy().astype(np.uint64))}
    return classes, counted.where((F.col("token") >= 0) & (F.col("n") < least)) if least > frequent else None


def marks(source: DataFrame, k: int, parts: int, classes: dict[int, np.ndarray], rest: DataFrame, frequent: int) -> DataFrame:
    """(id, marks): of each document its frequent n-grams that are not in the broadcast classes.

    A mark is twice the leading bits, and one more in class 3. Documents meet the counted
    n-grams by hash range; a range holds about half an input partition's n-grams.
    """
    shared = source.sparkSession.sparkContext.broadcast(classes)
    very = frequent * VERY_FREQUENT

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.concatenate([shared.value[2], shared.value[3]]))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, owners = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(values)
            values, owners = values[order], owners[order]
            bounds = _cuts(values, parts)
            rows = [(p, pack(np.diff(values[a:b], prepend=np.uint64(0))), pack(owners[a:b].view(np.uint64))) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], names=OWNER_SCHEMA.names)

        for part, tokens, bounds in _sets(batches, k):
            ids = part.column(0)
            values, owner = _counted(tokens), np.repeat(np.arange(len(ids)), np.diff(bounds))
            use = ids.is_valid().to_numpy(zero_copy_only=False)[owner] & ~_in(known, values)
            held.append((values[use], ids.fill_null(0).to_numpy(zero_copy_only=False)[owner[use]]))
            size += len(held[-1][0])
            if size >= FLUSH_TOKENS // 2:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def find(owned: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(counted) and len(owned):
            order = np.argsort(counted["token"].to_numpy())
            token, n = counted["token"].to_numpy()[order].astype(np.uint64), counted["n"].to_numpy()[order]
            for block, owners in zip(owned["block"], owned["owners"], strict=True):
                values = np.cumsum(unpack(block), dtype=np.uint64)
                hit = _in(token, values)
                mark = values[hit].astype(np.int64) * 2 + (n[np.searchsorted(token, values[hit])] >= very)
                out.append((unpack(owners).view(np.int64)[hit], mark))
        release_memory()
        return pd.DataFrame({"__id": np.concatenate([o[0] for o in out]), "mark": np.concatenate([o[1] for o in out])})

    owned = source.select("__id", "__text").mapInArrow(tidy(blocks), OWNER_SCHEMA)
    found = owned.groupBy("part").cogroup(rest.groupBy("part")).applyInPandas(find, "__id long, mark long")
    return found.groupBy("__id").agg(F.collect_list("mark").alias("__marks"))


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def signatures(source: DataFrame, k: int, threshold: int, classes: dict[int, np.ndarray], parts: int) -> DataFrame:
    """Rows of three kinds: sets (doc, n, digest), single signatures in blocks, combinations (sig, doc, n).

    A third column of source, if any, holds the marks of each document.
    """
    shared = source.sparkSession.sparkContext.broadcast(classes)
    starts = level_starts(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        singles: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def rows(kind: int, total: int, **columns: object) -> pa.RecordBatch:
            arrays = [pa.array([kind] * total, pa.int32())]
            for name, kind_ in (("part", pa.int32()), ("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("digest", pa.binary()), ("bits", pa.binary()), ("block", pa.binary())):
                arrays.append(pa.array(columns[name], kind_) if name in columns else pa.nulls(total, kind_))
            return pa.RecordBatch.from_arrays(arrays, names=SIGNATURE_SCHEMA.names)

        def flush() -> pa.RecordBatch:
            sig = np.concatenate([s[0] for s in singles])
            doc = np.repeat(np.array([s[1] for s in singles], np.int64), [len(s[0]) for s in singles])
            n = np.repeat(np.array([s[2] for s in singles], np.uint32), [len(s[0]) for s in singles])
            order = np.argsort(sig)
            sig, doc, n = sig[order], doc[order], n[order]
            bounds = _ranges(sig, parts)
            made = [(p, b"".join(len(x).to_bytes(8, "little") + x for x in (pack(np.diff(sig[a:b], prepend=np.uint64(0))), pack(doc[a:b].view(np.uint64)), pack(n[a:b])))) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return rows(SINGLE, len(made), part=[m[0] for m in made], block=[m[1] for m in made])

        for part, tokens, bounds in _sets(batches, k):
            raw_ids = part.column(0)
            digests = [hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield rows(SET, len(raw_ids), doc=raw_ids, n=np.diff(bounds).astype(np.int32), digest=digests, bits=parity_bits(tokens, bounds))
            valid, ids = raw_ids.is_valid().to_numpy(zero_copy_only=False), raw_ids.fill_null(0).to_numpy(zero_copy_only=False)
            # An n-gram has one class in all documents, so marks hold for the whole part.
            marked = np.unique(part.column(2).flatten().to_numpy()) if part.num_columns > 2 else np.zeros(0, np.int64)
            upper = _counted(tokens)
            kind = np.ones(len(tokens), np.int8)
            for c in (2, 3):
                kind[_in(frequent[c], upper) | _in((marked[marked % 2 == c - 2] >> 1).astype(np.uint64), upper)] = c
            combined: list[np.ndarray] = []
            owners: list[int] = []
            reach: list[int] = []
            seen: dict[bytes, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                n = int(bounds[i + 1] - bounds[i])
                # Very small sets link to equal sets only; of equal sets the least id stands for all.
                only_equal = slack(n, threshold) == 0 and 100 * n < threshold * (n + 1)
                if not valid[i] or only_equal or seen.setdefault(digests[i], i) != i:
                    continue
                own, own_kind = tokens[bounds[i] : bounds[i + 1]], kind[bounds[i] : bounds[i + 1]]
                rare = own[own_kind == 1]
                need = slack(n, threshold) + 1
                singles.append((rare[:need], int(ids[i]), n))
                size += min(len(rare), need)
                if len(rare) < need:
                    order = np.argsort(own_kind, kind="stable")[len(rare) :]
                    combined.append(combination_signatures(len(rare), own[order], own_kind[order].astype(np.int64), n, threshold, starts))
                    owners.append(i)
                    reach.append(largest_partner(n, len(order), threshold))
            if combined and sum(map(len, combined)):
                count = [len(c) for c in combined]
                yield rows(COMBINATION, sum(count), sig=np.concatenate(combined).view(np.int64), doc=np.repeat(ids[owners], count), n=np.repeat(np.diff(bounds)[owners], count).astype(np.int32), most=np.repeat(np.array(reach, np.int32), count))
            if size >= FLUSH_TOKENS // 4:
                yield flush()
                singles, size = [], 0
        if size:
            yield flush()

    return source.mapInArrow(tidy(run), SIGNATURE_SCHEMA)


def _shared_singles(pdf: pd.DataFrame) -> pd.DataFrame:
    """(sig, doc, n) of the single signatures of one hash range that several documents have."""
    columns: list[list[np.ndarray]] = [[], [], []]
    for block in pdf["block"]:
        at = 0
        for held in columns:
            size = int.from_bytes(block[at : at + 8], "little")
            held.append(unpack(block[at + 8 : at + 8 + size]))
            at += 8 + size
    sig = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in columns[0]])
    doc, n = np.concatenate(columns[1]).view(np.int64), np.concatenate(columns[2]).astype(np.int32)
    order = np.argsort(sig)
    sig, doc, n = sig[order], doc[order], n[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    keep = same[1:] | same[:-1]
    release_memory()
    return pd.DataFrame({"sig": sig[keep].view(np.int64), "doc": doc[keep], "n": n[keep]})


def verified(pairs: DataFrame, source: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts."""
    texts = source.select(F.col("__id").alias("id"), "__text").where("id IS NOT NULL")
    one = pairs.join(texts.withColumnsRenamed({"id": "b", "__text": "text_b"}), "b")
    both = one.join(texts.withColumnsRenamed({"id": "a", "__text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for part in slices(batch, "text_b"):
                data, offsets = buffers(part.column(3))
                tokens, bounds, _ = shingle_sets(lower(data), offsets, k)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                linked = np.zeros(len(a), bool)
                for i in range(len(a)):
                    own = tokens[bounds[i] : bounds[i + 1]]
                    text = part.column(2)[i]
                    if last[0] != text:
                        raw, ends = buffers(part.column(2).slice(i, 1))
                        last = (text, shingle_sets(lower(raw), ends, k)[0])
                    other = last[1]
                    common = int(_in(other, own).sum())
                    linked[i] = common > 0 and 100 * common >= threshold * (len(own) + len(other) - common)
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["u", "v"])

    return both.mapInArrow(tidy(run), "u long, v long")


def _fitting(threshold: int) -> object:
    """Partners' sizes are within the threshold of one another, and of what their signature allows."""
    return (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))


def representatives(linkable: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """(doc, rep) of every row: the least document with an equal set.

    Groups with a share of 1 / MAX_FREQUENT of all rows, so at most MAX_FREQUENT groups,
    find theirs in a broadcast list, where their rows lie; only small groups meet in tasks.
    """
    groups = linkable.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
    least = scratch.table(groups, "equal")
    large = F.col("rows") >= max(LARGE_GROUP, -(-total // MAX_FREQUENT))
    looked_up = linkable.join(F.broadcast(least.where(large).select("digest", "rep")), "digest", "left")
    others = looked_up.where("rep IS NULL").select("digest", "doc").join(least.where(~large).select("digest", "rep"), "digest", "left")
    return looked_up.where("rep IS NOT NULL").select("doc", "rep").unionByName(others.select("doc", F.coalesce("rep", "doc").alias("rep")))


def jaccard_components(documents: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5, threshold: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of documents: id_col, n_shingles and component_id.

    component_id is the smallest id reachable by links, itself included. Null and empty
    texts have no n-grams and link with nothing; texts of fewer than k words have one,
    the whole sequence. Rows with the same id are one node, linked by any of their
    texts. Rows with a null id get a null component and are linked with nothing. Other
    columns of the input play no part.
    """
    require(documents, text, id_col)
    if not 70 <= threshold <= 100:
        raise ValueError("threshold must be from 70 to 100")
    spark = documents.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "jaccard")
    source = documents.select(documents[id_col].cast("long").alias("__id"), documents[text].alias("__text"))
    parts = min(MAX_RANGES, max(16, 2 * source.rdd.getNumPartitions()))

    classes, rest = frequent_tokens(source, k, parts, scratch, frequent)
    scratch.release()
    told = source
    if rest is not None:
        marked = scratch.table(marks(source, k, parts, classes, rest, frequent), "marks")
        scratch.release()
        told = source.join(marked, "__id", "left").select("__id", "__text", "__marks")
    rows = scratch.table(signatures(told, k, threshold, classes, parts), "signatures")
    scratch.drop("frequent", "marks")
    sets = scratch.table(rows.where(F.col("kind") == SET).select("doc", "n", "digest", "bits"), "sets")
    linkable = sets.where("n > 0 AND doc IS NOT NULL")
    equal = representatives(linkable, sets.count(), scratch)
    copies = equal.where("doc <> rep").select(F.col("rep").alias("u"), F.col("doc").alias("v"))

    singles = rows.where(F.col("kind") == SINGLE).select("part", "block").groupBy("part").applyInPandas(_shared_singles, "sig long, doc long, n int")
    every = singles.withColumn("most", F.lit(ANY_SIZE)).unionByName(rows.where(F.col("kind") == COMBINATION).select("sig", "doc", "n", "most"))
    # Equal sets have equal signatures: their least id stands for all. An id drops out
    # if that holds for all of its rows.
    stood_for = equal.groupBy("doc").agg(F.bool_or(F.col("doc") == F.col("rep")).alias("stays")).where("NOT stays").select("doc")
    every = every.join(stood_for, "doc", "left_anti")
    postings = scratch.table(every, "postings")
    # The pivot is a set that may have partners of its own size or more, the one with the
    # largest reach: of a group of near copies, that with most of the common tokens. Sets
    # that reach less than the smallest such set have no partner under this signature.
    able = F.col("most") >= F.col("n")
    pivots = postings.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(F.when(able, F.col("n"))).alias("least"), F.min(F.when(able, F.struct((-F.col("most")).alias("order"), "n", "doc", "most"))).alias("pivot")).where("low <> high AND pivot IS NOT NULL").select("sig", "least", "pivot")
    shared = scratch.table(postings.join(pivots, "sig").where("most >= least").select("sig", "doc", "n", "most", "pivot"), "shared")
    scratch.drop("signatures", "postings")
    scratch.release()

    star = shared.where("doc <> pivot.doc").select(F.col("pivot.doc").alias("p"), F.col("doc").alias("d"), F.col("pivot.n").alias("n_a"), F.col("n").alias("n_b"), F.col("pivot.most").alias("most_a"), F.col("most").alias("most_b")).where(_fitting(threshold)).select(F.least("p", "d").alias("a"), F.greatest("p", "d").alias("b")).distinct()
    likely = scratch.table(plausible(star, sets, threshold), "likely-1")
    scratch.release()
    links = scratch.table(verified(likely, source, k, threshold), "links-1")
    scratch.release()
    classes_1 = connected_components(links, scratch, "round-1")

    # Signatures with members of several classes: those outside the largest class against all.
    member = shared.select("sig", "doc", "n", "most").join(classes_1.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    size = member.groupBy("sig", "component").agg(F.count("*").alias("members"))
    main = size.groupBy("sig").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("several")).where("several > 1").select("sig", "main")
    open_ = scratch.table(member.join(main, "sig"), "open")
    outer = open_.where("component <> main").select("sig", F.col("doc").alias("x"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("component").alias("x_class"))
    inner = open_.select("sig", F.col("doc").alias("y"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("component").alias("y_class"))
    crossed = outer.join(inner, "sig").where((F.col("x_class") != F.col("y_class")) & _fitting(threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    likely = scratch.table(plausible(crossed, sets, threshold), "likely-2")
    scratch.drop("shared", "open", "likely-1")
    scratch.release()
    more = scratch.table(verified(likely, source, k, threshold), "links-2")
    scratch.release()
    final = connected_components(links.unionByName(more).unionByName(copies), scratch, "round-2").withColumnRenamed("node", "doc")
    found = sets.where("doc IS NOT NULL").join(final, "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    nulls = sets.where("doc IS NULL").select("doc", "n", F.col("doc").alias("component"))
    return found.union(nulls).select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(documents.select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(words.doc_id, coalesce(r.y, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = words.doc_id
"""
