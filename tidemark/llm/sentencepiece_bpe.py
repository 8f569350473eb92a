"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross (before runs of the space
mark, and between characters that no piece holds side by side). All new segments of a
batch lie in one flat numpy array of symbols. Each round finds the smallest pair rank
of every segment, merges its occurrences from the left at once and compacts the
array, until no pair remains. Merging at once is exact where no longer piece that
starts or ends with the merged one ranks before it; in other segments only the
leftmost occurrence merges in a round. Segments beyond ``HEAP_LENGTH`` symbols use a
heap, so their cost stays near linear.

Encoded words are kept in a bounded per-worker cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns

SPACE = "▁"
HEAP_LENGTH = 256
CACHE_WORDS = 150_000
CACHE_CHARS = 48
NONE = np.iinfo(np.int64).max
_coders: dict[str, Coder] = {}


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file: kind 0 is normal, 1 control, 2 unknown, 3 a byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if p.is_control(i) else 2 if p.is_unknown(i) else 3 if p.is_byte(i) else 0
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class Coder:
    """Encodes and decodes with the identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, model: list[tuple[str, float, int]]):
        self.begin = next(i for i, m in enumerate(model) if m[0] == "<s>")
        self.end = next(i for i, m in enumerate(model) if m[0] == "</s>")
        self.unknown = next((i for i, m in enumerate(model) if m[2] == 2), 0)
        self.bytes_id = {int(m[0][3:5], 16): i for i, m in enumerate(model) if m[2] == 3}
        normal = {m[0]: i for i, m in enumerate(model) if m[2] == 0}
        scores = sorted({model[i][1] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p: rank_of[model[i][1]] for p, i in normal.items()}
        # Symbols: the id of a piece, or base + code point for a character that is none.
        self.base = len(model)
        self.size = self.base + 0x110000
        symbol = lambda p: normal.get(p, self.base + ord(p) if len(p) == 1 else None)
        self.of_char = np.arange(self.base, self.size, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        keys, ranks, results = [], [], []
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(r)
                    results.append(normal[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], NONE)
        self.ranks = np.append(np.array(ranks, np.int64)[order], NONE)
        self.results = np.append(np.array(results, np.int64)[order], 0)
        self.unsafe = np.zeros(self.base, bool)
        for p, r in rank.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and part in rank and rank[part] >= r:
                        self.unsafe[normal[part]] = True
        pairs = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        self.adjacent = np.append(np.sort(np.array([symbol(x[0]) * self.size + symbol(x[1]) for x in pairs], np.int64)), NONE)
        self.piece_bytes = [b"" if m[2] == 1 else bytes([int(m[0][3:5], 16)]) if m[2] == 3 else b" \xe2\x81\x87 " if m[2] == 2 else m[0].replace(SPACE, " ").encode() for m in model]
        self.is_byte = [m[2] == 3 for m in model]
        self.cache: dict[str, bytes] = {}

    def pack(self, symbol: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """Symbols, ordered by word, as one run of little-endian 32-bit ids per word."""
        odd = np.flatnonzero(symbol >= self.base)
        if len(odd):
            spelled = [[self.bytes_id.get(b, self.unknown) for b in chr(x - self.base).encode()] if self.bytes_id else [self.unknown] for x in symbol[odd].tolist()]
            count = np.ones(len(symbol), np.int64)
            count[odd] = [len(x) for x in spelled]
            start = np.cumsum(count) - count
            symbol, word = np.repeat(symbol, count), np.repeat(word, count)
            for at, x in zip(start[odd].tolist(), spelled, strict=True):
                symbol[at : at + len(x)] = x
        raw, bounds = symbol.astype("<u4").tobytes(), (4 * np.searchsorted(word, np.arange(n + 1))).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words that hold the space mark where the text has a space."""
        symbol = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        key = symbol[:-1] * self.size + symbol[1:]
        new = np.ones(len(symbol), bool)
        new[1:] = (word[1:] != word[:-1]) | (self.adjacent[np.searchsorted(self.adjacent, key)] != key)
        segment = np.cumsum(new) - 1
        owner, length = word[new], np.bincount(segment, minlength=0)
        long = np.flatnonzero(length > HEAP_LENGTH)
        if len(long):
            rest = length[segment] <= HEAP_LENGTH
            symbols, segments = self.merge_rounds(symbol[rest], segment[rest])
            start = np.cumsum(length) - length
            for i in long.tolist():
                merged = self.heap_merge(symbol[start[i] : start[i] + length[i]].tolist())
                symbols, segments = np.append(symbols, merged), np.append(segments, np.full(len(merged), i))
            order = np.argsort(segments, kind="stable")
            symbols, segments = symbols[order], segments[order]
        else:
            symbols, segments = self.merge_rounds(symbol, segment)
        return self.pack(symbols, owner[segments], len(words))

    def merge_rounds(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all segments in rounds; finished ones leave the array."""
        done = []
        while len(symbol) > 1:
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[self.keys[at] != key] = len(self.keys) - 1
            at[segment[:-1] != segment[1:]] = len(self.keys) - 1
            rank = np.append(self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbol)))
            live = np.repeat(least < NONE, length)
            if not live.all():
                done.append((symbol[~live], segment[~live]))
                symbol, segment, rank, at = symbol[live], segment[live], rank[live], np.append(at, len(self.keys) - 1)[live][:-1]
                if not len(symbol):
                    break
                least, length = least[least < NONE], length[least < NONE]
            hit = rank == np.repeat(least, length)
            # In a run of adjacent hits every second one merges, from the left.
            where = np.flatnonzero(hit)
            run_start = np.ones(len(where), bool)
            run_start[1:] = where[1:] != where[:-1] + 1
            run = np.maximum.accumulate(np.where(run_start, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            result = self.results[at[where]]
            # Where a longer piece may rank first, only the leftmost one merges.
            of = segment[where]
            lead = np.ones(len(where), bool)
            lead[1:] = of[1:] != of[:-1]
            ok = lead | ~self.held_back(of, lead, self.unsafe[result])
            where, result = where[ok], result[ok]
            symbol[where] = result
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            symbol, segment = symbol[keep], segment[keep]
        done.append((symbol, segment))
        symbol, segment = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(segment, kind="stable")
        return symbol[order], segment[order]

    @staticmethod
    def held_back(of: np.ndarray, lead: np.ndarray, unsafe: np.ndarray) -> np.ndarray:
        """True for all hits of a segment that has an unsafe one."""
        group = np.cumsum(lead) - 1
        return np.bincount(group, unsafe)[group] > 0 if len(group) else unsafe

    def merge_of(self, a: int, b: int) -> tuple[int, int] | None:
        """Rank and result of a pair of symbols."""
        key = a * self.size + b
        at = int(np.searchsorted(self.keys, key))
        return (int(self.ranks[at]), int(self.results[at])) if self.keys[at] == key else None

    def heap_merge(self, symbols: list[int]) -> list[int]:
        """The same merges one by one with a heap, for very long segments."""
        n, s = len(symbols), list(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and (m := self.merge_of(s[i], s[j])):
                heapq.heappush(heap, (m[0], i, s[i], s[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = self.merge_of(a, b)[1], -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [x for x in s if x >= 0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, begin and end included."""
        cut = [words_of(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list({w for words in cut for w in words})
        found = self.cache
        if new:
            made = dict(zip(new, self.encode_words([SPACE + w.replace(" ", SPACE) for w in new]), strict=True))
            found.update((w, x) for w, x in made.items() if len(w) <= CACHE_CHARS)
            if len(made) and any(len(w) > CACHE_CHARS for w in new):
                found = {**made, **{w: found[w] for words in cut for w in words if w in found}}
        head, tail = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [head + b"".join([found[w] for w in words]) + tail for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces join to characters, invalid bytes become U+FFFD."""
        ids = list(ids)
        table = self.piece_bytes
        body = [i for i in ids if i not in (self.begin, self.end)]
        if body and not self.is_byte[body[0]] and table[body[0]][:1] == b" " and body[0] != self.unknown:
            raw = table[body[0]][1:] + b"".join([table[i] for i in body[1:]])
        else:
            raw = b"".join([table[i] for i in body])
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out = []
            while raw:
                n = next((k for k in range(1, 5) if is_character(raw[:k])), 0)
                out.append(raw[:n].decode() if n else "�")
                raw = raw[n or 1 :]
            return "".join(out)


def is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def words_of(text: str) -> list[str]:
    """What follows each first space of a run, the dummy prefix included."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return re.findall(r" ( *[^ ]*)", " " + text)
    return text.split(" ")


def coder(model: list[tuple[str, float, int]], key: str) -> Coder:
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(model)
    return _coders[key]


def sentencepiece_roundtrip(documents: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, drop_text: bool = False, ids: bool = True) -> DataFrame:
    """documents (all columns and rows, or those in keep) with n_tokens, token_ids, ids_sha256, decoded and decoded_sha256.

    A null or empty text has the begin and end ids only and decodes to an empty text.
    With ids False, token_ids and decoded are left out. The vocabulary is read on the
    driver and broadcast (one model's pieces). Input columns named like an output are
    replaced; an empty table gives an empty result.
    """
    require(documents, text)
    model = read_model(model_path)
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        c = coder(shared.value, key)
        packed = c.encode_batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
        decoded = [c.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
        out = {
            "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
        }
        if ids:
            out |= {"token_ids": pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
        return out

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if ids:
        fields += [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return with_text_columns(documents, text, run, fields, keep, drop_text)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentencepiece_roundtrip(documents, public_tokenizers.path("piece_bpe_32k.model"), drop_text=True, ids=False)
