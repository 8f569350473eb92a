"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

The regression is trained on the driver from a small table of urls labelled by hand
(``url_labels.py``, or another of at most ``MAX_LABELLED`` rows) and scores every url in Arrow batches; the model is one array
of ``BUCKETS`` weights.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns
from tidemark.llm.text import buffers, prefix_hash, span_hash
from tidemark.llm.url_labels import labelled_urls

BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
MAX_LABELLED = 10_000
THRESHOLD = 0.5
MAX_RULES = 1000

#: (host, path prefix, verdict) as the query applies them.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z in lower case; path: from there up to ``?``, ``#`` or end.

    A null url or one without ``://`` has an empty host and path.
    """
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(path, empty)


def ngram_buckets(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of ``host`` and of ``path``, hashed apart.

    n-grams are over bytes; host and path have marked ends, and digits are alike.
    """
    rows, buckets = [], []
    for salt, column in enumerate((host, path)):
        raw, offsets = buffers(column)
        n = len(offsets) - 1
        size = np.diff(offsets) + 2
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = np.full(bounds[-1], 1, np.uint8)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[:-1]] = False
        inner[bounds[1:] - 1] = False
        data[inner] = np.where((raw >= 48) & (raw <= 57), 48, raw)
        prefix, row = prefix_hash(data), np.repeat(np.arange(n), size)
        for k in NGRAMS:
            start = np.arange(max(0, len(data) - k + 1))
            start = start[row[start] == row[np.minimum(start + k - 1, len(row) - 1)]] if len(start) else start
            h = span_hash(prefix, start, start + k)
            rows.append(row[start])
            buckets.append(((h >> np.uint64(20)) ^ np.uint64(salt * 7919)) & np.uint64(BUCKETS - 1))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def train(labelled: Iterable[tuple[str, str, int]], steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) from (host, path, label) rows, by full gradient steps (Adagrad)."""
    table = list(labelled)
    if len(table) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    y = np.array([x[2] for x in table], float)
    row, bucket = ngram_buckets(pa.array([x[0] for x in table], pa.string()), pa.array([x[1] for x in table], pa.string()))
    value = 1 / np.sqrt(np.bincount(row, minlength=len(table)))[row]
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, w[bucket] * value, len(table)) + w[-1]
        d = (1 / (1 + np.exp(-z)) - y) / max(1, len(table))
        g = np.append(np.bincount(bucket, d[row] * value, BUCKETS), d.sum()) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def score(host: pa.Array, path: pa.Array, weights: np.ndarray) -> np.ndarray:
    n = len(host)
    row, bucket = ngram_buckets(host, path)
    count = np.maximum(np.bincount(row, minlength=n), 1)
    return 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], n) / np.sqrt(count) + weights[-1])))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together) that fits, as host + path, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.lit(h + p)).otherwise(out)
    return out


def url_filter(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """pages (all columns and rows) with host, path, rule, url_score and verdict.

    The verdict is that of the longest fitting rule, else ``block`` for a score of
    threshold or more and ``allow`` below it. A null or malformed url has an empty host
    and path and is scored as such. Repeated rows are judged alike; input columns named
    like an output are replaced; an empty table gives an empty result.
    """
    require(pages, url)

    def parts(u: str) -> tuple[str, str]:
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        return rest[:cut].lower(), tail[:end]

    weights = train([(*parts(u), y) for u, y in (labelled if labelled is not None else labelled_urls())]).astype(np.float64)
    carried = [c for c in pages.columns if c not in ("host", "path", "rule", "url_score", "verdict")]
    host, path = host_and_path(F.col("__url"))
    split = pages.select(*[f"`{c}`" for c in carried], pages[url].alias("__url")).withColumns({"host": host, "path": path}).drop("__url")

    def batch_score(part: pa.RecordBatch) -> dict[str, pa.Array]:
        joined = part.column(part.num_columns - 1)
        return {"url_score": pa.array(score(part.column(part.schema.get_field_index("host")), joined, weights))}

    scored = with_text_columns(split.select(*[f"`{c}`" for c in split.columns if c != "path"], "path"), "path", batch_score, [("url_score", T.DoubleType())])
    kind = {h + p: v for h, p, v in rules}
    ruled = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.try_element_at(F.create_map(*[x for k, v in kind.items() for x in (F.lit(k), F.lit(v))]), F.col("rule")) if kind else F.lit(None).cast("string")
    return ruled.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("url_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")
