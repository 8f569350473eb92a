"""Quality rules with risk-controlled thresholds.

Base statistics of each whole text fix a base rule. On top of it, rules of the form
"reject if metric >= cutoff" are admitted per stratum (language) only with a
statistical guarantee: among labelled good documents of the stratum, the exact
binomial (Clopper-Pearson) test must certify, at a level corrected for all strata and
rules, that the rule rejects at most its share of ``max_false_rejection`` of the good
documents. Cutoffs of one rule are tested in a fixed order from the strictest one, and
testing stops at the first that fails, so the cutoffs need no further correction.

Labels enter as counts on a fixed grid of cutoffs: a table of at most
strata x rules x bins rows, whatever the size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import require, with_text_columns
from tidemark.llm.text import Words, buffers, prefix_hash, span_hash, windows

STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
BINS = 200
#: metric, bin width; each is compared as floor(metric / width), at most BINS.
RULES = {"symbols_per_word": 0.02, "dup_line_share": 0.005, "repeat_word_share": 0.005, "long_words": 0.1, "short_words": 0.1}
MAX_STRATA = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_stats(part: pa.RecordBatch) -> dict[str, pa.Array]:
    """The base statistics of each text of a batch; see ``quality_rules``."""
    data, offsets = buffers(part.column(part.num_columns - 1))
    n = len(offsets) - 1
    words = Words(data, offsets)
    prefix = prefix_hash(data)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.bincount(words.doc, lead[words.end] - lead[words.start], n)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    # Lines: cut at \n and at the ends of texts; only lines with a word count.
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:][data == 10] = True
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(data))
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(data) else 0)
    filled = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[filled], stop[filled]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    line_hash = span_hash(prefix, begin, stop)
    order = np.lexsort((line_hash, line_doc))
    again = (line_hash[order][1:] == line_hash[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    n_lines = np.bincount(line_doc, minlength=n)
    dup_lines = np.bincount(line_doc[order][1:][again], minlength=n)

    # Words covered by 3-word windows that occur twice or more in the same text.
    three = windows(words.hashes(prefix), 3)
    covered = np.zeros(len(words.start), bool)
    if len(three):
        same_text = np.flatnonzero(words.doc[: len(three)] == words.doc[2:])
        value, doc = three[same_text], words.doc[same_text]
        order = np.empty(len(value), np.int64)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            order[a:b] = a + np.argsort(value[a:b])
        same = (value[order][1:] == value[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(value), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = same_text[twice]
        for j in range(3):
            covered[at + j] = True
    repeated = np.bincount(words.doc[covered], minlength=n)
    made = (words.count, chars, symbols[offsets[1:]] - symbols[offsets[:-1]], n_lines, dup_lines, repeated)
    return {name: pa.array(np.asarray(x).astype(np.int64)) for name, x in zip(STATS, made, strict=True)}


def with_text_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None, drop_text: bool = False) -> DataFrame:
    return with_text_columns(df, text, text_stats, [(n, T.LongType()) for n in STATS], keep, drop_text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_bins() -> dict[str, Column]:
    """Each rule's metric as a bin number from 0 to BINS; texts without words get 0."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean_length = F.col("word_chars") / words
    metric = {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_word_share": F.col("n_repeat_words") / words,
        "long_words": mean_length,
        "short_words": F.when(F.col("n_words") > 0, F.greatest(F.lit(20.0) - mean_length, F.lit(0.0))).otherwise(F.lit(0.0)),
    }
    return {name: F.least(F.floor(metric[name] / width + 1e-9), F.lit(BINS)).cast("int") for name, width in RULES.items()}


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def certified(k: int, n: int, risk: float, level: float) -> bool:
    """Is the rejection rate at most risk, by the exact test on k rejections of n?

    Equal to: the one-sided Clopper-Pearson upper bound at this level is at most risk.
    """
    if n == 0 or k >= n * risk:
        return False
    return log_binomial_cdf(k, n, risk) <= math.log(level)


def select_cutoffs(counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], strata: int, max_false_rejection: float = 0.02, level: float = 0.05) -> dict[tuple[str, str], int]:
    """Per (stratum, rule), the least certified cutoff bin that rejects most bad documents.

    counts: good and bad labelled documents by bin. A rule that rejects no labelled bad
    document is left out, and among cutoffs that reject equally many the highest is
    taken, so that clean documents are kept.
    """
    risk, corrected = max_false_rejection / len(RULES), level / max(1, strata * len(RULES))
    chosen = {}
    for key, (good, bad) in counts.items():
        n, best, best_bad = int(good.sum()), None, 0
        rejected_good, rejected_bad = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
        for cutoff in range(BINS, 0, -1):
            if not certified(int(rejected_good[cutoff]), n, risk, corrected):
                break
            if rejected_bad[cutoff] > best_bad:
                best, best_bad = cutoff, rejected_bad[cutoff]
        if best is not None:
            chosen[key] = best
    return chosen


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", quality: str = "quality", max_false_rejection: float = 0.02, level: float = 0.05) -> dict[tuple[str, str], int]:
    """Cutoffs from the labelled documents of stats that pass the base rule.

    Several labels of one id count as bad if any is 0. Null ids and labels are left out.
    """
    require(labels, id_col, quality)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(quality).isNotNull()).groupBy(id_col).agg(F.min(quality).alias("__quality"))
    bins = rule_bins()
    joined = stats.where(~base_failed()).select(F.col(id_col), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__stratum"), *[bins[r].alias(f"__{r}") for r in RULES]).join(marks, id_col)
    long = joined.select("__stratum", "__quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__{r}").alias("bin")) for r in RULES])).alias("x"))
    table = long.groupBy("__stratum", "x.rule", "x.bin").agg(F.count_if(F.col("__quality") >= 1).alias("good"), F.count_if(F.col("__quality") < 1).alias("bad"))
    rows = table.limit(MAX_STRATA * len(RULES) * (BINS + 1) + 1).collect()
    if len(rows) > MAX_STRATA * len(RULES) * (BINS + 1):
        raise ValueError(f"more than {MAX_STRATA} strata")
    counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
    for s, rule, b, good, bad in rows:
        held = counts.setdefault((s, rule), (np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64)))
        held[0][b] += good
        held[1][b] += bad
    return select_cutoffs(counts, len({s for s, _ in counts}), max_false_rejection, level)


def verdict(cutoffs: dict[tuple[str, str], int], stratum: str = "lang") -> Column:
    """The first rule that rejects the document, or null."""
    bins, out = rule_bins(), F.lit(None).cast("string")
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    for rule in reversed(list(RULES)):
        per = {s: c for (s, r), c in cutoffs.items() if r == rule}
        if per:
            cutoff = F.create_map(*[x for s, c in sorted(per.items()) for x in (F.lit(s), F.lit(c))])
            out = F.when(bins[rule] >= F.try_element_at(cutoff, key), F.lit(rule)).otherwise(out)
    return out


def quality_rules(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", stratum: str = "lang", max_false_rejection: float = 0.02, level: float = 0.05, drop_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """documents (all columns and rows, or those in keep) with statistics, ``base_failed``, ``failed_rule`` and ``kept``.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (of those, equal to an earlier line), n_repeat_words: longs. Null and
    empty texts have zeros and fail the base rule. Documents of a stratum without
    enough labels (null strata form one of their own) are judged by the base rule
    alone. Repeated rows are judged alike; input columns named like an output are
    replaced; an empty table gives an empty result.
    """
    require(documents, text, id_col, stratum)
    cutoffs = calibrate(with_text_stats(documents, text, [id_col, stratum], True), labels, stratum, id_col, max_false_rejection=max_false_rejection, level=level)
    stats = with_text_stats(documents, text, keep, drop_text)
    failed = stats.withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict(cutoffs, stratum))
    return failed.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(documents.select("doc_id", "lang", "text"), labels, drop_text=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op4_sql(max_false_rejection: float = 0.02, level: float = 0.05) -> str:
    """The same rows by SQL: statistics, exact binomial tests, cutoffs and verdicts."""
    ratio = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_share": "n_repeat_words / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)", "short_words": "CASE WHEN n_words > 0 THEN greatest(20.0::DOUBLE - word_chars / greatest(n_words, 1), 0.0::DOUBLE) ELSE 0.0::DOUBLE END"}
    bins = ", ".join(f"CAST(least(floor(({ratio[r]}) / {w}::DOUBLE + 1e-9::DOUBLE), {BINS}) AS INTEGER) AS {r}" for r, w in RULES.items())
    long = " UNION ALL ".join(f"SELECT stratum, quality, {i} AS rule, {r} AS bin FROM labelled" for i, r in enumerate(RULES))
    failed = " ".join(f"WHEN {r} >= (SELECT cutoff FROM chosen c WHERE c.rule = {i} AND c.stratum = b.stratum) THEN '{r}'" for i, r in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM split WHERE len(w) >= 3)),
twice AS (SELECT r, p FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, (VALUES (0), (1), (2)) x(o) GROUP BY r),
stats AS (SELECT split.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {bins} FROM stats),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT b.*, quality FROM b JOIN marks USING (doc_id) WHERE NOT base_failed),
counted AS (SELECT stratum, rule, bin, count(*) FILTER (quality >= 1) AS good, count(*) FILTER (quality < 1) AS bad FROM ({long}) GROUP BY ALL),
totals AS (SELECT stratum, rule, sum(good) AS n FROM counted GROUP BY ALL),
cuts AS (SELECT t.stratum, t.rule, t.n, c.cutoff, coalesce(sum(good), 0) AS k, coalesce(sum(bad), 0) AS bad FROM totals t CROSS JOIN (SELECT unnest(range(1, {BINS + 1})) AS cutoff) c LEFT JOIN counted x ON x.stratum = t.stratum AND x.rule = t.rule AND x.bin >= c.cutoff GROUP BY ALL),
near AS (SELECT * FROM cuts WHERE k < n * {max_false_rejection / len(RULES)}::DOUBLE),
cdf AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({max_false_rejection / len(RULES)}::DOUBLE) + (n - i) * ln(1 - {max_false_rejection / len(RULES)}::DOUBLE))) AS p FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT) + 1)) AS i FROM near) GROUP BY ALL),
ok AS (SELECT stratum, rule, cutoff FROM cdf WHERE p <= {level}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM counted) * {len(RULES)})),
stop AS (SELECT stratum, rule, coalesce(max(cutoff) FILTER (cutoff NOT IN (SELECT cutoff FROM ok WHERE ok.stratum = cuts.stratum AND ok.rule = cuts.rule)), 0) AS last FROM cuts GROUP BY ALL),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (bad, cutoff)) AS cutoff FROM cuts JOIN stop USING (stratum, rule) WHERE cutoff > last AND bad > 0 GROUP BY ALL),
judged AS (SELECT *, CASE {failed} END AS failed_rule FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule FROM judged
"""
