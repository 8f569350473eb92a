"""Evidence and gate operators: row-level quality messages, pairing, support, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.collections import flags, has_entries, set_precision, set_recall
from tidemark.functions.numbers import count_true, every, number, ratio, rounded, some, total
from tidemark.functions.strings import filled

#: Fixed patterns: how either side prints a source location.
SUBJECT_LOCATION = r"[@ ][A-Za-z0-9_./-]+:\d+\b"
RIVAL_LOCATIONS = (r"\bSource:\s+\S.*\bL\d+\b", r"\bloc=L\d+\b")


def subject_kind_patterns(subject: str) -> list[str]:
    """Fixed patterns of the subject's counts by kind in a note."""
    return [rf"(?i)\b{subject}(?:\s+declaration)?\s+counts\s+(\{{[^}}]+\}})", rf"(?i)\b{subject}\s+also\s+reports\b.*?\bin\s+(\{{[^}}]+\}})"]


NATIVE_KIND_PATTERNS = [r"(?i)\bnative(?:\s+counter|\s+declaration)?\s+counts\s+(\{[^}]+\})", r"(?i)\bnative\s+counts\s+(\{[^}]+\})", r"(?i)\bvalidation\s+denominator\s+counts\s+functions/types\s+(\{[^}]+\})"]

#: Fixed patterns: why a command cannot be run as it stands.
PLACEHOLDER = r"<[^>]+>"
INLINE_NOTE = r"\s\([^)]*\)\s*$"
UNEXPANDED = (r"\bdocumentSymbol\s+<[^>]+>", r"\bplus\b.*<[^>]+>")


def kind_map(note: Column, patterns: list[str]) -> Column:
    """The first pattern's JSON object of counts that parses, as a map, or null."""
    parse = lambda p: F.from_json(F.nullif(F.regexp_extract(F.coalesce(note, F.lit("")), p, 1), F.lit("")), "map<string,double>")
    return F.coalesce(*[parse(p) for p in patterns])


def has_subject_location(text: Column) -> Column:
    return F.rlike(text, F.lit(SUBJECT_LOCATION))


def has_rival_location(text: Column) -> Column:
    return F.rlike(text, F.lit(RIVAL_LOCATIONS[0])) | F.rlike(text, F.lit(RIVAL_LOCATIONS[1]))


def proven(symbol: Column, subject_text: Column, rival_text: Column) -> Column:
    """Both sides name the symbol and a location."""
    name = F.coalesce(symbol, F.lit(""))
    named = (name != "") & F.contains(subject_text, name) & F.contains(rival_text, name)
    return named & has_subject_location(subject_text) & has_rival_location(rival_text)


def command_blockers(command: Column, helper: str) -> Column:
    """Codes of what keeps a command from being run; helper is the prefix of temporary helper folders."""
    return flags(
        (F.rlike(command, F.lit(PLACEHOLDER)), "native_command_contains_placeholder"),
        (F.rlike(command, F.lit(rf"/(?:private/)?tmp/{helper}[^ ]+")), "native_command_uses_ephemeral_helper_path"),
        (F.rlike(command, F.lit(INLINE_NOTE)), "native_command_contains_inline_note"),
        (F.rlike(command, F.lit(UNEXPANDED[0])) | F.rlike(command, F.lit(UNEXPANDED[1])), "native_command_uses_unexpanded_file_list"),
    )


def evidence_status(proven_rows: Column, kind_rows: Column, metric_kinds: Column) -> Column:
    return F.when(proven_rows > 0, F.lit("sampled-name-location")).when((kind_rows > 0) | metric_kinds, F.lit("kind-count-only")).otherwise(F.lit("count-only"))


def precision_evidence(artifacts: DataFrame, subject_word: str) -> DataFrame:
    """Per artifact: sampled and proven rows, rows with counts by kind, status.

    artifacts has queries (array of symbol, missing flags and heads) and repos (array
    with note); both may be null or empty.
    """
    text = lambda lines: F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n")
    present = lambda q: ~F.coalesce(q["subject_missing"], F.lit(False)) & ~F.coalesce(q["rival_missing"], F.lit(False))
    sampled = F.filter("queries", present)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    shown = F.filter(sampled, lambda q: proven(q["symbol"], text(q["subject_head"]), text(q["rival_head"])))
    kinds = F.filter("repos", lambda r: kind_map(r["note"], NATIVE_KIND_PATTERNS).isNotNull() & kind_map(r["note"], subject_kind_patterns(subject_word)).isNotNull())
    metric = has_entries(F.col("native.definition_counts")) | has_entries(F.col("native.expanded_definition_counts"))
    out = artifacts.select("language", "file", size(sampled).alias("comparable_rows"), size(shown).alias("proven_rows"), size(F.col("repos")).alias("validation_rows"), size(kinds).alias("kind_rows"), metric.alias("metric_kinds"))
    return out.withColumn("proven_ratio", rounded(ratio(F.col("proven_rows"), F.col("comparable_rows")), 4)).withColumn("status", evidence_status(F.col("proven_rows"), F.col("kind_rows"), F.col("metric_kinds")))


def precision_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("artifacts"), *[total(F.col(c)).cast("long").alias(c) for c in ("comparable_rows", "proven_rows", "validation_rows", "kind_rows")], *[count_true(F.col("status") == s).alias(s.replace("-", "_")) for s in ("sampled-name-location", "kind-count-only", "count-only")], (some(F.col("proven_rows") > 0) & some(F.col("kind_rows") > 0)).alias("passed"))


def call_evidence(artifacts: DataFrame) -> DataFrame:
    """Per artifact: calls, receiver-typed calls and status; columns subject_calls, typed_calls, rival_calls."""
    calls, typed = F.col("subject_calls"), F.col("typed_calls")
    status = F.when(calls.isNull(), F.lit("missing")).when(typed.isNotNull(), F.lit("receiver-typed")).otherwise(F.lit("calls-only"))
    return artifacts.withColumn("status", status).withColumn("typed_ratio", rounded(ratio(typed, calls), 4))


def call_summary(core: DataFrame, live: DataFrame) -> DataFrame:
    """Sums of both tiers and the gate: all core rows typed, all live rows with counts."""
    one = core.agg(F.count("*").alias("core_rows"), total(F.col("subject_calls")).alias("core_calls"), total(F.col("typed_calls")).alias("core_typed_calls"), every(F.col("status") == "receiver-typed").alias("core_typed"))
    two = live.agg(F.count("*").alias("live_rows"), total(F.col("subject_calls")).alias("live_calls"), total(F.col("rival_calls")).alias("live_rival_calls"), count_true(F.col("status") == "receiver-typed").alias("live_typed_rows"), every(F.col("status") != "missing").alias("live_counted"))
    return one.crossJoin(two).withColumn("core_typed_ratio", rounded(ratio(F.col("core_typed_calls"), F.col("core_calls")), 4)).withColumn("passed", F.col("core_typed") & F.col("live_counted"))


def support(artifacts: DataFrame, deterministic: DataFrame, detected: DataFrame) -> DataFrame:
    """Per artifact: support type, extractor and query counts.

    deterministic and detected have language, extractor, extensions and position; of
    several rows of a language the last counts.
    """
    from tidemark.operators.joins import left_last

    named = lambda df, p: df.select("language", F.col("extractor").alias(f"{p}_extractor"), F.col("extensions").alias(f"{p}_extensions"), F.col("position"))
    joined = left_last(artifacts, named(deterministic, "d"), ["language"], [F.col("position")]).drop("position")
    joined = left_last(joined, named(detected, "e"), ["language"], [F.col("position")]).drop("position")
    count = lambda test: F.coalesce(F.size(F.filter("queries", test)), F.lit(0))
    gone = lambda q, side: F.coalesce(q[f"{side}_missing"], F.lit(False))
    detector = F.col("detector_only") | F.col("e_extractor").isNotNull()
    out = joined.select(
        "language",
        "file",
        F.when(detector, F.lit("detector-only")).otherwise(F.lit("deterministic-extractor")).alias("support_type"),
        F.coalesce("d_extractor", "e_extractor").alias("extractor"),
        F.coalesce("d_extensions", "e_extensions").alias("extensions"),
        F.coalesce(F.size("queries"), F.lit(0)).alias("rows"),
        count(lambda q: ~gone(q, "rival") & ~gone(q, "subject")).alias("comparable_rows"),
        count(lambda q: ~gone(q, "rival")).alias("rival_rows"),
        count(lambda q: gone(q, "rival")).alias("rival_missing_rows"),
        count(lambda q: ~gone(q, "subject")).alias("subject_rows"),
    )
    return out.withColumn("rival_missing_ratio", rounded(ratio(F.col("rival_missing_rows"), F.col("rows")), 4))


def support_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("artifacts"), count_true(F.col("support_type") == "detector-only").alias("detector_only"), count_true(F.col("support_type") != "detector-only").alias("deterministic"), *[total(F.col(c)).cast("long").alias(c) for c in ("rows", "comparable_rows", "rival_missing_rows")])


def quality_messages(*rules: tuple[Column, str | Column]) -> Column:
    """The messages of all rules that a row breaks."""
    return flags(*rules)


def with_gate(rows: DataFrame, errors: str = "errors") -> DataFrame:
    """Counts of clean and failing rows and the pass flag (one row)."""
    return rows.agg(F.count("*").alias("rows"), count_true(F.size(errors) == 0).alias("clean_rows"), F.coalesce(F.sum(F.size(errors)), F.lit(0)).alias("messages"), every(F.size(errors) == 0).alias("passed"))


def validation_messages(artifacts: DataFrame, structured: tuple[str, ...] = ("json",)) -> DataFrame:
    """Errors and warnings of each artifact's validation block, and its status.

    artifacts has language, validation (struct or null) with repos; structured formats
    need no block.
    """
    from tidemark.operators.coverage import validation_columns

    v, code = F.col("validation"), ~F.col("language").isin(*structured)
    cols = validation_columns(v)
    rows = artifacts.withColumns({k: c for k, c in cols.items()})
    present = v.isNotNull()
    per_repo = F.flatten(
        F.transform(
            v["repos"],
            lambda r, i: F.array_compact(
                F.array(
                    F.when(filled(r["repo"]).isNull() | filled(r["commit"]).isNull(), F.format_string("repo row %d missing repo or commit", i + 1)),
                    *[F.when(number(r[c]).isNull(), F.format_string(f"repo row %d missing {c}", i + 1)) for c in ("subject_definitions", "native_definitions", "coverage_ratio")],
                    F.when(~F.coalesce(r["ok"], F.lit(True)), F.format_string("repo row %d marked ok=false", i + 1)),
                )
            ),
        )
    )
    head = flags(
        (~present & code, "missing multi_repo_validation block"),
        (present & filled(v["status"]).isNotNull() & (v["status"] != "passed"), F.concat(F.lit("validation status is "), v["status"])),
        (present & (F.col("repo_count") < F.col("minimum_repos")), F.format_string("only %d/%d validation repos recorded", F.col("repo_count"), F.col("minimum_repos"))),
        (present & (F.col("passed_repo_count") < F.col("minimum_repos")), F.format_string("only %d/%d repos pass coverage", F.col("passed_repo_count"), F.col("minimum_repos"))),
    )
    warnings = flags((present & filled(v["selection_method"]).isNull(), "selection_method missing"), (present & filled(v["measurement_order"]).isNull(), "measurement_order missing"))
    out = rows.withColumn("errors", F.concat(head, F.coalesce(F.when(present, per_repo), F.array().cast("array<string>")))).withColumn("warnings", warnings).withColumn("is_code", code)
    ok = (F.size("errors") == 0) & present & F.col("validation_passed")
    return out.withColumn("status", F.when(ok, F.lit("passed")).when(~code & ~present, F.lit("structured-pending")).otherwise(F.lit("failed")))


def validation_gate(rows: DataFrame) -> DataFrame:
    """Passed if no errors are left and every code artifact passed (one row)."""
    return rows.agg(F.count("*").alias("artifacts"), count_true(F.col("is_code")).alias("code_artifacts"), count_true(F.col("status") == "passed").alias("passed_artifacts"), F.coalesce(F.sum("repo_count"), F.lit(0)).alias("repo_rows"), F.coalesce(F.sum("passed_repo_count"), F.lit(0)).alias("passed_repo_rows"), (every(F.size("errors") == 0) & every(~F.col("is_code") | (F.col("status") == "passed"))).alias("passed"))


def blockers_by(rows: DataFrame, *keys: str) -> DataFrame:
    """The distinct blockers of all rows of a key, sorted; a key without any has an empty array.

    Codes are made distinct before they are gathered, so an array holds the codes that
    there are, not one per row.
    """
    codes = rows.select(*keys, F.explode_outer("blockers").alias("code")).distinct()
    return codes.groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("blockers"))


def support_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """``support`` over plain rows (subject_missing, rival_missing, detector_only): counts, no arrays."""
    gone = lambda side: F.coalesce(F.col(f"{side}_missing"), F.lit(False))
    out = rows.groupBy(*keys).agg(F.when(some(F.col("detector_only")), F.lit("detector-only")).otherwise(F.lit("deterministic-extractor")).alias("support_type"), F.count("*").alias("rows"), count_true(~gone("rival") & ~gone("subject")).alias("comparable_rows"), count_true(~gone("rival")).alias("rival_rows"), count_true(gone("rival")).alias("rival_missing_rows"))
    return out.withColumn("rival_missing_ratio", rounded(ratio(F.col("rival_missing_rows"), F.col("rows")), 4))


def set_scores(items: DataFrame, *keys: str) -> DataFrame:
    """Recall and precision of two sets given as rows (keys, item, expected: is it in the expected set, else the found one)."""
    each = items.groupBy(*keys, "item").agg(some(F.col("expected")).alias("e"), some(~F.col("expected")).alias("f"))
    out = each.groupBy(*keys).agg(count_true(F.col("e")).alias("n_expected"), count_true(F.col("f")).alias("n_found"), count_true(F.col("e") & F.col("f")).alias("n_both"))
    return out.withColumn("recall", ratio(F.col("n_both"), F.col("n_expected"))).withColumn("precision", ratio(F.col("n_both"), F.col("n_found")))


def recall_precision(rows: DataFrame, expected: str, found: str) -> DataFrame:
    """Set recall and precision of two array columns, with what is missing and extra."""
    e, f = F.col(expected), F.col(found)
    return rows.withColumns({"recall": set_recall(e, f), "precision": set_precision(e, f), "missing": F.array_sort(F.array_except(e, f)), "extra": F.array_sort(F.array_except(f, e))})
