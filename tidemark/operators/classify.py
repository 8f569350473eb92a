"""Rule-based classification by ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats without code, and languages known by extension only.
STRUCTURED = ("json", "markdown")
DETECTED = ("ejs", "ets", "r")
FAMILY_LANGUAGE = {"cpp/cuda": "cuda", "objective-c": "objc", "verilog/systemverilog": "verilog", "json config": "json", "terraform/hcl": "terraform", "byond dm": "byond", "dotnet project": "dotnet", "delphi/lazarus forms": "delphi", "shell": "bash", "groovy/gradle": "groovy"}
EXTENSION_LANGUAGE = {".ejs": "ejs", ".ets": "ets", ".r": "r"}
COUNTERS = ("source-counter", "directive-counter", "template-counter", "regex-counter")
SERVERS = ("lsp", "analyzer", "roslyn", "clangd", "jdtls")
PARSERS = ("compiler", "parser", "tokenizer", "ripper", "sqlfluff", "hcl")


def cases(*pairs: tuple[Column, str | Column], otherwise: str | Column | None = None) -> Column:
    """The value of the first condition that holds; a null condition does not."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def tool_name(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def row_status(token_ratio: Column, detector_only: Column) -> Column:
    """No ratio is the stronger truth, then detection by extension only."""
    return cases((token_ratio.isNull(), "not-comparable"), (detector_only, "detector-only"), otherwise="comparable")


def truth_risk(language: Column, tool: Column, detector_only: Column, validated: Column, coverage_ratio: Column) -> Column:
    """How far a baseline can be trusted: structured, high, medium or low."""
    t = tool_name(tool)
    return cases(
        (language.isin(*STRUCTURED), "structured"),
        (F.coalesce(detector_only, F.lit(False)) | language.isin(*DETECTED), "high"),
        (has_any(t, ("counter", "proxy", "project")) | (t == "bash-n"), "medium"),
        (~F.coalesce(validated, F.lit(False)), "medium"),
        (F.coalesce(coverage_ratio, F.lit(0.0)) > 5, "medium"),
        otherwise="low",
    )


#: Codes of a weak truth's reason; a report may give sentences for them.
RISK_REASONS = ("structured", "detected", "counted", "unvalidated", "scope")


def risk_reason(language: Column, tool: Column, detector_only: Column, validated: Column, sentences: dict[str, str] | None = None) -> Column:
    """Why a truth is weak, as one of RISK_REASONS or the sentence given for it."""
    structured, detected, counted, unvalidated, scope = ((sentences or {}).get(code, code) for code in RISK_REASONS)
    script = F.contains(F.coalesce(tool, F.lit("")), F.lit("counter"))
    pending = ~F.coalesce(validated, F.lit(False))
    return cases((language.isin(*STRUCTURED), structured), (detector_only, detected), (script, counted), (pending, unvalidated), otherwise=scope)


def tool_class(language: Column, tool: Column, detector_only: Column) -> Column:
    t = tool_name(tool)
    return cases(
        (language.isin(*STRUCTURED), "structured-format"),
        (F.coalesce(detector_only, F.lit(False)), "detector-only-proxy"),
        (has_any(t, COUNTERS), "source-counter-proxy"),
        (has_any(t, ("proxy", "project")), "scope-proxy"),
        (has_any(t, ("tree-sitter",)), "tree-sitter-baseline"),
        (has_any(t, SERVERS), "compiler-or-lsp-baseline"),
        (has_any(t, PARSERS), "parser-library-baseline"),
        (t == "bash-n", "syntax-checker-proxy"),
        otherwise="other-baseline",
    )


def tool_risk(language: Column, klass: Column, detector_only: Column) -> Column:
    """A second risk rule, by the class of the tool; not the same as ``truth_risk``."""
    return cases((language.isin(*STRUCTURED), "structured"), (F.coalesce(detector_only, F.lit(False)) | (klass == "detector-only-proxy"), "high"), (klass.isin("source-counter-proxy", "scope-proxy", "syntax-checker-proxy"), "medium"), otherwise="low")
