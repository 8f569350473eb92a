"""Source scanners: definition counts by kind with regular expressions and XPath.

Input is a table of whole files (path, text); see ``sources.files.source_tree``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.strings import match_count

#: Fixed patterns by scanner and kind.
EJS = {
    "include": r"""include\s*\(\s*['"]([^'"]+)['"]""",
    "function": r"\bfunction\s+[A-Za-z_$][\w$]*\s*\(",
    "variable": r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*",
}
SVELTE_SCRIPT = r"(?i)<script(?:\s[^>]*)?>([\s\S]*?)</script>"
SVELTE = {
    "function": r"(?m)^\s*function\s+[A-Za-z_$][\w$]*",
    "variable": r"(?m)^\s*(?:const|let)\s+[A-Za-z_$][\w$]*",
}
RAZOR = {
    "route": r"(?m)^\s*@page\b",
    "import": r"(?m)^\s*@(using|namespace)\b",
    "service": r"(?m)^\s*@inject\b",
    "base": r"(?m)^\s*@inherits\b",
    "model": r"(?m)^\s*@model\b",
    "component": r"<([A-Z][A-Za-z0-9_.]*)\b",
}
RAZOR_METHOD = r"(?m)^\s*(?:public|private|protected|internal|static|async|override|virtual|sealed|partial|new|\s)+[\w<>\[\],?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:=>|\{)"
#: Words before a parenthesis that are no method, and what marks files without methods.
RAZOR_PARAMETER = "[Parameter]"
RAZOR_NO_METHOD = ["if", "for", "while", "switch", "catch", "using", "foreach", "lock"]
SOLUTION_PROJECT = r"""(?m)^Project\("[^"]+"\)\s*=\s*"[^"]+",\s*"[^"]+\""""


def kind_counts(files: DataFrame, patterns: dict[str, str], text: Column | None = None) -> DataFrame:
    """(path, kind, n) of every file and pattern."""
    text = F.col("text") if text is None else text
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), match_count(text, p).alias("n")) for k, p in patterns.items()])
    return files.select("path", F.explode(entries).alias("e")).select("path", "e.kind", "e.n")


def ejs(files: DataFrame) -> DataFrame:
    """Template counts; every file is one template."""
    templates = files.select("path", F.lit("template").alias("kind"), F.lit(1).cast("long").alias("n"))
    return kind_counts(files, EJS).unionByName(templates)


def svelte(files: DataFrame) -> DataFrame:
    """Functions and variables that start a line of a script element, and script blocks."""
    blocks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SVELTE_SCRIPT), F.lit(1))
    per_block = files.select("path", F.explode(blocks).alias("text"))
    counted = kind_counts(per_block, SVELTE).groupBy("path", "kind").agg(F.sum("n").alias("n"))
    return counted.unionByName(files.select("path", F.lit("script_block").alias("kind"), F.size(blocks).cast("long").alias("n")))


def razor(files: DataFrame) -> DataFrame:
    """Views, directives, components and methods; methods do not count in files with [Parameter]."""
    text = F.coalesce("text", F.lit(""))
    views = files.select("path", F.lit("view").alias("kind"), F.lit(1).cast("long").alias("n"))
    names = F.filter(F.regexp_extract_all(text, F.lit(RAZOR_METHOD), F.lit(1)), lambda x: ~x.isin(RAZOR_NO_METHOD))
    methods = files.select("path", F.lit("method").alias("kind"), F.when(F.contains(text, F.lit(RAZOR_PARAMETER)), F.lit(0)).otherwise(F.size(names)).cast("long").alias("n"))
    return kind_counts(files, RAZOR).unionByName(views).unionByName(methods)


def projects(files: DataFrame) -> DataFrame:
    """Project files by element (names without their namespace), and the projects of solutions.

    A file that is no XML counts as a project without elements.
    """
    solution = F.endswith(F.lower("path"), F.lit(".sln"))
    xml_solution = F.endswith(F.lower("path"), F.lit(".slnx"))
    parsed = F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff", "")
    count = lambda path: F.xpath_int(F.col("xml"), F.lit(f"count({path})")).cast("long")
    lists = frameworks(F.array_join(F.xpath(F.col("xml"), F.lit("//*[local-name()='TargetFrameworks']/text()")), ";"))
    kinds = {
        "project": F.lit(1).cast("long"),
        "sdk": count("/*[@Sdk!='']"),
        "package": count("//*[local-name()='PackageReference']"),
        "project_reference": count("//*[local-name()='ProjectReference']"),
        "target_framework": count("//*[local-name()='TargetFramework' and normalize-space(text())!='']") + F.size(lists),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("n")) for k, c in kinds.items()])
    rows = files.where(~solution & ~xml_solution).select("path", parsed.alias("xml")).select("path", F.explode(entries).alias("e")).select("path", "e.kind", "e.n")
    plain = files.where(solution).select("path", F.lit("project").alias("kind"), match_count(F.col("text"), SOLUTION_PROJECT).alias("n"))
    tagged = files.where(xml_solution).select("path", parsed.alias("xml")).select("path", F.lit("project").alias("kind"), count("//*[translate(local-name(),'PROJECT','project')='project']").alias("n"))
    return rows.unionByName(plain).unionByName(tagged)


def frameworks(c: Column) -> Column:
    """The parts of a list split at ; or , without blanks."""
    return F.filter(F.transform(F.split(c, "[;,]"), F.trim), lambda x: x != "")


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind").agg(F.sum("n").alias("n"))


def samples(counts: DataFrame, most: int = 30) -> DataFrame:
    """Per kind the first paths that have it, a sample by definition (at most `most`).

    Each task keeps its first paths only, so a kind with many files does not gather.
    """
    from pyspark.sql import Window

    ranked = counts.where("n > 0").withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("path"))).where(F.col("place") <= most)
    return ranked.groupBy("kind").agg(F.array_sort(F.collect_list("path")).alias("paths"))
