"""Audit of stated numbers, references and sources: each gate is a query for its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailbed.functions.text import agrees, differs_by, norm_number


def verify_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """claims: claim, stated, tolerance and, if wanted, relative; metrics: claim, value. Adds value, verdict: ok, differs or missing.

    Whole numbers without a unit must be met exactly. A tolerance is relative unless ``relative`` is false, which makes it absolute.
    """
    number = norm_number(F.col("stated"))
    exact = F.col("stated").rlike(r"^[\s+-]*[0-9,]+\s*$")
    ok = agrees(number, F.col("value"), F.when(exact, F.lit(0.0)).otherwise(F.col("tolerance")))
    if "relative" in claims.columns:
        ok = F.when(exact | F.col("relative"), ok).otherwise(~differs_by(number, F.col("value"), F.col("tolerance")))
    return claims.join(metrics, "claim", "left").select(
        "claim", "stated", number.alias("number"), F.round("value", 6).alias("value"), F.when(F.col("value").isNull(), "missing").when(ok, "ok").otherwise("differs").alias("verdict")
    )


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), line_no from 0; null texts give nothing."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def table_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of markdown tables whose first cell has a digit: (key, line_no, claim, description, source)."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    row = lines(docs, key, text).filter(F.ltrim("line").like("|%")).withColumn("cells", cells)
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    return row.filter(cell(1).rlike(r"\d")).select(key, "line_no", cell(1).alias("claim"), cell(2).alias("description"), F.regexp_extract(F.coalesce(cell(3), F.lit("")), "`([^`]+)`", 1).alias("source"))


def code_lines(docs: DataFrame, key: str, text: str, comment: str = r"^\s*(?:#|%|//)") -> DataFrame:
    """Lines that are neither blank nor whole-line comments."""
    return lines(docs, key, text).filter(~F.col("line").rlike(comment) & (F.trim("line") != ""))


def number_literals(docs: DataFrame, key: str, text: str, allowed: list[str]) -> DataFrame:
    """Numbers written into code beyond an allow list: (key, line_no, number)."""
    found = F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.])(\d+\.?\d*)(?![\w.])"), F.lit(1))).alias("number")
    return code_lines(docs, key, text).select(key, "line_no", found).filter(~F.col("number").isin(*allowed))


def cited_keys(docs: DataFrame, text: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all(text, F.lit(r"\\cite[a-z]*\{([^}]+)\}"), F.lit(1))).alias("keys")
    return docs.select(found).select(F.explode(F.split("keys", r"\s*,\s*")).alias("cite_key")).distinct()


def bib_entries(docs: DataFrame, text: str) -> DataFrame:
    """(cite_key, body) of BibTeX entries."""
    found = F.explode(F.split(text, r"(?m)^(?=@)")).alias("entry")
    return docs.select(found).select(F.regexp_extract("entry", r"^@\w+\{([^,\s]+),", 1).alias("cite_key"), F.col("entry").alias("body")).filter("cite_key <> ''")


def undefined_citations(cited: DataFrame, entries: DataFrame) -> DataFrame:
    return cited.join(entries, "cite_key", "left_anti").select("cite_key")


def uncited_entries(cited: DataFrame, entries: DataFrame) -> DataFrame:
    return entries.join(cited, "cite_key", "left_anti").select("cite_key")


def unverifiable_entries(entries: DataFrame) -> DataFrame:
    """Entries without arXiv id, DOI, URL, or venue and year."""
    has = F.col("body").rlike(r"(?i)arxiv|doi\s*=|url\s*=|https?://") | (F.col("body").rlike(r"(?i)(journal|booktitle)\s*=") & F.col("body").rlike(r"(?i)year\s*="))
    return entries.filter(~has).select("cite_key")


def impossible_arxiv(entries: DataFrame, first_year: int = 7, last_year: int = 26) -> DataFrame:
    """arXiv ids whose year or month can't be: (cite_key, arxiv)."""
    arxiv = F.explode(F.regexp_extract_all("body", F.lit(r"(?<!\d)(\d{4}\.\d{4,5})(?!\d)"), F.lit(1))).alias("arxiv")
    year, month = F.substring("arxiv", 1, 2).cast("int"), F.substring("arxiv", 3, 2).cast("int")
    return entries.select("cite_key", arxiv).filter((year < first_year) | (year > last_year) | (month < 1) | (month > 12))


def missing_sources(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Registered rows whose source file is absent or empty. files: path, length."""
    return rows.filter("source <> ''").join(files.filter("length > 0").select(F.col("path").alias("source")), "source", "left_anti")


def without_source(rows: DataFrame) -> DataFrame:
    """Registered rows (claim, source) that name no source file: a path in back quotes with a slash, or a bare one."""
    return rows.filter(~F.coalesce("source", F.lit("")).contains("/")).select("claim")


def absent(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files (path) that must be there and are not, or are empty. files: path, length."""
    return wanted.join(files.filter("length > 0").select("path"), "path", "left_anti")


def unfinished(docs: DataFrame, key: str, text: str, mark: str = r"\\(?:num|todo)\{", done: str = r"%\s*status:\s*done") -> DataFrame:
    """Sections said to be done that still hold a placeholder: (key, section, n_marks). A section begins at \\section."""
    each = docs.select(key, F.posexplode(F.split(text, r"(?=\\section\{)")).alias("section", "body"))
    return each.filter(F.col("body").rlike(done)).select(key, "section", F.size(F.regexp_extract_all("body", F.lit(mark), F.lit(0))).alias("n_marks")).filter("n_marks > 0")


def sample_sizes(counts: DataFrame, contracts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """contracts: source, expected; counts: source, n. Violations beyond the tolerance."""
    return contracts.join(counts, "source", "left").filter(F.coalesce(F.abs(F.col("n") - F.col("expected")) > tolerance * F.col("expected"), F.lit(True)))


def unregistered(measured: DataFrame, registry: DataFrame) -> DataFrame:
    return measured.join(registry.select("claim"), "claim", "left_anti")


def placeholders(text: Column) -> Column:
    """Number of marks left for later."""
    return F.size(F.regexp_extract_all(text, F.lit(r"TODO|FIXME|TBD|XXX|\?\?"), F.lit(0)))


def unproven_figures(figures: DataFrame, provenance: DataFrame) -> DataFrame:
    """figures: stem; provenance: stem, kind, source, source_url, captured, command. Violations with their reason.

    Every figure needs a record; a screenshot its address and date, a schematic nothing more, any other figure its source.
    """
    row = figures.join(provenance.withColumn("known", F.lit(True)), "stem", "left")
    why = (
        F.when(F.col("known").isNull(), "no provenance")
        .when((F.col("kind") == "screenshot") & (F.coalesce("source_url", F.lit("")).eqNullSafe("") | F.coalesce("captured", F.lit("")).eqNullSafe("")), "no address or date")
        .when(~F.coalesce("kind", F.lit("")).isin("screenshot", "schematic") & F.coalesce("source", F.lit("")).eqNullSafe(""), "no source")
    )
    return row.select("stem", why.alias("reason")).filter("reason IS NOT NULL")
