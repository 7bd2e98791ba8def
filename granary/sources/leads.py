"""Lead lists from CSV files, HTML tables and tab-separated text; links from Markdown and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import blank_to_null

# Header aliases, in the order in which fields claim columns.
ALIASES = (
    ("company_linkedin", ("company linkedin", "organization linkedin")),
    ("company_website", ("company website", "website", "domain")),
    ("company_name", ("company name", "organization name", "account name", "company", "organization")),
    ("person_linkedin", ("person linkedin", "contact linkedin", "linkedin url", "linkedin")),
    ("person_name", ("person name", "contact name", "full name", "name")),
    ("job_title", ("job title", "title", "position", "role")),
    ("industry", ("industry",)),
    ("country", ("country/region", "country", "location")),
)


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """field -> header: in order of precedence, the first unclaimed header that contains an alias."""
    taken, out = set(), {}
    for field, aliases in ALIASES:
        found = next((h for h in headers if h not in taken and any(a in h.strip().lower() for a in aliases)), None)
        if found is not None:
            taken.add(found)
            out[field] = found
    return out


def project(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a company name (blank is null), and warnings on the others. rows has pos and the file's columns."""
    found = resolve_headers([c for c in rows.columns if c not in ("file", "pos")])
    fields = [(blank_to_null(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast("string")).alias(f) for f, _ in ALIASES]
    place = [c for c in ("file", "pos") if c in rows.columns]
    named = rows.select(*place, *fields)
    bad = named.where("company_name IS NULL").select(*place, F.concat(F.lit("Row "), (F.col("pos") + 2).cast("string"), F.lit(": no company name")).alias("warning"))
    return named.where("company_name IS NOT NULL"), bad


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, pos (from 0, in each file) and the columns of the CSV files under a path, which share a header; empty lines are skipped.

    A file may be read in many splits (unless cells may hold line ends): rows are numbered inside each, and moved by the
    number of rows in the splits before it, which a first pass counts. That pass leaves one row a split.
    """
    rows = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    numbered = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_n"))
    splits = numbered.groupBy("file", "_split").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    moved = splits.select("file", "_split", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_by"))
    return numbered.join(moved, ["file", "_split"]).select("file", (F.col("_n") + F.col("_by")).alias("pos"), *[F.col(f"`{c}`") for c in rows.columns])


def html_rows(html: Column) -> Column:
    """The cells of every table row, as an array of arrays."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)


def tab_rows(text: Column) -> Column:
    """Lines with tabs as arrays of cells; none if the first line has no tab."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.contains(F.try_element_at(lines, F.lit(1)), F.lit("\t")), F.transform(lines, lambda x: F.split(x, "\t"))).otherwise(F.array().cast("array<array<string>>"))


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc[^>]*>([^<]+)</loc>"), F.lit(1)), lambda u: F.trim(u))


def markdown_links(md: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(md, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1)), lambda u: F.regexp_replace(u, "#.*$", "")))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A reader by extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "parquet", "orc"):
        return getattr(spark.read, kind)(path)
    raise ValueError(f"no reader for .{kind}: spreadsheets and documents are converted to CSV, HTML or text first")
