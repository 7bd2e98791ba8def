"""Crawl-frontier operators over (site, url) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import url as U


def locale_segments(pages: DataFrame, least: int = U.LOCALE_REPEAT) -> DataFrame:
    """site, segment: first path segments that look like a locale, on `least` pages of a site or more."""
    seg = F.element_at(U.segments(F.col("path")), 1)
    some = pages.where(F.size(U.segments(F.col("path"))) > 0).select("site", seg.alias("segment"))
    shaped = some.where(F.col("segment").rlike("^[a-z]{2}(-[a-z]{2})?$") & ~F.col("segment").isin(*U.SHORT_KEYWORDS))
    return shaped.groupBy("site", "segment").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def scored(pages: DataFrame) -> DataFrame:
    """site, url, path, category, score: pages with their category's score, less for locales other than English."""
    distinct = pages.select(U.host(F.col("url")).alias("site"), "url", U.path(F.col("url")).alias("path")).distinct()
    named = distinct.withColumn("category", U.category(F.col("path"))).withColumn("segment", F.try_element_at(U.segments(F.col("path")), F.lit(1)))
    base = named.join(locale_segments(distinct).drop("n").withColumn("is_locale", F.lit(True)), ["site", "segment"], "left")
    points = U.category_score(F.col("category"))
    foreign = F.coalesce("is_locale", F.lit(False)) & ~U.is_english_locale(F.col("segment"))
    return base.select("site", "url", "path", "category", F.when(foreign, F.greatest(F.lit(0), points - U.LOCALE_PENALTY)).otherwise(points).alias("score"))


def rank_pages(pages: DataFrame, limit: int = 15) -> DataFrame:
    """The best `limit` pages of each site."""
    order = Window.partitionBy("site").orderBy(F.desc("score"), "url")
    return scored(pages).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def accumulate(pages: DataFrame, enough: int) -> DataFrame:
    """Pages of a site in order (pos) as long as the characters before them stay below `enough`."""
    before = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum("n_chars").over(before), F.lit(0))).where(F.col("before") < enough)


def one_per_host(rows: DataFrame, limit: int) -> DataFrame:
    """Greedy selection by (pass, pos): a host's first row, then `limit` rows of each key."""
    first = Window.partitionBy("key", "host").orderBy("pass", "pos")
    best = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("pass", "pos"))).where(F.col("rank") <= limit)


def consumer_sites(pages: DataFrame, least: int = 3) -> DataFrame:
    """site, content_hits, link_hits, is_b2c: three patterns of a page's content, or three of its links, mark a site.

    pages has site, content and links (an array).
    """
    marked = F.size(F.filter("links", lambda x: x.rlike("(?i)" + "|".join(U.B2C_LINKS))))
    each = pages.select("site", U.hits(F.col("content"), U.B2C_CONTENT).alias("content_hits"), marked.alias("link_hits"))
    return each.groupBy("site").agg(F.max("content_hits").alias("content_hits"), F.max("link_hits").alias("link_hits")).withColumn("is_b2c", (F.col("content_hits") >= least) | (F.col("link_hits") >= least))


def rank_corporate_pages(pages: DataFrame, consumer: DataFrame, limit: int = 15) -> DataFrame:
    """As rank_pages, of consumer sites (site) only the corporate categories."""
    mine = scored(pages).join(consumer.select("site", F.lit(True).alias("_b2c")), "site", "left")
    kept = mine.where(F.col("_b2c").isNull() | F.col("category").isin(*U.B2C_CATEGORIES)).drop("_b2c")
    order = Window.partitionBy("site").orderBy(F.desc("score"), "url")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def probes(sites: DataFrame, have: DataFrame, limit: int, paths: tuple[str, ...] = U.UNIVERSAL_PATHS) -> DataFrame:
    """site, url, pos of the first `limit` paths of each site that aren't known yet; sites has site, have site and url."""
    listed = sites.select("site", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("pos", "path"))
    urls = listed.select("site", F.concat(F.lit("https://"), "site", "path").alias("url"), "pos")
    new = urls.join(have.select("site", "url"), ["site", "url"], "left_anti")
    return new.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")


def discovery(pages: DataFrame) -> DataFrame:
    """site, method, probe: pages has site, origin (map, sitemap or link), category and score."""
    of = lambda name: F.count_if(F.col("origin") == name)
    per_site = pages.groupBy("site").agg(of("map").alias("m"), of("sitemap").alias("s"), of("link").alias("l"), F.count_if(F.col("score") >= 70).alias("high"), F.count_distinct("category").alias("categories"))
    return per_site.select("site", U.discovery_method(F.col("m"), F.col("s"), F.col("l")).alias("method"), U.needs_probe(F.col("high"), F.col("categories")).alias("probe"))
