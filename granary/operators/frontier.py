"""Pages that sitemaps list, with sitemap indexes followed round by round.

Fetched documents are a table; a round joins the sitemaps to be read with it. An index's own sitemaps are followed if
their names tell of a company rather than of products, at most `most` of a site's in a round, and none twice.

Defined results: sitemaps that weren't fetched or have no more than SHORT characters list nothing; of documents with one
url the first by letters counts; a page that several sitemaps list is one row, with the first round that found it;
cycles end as every sitemap of a site is read once; empty tables give an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import stored

# What names of sitemaps worth following hold, and the marks of an index.
CORPORATE = r"corporate|about|investor|sustainability|esg|careers|newsroom|press|manufactur|technolog|ir[-_]"
INDEX_MARKS = ("<sitemapindex", "<sitemap>")
SHORT, MOST = 100, 5


def locations(xml: Column) -> Column:
    """The addresses that a sitemap lists, in order."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc[^>]*>([^<]+)</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u.startswith("http"))


def sitemap_pages(sites: DataFrame, fetched: DataFrame, rounds: int = 1, most: int = MOST) -> DataFrame:
    """site, url, round of all pages. sites has site and url (of its sitemap), fetched url and xml."""
    known = fetched.where(F.length("xml") > SHORT).groupBy("url").agg(F.min("xml").alias("xml"))
    front = sites.where("url IS NOT NULL").select("site", "url").distinct().withColumn("place", F.lit(0).cast("long"))
    seen, pages = front.select("site", "url"), []
    for n in range(rounds + 1):
        is_index = F.col("xml").contains(INDEX_MARKS[0]) | F.col("xml").contains(INDEX_MARKS[1])
        read = stored(front.join(known, "url").select("site", "place", is_index.alias("is_index"), locations(F.col("xml")).alias("urls")), "sitemaps")
        listed = read if n else read.where("NOT is_index")
        pages.append(listed.select("site", F.explode(F.filter("urls", lambda u: ~u.endswith(".xml"))).alias("url")).withColumn("round", F.lit(n)))
        if n == rounds:
            break
        maps = F.slice(F.filter("urls", lambda u: u.endswith(".xml") & F.lower(u).rlike(CORPORATE)), 1, most)
        # a sitemap has `most` candidates at most, and so has a site in the end
        ranked = read.where("is_index").select("site", "place", F.posexplode(maps).alias("nth", "url")).withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("place", "nth", "url")))
        chosen = ranked.where(F.col("rank") <= most).groupBy("site", "url").agg(F.min("rank").cast("long").alias("place"))
        front = stored(chosen.join(seen, ["site", "url"], "left_anti").select("site", "url", "place"), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("site", "url"))
    found = pages[0]
    for more in pages[1:]:
        found = found.unionByName(more)
    return found.groupBy("site", "url").agg(F.min("round").alias("round"))
