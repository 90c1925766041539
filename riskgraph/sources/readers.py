"""Sources: posts, pages, listings, media files, event and chunk logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.media import content_type
from ..functions.urls import file_extension
from ..operators.ranking import dedup_first
from .html_nodes import page_nodes


def read_posts(spark: SparkSession, path: str, max_posts: int | None = None,
               url: str | None = None) -> DataFrame:
    """Posts (id, link, title, content, date) from a folder of JSON files.

    ``max_posts`` keeps the first posts by (date, id); ``url`` reads a single post whose title
    is the <title> of its page.
    """
    posts = spark.read.schema(S.POST).option("multiLine", True).json(path)
    return flat_posts(posts, max_posts, url)


def flat_posts(posts: DataFrame, max_posts: int | None = None, url: str | None = None) -> DataFrame:
    from ..functions.base import strip
    from ..operators.pages import elements, first, text_of

    flat = posts.select(
        "id", "link", F.col("title.rendered").alias("title"),
        F.col("content.rendered").alias("html"), "date")
    if url is not None:
        one = page_nodes(flat.where(F.col("link") == url), keep_html=True)
        n = F.col("nodes")
        name = strip(text_of(n, first(elements(n, lambda e: e["tag"] == "title"))))
        return one.withColumn("title", F.coalesce(name, F.col("title"))).select(
            "id", "link", "title", "html", "date")
    return flat if max_posts is None else flat.orderBy("date", "id").limit(max_posts)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_listings(spark: SparkSession, path: str, mode: str = "all", from_page: int = 1,
                  max_pages: int = 0) -> DataFrame:
    """Listing pages (fake_type, page, listing_page, html) of the wanted range."""
    return listing_range(spark.read.parquet(path), mode, from_page, max_pages)


def listing_range(pages: DataFrame, mode: str = "all", from_page: int = 1, max_pages: int = 0
                  ) -> DataFrame:
    types = ["web", "social"] if mode == "all" else [mode]
    start = max(from_page, 1)
    kept = pages.where(F.col("fake_type").isin(types) & (F.col("page") >= start))
    return kept if max_pages <= 0 else kept.where(F.col("page") < start + max_pages)


def read_media(spark: SparkSession, path: str, pattern: str = "*", stored: DataFrame | None = None) -> DataFrame:
    """Files below a folder with content hash, size, type and extension; see ``media_facts``.

    Spark's file scan leaves out files without a byte."""
    return media_facts(
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(path), stored)


def media_facts(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per content of files(path, length, content), under its first path; the bytes stay out.

    Hash and content type come from one look at the bytes in the scan's own stage, and only these narrow rows are
    shuffled to find equal contents, a copied file once for each task.  Files whose hash is among ``stored`` (a column
    sha) are left out.  A file that couldn't be read (content NULL) has no row, an empty one has.
    """
    known = F.lit(None).cast("string")
    facts = files.where(F.col("content").isNotNull()).select(
        "path", F.sha2("content", 256).alias("sha"), F.col("length").alias("file_size_bytes"),
        content_type("content").alias("content_type"),
        file_extension(known, F.regexp_replace("path", "^[a-z]+:/*", "https://file/")).alias("ext"))
    if stored is not None:
        facts = facts.join(stored.select("sha").distinct(), "sha", "left_anti")
    return dedup_first(facts, ["sha"], ["path"]).withColumn(
        "file_path", F.concat_ws(".", "sha", "ext"))


def read_events(spark: SparkSession, path: str, streaming: bool = False,
                files_per_trigger: int = 100) -> DataFrame:
    if streaming:
        return (spark.readStream.schema(S.EVENT)
                .option("maxFilesPerTrigger", files_per_trigger).json(path))
    return spark.read.schema(S.EVENT).json(path)


def read_chunks(spark: SparkSession, path: str, streaming: bool = False,
                files_per_trigger: int = 100) -> DataFrame:
    if streaming:
        return (spark.readStream.schema(S.CHUNK)
                .option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    return spark.read.schema(S.CHUNK).parquet(path)


def read_submissions(spark: SparkSession, path: str, streaming: bool = False,
                     files_per_trigger: int = 100) -> DataFrame:
    if streaming:
        return (spark.readStream.schema(S.SUBMISSION)
                .option("maxFilesPerTrigger", files_per_trigger).json(path))
    return spark.read.schema(S.SUBMISSION).json(path)


def feed_has_match(json_col: str):
    return F.coalesce(F.get_json_object(json_col, "$.exists") == "true", F.lit(False))


