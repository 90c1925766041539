"""Search-result triage: candidates, deep targets, page merges, screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.base import count_if, strip
from ..functions.pages import block_kind
from ..functions.search import is_generic_result, mentions_query
from ..functions.text import text_signature
from ..functions.urls import canonicalize_url, is_low_value_target, is_search_page, url_host
from .ranking import concat_ranked, dedup_first, top_n, with_rank


def expand_queries(subjects: DataFrame) -> DataFrame:
    """Search strings of each query(query_id, query, query_type), distinct and ordered."""
    def forms(kind: str):
        return F.array_distinct(F.array(*[
            F.replace(F.lit(t), F.lit("%s"), F.col("query")) for t in V.QUERY_SUFFIXES[kind]]))

    texts = (F.when(F.col("query_type") == "phone", forms("phone"))
             .when(F.col("query_type") == "bank", forms("bank")).otherwise(forms("url")))
    return subjects.select("query_id", F.posexplode(texts).alias("pos", "search_text"))


def select_candidates(results: DataFrame, queries: DataFrame, limit: int = V.CANDIDATE_LIMIT
                      ) -> DataFrame:
    """At most ``limit`` usable results per query, first engine before the second.

    results(query_id, engine, pos, title, url, snippet) with engine 1 or 2;
    queries(query_id, query, query_type).  Engine 2 only fills what engine 1 leaves open,
    which is the same as ranking by (engine, pos) after the dedup.
    """
    usable = (
        results.join(queries, "query_id")
        .where(~is_low_value_target("url") & ~is_search_page("url")
               & mentions_query("title", "snippet", "url", "query", "query_type"))
        .drop("query", "query_type")
        .withColumn("canonical", canonicalize_url("url"))
    )
    order = ["engine", "pos"]
    once = dedup_first(usable, ["query_id", "canonical"], order)
    return with_rank(once, ["query_id"], order, "rank", limit)


def _targetable(df: DataFrame) -> DataFrame:
    return df.where(~is_low_value_target("url") & ~is_search_page("url"))


def _finish_targets(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    once = dedup_first(df, ["query_id", "signature"], order)
    return with_rank(once, ["query_id"], order, "priority", limit)


def fallback_targets(candidates: DataFrame, limit: int = V.TARGET_LIMIT) -> DataFrame:
    """Targets taken from the candidates(query_id, rank, title, url, snippet) themselves."""
    usable = _targetable(candidates).where(~is_generic_result("title", "snippet", "url"))
    keyed = usable.withColumns({
        "canonical": canonicalize_url("url"),
        "signature": text_signature(F.concat_ws(" ", "title", "snippet")),
    })
    # repeated URLs go first: a signature counts only on the rows that survive
    once = dedup_first(keyed, ["query_id", "canonical"], ["rank"])
    return _finish_targets(once, ["rank"], limit).select(
        "query_id", "url", F.lit("fallback").alias("reason"), "priority")


def whitelist(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chosen URLs that are candidates, with the candidate's text.

    Of several candidates with one canonical URL the last one is looked up.
    """
    texts = top_n(
        candidates.withColumn("canonical", canonicalize_url("url")),
        ["query_id", "canonical"], [F.desc("rank")], 1,
    ).select("query_id", "canonical", "title", "snippet", F.col("url").alias("candidate_url"))
    return chosen.withColumn("canonical", canonicalize_url("url")).join(
        texts, ["query_id", "canonical"])


def chosen_targets(chosen: DataFrame, candidates: DataFrame, limit: int = V.TARGET_LIMIT
                   ) -> DataFrame:
    """Targets from a chosen list(query_id, pos, url, reason), whitelisted and deduplicated.

    Here a row that is generic still uses up its canonical URL, so the URL dedup comes first.
    """
    listed = top_n(chosen, ["query_id"], ["pos"], limit)
    known = _targetable(whitelist(listed, candidates))
    once = dedup_first(known, ["query_id", "canonical"], ["pos"])
    kept = once.where(~is_generic_result("title", "snippet", "candidate_url")).withColumn(
        "signature", text_signature(F.concat_ws(" ", "title", "snippet")))
    return _finish_targets(kept, ["pos"], limit).select("query_id", "url", "reason", "priority")


def select_targets(candidates: DataFrame, chosen: DataFrame | None = None,
                   limit: int = V.TARGET_LIMIT) -> DataFrame:
    """Chosen targets where a query has any, the fallback for the other queries."""
    fallback = fallback_targets(candidates, limit)
    if chosen is None:
        return fallback
    both = concat_ranked([chosen_targets(chosen, candidates, limit), fallback], "__list")
    # at most two short lists per query reach the window
    best = F.min("__list").over(Window.partitionBy("query_id"))
    return both.withColumn("__best", best).where(F.col("__list") == F.col("__best")).drop(
        "__list", "__best")


def merge_result_pages(pages: DataFrame, cap: int = V.CANDIDATE_LIMIT) -> DataFrame:
    """Results of the pages before the first blocked one, first of each URL, at most ``cap``.

    pages(query_id, page, blocked, results array<struct<title,url,snippet>>).
    """
    blocked_at = pages.groupBy("query_id").agg(
        F.min(F.when(F.col("blocked"), F.col("page"))).alias("__stop"))
    open_ = pages.join(blocked_at, "query_id").where(
        F.col("__stop").isNull() | (F.col("page") < F.col("__stop")))
    rows = open_.select(
        "query_id", "page", F.posexplode("results").alias("pos", "r")
    ).select("query_id", "page", "pos", "r.*").withColumn("canonical", canonicalize_url("url"))
    order = ["page", "pos"]
    once = dedup_first(rows, ["query_id", "canonical"], order)
    return with_rank(once, ["query_id"], order, "rank", cap)


def flag_repetitive(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with at least 6 long lines of which one signature occurs 4 times or more.

    Only texts with enough long lines are exploded; the line counts combine map-side, where
    all lines of a text lie.
    """
    long_lines = F.filter(
        F.transform(F.split(text, r"\r?\n"), lambda s: strip(s)), lambda s: F.octet_length(s) >= 20)
    lines = texts.select(key, long_lines.alias("__l"))
    enough = lines.where(F.size("__l") >= 6).select(key, F.explode("__l").alias("__s"))
    counts = enough.groupBy(key, text_signature("__s").alias("__sig")).agg(
        F.count(F.lit(1)).alias("__n"))
    worst = counts.groupBy(key).agg(F.max("__n").alias("max_repeats"))
    flagged = worst.where(F.col("max_repeats") >= 4)
    return lines.select(key, F.size("__l").alias("n_lines")).join(flagged, key, "left").select(
        key, "n_lines", F.col("max_repeats").isNotNull().alias("repetitive"))


def drop_near_duplicates(df: DataFrame, text: str, order: list[str], keys: list[str] | None = None
                         ) -> DataFrame:
    """First text per signature (and key)."""
    keyed = df.withColumn("signature", text_signature(text))
    return dedup_first(keyed, [*(keys or []), "signature"], order)


def screen_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, blocked pages with their kind)."""
    kinds = pages.withColumn("block_kind", block_kind("html"))
    return (kinds.where(F.col("block_kind").isNull()).drop("block_kind"),
            kinds.where(F.col("block_kind").isNotNull()))


def screen_counts(pages: DataFrame) -> DataFrame:
    """Pages per host and kind, 'usable' where nothing blocks."""
    return pages.select(
        url_host("url").alias("host"),
        F.coalesce(block_kind("html"), F.lit("usable")).alias("kind"),
    ).groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n_pages"))


# --- source plan ------------------------------------------------------------------------
def source_plan(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per planned source of a query.

    queries(query_id, query, query_type), results(query_id, source, success, error).  The second
    engine is planned only where the first failed, a missing result is a failed row, and a
    query whose sources all failed gets one more synthetic row.
    """
    planned = F.concat(
        F.array(*[F.lit(s) for s in V.SOURCES_FOR_ALL]),
        F.when(F.col("query_type") == "phone", F.array(*[F.lit(s) for s in V.SOURCES_FOR_PHONE]))
        .otherwise(F.array().cast("array<string>")),
        F.array(F.lit(V.ENGINES[0])),
    )
    first = dedup_first(
        results.select("query_id", "source", "success", "error"), ["query_id", "source"],
        ["success", "error"])

    def outcome(plan: DataFrame) -> DataFrame:
        return plan.join(first, ["query_id", "source"], "left").withColumns({
            "error": F.when(F.col("success").isNull(), F.lit("no result in time"))
            .otherwise(F.col("error")),
            "success": F.coalesce("success", F.lit(False)),
        })

    main = outcome(queries.select("query_id", F.explode(planned).alias("source")))
    failed_engine = main.where((F.col("source") == V.ENGINES[0]) & ~F.col("success"))
    second = outcome(failed_engine.select("query_id", F.lit(V.ENGINES[1]).alias("source")))
    both = main.unionByName(second)
    dead = both.groupBy("query_id").agg(F.bool_or("success").alias("__ok")).where(
        ~F.col("__ok")).select(
        "query_id", F.lit(V.ENGINES[1]).alias("source"), F.lit("all scrapers failed").alias("error"),
        F.lit(False).alias("success"))
    return both.withColumn("synthetic", F.lit(False)).unionByName(
        dead.withColumn("synthetic", F.lit(True)))


def successful_sources(results: DataFrame) -> DataFrame:
    return results.where("success")


def ingest_gate(investigations: DataFrame) -> DataFrame:
    return investigations.where(F.round("quality_score", 6) >= V.QUALITY_GATE)


def reuse_gate(investigations: DataFrame) -> DataFrame:
    return investigations.where(F.col("sources_success_ratio") >= V.REUSE_GATE)


def validate_reports(submissions: DataFrame) -> DataFrame:
    """Adds ``normalized`` and ``reject_reason`` (NULL for a valid submission)."""
    from ..functions.subjects import normalize_subject, valid_subject_type

    return submissions.withColumn("normalized", normalize_subject("value", "subject_type")).withColumn(
        "reject_reason",
        F.when(~valid_subject_type("subject_type"), "subject_type")
        .when(F.coalesce("normalized", F.lit("")) == "", "value")
        .when(F.coalesce(strip("description"), F.lit("")) == "", "description_missing")
        .when(F.octet_length("description") > V.DESCRIPTION_MAX_BYTES, "description_too_long"))


def attempts(results: DataFrame, key: list[str]) -> DataFrame:
    """Fetch attempts listed in the metadata of each result; none gives one empty row."""
    schema = (
        "array<struct<strategy:string,success:boolean,result_count:int,blocked:string,"
        "error:string,proxy_source:string,metadata:string>>")
    listed = F.from_json(F.get_json_object("metadata", "$.attempts"), schema)
    return results.select(*key, F.posexplode_outer(listed).alias("attempt", "a")).select(
        *key, "attempt", "a.*")


def attempt_failures(results: DataFrame, key: list[str]) -> DataFrame:
    """Message of a failed search: a challenge beats the last error."""
    rows = attempts(results, key)
    return rows.groupBy(*key).agg(
        F.count("attempt").alias("n_attempts"),
        count_if(F.coalesce(F.col("success"), F.lit(False))).alias("n_success"),
        F.when(
            F.max(F.coalesce(F.col("blocked") == "anomaly", F.lit(False))),
            F.lit("duckduckgo returned anomaly challenge"),
        ).otherwise(F.coalesce(
            F.nullif(strip(F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt")))),
                     F.lit("")),
            F.lit("duckduckgo returned empty results"))).alias("message"))
