"""Queries on stored tables: graph, risk, history, table jobs, logs, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import risk as FR
from ..functions import subjects as FJ
from ..operators import graph, history, kb, metrics, models, ranking, risk, triage
from ..session import checkpoint_dir, cut_lineage
from ..sources import change_log
from ..sources import driver_tables as D
from ..streaming import admission, reports, state
from . import submissions
from .registry import check


def r6(c) -> Column:
    return F.round(c, 6)


# --- SQL pieces ---------------------------------------------------------------------------
K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def q_phone(x: str) -> str:
    return f"('09' || lpad(CAST({x} AS VARCHAR), 8, '0'))"


def q_account(x: str) -> str:
    return f"('1903' || lpad(CAST({x} AS VARCHAR), 8, '0'))"


def q_pid(x: str) -> str:
    return f"sha256('phone|' || {q_phone(x)})"


def q_part(x: str) -> str:
    return f"('https://shop.example.com/p/' || CAST({x} AS VARCHAR))"


def q_level(score: str) -> str:
    return (f"CASE WHEN round({score}, 6) >= 0.8 THEN 'critical' WHEN round({score}, 6) >= 0.6 "
            f"THEN 'high' WHEN round({score}, 6) >= 0.3 THEN 'medium' WHEN round({score}, 6) > 0 "
            "THEN 'low' ELSE 'unknown' END")


def q_balance(x: str) -> str:
    return f"round(least(greatest({x} / 10000, 0.0), 1.0), 6)"


Q_CUSTOMERS = f"""customers AS (
  SELECT {q_pid('c_custkey')} AS id, {q_phone('c_custkey')} AS value, 'phone' AS subject_type,
         {q_balance('c_acctbal')} AS risk_score, {q_level(q_balance('c_acctbal'))} AS risk_level,
         TIMESTAMP '2023-12-01' AS first_seen_at,
         TIMESTAMP '2023-12-01' + to_minutes(c_custkey) AS last_seen_at
  FROM customer)"""
Q_PARTS = f"""parts AS (
  SELECT sha256('url|' || {q_part('p_partkey')}) AS id, {q_part('p_partkey')} AS value,
         'url' AS subject_type, {q_balance('p_retailprice')} AS risk_score,
         {q_level(q_balance('p_retailprice'))} AS risk_level
  FROM part)"""
Q_LINKS = f"""links AS (
  SELECT least(c, p) AS a, greatest(c, p) AS b, CAST(n AS DOUBLE) AS strength FROM (
    SELECT {q_pid('o_custkey')} AS c, sha256('url|' || {q_part('l_partkey')}) AS p, count(*) AS n
    FROM (SELECT DISTINCT l_orderkey, o_custkey, l_partkey
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_custkey, l_partkey))"""
Q_INV = f"""inv AS (
  SELECT 'inv' || event_id AS id, {q_pid('user_id')} AS subject_id, level AS risk_level,
         CASE level WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5
              WHEN 'low' THEN 0.2 ELSE 0.0 END::DOUBLE AS score,
         (event_id % 10) / 10.0::DOUBLE AS ratio, least(value / 200, 1.0)::DOUBLE AS confidence,
         least(1.0, greatest(0.0, (event_id % 10) / 10.0::DOUBLE * 0.4::DOUBLE
           + least(value / 200, 1.0)::DOUBLE * 0.3::DOUBLE
           + least((k % 7 + k % 4) / 10.0, 1.0)::DOUBLE * 0.2::DOUBLE + 0.1::DOUBLE)) AS quality,
         ts AS created_at
  FROM (SELECT *, {K} AS k, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 60 THEN 'high'
          WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'unknown' END AS level
        FROM events WHERE event_type = 'purchase'))"""
Q_REP = f"""rep AS (
  SELECT 'rep' || event_id AS id, {q_pid(K)} AS subject_id,
         sha256(CAST(user_id AS VARCHAR)) AS reporter, event_type AS category,
         event_type || ' ' || CAST(trunc(value) AS INTEGER) AS description,
         CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
         ts AS created_at
  FROM events WHERE event_type IN ('error', 'signup'))"""
Q_EV = f"""ev AS (
  SELECT 'ev' || event_id AS id, {q_pid('user_id')} AS subject_id, user_id, event_type AS source,
         {K} AS k, 'https://src.example.com/' || {K} AS source_url, {K} % 15 AS report_count,
         CASE WHEN {K} % 2 = 0 THEN 'web' ELSE 'social' END AS fake_type, ts AS created_at
  FROM events)"""
Q_RISK = f"""scored AS (
  SELECT c.id, coalesce(i.s, 0.0) AS inv_score, coalesce(r.n, 0) AS approved FROM customers c
  LEFT JOIN (SELECT subject_id, coalesce(sum(score * quality) / nullif(sum(quality), 0), 0) AS s
             FROM inv GROUP BY 1) i ON i.subject_id = c.id
  LEFT JOIN (SELECT subject_id, count(*) FILTER (WHERE status = 'approved') AS n
             FROM rep GROUP BY 1) r ON r.subject_id = c.id),
recalc AS (
  SELECT id, approved, round(least(1.0, greatest(0.0, CASE WHEN inv_score <= 0
           THEN least(approved * 0.12::DOUBLE, 0.72)
           ELSE greatest(inv_score, inv_score * 0.8::DOUBLE
                         + least(approved * 0.12::DOUBLE, 0.72) * 0.2::DOUBLE) END)), 6) AS score
  FROM scored)"""
Q_FLOOR = """CASE WHEN {0} >= 10 THEN 0.9 WHEN {0} >= 5 THEN 0.75 WHEN {0} >= 2 THEN 0.55
  WHEN {0} >= 1 THEN 0.35 ELSE 0.2 END::DOUBLE"""


# --- graph --------------------------------------------------------------------------------
def _links(spark, d) -> DataFrame:
    # a stored table in production: computed once, then read by every hop
    return cut_lineage(graph.co_mention_links(D.order_mentions(spark, d), D.parts(spark, d)))


def _asked(spark, d) -> DataFrame:
    """The subjects asked about: customers whose key is divisible by 100."""
    asked = D.table(spark, d, "customer").where(F.col("c_custkey") % 100 == 0)
    return asked.select(D.phone_id("c_custkey").alias("root_id"))


Q_NET = f"""WITH RECURSIVE {Q_CUSTOMERS}, {Q_PARTS}, {Q_LINKS},
subjects AS (SELECT id, value, subject_type, risk_score, risk_level FROM customers
             UNION ALL SELECT id, value, subject_type, risk_score, risk_level FROM parts),
edges AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
net(root_id, id, depth) AS (
  SELECT id, id, 0 FROM (SELECT {q_pid('c_custkey')} AS id FROM customer WHERE c_custkey % 100 = 0)
  UNION SELECT n.root_id, e.dst, n.depth + 1 FROM net n JOIN edges e ON e.src = n.id
        WHERE n.depth < 3),
nodes AS (SELECT root_id, id, min(depth) AS depth FROM net GROUP BY 1, 2)"""


@check("co_mention_links", f"""WITH {Q_LINKS}
SELECT a AS subject_a_id, b AS subject_b_id, 'co_mentioned' AS link_type, strength FROM links""")
def co_mention_links(spark, d):
    return graph.co_mention_links(D.order_mentions(spark, d), D.parts(spark, d))


@check("network_nodes", Q_NET + """
SELECT root_id, id, value, subject_type, risk_level, risk_score, depth
FROM nodes JOIN subjects USING (id)""")
def network_nodes(spark, d):
    return graph.network_nodes(
        D.subjects(spark, d), _links(spark, d), _asked(spark, d), 3)


@check("network_edges", Q_NET + """
SELECT DISTINCT n.root_id, s.a AS subject_a_id, s.b AS subject_b_id, 'co_mentioned' AS link_type,
       s.strength
FROM links s JOIN nodes n ON n.id = s.a JOIN nodes m ON m.id = s.b AND m.root_id = n.root_id""")
def network_edges(spark, d):
    links = _links(spark, d)
    return graph.network_edges(links, graph.reached(links, _asked(spark, d), 3))


@check("network_neighbours_only", Q_NET + """
SELECT root_id, id, depth FROM nodes WHERE depth > 0""")
def network_neighbours_only(spark, d):
    return graph.without_root(
        graph.reached(_links(spark, d), _asked(spark, d), 3))


@check("induced_edges", f"""WITH {Q_CUSTOMERS}, {Q_PARTS}, {Q_LINKS},
nodes AS (SELECT id FROM customers WHERE risk_level = 'critical'
          UNION ALL SELECT id FROM parts)
SELECT a AS subject_a_id, b AS subject_b_id, 'co_mentioned' AS link_type, strength FROM links
WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)""")
def induced_edges(spark, d):
    nodes = D.customers(spark, d).where(F.col("risk_level") == "critical").select("id").unionByName(
        D.parts(spark, d).select("id"))
    return graph.induced_edges(_links(spark, d), nodes)


@check("neighbours", f"""WITH {Q_CUSTOMERS}, {Q_PARTS}, {Q_LINKS},
subjects AS (SELECT id, value, risk_score, risk_level, last_seen_at FROM customers
             UNION ALL SELECT id, value, risk_score, risk_level,
               TIMESTAMP '2023-12-01' + to_minutes(p_partkey) FROM parts JOIN part ON {q_part('p_partkey')} = value),
edges AS (SELECT a AS src, b AS dst, strength FROM links UNION ALL SELECT b, a, strength FROM links)
SELECT src AS subject_id, dst AS other_id, value, risk_score, risk_level, strength FROM (
  SELECT e.*, s.*, row_number() OVER (PARTITION BY src
           ORDER BY strength DESC, last_seen_at DESC, dst) AS rn
  FROM edges e JOIN subjects s ON s.id = e.dst) WHERE rn <= 10""")
def neighbours(spark, d):
    return graph.neighbours(D.subjects(spark, d), _links(spark, d)).select(
        "subject_id", "other_id", "value", "risk_score", "risk_level", "strength")


@check("upsert_links", f"""WITH {Q_EV}, pairs AS (
  SELECT least(subject_id, o) AS a, greatest(subject_id, o) AS b, id, source FROM (
    SELECT subject_id, {q_pid('k')} AS o, id, source FROM ev WHERE k <> user_id)),
early AS (SELECT a, b, count(DISTINCT id) AS n FROM pairs WHERE source <> 'click' GROUP BY 1, 2),
late AS (SELECT a, b, count(DISTINCT id) AS n FROM pairs WHERE source IN ('click', 'view')
           AND id NOT IN (SELECT id FROM pairs WHERE source <> 'click') GROUP BY 1, 2)
SELECT coalesce(e.a, l.a) AS subject_a_id, coalesce(e.b, l.b) AS subject_b_id,
       CAST(coalesce(e.n, 0) + coalesce(l.n, 0) AS DOUBLE) AS strength
FROM early e FULL JOIN late l ON e.a = l.a AND e.b = l.b""")
def upsert_links(spark, d):
    """Two batches that overlap: all but clicks, then clicks and (again) views."""
    ev = D.evidence(spark, d)
    now = F.lit("2024-02-01").cast("timestamp")

    def pairs(kinds):
        rows = graph.mention_rows(graph.evidence_with_mentions(ev.where(F.col("source").isin(kinds))))
        rows = rows.withColumn("other_id", FJ.subject_id("subject_type", "value"))
        return graph.ordered_pair(rows).select(
            "subject_a_id", "subject_b_id", F.lit("co_mentioned").alias("link_type"), "evidence_id")

    empty = spark.createDataFrame([], S.LINKS), spark.createDataFrame([], S.LINK_EVIDENCE)
    first = graph.upsert_links(*empty, pairs(["view", "error", "signup", "purchase"]), now)
    links, known = map(cut_lineage, first)
    links, _ = graph.upsert_links(links, known, pairs(["click", "view"]), now)
    return links.select("subject_a_id", "subject_b_id", "strength")


@check("co_mention_increments", f"""SELECT least(x, y) AS subject_a_id, greatest(x, y) AS subject_b_id,
  'co_mentioned' AS link_type, CAST(count(*) AS DOUBLE) AS strength
FROM (SELECT {q_pid('user_id')} AS x, c.id AS y FROM (SELECT user_id, {K} AS k FROM events) e
      JOIN (SELECT {q_pid('c_custkey')} AS id, c_custkey FROM customer) c ON c.id = {q_pid('e.k')} WHERE e.k <> e.user_id)
WHERE x <> y GROUP BY 1, 2""")
def co_mention_increments(spark, d):
    """Evidence and subjects that come in two halves, the second one through the index of the first."""
    ev, subjects = D.evidence(spark, d), D.customers(spark, d)
    first, known = F.pmod(F.xxhash64("id"), F.lit(2)) == 0, F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    now = F.lit("2024-02-01").cast("timestamp")
    links, stored = spark.createDataFrame([], S.LINKS), spark.createDataFrame([], S.LINK_EVIDENCE)
    index = graph.mention_index(ev.limit(0))
    for new_rows, new_subjects, all_subjects in (
            (ev.where(first), subjects.where(known), subjects.where(known)), (ev.where(~first), subjects.where(~known), subjects)):
        added = cut_lineage(graph.mention_index(new_rows))
        index = graph.replace_indexed(index, new_rows.select(F.col("id").alias("evidence_id")), added)
        pairs = graph.new_co_mention_pairs(index, added, all_subjects, new_subjects)
        links, stored = map(cut_lineage, graph.upsert_links(links, stored, pairs, now))
    return links.select("subject_a_id", "subject_b_id", "link_type", "strength")


# --- risk ---------------------------------------------------------------------------------
@check("weighted_risk", f"""WITH {Q_INV}
SELECT subject_id, round(coalesce(sum(score * quality) / nullif(sum(quality), 0), 0), 6) AS
  investigation_score FROM inv GROUP BY 1""")
def weighted_risk(spark, d):
    return risk.weighted_risk(D.investigations(spark, d)).withColumn(
        "investigation_score", r6("investigation_score"))


@check("approved_counts", f"""WITH {Q_REP}
SELECT subject_id, count(*) FILTER (WHERE status = 'approved') AS approved FROM rep GROUP BY 1""")
def approved_counts(spark, d):
    return risk.approved_counts(D.user_reports(spark, d))


@check("recalculate_risk", f"""WITH {Q_CUSTOMERS}, {Q_INV}, {Q_REP}, {Q_RISK}
SELECT id, score AS risk_score, {q_level('score')} AS risk_level,
       CAST(approved AS INTEGER) AS report_count FROM recalc""")
def recalculate_risk(spark, d):
    return risk.recalculate_risk(
        D.customers(spark, d), D.investigations(spark, d), D.user_reports(spark, d)
    ).select("id", "risk_score", "risk_level", "report_count")


@check("crawl_floors", f"""WITH {Q_EV}
SELECT subject_id, {Q_FLOOR.format('max(report_count)')} AS floor FROM ev
WHERE source = 'view' GROUP BY 1""")
def crawl_floors(spark, d):
    return risk.crawl_floors(D.evidence(spark, d), "view")


Q_FLOORED = f"""floors AS (SELECT subject_id, {Q_FLOOR.format('max(report_count)')} AS f FROM ev
  WHERE source = 'view' GROUP BY 1)"""


@check("apply_floors", f"""WITH {Q_CUSTOMERS}, {Q_EV}, {Q_FLOORED}
SELECT id, greatest(risk_score, f) AS risk_score,
       CASE WHEN risk_score < f THEN {q_level('f')} ELSE risk_level END AS risk_level
FROM customers LEFT JOIN floors ON subject_id = id""")
def apply_floors(spark, d):
    return risk.apply_floors(
        D.customers(spark, d), risk.crawl_floors(D.evidence(spark, d), "view")
    ).select("id", "risk_score", "risk_level")


@check("refresh_linked", f"""WITH {Q_CUSTOMERS}, {Q_EV}, {Q_INV}, {Q_REP}, {Q_RISK}, {Q_FLOORED},
touched AS (SELECT subject_id AS id FROM ev WHERE source = 'view' AND k <> user_id
            UNION SELECT c.id FROM ev JOIN customers c ON c.id = {q_pid('k')}
                  WHERE source = 'view' AND k <> user_id),
step AS (SELECT c.id, CASE WHEN t.id IS NULL THEN c.risk_score ELSE r.score END AS s,
                CASE WHEN t.id IS NULL THEN c.risk_level ELSE {q_level('r.score')} END AS l,
                CASE WHEN t.id IS NULL THEN NULL ELSE f END AS f
         FROM customers c JOIN recalc r ON r.id = c.id LEFT JOIN touched t ON t.id = c.id
         LEFT JOIN floors ON subject_id = c.id)
SELECT id, greatest(s, f) AS risk_score, CASE WHEN s < f THEN {q_level('f')} ELSE l END AS
  risk_level FROM step""")
def refresh_linked(spark, d):
    c = D.customers(spark, d)
    ev = D.evidence(spark, d).where(F.col("source") == "view").withColumn(
        "source", F.lit("checkscam_crawl"))
    pairs = graph.co_mention_pairs(ev, c)
    touched = risk.touched_ids(graph.evidence_with_mentions(ev), pairs)
    return risk.refresh_linked(
        c, D.investigations(spark, d), D.user_reports(spark, d), ev, touched
    ).select("id", "risk_score", "risk_level")


@check("risk_scales", f"""SELECT event_id, {q_level('value / 500')} AS level,
  {Q_FLOOR.format(f'({K} % 13)')} AS floor,
  round(least(1.0, greatest(0.0, least(value / 100, 1.0) * 0.4 + least(value / 300, 1.0) * 0.3
    + least(({K} % 9 + {K} % 5) / 10.0, 1.0) * 0.2 + 0.1)), 6) AS quality FROM events""")
def risk_scales(spark, d):
    return D.events(spark, d).select(
        "event_id", FR.score_to_level(F.col("value") / 500).alias("level"),
        FR.crawl_floor(F.col("k") % 13).alias("floor"),
        r6(FR.quality_score(F.col("value") / 100, F.col("value") / 300, F.col("k") % 9,
                            F.col("k") % 5)).alias("quality"))


@check("crawl_stats", f"""SELECT CAST(count(*) AS BIGINT) AS posts_discovered,
  CAST(sum(CASE WHEN {K} % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS posts_processed,
  CAST(sum(CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS posts_skipped,
  CAST(sum(CASE WHEN {K} % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS post_errors,
  CAST(sum({K}) AS BIGINT) AS subjects_upserted, CAST(sum({K} % 3) AS BIGINT) AS evidence_inserted,
  CAST(sum({K} % 2) AS BIGINT) AS evidence_updated, CAST(sum({K} % 6) AS BIGINT) AS media_attached,
  CAST(sum(CASE WHEN {K} % 6 > 2 THEN {K} % 6 ELSE 0 END) AS BIGINT) AS media_reused,
  CAST(sum(CASE WHEN {K} % 6 > 2 THEN 0 ELSE {K} % 6 END) AS BIGINT) AS media_downloaded,
  CAST(sum({K} % 7) AS BIGINT) AS links_created, CAST(sum({K} % 8) AS BIGINT) AS risk_updated FROM events""")
def crawl_stats(spark, d):
    k = F.col("k")
    skipped, media = k % 4 == 0, k % 6
    return metrics.crawl_stats(D.events(spark, d).select(
        F.lit(1).alias("posts_discovered"), F.when(skipped, 0).otherwise(1).alias("posts_processed"),
        F.when(skipped, 1).otherwise(0).alias("posts_skipped"), F.when(k % 11 == 0, 1).alias("post_errors"),
        k.alias("subjects_upserted"), (k % 3).alias("evidence_inserted"), (k % 2).alias("evidence_updated"),
        media.alias("media_attached"), F.when(media > 2, media).alias("media_reused"),
        F.when(media <= 2, media).alias("media_downloaded"), (k % 7).alias("links_created"),
        (k % 8).alias("risk_updated")))


# --- history ------------------------------------------------------------------------------
@check("overview", f"""WITH {Q_CUSTOMERS}, {Q_INV}
SELECT c.id, any_value(value) AS value, any_value(c.risk_level) AS risk_level,
       max(created_at) AS last_investigation_at
FROM customers c LEFT JOIN inv ON subject_id = c.id GROUP BY 1""")
def overview(spark, d):
    return history.overview(D.customers(spark, d), D.investigations(spark, d)).select(
        "id", "value", "risk_level", "last_investigation_at")


@check("moderation_list", f"""WITH {Q_CUSTOMERS}, {Q_REP}
SELECT r.id, subject_id, value AS subject_value, risk_level AS subject_risk_level, description,
       status, created_at
FROM rep r JOIN customers c ON c.id = subject_id WHERE status = 'pending'""")
def moderation_list(spark, d):
    return history.reports_with_subject(
        D.user_reports(spark, d), D.customers(spark, d), "pending"
    ).select("id", "subject_id", "subject_value", "subject_risk_level", "description", "status",
             "created_at")


@check("moderation_page", f"""WITH {Q_CUSTOMERS}, {Q_REP}
SELECT r.id, value AS subject_value, created_at FROM rep r JOIN customers c ON c.id = subject_id
WHERE status = 'pending' ORDER BY created_at DESC, r.id LIMIT 50 OFFSET 25""")
def moderation_page(spark, d):
    rows = moderation_list(spark, d).select("id", "subject_value", "created_at")
    return ranking.page(rows, [F.desc("created_at"), "id"], 50, 25)


@check("recent_investigations", f"""WITH {Q_INV}
SELECT id, subject_id, risk_level, created_at FROM (SELECT *, row_number() OVER (
  PARTITION BY subject_id ORDER BY created_at DESC, id) AS rn FROM inv) WHERE rn <= 10""")
def recent_investigations(spark, d):
    return history.recent_investigations(D.investigations(spark, d)).select(
        "id", "subject_id", "risk_level", "created_at")


@check("approved_reports", f"""WITH {Q_REP}
SELECT id, subject_id, description, created_at FROM (SELECT *, row_number() OVER (
  PARTITION BY subject_id ORDER BY created_at DESC, id) AS rn FROM rep WHERE status = 'approved')
WHERE rn <= 10""")
def approved_reports(spark, d):
    return history.approved_reports(D.user_reports(spark, d)).select(
        "id", "subject_id", "description", "created_at")


@check("distinct_signals", f"""WITH {Q_EV}, s AS (
  SELECT DISTINCT subject_id, 'signal:' || (k % 20) AS signal FROM ev
  UNION SELECT DISTINCT subject_id, 'type:' || source FROM ev)
SELECT subject_id, signal FROM (SELECT *, row_number() OVER (
  PARTITION BY subject_id ORDER BY signal) AS rn FROM s) WHERE rn <= 15""")
def distinct_signals(spark, d):
    return history.distinct_signals(D.evidence(spark, d), 15)


@check("history_snapshot", f"""WITH {Q_CUSTOMERS}, {Q_INV}, {Q_REP}, {Q_LINKS},
lvl AS (SELECT subject_id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
          ORDER BY created_at DESC, id DESC) AS rn FROM inv) WHERE rn = 1),
app AS (SELECT subject_id, count(*) AS n FROM rep WHERE status = 'approved' GROUP BY 1),
ends AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links)
         GROUP BY 1)
SELECT c.id, coalesce(lvl.risk_level, c.risk_level) AS last_risk_level,
  CAST(least(coalesce(app.n, 0), 10) AS INTEGER) AS approved_reports,
  CAST(least(coalesce(ends.n, 0), 10) AS INTEGER) AS linked_subjects_count,
  coalesce(app.n, 0) AS approved_reports_total, coalesce(ends.n, 0) AS linked_subjects_total,
  strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S.000000+00:00') AS last_seen
FROM customers c LEFT JOIN lvl ON lvl.subject_id = c.id LEFT JOIN app ON app.subject_id = c.id
LEFT JOIN ends ON ends.id = c.id""")
def history_snapshot(spark, d):
    return history.history_snapshot(
        D.customers(spark, d), D.investigations(spark, d), D.user_reports(spark, d),
        _links(spark, d),
    ).drop("investigation_count", "first_seen")


def _payloads(spark, d) -> DataFrame:
    return history.history_payload(
        D.subjects(spark, d), D.investigations(spark, d), D.user_reports(spark, d),
        _links(spark, d), D.evidence(spark, d))


Q_PAYLOAD = f"""{Q_CUSTOMERS}, {Q_PARTS}, {Q_LINKS}, {Q_REP}, {Q_EV},
subjects AS (SELECT id, value, subject_type, risk_level, last_seen_at FROM customers
  UNION ALL SELECT id, value, subject_type, risk_level, TIMESTAMP '2023-12-01' + to_minutes(p_partkey)
  FROM parts JOIN part ON {q_part('p_partkey')} = value),
edges AS (SELECT a AS src, b AS dst, strength FROM links UNION ALL SELECT b, a, strength FROM links),
near AS (SELECT src AS id, string_agg(value || '/' || risk_level || '/' || CAST(strength AS INTEGER), ' ' ORDER BY rn) AS linked
  FROM (SELECT src, value, risk_level, strength, row_number() OVER (PARTITION BY src
          ORDER BY strength DESC, last_seen_at DESC, dst) AS rn FROM edges JOIN subjects ON id = dst)
  WHERE rn <= 8 GROUP BY src),
told AS (SELECT subject_id AS id, string_agg(description, ' ' ORDER BY rn) AS reports FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, id) AS rn FROM rep
  WHERE status = 'approved') WHERE rn <= 5 GROUP BY 1),
sig AS (SELECT DISTINCT subject_id, 'signal:' || (k % 20) AS signal FROM ev
  UNION SELECT DISTINCT subject_id, 'type:' || source FROM ev),
signs AS (SELECT subject_id AS id, string_agg(signal, ' ' ORDER BY signal) AS signals FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY signal) AS rn FROM sig) WHERE rn <= 12 GROUP BY 1),
payloads AS (SELECT id, coalesce(linked, '') AS linked, coalesce(reports, '') AS reports, coalesce(signals, '') AS signals
  FROM subjects LEFT JOIN near USING (id) LEFT JOIN told USING (id) LEFT JOIN signs USING (id))"""
PAYLOAD = ("summary struct<investigation_count: int>, approved_reports array<struct<description: string>>, "
           "linked_subjects array<struct<value: string, risk_level: string, strength: double>>, risk_signals array<string>")


def _unpacked(payload: str) -> list[Column]:
    """The parts of a payload text as plain strings."""
    p = F.from_json(payload, PAYLOAD)
    linked = F.transform(p["linked_subjects"], lambda x: F.concat_ws("/", x["value"], x["risk_level"], x["strength"].cast("int")))
    return [F.array_join(linked, " ").alias("linked"),
            F.array_join(p["approved_reports"]["description"], " ").alias("reports"),
            F.array_join(p["risk_signals"], " ").alias("signals")]


@check("history_payload", f"WITH {Q_PAYLOAD} SELECT * FROM payloads")
def history_payload(spark, d):
    return _payloads(spark, d).select("id", *_unpacked("payload"))


@check("lookup_subjects", f"""WITH {Q_CUSTOMERS}
SELECT event_id AS query_id, c.id, c.risk_level FROM events
JOIN customers c ON c.value = {q_phone('user_id')}""")
def lookup_subjects(spark, d):
    raw = F.concat(F.lit(" 09-"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    q = D.events(spark, d).select(
        F.col("event_id").alias("query_id"), raw.alias("query"), F.lit("phone").alias("query_type"))
    return history.lookup_subjects(D.customers(spark, d), q).select("query_id", "id", "risk_level")


@check("reports_last_24h", f"""WITH {Q_REP}
SELECT reporter AS reporter_ip_hash,
  count(*) FILTER (WHERE created_at > TIMESTAMP '2024-01-19' AND created_at <= TIMESTAMP '2024-01-20')
    AS n_recent,
  count(*) FILTER (WHERE created_at > TIMESTAMP '2024-01-19' AND created_at <= TIMESTAMP '2024-01-20')
    < 5 AS allowed FROM rep GROUP BY 1""")
def reports_last_24h(spark, d):
    return history.reports_last_24h(D.user_reports(spark, d), D.AS_OF)


@check("recent_duplicates", f"""WITH {Q_REP}, recent AS (
  SELECT DISTINCT reporter, subject_id FROM rep WHERE created_at > TIMESTAMP '2024-01-19')
SELECT r.id FROM rep r JOIN recent USING (reporter, subject_id)""")
def recent_duplicates(spark, d):
    rep = D.user_reports(spark, d)
    return history.recent_duplicates(
        rep, rep.select("id", "reporter_ip_hash", "subject_id"), D.AS_OF).select("id")


# --- table jobs ---------------------------------------------------------------------------
@check("upsert_subjects", f"""WITH {Q_CUSTOMERS}, seen AS (
  SELECT {q_phone(f'{K} * 20')} AS value, min(ts) AS f, max(ts) AS l FROM events
  WHERE event_type <> 'view' GROUP BY 1)
SELECT coalesce(c.id, sha256('phone|' || s.value)) AS id, coalesce(c.value, s.value) AS value,
  coalesce(c.risk_score, 0.0)::DOUBLE AS risk_score, coalesce(c.risk_level, 'unknown') AS risk_level,
  coalesce(c.first_seen_at, s.f) AS first_seen_at,
  greatest(coalesce(c.last_seen_at, s.l), coalesce(s.l, c.last_seen_at)) AS last_seen_at
FROM customers c FULL JOIN seen s ON s.value = c.value""")
def upsert_subjects(spark, d):
    e = D.events(spark, d)
    raw = F.when(F.col("event_type") == "view", F.lit("no digits")).otherwise(
        F.concat(F.lit("09 "), F.lpad((F.col("k") * 20).cast("string"), 8, "0")))
    merged, _ = kb.upsert_subjects(D.customers(spark, d), e.select(
        raw.alias("value"), F.lit("phone").alias("subject_type"), F.col("ts").alias("seen_at")))
    return merged.select("id", "value", "risk_score", "risk_level", "first_seen_at", "last_seen_at")


@check("append_investigations", f"""WITH {Q_CUSTOMERS}, {Q_INV}
SELECT c.id, CAST(count(i.id) AS INTEGER) AS investigation_count,
  greatest(any_value(c.last_seen_at), coalesce(max(i.created_at), any_value(c.last_seen_at))) AS
    last_seen_at
FROM customers c LEFT JOIN inv i ON i.subject_id = c.id AND i.ratio >= 0.5 GROUP BY 1""")
def append_investigations(spark, d):
    inv = D.investigations(spark, d)
    new = inv.where(F.col("sources_success_ratio") >= 0.5)
    # every row comes twice
    subjects, _ = kb.append_investigations(
        D.customers(spark, d), inv.where(F.lit(False)), new.unionByName(new))
    return subjects.select("id", "investigation_count", "last_seen_at")


@check("upsert_evidence", f"""WITH {Q_EV}, old AS (SELECT * FROM ev WHERE created_at < '2024-01-15'),
new AS (SELECT subject_id, source, source_url, k, created_at, id, row_number() OVER (
          PARTITION BY subject_id, source, source_url ORDER BY created_at DESC, id DESC) AS rn
        FROM ev WHERE created_at >= '2024-01-15'),
first AS (SELECT subject_id, source, source_url, min_by(id, (created_at, id)) AS id FROM old
          GROUP BY 1, 2, 3)
SELECT f.id IS NOT NULL AS updated,
  coalesce(f.id, sha256('evidence|' || n.subject_id || '|' || n.source || '|' || n.source_url)) AS id,
  n.subject_id, n.source_url, n.id AS new_id
FROM new n LEFT JOIN first f USING (subject_id, source, source_url) WHERE rn = 1""")
def upsert_evidence(spark, d):
    ev = kb.with_json_keys(D.evidence(spark, d))
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    changes = ev.where(F.col("created_at") >= split).withColumnsRenamed(
        {"created_at": "at", "id": "new_id"})
    _, stored = kb.upsert_evidence(
        ev.where(F.col("created_at") < split), changes, ["subject_id", "source", "source_url"],
        ["at", "new_id"], F.lit("2024-02-01").cast("timestamp_ntz"))
    return stored.select("updated", "id", "subject_id", "source_url", "new_id")


@check("oldest_evidence", f"""WITH {Q_EV}
SELECT subject_id, source, source_url, fake_type, min_by(id, (created_at, id)) AS id,
       min(created_at) AS created_at FROM ev GROUP BY 1, 2, 3, 4""")
def oldest_evidence(spark, d):
    return kb.oldest_evidence(
        kb.with_json_keys(D.evidence(spark, d)), ["subject_id", "source", "source_url", "fake_type"])


@check("evidence_fields", f"""WITH {Q_EV}
SELECT id, source_url, fake_type, report_count FROM ev""")
def evidence_fields(spark, d):
    return kb.with_json_keys(D.evidence(spark, d)).select(
        "id", "source_url", "fake_type", "report_count")


@check("source_url_counts", f"""WITH {Q_EV}
SELECT source, source_url, count(*) AS n_evidence,
  CAST(sum(CASE WHEN source IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS n_media
FROM ev GROUP BY 1, 2""")
def source_url_counts(spark, d):
    return kb.source_url_counts(D.evidence(spark, d), D.media(spark, d))


Q_MEDIA = f"""media AS (SELECT 'm' || event_id AS id, 'ev' || event_id AS entity_id,
  'https://img.example.com/' || {K} || '.jpg' AS original_url, 'media/' || event_id AS file_path,
  CAST(trunc(value * 100) AS BIGINT) AS file_size_bytes, ts AS created_at
  FROM events WHERE event_type IN ('view', 'click'))"""


@check("oldest_media", f"""WITH {Q_MEDIA}
SELECT original_url, id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY original_url
  ORDER BY created_at, id) AS rn FROM media) WHERE rn = 1""")
def oldest_media(spark, d):
    return kb.oldest_media(D.media(spark, d)).select("original_url", "id", "file_path")


@check("media_with_evidence", f"""WITH {Q_MEDIA}, {Q_EV}
SELECT m.id AS media_id, entity_id, source, original_url FROM media m JOIN ev ON ev.id = entity_id""")
def media_with_evidence(spark, d):
    return kb.media_with_evidence(D.media(spark, d), D.evidence(spark, d)).select(
        "media_id", "entity_id", "source", "original_url")


@check("media_of", f"""WITH {Q_MEDIA} SELECT m.id, entity_id FROM media m
JOIN events ON entity_id = 'ev' || event_id WHERE event_type = 'view'""")
def media_of(spark, d):
    ids = D.evidence(spark, d).where(F.col("source") == "view").select("id")
    return kb.media_of(D.media(spark, d), "evidence", ids).select("id", "entity_id")


@check("attach_media", f"""WITH {Q_MEDIA}, clicks AS (
  SELECT m.* FROM media m JOIN events ON entity_id = 'ev' || event_id WHERE event_type = 'click'),
wanted AS (SELECT DISTINCT 'ev' || event_id AS entity_id,
             'https://img.example.com/' || ({K} + 20) || '.jpg' AS original_url FROM events),
open AS (SELECT w.* FROM wanted w LEFT JOIN clicks c USING (entity_id, original_url)
         WHERE c.id IS NULL)
SELECT entity_id, original_url, CASE
  WHEN original_url IN (SELECT original_url FROM clicks) THEN 'reused'
  WHEN CAST(regexp_extract(original_url, '([0-9]+).jpg', 1) AS INTEGER) % 2 = 0 THEN 'downloaded'
  ELSE 'failed' END AS outcome FROM open""")
def attach_media(spark, d):
    e = D.events(spark, d)
    m = D.media(spark, d)
    clicks = m.join(D.evidence(spark, d).where(F.col("source") == "click").select(
        F.col("id").alias("entity_id")), "entity_id", "left_semi")
    url = D.image_url("n")
    wanted = e.withColumn("n", F.col("k") + 20).select(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("entity_id"),
        url.alias("original_url"))
    files = e.withColumn("n", F.col("k") + 20).where(F.col("n") % 2 == 0).select(
        url.alias("original_url"), url.alias("file_path"), F.lit("image/jpeg").alias("content_type"),
        F.lit(10).cast("bigint").alias("file_size_bytes"))
    return kb.attach_media(clicks, wanted, files, F.lit("2024-02-01").cast("timestamp_ntz"))[1]


@check("delete_media", f"""WITH {Q_MEDIA}
SELECT id FROM media WHERE file_size_bytes >= 1000""")
def delete_media(spark, d):
    m = D.media(spark, d)
    return kb.delete_media(m, m.where(F.col("file_size_bytes") < 1000))[0].select("id")


Q_FAIL = f"""log AS (SELECT 'https://site.example.com/' || {K} AS url, ts, event_id,
  event_type IN ('view', 'click') AS ok, event_type AS phase, event_type || ':' || user_id AS message
  FROM events),
eps AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY ts
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM log),
state AS (SELECT url, CAST(episode AS BIGINT) AS episode, max_by(phase, ts) AS error_phase,
    max_by(message, ts) AS error_message, CAST(count(*) - 1 AS INTEGER) AS retry_count,
    min(ts) AS created_at, max(ts) AS last_ts FROM eps WHERE NOT ok GROUP BY 1, 2),
wins AS (SELECT url, count(*) AS n, max(ts) AS last_ok FROM log WHERE ok GROUP BY 1),
failures AS (SELECT s.url, s.episode, error_phase, error_message, retry_count,
    coalesce(n > s.episode, false) AS resolved, created_at,
    CASE WHEN coalesce(n > s.episode, false) THEN last_ok ELSE last_ts END AS updated_at
  FROM state s LEFT JOIN wins USING (url))"""


@check("failure_state", f"""WITH {Q_FAIL} SELECT * FROM failures""")
def failure_state(spark, d):
    return kb.failure_state(D.failure_log(spark, d))


@check("retry_queue", f"""WITH {Q_FAIL}
SELECT url, retry_count, created_at FROM failures WHERE NOT resolved""")
def retry_queue(spark, d):
    return kb.retry_queue(kb.failure_state(D.failure_log(spark, d))).select(
        "url", "retry_count", "created_at")


Q_DEC = """dec AS (SELECT 'rep' || (event_id - event_id % 4) AS id, event_type AS reviewer, ts,
  CASE WHEN value > 50 THEN 'approved' ELSE 'rejected' END AS status FROM events),
last AS (SELECT id, max_by(status, (ts, status)) AS status, max_by(reviewer, (ts, status)) AS reviewer,
         max(ts) AS ts FROM dec GROUP BY 1)"""


def _decisions(spark, d):
    e = D.events(spark, d)
    return e.select(
        F.concat(F.lit("rep"), (F.col("event_id") - F.col("event_id") % 4).cast("string")).alias(
            "report_id"),
        F.when(F.col("value") > 50, "approved").otherwise("rejected").alias("status"),
        F.col("event_type").alias("reviewed_by"), F.col("ts").alias("decided_at"))


@check("apply_decisions", f"""WITH {Q_REP}, {Q_DEC}
SELECT r.id, coalesce(l.status, r.status) AS status, l.reviewer AS reviewed_by, l.ts AS reviewed_at
FROM rep r LEFT JOIN last l USING (id)""")
def apply_decisions(spark, d):
    return kb.apply_decisions(D.user_reports(spark, d), _decisions(spark, d))[0].select(
        "id", "status", "reviewed_by", "reviewed_at")


@check("decided_subjects", f"""WITH {Q_REP}, {Q_DEC}
SELECT DISTINCT subject_id AS id FROM rep JOIN last USING (id)""")
def decided_subjects(spark, d):
    return kb.apply_decisions(D.user_reports(spark, d), _decisions(spark, d))[1]


@check("drop_subjects", f"""WITH {Q_CUSTOMERS}, {Q_REP}
SELECT r.id FROM rep r WHERE subject_id NOT IN (
  SELECT id FROM customers WHERE risk_level = 'low')""")
def drop_subjects(spark, d):
    c = D.customers(spark, d)
    tables = {"subjects": c, "user_reports": D.user_reports(spark, d)}
    return kb.drop_subjects(tables, c.where(F.col("risk_level") == "low"))["user_reports"].select("id")


@check("posts_to_ingest", f"""WITH {Q_MEDIA}, posts AS (
  SELECT 'https://src.example.com/' || {K} AS link, user_id, event_id, event_type, {K} AS k FROM events),
need AS (SELECT link, count(DISTINCT user_id) AS n FROM posts WHERE event_type = 'view' GROUP BY 1),
have AS (SELECT DISTINCT link, user_id FROM posts WHERE event_type = 'click'),
found AS (SELECT v.link, count(*) AS n FROM (SELECT DISTINCT link, user_id FROM posts
            WHERE event_type = 'view') v JOIN have h ON h.link = v.link AND h.user_id = v.user_id
          GROUP BY 1)
SELECT need.link FROM need LEFT JOIN found USING (link) WHERE coalesce(found.n, 0) < need.n""")
def posts_to_ingest(spark, d):
    """Sources of views as posts without pictures; click evidence counts as stored."""
    ev = kb.with_json_keys(D.evidence(spark, d))
    views = ev.where(F.col("source") == "view").select(
        F.col("source_url").alias("link"), "subject_id")
    posts = views.select("link", F.array().cast("array<string>").alias("image_urls")).distinct()
    return kb.posts_to_ingest(posts, views, ev, D.media(spark, d), "click").select("link")


# --- reuse --------------------------------------------------------------------------------
Q_REUSE = """reuse AS (SELECT CAST(doc_id AS VARCHAR) AS query, sha256('doc ' || doc_id) AS input_hash,
  '{"n":' || toxic || '}' AS result, quality,
  TIMESTAMP '2024-01-10' + to_days(CASE WHEN quality = 1 THEN 30 ELSE 5 END) AS expires_at
  FROM labels)"""


@check("purge_expired", f"""WITH {Q_REUSE}
SELECT query, expires_at FROM reuse WHERE expires_at > TIMESTAMP '2024-01-20'""")
def purge_expired(spark, d):
    return kb.purge_expired(D.reuse_table(spark, d), D.AS_OF)[0].select("query", "expires_at")


@check("purged_count", f"""WITH {Q_REUSE}
SELECT CAST(count(*) AS BIGINT) AS n_purged FROM reuse WHERE expires_at <= TIMESTAMP '2024-01-20'""")
def purged_count(spark, d):
    return kb.purge_expired(D.reuse_table(spark, d), D.AS_OF)[1]


@check("latest_valid", f"""WITH {Q_REUSE}
SELECT query, max(result) AS result FROM reuse WHERE expires_at > TIMESTAMP '2024-01-20' GROUP BY 1""")
def latest_valid(spark, d):
    return ranking.latest_valid(
        D.reuse_table(spark, d), ["query"], D.AS_OF, tie="result").select("query", "result")


@check("rows_to_score", f"""WITH {Q_REUSE}
SELECT CAST(doc_id AS VARCHAR) AS query FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (
  SELECT query FROM reuse WHERE expires_at > TIMESTAMP '2024-01-20')""")
def rows_to_score(spark, d):
    inputs = D.score_inputs(spark, d).withColumn("input_hash", FJ.sha256_hex("input"))
    return history.rows_to_score(inputs, D.reuse_table(spark, d), D.AS_OF).select("query")


def _length_model(pdf):
    return pdf.assign(result=['{"len":%d}' % len(t) for t in pdf["input"]])


@check("score_with", f"""WITH {Q_REUSE}, valid AS (
  SELECT query, max(result) AS result FROM reuse WHERE expires_at > TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS query, v.query IS NOT NULL AS reused,
  coalesce(v.result, '{{"len":' || length('doc ' || doc_id) || '}}') AS result
FROM documents LEFT JOIN valid v ON v.query = CAST(doc_id AS VARCHAR)""")
def score_with(spark, d):
    scored, _ = models.score_with(
        D.score_inputs(spark, d), _length_model, D.reuse_table(spark, d), D.AS_OF)
    return scored.select("query", "reused", "result")


@check("put_results", f"""WITH {Q_REUSE}
SELECT query, expires_at FROM reuse UNION ALL
SELECT CAST(doc_id AS VARCHAR), TIMESTAMP '2024-01-21 00:00:00' FROM documents""")
def put_results(spark, d):
    new = D.score_inputs(spark, d).select("query", "agent_name", "prompt_hash")
    return kb.put_results(D.reuse_table(spark, d), new, 24, D.AS_OF).select("query", "expires_at")


# --- fetch log ----------------------------------------------------------------------------
Q_LOG = """log AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS entry, ts,
  value > 20 AS success, floor(value) AS ms, value < 5 AS blocked FROM events),
st AS (SELECT source, entry, count(*) FILTER (WHERE success) AS ok,
    count(*) FILTER (WHERE NOT success) AS bad, max(ts) AS last_used,
    max_by(success, ts) AS last_success, max_by(ms, ts) FILTER (WHERE success) AS last_ms
  FROM log WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2),
cool AS (SELECT *, NOT last_success AND last_used + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-20' AS cooling
  FROM st)"""


@check("fetch_health", f"""WITH {Q_LOG}
SELECT source, count(*) AS total, CAST(sum(CASE WHEN cooling THEN 0 ELSE 1 END) AS BIGINT) AS healthy,
  CAST(sum(ok) AS BIGINT) AS successes, CAST(sum(bad) AS BIGINT) AS failures FROM cool GROUP BY 1""")
def fetch_health(spark, d):
    return metrics.fetch_health(D.fetch_log(spark, d), D.AS_OF, 86400)


@check("fetch_success", f"""WITH {Q_LOG}
SELECT source, count(*) AS tested, count(*) FILTER (WHERE success) AS successful FROM log GROUP BY 1""")
def fetch_success(spark, d):
    return metrics.fetch_success(D.fetch_log(spark, d))


@check("fetch_latency", f"""WITH {Q_LOG}, d AS (
  SELECT source, ms, row_number() OVER (PARTITION BY source ORDER BY ms) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM log WHERE ms > 0),
p AS (SELECT source, ms AS p95_ms FROM d WHERE i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)))
SELECT source, count(*) AS jobs, round(avg(CAST(success AS INTEGER)), 6) AS success_rate,
  CAST(floor(avg(ms) FILTER (WHERE ms > 0) + 0.5) AS BIGINT) AS avg_ms,
  count(*) FILTER (WHERE blocked) AS blocked_total, any_value(p95_ms) AS p95_ms
FROM log JOIN p USING (source) GROUP BY 1""")
def fetch_latency(spark, d):
    return metrics.fetch_latency(D.fetch_log(spark, d)).drop("jobs_per_second")


@check("rank_sources", f"""WITH {Q_LOG}, sc AS (
  SELECT source, entry, cooling, last_used, 100 + ok * 20 + CASE WHEN ok > 0 THEN 5 ELSE 0 END
    - bad * 25 - CASE WHEN coalesce(last_ms, 0) > 0
        THEN least(20, CAST(floor(last_ms / 250 + 0.5) AS INTEGER)) ELSE 0 END AS score FROM cool)
SELECT source, entry, CAST(score AS BIGINT) AS score, last_used AS last_used_at FROM sc
WHERE NOT cooling OR NOT (SELECT bool_or(NOT cooling) FROM sc)""")
def rank_sources(spark, d):
    return metrics.rank_sources(D.fetch_log(spark, d), D.AS_OF, cooldown_seconds=86400)


@check("source_timings", """SELECT doc_id // 7 AS query_id, min(CAST(n_chars AS DOUBLE)) AS fastest_ms,
  max(CAST(n_chars AS DOUBLE)) AS slowest_ms, round(sum(CAST(n_chars AS DOUBLE)), 6) AS sum_ms,
  round(sum(CAST(n_chars AS DOUBLE)) / nullif(max(CAST(n_chars AS DOUBLE)), 0), 6) AS speed_up
FROM documents GROUP BY 1""")
def source_timings(spark, d):
    return metrics.source_timings(D.source_results(spark, d))


# --- events -------------------------------------------------------------------------------
Q_LOGEV = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS investigation_id, event_id AS seq, {K} AS k, value,
  CASE WHEN event_type = 'purchase' AND value > 150 THEN 'complete' WHEN event_type = 'view' THEN
    'phase_start' WHEN event_type = 'error' THEN 'source_status' WHEN event_type = 'click' THEN
    'summary_result' WHEN event_type = 'signup' THEN 'extraction_result' ELSE 'detective_stream' END
    AS type FROM events),
src AS (SELECT investigation_id, k % 7 AS s, max_by(CASE WHEN value > 30 THEN 'done' ELSE 'error' END,
    seq) AS status FROM e WHERE type = 'source_status' GROUP BY 1, 2),
summ AS (SELECT investigation_id, k % 7 AS s, max_by(k, seq) AS k FROM e
    WHERE type = 'summary_result' GROUP BY 1, 2),
ext AS (SELECT investigation_id, k % 13 AS u, max_by(k, seq) AS k FROM e
    WHERE type = 'extraction_result' GROUP BY 1, 2),
roll AS (SELECT i.investigation_id,
  (SELECT count(*) FROM src s WHERE s.investigation_id = i.investigation_id) AS total_sources,
  (SELECT count(*) FROM src s WHERE s.investigation_id = i.investigation_id AND status = 'done')
    AS done_sources,
  (SELECT count(*) FROM src s WHERE s.investigation_id = i.investigation_id AND status <> 'done')
    AS failed_sources,
  CAST(coalesce((SELECT sum(k % 4) FROM summ s WHERE s.investigation_id = i.investigation_id), 0)
    AS BIGINT) AS summary_signals,
  CAST(coalesce((SELECT sum(k % 4) FROM ext s WHERE s.investigation_id = i.investigation_id), 0)
    AS BIGINT) AS extraction_signals,
  (SELECT count(DISTINCT k % 11) FROM summ s WHERE s.investigation_id = i.investigation_id)
    AS n_phone_mentions,
  (SELECT count(DISTINCT k % 17) FROM ext s WHERE s.investigation_id = i.investigation_id)
    AS n_related_numbers
  FROM (SELECT DISTINCT investigation_id FROM e) i),
prog AS (SELECT investigation_id,
  count(DISTINCT k % 5) FILTER (WHERE type = 'phase_start') AS started_phases,
  bool_or(type = 'complete') AS complete, bool_or(type = 'summary_result') AS s,
  coalesce(max(seq) FILTER (WHERE type = 'detective_stream') >=
    coalesce(max(seq) FILTER (WHERE type = 'detective_stream' AND k % 10 = 0), -1), false) AS t,
  max_by(least(value / 500, 1.0), seq) FILTER (WHERE type = 'complete') AS confidence FROM e GROUP BY 1),
progress AS (SELECT investigation_id, started_phases, complete, CAST(CASE WHEN complete
    THEN floor(confidence * 100 + 0.5)
    ELSE least(95, greatest(8, started_phases * 18 + CASE WHEN s THEN 6 ELSE 0 END
                               + CASE WHEN t THEN 8 ELSE 0 END)) END AS INTEGER) AS progress FROM prog)"""


@check("investigation_rollup", f"WITH {Q_LOGEV} SELECT * FROM roll")
def investigation_rollup(spark, d):
    return metrics.investigation_rollup(D.event_log(spark, d))


@check("investigation_progress", f"WITH {Q_LOGEV} SELECT * FROM progress")
def investigation_progress(spark, d):
    return metrics.investigation_progress(D.event_log(spark, d))


@check("investigation_state", f"""WITH {Q_LOGEV}, failed AS (SELECT investigation_id,
  bool_or(type = 'source_status' AND value < 5 AND k % 3 = 0) AS failed FROM e GROUP BY 1)
SELECT roll.*, started_phases, progress,
  CASE WHEN complete THEN 'complete' WHEN failed THEN 'failed' ELSE 'running' END AS status
FROM roll JOIN progress USING (investigation_id) JOIN failed USING (investigation_id)""")
def investigation_state(spark, d):
    """Errors of low value end the investigation unless they are recoverable."""
    errors = D.events(spark, d).where((F.col("event_type") == "error") & (F.col("value") < 5)).select(
        F.col("user_id").cast("string").alias("investigation_id"), F.col("event_id").alias("seq"),
        F.lit("error").alias("type"), (F.col("k") % 3 > 0).alias("recoverable"))
    return state.investigation_state_batch(D.event_log(spark, d).unionByName(errors, allowMissingColumns=True))


@check("latest_per_key", f"""SELECT user_id, event_type, min(event_id) AS first_seq,
  max_by(value, event_id) AS value FROM events GROUP BY 1, 2""")
def latest_per_key(spark, d):
    return ranking.latest_per_key(
        D.table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])


@check("assemble_reports", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS investigation_id, turn, text,
  role = 'assistant' AND turn >= 5 AS done, role = 'user' AND turn > 0 AS repl FROM conversations),
e AS (SELECT investigation_id, min(turn) FILTER (WHERE done) AS end_turn FROM c GROUP BY 1),
u AS (SELECT c.*, end_turn FROM c JOIN e USING (investigation_id)
      WHERE end_turn IS NULL OR turn <= end_turn),
s AS (SELECT investigation_id, max(turn) FILTER (WHERE repl) AS start_turn FROM u GROUP BY 1)
SELECT investigation_id, string_agg(text, '' ORDER BY turn) AS text,
  bool_or(end_turn IS NOT NULL) AS complete, count(*) AS n_chunks
FROM u JOIN s USING (investigation_id) WHERE start_turn IS NULL OR turn >= start_turn GROUP BY 1""")
def assemble_reports(spark, d):
    return reports.assemble_reports_batch(D.chunks(spark, d))


Q_SUB = f"""sub AS (SELECT event_id, ts, sha256('203.0.113.' || user_id) AS reporter,
  sha256('phone|' || {q_phone(f'{K} % 12')}) AS subject,
  CASE WHEN event_id % 11 = 0 THEN 'invalid:subject_type' WHEN event_id % 13 = 0
    THEN 'invalid:description_missing' END AS bad
  FROM events WHERE event_type IN ('error', 'signup'))"""


@check("validate_reports", f"""WITH {Q_SUB}
SELECT event_id, replace(bad, 'invalid:', '') AS reject_reason FROM sub""")
def validate_reports(spark, d):
    return triage.validate_reports(D.submissions(spark, d)).select("event_id", "reject_reason")


Q_FOLD = f"""{Q_SUB},
s AS (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY ts, event_id) AS rn
      FROM sub WHERE bad IS NULL),
f(reporter, rn, event_id, outcome, st) AS (
  SELECT DISTINCT reporter, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
    CAST([] AS STRUCT(t TIMESTAMP, s VARCHAR)[]) FROM s
  UNION ALL
  SELECT reporter, rn, event_id, outcome, CASE WHEN outcome = 'accepted'
      THEN list_append(live, {{'t': ts, 's': subject}}) ELSE live END FROM (
    SELECT *, CASE WHEN len(live) >= 5 THEN 'rate_limited'
        WHEN len(list_filter(live, lambda x: x.s = subject)) > 0 THEN 'duplicate'
        ELSE 'accepted' END AS outcome FROM (
      SELECT s.reporter, s.rn, s.event_id, s.ts, s.subject,
             list_filter(f.st, lambda x: x.t > s.ts - INTERVAL 24 HOUR) AS live
      FROM f JOIN s ON s.reporter = f.reporter AND s.rn = f.rn + 1)))"""


@check("admit_reports", f"""WITH RECURSIVE {Q_FOLD}
SELECT event_id, outcome FROM f WHERE event_id IS NOT NULL
UNION ALL SELECT event_id, bad FROM sub WHERE bad IS NOT NULL""")
def admit_reports(spark, d):
    once = D.submissions(spark, d)
    # every submission comes twice under one event id
    return admission.admit_reports_batch(once.unionByName(once)).select("event_id", "outcome")


@check("submit_reports", f"""WITH RECURSIVE {Q_FOLD}
SELECT sha256('report|' || event_id) AS id, subject AS subject_id, reporter AS reporter_ip_hash, 'pending' AS status,
  ts AS created_at FROM (SELECT event_id, outcome FROM f WHERE event_id IS NOT NULL) f
JOIN sub USING (event_id) WHERE outcome = 'accepted'""")
def submit_reports(spark, d):
    empty = spark.createDataFrame([], S.REPORTS)
    _, stored, _ = submissions.submit_reports(D.customers(spark, d), empty, D.submissions(spark, d))
    return stored.select("id", "subject_id", "reporter_ip_hash", "status", "created_at")


@check("submission_subjects", f"""WITH RECURSIVE {Q_FOLD}, {Q_CUSTOMERS},
t AS (SELECT subject AS id, max(ts) AS ts FROM (SELECT event_id, outcome FROM f WHERE event_id IS NOT NULL) f
      JOIN sub USING (event_id) WHERE outcome IN ('accepted', 'duplicate') GROUP BY 1)
SELECT id, greatest(last_seen_at, t.ts) AS last_seen_at FROM customers LEFT JOIN t USING (id)""")
def submission_subjects(spark, d):
    empty = spark.createDataFrame([], S.REPORTS)
    subjects, _, _ = submissions.submit_reports(D.customers(spark, d), empty, D.submissions(spark, d))
    return subjects.select("id", "last_seen_at")


@check("moderate_reports", f"""WITH {Q_CUSTOMERS}, {Q_INV}, {Q_REP.replace('rep AS', 'rep0 AS', 1)}, {Q_DEC},
rep AS (SELECT rep0.* REPLACE (coalesce(last.status, rep0.status) AS status) FROM rep0 LEFT JOIN last USING (id)), {Q_RISK}
SELECT id, score AS risk_score, {q_level('score')} AS risk_level, CAST(approved AS INTEGER) AS report_count
FROM recalc WHERE id IN (SELECT subject_id FROM rep0 JOIN last USING (id))""")
def moderate_reports(spark, d):
    _, scores = submissions.moderate_reports(
        D.customers(spark, d), D.investigations(spark, d), D.user_reports(spark, d), _decisions(spark, d))
    return scores.select("id", "risk_score", "risk_level", "report_count")


# --- gates and small lookups ----------------------------------------------------------------
@check("quality_gate", f"""WITH {Q_INV} SELECT id, round(quality, 6) AS quality_score FROM inv
WHERE round(quality, 6) >= 0.3""")
def quality_gate(spark, d):
    return triage.ingest_gate(D.investigations(spark, d)).select(
        "id", r6("quality_score").alias("quality_score"))


@check("reuse_gate", f"WITH {Q_INV} SELECT id FROM inv WHERE ratio >= 0.5")
def reuse_gate(spark, d):
    return triage.reuse_gate(D.investigations(spark, d)).select("id")


@check("media_exists", f"""SELECT DISTINCT 'https://img.example.com/' || {K} || '.jpg' AS original_url FROM events
WHERE event_type IN ('view', 'click')""")
def media_exists(spark, d):
    wanted = D.events(spark, d).select(D.image_url("k").alias("original_url")).distinct()
    return kb.media_exists(D.media(spark, d), wanted)


@check("existing_evidence", f"""WITH {Q_EV}, w AS (SELECT DISTINCT subject_id, source_url FROM ev WHERE source = 'click')
SELECT w.subject_id, w.source_url, o.id FROM w JOIN (SELECT subject_id, source_url,
  min_by(id, (created_at, id)) AS id FROM ev WHERE source = 'view' GROUP BY 1, 2) o USING (subject_id, source_url)""")
def existing_evidence(spark, d):
    ev = kb.with_json_keys(D.evidence(spark, d))
    keys = ev.where(F.col("source") == "click").select("subject_id", "source_url").distinct()
    return history.existing_evidence(
        keys, ev.where(F.col("source") == "view"), ["subject_id", "source_url"]
    ).select("subject_id", "source_url", "id")


@check("with_history", f"""WITH {Q_PAYLOAD}
SELECT event_id AS query_id, p.linked, p.reports, p.signals
FROM events LEFT JOIN customers c ON c.value = {q_phone(f'user_id + {K}')} LEFT JOIN payloads p ON p.id = c.id""")
def with_history(spark, d):
    """Queries for user + k with the payload of known subjects."""
    c = D.customers(spark, d)
    q = D.events(spark, d).select(
        F.col("event_id").alias("query_id"), D.phone(F.col("user_id") + F.col("k")).alias("query"),
        F.lit("phone").alias("query_type"))
    return history.with_history(q, c, _payloads(spark, d)).select("query_id", *(
        F.when(F.col("payload").isNotNull(), part).alias(name)
        for part, name in zip(_unpacked("payload"), ("linked", "reports", "signals"), strict=True)))


@check("report_status", """SELECT CAST(user_id AS VARCHAR) AS investigation_id, max_by(event_type, (ts, event_type)) AS status,
  max(ts) AS updated_at, max(ts) + INTERVAL 3600 SECOND AS expires_at FROM events
WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1 HAVING max(ts) + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-20'""")
def report_status(spark, d):
    return state.report_status_batch(D.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("investigation_id"), "ts",
        F.col("event_type").alias("status")), D.AS_OF)


@check("refresh", f"""WITH {Q_CUSTOMERS}, {Q_INV}
SELECT c.id, max(created_at) AS last_investigation_at FROM customers c LEFT JOIN inv ON subject_id = c.id GROUP BY 1""")
def refresh(spark, d):
    """The scheduled rebuild: overview and purge of stored results."""
    from ..streaming.ingest import refresh as rebuild

    out = rebuild({"subjects": D.customers(spark, d), "investigations": D.investigations(spark, d),
                   "analysis_cache": D.reuse_table(spark, d)}, D.AS_OF)
    return out["overview"].select("id", "last_investigation_at")


@check("merge_ids", f"""SELECT user_id, count(DISTINCT {K}) AS n FROM events GROUP BY 1""")
def merge_ids(spark, d):
    """Distinct union of two id lists, kept as rows."""
    e = D.events(spark, d)
    a = e.where(F.col("k") < 60).select("user_id", "k")
    b = e.where(F.col("k") >= 40).select("user_id", "k")
    return graph.union_distinct(a, b).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@check("change_log", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' moved' ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 200 WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS place
FROM customer WHERE c_custkey % 7 <> 0""")
def change_log_(spark, d):
    """Customers written by three commits and a compaction, read back: added, replaced twice, gone."""
    import uuid

    base, keys = f"{checkpoint_dir(spark)}/change-log-{uuid.uuid4().hex}", {"customers": ["id"]}
    rows = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("place"))
    third = F.col("id") % 3 == 0
    moved = rows.withColumn("name", F.when(third, F.concat("name", F.lit(" moved"))).otherwise(F.col("name"))).withColumn(
        "place", F.when(third, F.col("place") + 100).otherwise(F.col("place")))
    fifth = F.when(F.col("id") % 5 == 0, F.pmod("place", F.lit(100)) + 200).otherwise(F.col("place"))
    last = moved.withColumn("place", fifth).where(F.col("id") % 7 != 0)
    version = 0
    for old, new in ((rows.limit(0), rows), (rows, moved), (moved, last)):
        changes = {"customers": change_log.changes_between(old, new, ["id"])}
        version = change_log.commit(spark, base, version, changes, keys)
        if version == 2:
            version = change_log.compact(spark, base, 1, keys)
    return change_log.read(spark, base, "customers", keys=["id"])
