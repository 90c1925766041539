"""Links between subjects and questions on the link graph.

``links``: subject_a_id < subject_b_id, link_type, strength, first_seen_at, last_seen_at.
The evidence of a link is kept as rows (``link_evidence``), not as an array that would grow
with the link.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.subjects import classify_value, normalize_subject, parse_mention, subject_id
from ..session import cut_lineage, tasks_for
from .hubs import for_parts, heavy_and_count, in_parts, split_join
from .numbers import numbered
from .ranking import top_n

LINK_KEY = ["subject_a_id", "subject_b_id", "link_type"]

#: So many names are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 100_000


# --- building -------------------------------------------------------------------------
def evidence_with_mentions(evidence: DataFrame, source: str | None = None) -> DataFrame:
    kept = evidence.where(F.size("mentioned_subjects") > 0)
    return kept if source is None else kept.where(F.col("source") == source)


def mention_rows(evidence: DataFrame) -> DataFrame:
    """(evidence_id, subject_id, subject_type, value) per mention, normalised."""
    return (
        evidence.select(
            F.col("id").alias("evidence_id"), "subject_id",
            F.explode("mentioned_subjects").alias("__m"))
        .withColumn("__p", parse_mention("__m"))
        .select(
            "evidence_id", "subject_id", F.col("__p.subject_type").alias("subject_type"),
            normalize_subject(F.col("__p.value"), F.col("__p.subject_type")).alias("value"))
        .where(F.col("value") != "")
    )


def resolve_mentions(mentions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Mentions whose subject exists and is another one; adds ``other_id``.

    A value that much of the evidence names is joined in parts."""
    known = subjects.select("subject_type", "value", F.col("id").alias("other_id"))
    return split_join(mentions, known, ["subject_type", "value"], F.col("subject_id")).where(
        F.col("other_id") != F.col("subject_id"))


def ordered_pair(df: DataFrame, left: str = "subject_id", right: str = "other_id") -> DataFrame:
    return (
        df.withColumn("subject_a_id", F.least(left, right))
        .withColumn("subject_b_id", F.greatest(left, right))
        .drop(left, right)
    )


def co_mention_links(mentions: DataFrame, subjects: DataFrame,
                     link_type: str = "co_mentioned") -> DataFrame:
    """Strength = number of evidence rows that mention the pair.

    One shuffle by mentioned value, in which values that much of the evidence names are dealt in parts by subject and
    evidence, serves the distinct count per (subject, value) and the join with the subjects; the parts' counts add up.
    """
    # the key is one column: a constant type would drop out of the grouping, but not out of the shuffle
    key, told = ["mention"], F.col("subject_type").isNotNull() & F.col("value").isNotNull()
    mention = F.struct("subject_type", "value").alias("mention")
    rows = mentions.where(told).select("subject_id", mention, "evidence_id")
    heavy, n = heavy_and_count(rows, key)
    tasks = tasks_for(mentions.sparkSession, n)
    counted = (
        in_parts(rows, key, F.struct("subject_id", "evidence_id"), heavy)
        .repartition(tasks, *key, "part")
        .groupBy("subject_id", *key, "part").agg(F.count_distinct("evidence_id").alias("n")))
    known = for_parts(subjects.where(told).select(mention, F.col("id").alias("other_id")), key, heavy)
    pairs = ordered_pair(counted.join(known, [*key, "part"]).where(
        F.col("other_id") != F.col("subject_id")).select("subject_id", "other_id", "n"))
    # one evidence row belongs to one subject, so the two directions never share evidence
    return pairs.repartition(tasks, "subject_a_id", "subject_b_id").groupBy("subject_a_id", "subject_b_id").agg(
        F.lit(link_type).alias("link_type"),
        F.greatest(F.sum("n"), F.lit(1)).cast("double").alias("strength"))


def co_mention_pairs(evidence: DataFrame, subjects: DataFrame, source: str | None = None
                     ) -> DataFrame:
    """Change rows for ``upsert_links``: one per (pair, evidence)."""
    rows = resolve_mentions(mention_rows(evidence_with_mentions(evidence, source)), subjects)
    return ordered_pair(rows).select(
        "subject_a_id", "subject_b_id", F.lit("co_mentioned").alias("link_type"), "evidence_id")


def mention_index(evidence: DataFrame, source: str | None = None) -> DataFrame:
    """Inverted index of the evidence: one row per (subject_type, value, evidence_id), with the evidence's subject."""
    return mention_rows(evidence_with_mentions(evidence, source)).distinct()


def replace_indexed(index: DataFrame, changed_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The index (or another frame by ``evidence_id``) once the evidence ``changed_ids(evidence_id)`` has ``rows``."""
    return index.join(changed_ids, "evidence_id", "left_anti").unionByName(rows)


def new_co_mention_pairs(index: DataFrame, added: DataFrame, subjects: DataFrame, new_subjects: DataFrame) -> DataFrame:
    """Change rows for ``upsert_links`` that index rows ``added`` to ``index`` and ``new_subjects`` bring.

    Added rows look among all subjects, all indexed rows among the new subjects only; pairs of old evidence with old
    subjects are links already."""
    rows = resolve_mentions(added, subjects).unionByName(resolve_mentions(index, new_subjects)).distinct()
    return ordered_pair(rows).select(
        "subject_a_id", "subject_b_id", F.lit("co_mentioned").alias("link_type"), "evidence_id")


def investigation_mentions(investigations: DataFrame) -> DataFrame:
    """Subjects named in the summaries and extractions of an investigation.

    investigations(subject_id, query, query_type, summaries, extractions); the investigated
    value itself is left out whatever the type.
    """
    named = F.array_distinct(F.concat(
        F.flatten(F.transform("summaries", lambda s: s["phone_mentions"])),
        F.flatten(F.transform("extractions", lambda e: e["related_numbers"]))))
    # typed, normalised and sifted inside the row: as columns the optimizer repeats each step in the next
    typed = F.transform(named, lambda m: F.struct(m.alias("m"), classify_value(m).alias("subject_type")))
    values = F.transform(typed, lambda r: F.struct(
        r["subject_type"].alias("subject_type"), normalize_subject(r["m"], r["subject_type"]).alias("value")))
    kept = F.flatten(F.transform(
        F.array(normalize_subject("query", "query_type")), lambda own: F.filter(
            values, lambda r: r["subject_type"].isNotNull() & (r["value"] != "") & (r["value"] != own))))
    return investigations.select("subject_id", F.explode_outer(kept).alias("__m")).where(
        F.col("__m").isNotNull()).select("subject_id", "__m.subject_type", "__m.value").distinct()


def mention_pairs(mentions: DataFrame) -> DataFrame:
    """'mentioned_together' change rows: no evidence, so the strength stays 1."""
    rows = mentions.withColumn("other_id", subject_id("subject_type", "value")).where(
        F.col("other_id") != F.col("subject_id"))
    return ordered_pair(rows).select(
        "subject_a_id", "subject_b_id", F.lit("mentioned_together").alias("link_type"),
        F.lit(None).cast("string").alias("evidence_id")).distinct()


def upsert_links(links: DataFrame, link_evidence: DataFrame, pairs: DataFrame, seen_at
                 ) -> tuple[DataFrame, DataFrame]:
    """New links and link evidence after the change rows ``pairs`` (LINK_KEY + evidence_id).

    A new link counts its distinct evidence (at least 1); a known link grows by the evidence
    it did not have.  Repeating the same changes changes nothing but last_seen_at.
    """
    known = link_evidence.select(*LINK_KEY, "evidence_id", F.lit(True).alias("__k"))
    marked = pairs.select(*LINK_KEY, "evidence_id").distinct().join(
        known, [*LINK_KEY, "evidence_id"], "left"
    ).withColumn("__new", F.col("evidence_id").isNotNull() & F.col("__k").isNull())
    fresh = marked.where("__new").select(*LINK_KEY, "evidence_id")
    added = marked.groupBy(*LINK_KEY).agg(F.sum(F.col("__new").cast("int")).alias("__n"))
    old = links.withColumnRenamed("strength", "__s")
    grown = F.coalesce(F.col("__n"), F.lit(0))
    merged = old.join(added.withColumn("__hit", F.lit(True)), LINK_KEY, "full_outer").select(
        *LINK_KEY,
        F.when(F.col("__s").isNull(), F.greatest(grown, F.lit(1)))
        .otherwise(F.col("__s") + grown).cast("double").alias("strength"),
        F.coalesce("first_seen_at", seen_at).alias("first_seen_at"),
        F.when(F.col("__hit"), seen_at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
    return merged, link_evidence.select(*LINK_KEY, "evidence_id").unionByName(fresh)


# --- asking ---------------------------------------------------------------------------
def symmetrise(links: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each link in both directions, so that a neighbour lookup is an equi-join."""
    keep = keep or []
    a, b = F.col("subject_a_id"), F.col("subject_b_id")
    ends = F.array(
        F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))
    return links.select(F.inline(ends), *keep)


def expand(frontier: DataFrame, edges: DataFrame, heavy: DataFrame | None = None, tasks: int | None = None
           ) -> DataFrame:
    """(root_id, id) one hop further; repeats are left to the aggregation that follows.

    A hub's edges are dealt over parts, each of which meets the frontier's rows of the hub."""
    here = frontier.select("root_id", F.col("id").alias("src"))
    return split_join(edges.select("src", "dst"), here, ["src"], F.col("dst"), heavy, tasks=tasks).select(
        "root_id", F.col("dst").alias("id"))


def named(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ids of the numbers in ``column``; up to BROADCAST_NAMES names are broadcast."""
    ids = names.select(F.col("n").alias(column), F.col("id").alias("__id"))
    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    return rows.join(F.broadcast(ids) if few else ids, column, "left").withColumn(column, F.col("__id")).drop("__id")


def link_ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("subject_a_id", "subject_b_id")).alias("id"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def min_depth(nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    # hardly two rows of a node meet before the shuffle, so they aren't combined there
    rows = nodes if tasks is None else nodes.repartition(tasks, "root_id", "id")
    return rows.groupBy("root_id", "id").agg(F.min("depth").alias("depth"))


class _Around(NamedTuple):
    """Nodes as numbers, the names (n, id) of all of them and of the roots, and the hubs among the numbers."""
    nodes: DataFrame
    names: DataFrame
    roots: DataFrame
    heavy: DataFrame

    def with_fields(self, fields: DataFrame, how: str) -> DataFrame:
        """Nodes with fields(n, ...) of each; a hub, which many roots reach, is joined in parts."""
        rows = split_join(self.nodes, fields.withColumnRenamed("n", "id"), ["id"], F.col("root_id"), self.heavy, how)
        return named(rows, self.roots, "root_id")


def _around(links: DataFrame, roots: DataFrame, depth: int) -> _Around:
    """All nodes within ``depth`` hops (1..3) of each root; ids travel as numbers."""
    depth = min(max(depth, 1), 3)
    asked = roots.select(F.col("root_id").alias("id")).distinct()
    names, number = numbered(link_ends(links).unionByName(asked))
    # hubs are looked for and each hop joins the same edges: made once, without parallel links of other types
    edges = cut_lineage(symmetrise(links.select(
        number("subject_a_id").alias("subject_a_id"), number("subject_b_id").alias("subject_b_id"))).distinct())
    heavy, n = heavy_and_count(edges, ["src"])
    tasks = tasks_for(links.sparkSession, n)
    root_names = cut_lineage(asked.where(F.col("id").isNotNull()).select(number("id").alias("n"), "id"))
    nodes = asked.select(number("id").alias("root_id"), number("id").alias("id"), F.lit(0).alias("depth"))
    for hop in range(1, depth + 1):
        frontier = nodes.where(F.col("depth") == hop - 1)
        found = expand(frontier, edges, heavy, tasks).withColumn("depth", F.lit(hop))
        nodes = min_depth(nodes.unionByName(found), tasks)
        if hop < depth:
            # each hop reads the nodes twice; without the cut the plan would double per hop
            nodes = cut_lineage(nodes)
    return _Around(nodes, names, root_names, heavy)


def reached(links: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root_id, id, depth) of all nodes within ``depth`` hops (1..3) of each root."""
    around = _around(links, roots, depth)
    return around.with_fields(around.names.withColumnRenamed("id", "name"), "left").select(
        "root_id", F.col("name").alias("id"), "depth")


def network_nodes(subjects: DataFrame, links: DataFrame, roots: DataFrame, depth: int = 2
                  ) -> DataFrame:
    """Nodes around each existing root with their attributes and smallest depth."""
    known = roots.join(subjects.select(F.col("id").alias("root_id")), "root_id", "left_semi")
    around = _around(links, known, depth)
    attributes = subjects.select("id", "value", "subject_type", "risk_level", "risk_score").join(
        around.names, "id").withColumnRenamed("id", "name")
    return around.with_fields(attributes, "inner").select(
        "root_id", F.col("name").alias("id"), "value", "subject_type", "risk_level", "risk_score", "depth")


def network_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes of the same root.

    A link is tried for the roots of that end which fewer roots have; ids travel as numbers."""
    names, number = numbered(link_ends(links).unionByName(nodes.select(F.explode(F.array("root_id", "id")).alias("id"))))
    ends = cut_lineage(nodes.select(number("root_id").alias("root_id"), number("id").alias("id")).distinct())
    roots = cut_lineage(ends.select(F.col("root_id").alias("n")).distinct().join(names, "n"))
    a, b = number("subject_a_id").alias("a"), number("subject_b_id").alias("b")
    spread = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    tried = links.select(a, b).distinct()
    for end in ("a", "b"):
        tried = tried.join(spread.withColumnsRenamed({"id": end, "n": f"n_{end}"}), end)
    fewer = F.col("n_a") <= F.col("n_b")
    tried = cut_lineage(tried.select(
        "a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("id"),
        F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"), F.least("n_a", "n_b").alias("n")))
    size = tried.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    tasks = tasks_for(links.sparkSession, size["rows"])
    rows = split_join(tried.drop("n"), ends, ["id"], F.col("other"), tasks=tasks_for(links.sparkSession, size["pairs"]))
    other = ends.withColumnRenamed("id", "other")
    kept = rows.drop("id").repartition(tasks, "root_id", "other").join(other, ["root_id", "other"], "left_semi")
    full = links.select(a, b, *LINK_KEY, "strength").distinct()
    return named(kept.select("root_id", "a", "b").repartition(tasks, "a", "b").join(full, ["a", "b"]), roots, "root_id"
                 ).select("root_id", *LINK_KEY, "strength")


def induced_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes, roots not distinguished."""
    ids = nodes.select("id").distinct()
    tasks = tasks_for(links.sparkSession, links.count())
    rows = links.select(*LINK_KEY, "strength")
    for end in ("subject_a_id", "subject_b_id"):
        rows = split_join(rows, ids.withColumnRenamed("id", end), [end], F.xxhash64(*LINK_KEY), how="left_semi", tasks=tasks)
    return rows.distinct()


def neighbours(subjects: DataFrame, links: DataFrame, wanted: DataFrame | None = None, n: int = 10
               ) -> DataFrame:
    """Strongest direct links per subject: (subject_id, other subject …, link_type, strength).

    Ids travel as numbers until the first ``n`` rows are found; equal ranks keep the order of the ids."""
    edges = symmetrise(links, ["link_type", "strength"])
    ids = edges.select(F.col("src").alias("id"))
    if wanted is not None:
        edges = cut_lineage(edges.join(wanted.select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    names, number = numbered(ids)
    # sorted, so that row numbers keep the order of the ids; rows of one id share their first one as its place
    other = cut_lineage(subjects.select(
        "id", "value", "subject_type", "risk_score", "risk_level", "last_seen_at"
    ).orderBy("id").withColumn("row", F.monotonically_increasing_id()))
    place = F.min("row").over(Window.partitionBy("id")).alias("place")
    narrow = other.select("id", "row", place, "last_seen_at").join(names, "id").select(
        F.col("n").alias("dst"), "row", "place", "last_seen_at")
    edges = edges.select(number("src").alias("src"), number("dst").alias("dst"), "link_type", "strength")
    heavy, size = heavy_and_count(edges, ["dst"])
    tasks = tasks_for(links.sparkSession, size)
    rows = split_join(edges, narrow, ["dst"], F.col("src"), heavy, tasks=tasks).select(
        "src", "row", "place", "last_seen_at", "link_type", "strength")
    order = [F.desc("strength"), F.desc("last_seen_at"), "place", "link_type"]
    # a subject with very many links is cut in parts first; links hold in both directions, so it is heavy on either side
    dealt = in_parts(rows, ["src"], F.col("row"), heavy).repartition(tasks, "src", "part")
    best = top_n(top_n(dealt, ["src", "part"], order, n), ["src"], order, n).select("src", "row", "link_type", "strength")
    return best.join(other, "row").withColumnRenamed("id", "other_id").join(
        names.select(F.col("n").alias("src"), F.col("id").alias("subject_id")), "src", "left").select(
        "subject_id", "other_id", "value", "subject_type", "risk_score", "risk_level", "last_seen_at", "link_type", "strength")


def without_root(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("depth") > 0)
