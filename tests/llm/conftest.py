"""Small tables with the awkward rows every operator has to take."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

EN = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brews near old bridges".split()
DE = "der schnelle braune fuchs springt über den faulen hund während sieben zauberer gifte nahe alten brücken mischen".split()


def text_of(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ing", "er", "x", "q"]) for _ in range(n))


def edge_documents():
    """(doc_id, text, lang): nulls, empty and very long texts, copies, near copies, ties, passages, odd characters."""
    rng = random.Random(11)
    rows = []
    for i in range(90):
        rows.append((i, text_of(rng, EN, rng.randint(20, 90)) + ".\n" + text_of(rng, EN, 30) + ".", "en"))
    for i in range(90, 130):
        rows.append((i, text_of(rng, DE, rng.randint(20, 90)) + ".\n" + text_of(rng, DE, 30) + ".", "de"))
    rows += [
        (200, None, "en"), (201, "", "en"), (202, "   \n\n ", None), (203, "12345 !!! 67", "en"), (204, "one", None),
        (205, rows[3][1], "en"), (206, rows[3][1], "en"), (207, rows[3][1] + " extra", "en"),
        (208, rows[4][1].replace("fox", "cat", 1), "en"), (209, rows[95][1].upper(), "de"),
        (210, text_of(rng, EN, 30_000), "en"), (211, "x" * 20_000, "en"), (212, "á あい \U0001f600 \x85 z", None),
        (213, "<|endoftext|> two  spaces\ttab", "en"), (213, "<|endoftext|> two  spaces\ttab", "en"),
        (None, "a text that has no id but words enough to have shingles", "en"), (None, None, None),
        (-5, "a negative id stands first among the ids that are there", "en"),
    ]
    return rows


def write(folder, documents, pages, benchmark, labels):
    os.makedirs(folder, exist_ok=True)
    tables = {
        "documents": pa.table({
            "doc_id": pa.array([r[0] for r in documents], pa.int64()), "text": pa.array([r[1] for r in documents], pa.string()),
            "lang": pa.array([r[2] for r in documents], pa.string()),
            "source": pa.array(["src0"] * len(documents), pa.string()),
            "n_chars": pa.array([len(r[1]) if r[1] is not None else None for r in documents], pa.int64())}),
        "pages": pa.table({
            "page_id": pa.array([r[0] for r in pages], pa.int64()), "url": pa.array([r[1] for r in pages], pa.string()),
            "html": pa.array([r[2] for r in pages], pa.string())}),
        "benchmark": pa.table({
            "item_id": pa.array([r[0] for r in benchmark], pa.int64()), "text": pa.array([r[1] for r in benchmark], pa.string())}),
        "labels": pa.table({
            "doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()),
            "toxic": pa.array([r[1] for r in labels], pa.int32())}),
    }
    # columns whose names the operators use inside
    extra = ["at", "th", "key", "score", "n", "bands", "shard", "rank", "line", "c0", "component", "id", "segment", "pair"]
    for name, t in tables.items():
        for c in extra:
            t = t.append_column(c, pa.array([f"{c}-{i}" for i in range(t.num_rows)], pa.string()))
        pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)


def edge_benchmark(documents):
    by_id = {r[0]: r[1] for r in documents}
    words = by_id[10].split()
    return [(1, " ".join(words[:18])), (2, " ".join(words[9:15] + words[:6])), (3, None), (4, ""), (5, "four words are few"),
            (None, "an item that nobody ever copied into any document at all"), (1, " ".join(words[:18]))]


def edge_pages():
    long = "<p>" + "payload " * 40 + "</p>"
    return [(5, "http://a/5", long), (3, "http://a/3", long), (9, "http://a b/9\r\nX: y", long), (3, "http://a/3", long),
            (1, None, None), (2, "http://a/2", ""), (4, "http://a/4", "short"), (6, "http://a/6", "short"),
            (None, "http://a/none", long), (7, "http://a/7", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1" + "y" * 100),
            (8, "http://a/8", "ü" * 50), (10, "http://a/10", "ü" * 50), (11, "http://a/11", "z" * 300_000)]


def edge_labels(documents):
    return [(r[0], int(r[1] is not None and "toxic" in r[1])) for r in documents if r[0] is not None] + [(None, 1), (0, None)]


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    docs = edge_documents()
    return write(str(tmp_path_factory.mktemp("edge")), docs, edge_pages(), edge_benchmark(docs), edge_labels(docs))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(str(tmp_path_factory.mktemp("empty")), [], [], [], [])
