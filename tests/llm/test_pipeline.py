"""The pipeline's stages against a plain version, and on awkward tables."""

import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from conftest import write
from test_queries import plain_best_fit, plain_line_dedup

from riskgraph.llm import lines, packing
from riskgraph.llm.common import stored
from riskgraph.llm.queries import tokenizer_path


def plain_near(docs):
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def plain_contaminated(text, items):
    words = re.findall(r"\w+", text.lower())
    grams = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    for item in items:
        w = re.findall(r"\w+", item.lower())
        hit = set()
        for k in range(len(w) - 4):
            if tuple(w[k:k + 5]) in grams:
                hit.update(range(k, k + 5))
        if w and len(hit) >= 0.75 * len(w):
            return True
    return False


def plain_without_stubs(docs):
    """Documents that lost lines go if what is left is blank or short, and all of it stands in an earlier document."""
    left, earlier, out = plain_line_dedup(sorted(docs.items())), set(), {}
    short = lambda x: len(x) < lines.LEAST_CHARS
    for i, text in sorted(docs.items()):
        kept = [x for x in left[i].split("\n") if x.strip()]
        own = [x for x in kept if not short(x) or x not in earlier]
        if len(left[i].split("\n")) == len(text.split("\n")) and left[i] or own or (not text and not left[i]):
            out[i] = left[i]
        earlier |= {x for x in text.split("\n") if short(x)}
    return out


def test_stages_equal_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        held[name] = docs
        if name != "pack":
            assert docs.columns == columns
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall())
    got = {n: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for n, d in held.items() if n != "pack"}
    assert got["language_id"] == {i: t for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    assert got["line_dedup"] == plain_without_stubs(got["language_id"])
    assert all(r["n_chars"] == len(r["text"]) for r in held["line_dedup"].collect())
    assert got["near_dedup"] == plain_near(got["line_dedup"])
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM read_parquet('{sf_dir}/benchmark.parquet')").fetchall()]
    assert got["decontaminate"] == {i: t for i, t in got["near_dedup"].items() if not plain_contaminated(t, items)}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, lengths = set(), []
    for i, text in got["decontaminate"].items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want.add((i, k, start, n, zlib.crc32(ids[start:start + n])))
            lengths.append(n)
    rows = held["pack"].collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len({r["sequence_id"] for r in rows}) == plain_best_fit(lengths, 1024)


def test_awkward_and_empty_tables(spark, edge_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    before = {(r["doc_id"], r["key"]): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, edge_dir), name)
        for r in docs.collect():  # other columns go along unchanged
            old = before[r["doc_id"], r["key"]]
            assert all(r[c] == old[c] for c in docs.columns if c not in ("text", "n_chars"))
    left = {r["doc_id"] for r in docs.collect()}
    assert not left & {200, 201, 203, 10, 206}
    assert {0, 1, 5, 100} <= left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir).count() >= len(left)


def test_copies_with_short_or_blank_lines_go(spark, tmp_path):
    long = ["A first line that is long enough to tell from others.", "Quite another sentence closes this little document."]
    docs = [
        (1, "Haanth.\n" + "\n".join(long), "en"), (2, "Haanth.\n" + "\n".join(long), "en"),  # a short title
        (3, "\n\n".join(x[::-1] for x in long), "en"), (4, "\n\n".join(x[::-1] for x in long), "en"),  # blank lines
        (5, "Haanth.\n \n" + "\n".join(x + "!" for x in long), "en"),  # nearly a copy
        (6, long[0] + "\nRoses are red,\nviolets blue.", "en"),  # short lines of its own
        (7, "Roses are red,\n" + long[0] + "\nHaanth.", "en"),  # short lines of several others
        (8, "Haanth.", "en"),  # has lost nothing
        (None, "Haanth.\n" + long[0].upper(), "en"),
    ]
    folder = write(tmp_path / "copies", docs, [], [], [])
    out = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts == {
        1: docs[0][1], 3: docs[2][1], 6: docs[5][1].split("\n", 1)[1], 8: "Haanth.", None: docs[8][1]}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert packed >= {1, 3, 6} and not packed & {2, 4, 5, 7}


def test_clashing_and_dotted_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    extra = ["n_lines", "near_lines", "equal_lines", "a.b", "c0", "at", "th", "own_0", "lang_pred", "maybe", "kept", "place of the text"]
    wide = docs.drop(*extra).select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = wide.columns
        wide = stored(stage(spark, wide, edge_dir), name)
        assert wide.columns == columns
        for r in wide.collect():
            assert all(r[c] == f"{c} {'none' if r['doc_id'] is None else r['doc_id']}" for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, edge_dir).count() > 0


def test_workers_hold_one_steps_tables():
    """Python workers go on from stage to stage: what one remembered isn't kept through the next."""
    from riskgraph.llm import common, decontamination, near_dups, tokens

    common.forget()
    near_dups.shingles("some words of a text")
    assert list(common._kept) == ["shingle words"] and len(common._kept["shingle words"]) == 5
    near_dups.shingles("some more words")
    assert len(common._kept["shingle words"]) == 6
    decontamination.word_hashes("some words of a text")
    assert list(common._kept) == ["window words"]
    path = tokenizer_path("byte_bpe_50k.json")
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first and list(common._kept) == [("encoder", path)]
    common.forget()
    assert not common._kept


def test_workers_get_batches_of_bounded_bytes(spark):
    """Long texts come in small batches, so neither the JVM nor a worker holds many of them; a bound that is set stays."""
    from riskgraph import session
    from riskgraph.llm.common import by_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    docs = spark.range(0, 900, 1, 1).select(F.repeat(F.lit("ten chars "), 1000).alias("text"))
    try:
        spark.conf.unset(name)
        got = by_batches(docs, sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 900 and max(r["bytes"] for r in got) < 2 * session.BATCH_BYTES
        spark.conf.set(name, 1 << 30)
        assert by_batches(docs, sizes, "n long, bytes long").count() == 1
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_word_tables_stay_small():
    """A corpus whose texts all have words of their own fills no worker: hashes beyond the bound are found, not kept."""
    from riskgraph.llm import common, decontamination, near_dups

    common.forget()
    text = " ".join(f"w{i}" for i in range(200_000))
    for hashes, name in ((near_dups.shingles, "shingle words"), (decontamination.word_hashes, "window words")):
        first = hashes(text)
        assert len(common._kept[name]) <= 100_000
        assert (hashes(text) == first).all() and len(np.unique(first)) >= 199_996
    common.forget()
