"""Every query on awkward and empty tables; those with SQL against DuckDB."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import compare, duck

from riskgraph.llm import decontamination, langid, lines, near_dups, packing, toxicity, warc
from riskgraph.llm.queries import QUERIES, SQL, tokenizer_path

COLUMNS = {
    "op1_language_codes": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_bbit_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op3_string_tiling": {"doc_id", "contaminated"},
    "op4_consistent_hash_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op5_warc_revisits": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op6_toxic_spans": {"doc_id", "held_out", "score", "predicted"},
    "op7_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op8_line_neighbours": {"doc_id", "text"},
    "op9_invertible_sketches": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
}


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def table(folder, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, empty_dir, name):
    out = QUERIES[name](spark, empty_dir)
    assert COLUMNS[name] <= set(out.columns)
    assert out.count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), sf_dir, QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("op5_warc_revisits", "op7_best_fit_packing")])
def test_a_row_for_every_document(spark, edge_dir, name):
    want = Counter(r[0] for r in table(edge_dir, "SELECT doc_id FROM documents"))
    assert Counter(r["doc_id"] for r in rows(spark, name, edge_dir)) == want


def test_language(spark, edge_dir):
    got = {r["doc_id"]: r for r in rows(spark, "op1_language_codes", edge_dir)}
    want = dict(table(edge_dir, "SELECT doc_id, lang FROM documents"))
    for i in (200, 201, 202, 203):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i, r in got.items() if i is not None and r["held_out"] and r["lang_pred"] != "und" and want[i]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    assert sum(got[i]["lang_pred"] == want[i] for i in held) >= 0.9 * len(held)


def test_letters_of_all_planes(spark):
    learned = [(i, text, lang) for i in range(60) for text, lang in [("the brown fox jumps", "en"), ("der braune fuchs springt", "de")]]
    asked = [(1000, "\U0001f600 \U0001f680\U0001f3fb 12 \u20dd", None), (1001, "\U0001d173\U000e0100 \U0001f1e9", None),
             (1002, "\U00010330\U00010331 \U00010332", None), (1003, "\U0001f600 fox", None), (1004, "\U00020000", None)]
    docs = spark.createDataFrame(learned + asked, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify_documents(docs).filter("doc_id >= 1000").collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001)] == [("und", 0)] * 2
    assert all(got[i]["lang_pred"] in ("en", "de") for i in (1002, 1003, 1004))
    assert {r["doc_id"] for r in langid.accepted(docs, 40).filter("doc_id >= 1000").collect()} == {1002, 1003, 1004}


def test_language_held_out_accuracy(spark, sf_dir):
    got = {r["doc_id"]: r for r in rows(spark, "op1_language_codes", sf_dir)}
    want = [(i, x) for i, x in table(sf_dir, "SELECT doc_id, lang FROM documents") if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == x for i, x in want) >= 0.97 * len(want)


def test_toxic_scores_rank_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in rows(spark, "op6_toxic_spans", folder)}
    held = [(got[i]["score"], t) for i, t in table(folder, "SELECT doc_id, toxic FROM labels") if got[i]["held_out"]]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9
    assert np.mean([s >= 0.7 for s in good]) < 0.005
    texts = dict(table(folder, "SELECT doc_id, text FROM documents"))
    for i, r in got.items():
        for span in r["spans"]:
            assert texts[i][span["start"]:span["stop"]].isalnum() and span["p"] > 0.5


def test_toxic_edges(spark, edge_dir):
    got = rows(spark, "op6_toxic_spans", edge_dir)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_sampled_texts_are_copies_only_if_alike():
    import random

    rng = random.Random(9)
    texts = [{int(600 * rng.random() ** 2) for _ in range(rng.randint(1, 60))} for _ in range(500)]
    texts += [{w if rng.random() < 0.8 else rng.randrange(600) for w in rng.choice(texts)} for _ in range(300)] + [set()] * 2
    rng.shuffle(texts)
    long = np.array([w % 4 > 0 for w in range(600)])
    kept, want = [], []
    for t in texts:
        mine = {w for w in t if long[w]}
        want.append(not any(2 * len(mine & k) >= len(mine | k) for k in kept if mine))
        if want[-1]:
            kept.append(mine)
    got = toxicity._once([np.array(sorted(t), np.int32) for t in texts], long)
    assert got.tolist() == want and 400 < sum(want) < 700


def test_near_duplicates_on_edges(spark, edge_dir):
    docs = table(edge_dir, "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL")
    sets = defaultdict(set)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] |= {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    for r in rows(spark, "op2_bbit_minhash", edge_dir):
        if r["doc_id"] is not None:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i), i


def test_estimate_follows_similarity():
    times, flip = near_dups._seeds()
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.75, 0.95):
        both = int(800 * share)
        pool = rng.integers(0, 1 << 63, 800 + 800 - both, np.uint64)
        a, b = pool[:800], pool[800 - both:]
        pa, pb = (near_dups.packed(near_dups.minima(x, times, flip)).view(np.uint64) for x in (a, b))
        x = pa ^ pb
        differ = sum(int(v).bit_count() for v in ((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)))
        got = (1 - differ / (near_dups.BANDS * near_dups.ROWS) - 0.25) / 0.75
        assert abs(got - both / len(pool)) < 0.14


def test_shards(spark, edge_dir, sf_dir):
    for folder in (edge_dir, sf_dir):
        got = rows(spark, "op4_consistent_hash_shards", folder)
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
        counts = [len(by.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1
        texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                        for i, t in table(folder, "SELECT doc_id, text FROM documents"))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts


def test_warc_edges(spark, edge_dir):
    pages = table(edge_dir, "SELECT page_id, html FROM pages")
    first = {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    import hashlib

    want = Counter()
    for i, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and h in first and i != first[h]
        if i is not None:
            want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
                  for r in rows(spark, "op5_warc_revisits", edge_dir) if r["page_id"] is not None)
    assert got == want


def test_warc_records_are_well_formed(spark, edge_dir, tmp_path):
    import gzip
    import pathlib

    warc.write_archives(spark.read.parquet(f"{edge_dir}/pages.parquet"), str(tmp_path / "w"), archive_bytes=1000)
    files = list(pathlib.Path(tmp_path / "w").glob("part-*"))
    found = [r for f in files for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(files) > 1 and len(found) == 13
    assert len({h["WARC-Record-ID"] for h, _ in found}) == 12  # one page comes twice
    assert all(("WARC-Refers-To" in h) == (h["WARC-Type"] == "revisit") for h, _ in found)


def test_packing(spark, edge_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = rows(spark, "op7_best_fit_packing", edge_dir)
    want, lengths = Counter(), Counter()
    for i, text in table(edge_dir, "SELECT doc_id, text FROM documents"):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, start, n, zlib.crc32(ids[start:start + n])] += 1
            lengths[n] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in filled.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(filled) == plain_best_fit(list(lengths.elements()), 1024)


MARKED = [
    "end <|endoftext|> next", "end<|endoftext|>next", "a  <|endoftext|>  b", "x.<|endoftext|>\n<|startoftext|>y",
    "<|startoftext|>", "Two <|endoftext|><|endoftext|>, (<|endoftext|>) é.", "<|ENDOFTEXT|> <|endof text|> <|endoftext|", "plain words"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_with_added_tokens_equal_whole_encoding(name):
    from tokenizers import Tokenizer

    from riskgraph.llm.tokens import PieceEncoder

    t, enc = Tokenizer.from_file(tokenizer_path(name)), PieceEncoder(tokenizer_path(name))
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in MARKED] == [t.encode(x, add_special_tokens=False).ids for x in MARKED]


def test_both_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    from riskgraph.llm import token_files

    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    for name, made in (("byte_bpe_50k.json", packing.pack_documents), ("word_bpe_49k.json", token_files.encode_documents)):
        t, got, start = Tokenizer.from_file(tokenizer_path(name)), {r["doc_id"]: r for r in made(docs, tokenizer_path(name)).collect()}, 0
        for i, x in enumerate(MARKED):
            ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
            assert got[i]["ids_crc32"] == zlib.crc32(ids)
            if name == "byte_bpe_50k.json":
                assert got[i]["length"] == len(ids)
            else:
                assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
            start += len(ids)


def plain_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_best_fit_plan_equals_one_by_one():
    import random

    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([5, 7, 16, 50])
        lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 70))]
        plan = packing.best_fit_decreasing(Counter(lengths), capacity)
        used = {p["sequence"] + k // p["each"] for p in plan for k in range(p["to"] - p["from"])}
        assert len(used) == plain_best_fit(lengths, capacity)
        assert sum(p["to"] - p["from"] for p in plan) == len(lengths)


def test_token_files(spark, edge_dir, tmp_path):
    from tokenizers import Tokenizer

    from riskgraph.llm import token_files

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = table(edge_dir, "SELECT doc_id, text FROM documents ORDER BY doc_id NULLS FIRST, text")
    ids = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")) for i, x in docs]
    got = rows(spark, "op10_token_files", edge_dir)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x)) for i, x in ids)
    start, starts = 0, {}
    for i, x in ids:
        starts.setdefault(i, start)
        start += len(x)
    for r in got:
        if r["doc_id"] not in (None, 213):
            assert r["start"] == starts[r["doc_id"]]
    for i in (None, 213):  # repeated ids stand beside each other in any order
        own = sorted((r["start"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        assert [s for s, _ in own] == [starts[i] + sum(n for _, n in own[:k]) for k in range(len(own))]
    path = str(tmp_path / "t")
    token_files.write_token_files(spark.read.parquet(f"{edge_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"), path, file_bytes=9000)
    wanted = spark.createDataFrame([(5,), (213,), (9999,), (None,), (-5,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(spark, path, wanted).collect()}
    plain = defaultdict(list)
    for i, x in ids:
        plain[i] += x.tolist()
    assert found == {i: plain[i] for i in (5, 213, -5)}


def test_perfect_hash_is_minimal():
    from riskgraph.llm.token_files import PerfectHash

    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_fingerprints(spark, edge_dir):
    import hashlib
    import re

    from riskgraph.llm.fingerprints import PIECE

    docs = table(edge_dir, "SELECT doc_id, coalesce(text, '') FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id")
    docs = [d for k, d in enumerate(docs) if k == 0 or d != docs[k - 1]]
    got = {r["doc_id"]: r for r in rows(spark, "op9_invertible_sketches", edge_dir)}
    prints = {}
    first = next((r["text"] for r in spark.read.parquet(f"{edge_dir}/documents.parquet").filter("doc_id IS NULL").selectExpr(
        "coalesce(text, '') text", "xxhash64(coalesce(text, '')) th").orderBy("th").collect()), docs[0][1])
    for k, (i, text) in enumerate(docs):
        if k + 1 < len(docs) and 213 in (i, docs[k + 1][0]):  # its rows are alike, so one of them follows the other
            after = text if i == 213 else docs[k + 1][1]
            if i == 213:
                continue
        else:
            after = docs[k + 1][1] if k + 1 < len(docs) else first
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, e, n = (set(re.findall(PIECE, x)) for x in (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for x, near in ((e, r["near_edited"]), (n, r["near_next"])):
            assert abs(near - (len(a & x) / len(a | x) if a | x else 1.0)) < 1e-9
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len({frozenset(re.findall(PIECE, t)) for t in prints})


def test_buckets_of_skewed_and_missing_ids(spark):
    import random

    from riskgraph.llm import fingerprints

    rng = random.Random(6)
    ids = [None] * 60 + [7] * 80 + [(s << 40) + k for s in (0, 3, 9) for k in range(40)] + [2**62, -(2**62)]
    docs = [(i, f"text {k} " * rng.randint(1, 4)) for k, i in enumerate(ids)]
    rows = fingerprints.ordered(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    assert len(rows) == len(docs) and len({r["bucket"] for r in rows}) >= 15
    assert max(Counter(r["bucket"] for r in rows).values()) <= 45
    by_place = sorted(rows, key=lambda r: (r["bucket"], r["pair"]))
    assert [r["at"] for r in by_place] == sorted(fingerprints.NO_ID if i is None else i for i in ids)
    assert all(r["next"] == by_place[(k + 1) % len(by_place)]["text"] for k, r in enumerate(by_place))


def test_pairs_that_stay_stuck_are_counted(spark, monkeypatch):
    import re

    from riskgraph.llm import fingerprints

    for name, value in (("TRIES", 1), ("LEAST_CELLS", 1), ("NEAR", 0.001), ("FAR", 0.001)):
        monkeypatch.setattr(fingerprints, name, value)
    texts = ["".join(f"Line {k * n % 50} is one of a document.\n" for k in range(40)) for n in (1, 3, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprint_documents(docs).collect()}
    a = [set(re.findall(fingerprints.PIECE, t)) for t in texts]
    for i in range(3):
        b = a[(i + 1) % 3]
        assert abs(got[i] - len(a[i] & b) / len(a[i] | b)) < 1e-9


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 1


def plain_line_dedup(docs):
    seen, out = [], {}
    for i, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            if len(line) < lines.LEAST_CHARS or not any(within_one(line, e) for e in seen):
                kept.append(line)
            if len(line) >= lines.LEAST_CHARS:
                seen.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_within_one_edit(spark):
    import random

    rng = random.Random(5)
    base = ["abcdefghijklmnopqrstuv", "thequickbrownfoxjumpsoverit", "a" * 25]

    def edit(x):
        at, c = rng.randrange(len(x) + 1), rng.choice("abx")
        return rng.choice([x[:at] + c + x[at:], x[:at] + x[at + 1:], x[:at] + c + x[at + 1:], x])

    docs = []
    for i in range(60):
        found = []
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(base) * rng.choice([1, 1, 40])
            for _ in range(rng.randint(0, 3)):
                line = edit(line)
            found.append(line)
        docs.append((i, "\n".join(found)))
    docs += [(60, docs[1][1]), (61, None)]
    got = lines.deduplicated_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_line_dedup(docs)


def plain_tiles(a, b, least):
    """Greedy string tiling on word lists by trying every match each time."""
    used_a, used_b, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(b)):
            for d in range(len(a)):
                n = 0
                while (d + n < len(a) and i + n < len(b) and a[d + n] == b[i + n] and d + n not in used_a and i + n not in used_b):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        used_a.update(range(d, d + n))
        used_b.update(range(i, i + n))
        covered += n


def test_tiling_equals_plain(spark):
    import random

    rng = random.Random(8)
    docs, items = [], [(k, " ".join(rng.choice("pqrst") for _ in range(rng.randint(3, 25)))) for k in range(6)]
    for i in range(25):
        parts = [" ".join(rng.choice("pqrst") for _ in range(rng.randint(0, 12))) for _ in range(2)]
        item = rng.choice(items)[1].split()
        at = rng.randrange(len(item))
        docs.append((i, " ".join([parts[0], *item[at:], parts[1], *item[:at]])))
    got = decontamination.coverage(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["at"], r["item_id"]): round(r["covered"] * len(items[r["item_id"]][1].split())) for r in got.collect()}
    for i, text in docs:
        for k, item in items:
            assert found.get((i, k), 0) == plain_tiles(text.split(), item.split(), decontamination.LEAST), (i, k)


def test_decontamination_edges(spark, edge_dir):
    got = {r["doc_id"]: r for r in rows(spark, "op3_string_tiling", edge_dir)}
    assert got[10]["contaminated"] and got[10]["item_id"] == 1 and got[10]["covered"] == 1.0 and got[10]["items"] == 2
    assert not any(r["contaminated"] for i, r in got.items() if i != 10)


def test_pairs_below_the_threshold_need_no_sets(spark, monkeypatch):
    import random

    held = {}

    def counted(df, name, stored=near_dups.stored):
        out = stored(df, name)
        held[name] = held.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dups, "stored", counted)
    close = []
    for n in (100, 200):
        rng = random.Random(3)
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts = []
        for _ in range(n):  # any two at similarity 0.65, about
            words = list(base)
            for at in rng.sample(range(300), 7):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        linked = texts[5].split()
        linked[0] = "other"
        texts.append(" ".join(linked))
        held.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_dups.duplicates(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((label[a], label[b]))
                    label = [x if v == y else v for v in label]
        assert got == dict(enumerate(label))
        close.append(held["close"])
    assert close[1] < 0.15 * 200 * 199 / 2, close
