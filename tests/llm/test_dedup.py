"""Exact dedup, near dedup, components: brute force on the edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from revkit.llm import components, exact_dedup, near_dedup
from revkit.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_groups(spark, docs):
    got = exact_dedup.assign(docs, exact_dedup.fresh_index(spark, 4)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("h")).collect()
    groups = defaultdict(list)
    for i, t in [(r.doc_id, r.text or "") for r in docs.collect()]:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i or 0))
    want = []
    for h, members in groups.items():
        best = min(members)
        want += [(None if n else i, None if best[1] else best[2], len(members), (c, n, i) == best, h) for c, n, i in members]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_drop_keeps_one_row_and_all_columns(spark, docs, none):
    out = exact_dedup.drop_copies(docs, exact_dedup.fresh_index(spark, 4))
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})
    assert exact_dedup.drop_copies(none, exact_dedup.fresh_index(spark, 4)).count() == 0


def test_exact_index_persists(spark, docs):
    index = exact_dedup.fresh_index(spark, 4)
    exact_dedup.drop_copies(docs, index)
    before = index.read().count()
    again = exact_dedup.DigestIndex.open(spark, index.name, index.location(), 4)
    fresh = spark.createDataFrame([(900, "quite new"), (901, docs.first().text)], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.assign(fresh, again).collect()}
    assert again.read().count() == before + 1
    assert got[900].kept and not got[901].kept and got[901].keep_id != 901
    plan = spark.table(index.name)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()


def sets(texts, n):
    low = {i: i + 32 for i in range(65, 91)}
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(pairs, n):
    """doc_id -> smallest id reachable; every pair compared."""
    ids = [i for i, _ in pairs]
    s = sets([t for _, t in pairs], n)
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not s[a] or not s[b]:
                continue
            both = len(s[a] & s[b])
            if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((find(ids[a]), find(ids[b])))
                up[y] = x
    return {i: find(i) for i in up}, s


def check_near(df, n=4):
    pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    comp, s = brute(pairs, n)
    want = sorted(repr((i, len(x), comp.get(i), i is None or comp[i] == i)) for (i, _), x in zip(pairs, s, strict=True))
    assert sorted(repr(tuple(r)) for r in near_dedup.components(df, shingle=n).collect()) == want


def test_near_edge_cases(docs):
    check_near(docs)


def test_near_sf(spark):
    check_near(spark.read.parquet(f"{SF}/documents.parquet"))
    check_near(spark.read.parquet(f"{SF}/documents.parquet"), 5)


def test_near_chain_and_blocks(spark, monkeypatch):
    """A long chain of edits (many links away from the hub), with tiny blocks so that the block plan runs."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(near_dedup, "HUB_ROWS", 2)
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 160])) for i in range(70)]
    other = [(500 + i, " ".join([*words[:60], *(f"x{i}_{k}" for k in range(60))])) for i in range(12)]
    check_near(spark.createDataFrame(chain + other, "doc_id long, text string"))


def test_near_second_level(spark, monkeypatch):
    """Every key of over three documents is split by further chunks; the result is the same."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(near_dedup, "SPLIT_BLOCKS", 1)
    monkeypatch.setattr(near_dedup, "FAIR_PART", 1)  # one more hub round only: much is left to the cells
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    rows = _shared_part(8, 90) + [(100 + i, t) for i, t in _shared_part(8, 89)] + [(200 + i, t) for i, t in _shared_part(4, 70)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def _shared_part(n, shared):
    """Documents of 100 words of which ``shared`` are the same."""
    rng = random.Random(n)
    common = [f"c{i}" for i in range(shared)]
    return [(k, " ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(100 - shared)])) for k in range(n)]


@pytest.mark.parametrize("equal", [0, 10])
def test_near_dealt_rows_follow_the_documents(spark, monkeypatch, equal):
    """One key that n unlinked documents share, their signatures otherwise apart
    (but for some equal values): twice the documents, about twice the rows in cells."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dedup, "SPLIT_BLOCKS", 1)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)

    def dealt(n):
        sig = np.random.default_rng(n).integers(0, 1 << 16, (n, 64)).astype(np.uint16)
        sig[:, 5 : 5 + equal] = np.arange(n)[:, None] // 8  # eight of a kind
        reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "id long, sig binary").cache()
        buckets = reps.selectExpr("7L as key", "0 as k", "-1L as hub", "id")
        return near_dedup.in_cells(buckets, spark.createDataFrame([], "id long, comp long"), reps).count()

    few, many = dealt(200), dealt(400)
    assert many <= 2.2 * few and many <= 400 * 120


def test_near_ids_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "other words here now then")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_near_drop(docs, none):
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 1 in kept and not kept & {2, 3, 4, 5, 6} and {7, 8, 9, 10, 13, None} <= kept and len(kept & {11, 12}) == 1
    assert near_dedup.drop_near_copies(none).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 50), (101, 100), (7, 7)]
    got = {r.id: r.comp for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50}


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_exact_dedup", "op7_quality_rules", "op8_license_scan"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))
