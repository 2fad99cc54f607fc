import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import chat, embedding_dedup, nearest
from opslens.llm.components import components

TURNS = "conv_id long, turn long, role string, text string, pos int, conv string"
VECTORS = "vec_id long, embedding array<float>, label int, vec string, row int"


def conversations(spark):
    rows = []

    def log(conv, *texts):
        rows.extend((conv, k, "user" if k % 2 == 0 else "assistant", t, 0, "x") for k, t in enumerate(texts))

    log(1, "hi", "hello")
    log(2, "hi", "hello", "bye")
    log(3, "hi", "hello", "bye", "ok")
    log(4, "hi", "hello", "bye", "ok")
    log(5, "hi", "other")
    log(6, "", None)
    log(7, None)
    log(8, "")
    log(9, *[f"t{k}" for k in range(300)])
    log(10, *[f"t{k}" for k in range(299)])
    log(11, *[f"t{k}" for k in range(150)], "else")
    rows += [(12, 0, None, "x", 0, ""), (12, 0, None, "x", 0, ""), (12, None, "user", "late", 0, ""), (None, 0, "user", "lost", 0, ""), (13, 0, "user", "lost", 0, "")]
    return rows


@pytest.mark.parametrize("slice_rows", [50, 100_000])
def test_chat_keeps_maximal_conversations(spark, slice_rows):
    rows = conversations(spark)
    got = chat.format_chats(spark.createDataFrame(rows, TURNS), slice_rows).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    # the oracle knows no null ids: that conversation equals number 13, which stays
    expected = db.execute(chat.ORACLE.replace("FROM conversations", "FROM conversations WHERE conv_id IS NOT NULL")).fetchall()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert {r["conv_id"] for r in got} == {3, 5, 6, 7, 9, 11, 12, 13}  # 8 is how 6 begins


def test_chat_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame(conversations(spark), TURNS).where(F.lit(False))).collect() == []


def vectors():
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((300, 24))
    near = base[0] + 0.03 * rnd.standard_normal((120, 24))
    edge = base[1] * 3 + 0.9 * rnd.standard_normal((80, 24))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate([*base, *near, *edge])]
    rows += [(1000 + k, rows[7][1]) for k in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] + [1.0] * 23), (2004, [math.nan] + [1.0] * 23), (2005, [math.inf] + [1.0] * 23)]
    rows += [(2006, [1.0, 2.0]), (2020, [2.0, 4.0]), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1]), (2040, [-v for v in rows[9][1]])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links_match_brute_force(spark, block):
    rows = vectors()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(frame(spark, rows), 0.95, block).collect()), key=str)
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            v, w = rows[a][1], rows[b][1]
            if fine(v) and fine(w) and len(v) == len(w):
                v, w = np.array(v), np.array(w)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    big = 2**63 - 1
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), big), big if i is None else i)
    expected = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)]
        expected.append((i is None, i or 0, links[k], None if c == big else c, c == (big if i is None else i)))
    assert got == sorted(expected, key=str)


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(1)
    unit = rnd.standard_normal((400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ embedding_dedup.rotation(64, 0).T
    found, bound = embedding_dedup.estimates(turned, turned)
    error = found - unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.005 and (np.abs(error)[off] <= np.broadcast_to(bound[:, None], error.shape)[off]).mean() > 0.999


def test_nearest_recall_ties_and_odd_vectors(spark):
    rows = vectors()
    got = {}
    for r in nearest.nearest_vectors(frame(spark, rows), every=20, shard=200, queries=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = wanted = 0
    for i, v in rows:
        if i is None or i % 20 or not fine(v):
            continue
        v = np.array(v)
        scores = [(-float(np.dot(v, np.array(w))), j is None, j or 0) for j, w in rows if fine(w) and len(w) == len(v) and j != i]
        best = sorted(scores)[:20]
        mine = sorted(got.get(i, []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        edge = -best[-1][0]
        hits += sum(m[2] >= edge - 1e-9 for m in mine)
        wanted += len(best)
    assert hits >= 0.9 * wanted
    # equal vectors come in the order of their ids, the null id last
    for mine in got.values():
        for a, b in zip(sorted(mine), sorted(mine)[1:]):
            assert a[2] > b[2] or (a[1] is not None and (b[1] is None or a[1] <= b[1]))


@pytest.mark.parametrize("run", [embedding_dedup.near_vectors, nearest.nearest_vectors])
def test_no_vectors(spark, run):
    assert run(frame(spark, [(1, [1.0])]).where(F.lit(False))).collect() == []


def test_components_of_chains_stars_and_nothing(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 400)] + [(7, 7), (8, 9), (9, 8)]
    rnd.shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(200, 400)]} | {8: 8, 9: 8}
    for part in (3, 40):
        again = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), part=part).collect()}
        assert again == got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
