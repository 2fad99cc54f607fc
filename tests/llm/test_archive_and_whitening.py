import gzip
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import warc, whitening
from opslens.sources.sinks import work_folder

PAGES = "page_id long, url string, html string, row long, size long, shard long, position long"
VECTORS = "vec_id long, embedding array<float>, x string, d int, n long"


def pages(spark):
    long_text = "".join(random.Random(3).choice("abcdef <>é") for _ in range(400_000))
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/ x\r\nEvil: 1", "<p>one</p>"), (5, "u", long_text)]
    rows += [(6, "u", "line\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "<p>one</p>"), (None, "n", "nobody's"), (None, "n", "nobody's"), (7, "漢字", "漢字 🎉")]
    rows += [(100 + k, "http://hot/", "the same page") for k in range(60)] + [(200 + k, f"http://b/{k}", f"<p>{k}</p>" * 50) for k in range(40)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], PAGES), rows


def archive(spark, frame, **settings):
    folder = work_folder(spark, "warc")
    return folder, warc.write_warc(frame, folder, **settings)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "file_bytes": 1500}])
def test_archive_holds_every_page_and_reads_back(spark, sizes):
    frame, rows = pages(spark)
    folder, manifest = archive(spark, frame, **sizes)
    got = warc.read_warc(spark, folder, payload=True)
    back = [(r["page_id"], r["html"]) for r in warc.restored(got).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(back, key=key) == sorted(((i, h or "") for i, _, h in rows), key=key)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == got.select("record_id").distinct().count()
    # the last page of equal payloads answers for the others
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()}
    assert {(3, "response", None), (2, "revisit", 3), (6, "response", None), (1, "revisit", 6), (4, "revisit", 6)} <= kinds
    assert {(159, "response", None), (100, "revisit", 159), (None, "response", None), (None, "revisit", None)} <= kinds
    files = [r["name"] for r in manifest.collect()]
    assert len(files) == 1 if not sizes else len(files) > 5
    assert not [p for p in (warc.pafs.FileSystem.from_uri(folder)[0].get_file_info(warc.pafs.FileSelector(folder))) if "_temporary" in p.path]


def test_archive_bytes_do_not_depend_on_partitions(spark):
    frame, _ = pages(spark)
    frame = frame.where("page_id is not null")
    made = []
    for parts in (1, 7):
        _, manifest = archive(spark, frame.repartition(parts), shard_bytes=3000, file_bytes=1500)
        made.append(sorted((r["name"], r["records"], r["bytes"], r["sha1"]) for r in manifest.collect()))
    assert made[0] == made[1]


def test_files_roll_by_compressed_size_and_are_plain_gzip(spark):
    frame, _ = pages(spark)
    folder, manifest = archive(spark, frame, file_bytes=2000)
    rows = sorted(manifest.collect(), key=lambda r: r["seq"])
    assert all(r["bytes"] >= 2000 for r in rows[:-1]) and {r["shard"] for r in rows} == {0}
    text = gzip.open(f"{folder}/{rows[0]['name']}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
    assert b"\r\nEvil: 1" not in text  # an url cannot add headers


def test_committing_twice_and_small_payloads(spark):
    frame, _ = pages(spark)
    folder, manifest = archive(spark, frame, revisit_from=11, shard_bytes=300)
    kinds = {(r["page_id"], r["record_type"]) for r in warc.read_warc(spark, folder).collect()}
    assert {(1, "response"), (2, "response"), (100, "revisit")} <= kinds
    # copies of a short payload under one page id, which several shards share
    short = spark.createDataFrame([(5, str(k), "0123456789", 0, 0, 0, 0) for k in range(200)], PAGES)
    own, _ = archive(spark, short, revisit_from=11, shard_bytes=100)
    got = warc.read_warc(spark, own, payload=True).collect()
    assert len(got) == 200 and {(r["record_type"], r["html"]) for r in got} == {("response", "0123456789")}
    rows = manifest.withColumn("temporary", F.lit("_temporary/gone")).collect()
    batch = warc.pa.RecordBatch.from_pylist([r.asDict() for r in rows], warc._schema())
    assert list(warc._moved(folder)(iter([batch])))  # a repeated commit finds its files


def test_damage_is_found(spark):
    frame, _ = pages(spark)
    folder, manifest = archive(spark, frame.where("page_id = 1"))
    path = f"{folder}/{manifest.first()['name']}"
    member = list(warc.members(open(path, "rb")))[1]
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(member.replace(b"one", b"two"))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.members(__import__("io").BytesIO(open(path, "rb").read()[:-9])))


def test_an_archive_without_pages(spark):
    frame, _ = pages(spark)
    folder, manifest = archive(spark, frame.where("false"))
    assert manifest.count() == 0 and warc.read_warc(spark, folder).count() == 0


def test_archive_query_equals_its_sql(spark, small):
    from opslens.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    key = lambda r: [v if v is not None else -1 for v in r]
    assert sorted(map(key, QUERIES["op11_warc"](spark, small).collect())) == sorted(map(key, db.execute(ORACLES["op11_warc"]).fetchall()))


# --- whitening -------------------------------------------------------------------------------------------------


def brute_whitening(vectors, components=16):
    """(vec_id, deviation, whitened up to sign, explained) by numpy's own eigenvectors."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums)])
    m = np.array([centre(x) for x in fit])
    values, axes = np.linalg.eigh(m.T @ m / n)
    order = [k for k in np.argsort(-values) if values[k] > 1e-9 * values.max()][:components]
    out = {}
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.setdefault(i, []).append((dev, [abs(float(centre(x) @ axes[:, k]) / math.sqrt(values[k])) for k in order]))
    return n, out, [float(values[k] / values.sum()) for k in order]


def vectors(count=300, dims=20, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, dims)) * np.linspace(3, 0.2, dims)
    rows = [(k, [float(c) for c in base[k]]) for k in range(count)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # a third of all rows is one vector
    rows += [(2000, None), (2001, [float("nan")] * dims), (2002, [None] + [1.0] * (dims - 1)), (2003, [float("inf")] * dims), (2004, []), (2005, [0.0] * dims), (None, rows[0][1]), (7, rows[9][1])]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], VECTORS)


@pytest.mark.parametrize("rows_a_task", [200_000, 40])
def test_whitening_equals_brute_force(spark, rows_a_task):
    rows = vectors()
    n, expected, explained = brute_whitening(rows)
    got = whitening.whiten(table_of(spark, rows), rows_a_task=rows_a_task).collect()
    assert len(got) == 16 * sum(map(len, expected.values()))
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], int(r["deviation"])), {})[r["component"]] = abs(r["whitened"])
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    assert set(found) == {(i, dev) for i, held in expected.items() for dev, _ in held}
    for i, held in expected.items():
        for dev, white in held:
            assert np.allclose([found[i, dev][k] for k in range(1, 17)], white, rtol=1e-7, atol=1e-8)


def test_whitening_of_few_directions(spark):
    flat = [(k, [float(k % 7), 2.0 * (k % 7), 5.0]) for k in range(50)]
    got = whitening.whiten(table_of(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {7} and abs(got[0]["explained"] - 1) < 1e-12
    for rows in ([], [(1, [1.0, 2.0])] * 9, [(1, None)]):
        assert whitening.whiten(table_of(spark, rows)).collect() == []


def test_large_numbers_stay_exact():
    x = np.array([[2**61, 3], [2**60 + 1, 5]], np.int64)
    sums = [2**61 + 2**60 + 1, 8]
    assert whitening.deviations(x, 2, sums) == [(2 * 2**61 - sums[0]) ** 2 + 4, (2 * (2**60 + 1) - sums[0]) ** 2 + 4]


CASES = {
    "graded": lambda g: g.standard_normal((500, 40)) * np.logspace(0, -6, 40),
    "clusters": lambda g: (np.linalg.qr(g.standard_normal((40, 40)))[0] * np.array([10.0] * 5 + [1.0] * 35)) @ np.linalg.qr(g.standard_normal((40, 40)))[0],
    "identity": lambda g: np.eye(12),
    "deficient": lambda g: g.standard_normal((100, 3)) @ g.standard_normal((3, 20)),
    "ones": lambda g: np.ones((30, 6)),
    "wilkinson": lambda g: np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11)) + 12.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
    "one": lambda g: g.standard_normal((9, 1)),
    "nothing": lambda g: np.zeros((4, 4)),
}


@pytest.mark.parametrize("name", CASES)
def test_singular_values_and_directions(name):
    r = np.linalg.qr(CASES[name](np.random.default_rng(5)), mode="r")
    d = r.shape[1]
    values, axes = whitening.principal_directions(r)
    expected = np.append(np.linalg.svd(r, compute_uv=False), np.zeros(d))[:d] ** 2
    top = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-13 * top
    held = expected > 1e-13 * top
    assert np.allclose(values[held], expected[held], rtol=1e-9)
    assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-11
    assert np.abs(r.T @ (r @ axes) - axes * values).max() <= 1e-12 * top


def test_dqds_keeps_tiny_values():
    # the product of a graded matrix's values is known exactly: its determinant
    a, b = np.array([2.0**-k for k in range(0, 60, 2)]), np.array([2.0**-k for k in range(0, 58, 2)])
    values = whitening.squared_singular_values(a, b)
    assert math.isclose(np.log2(values).sum(), 2 * np.log2(a).sum(), rel_tol=1e-12)
