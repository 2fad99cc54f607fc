import itertools
import random

import brute
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from opslens.llm import store
from opslens.llm.queries import QUERIES
from opslens.llm.store import table


def prose(rnd, n):
    return " ".join(f"{rnd.choice('bcdfgl')}{rnd.choice('aeiou')}{rnd.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, toxic ones, exact and near copies, a shared passage and a secret."""
    rnd = random.Random(11)
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    passage, secret = prose(rnd, 60), "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    for k in range(300):
        text = prose(rnd, 80)
        if k % 10 == 0:
            words = text.split()
            for _ in range(3):
                words.insert(rnd.randrange(80), rnd.choice(["idiot", "scum", "moron"]))
            text = " ".join(words)
        labels.append((k, int(k % 10 == 0)))
        rows.append([k, text, "en", "src", len(text)])
    rows[41][1] = rows[31][1]
    rows[42][1] = rows[31][1] + " one more"
    for k in (51, 61, 71):
        rows[k][1] = f"{prose(rnd, 30)} {passage} {prose(rnd, 100)}"
    for k in range(81, 99, 2):
        value = secret if k == 81 else "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        rows[k][1] = f'{prose(rnd, 20)} token = "{value}" {prose(rnd, 20)}'
    rows += [[1000, None, None, None, None], [1001, "", "en", "src", 0], [None, prose(rnd, 40), "en", "src", 1], list(rows[31]), list(rows[7])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, passage, secret


def test_stages_take_effect_and_keep_the_rest(spark, corpus):
    folder, rows, passage, secret = corpus
    docs, seen = table(spark, folder, "documents"), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("extra", F.lit(1)), folder)
        assert tuple(out.columns) == pipeline.COLUMNS
        seen[name] = [tuple(r) for r in out.collect()]
        docs = spark.createDataFrame(seen[name], "doc_id long, text string, lang string, source string, n_chars long")
    ids = {name: {r[0] for r in found} for name, found in seen.items()}
    everyone = {r[0] for r in rows}
    assert everyone - ids["toxicity"] == {k for k in range(0, 300, 10)}
    # near duplicates: brute force at 0.8 over what the first stage kept
    groups = brute.groups([r[:2] for r in seen["toxicity"]], 80)
    assert ids["minhash_near_dedup"] == {None if k == brute.LAST else k for k, c in groups.items() if k == c}
    assert len(seen["minhash_near_dedup"]) == len(ids["minhash_near_dedup"])  # repeated rows count once
    cut = {r[0]: r[1] for r in seen["substring_dedup"]}
    assert {i: " ".join((t or "").split()) for i, t in cut.items()} == {i: kept for i, _, _, kept in brute.repeats([r[:2] for r in seen["minhash_near_dedup"]])}
    assert passage in cut[51] and passage not in cut[61] and passage not in cut[71]
    last = {r[0]: r for r in seen["secret_scan"]}
    assert set(last) == ids["substring_dedup"] and secret not in last[81][1]
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in last.values())
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(last)
    whole = sorted((r["sequence_id"] is not None, r["length"], r["ids_crc32"]) for r in packed)
    assert whole == sorted((r["sequence_id"] is not None, r["length"], r["ids_crc32"]) for r in pipeline.run(spark, folder).collect())


@pytest.mark.parametrize(
    "at, left", [(0, ["numbered-documents", "toxic-rows"]), (1, ["duplicate-rows", "numbered-documents"]), (2, ["earlier-windows"])], ids=["toxicity", "near", "substring"]
)
def test_stages_leave_only_the_tables_that_their_result_reads(spark, corpus, tmp_path, monkeypatch, at, left):
    monkeypatch.setattr(store, "work_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{next(numbers)}")
    numbers = itertools.count()
    out = pipeline.STAGES[at][1](spark, table(spark, corpus[0], "documents"), corpus[0])
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == left
    assert out.count() > 200


def test_the_substring_stage_keeps_the_layout(spark, corpus):
    rnd = random.Random(3)
    shared = prose(rnd, 20)
    code = f"def f(x):\n    return x  # é\n\n{shared}\n\ttab"
    rows = [(1, code), (2, f"\n first line\n  {shared}\n\nlast\tline \n"), (3, shared.replace(" ", "\n")), (4, None), (5, " \n"), (6, f"é漢\n{shared}"), (7, code + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.substring_stage(spark, docs, corpus[0]).collect()}
    assert got == {1: code, 2: "\n first line\n  last\tline \n", 3: "", 4: None, 5: " \n", 6: "é漢\n", 7: "end"}


def test_rows_without_an_id_of_their_own_go_alone(spark, corpus):
    folder, rnd = corpus[0], random.Random(12)
    clean = [prose(rnd, 40) for _ in range(4)]
    toxic = f"{prose(rnd, 10)} idiot {prose(rnd, 10)} scum {prose(rnd, 10)} moron"
    rows = [(None, clean[0]), (None, clean[1]), (None, toxic), (2000, clean[2]), (2000, toxic), (2001, clean[1]), (None, clean[3]), (2000, clean[3])]
    docs = spark.createDataFrame([(i, t, "en", "own", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.toxicity_stage(spark, docs.unionByName(table(spark, folder, "documents")), folder).where("source = 'own'")
    order = lambda found: sorted(found, key=str)
    assert order((r["doc_id"], r["text"]) for r in left.collect()) == order(r for r in rows if r[1] != toxic)
    alone = [(None, clean[0]), (2000, clean[2]), (2001, clean[1]), (2000, clean[3])]
    assert order((r["doc_id"], r["text"]) for r in pipeline.near_duplicate_stage(spark, left, folder).collect()) == order(alone)


def test_the_pipeline_of_nothing(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels"):
        table(spark, folder, name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


CONTRACT = {
    "op1_chat_format": ["conv_id", "turn_no", "n_turns", "role", "rendered"],
    "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op8_secret_scan": ["doc_id", "start", "length", "value_sha256", "score", "is_secret"],
    "op9_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op10_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_cover_their_whole_tables(spark, small, name):
    frame = QUERIES[name](spark, small)
    assert frame.columns == CONTRACT[name]
    source = {"op1": "conversations", "op3": "embeddings", "op7": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    key = frame.columns[0]
    own = {"conversations": "conv_id", "embeddings": "vec_id", "pages": "page_id"}.get(source, "doc_id")
    ids = {r[0] for r in table(spark, small, source).select(own).collect()}
    got = {r[0] for r in frame.select(key).collect()}
    if name.startswith("op7"):
        ids = {i for i in ids if i % 20 == 0}
    assert got <= ids if name[:4] in ("op1_", "op8_") else got == ids
