import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from opslens.llm import collocations as c

DOCS = "doc_id long, text string, lang string, key string, c long, start int"


def brute_collocations(rows, longest=3, least=10, top=2000, percent=50):
    by = {}
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            counts = by.setdefault(lang or "und" if lang is None else lang, Counter())
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in by.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        held = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * v >= percent * a for q, v in candidates.items())
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not inside:
                held.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(held)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def docs():
    rng = np.random.default_rng(8)
    word = [f"w{k}" for k in range(40)] + ["É", "漢字", "Mixed", "x" * 50]
    zipf = 1 / np.arange(1, len(word) + 1)
    texts = []
    for k in range(120):
        w = rng.choice(word, 60, p=zipf / zipf.sum())
        texts.append((" ".join(w[:30]) + rng.choice([". ", ",", "\n", "\x0b", " ; "]) + "\t".join(w[30:]), ["en", "de", None, "und"][k % 4]))
    texts += [("New York City is", "en")] * 25 + [("late phrase here", "en") if k % 9 == 8 else ("", "en") for k in range(200)]
    texts += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("a" * 300_000, "en"), ("to be or not to be to be " * 3000, "de")]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, lang, "a", 1, 2) for k, (t, lang) in enumerate(texts)], DOCS)


@pytest.mark.parametrize("settings", [{}, {"shards": 1}, {"shards": 5, "buckets": 1 << 6}, {"shards": 3, "longest": 4, "least": 5}, {"longest": 2}, {"top": 5}])
def test_collocations_equal_brute_force(spark, settings):
    texts = docs()
    expected = {k: v for k, v in settings.items() if k in ("longest", "least", "top")}
    assert sorted(map(tuple, c.collocations(frame(spark, texts).repartition(5), **settings).collect())) == brute_collocations(texts, **expected)


def test_collocations_equal_their_sql(spark):
    texts = [t for t in docs() if t[0] != ""]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(map(tuple, c.collocations(frame(spark, texts)).collect())) == sorted(db.execute(c.ORACLE).fetchall())


def test_longer_phrases_start_after_their_parts_and_run_one_cycle(spark, monkeypatch):
    """A phrase is counted from the step after both parts are frequent, in every shard once."""
    seen = []
    original = c._activate

    def watch(reached, active, step):
        before = active.copy()
        changed = original(reached, active, step)
        seen.append((step, [int((active[k] != before[k]).sum()) for k in range(len(active))]))
        return changed

    monkeypatch.setattr(c, "_activate", watch)
    texts = [("a b c", "en")] * 40
    texts = frame(spark, texts).selectExpr("lang", "text", "cast(doc_id % 4 as int) as shard")
    found = c.phrase_counts(spark, texts, least=10, shards=4)
    assert {(len(r["key"]) // 8, r["c"]) for r in found.collect()} == {(0, 120), (1, 40), (2, 40), (3, 40)}
    # ten rows a shard: words reach the threshold in step 1, pairs in step 2; triples start in step 3 and end in step 6
    assert seen[0] == (1, [3, 0]) and seen[1] == (2, [0, 2]) and seen[-1][0] == 6


def test_words_that_share_a_code_are_told_apart(spark, monkeypatch):
    texts = docs()[:60]
    real = c._coded

    def colliding(column, seed):
        w, codes = real(column, seed)
        if not seed:
            text = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
            codes = np.where([t in (b"w0", b"w1") for t in text], np.uint64(77), codes)
        return w, codes

    table = c.pa.array([t for t, _ in texts])
    w, first = real(table, 0)
    assert (real(table, 1)[1] != first).all()
    monkeypatch.setattr(c, "_coded", colliding)
    rows = frame(spark, texts).selectExpr("coalesce(lang, 'und') as lang", "text", "0 as shard")
    schema, sent = c._WORDS, spark.sparkContext.broadcast(np.ones(64, bool))
    batch = c.pa.RecordBatch.from_pylist([{"text": t} for t, _ in texts])
    words = [(r["code"], r["word"]) for b in c._spellings(0, sent)(iter([batch])) for r in b.to_pylist()]
    assert sorted(x for k, x in words if k == (77).to_bytes(8, "little")) == ["w0", "w1"]
    assert len(words) == len({x for _, x in words})
    # a code of two words asks for another function
    both = spark.createDataFrame(words, schema)
    monkeypatch.setattr(c, "_spellings", lambda seed, wanted: lambda batches: iter([c.pa.RecordBatch.from_pylist([{"code": k, "word": x} for k, x in words])]))
    counted = both.selectExpr("'en' as lang", "code as key").limit(500)
    assert c.dictionary(rows, counted, 1, 64, 0) is None


def test_counts_with_the_other_hash_function(spark, monkeypatch):
    real = c.dictionary
    monkeypatch.setattr(c, "dictionary", lambda texts, counted, longest, buckets, seed: None if seed == 0 else real(texts, counted, longest, buckets, seed))
    texts = docs()[:60]
    assert sorted(map(tuple, c.collocations(frame(spark, texts)).collect())) == brute_collocations(texts)


def test_two_phrases_with_one_hash_are_counted_apart():
    a = np.array([1, 2, 1, 2, 2], np.uint64)
    one, counts = c._grouped([a], np.zeros(5, np.uint64))
    assert sorted(zip(a[one].tolist(), counts.tolist())) == [(1, 2), (2, 3)]


def test_large_counts_score_exactly(spark):
    a, left, right = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    rows = [("en", b"A" * 8, left), ("en", b"B" * 8, right), ("en", b"A" * 8 + b"B" * 8, a), ("en", b"", left + right)]
    got = c._scored(spark.createDataFrame([(x, bytearray(y), z) for x, y, z in rows], "lang string, key binary, c long"), 2).collect()
    assert [r["score"] for r in got] == [10**6 * a * a // (left * right)]


def test_no_documents(spark):
    assert c.collocations(frame(spark, [])).collect() == []
    assert c.collocations(frame(spark, [(None, "en"), (" . ", "en")])).collect() == []


def test_a_scan_holds_a_small_part_of_a_batch_at_once():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 8000))
    batch = c.pa.RecordBatch.from_pylist([{"lang": "en", "text": text[k:] + text[:k]} for k in range(140)])
    everything = type("Sent", (), {"value": np.zeros((2, 1 << 12), np.uint8)})
    c.words(batch["text"].slice(0, 1))  # tables that the process keeps
    tracemalloc.start()
    sizes = [(b.num_rows, b.nbytes) for b in c._scan(0, 2, 2, 3, everything)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 7 << 20 and max(size for _, size in sizes) < 5 << 20 and peak < 12 * batch.nbytes


class Sent:
    def __init__(self, value):
        self.value = value


def test_partial_counts_leave_a_scan_as_few_rows():
    """A row for each language, length and range of hashes, not one for each phrase."""
    rng = np.random.default_rng(4)
    texts = [{"lang": lang, "text": " ".join(f"w{k}" for k in rng.integers(0, 5000, 20_000))} for lang in ("en", "de")]
    everything = Sent(np.zeros((2, 1 << 12), np.uint8))
    rows = sum(b.num_rows for b in c._scan(0, 2, 2, 3, everything)(iter([c.pa.RecordBatch.from_pylist(texts)])))
    assert rows <= 2 * 3 * 2 + 2


def test_counts_of_two_scans_merge_exactly():
    """Many languages, counts beyond a byte, words with and without a number, several ranges."""
    rng = np.random.default_rng(5)
    texts = [(f"l{k}", "very common words " * 200 + " ".join(f"w{x}" for x in rng.integers(0, 60, 90))) for k in range(300)] + [("l0", "very common words " * 400)]
    expected = Counter()
    for lang, text in texts:
        w = text.split()
        expected.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    table = c.pa.table({"text": [t for _, t in texts], "lang": [x for x, _ in texts]})
    w, codes = c._coded(table["text"], 0)
    word = {int(code): w.data[a:b].tobytes().decode() for code, a, b in zip(codes, w.starts, w.ends)}
    hot = Sent(c.Hot(np.array([code for code, x in word.items() if x in ("very", "words", "w7")], np.uint64)))
    everything, parts = Sent(np.zeros((2, 1 << 12), np.uint8)), 4
    halves = [table.slice(0, 150).to_batches(), table.slice(150).to_batches()]
    made = c.pa.Table.from_batches([b for half in halves for b in c._scan(0, 2, 2, 3, everything, parts, hot)(iter(half))])
    found, frequent = Counter(), [set(), set()]
    for key in set(zip(*(made[name].to_pylist() for name in ("part", "level", "start")))):
        own = made.filter(c.pa.compute.and_(c.pa.compute.equal(made["part"], key[0]), c.pa.compute.equal(made["level"], key[1])))
        for open_at, step in ((2, 2), (1, 3)):  # done in step 2; else carried on and merged with itself
            merged = c._merge(open_at, 2, 3, 1, 1 << 12, parts, hot)(own)
            if open_at == 1:
                carried = merged.filter(c.pa.compute.equal(merged["kind"], c._OPEN)).select(own.schema.names)
                merged = c._merge(step, 2, 3, 1, 1 << 12, parts, hot)(c.pa.concat_tables([carried, carried]))
            for row in merged.to_pylist():
                if row["kind"] == c._FOUND and row["key"]:
                    found[open_at, row["lang"], *(word[int(x)] for x in np.frombuffer(row["key"], "<u8"))] += row["n"]
                if row["kind"] == c._REACHED:
                    bits = np.unpackbits(np.frombuffer(row["key"], np.uint8), bitorder="little")
                    frequent[row["level"] - 1].update((np.flatnonzero(bits) + row["n"]).tolist())
    assert {k[1:]: v for k, v in found.items() if k[0] == 2} == expected
    assert {k[1:]: v for k, v in found.items() if k[0] == 1} == {k: 2 * v for k, v in expected.items()}
    salt = dict(zip(("l0",), c._salts(["l0"])))
    h = c.mix(codes[:1] ^ salt["l0"])
    assert int(c._upper(h, 1 << 12)[0]) in frequent[0] and all(0 <= x < 1 << 12 for x in frequent[0] | frequent[1])


def test_started_tells_the_steps_of_the_cycle():
    for shards in (1, 2, 3, 20):
        step, buckets = shards + 6, 64
        active = np.array([[k if k < step else c.NEVER for k in range(buckets)]], np.uint8)
        places = np.arange(buckets, dtype=np.uint64) << np.uint64(58)
        got = c.Started(active, step, shards).classes(0, places).tolist()
        assert got == [shards + 1 if k >= step else max(0, k - (step - shards - 1)) for k in range(buckets)]


def test_buckets_and_ranges_grow_with_the_text(spark, monkeypatch):
    """A table of one size would be full on a large corpus and let every phrase start."""
    seen, original = [], c._activate
    monkeypatch.setattr(c, "_activate", lambda reached, active, step: (seen.append(active.shape), original(reached, active, step))[1])
    monkeypatch.setattr(c, "text_bytes", lambda rows: 5 << 30, raising=False)
    texts = frame(spark, docs()[:20]).selectExpr("coalesce(lang, 'und') as lang", "text", "0 as shard")
    c.phrase_counts(spark, texts, longest=2, shards=1, buckets=64)
    assert seen[0] == (1, 512)


def test_a_task_spells_a_word_once():
    batch = c.pa.RecordBatch.from_pylist([{"text": "one two three " * 200_000}])
    rows = [r for b in c._spellings(0, Sent(np.ones(64, bool)))(iter([batch, batch])) for r in b.to_pylist()]
    assert sorted(r["word"] for r in rows) == ["one", "three", "two"]
