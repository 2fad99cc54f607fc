import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opslens.llm import packing, substring
from opslens.llm.bpe import Replay, decode, encode, read_ranks
from opslens.llm.minhash import near_duplicates

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ordered(rows):
    return sorted(rows, key=lambda r: [brute.value(v) if not isinstance(v, str) else (False, v) for v in r])


@pytest.mark.parametrize("group_bytes", [1 << 24, 60_000])
def test_substring_dedup_is_exact(docs_of, odd_texts, group_bytes):
    got = substring.remove_repeats(docs_of(odd_texts), group_bytes=group_bytes, carry=("lang", "g"))
    assert got.columns == ["doc_id", "lang", "g", "n_words", "n_removed", "kept_text", "repeats"]
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert ordered(rows) == ordered(brute.repeats(odd_texts))


def test_substring_repeats_are_maximal_stretches(docs_of):
    text = " ".join(f"w{k}" for k in range(40))
    got = {r["doc_id"]: r["repeats"] for r in substring.remove_repeats(docs_of([(1, text), (2, f"x {text} y {text}")])).collect()}
    assert got == {1: [], 2: [[1, 41], [42, 82]]}


def test_a_group_of_documents_takes_little_memory_beside_its_text():
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(2)
    some = [f"{k:05d}" for k in range(50_000)]
    texts = [" ".join(rnd.choices(some, k=6_000)) for _ in range(200)]
    rows = pa.table({"g": [0] * 200, "doc_id": list(range(200)), "text": texts})
    none = pa.table({"g": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "checks": pa.array([], pa.binary())})
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        left = substring._finish(13, ("doc_id",), True)(rows, none)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert left["left_text"].to_pylist() == texts
    assert peak < 17 * size


def test_near_duplicates_are_the_brute_force_components(docs_of, odd_texts):
    got = near_duplicates(docs_of(odd_texts), percent=85).collect()
    expected = brute.groups(odd_texts, 85)
    assert len(got) == len(odd_texts)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(brute.shingles(t)) for _, t in odd_texts)
    for r in got:
        own = brute.LAST if r["doc_id"] is None else r["doc_id"]
        assert (brute.LAST if r["component_id"] is None else r["component_id"]) == expected[own]
        assert r["kept"] == (expected[own] == own)


def test_near_duplicates_of_repeated_ids_with_other_texts(docs_of):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (3, b), (9, a), (11, "alone")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {(5, 3, False), (3, 3, True), (9, 3, False), (11, 11, True)}


def test_a_chain_of_near_copies_and_a_crowded_node(docs_of, monkeypatch):
    import opslens.llm.minhash as minhash

    monkeypatch.setattr(minhash, "SMALL", 6)
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "THIN", 40)  # most nodes are large: branching and block pairs are used
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # neighbours differ in two words, the ends share nothing
        words = [*words[2:], f"n{k}a", f"n{k}b"]
        rows.append((1000 + k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(k, passage + " " + " ".join(f"r{rnd.random()}" for _ in range(20))) for k in range(60)]
    for depth in (1, 10):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), percent=85, depth=depth).collect()}
        assert got == brute.groups(rows, 85)


def test_pairs_beside_a_crowded_node_are_found(docs_of, monkeypatch):
    import opslens.llm.minhash as minhash

    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "THIN", 0)  # the nodes of the passage branch, those of a pair alone are small
    rnd = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(160):
        words = [f"d{k}w{j}" for j in range(60)]
        edited = list(words)
        edited[rnd.randrange(10, 50)] = "changed"
        rows += [(2 * k, f"{passage} {' '.join(words)}"), (2 * k + 1, f"{passage} {' '.join(edited)}")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), percent=85, depth=2).collect()}
    assert got == brute.groups(rows, 85)


def test_a_crowd_of_near_copies_that_are_no_links_costs_rows_in_proportion(docs_of, monkeypatch):
    import opslens.llm.minhash as minhash

    seen = []
    confirm = minhash._Search.confirm

    def spy(self, groups):
        seen.append(groups.distinct().count())
        return confirm(self, groups)

    monkeypatch.setattr(minhash._Search, "confirm", spy)
    monkeypatch.setattr(minhash, "CODES", 20_000)  # the crowd is dealt into parts that meet
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(130)]
    rows = []
    for k in range(600):  # two edits each: about 0.73 alike
        words = list(base)
        for at in rnd.sample(range(10, 120), 2):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
        if k % 20 == 0:  # a link of its own
            rows.append((1000 + k, " ".join(words[:-2])))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), percent=85).collect()}
    assert got == brute.groups(rows, 85)
    assert 0 < sum(seen) < 10 * len(rows)


def test_crowds_and_nodes_of_middle_size_do_not_branch(docs_of, monkeypatch):
    import opslens.llm.minhash as minhash

    seen = []
    level = minhash._level

    def spy(members, *rest):
        seen.append(members.count())
        return level(members, *rest)

    monkeypatch.setattr(minhash, "_level", spy)
    monkeypatch.setattr(minhash, "THIN", 0)
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(130)]
    crowd = []
    for k in range(300):  # two edits each: about 0.73 alike
        words = list(base)
        for at in rnd.sample(range(10, 120), 2):
            words[at] = f"e{k}x{at}"
        crowd.append((k, " ".join(words)))
        if k % 20 == 0:  # a link of its own
            crowd.append((1000 + k, " ".join(words[:-2])))
    passage = " ".join(f"p{k}" for k in range(40))
    middle = [(k, passage + " " + " ".join(f"d{k // 2}w{j}" for j in range(60 + k % 2))) for k in range(120)]
    for small, rows in ((8, crowd), (20, middle)):
        monkeypatch.setattr(minhash, "SMALL", small)
        seen.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), percent=85).collect()}
        assert got == brute.groups(rows, 85)
        assert len(seen) == 1 and sum(seen) < 20 * len(rows)


def test_packing_pieces_and_places(docs_of, odd_texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(docs_of(odd_texts), WORD_BPE, fan_in=20).collect()
    expected = []
    for i, t in odd_texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert ordered([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]) == ordered(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    bound = -(-sum(e[3] for e in expected) // 2048)
    assert len(sequences) <= bound * 1.02 + 1


def test_best_fit_uses_the_least_room():
    bins, places, fills = packing.best_fit(np.array([6, 5, 5, 4]), 10)
    assert fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 1, 0] and places.tolist() == [0, 0, 5, 6]


def test_bpe_matches_tiktoken_and_decodes_back(docs_of, odd_texts):
    import tiktoken

    ranks = read_ranks(BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in odd_texts if not t or len(t) < 250_000] + [(900, "<|endoftext|> it's  \n\n 12345 ‍👩‍👩‍👧"), (901, "ab" * 500)]
    encoded = encode(docs_of(rows), BYTE_BPE, public_tokenizers.PATTERN, with_ids=True).cache()
    expected = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        packed = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered([tuple(r) for r in encoded.drop("ids").collect()]) == ordered(expected)
    back = decode(encoded, BYTE_BPE).select("text").collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows)


def test_replay_goes_back_to_a_smaller_rank():
    # "bc" makes "abc" possible, which has a smaller rank than "bc": the second "bc" of a word waits for it
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cbc": 258}
    assert Replay(ranks).encode([b"abcbc", b"bcbc", b""]) == [[256, 257], [257, 257], []]


def _alone(ranks, word):
    """Ids of one word, the leftmost pair of smallest rank at a time."""
    parts = [word] if word in ranks else [bytes([b]) for b in word]
    while made := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        at = min(made)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def test_replay_of_any_vocabulary_gives_what_each_word_gives_alone():
    rnd = random.Random(12)
    for _ in range(60):
        tokens = sorted({bytes(rnd.choices(b"abc", k=rnd.randrange(2, 8))) for _ in range(rnd.randrange(60))})
        drawn = rnd.sample(range(1000), 256 + len(tokens))  # in no order, with gaps
        ranks = dict(zip([bytes([b]) for b in range(256)] + tokens, drawn))
        words = [bytes(rnd.choices(b"abc", k=rnd.randrange(30))) for _ in range(60)] + [b"a" * 101, b"", "ë".encode()]
        assert Replay(ranks).encode(words) == [_alone(ranks, w) if w else [] for w in words]
        assert Replay(ranks).encode([b""]) == [[]] and Replay(ranks).encode([]) == []


def test_replay_takes_steps_by_rank_and_not_by_merge():
    import sys

    replay, rnd, lines = Replay(read_ranks(BYTE_BPE)), random.Random(13), [0]

    def trace(frame, event, _):
        if not frame.f_code.co_filename.endswith("bpe.py"):
            return None
        lines[0] += event == "line"
        return trace

    seen = []
    for size in (2_000, 16_000):
        words = [bytes(rnd.choices(b"etaoin", k=10)) for _ in range(size)]
        lines[0], before = 0, sys.gettrace()
        sys.settrace(trace)
        try:
            replay.encode(words)
        finally:
            sys.settrace(before)
        seen.append((lines[0] - 2 * size) / size)  # but for reading and listing the words
    assert seen[1] < seen[0] / 3 and seen[1] < 10


def test_bpe_forgets_words_and_reads_in_pieces(monkeypatch):
    import pyarrow as pa
    from opslens.llm import bpe

    rnd = random.Random(14)
    texts = [" ".join("".join(rnd.choices("etaoiné", k=rnd.randrange(1, 9))) for _ in range(50)) for _ in range(60)]
    batch = pa.record_batch({"doc_id": list(range(60)), "text": texts})

    def rows():
        monkeypatch.setattr(bpe, "_words", {})
        made = bpe._encode(BYTE_BPE, public_tokenizers.PATTERN, True)(iter([batch, batch]))
        return [tuple(r.values()) for b in made for r in b.to_pylist()]

    whole = rows()
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 2_000)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 200)
    assert rows() == whole and len(whole) == 120
    assert len(bpe._words[BYTE_BPE].number) < 2_000


@pytest.mark.parametrize("run", [
    lambda d: substring.remove_repeats(d), lambda d: near_duplicates(d), lambda d: packing.pack(d, WORD_BPE),
    lambda d: encode(d, BYTE_BPE, public_tokenizers.PATTERN),
])
def test_empty_tables_give_no_rows(docs_of, run):
    assert run(docs_of([(1, "x")]).where(F.lit(False))).collect() == []


def test_the_encoder_remembers_a_bounded_number_of_bytes(monkeypatch):
    encoder = packing._Encoder(WORD_BPE)
    texts = [f"{'abcdefgh' * 500}{k} same words" for k in range(60)] + ["same words"]
    first = list(encoder.encode(texts))
    monkeypatch.setattr(packing, "REMEMBERED", 100_000)
    encoder = packing._Encoder(WORD_BPE)
    assert list(encoder.encode(texts)) == first
    held = sum(len(k) + len(v) for store in (encoder.known, encoder.older) for k, v in store.items())
    assert 0 < held <= 2 * 100_000 + 20_000
