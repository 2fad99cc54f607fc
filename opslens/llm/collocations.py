"""Phrase collocations by dynamic itemset counting: lengths are interleaved in cyclic scans of shards.

The texts are dealt into ``shards``, stored one by one.  Step t reads shard (t - 1) mod ``shards``.  Words are counted
from the first step on; a longer phrase becomes active at the end of the step in which both of its subphrases (all but the
last word, all but the first) have reached the threshold in what was counted of them so far, and is counted in the
``shards`` steps after that, one full cycle, which sees every shard once.  A phrase that completes its cycle below the threshold is
dropped, the others are final.  The scans end a cycle after the last activation.

Activations are kept as the step in which each hash bucket of a length first held a phrase at the threshold: a table that every
task gets, with ``buckets`` buckets for each GB of text.  Two phrases in one bucket can only start the longer one early: every
phrase still has a whole cycle of its own, so counts are exact, and a full table merely prunes nothing.

Between tasks counts travel as blobs: a row has all phrases of one language, length, first step and range of hashes, and their
counts.  A range is small enough for one task at any size of the corpus.  The most frequent words of the first step are written
as numbers of two bytes in longer phrases.

Words are 64-bit codes and a phrase is the bytes of its codes.  A last scan spells the words of all candidates; it sees
every word that has one of their codes, so it proves that no two words were taken for one, and everything is counted
anew with another function if they were.

Defined cases: A-Z is lower-cased; a null text counts as empty, a null ``lang`` as ``und``; texts without words give
nothing; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.store import cut, discard, parts_for, slices, store, text_bytes
from opslens.llm.words import U64, Words, mix, words
from opslens.sources.sinks import work_folder

SHARDS = 2
BUCKETS = 1 << 22
#: No more buckets a length than this, whatever the text: a task holds a quarter of a byte for each.
MOST_BUCKETS = 1 << 26
#: Text that a task turns into words at once; in memory it is about 40 times as large.
BATCH_BYTES = 2 << 20
#: Words whose phrases are counted at once, and text for each range of hashes.
HELD_WORDS = 1_000_000
PART_BYTES = 8 << 20
LEAST_PARTS = 64
#: Words that a task remembers as spelled.
SPELLED = 2_000_000
RANKED_A_TASK = 500_000
NEVER = 255
SEEDS = 8
CODE = 8
UNKNOWN = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
LONG = 64
_WEIGHTS = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_TIMES = U64(0xD6E8FEB86659FD93)
_WORDS = "code binary, word string"
_COUNTS = "part int, level int, start int, wide boolean, lang string, key binary, rare binary, c binary"
_OPEN, _FOUND, _REACHED, _HOT = range(4)
RARE = (1 << 16) - 1
_MERGED = f"kind int, {_COUNTS}, n long"


def _recoded(w: Words, seed: int) -> np.ndarray:
    """Word codes of another hash function, for texts in which two words share a code of the first one."""
    held: dict[bytes, int] = {}
    out = np.empty(len(w.starts), U64)
    for at, (s, e) in enumerate(zip(w.starts.tolist(), w.ends.tolist())):
        word = w.data[s:e].tobytes()
        if word not in held:
            held[word] = int.from_bytes(hashlib.blake2b(word, digest_size=CODE, key=str(seed).encode()).digest(), "little")
        out[at] = held[word]
    return out


def _coded(texts: pa.Array, seed: int) -> tuple[Words, np.ndarray]:
    """The words of the texts and their codes, none of them 0."""
    w = words(texts, lower=True, outside=_OUTSIDE)
    return w, np.maximum(_recoded(w, seed) if seed else w.codes, U64(1))


def _stream(w: Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all pieces with a 0 between two of them, and the text of each place."""
    fresh = np.zeros(len(codes) + 1, bool)
    fresh[np.searchsorted(w.starts, np.flatnonzero(_BREAK[w.data]))] = True
    fresh[w.first[:-1]] = True
    fresh[0] = False
    places = np.arange(len(codes)) + np.cumsum(fresh[:-1])
    out, of = np.zeros(int(places[-1]) + 1, U64), np.zeros(int(places[-1]) + 1, np.int64)
    out[places], of[places] = codes, w.document_of()
    return out, of


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of the hashes, as far as their upper bits tell, and those bits."""
    low = U64(max(1, len(hashes)).bit_length())
    ordered = (hashes >> low << low) | np.arange(len(hashes), dtype=U64)
    ordered.sort()
    return (ordered & ((U64(1) << low) - U64(1))).astype(np.int64), ordered >> low


def _differs(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), bool)
    out[:1] = True
    for column in columns:
        there = column[order]
        out[1:] |= there[1:] != there[:-1]
    return out


def _runs(columns: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which the rows of each distinct combination of the columns are one run, and where the runs begin."""
    order, upper = _by_hash(hashes)
    differs = _differs(columns, order)
    if (differs[1:] & (upper[1:] == upper[:-1])).any():  # two combinations share a hash
        order = np.lexsort(columns)
        differs = _differs(columns, order)
    return order, np.flatnonzero(differs)


def _grouped(columns: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of one row of each distinct combination of the columns, and how often it occurs."""
    order, first = _runs(columns, hashes)
    return order[first], np.diff(np.append(first, len(order)))


def _upper(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges, a power of two of them, a hash is in."""
    return (hashes >> U64(1)) >> U64(63 - (parts.bit_length() - 1))


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for s in langs], U64)


class Started:
    """The step that each bucket of each length became active in, as far as one step's scan needs it.

    Classes: 0 for a step so long ago that the cycle is over, 1 to ``shards`` for those since, ``shards`` + 1 for never; packed.
    """

    def __init__(self, active: np.ndarray, step: int, shards: int):
        self.buckets, self.any = active.shape[1], [int(row.min()) < step for row in active]
        self.bits = 2 if shards <= 2 else 4 if shards <= 14 else 8
        classes = np.array([shards + 1 if s >= step else max(0, s - (step - shards - 1)) for s in range(256)], np.uint8)
        each = 8 // self.bits
        self.packed = np.zeros((len(active), -(-self.buckets // each)), np.uint8)
        for level, row in enumerate(active):
            for at in range(0, self.buckets, 1 << 20):
                span = classes[row[at : at + (1 << 20)]]
                for j in range(each):
                    part = span[j::each]
                    self.packed[level, at // each : at // each + len(part)] |= part << np.uint8(self.bits * j)

    def classes(self, level: int, hashes: np.ndarray) -> np.ndarray:
        place = _upper(hashes, self.buckets).astype(np.int64)
        held = self.packed[level][place >> (8 // self.bits).bit_length() - 1]
        if self.bits < 8:
            held >>= (place & 8 // self.bits - 1).astype(np.uint8) * np.uint8(self.bits)
            held &= np.uint8((1 << self.bits) - 1)
        return held


class Hot:
    """Numbers of up to 65,535 words; ``RARE`` for every other one."""

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes)[:RARE]
        self.codes = np.append(codes, np.zeros(RARE + 1 - len(codes), U64))
        self.slots = np.full(1 << 18, RARE, np.uint16)
        self.slots[self._slot(codes)] = np.arange(len(codes))

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> U64(64 - 18)).astype(np.int64)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        out = self.slots[self._slot(codes)]
        out[self.codes[out] != codes] = RARE
        return out


def _blobs(
    level: int, start: int, langs: list[str], lang: np.ndarray, codes: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: int, hot: Hot
) -> Iterator[pa.RecordBatch]:
    """Counted phrases as a row for each language and range.  Counts take a byte, in wide rows eight."""
    for wide in (False, True):
        at = np.flatnonzero((counts > 255) == wide)
        if not len(at):
            continue
        group = (lang[at].astype(np.int64) * parts + part[at].astype(np.int64)).astype(U64)
        at = at[_by_hash(group << U64(64 - (len(langs) * parts).bit_length()))[0]]
        own = np.flatnonzero(_differs([lang, part], at))
        bounds, keys = np.append(own, len(at)), codes[at]
        numbers = np.stack([hot.numbers(keys[:, j]) for j in range(level)], axis=1) if level > 1 else np.full(keys.shape, RARE, np.uint16)
        rare = numbers == RARE
        before = np.append(0, np.cumsum(rare.sum(axis=1)))

        def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])

        yield pa.record_batch(
            {
                "part": pa.array(part[at[own]].astype(np.int32)),
                "level": pa.array(np.full(len(own), level, np.int32)),
                "start": pa.array(np.full(len(own), start, np.int32)),
                "wide": pa.array(np.full(len(own), wide)),
                "lang": pa.array(langs, pa.string()).take(pa.array(lang[at[own]])),
                "key": binary(numbers.ravel(), bounds * level) if level > 1 else pa.array([b""] * len(own), pa.binary()),
                "rare": binary(keys[rare], before[bounds]),
                "c": binary(counts[at].astype("<i8" if wide else np.uint8), bounds),
            }
        )


def _totals(langs: list[str], totals: np.ndarray) -> pa.RecordBatch:
    """The numbers of words of the languages, as rows of the empty phrase."""
    zero, none = pa.array(np.zeros(len(langs), np.int32)), pa.array([b""] * len(langs), pa.binary())
    counts = [int(n).to_bytes(CODE, "little") for n in totals]
    own = {"part": zero, "level": zero, "start": zero, "wide": pa.array([True] * len(langs)), "lang": pa.array(langs, pa.string())}
    return pa.record_batch(own | {"key": none, "rare": none, "c": pa.array(counts, pa.binary())})


def _counted(codes: np.ndarray, langs: list[str], lang: np.ndarray, step: int, shards: int, longest: int, started: Started, parts: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of all lengths that are active in this step; level 0 counts the words of a language.

    A phrase may come twice, if another one's hash is nearly the same.
    """
    if step <= shards:
        yield _totals(langs, np.bincount(lang[codes != 0], minlength=len(langs)))
    hashes, whole = mix(codes ^ _salts(langs)[lang]), codes != 0
    for k in range(1, longest + 1):
        if k > 1:
            n = len(codes) - k + 1
            if n <= 0 or not started.any[k - 2]:
                return
            began = started.classes(k - 2, hashes)
            began = np.maximum(began[:n], began[1 : n + 1])
            hashes = mix(hashes[:n] * _TIMES + codes[k - 1 :])
            whole = whole[:n] & (codes[k - 1 :] != 0)
            starts = [(step - shards - 1 + v, whole & (began == v)) for v in range(1, shards + 1) if step - shards - 1 + v >= 0]
        else:
            starts = [(0, whole)] if step <= shards else []
        for start, here in starts:
            at = np.flatnonzero(here)
            if not len(at):
                continue
            at = at[_by_hash(hashes[at])[0]]
            first = np.flatnonzero(_differs([codes[j:] for j in range(k)] + [lang], at))
            counts = np.diff(np.append(first, len(at)))
            at = at[first]
            keys = np.empty((len(at), k), "<u8")
            for j in range(k):
                keys[:, j] = codes[at + j]
            yield from _blobs(k, start, langs, lang[at], keys, counts, _upper(hashes[at], parts), parts, hot)


def _scan(seed: int, step: int, shards: int, longest: int, active, parts: int = 1, hot=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = active.value if isinstance(active.value, Started) else Started(active.value, step, shards)
        numbered = hot.value if hot else Hot(np.zeros(0, U64))
        codes, lang, langs, held = [], [], {}, 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal codes, lang, langs, held
            all_codes, all_lang = np.concatenate(codes)[:-1], np.concatenate(lang)[:-1]
            names = list(langs)
            codes, lang, langs, held = [], [], {}, 0
            for rows in _counted(all_codes, names, all_lang, step, shards, longest, started, parts, numbered):
                yield from slices(rows)

        for batch in batches:
            for rows in slices(batch, BATCH_BYTES):
                w, words_ = _coded(rows["text"], seed)
                if not len(words_):
                    continue
                column = rows["lang"].dictionary_encode()
                known = np.array([langs.setdefault(s, len(langs)) for s in column.dictionary.to_pylist()], np.int32)
                stream, of = _stream(w, words_)
                codes += [stream, np.zeros(1, U64)]
                lang += [known[column.indices.to_numpy()][of], np.zeros(1, np.int32)]
                held += len(stream)
                del w, words_, stream, of
                if held >= HELD_WORDS:
                    yield from counted()
        if held:
            yield from counted()

    return run


def _unpacked(table: pa.Table, level: int, hot: Hot) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and language, codes and count of every phrase of the rows."""
    names: dict[str, int] = {}
    lang, counts, numbers, rare = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], [np.zeros(0, "<u8")]
    for batch in table.to_batches():
        for name, wide, blob in zip(batch["lang"].to_pylist(), batch["wide"].to_pylist(), batch["c"]):
            counts.append(np.frombuffer(blob.as_buffer(), "<i8" if wide else np.uint8).astype(np.int64))
            lang.append(np.full(len(counts[-1]), names.setdefault(name, len(names)), np.int32))
        if level > 1:
            numbers += [np.frombuffer(x.as_buffer(), np.uint16) for x in batch["key"]]
        rare += [np.frombuffer(x.as_buffer(), "<u8") for x in batch["rare"] if len(x.as_buffer())]
    all_counts, codes = np.concatenate(counts), np.concatenate(rare)
    if level > 1:
        at = np.concatenate(numbers)
        held = hot.codes[at]
        held[at == RARE] = codes
        codes = held
    return list(names), np.concatenate(lang), codes.reshape(len(all_counts), level), all_counts


def _merge(step: int, shards: int, longest: int, least: int, buckets: int, parts: int, hot):
    """All counts of one range, length and first step: phrases that go on, those found, and the buckets that hold a frequent one."""
    schema = {"kind": pa.int32(), "part": pa.int32(), "level": pa.int32(), "start": pa.int32(), "wide": pa.bool_(), "lang": pa.string()}
    schema |= {"key": pa.binary(), "rare": pa.binary(), "c": pa.binary(), "n": pa.int64()}

    def rows(kind: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"kind": pa.array(np.full(size, kind, np.int32))}
        return pa.record_batch([(kinds | columns).get(name, pa.nulls(size, what)) for name, what in schema.items()], schema=pa.schema(schema))

    def run(table: pa.Table) -> pa.Table:
        part, level, start = (table[name][0].as_py() for name in ("part", "level", "start"))
        langs, lang, codes, counts = _unpacked(table, level, hot.value)
        hashes = _salts(langs)[lang]
        for j in range(level):
            hashes = mix(hashes * _TIMES + codes[:, j]) if j else mix(codes[:, j] ^ hashes)
        order, first = _runs([codes[:, j] for j in range(level)] + [lang], hashes << U64(parts.bit_length() - 1))
        counts, order = np.add.reduceat(counts[order], first), order[first]
        lang, codes, hashes = lang[order], codes[order], hashes[order]
        many = counts >= least
        out = []
        if start + shards > step:
            if level:
                blobs = _blobs(level, start, langs, lang, codes, counts, np.full(len(counts), part), parts, hot.value)
            else:
                blobs = [_totals([langs[x] for x in lang], counts)]
            out += [rows(_OPEN, len(b), **dict(zip(b.schema.names, b.columns))) for b in blobs]
        elif level == 0 or many.any():
            at = np.flatnonzero(many) if level else np.arange(len(counts))
            if level:
                width = CODE * level
                key = pa.Array.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(codes[at].tobytes())]).cast(pa.binary())
            else:
                key = pa.array([b""] * len(at), pa.binary())
            out.append(rows(_FOUND, len(at), lang=pa.array(langs, pa.string()).take(pa.array(lang[at])), key=key, n=pa.array(counts[at])))
        if step == level == 1:
            most = codes[np.argsort(-counts)[: max(1, RARE // parts)], 0]
            out.append(rows(_HOT, 1, key=pa.array([most.tobytes()], pa.binary())))
        if 1 <= level < longest and many.any():
            each = buckets // parts
            flags = np.zeros(each, bool)
            flags[_upper(hashes[many], buckets).astype(np.int64) - part * each] = True
            at = {"level": pa.array([level], pa.int32()), "n": pa.array([part * each], pa.int64())}
            out.append(rows(_REACHED, 1, key=pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), **at))
        return pa.Table.from_batches(out, schema=pa.schema(schema))

    return run


def _power(n: int) -> int:
    """The least power of two that is not below n."""
    return 1 << max(0, n - 1).bit_length()


def phrase_counts(
    spark: SparkSession, texts: DataFrame, longest: int = 3, least: int = 10, shards: int = SHARDS, buckets: int = BUCKETS, seed: int = 0
) -> DataFrame:
    """(lang, key, c) of all phrases of up to ``longest`` words with at least ``least`` occurrences.

    ``texts``: lang, text and the number of the shard.  ``key`` joins the 8-byte codes of the words; the empty key has the number
    of all words of the language.
    """
    if shards < 1 or longest * shards >= NEVER or buckets & (buckets - 1):
        raise ValueError("shards * longest must stay below 255 and buckets be a power of two")
    size = text_bytes(texts)
    buckets = max(buckets, min(MOST_BUCKETS, buckets * _power(parts_for(size, 1 << 30))))
    parts = min(buckets, max(LEAST_PARTS, _power(parts_for(size, PART_BYTES))))
    active = np.full((max(1, longest - 1), buckets), NEVER, np.uint8)
    running = spark.createDataFrame([], _COUNTS)
    finished: list[DataFrame] = []
    step, last = 0, 0
    hot = spark.sparkContext.broadcast(Hot(np.zeros(0, U64)))
    while step < last + shards:
        step += 1
        sent = spark.sparkContext.broadcast(Started(active, step, shards))
        shard = texts.where(F.col("shard") == (step - 1) % shards).select("lang", "text")
        fresh = shard.mapInArrow(_scan(seed, step, shards, longest, sent, parts, hot), _COUNTS)
        counts = running.unionAll(fresh).groupBy("part", "level", "start").applyInArrow(_merge(step, shards, longest, least, buckets, parts, hot), _MERGED)
        path = work_folder(spark, f"phrases-{step}")
        stored = store(counts, path, "kind")
        sent.destroy()
        if step > 1:
            discard(spark, f"{before}/kind={_OPEN}", f"{before}/kind={_REACHED}", f"{before}/kind={_HOT}")
        else:
            hot.destroy()
            most = [np.frombuffer(row["key"], "<u8") for row in stored.where(F.col("kind") == _HOT).select("key").collect()]
            hot = spark.sparkContext.broadcast(Hot(np.concatenate([*most, np.zeros(0, U64)])))
        before = path
        finished.append(stored.where(F.col("kind") == _FOUND).select("lang", "key", F.col("n").alias("c")))
        running = stored.where(F.col("kind") == _OPEN).select(*running.columns)
        if _activate(stored.where(F.col("kind") == _REACHED), active, step):
            last = step
    hot.destroy()
    return reduce(DataFrame.unionAll, finished)


def _activate(reached: DataFrame, active: np.ndarray, step: int) -> bool:
    """Set the buckets of phrases at the threshold that are new in this step; at most a bit a bucket comes here for each step begun."""
    changed = False
    for row in reached.select("level", "n", "key").collect():
        on = np.flatnonzero(np.unpackbits(np.frombuffer(row["key"], np.uint8), bitorder="little")) + row["n"]
        own = active[row["level"] - 1]
        new = on[own[on] == NEVER]
        own[new] = step
        changed |= bool(len(new))
    return changed


def _cuts(longest: int) -> list:
    """(cut, side, part of the key) of every way to cut a phrase."""
    out = []
    for k in range(1, longest):
        inside = F.length("key") > CODE * k
        for side, part in (("l", f"substring(key, 1, {CODE * k})"), ("r", f"substring(key, {CODE * k + 1})")):
            out.append(F.when(inside, F.struct(F.lit(f"{side}{k}").alias("which"), F.expr(part).alias("part"))))
    return out


def _scored(found: DataFrame, longest: int) -> DataFrame:
    """Candidates with the counts and the score of their weakest cut."""
    candidates = found.where(F.length("key") >= 2 * CODE).withColumnRenamed("c", "a")
    cuts = F.explode(F.filter(F.array(*_cuts(longest)), lambda x: x.isNotNull()))
    parts = candidates.select("lang", "key", "a", cuts.alias("cut")).select("lang", "key", "a", "cut.which", "cut.part")
    sizes = found.where((F.length("key") > 0) & (F.length("key") < longest * CODE)).select("lang", F.col("key").alias("part"), "c")
    names = [f"{side}{k}" for k in range(1, longest) for side in "lr"]
    wide = parts.join(sizes, ["lang", "part"]).groupBy("lang", "key", "a")
    wide = wide.agg(*[F.max(F.when(F.col("which") == n, F.col("c"))).alias(n) for n in names])
    exact = "cast({} as decimal(18, 0))"
    a = exact.format("a")
    ways = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                F.expr(f"(1000000BD * ({a} * {a})) div ({exact.format(f'l{k}')} * {exact.format(f'r{k}')})").alias("score"),
                F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, longest)
    ]
    weakest = F.least(*ways) if len(ways) > 1 else ways[0]
    return wide.select("lang", "key", "a", weakest.alias("cut")).select("lang", "key", "a", "cut.l", "cut.r", "cut.score")


def _outside_longer(scored: DataFrame, longest: int, percent: int) -> DataFrame:
    """Without the candidates that a longer candidate holds, most of whose occurrences are inside it."""
    insides = [
        F.when(F.length("key") == CODE * k, F.expr(f"substring(key, {CODE * at + 1}, {CODE * m})"))
        for k in range(3, longest + 1) for m in range(2, k) for at in range(k - m + 1)
    ]
    if not insides:
        return scored
    inside = scored.select("lang", F.explode(F.filter(F.array(*insides), lambda x: x.isNotNull())).alias("key"), F.col("a").alias("f"))
    most = inside.groupBy("lang", "key").agg(F.max("f").alias("f"))
    held = scored.join(most, ["lang", "key"], "left")
    return held.where(f"f is null or cast(f as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {percent}").drop("f")


def _codes(rows: DataFrame, longest: int) -> DataFrame:
    """lang, key, pos, code: the words of every key."""
    codes = F.array(*[F.when(F.length("key") > CODE * k, F.expr(f"substring(key, {CODE * k + 1}, {CODE})")) for k in range(longest)])
    return rows.select("lang", "key", F.posexplode(F.filter(codes, lambda x: x.isNotNull())).alias("pos", "code"))


def _places(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(codes) & U64(buckets - 1)).astype(np.int64)


def _marks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(np.frombuffer(b"".join(batch["code"].to_pylist()), "<u8"), buckets)
            bits = np.left_shift(np.int64(1), (at & 63).astype(np.int64))
            yield pa.record_batch({"word": pa.array(at >> 6), "bits": pa.array(bits)})

    return run


def _spellings(seed: int, wanted):
    """A task's words whose code has its bucket marked, each about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_sums = np.zeros(0, U64), np.zeros(0, U64)
        for batch in batches:
            for rows in slices(batch, BATCH_BYTES):
                w, codes = _coded(rows["text"], seed)
                hit = np.flatnonzero(wanted.value[_places(codes, len(wanted.value))]) if len(codes) else np.zeros(0, np.int64)
                long = w.ends[hit] - w.starts[hit] > LONG
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(_WEIGHTS[w.data], dtype=U64)])
                short = hit[~long]
                # short words are told apart by their code and a sum over their bytes, long ones by all of their bytes
                sums = sums[w.ends[short]] - sums[w.starts[short]]
                one, _ = _grouped([codes[short], sums], codes[short])
                one = one[np.argsort(codes[short[one]])]
                short, sums = short[one], sums[one]
                at = np.searchsorted(known, codes[short])
                there = np.minimum(at, max(0, len(known) - 1))
                new = (known[there] != codes[short]) | (known_sums[there] != sums) if len(known) else np.ones(len(short), bool)
                short, sums, at = short[new], sums[new], at[new]
                if len(known) > SPELLED:
                    known, known_sums, at = known[:0], known_sums[:0], at * 0
                known, known_sums = np.insert(known, at, codes[short]), np.insert(known_sums, at, sums)
                seen = np.concatenate([short, hit[long]])
                spelled = {(int(codes[h]), w.data[w.starts[h] : w.ends[h]].tobytes()) for h in seen.tolist()}
                keys = np.array([c for c, _ in spelled], "<u8")
                yield pa.record_batch({"code": pa.array([k.tobytes() for k in keys], pa.binary()), "word": pa.array([s.decode() for _, s in spelled], pa.string())})

    return run


def dictionary(texts: DataFrame, counted: DataFrame, longest: int, buckets: int, seed: int) -> DataFrame | None:
    """(code, word) of all codes in ``counted``; None if one of them stands for two words of the texts."""
    spark = texts.sparkSession
    buckets *= 4  # one bit each here
    needed = cut(_codes(counted, longest).select("code").distinct(), "phrase-words")
    marks = needed.mapInArrow(_marks(buckets), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    flags = np.zeros(max(1, buckets // 64), np.int64)
    flags[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(np.unpackbits(flags.view(np.uint8), bitorder="little")[:buckets].astype(bool))
    spelled = texts.select("text").mapInArrow(_spellings(seed, sent), _WORDS)
    both = spelled.join(needed, "code").groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("last"))
    held = cut(both, "word-codes")
    sent.destroy()
    return None if held.where("word <> last").take(1) else held.select("code", "word")


def _spelled(rows: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """The phrase of every key."""
    named = _codes(rows, longest).join(known, "code").groupBy("lang", "key").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
    return rows.join(named.select("lang", "key", F.concat_ws(" ", F.col("words.word")).alias("phrase")), ["lang", "key"])


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, shards: int = SHARDS, buckets: int = BUCKETS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language.

    ``docs``: columns text and lang.  ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the
    language; the score is floor(1000000 * a * a / (l * r)), in exact decimals.
    """
    spark = docs.sparkSession
    held = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    path = work_folder(spark, "text-shards")
    texts = store(held.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), path, "shard")
    for seed in range(SEEDS):
        found = phrase_counts(spark, texts, longest, least, shards, buckets, seed)
        scored = cut(_scored(found, longest), "scored-phrases")
        known = dictionary(texts, scored, longest, buckets, seed)
        if known is not None:
            break
    else:
        raise RuntimeError(f"no hash function of {SEEDS} tells all words apart")
    discard(spark, path)
    named = cut(_spelled(_outside_longer(scored, longest, inside_percent), known, longest).drop("key"), "named-phrases")
    # ranked in parts of a bounded size first, so that no language is one task
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(parts_for(named.count(), RANKED_A_TASK)))
    best = named.withColumn("salt", salt)
    for by in (["lang", "salt"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    totals = found.where(F.length("key") == 0).groupBy("lang").agg(F.sum("c").alias("n"))
    out = best.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same result for two and three words as SQL.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
single AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
counted AS (
  SELECT lang, 1 AS k, w[i] AS w1, '' AS w2, '' AS w3, count(*)::HUGEINT AS f FROM single GROUP BY ALL
  UNION ALL SELECT lang, 2, w[i], w[i + 1], '', count(*) FROM single WHERE i < len(w) GROUP BY ALL
  UNION ALL SELECT lang, 3, w[i], w[i + 1], w[i + 2], count(*) FROM single WHERE i + 1 < len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, f AS a FROM counted WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.*, 1 AS cut, l.f AS l, r.f AS r FROM candidates c
    JOIN counted l ON l.lang = c.lang AND l.k = 1 AND l.w1 = c.w1
    JOIN counted r ON r.lang = c.lang AND r.k = c.k - 1 AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.*, 2, l.f, r.f FROM candidates c
    JOIN counted l ON l.lang = c.lang AND l.k = 2 AND l.w1 = c.w1 AND l.w2 = c.w2
    JOIN counted r ON r.lang = c.lang AND r.k = 1 AND r.w1 = c.w3
  WHERE c.k = 3),
scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM candidates WHERE k = 3 UNION ALL SELECT lang, w2, w3, f FROM candidates WHERE k = 3)
  GROUP BY ALL),
named AS (
  SELECT w.lang, w.w1 || ' ' || w.w2 || CASE WHEN w.k = 3 THEN ' ' || w.w3 ELSE '' END AS phrase, w.a, w.l, w.r, w.score
  FROM weakest w LEFT JOIN inside i ON w.k = 2 AND i.lang = w.lang AND i.w1 = w.w1 AND i.w2 = w.w2
  WHERE i.f IS NULL OR 100 * i.f < 50 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM named JOIN totals USING (lang) QUALIFY rank <= 2000
"""
