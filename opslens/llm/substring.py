"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK = (window + 1) / 2 words, the reference
index.  Each run of ``window`` words holds exactly one block of its own document whole, so a repeated run
shows up as a rolling BLOCK-word probe of the later document that meets an indexed block of the earlier
one.  Three steps, each over groups of documents (by a hash of the id, sized by ``group_bytes``):

1. blocks and rolling probes go, as sorted difference-coded sets, to the bucket of their hash; a bucket
   answers each group with the block codes that two documents share and at least one has as a block;
2. hits are extended: only runs around a hit are hashed as whole windows (96 bits) and sent, with the
   smallest document of the group; the bucket answers which of them some smaller document of another
   group holds;
3. windows that start in a smaller document are marked, overlapping ones join into maximal repeats.

A block in every third document is one code per group, never a list of pairs.

Defined cases: a null text has no words; a null ``doc_id`` counts as larger than every id; rows that
repeat a ``doc_id`` are documents of their own, none smaller than the other; an empty table gives no
rows.  Other columns are ignored by name.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import NO_ID, cut, parts_for, passing, release, text_bytes
from opslens.llm.words import U64, Words, gather, spread, steps, unsteps, words

WINDOW = 13
GROUP_BYTES = 10 << 20
_FINE = U64(40)
_MASK = U64((1 << 40) - 1)


def _batches(rows: pa.Table) -> tuple[pa.Table, Words, np.ndarray]:
    """A group in id order, with its words and the id of each document."""
    rows = rows.sort_by("doc_id")
    return rows, words(rows["text"]), rows["doc_id"].to_numpy().astype(np.int64)


def _coded(rows: pa.Table) -> tuple[Words, np.ndarray]:
    """The words of a group in id order without their texts and places, and the id of each document."""
    _, w, ids = _batches(rows.select(["doc_id", "text"]))
    none = np.zeros(0, np.int64)
    return Words(w.codes, w.first, np.zeros(0, np.uint8), none, none), ids


def _blocks(w: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, code and "is an indexed block" of every rolling probe."""
    at = w.whole(block)
    inside = at - np.repeat(w.first[:-1], np.diff(w.first))[at]
    return at, w.windows(block)[at], inside % block == 0


def _split(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes >> _FINE) % U64(buckets)).astype(np.int64)


def _announce(block: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        group = rows["g"][0].as_py()
        w, ids = _coded(rows)
        at, codes, indexed = _blocks(w, block)
        owner = ids[w.document_of()[at]]
        del w, at
        out = []
        bucket = _split(codes, buckets)
        order = np.lexsort((codes & _MASK, bucket))
        bucket, codes, owner, indexed = bucket[order], codes[order] & _MASK, owner[order], indexed[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        if len(first):
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            marked = (codes[first] << U64(2)) | (several.astype(U64) << U64(1)) | np.maximum.reduceat(indexed, first).astype(U64)
            edges = np.searchsorted(bucket[first], np.arange(buckets + 1))
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    out.append((b, group, steps(marked[edges[b] : edges[b + 1]])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.binary()))], ["b", "g", "codes"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """The codes of a bucket that two documents hold, one of them as a block; per group."""
    parts = [unsteps(x.as_py()) for x in rows["codes"]]
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    marked = np.concatenate(parts)
    order = np.argsort(marked >> U64(2), kind="stable")
    marked, source = marked[order], source[order]
    codes = marked >> U64(2)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    size = np.diff(np.append(first, len(codes)))
    shared = (size > 1) | (np.maximum.reduceat((marked >> U64(1)) & U64(1), first) > 0)
    shared &= np.maximum.reduceat(marked & U64(1), first) > 0
    keep = np.repeat(shared, size)
    codes, source = codes[keep], source[keep]
    out = [(rows["g"][i].as_py(), rows["b"][i].as_py(), steps(codes[source == i])) for i in np.unique(source)]
    columns = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["g", "b", "codes"])


def _extend(window: int, block: int, buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names, kinds = ["b", "g", "codes", "checks", "ids"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        out = []
        if rows.num_rows and answers.num_rows:
            group = rows["g"][0].as_py()
            w, ids = _coded(rows)
            at, codes, _ = _blocks(w, block)
            bucket = _split(codes, buckets)
            hit = np.zeros(len(w.codes) + window + 1, np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, blob in zip(answers["b"].to_pylist(), answers["codes"].to_pylist()):
                here = order[edges[b] : edges[b + 1]]
                shared, mine = unsteps(blob), codes[here] & _MASK
                place = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
                hit[at[here[shared[place] == mine]]] = 1
            del at, codes, bucket, order  # only what lies around a hit is needed from here on
            sums = np.concatenate([[0], np.cumsum(hit)])
            runs = w.whole(window)
            runs = runs[sums[runs + window - block + 1] > sums[runs]]
            del hit, sums
            long, check = w.windows(window)[runs], w.windows(window, 1)[runs] & U64(0xFFFFFFFF)
            owner = ids[w.document_of()[runs]]
            bucket = _split(long, buckets)
            order = np.lexsort((check, long, bucket))  # stable: the smallest document of equal windows is first
            bucket, long, check, owner = bucket[order], long[order], check[order], owner[order]
            new = np.ones(len(long), bool)
            new[1:] = (long[1:] != long[:-1]) | (check[1:] != check[:-1])
            bucket, long, check, owner = bucket[new], long[new], check[new], owner[new]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                s = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    out.append((b, group, steps(long[s]), spread(check[s]), spread(owner[s].view(U64) ^ U64(1 << 63))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 5, kinds)], names)

    return run


def _smaller(rows: pa.Table) -> pa.Table:
    """Per group, the windows of a bucket that a smaller document of another group holds."""
    longs, checks = [unsteps(x.as_py()) for x in rows["codes"]], [gather(x.as_py()) for x in rows["checks"]]
    owners = [gather(x.as_py()) for x in rows["ids"]]
    source = np.repeat(np.arange(len(longs)), [len(p) for p in longs])
    long, check, owner = np.concatenate(longs), np.concatenate(checks), np.concatenate(owners)
    order = np.lexsort((check, long))
    long, check, owner, source = long[order], check[order], owner[order], source[order]
    first = np.flatnonzero(np.concatenate([[True], (long[1:] != long[:-1]) | (check[1:] != check[:-1])]))
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(long))))
    keep = owner > least
    long, check, source = long[keep], check[keep], source[keep]
    out = [(rows["g"][i].as_py(), steps(long[source == i]), spread(check[source == i])) for i in np.unique(source)]
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 3, kinds)], ["g", "codes", "checks"])


def _covered(w: Words, ids: np.ndarray, window: int, answers: pa.Table) -> np.ndarray:
    """Whether each word lies in a window that also starts in a smaller document."""
    runs = w.whole(window)
    long, check = w.windows(window)[runs], w.windows(window, 1)[runs].astype(np.uint32)
    repeated = np.zeros(len(runs), bool)
    if len(runs):
        order = np.lexsort((check, long))
        new = np.ones(len(runs), bool)
        a = long[order]
        new[1:] = a[1:] != a[:-1]
        a = check[order]
        new[1:] |= a[1:] != a[:-1]
        del a
        ranks = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0, dtype=np.int32)  # equal ids are equal
        owner = np.repeat(ranks, np.diff(w.first))[runs][order]
        repeated[order] = owner > owner[new][np.cumsum(new, dtype=np.int32) - 1]
        del order, owner, new
    if answers.num_rows and len(runs):
        known = np.concatenate([unsteps(x.as_py()) for x in answers["codes"]])
        known_check = np.concatenate([gather(x.as_py()) for x in answers["checks"]])
        by = np.lexsort((known_check, known))
        known, known_check = known[by], known_check[by]
        place = np.minimum(np.searchsorted(known, long), len(known) - 1)
        while True:  # equal 64-bit codes with another check stand next to each other
            same = known[place] == long
            repeated |= same & (known_check[place] == check)
            after = np.minimum(place + 1, len(known) - 1)
            if not (same & (after > place) & (known[after] == long)).any():
                break
            place = np.where(same & (known[after] == long), after, place)
            if (place == len(known) - 1).all():
                repeated |= (known[place] == long) & (known_check[place] == check)
                break
    marks = np.zeros(len(w.codes) + 1, np.int32)
    hits = runs[repeated]
    np.add.at(marks, hits, 1)
    np.add.at(marks, hits + window, -1)
    return np.cumsum(marks)[:-1] > 0


def _left(text: str, at: int, w: Words, low: int, spans: list[list[int]]) -> str:
    """The text, which starts at byte ``at`` of the batch, without its spans of words and the white space after them."""
    raw, out, place = text.encode(), [], 0
    for first, last in spans:
        out.append(raw[place : w.starts[low + first] - at])
        following = low + last
        inside = following < len(w.starts) and w.starts[following] < at + len(raw)
        place = (w.starts[following] if inside else w.ends[following - 1]) - at
    return b"".join([*out, raw[place:]]).decode()


def _finish(window: int, columns: tuple[str, ...], layout: bool):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, w, ids = _batches(rows)
        gone = _covered(w, ids, window, answers)
        w.codes = w.codes[:0]
        removed = np.concatenate([[0], np.cumsum(gone)])
        texts, lost, spans, at = [], [], [], 0
        for d, text in enumerate(rows["text"]):
            low, high = w.first[d], w.first[d + 1]
            own = text.as_py()
            lost.append(int(removed[high] - removed[low]))
            if lost[-1]:
                flags = gone[low:high]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
            else:
                spans.append([])
            if layout:
                texts.append(_left(own, at, w, low, spans[-1]) if spans[-1] else own)
                at += len((own or "").encode())
            else:
                parts = (own or "").encode().split()
                texts.append(b" ".join(compress(parts, (~flags).tolist()) if lost[-1] else parts).decode())
        out = rows.select(columns)
        out = out.append_column("n_words", pa.array(np.diff(w.first), pa.int64()))
        out = out.append_column("n_removed", pa.array(lost, pa.int64()))
        out = out.append_column("left_text" if layout else "kept_text", pa.array(texts, pa.string()))
        return out.append_column("repeats", pa.array(spans, pa.list_(pa.list_(pa.int64()))))

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, carry: tuple[str, ...] = (), layout: bool = False
) -> DataFrame:
    """Documents without the word windows that already start in a document with a smaller id.

    Returns doc_id, the columns to ``carry`` along, n_words, n_removed, kept_text (kept words joined by one
    space) and repeats: the maximal repeated stretches as [first word, word after the last].  With ``layout`` left_text is in
    place of kept_text, so that a task holds one text of each: the text as it was, line breaks and all, without those
    stretches; a text that loses nothing, null included, is unchanged.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    block = (window + 1) // 2
    groups = parts_for(text_bytes(docs), group_bytes)
    ids, text = F.coalesce("doc_id", F.lit(NO_ID)).cast("long"), F.col("text").cast("string")
    held = docs.select(ids.alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry])
    # the text takes part in the draw: one repeated id cannot fill a group
    held = held.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)))
    by_group = held.select("g", "doc_id", "text").groupBy("g")

    announced = by_group.applyInArrow(_announce(block, groups), "b long, g long, codes binary")
    with passing(spark):
        met = cut(announced.groupBy("b").applyInArrow(_meet, "g long, b long, codes binary"), "shared-blocks")
        release(spark)
        extended = by_group.cogroup(met.groupBy("g")).applyInArrow(
            _extend(window, block, groups), "b long, g long, codes binary, checks binary, ids binary"
        )
        smaller = cut(extended.groupBy("b").applyInArrow(_smaller, "g long, codes binary, checks binary"), "earlier-windows", lasting=True)
    release(spark)
    more = "".join(f"`c_{c}` {kinds[c]}, " for c in carry)
    made = ("n_words", "n_removed", "left_text" if layout else "kept_text", "repeats")
    out = held.groupBy("g").cogroup(smaller.groupBy("g")).applyInArrow(
        _finish(window, ("doc_id", *(f"c_{c}" for c in carry)), layout),
        f"doc_id long, {more}n_words long, n_removed long, {made[2]} string, repeats array<array<long>>",
    )
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), *[F.col(f"c_{c}").alias(c) for c in carry], *made)
