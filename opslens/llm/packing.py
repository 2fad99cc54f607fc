"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are encoded and cut into pieces of at most ``size`` tokens.  Round 0 packs the pieces of each
partition best-fit, longest first; bins that are nearly full are final.  The others become items of the
next round: groups of underfull bins, bounded in number, are packed again, and the groups shrink like a
tree until one is left or a round no longer saves bins.  A bin is never opened again, so a merge only has to
record (bin, larger bin, place in it); the places of all pieces follow by following those records.

Defined cases: a null text counts as empty, and every document ends in one ``end_id``, so an empty one is a
single token; null and repeated ids are kept as they are (pieces carry numbers of their own); an
empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import cut, parts_for, slices, total

SIZE = 2048
SLACK = 8
FAN_IN = 100_000
#: Bytes of stretches, their ids and what Python needs to hold them; two such stores are kept.
REMEMBERED = 64 << 20
_ENTRY = 200
_TAIL = re.compile(rb"(?<=[a-z0-9])(?=[.,;:!?%$&*#|]+(?: |\Z))")


class _Encoder:
    """Token ids as little-endian 32-bit bytes, by stretches between white space.

    The tokenizer folds case and drops white space, and none of its rules looks across it, so a stretch always has the same
    ids.  Marks at the end of a word are stretches of their own: a letter never shares a token with them.  Stretches
    are remembered in two generations of about ``REMEMBERED`` bytes, or those of one text, if they are more.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older, self.held = Tokenizer.from_file(path), {}, {}, 0

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            raw = (text or "").encode().replace(b"\n", b" ")
            # names of special tokens are matched before case is folded
            parts = (raw if b"<|" in raw else _TAIL.sub(b" ", raw.lower())).split(b" ")
            known = self.known
            fresh = [p for p in set(parts) if p not in known]
            if fresh:
                if self.held > REMEMBERED:
                    self.older, self.known, self.held = known, {}, 0
                    known, fresh = self.known, list(set(parts))
                older = self.older
                known.update((p, older[p]) for p in fresh if p in older)
                new = [p for p in fresh if p not in known]
                found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
                known.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in found)))
                self.held += sum(len(p) + len(known[p]) + _ENTRY for p in fresh)
            yield b"".join(map(known.__getitem__, parts))


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """The encoder of a file, kept for the tasks that a Python worker still gets."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in (piece for whole in batches for piece in slices(whole)):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for at, ids in enumerate(known.encode(batch["text"].to_pylist())):
                ids += end
                for number, start in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[start : start + 4 * size]
                    rows.append(at)
                    numbers.append(number)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(rows, pa.int64())),
                    "piece": pa.array(numbers, pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            )

    return run


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the bin with the least room that fits; and the bins' fill."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set while a bin with room r is open
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = size, len(fills)
            fills.append(0)
        bins[item], offsets[item] = at, fills[at]
        fills[at] += need
        by_room[room - need].append(at)
        rooms |= 1 << (room - need)
    return bins, offsets, np.array(fills, np.int64)


def _pack(size: int, slack: int):
    """Items (item, length) of one task -> (item, bin, place, fill, closed), bins named by their first item."""

    def table(items: np.ndarray, lengths: np.ndarray) -> pa.Table:
        bins, places, fills = best_fit(lengths, size)
        names = np.zeros(len(fills), np.int64)
        names[bins[places == 0]] = items[places == 0]
        return pa.table({"item": items, "bin": names[bins], "place": places, "fill": fills[bins], "closed": fills[bins] >= size - slack})

    return table


_PLACED = "item long, bin long, place long, fill long, closed boolean"


def _pack_partition(size: int, slack: int):
    pack = _pack(size, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0, []
        for batch in batches:
            held = held[0] + batch.num_rows, [*held[1], batch]
            if held[0] >= FAN_IN:
                yield from _all(held[1], pack)
                held = 0, []
        if held[0]:
            yield from _all(held[1], pack)

    return run


def _all(batches: list[pa.RecordBatch], pack) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    return pack(rows["item"].to_numpy(), rows["length"].to_numpy()).to_batches()


def _pack_group(size: int, slack: int):
    pack = _pack(size, slack)
    return lambda rows: pack(rows["item"].to_numpy(), rows["length"].to_numpy())


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place in a sequence.

    ``slack``: a bin with at most that many tokens of room left is final.  ``fan_in``: the number of
    underfull bins one task packs at once.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = held.mapInArrow(_pieces(tokenizer, size, end_id), kinds).withColumn("item", F.monotonically_increasing_id())
    pieces = cut(pieces, "pieces")

    part = pieces.where(F.col("length") < size).select("item", "length").mapInArrow(_pack_partition(size, slack), _PLACED)
    places = cut(part, "packed")  # piece -> bin
    underfull = places.where("place = 0 and not closed").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    count = underfull.count()
    merges: list[DataFrame] = []
    while count > 1:
        groups = parts_for(count, fan_in)
        dealt = underfull.withColumn("group", F.pmod(F.xxhash64("item", F.lit(len(merges))), F.lit(groups)))
        merged = cut(dealt.groupBy("group").applyInArrow(_pack_group(size, slack), _PLACED), "merged")
        merges.append(merged)
        underfull = merged.where("place = 0 and not closed").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        before, count = count, underfull.count()
        closed = total(merged, F.when(F.col("closed") & (F.col("place") == 0), 1))
        if groups == 1 or count + closed > 0.999 * before:
            break

    # follow the records from the last round back: bin -> (sequence, shift)
    where = None
    for merged in reversed(merges):
        here = merged.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("place").alias("shift"))
        if where is not None:
            above = where.select(F.col("bin").alias("up"), F.col("sequence_id").alias("top"), F.col("shift").alias("more"))
            here = here.join(above, "up", "left").select(
                "bin", F.coalesce("top", "up").alias("up"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        where = here.select("bin", F.col("up").alias("sequence_id"), "shift")
    if where is not None:
        places = places.join(where, "bin", "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    else:
        places = places.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    out = pieces.join(places, "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")
    )
    return out
