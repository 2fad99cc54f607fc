"""Byte-level BPE by replaying merges over a corpus of distinct words.

A task gathers the distinct words (matches of the pattern) of its documents, lays all their bytes out as one
row of tokens, and keeps an inverted index from the rank of a neighbouring pair to the positions that hold
it.  Ranks are replayed in order, smallest first, through a heap; all places of a rank are merged at once, and a
merge touches only its two neighbours and enters their new pairs into the index.  Where a merge makes a pair of
smaller rank in the same word, the rest of that word waits for it, so every word goes through the very steps it
would go through alone.  Words are numbered as they come; a document is the row of its words' numbers until the
ids of the new ones are known.  Words of earlier pieces are remembered up to a fixed number, so each is replayed
about once per Python worker.

Defined cases: a null text is empty and has no tokens; null and repeated ids are kept as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import slices

REMEMBERED = 500_000
#: Bytes of text whose words are numbered before the new ones are replayed, and of words replayed at once; no result depends on them.
PIECE_BYTES, REPLAY_BYTES = 8 << 20, 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _borders(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _joined(flat: np.ndarray, borders: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of a row of stretches, one after the other."""
    low, to = borders[which], borders[which + 1]
    at = _borders(to - low)
    return flat[np.repeat(low - at[:-1], to - low) + np.arange(at[-1])]


class Replay:
    """Merges of one vocabulary over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes, self.borders = np.frombuffer(b"".join(tokens), np.uint8), _borders([len(t) for t in tokens])
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        made = [
            (left, right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        left, right, rank = np.array(made, np.int32).reshape(-1, 3).T
        of_byte = np.full(self.size, -1, np.int32)
        of_byte[self.single[self.single >= 0]] = np.flatnonzero(self.single >= 0)
        short = (of_byte[left] >= 0) & (of_byte[right] >= 0)
        self.first = np.full((256, 256), -1, np.int32)  # ranks of two bytes
        self.first[of_byte[left[short]], of_byte[right[short]]] = rank[short]
        self.after, self.before = self._partners(left, right, rank), self._partners(right, left, rank)

    def _partners(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Borders by token, its partners on one side, and the ranks of the tokens they make."""
        order = np.argsort(own, kind="stable")
        return _borders(np.bincount(own, minlength=self.size)), other[order], rank[order]

    def encode(self, corpus: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        ids, borders = self.flat(corpus)
        return [ids[low:to].tolist() for low, to in zip(borders[:-1], borders[1:])]

    def flat(self, corpus: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the words' borders in it."""
        words = _borders([len(w) for w in corpus])
        data = np.frombuffer(b"".join(corpus), np.uint8)
        size = len(data)
        # position -1, the last of each array, stands for the one beyond a word's end
        token = np.append(self.single[data], np.int32(self.size))
        pair = np.full(size + 1, -1, np.int32)
        pair[: max(0, size - 1)] = self.first[data[:-1], data[1:]]
        after, before = np.arange(1, size + 2, dtype=np.int64), np.arange(-1, size, dtype=np.int64)
        inked = words[1:] > words[:-1]
        lows, lasts = words[:-1][inked], words[1:][inked] - 1
        pair[lasts] = after[lasts] = before[lows] = -1
        whole = np.array([self.ranks.get(w, -1) if w else -1 for w in corpus], np.int32)
        alone = np.flatnonzero(whole >= 0)
        inside = _joined(np.arange(size), words, alone)
        pair[inside] = token[inside] = -1
        token[words[alone]] = whole[alone]
        rest = np.ones(size, bool)
        rest[inside] = False
        if (token[:-1][rest] < 0).any():
            raise KeyError("a byte has no token")
        self._replay(words, token, pair, after, before)
        left = token[:-1] >= 0
        return token[:-1][left], _borders(left)[words]

    def _replay(self, words: np.ndarray, token: np.ndarray, pair: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Merge in place; a token that is gone is -1.  ``pair`` holds the rank of the pair that begins at a position, or -1."""
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks >= 0
            places, ranks = places[some], ranks[some]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for low, to, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(places[low:to])

        enter(np.arange(len(pair)), pair)
        behind, ahead = np.full(self.size + 1, -1, np.int32), np.full(self.size + 1, -1, np.int32)
        (after_at, after_who, after_rank), (before_at, before_who, before_rank) = self.after, self.before
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            places = held[0] if len(held) == 1 else np.concatenate(held)
            places = np.sort(places[pair[places] == rank])
            if not len(places):
                continue
            a, b = after_at[rank], after_at[rank + 1]
            c, d = before_at[rank], before_at[rank + 1]
            behind[after_who[a:b]], ahead[before_who[c:d]] = after_rank[a:b], before_rank[c:d]
            lefts, rights = places, after[places]
            meets = rights[:-1] == places[1:]
            if meets.any():  # a place that the merge before it has taken is passed over
                at = np.arange(len(places))
                begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~meets]), at, 0))
                lefts = places[(at - begins) % 2 == 0]
                rights = after[lefts]
            if (after_rank[a:b] < rank).any() or (before_rank[c:d] < rank).any():
                earlier, later = token[before[lefts]], token[after[rights]]
                earlier[1:][before[lefts[1:]] == rights[:-1]] = rank
                less = [(made >= 0) & (made < rank) for made in (behind[later], ahead[earlier])]
                smaller = np.flatnonzero(less[0] | less[1])
                if len(smaller):  # what lies beyond the first smaller rank of a word waits for it
                    number, first = np.unique(np.searchsorted(words, lefts[smaller], "right"), return_index=True)
                    until = np.full(len(words) + 1, len(token))
                    until[number] = lefts[smaller[first]]
                    go = lefts <= until[np.searchsorted(words, lefts, "right")]
                    waits = places[places > until[np.searchsorted(words, places, "right")]]
                    lefts, rights = lefts[go], rights[go]
                    enter(waits, np.full(len(waits), rank))
            beyond = after[rights]
            token[lefts], token[rights], pair[rights] = rank, -1, -1
            after[lefts], before[beyond] = beyond, lefts
            made = pair[lefts] = behind[token[beyond]]
            front = before[lefts]
            other = pair[front] = ahead[token[front]]
            if b > a:
                enter(lefts, made)
            if d > c:
                other[1:][front[1:] == lefts[:-1]] = -1  # entered as a left one
                enter(front, other)
            behind[after_who[a:b]] = ahead[before_who[c:d]] = -1


class _Words:
    """Words by numbers in the order they came, and the token ids of each."""

    def __init__(self, replay: Replay):
        self.replay = replay
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.borders = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Replay the words that came since the last time."""
        parts, borders, some, size = [self.ids], [self.borders], [], 0
        at = len(self.ids)

        def replay() -> None:
            nonlocal at
            ids, cuts = self.replay.flat(some)
            parts.append(ids)
            borders.append(cuts[1:] + at)
            at += len(ids)

        for word in islice(self.number, len(self.borders) - 1, None):
            some.append(word.encode())
            size += len(some[-1])
            if size >= REPLAY_BYTES:
                replay()
                some, size = [], 0
        if some:
            replay()
        self.ids, self.borders = np.concatenate(parts), np.concatenate(borders)


_words: dict[str, _Words] = {}  # kept for the tasks that a Python worker still gets


def _encode(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        if path not in _words:
            _words[path] = _Words(Replay(read_ranks(path)))
        words = _words[path]
        replay = words.replay
        for batch in batches:
            for piece in slices(batch, PIECE_BYTES):
                if len(words.number) > REMEMBERED:
                    words.forget()
                rows = [words.numbers(find(text.as_py() or "")) for text in piece["text"]]
                words.learn()
                counts, id_sums, texts_back, streams = [], [], [], []
                for row in rows:
                    ids = _joined(words.ids, words.borders, row)
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest())
                    texts_back.append(hashlib.sha256(_joined(replay.bytes, replay.borders, ids)).hexdigest())
                    if with_ids:
                        streams.append(ids.tolist())
                columns = {
                    "doc_id": piece["doc_id"], "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(texts_back, pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array(streams, pa.list_(pa.int64()))
                yield pa.record_batch(columns)

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; ``with_ids`` adds the ids themselves.

    ``ranks`` names a file of token ranks that every executor has; no special tokens are used.
    """
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(held.dtypes)["doc_id"]
    more = ", ids array<long>" if with_ids else ""
    return held.mapInArrow(_encode(ranks, pattern, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text of rows with ids: the bytes of all tokens in a row; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(ranks).items()}
        for batch in batches:
            texts = [b"".join(bytes_of[i] for i in ids or ()).decode(errors="replace") for ids in batch["ids"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
