"""Toxicity by weak supervision.

1. Words of a bounded sample of labelled rows (``sample_rows``) give a lexicon: words far more frequent in
   toxic rows.  Every lexicon word is a voter of its own; patterns (several hits, hits beside a second person,
   density, shouting, exclamation, repetition) are further voters.
2. One pass over all documents stores votes and vocabulary words of each document.
3. A generative label model is fitted on the votes of all documents by expectation maximisation: accuracies
   of each voter given the hidden class, correlations of voters within a class, which discount the
   weight of voters that repeat each other.  The label of a learnable row is one more, noisy voter.
4. Logistic regression on votes and vocabulary words is trained on the posteriors of the sampled rows and scores
   every document.

Labels, language, source and id are never inputs of a score.  Rows whose crc32(doc_id) mod 5 is 0 are held
out: their labels are never read.  Defined cases: null texts are empty and scored like them; a null id is
held out; labels that repeat an id count as toxic if one says so, null labels not at all; without
learnable labels the label model alone, on seed words and patterns, gives the score; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import arrow_map, cut
from opslens.llm.words import U64, flat, words

SAMPLE_ROWS = 20_000
LEXICON = 40
VOCABULARY = 4_096
SURPRISE = 4.0
LABEL_NOISE = 0.02
# fixed values: common insults, voters even without labels
SEEDS = ("idiot", "moron", "stupid", "dumb", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "jerk", "fool", "imbecile", "hate", "kill", "dumm", "arschloch", "idiote", "imbécile", "connard", "estúpido", "idiota")
SECOND_PERSON = ("you", "your", "youre", "du", "dich", "dein", "tu", "toi", "vous", "te", "ti", "usted", "eres")
PATTERNS = ("two_hits", "three_hits", "dense", "addressed", "shouting", "exclaiming", "repeating")


def codes_of(some: tuple[str, ...]) -> np.ndarray:
    return words(pa.array(some, pa.string()), lower=True, letters=True).codes


def _word_counts(rows: pa.Table) -> pa.Table:
    """Documents with each word, by label, for one batch."""
    w = words(rows["text"], lower=True, letters=True)
    order = np.lexsort((w.codes, w.document_of()))
    codes, owner = w.codes[order], w.document_of()[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    toxic = rows["toxic"].to_numpy().astype(np.int64)[owner[new]]
    code, back = np.unique(codes[new], return_inverse=True)
    bad = np.bincount(back, toxic, len(code)).astype(np.int64)
    return pa.table({"code": code.view(np.int64), "bad": bad, "good": np.bincount(back, minlength=len(code)) - bad})


def _ids(sorted_codes: np.ndarray, order: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Number of each code in a list of codes, -1 if it is not there."""
    if not len(sorted_codes):
        return np.full(len(codes), -1)
    place = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[place] == codes, order[place], -1)


def _votes(lexicon: np.ndarray, vocabulary: np.ndarray, carry: tuple[str, ...] = ()):
    """doc_id, the columns to ``carry`` along, bits (one per voter) and the vocabulary words of each document."""
    lexicon_order, vocabulary_order = np.argsort(lexicon), np.argsort(vocabulary)
    second = np.sort(codes_of(SECOND_PERSON))

    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        w = words(rows["text"], lower=True, letters=True)
        owner = w.document_of()
        hit = _ids(lexicon[lexicon_order], lexicon_order, w.codes)
        at = np.flatnonzero(hit >= 0)
        bits = np.zeros(n, np.int64)
        np.bitwise_or.at(bits, owner[at], np.int64(1) << hit[at])
        length, hits = np.diff(w.first), np.bincount(owner[at], minlength=n)
        you = np.isin(w.codes, second)
        near = np.zeros(len(at), bool)
        for shift in (-3, -2, -1, 1, 2, 3):
            other = at + shift
            fine = (other >= 0) & (other < len(w.codes))
            other = np.where(fine, other, 0)
            near |= fine & (owner[other] == owner[at]) & you[other] if len(at) else near
        data, borders = flat(rows["text"])
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        shouts = np.concatenate([[0], np.cumsum(data == 33)])
        size = np.maximum(1, np.diff(borders))
        same = np.zeros(len(w.codes), bool)
        same[1:] = (w.codes[1:] == w.codes[:-1]) & (owner[1:] == owner[:-1])
        patterns = (
            hits >= 2,
            hits >= 3,
            hits > 0.01 * np.maximum(1, length),
            np.bincount(owner[at][near], minlength=n) > 0,
            (upper[borders[1:]] - upper[borders[:-1]]) / size > 0.3,
            (shouts[borders[1:]] - shouts[borders[:-1]]) / size > 0.02,
            np.bincount(owner[same], minlength=n) > 0.05 * np.maximum(1, length),
        )
        for k, flag in enumerate(patterns):
            bits |= flag.astype(np.int64) << (len(lexicon) + k)
        known = _ids(vocabulary[vocabulary_order], vocabulary_order, w.codes)
        inside = np.flatnonzero(known >= 0)
        pairs = np.unique(owner[inside] * (1 << 20) + known[inside])
        ends = np.searchsorted(pairs, np.arange(n + 1) << 20)
        found = (pairs & ((1 << 20) - 1)).astype("<u2")
        return pa.table(
            {
                **{c: rows[c] for c in ("doc_id", *carry)},
                "bits": pa.array(bits),
                "found": pa.array([found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            }
        )

    return arrow_map(run)


class LabelModel:
    """Prior, voter accuracies per class and the weights left after discounting correlated voters."""

    def __init__(self, voters: int):
        self.voters = voters
        self.prior = 0.1
        self.rate = np.stack([np.full(voters, 0.02), np.full(voters, 0.3)])  # P(vote | class 0), P(vote | class 1)
        self.discount = np.ones(voters)

    def log_odds(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """label: 0, 1, or -1 where there is none."""
        on, off = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        z = np.log(self.prior / (1 - self.prior)) + votes @ ((on - off) / self.discount) + (off / self.discount).sum()
        sure = np.log((1 - LABEL_NOISE) / LABEL_NOISE)
        return z + np.where(label < 0, 0.0, np.where(label == 1, sure, -sure))

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes, label), -30, 30)))

    def update(self, sums: np.ndarray) -> None:
        """sums[c]: second moments of (1, votes) weighted by the posterior of class c."""
        weight = sums[:, 0, 0]
        self.prior = float(np.clip((weight[1] + 1) / (weight.sum() + 10), 1e-4, 0.5))
        mean = (sums[:, 0, 1:] + [[0.2], [3.0]]) / (weight[:, None] + 10)  # ten rows of the first guess
        self.rate = np.clip(mean, 1e-6, 1 - 1e-6)
        together = np.zeros((self.voters, self.voters))
        for c in (0, 1):
            m = sums[c, 0, 1:] / max(weight[c], 1e-9)
            covariance = sums[c, 1:, 1:] / max(weight[c], 1e-9) - np.outer(m, m)
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            share = weight[c] / max(weight.sum(), 1e-9)
            together += share * weight[c] / (weight[c] + 20) * np.clip(covariance / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(together, 0)
        self.discount = 1 + together.sum(axis=1)


def _unpack(bits: np.ndarray, voters: int) -> np.ndarray:
    return ((bits[:, None] >> np.arange(voters)) & 1).astype(np.float64)


def _moments(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.voters + 1
        sums = np.zeros((2, size, size))
        for batch in batches:
            votes = _unpack(batch["bits"].to_numpy(), model.voters)
            count, label = batch["rows"].to_numpy().astype(float), batch["label"].to_numpy()
            p = model.posterior(votes, label)
            full = np.hstack([np.ones((len(votes), 1)), votes])
            sums[0] += (full * ((1 - p) * count)[:, None]).T @ full
            sums[1] += (full * (p * count)[:, None]).T @ full
        yield pa.record_batch({"at": np.arange(sums.size), "value": sums.reshape(-1)})

    return run


def fit_label_model(patterns: DataFrame, voters: int, rounds: int = 6) -> LabelModel:
    """``patterns``: bits, label, rows.  Only sums of fixed size leave the executors."""
    model = LabelModel(voters)
    for _ in range(rounds):
        parts = patterns.mapInArrow(_moments(model), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
        sums = np.zeros(2 * (voters + 1) ** 2)
        for row in parts.collect():
            sums[row["at"]] = row["value"]
        model.update(sums.reshape(2, voters + 1, voters + 1))
    return model


def _matrix(bits: np.ndarray, found: list[bytes], voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows: (row, column) of every feature that is on; votes first, then vocabulary words."""
    row, column = np.nonzero(_unpack(bits, voters))
    own = [np.frombuffer(f, "<u2").astype(np.int64) for f in found]
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    return np.concatenate([row, rows]), np.concatenate([column, np.concatenate(own) + voters if own else np.zeros(0, np.int64)])


def fit_linear(row: np.ndarray, column: np.ndarray, target: np.ndarray, votes: int, size: int, rounds: int = 400) -> np.ndarray:
    """Weights (bias last) of logistic regression with an L2 penalty, by accelerated gradient steps.

    The first ``votes`` features are penalised little, the words after them much more.
    """
    n = len(target)
    often = np.bincount(column, minlength=size)
    # rare votes move as easily as frequent ones
    scale = np.where(np.arange(size) < votes, 1 / np.sqrt(np.maximum(often, 1) / n + 1e-3), 0.5)
    step, penalty = 4 / (1 + np.bincount(row, scale[column] ** 2, n).mean()), 3e-4
    v = np.zeros(size + 1)
    v[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    ahead = v.copy()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (ahead[:-1] * scale)[column], n) + ahead[-1], -30, 30)))
        gap = (p - target) / n
        slope = np.append(np.bincount(column, gap[row], size) * scale + penalty * ahead[:-1], gap.sum())
        fresh = ahead - step * slope
        ahead, v = fresh + k / (k + 3) * (fresh - v), fresh
    return np.append(v[:-1] * scale, v[-1])


def _score(model: LabelModel, weights: np.ndarray | None, carry: tuple[str, ...] = ()):
    def run(rows: pa.Table) -> pa.Table:
        bits = rows["bits"].to_numpy()
        if weights is None:
            score = model.posterior(_unpack(bits, model.voters), np.full(len(bits), -1))
        else:
            row, column = _matrix(bits, rows["found"].to_pylist(), model.voters)
            z = np.bincount(row, weights[column], len(bits)) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pa.table({c: rows[c] for c in ("doc_id", *carry)} | {"score": score})

    return arrow_map(run)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns to ``carry`` along, held_out, score and predicted for every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    more = "".join(f"`{c}` long, " for c in carry)
    learnable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    learnable = learnable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    learnable = cut(learnable, "labels")
    # rows in hash order: a sample that does not depend on the layout of the table, bounded by its parameter
    chosen = [(r["doc_id"], r["toxic"]) for r in learnable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    sampled = spark.createDataFrame(chosen, "doc_id long, toxic int") if chosen else None

    seeds = codes_of(SEEDS)
    lexicon, vocabulary = seeds[:LEXICON], np.zeros(0, U64)
    if chosen:
        texts = docs.join(F.broadcast(sampled), "doc_id").select("text", "toxic")
        counts = texts.mapInArrow(arrow_map(_word_counts), "code long, bad long, good long")
        counts = counts.groupBy("code").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good >= 5")
        bad_rows, rows = sum(t for _, t in chosen), len(chosen)
        odds = F.log((F.col("bad") + 0.5) / (bad_rows + 1)) - F.log((F.col("good") + 0.5) / (rows - bad_rows + 1))
        share = max(1, bad_rows) / (rows + 1)
        n = F.col("bad") + F.col("good")
        surprise = (F.col("bad") - n * share) / F.sqrt(n * share * (1 - share))  # in standard deviations of chance
        told = counts.withColumn("odds", odds).withColumn("surprise", F.abs(surprise)).where(F.col("surprise") >= SURPRISE)
        top = told.orderBy(F.desc("surprise"), "code").limit(VOCABULARY).collect()
        vocabulary = np.array([r["code"] for r in top], np.int64).view(U64)
        likely = [r for r in top if r["odds"] > 2 and r["bad"] >= max(5, 0.01 * bad_rows)]
        likely.sort(key=lambda r: (-r["odds"] * r["bad"] ** 0.5, r["code"]))
        learned = np.array([r["code"] for r in likely], np.int64).view(U64)
        lexicon = np.array(list(dict.fromkeys([*learned.tolist()[:LEXICON], *seeds.tolist()]))[: LEXICON + 8], U64)

    voters = len(lexicon) + len(PATTERNS)
    votes = cut(docs.mapInArrow(_votes(lexicon, vocabulary, carry), f"doc_id long, {more}bits long, found binary"), "votes")
    labelled = votes.join(learnable, "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(-1)))
    patterns = cut(labelled.groupBy("bits", "label").agg(F.count(F.lit(1)).alias("rows")), "vote-patterns")
    model = fit_label_model(patterns, voters)

    weights = None
    if chosen:
        known = votes.join(F.broadcast(sampled), "doc_id").orderBy("doc_id", "bits").toPandas()
        if len(known):
            bits = known["bits"].to_numpy()
            target = model.posterior(_unpack(bits, voters), known["toxic"].to_numpy())
            row, column = _matrix(bits, [bytes(f) for f in known["found"]], voters)
            weights = fit_linear(row, column, target, voters, voters + len(vocabulary))
    scored = votes.mapInArrow(_score(model, weights, carry), f"doc_id long, {more}score double")
    return scored.select("doc_id", *carry, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
