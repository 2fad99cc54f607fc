"""Secret scans: broad candidates, then a random forest that removes false positives.

Candidates are runs of at least ``MIN_LENGTH`` characters A-Z a-z 0-9 + / = _ - with a digit, private keys, public
formats of credentials, and values of six and more characters assigned to a credential's name, quoted or not.  Features of a
candidate: its length and characters, character transitions under the corpus's own letter statistics, the part
covered by frequent corpus words, and what stands around it (credential names, names of hashes and ids, an
assignment, quotes, a path or address).  Letter statistics and the dictionary are counted over all documents.

The forest is trained on labelled findings: a table of the caller, or findings whose format or surroundings
are unmistakable either way; at most ``train_rows`` of them, in hash order.  With one class only, or no finding,
the rule behind those labels decides alone.

Defined cases: null and empty texts have no findings; null and repeated ids are kept as they are; an empty
table gives no rows; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import arrow_map, cut, slices
from opslens.llm.words import flat, runs

MIN_LENGTH = 16
TRAIN_ROWS = 20_000
DICTIONARY = 20_000
PLACEHOLDER = "[SECRET]"
# fixed values: public formats of credentials, and names that stand before credentials or before other codes
FORMATS = re.compile(
    rb"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|xox[abprs]-[A-Za-z0-9-]{10,}$|sk_(live|test)_[A-Za-z0-9]{16,}$|AIza[0-9A-Za-z_-]{35}$|"
    rb"eyJ[A-Za-z0-9_-]{10,}|glpat-[A-Za-z0-9_-]{20}$|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
CREDENTIAL = re.compile(rb"token|secret|api[_ -]?key|passw(or)?d|passwd|pwd|auth|bearer|private[_ -]?key|credential|access[_ -]?key|signature")
OTHER_CODE = re.compile(rb"sha-?\d*|md5|commit|checksum|digest|etag|uuid|guid|revision|version|isbn|order|invoice|phone|card|iban|hash")
FORMAT = re.compile(
    rb"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|"
    rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])|eyJ[A-Za-z0-9_-]{10,}|glpat-[A-Za-z0-9_-]{20}(?![0-9A-Za-z_-]))"
)
HINT = re.compile(rb"(?i)token|secret|key|passw|pwd|auth|bearer|credential|signature|AKIA|gh[pousr]_|xox|sk_|AIza|eyJ|glpat-")
ASSIGNED = re.compile(
    rb"(?i)(?:(?:token|secret|api[ _-]?key|passw(?:or)?d|passwd|pwd|auth|authorization|bearer|private[ _-]?key|credentials?|access[ _-]?key|signature)[\"']?"
    rb"\s*[:=]\s*(?:(?:bearer|basic|token)\s+)?|bearer\s+)"
    rb"(?:\"([^\"\r\n]{6,})\"|'([^'\r\n]{6,})'|[\"']?((?:(?!&[\w.-]+=)[^\s\"'<>])+))"
)
BEGIN = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----")
END = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-----")
# header lines, one blank line and lines of base64 after a BEGIN line that has no END line
_BREAK = rb"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*"
BODY = re.compile(rb"(?:%b[A-Z][A-Za-z0-9-]*:[^\r\n\\]*)*(?:%b(?=%b))?(?:(?:%b|[ \t]+(?=[A-Za-z0-9+/]{40}))[A-Za-z0-9+/]+={0,2}(?=\s|\\|\Z))*" % ((_BREAK,) * 4))
_NAMES = ("length", "digits", "upper", "lower", "symbols", "hexadecimal", "entropy", "transitions", "switches", "dictionary", "credential", "other_code", "assigned", "quoted", "path", "address", "format")
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = False
_LETTER = np.ones(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = False
_CLASS = np.full(256, 27, np.int64)  # a-z, digit, other
_CLASS[[*range(97, 123)]] = _CLASS[[*range(65, 91)]] = np.arange(26)
_CLASS[[*range(48, 58)]] = 26
_KIND = np.full(256, 3, np.int64)
_KIND[[*range(48, 58)]], _KIND[[*range(65, 91)]], _KIND[[*range(97, 123)]] = 0, 1, 2


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring characters by class, summed over a task."""
    sums = np.zeros(28 * 28, np.int64)
    for batch in (piece for whole in batches for piece in slices(whole)):
        data, _ = flat(batch["text"])
        kinds = _CLASS[data]
        sums += np.bincount(kinds[:-1] * 28 + kinds[1:], minlength=784) if len(kinds) > 1 else 0
    yield pa.record_batch({"at": np.arange(784), "n": sums})


def _short_words(rows: pa.Table) -> pa.Table:
    """Words of 4 to 8 ASCII letters with their number, for one batch."""
    data, borders = flat(rows["text"])
    starts, ends = runs(data, borders, _LETTER)
    fine = (ends - starts >= 4) & (ends - starts <= 8)
    starts, ends = starts[fine], ends[fine]
    packed = np.zeros(len(starts), np.uint64)
    for k in range(8):
        inside = starts + k < ends
        packed |= np.where(inside, (data[np.minimum(starts + k, len(data) - 1)] | 32).astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    word, n = np.unique(packed, return_counts=True)
    return pa.table({"word": word.view(np.int64), "n": n})


def statistics(docs: DataFrame, dictionary: int = DICTIONARY) -> tuple[np.ndarray, set[bytes]]:
    """Log odds of letter pairs against chance, and the most frequent short words of all documents."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    pairs = np.ones((28, 28))
    for row in texts.mapInArrow(_letter_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        pairs[divmod(row["at"], 28)] += row["n"]
    given = np.log(pairs / pairs.sum(axis=1, keepdims=True)) - math.log(1 / 28)
    counted = texts.mapInArrow(arrow_map(_short_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(dictionary).collect()
    return given, {int(r["word"]).to_bytes(8, "little", signed=True).rstrip(b"\0") for r in top if r["n"] > 1}


def _covered(value: bytes, dictionary: set[bytes]) -> float:
    low, marks = value.lower(), bytearray(len(value))
    for at in range(len(low) - 3):
        for size in range(min(8, len(low) - at), 3, -1):
            if low[at : at + size] in dictionary:
                marks[at : at + size] = b"\1" * size
                break
    return sum(marks) / max(1, len(value))


def _nearest(before: bytes) -> tuple[float, float]:
    """Whether the name nearest before a value is a credential's, and whether it is that of another code."""
    credential, other = (max((m.end() for m in names.finditer(before)), default=-1) for names in (CREDENTIAL, OTHER_CODE))
    return float(credential >= 0 and credential >= other), float(other > credential)


def features(value: bytes, before: bytes, after: bytes, given: np.ndarray, dictionary: set[bytes]) -> list[float]:
    raw = np.frombuffer(value, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=4) / len(raw)
    share = np.bincount(raw)[np.unique(raw)] / len(raw)
    classes = _CLASS[raw]
    near = before.lower()
    return [
        float(len(value)), *kinds[:3].tolist(), float(kinds[3]),
        float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None),
        float(-(share * np.log2(share)).sum()),
        float(given[classes[:-1], classes[1:]].mean()) if len(raw) > 1 else 0.0,
        float((_KIND[raw][1:] != _KIND[raw][:-1]).mean()) if len(raw) > 1 else 0.0,
        _covered(value, dictionary),
        *_nearest(near),
        float(bool(re.search(rb"(?i)(?:[:=]|\bbearer)\s*[\"']?$", before))), float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")),
        float(b"/" in value or before[-1:] in (b"/", b"\\")), float(b"@" in after[:1] + before[-1:] or b"://" in before[-12:] or after[:1] == b"."),
        float(bool(FORMATS.match(value) or FORMAT.search(value))),
    ]


def weak_label(x: list[float]) -> int:
    """1 or 0 where format or surroundings are unmistakable, else -1."""
    f = dict(zip(_NAMES, x))
    if f["format"]:
        return 1
    if f["other_code"] or f["address"] or f["digits"] == 1.0:
        return 0
    named = f["credential"] and f["assigned"]
    if named and f["digits"] and f["entropy"] > 2.5:
        return 1
    if f["dictionary"] > 0.6:
        return 0
    if named and f["quoted"]:
        return 1
    return 0 if not f["credential"] and not f["assigned"] and f["entropy"] < 3 else -1


def private_keys(text: bytes) -> list[tuple[int, int]]:
    """Keys from BEGIN to END, whatever is between; without an END of its own, to the end of the base64 lines."""
    begins, ends, out = list(BEGIN.finditer(text)), [m.end() for m in END.finditer(text)], []
    at = 0
    for k, m in enumerate(begins):
        while at < len(ends) and ends[at] <= m.end():
            at += 1
        following = begins[k + 1].start() if k + 1 < len(begins) else len(text) + 1
        own = at < len(ends) and ends[at] <= following
        out.append((m.start(), ends[at] if own else BODY.match(text, m.end()).end()))
    return out


def _values(text: bytes) -> Iterator[tuple[int, int]]:
    """Values after a credential's name; those without quotes end before closing punctuation."""
    for m in ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            end = start + len(m[3].rstrip(b".,;:)]}"))
        if end - start >= 6:
            yield start, end


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of all candidates of one text.

    Keys, formats and assigned values that overlap are joined; runs are what these leave of them.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return []
    starts, ends = runs(data, np.array([0, len(data)]), _OUTSIDE)
    found = list(_values(text))
    found += private_keys(text) if b"-----BEGIN" in text else []
    for m in FORMAT.finditer(text):  # to the end of its run
        found.append((m.start(), max(m.end(), int(ends[np.searchsorted(ends, m.end())]))))
    sure: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if sure and s < sure[-1][1]:
            sure[-1] = (sure[-1][0], max(e, sure[-1][1]))
        else:
            sure.append((s, e))
    if sure:
        rest = data.copy()
        for s, e in sure:
            rest[s:e] = ord(" ")
        starts, ends = runs(rest, np.array([0, len(rest)]), _OUTSIDE)
    long = ends - starts >= MIN_LENGTH
    starts, ends = starts[long], ends[long]
    digits = np.concatenate([[0], np.cumsum(_KIND[data] == 0)]) if len(starts) else np.zeros(1, int)
    return sorted(sure + [(int(s), int(e)) for s, e in zip(starts, ends) if digits[e] > digits[s]])


def _scan(given: np.ndarray, dictionary: set[bytes]):
    def run(rows: pa.Table) -> pa.Table:
        made: dict[str, list] = {k: [] for k in ("row", "start", "length", "value", "x", "label")}
        data, borders = flat(rows["text"])
        # one quick pass over the batch finds the texts worth a closer look
        starts, ends = runs(data, borders, _OUTSIDE)
        digits = np.concatenate([[0], np.cumsum(_KIND[data] == 0)])
        hot = starts[(ends - starts >= MIN_LENGTH) & (digits[ends] > digits[starts])]
        look = np.zeros(rows.num_rows, bool)
        look[np.searchsorted(borders, hot, "right") - 1] = True
        for m in HINT.finditer(data.tobytes()):
            look[np.searchsorted(borders, [m.start(), m.end() - 1], "right") - 1] = True
        dashes = np.flatnonzero((data[:-2] == 45) & (data[1:-1] == 45) & (data[2:] == 45)) if len(data) > 2 else np.zeros(0, int)
        look[np.unique(np.searchsorted(borders, dashes, "right") - 1)] = True
        for at in np.flatnonzero(look).tolist():
            text = data[borders[at] : borders[at + 1]].tobytes()
            done = chars = 0
            for s, e in candidates(text):
                chars, done = chars + len(text[done:s].decode(errors="ignore")), s
                x = features(text[s:e], text[max(0, s - 40) : s], text[e : e + 8], given, dictionary)
                made["row"].append(at)
                made["start"].append(chars)
                made["length"].append(len(text[s:e].decode(errors="ignore")))
                made["value"].append(text[s:e].decode(errors="ignore"))
                made["x"].append(x)
                made["label"].append(-1 if b" " in text[s:e] and not x[-1] else weak_label(x))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
        columns = {k: pa.array(made[k], t) for k, t in zip(("start", "length", "value", "x", "label"), kinds)}
        return pa.table({k: rows[k].take(pa.array(made["row"], pa.int64())) for k in ("doc_id", "key")} | columns)

    return arrow_map(run)


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, trees: int = 30) -> DataFrame:
    """doc_id, key (of id and text), start, length, value, score, is_secret: one row per candidate.

    Positions count code points.  ``labelled`` may give findings of the same form with a column ``label``.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held.withColumn("key", F.xxhash64("doc_id", "text"))
    given, dictionary = statistics(held)
    kinds = "doc_id long, key long, start long, length long, value string, x array<double>, label int"
    found = cut(held.mapInArrow(_scan(given, dictionary), kinds), "candidates")
    known = labelled if labelled is not None else found
    known = known.where("label >= 0").select("x", F.col("label").cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("x"), "label").limit(train_rows)
    known = cut(known.select(array_to_vector("x").alias("v"), "label"), "labelled-findings")
    if known.select("label").distinct().count() < 2:
        score = F.when(F.col("label") == 1, 1.0).otherwise(0.0)
        scored = found.withColumn("score", score)
    else:
        model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=6, seed=11).fit(known)
        scored = model.transform(found.drop("label").withColumn("v", array_to_vector("x")))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "key", "start", "length", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, length in sorted(spans):
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
            at = start + length
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            texts = [
                _masked(t, [(s["start"], s["length"]) for s in spans]) if t is not None and spans else t
                for t, spans in zip(rows["text"].to_pylist(), rows["spans"].to_pylist())
            ]
            keep = [c for c in rows.schema.names if c != "spans"]
            yield pa.record_batch({c: pa.array(texts, pa.string()) if c == "text" else rows[c] for c in keep})


def mask_secrets(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """The documents with every secret replaced by a placeholder; no row is dropped."""
    spans = findings.where("is_secret").select("key", F.struct("start", "length").alias("span")).distinct()
    spans = spans.groupBy(F.col("key").alias("_key")).agg(F.collect_list("span").alias("spans"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = docs.join(spans, key == F.col("_key"), "left").select(*docs.columns, "spans")
    return joined.mapInArrow(_mask, docs.schema)
