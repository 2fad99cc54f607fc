"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of five-word shingles.  Documents with one and the same set are one node from the start.
A node of a search tree is a path of chosen minwise tokens: at every node each of the ``SLOTS`` minhash
slots is chosen with a probability of about 1 / (threshold * SLOTS) by a hash of the path, and a document goes to
one child per chosen slot, named by the minimum it has there.  Two documents at the threshold share the child of a
slot with that probability, and ``trees`` independent roots bring the chance of never meeting below one in a thousand.

1. Under the first slots, every node compares its documents with its smallest one; the links join components.  A crowd
   of near copies is one component after that.
2. Nodes whose documents are all in one component are finished.  Small nodes compare documents of different
   components exhaustively, a pair only in the first node compared whole where it meets.  Nodes that are large because of one
   component compare all others with it.  Larger nodes whose documents agree in ``ALIKE`` of their slots on average are a
   group as they are: their children would hold nearly all of them again, several times over.  Others of up to ``WHOLE``
   times a small one are compared in full, block against block.  The rest branches, and the step repeats; nodes still
   large at ``depth`` are compared in full as well.
3. What the nodes of all levels find is confirmed at once, after the last of them.

Signatures only reject (four standard deviations below the threshold); nodes carry one byte of each slot and the whole
minima of the roots' slots.  What a node finds leaves it as groups of documents that pairs near the threshold connect, one
row a document, never as pairs.  Groups that share documents are joined where that makes fewer rows.  Each group's full
shingle sets meet once, in parts of at most about ``CODES`` codes and ``MEMBERS`` documents; there every pair of different
components is decided by 64-bit codes, as 100 * intersection >= 100 * threshold * union in whole numbers, and the links
that join components are returned.  A crowd of near copies that are mostly no links of each other thus costs one row a
member, and one more for every further part.

Defined cases: no word or a null text is the empty set, linked with nothing; fewer than five words make one
shingle of all of them; a null ``doc_id`` counts as one id larger than every other; rows repeating a
``doc_id`` are one document for its component, each with its own set; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.components import components, roots
from opslens.llm.store import NO_ID, arrow_map, cut, release
from opslens.llm.words import U64, Words, mix, words

SHINGLE = 5
SLOTS = 96
TREES = 6
STARS = 3
SMALL = 1_000
THIN = 500_000
WHOLE = 8
BLOCK = 1_000
DEPTH = 10
ALIKE = 0.4
DRAWN = 100
CODES = 500_000
MEMBERS = 1_500
DEVIATIONS = 4.0
_HIGH = U64(32)
_GENERATOR = np.random.Generator(np.random.PCG64(77))
_TIMES = _GENERATOR.integers(1, 2**63, SLOTS, dtype=np.uint64) * U64(2) + U64(1)
_PLUS = _GENERATOR.integers(0, 2**63, SLOTS, dtype=np.uint64)
_SALT = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.ChunkedArray, size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle codes of each text, ascending."""
    w = words(texts, lower=True)
    windows = w.windows(size)
    out = []
    for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(windows[low : high - size + 1]))
        elif high > low:
            short = Words(w.codes[low:high], np.array([0, high - low]), w.data, w.starts, w.ends)
            out.append(short.windows(high - low, seed=1000 + high - low))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(codes: np.ndarray) -> np.ndarray:
    """The minimum of each slot's permutation, 32 bits of it."""
    least = np.full(SLOTS, np.iinfo(U64).max, U64)
    for at in range(0, len(codes), 1 << 12):
        part = codes[at : at + (1 << 12)]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return (least >> _HIGH).astype("<u4")


def _digest(slots: np.ndarray):
    """Set size, two sums that name the set, the signature, one byte of each slot, and the minima of the roots' slots."""

    def run(rows: pa.Table) -> pa.Table:
        sets = shingle_sets(rows["text"])
        sums = [(len(s), int(mix(s).sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(s * U64(3)))) if len(s) else 0) for s in sets]
        signed = lambda x: x - (x >> 63 << 64)
        sigs = [signature(s) if len(s) else None for s in sets]
        parts = {
            "sig": [None if s is None else s.tobytes() for s in sigs],
            "low": [None if s is None else (s & 0xFF).astype(np.uint8).tobytes() for s in sigs],
            "first": [None if s is None else s[slots].tobytes() for s in sigs],
        }
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_shingles": pa.array([s[0] for s in sums], pa.int64()),
                "k1": pa.array([signed(s[1]) for s in sums], pa.int64()),
                "k2": pa.array([signed(s[2]) for s in sums], pa.int64()),
                **{name: pa.array(values, pa.binary()) for name, values in parts.items()},
            }
        )

    return arrow_map(run)


def root_slots(threshold: float, trees: int) -> np.ndarray:
    """The slots chosen at the roots, each once."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03))
    draw = mix(roots[:, None] ^ _SALT[None, :])
    chosen = draw < U64(int(2**64 / (threshold * SLOTS)))
    chosen[np.arange(trees), draw.argmin(axis=1)] = True
    return np.array(list(dict.fromkeys(np.nonzero(chosen)[1].tolist())))


def _roots(slots: np.ndarray):
    """The roots' children of (id, first); k is the place of the slot."""

    def run(rows: pa.Table) -> pa.Table:
        sigs = _table(rows["first"], "<u4", len(slots)).astype(U64)
        child = mix(mix(_SALT[slots])[None, :] + sigs)
        at = pa.array(np.repeat(np.arange(len(sigs)), len(slots)))
        k = np.tile(np.arange(len(slots), dtype=np.int32), len(sigs))
        return pa.table({"node": pa.array(child.reshape(-1).view(np.int64)), "k": k, "id": rows["id"].take(at)})

    return arrow_map(run)


def _branches(threshold: float):
    """The children of (node, id, sig).  A slot of several roots is one node, so each node draws for two."""
    limit = U64(int(2**64 * 2 / (threshold * SLOTS)))

    def run(rows: pa.Table) -> pa.Table:
        sigs, nodes = _table(rows["sig"], "<u4", SLOTS).astype(U64), rows["node"].to_numpy().astype(np.int64).view(U64)
        draw = mix(nodes[:, None] ^ _SALT[None, :])
        chosen = draw < limit
        chosen[np.arange(len(nodes)), draw.argmin(axis=1)] = True
        row, slot = np.nonzero(chosen)
        child = mix(mix(nodes[row] + _SALT[slot]) + sigs[row, slot])
        none = np.full(len(row), -1, np.int32)
        return pa.table({"node": pa.array(child.view(np.int64)), "k": none, "id": rows["id"].take(pa.array(row))})

    return arrow_map(run)


def _floor(threshold: float) -> float:
    """The share of equal slots below which a pair is taken to be under the threshold."""
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / SLOTS) ** 0.5


def _sized(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose set sizes allow the threshold."""
    return np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9


def _pairs(low: np.ndarray, others: np.ndarray, n: np.ndarray, on: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs ``apart`` that may reach the threshold, by sizes and one byte of each slot."""
    same = np.zeros((len(low), len(others)), np.uint8)
    for slot in range(SLOTS):
        same += low[:, slot, None] == others[None, :, slot]
    one, two = np.nonzero(apart & (same >= _floor(threshold) * SLOTS - 1e-9))
    fit = _sized(n[one], on[two], threshold)
    return one[fit], two[fit]


def _table(column: pa.ChunkedArray | list[bytes], kind: str, width: int) -> np.ndarray:
    """Binary values of equal width as rows of numbers."""
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), kind).reshape(-1, width)


def _star_filter(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        same = (_table(rows["plow"], "u1", SLOTS) == _table(rows["low"], "u1", SLOTS)).mean(axis=1)
        ok = _sized(rows["pn"].to_numpy(), rows["n"].to_numpy(), threshold) & (same >= _floor(threshold) - 1e-9)
        return rows.filter(pa.array(ok)).select(["a", "b", "n"])

    return arrow_map(run)


def _grouped(ids: np.ndarray, labels: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """The documents that pairs a-b of ids connect: one row each, with the group's number, which its members alone decide."""
    own, first = np.unique(ids, return_index=True)
    one, two = np.searchsorted(own, a), np.searchsorted(own, b)
    root = roots(len(own), one, two)
    paired = np.zeros(len(own), bool)
    paired[one] = paired[two] = True
    sums = np.zeros(len(own), U64)
    np.add.at(sums, root[paired], mix(own[paired].view(U64) + U64(1)))
    group = mix(sums[root[paired]])
    return pa.table({"group": group.view(np.int64), "id": own[paired], "label": labels[first][paired], "n": n[first][paired]})


def _block_filter(threshold: float, slots: np.ndarray):
    """Groups in one bounded block, or in two; each row holds the members of a block as lists.

    A pair that already meets under an earlier slot is left to that node, unless the node is ``wide``: those branch.
    """

    def side(row: dict, name: str):
        members = row[name]
        ids, label = np.array([m["id"] for m in members]), np.array([m["label"] for m in members])
        low = _table([m["low"] for m in members], "u1", SLOTS)
        return ids, label, np.array([m["n"] for m in members]), low, _table([m["first"] for m in members], "<u4", len(slots))

    def whole(members: list[dict]) -> np.ndarray:
        """By member and slot: whether its node is compared whole."""
        out = np.ones((len(members), len(slots)), bool)
        for at, m in enumerate(members):
            out[at, m["wide"] or []] = False
        return out

    def run(rows: pa.Table):
        for at in range(rows.num_rows):
            row = rows.slice(at, 1).to_pylist()[0]
            ids, label, n, low, first = side(row, "members")
            oids, olabel, on, olow, ofirst = side(row, "others") if row.get("others") else (ids, label, n, low, first)
            apart = label[:, None] != olabel[None, :]
            one, two = _pairs(low, olow, n, on, apart if row.get("others") else np.triu(apart), threshold)
            if (row.get("k") or 0) > 0 and len(one):
                met = first[one, : row["k"]] == ofirst[two, : row["k"]]
                new = ~(met & whole(row["members"])[:, : row["k"]][one]).any(axis=1)
                one, two = one[new], two[new]
            if len(one):
                both = [np.concatenate(sides) for sides in ((ids, oids), (label, olabel), (n, on))]
                yield _grouped(*both, ids[one], oids[two])

    return arrow_map(run)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with later ones; codes of one set alone are left out, the others compared 64 at a time."""
    size = len(sets)
    if size == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((size, size), np.int32)
    width = 1 << 13
    for low in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(column, [low, low + width])
        has = np.zeros((size, width), bool)
        has[owner[s:e], column[s:e] - low] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        bits = bits[:, bits.any(axis=0)]
        for i in range(size - 1):
            out[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int32)
    return out


def _decide(percent: int, star: bool):
    """Links that join the components of each part of a group; rows come sorted by part.

    In a ``star`` every document is compared with the part's pivot, whose id is its ``group``.
    """

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        if len(ids) < 2:
            return None
        sets = shingle_sets(rows["text"])
        if star:
            pivot = int(np.flatnonzero(ids == rows["group"][0].as_py())[0])
            one = np.full(len(ids) - 1, pivot)
            two = np.delete(np.arange(len(ids)), pivot)
            both = np.array([len(np.intersect1d(sets[pivot], sets[t], assume_unique=True)) for t in two])
        else:
            common, sizes = _common(sets), np.array([len(s) for s in sets])
            near = np.zeros(common.shape, bool)
            for i in range(len(ids) - 1):
                held = common[i, i + 1 :].astype(np.int64)
                near[i, i + 1 :] = (100 * held >= percent * (sizes[i] + sizes[i + 1 :] - held)) & (label[i] != label[i + 1 :])
            one, two = np.nonzero(near)
            both = common[one, two].astype(np.int64)
        n = np.array([len(s) for s in sets])
        linked = 100 * both >= percent * (n[one] + n[two] - both)
        one, two = one[linked], two[linked]
        if not star and len(one):
            root = roots(len(ids), one, two)
            two = np.flatnonzero(root != np.arange(len(ids)))
            one = root[two]
        a, b = ids[one], ids[two]
        return pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy() for c in ("group", "x", "y")]
            fresh = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            borders = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
            for low, high in zip(borders[:-1], borders[1:]):
                now = tuple(int(k[low]) for k in keys)
                if held and now != key:
                    made = links(pa.concat_tables(held))
                    held = []
                    if made is not None and made.num_rows:
                        yield made
                key = now
                held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
        if held:
            made = links(pa.concat_tables(held))
            if made is not None and made.num_rows:
                yield made

    return run


def _parts() -> Column:
    """The parts of a group of (id, n) rows: one while it fits into a task, where otherwise two parts meet."""
    need = F.greatest(F.sum("n") / CODES, F.count(F.lit(1)) / MEMBERS)
    return F.when(need <= 2, 1).otherwise(F.ceil(need)).cast("int").alias("parts")


class _Search:
    """Candidate texts and signatures of one search, and the links confirmed so far."""

    def __init__(self, known: DataFrame, texts: DataFrame, percent: int):
        self.known, self.texts, self.percent, self.links = known, texts, percent, None

    def _add(self, parts: DataFrame, star: bool) -> None:
        """Add the links of parts (group, x, y, id, label); each document's text travels once a part."""
        # merged whatever the size of the parts, so that work grows alike: texts are shuffled once
        met = parts.hint("merge").join(self.texts, "id").select("group", "x", "y", "id", "label", "text")
        dealt = met.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
        found = cut(dealt.mapInArrow(_decide(self.percent, star), "a long, b long"), "links")
        self.links = found if self.links is None else self.links.unionAll(found)

    def confirm(self, groups: DataFrame) -> None:
        """Add the links of groups (group, id, label, n) that hold on full sets.

        A group too large for one task is dealt into parts, and every two parts meet.  Documents that nodes of several
        slots group are in one joined group, unless its parts would make more rows than the groups by themselves.
        """
        held = cut(groups.distinct(), "groups")
        least = held.groupBy("group").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("rows"), _parts())
        joined = components(held.join(least, "group").select(F.col("id").alias("a"), "b"), "joined-groups")
        whole = held.dropDuplicates(["id"]).join(joined, "id").select(F.col("component").alias("group"), "id", "label", "n")
        alone = least.join(joined, F.col("b") == F.col("id")).select("group", "component", (F.col("rows") * F.col("parts")).alias("rows"))
        sums = whole.groupBy("group").agg(F.count(F.lit(1)).alias("members"), _parts())
        costs = alone.groupBy("component").agg(F.sum("rows").alias("rows")).join(sums, F.col("component") == F.col("group"))
        dear = costs.where(F.col("members") * F.col("parts") > F.col("rows")).select("component")
        apart = alone.join(dear, "component", "left_semi").select("group")
        kept = whole.join(dear.withColumnRenamed("component", "group"), "group", "left_anti")
        held = cut(kept.unionByName(held.join(apart, "group", "left_semi")), "groups")
        sizes = held.groupBy("group").agg(_parts())
        block = F.pmod(F.xxhash64("id", "group"), F.col("parts")).cast("int")
        met = held.join(sizes, "group").withColumn("block", block)
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        self._add(met.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "label"), False)

    def confirm_stars(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b, n) of pivots a and documents b that hold on full sets; the pivot's text travels once a part."""
        held = cut(pairs, "stars")
        sizes = held.groupBy("a").agg(F.ceil(F.sum("n") / CODES).cast("int").alias("parts"))
        none = F.lit(0).cast("long").alias("label")
        part = F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int")
        rays = held.join(sizes, "a").select(F.col("a").alias("group"), part.alias("x"), F.lit(0).alias("y"), F.col("b").alias("id"), none)
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        pivots = sizes.select(F.col("a").alias("group"), each.alias("x"), F.lit(0).alias("y"), F.col("a").alias("id"), none)
        self._add(rays.unionAll(pivots), True)


def _lists(rows: DataFrame, name: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct("id", "label", "n", "low", "first", "wide")).alias(name))


def _blocks(rows: DataFrame) -> DataFrame:
    """The members of large nodes in blocks of about BLOCK documents."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int"))
    return _lists(dealt, "members", "node", "k", "block", "blocks")


def _crowded(rows: DataFrame) -> DataFrame:
    """Large nodes whose documents are mostly alike, judged by about DRAWN of each; this decides only how they are compared."""

    def run(lists: pa.Table) -> pa.Table:
        share = []
        for members in lists["lows"]:
            low = _table(members.as_py(), "u1", SLOTS)
            same = sum(((counts := np.bincount(low[:, slot])) * (counts - 1)).sum() for slot in range(SLOTS))
            share.append(same / max(1, SLOTS * len(low) * (len(low) - 1)))
        return lists.select(["node"]).filter(pa.array(np.array(share) >= ALIKE))

    drawn = rows.where(F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("size") / DRAWN)) == 0)
    return drawn.groupBy("node").agg(F.collect_list("low").alias("lows")).mapInArrow(arrow_map(run), "node long")


def _thin_pairs(rows: DataFrame) -> DataFrame:
    """Blocks of nodes that are large because of one component, each with the node's documents outside of it."""
    others = _lists(rows.where(F.col("label") != F.col("major")), "others", "node")
    return _blocks(rows).join(others, "node").select("members", "others", F.lit(-1).alias("k"))


def _all_pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Every two blocks of a large node, and each by itself."""
    mine = _blocks(rows)
    one = mine.select("node", "k", "block", "members", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    two = mine.select("node", F.col("block").alias("other"), F.col("members").alias("others"))
    others = F.when(F.col("block") != F.col("other"), F.col("others"))
    return one.join(two, ["node", "other"]).select("members", others.alias("others"), "k")


def _stars(search: _Search, members: DataFrame, threshold: float) -> DataFrame:
    """Confirm the pairs of each node's documents with its smallest; returns the components they make."""
    pivots = members.groupBy("node").agg(F.min("id").alias("pivot"))
    # a pair that shares several nodes is looked at once
    near = members.join(pivots, "node").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    one = search.known.select(F.col("id").alias("a"), F.col("n").alias("pn"), F.col("low").alias("plow"))
    two = search.known.select(F.col("id").alias("b"), "n", "low")
    star = near.join(two, "b").join(one, "a").select("a", "b", "pn", "n", "plow", "low")
    search.confirm_stars(star.mapInArrow(_star_filter(threshold), "a long, b long, n long"))
    return components(search.links).withColumnsRenamed({"component": "label"})


def _level(members: DataFrame, known: DataFrame, slots: np.ndarray, threshold: float, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Handle the nodes of one level, with what is ``known`` of every document; returns the groups found and the members of nodes that have to branch."""
    marked = members.join(known, "id")
    counts = marked.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    nodes = counts.groupBy("node").agg(
        F.sum("c").alias("size"), F.max_by("label", "c").alias("major"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares")
    )
    cross = (F.col("size").cast("double") * F.col("size") - F.col("squares")) / 2
    kind = F.when(F.col("size") <= SMALL, "small").when(cross <= THIN, "thin").when(F.col("size") <= WHOLE * SMALL, "middle").otherwise("large")
    open_nodes = nodes.select("node", "size", "major", F.when(cross > 0, kind).alias("kind"))
    held = cut(marked.join(open_nodes, "node", "left").where("kind is not null"), "open-nodes")
    kinds = {r[0] for r in held.groupBy("kind").agg(F.lit(1)).collect()}
    crowds = None
    if kinds & {"middle", "large"}:
        full = held.where("kind in ('middle', 'large')")
        crowded = cut(_crowded(full), "crowded-nodes")
        crowds = full.join(crowded, "node", "left_semi").select(F.col("node").alias("group"), "id", "label", "n")
        held = held.join(crowded, "node", "left_anti")
    large = held.where("kind = 'large'") if "large" in kinds else None
    # the slots under which a document is in a node that branches
    wide = large.where("k >= 0").groupBy("id").agg(F.collect_set("k").alias("wide")) if large is not None and not last else None
    held = held.join(wide, "id", "left") if wide is not None else held.withColumn("wide", F.lit(None).cast("array<int>"))

    small = _lists(held.where("kind = 'small'"), "members", "node", "k")
    work = small.select("members", F.lit(None).cast(small.schema["members"].dataType).alias("others"), "k")
    if "thin" in kinds:
        work = work.unionAll(_thin_pairs(held.where("kind = 'thin'")))
    full = {"middle", "large"} & kinds if last else {"middle"} & kinds
    if full:
        work = work.unionAll(_all_pairs_of_blocks(held.where(F.col("kind").isin(*full))))
    groups = work.mapInArrow(_block_filter(threshold, slots), "group long, id long, label long, n long")
    groups = cut(groups if crowds is None else groups.unionAll(crowds), "found-groups")
    return groups, None if last or large is None or large.isEmpty() else large


def _shared(children: DataFrame) -> DataFrame:
    """(node, k, id) of nodes that at least two documents share; stored."""
    several = children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("node")
    return cut(children.join(several, "node", "left_semi"), "nodes")


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, one row per document.

    Two documents are linked when ``100 * intersection >= percent * union`` of their shingle sets.
    """
    spark, threshold = docs.sparkSession, percent / 100
    held = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slots = root_slots(threshold, trees)
    columns = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, low binary, first binary"
    digests = cut(held.mapInArrow(_digest(slots), columns), "digests")

    same = ["n_shingles", "k1", "k2"]
    full = digests.where("n_shingles > 0")
    # a repeated id may stand for several sets: each is searched under the set's own number
    sets = full.groupBy("doc_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("k1", "k2")], F.count(F.lit(1)).alias("rows"))
    odd = sets.agg(F.coalesce(F.bool_or(F.expr("least_k1 <> most_k1 or least_k2 <> most_k2")), F.lit(False)), F.coalesce(F.max("rows") > 1, F.lit(False)))
    several, repeated = odd.first()
    if several:
        return _with_repeated_ids(held, percent, trees, depth)
    known = full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("low").alias("low"), F.first("first").alias("first"))
    known = cut(known.select("id", F.col("n_shingles").alias("n"), "low", "first", "k1", "k2"), "classes")

    members = _shared(known.select("id", "first").mapInArrow(_roots(slots), "node long, k int, id long"))
    release(spark)
    texts = held.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumnRenamed("doc_id", "id")
    if repeated:
        texts = cut(texts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "candidates")
        release(spark)
    sigs = digests.select(F.col("doc_id").alias("id"), "sig")
    sigs = sigs.groupBy("id").agg(F.first("sig").alias("sig")) if repeated else sigs
    search = _Search(known.select("id", "n", "low", "first"), texts, percent)
    labels = _stars(search, members.where(F.col("k") < STARS), threshold)
    marks = search.known.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    marks = cut(marks, "marks")
    found: list[DataFrame] = []
    for level in range(1, depth + 1):
        groups, large = _level(members, marks, slots, threshold, level == depth)
        found.append(groups)
        if large is None:
            break
        members = _shared(large.select("node", "id").join(sigs, "id").select("node", "id", "sig").mapInArrow(_branches(threshold), "node long, k int, id long"))
    release(spark)
    search.confirm(reduce(DataFrame.unionAll, found))

    joined = components(search.links)
    labelled = known.join(joined, "id", "left").select(F.col("n").alias("n_shingles"), "k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = digests.select("doc_id", *same).join(labelled, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        _real("doc_id").alias("doc_id"), "n_shingles", _real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def _real(column: Column | str) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def _with_repeated_ids(held: DataFrame, percent: int, trees: int, depth: int) -> DataFrame:
    """The same for a table whose ids repeat with other texts: rows get numbers, rows of an id are one document."""
    numbered = cut(held.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    by_row = cut(near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), percent, trees, depth), "by-row")
    rows = numbered.select("row", "doc_id").join(by_row.withColumnRenamed("doc_id", "row"), "row")
    firsts = rows.groupBy("doc_id").agg(F.min("component_id").alias("first"))
    ties = rows.join(firsts, "doc_id").select(F.col("component_id").alias("a"), F.col("first").alias("b"))
    merged = components(ties).select(F.col("id").alias("component_id"), F.col("component").alias("merged"))
    rows = rows.join(merged, "component_id", "left").withColumn("merged", F.coalesce("merged", "component_id"))
    least = rows.groupBy("merged").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "merged")
    return rows.select(_real("doc_id").alias("doc_id"), "n_shingles", _real("least").alias("component_id"), (F.col("doc_id") == F.col("least")).alias("kept"))
