"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each snapshot a few turns longer.  Every turn gets a hash of
the whole prefix up to it: four running sums of 31-bit hashes of (position, role, text), so that equal
sums at equal positions mean equal prefixes.  A conversation whose last prefix is an inner prefix of a longer
one is dropped by an anti-join, and of equal conversations the smallest id stays.  The rest is rendered turn
by turn.

Positions and running sums are computed in slices of a range-partitioned copy: a slice is numbered by itself and
shifted by what the slices before it hold, so a conversation with a third of all turns is many tasks.

Defined cases: turns are ordered by turn number, role and text, nulls last; repeated rows are turns of their own;
rows without ``conv_id`` are one conversation, its id is null and larger than every other; a null role is rendered as
``unknown``, a null text as empty, but neither equals those strings when conversations are compared; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.store import NO_ID, cut, parts_for

SLICE_ROWS = 200_000
_LANES = ("h1", "h2", "h3", "h4")
# fixed values: the markers of the chat format
OPENING, CLOSING = "<|im_start|>", "<|im_end|>\n"


def _shifted(parts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per slice and conversation, the sums of the slices before it."""
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv", "slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b_{n}") for n in names])


def prefixes(turns: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The turns in order (row, conv, role, text), and (row, conv, pos, h1-h4) of every prefix."""
    held = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc("conv"), F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text"), F.asc("row")]
    slices = parts_for(turns.count(), slice_rows)
    ordered = cut(held.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "turns")

    within = Window.partitionBy("slice", "conv").orderBy(*order[1:])
    one, two = F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")
    placed = ordered.select("row", "conv", "slice", one.alias("one"), two.alias("two"), F.row_number().over(within).cast("long").alias("pos"))
    counts = _shifted(placed.groupBy("conv", "slice").agg(F.count(F.lit(1)).alias("n")), ("n",))
    placed = placed.join(counts, ["conv", "slice"]).withColumn("pos", F.col("pos") + F.col("b_n"))
    low, a, b = F.lit(0x7FFFFFFF), F.xxhash64("pos", "one"), F.xxhash64("two", "pos")
    lanes = [a.bitwiseAND(low), F.shiftrightunsigned(a, 33), b.bitwiseAND(low), F.shiftrightunsigned(b, 33)]
    hashed = cut(placed.select("row", "conv", "slice", "pos", *[x.alias(n) for x, n in zip(lanes, _LANES)]), "turn-hashes")

    running = Window.partitionBy("slice", "conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = _shifted(hashed.groupBy("conv", "slice").agg(*[F.sum(n).alias(n) for n in _LANES]), _LANES)
    rolled = hashed.select("row", "conv", "slice", "pos", *[F.sum(n).over(running).alias(n) for n in _LANES])
    rolled = rolled.join(sums, ["conv", "slice"]).select("row", "conv", "pos", *[(F.col(n) + F.col(f"b_{n}")).alias(n) for n in _LANES])
    return ordered, cut(rolled, "prefixes")


def format_chats(turns: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """conv_id, turn_no (from 1), n_turns, role and rendered: the turns of maximal conversations, ready to be joined in order."""
    ordered, rolled = prefixes(turns, slice_rows)
    key = ["pos", *_LANES]
    sizes = rolled.groupBy("conv").agg(F.max("pos").alias("n_turns"))
    known = rolled.join(sizes, "conv")
    whole = known.where("pos = n_turns").select("conv", *key)
    inner = known.where("pos < n_turns").select(*key).distinct()
    maximal = whole.join(inner, key, "left_anti")
    kept = maximal.groupBy(*key).agg(F.min("conv").alias("conv")).select("conv", F.col("pos").alias("n_turns"))
    places = rolled.select("row", "conv", "pos").join(kept, "conv")
    role = F.coalesce("role", F.lit("unknown"))
    rendered = F.concat(F.lit(OPENING), role, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSING))
    return places.join(ordered.select("row", "role", "text"), "row").select(
        F.nullif("conv", F.lit(NO_ID)).alias("conv_id"), F.col("pos").alias("turn_no"), "n_turns", role.alias("role"), rendered.alias("rendered")
    )


ORACLE = """
WITH turns AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos
  FROM conversations
), logs AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS items FROM turns GROUP BY conv_id
), gone AS (
  SELECT s.conv_id FROM logs s JOIN logs l ON l.items[1] = s.items[1]
  WHERE (l.n > s.n AND list_slice(l.items, 1, s.n) = s.items) OR (l.items = s.items AND l.conv_id < s.conv_id)
)
SELECT t.conv_id, t.pos AS turn_no, l.n AS n_turns, coalesce(t.role, 'unknown') AS role,
       '<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10) AS rendered
FROM turns t JOIN logs l USING (conv_id)
WHERE t.conv_id NOT IN (SELECT conv_id FROM gone)
"""
