"""Operator 7: mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled (by a hash of the id) and cut into blocks of equal token number. Slot i of the schedule
has the golden-ratio point frac(i * phi), here in 32-bit integers; the point's place among the cumulative target weights names its source, the
rank of the slot among that source's slots names the block (blocks are repeated in further epochs when they run out). So every
stretch of the schedule holds the sources in proportion to their weights.

Weights default to the square root of a source's tokens; there are exactly as many slots as the least favoured source needs for each
of its blocks (slots of a range are counted by a floor sum, on the driver, for one row per source). A block that comes up in very many epochs is
copied, so that the slots of a tiny source don't meet in one task. Running sums and ranks are taken in two steps (per chunk, then within the chunk), so that no task holds a whole
source and a hot source makes no hot task.

Defined cases: null and empty texts have no tokens and get no slot; a null source is a source of its own, other than the empty name (weights
know it as None); a null doc_id is scheduled like any other; a long text runs through as many blocks as it fills; documents whose hashes tie go by id and
length; repeated rows are scheduled each; an empty table gives an empty schedule; other columns aren't read; a share below 2**-32 of all weights
counts as that; after 2**32 slots the points come again from the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: 2**32 / golden ratio, odd: i * STEP mod 2**32 is the golden-ratio sequence.
STEP, RANGE, BIN = 2654435769, 4294967296, 1 << 20
CHUNK = 65_536
#: Epochs of a block that one copy of it serves.
EPOCHS = 1024


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a * i + b) // m over i < n, by Euclid's steps."""
    total = 0
    while n > 0:
        total += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        n, b = divmod(a * n + b, m)
        m, a = a, m
    return total


def drawn(n: int, low: int, high: int) -> int:
    """How many of the first n points lie in [low, high)."""
    below = lambda h: floor_sum(n, RANGE, STEP, 0) - floor_sum(n, RANGE, STEP, RANGE - h) + n
    return below(high) - below(low)


def slots_for(blocks: int, low: int, high: int) -> int:
    """The fewest slots of which that many lie in [low, high)."""
    few, many = 0, blocks
    while drawn(many, low, high) < blocks:
        few, many = many, 2 * many
    while many - few > 1:
        middle = (few + many) // 2
        few, many = (few, middle) if drawn(middle, low, high) >= blocks else (middle, many)
    return many


def points(slot: Column) -> Column:
    """slot * STEP modulo RANGE, without leaving 64 bits."""
    return F.pmod(slot % RANGE * (STEP - RANGE), F.lit(RANGE))


def running(df: DataFrame, group: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the group that come before, by chunk and then order."""
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [group, chunk]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_before")


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_tokens: int = 4096, seed: int = 0) -> DataFrame:
    """(slot, source, epoch, block, doc_id, start_token, end_token): the pieces of documents in each slot's block."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))  # null beside all names
    rows = docs.select("doc_id", name.alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"), key.alias("key")).filter("n > 0")
    rows = common.materialise(rows.withColumn("chunk", F.substring("key", 1, 3)))
    placed = running(rows, "source", "chunk", ["key", "doc_id", "n"], "n", "at")
    cut = F.explode(F.expr(f"sequence(at div {block_tokens}, (at + n - 1) div {block_tokens})"))
    pieces = placed.select("source", "doc_id", "at", "n", cut.alias("block")).select(
        "source", "block", "doc_id", F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("at")).alias("start_token"), F.least(F.col("n"), (F.col("block") + 1) * block_tokens - F.col("at")).alias("end_token")
    )
    # one row per source, in order of name
    tokens = [(r.source, r.t) for r in rows.groupBy("source").agg(F.sum("n").alias("t")).orderBy("source").collect()]
    if weights is not None:
        given = {"n" if s is None else f"s{s}": float(w) for s, w in weights.items()}
        tokens = [(s, t) for s, t in tokens if given.get(s, 0) > 0]
    share = [given[s] if weights is not None else float(int(t**0.5)) for s, t in tokens]
    total = float(sum(share))
    edges, low, end = [], 0.0, 0
    for (s, t), w in zip(tokens, share):
        start = max(end, int(low / total * RANGE))
        end = max(start + 1, int((low + w) / total * RANGE))
        edges.append((s, -(-t // block_tokens), start, end))
        low += w
    if end > RANGE:
        raise ValueError("more sources than points")
    n_slots = 0
    for _, blocks, start, end in edges:
        if drawn(n_slots, start, end) < blocks:
            n_slots = slots_for(blocks, start, end)
    edges = [(s, blocks, start, end, 1 + drawn(n_slots, start, end) // (blocks * EPOCHS)) for s, blocks, start, end in edges]
    edge = spark.createDataFrame(edges, "source string, n_blocks long, low long, high long, copies long")  # a row per source
    small = len(edges) < 10_000
    # bins of the range are the join's equi key, so that a slot meets the few sources of its bin
    binned = edge.withColumn("bin", F.explode(F.expr(f"sequence(low div {BIN}, (high - 1) div {BIN})")))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("point"), F.expr(f"id div {CHUNK}").alias("chunk"), F.lit(1).alias("one")).withColumn("bin", F.expr(f"point div {BIN}"))
    slots = slots.join(F.broadcast(binned) if small else binned, (slots["bin"] == binned["bin"]) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    ranked = running(slots.select("source", "n_blocks", "copies", "slot", "chunk", "one"), "source", "chunk", ["slot"], "one", "rank")
    ranked = ranked.select("source", "slot", F.expr("rank div n_blocks").alias("epoch"), F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks % copies").alias("copy"))
    if any(e[4] > 1 for e in edges):
        copies = edge.select("source", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
        pieces = pieces.join(F.broadcast(copies) if sum(e[4] for e in edges) < 10_000 else copies, "source")
    else:
        pieces = pieces.withColumn("copy", F.lit(0).cast("long"))
    joined = ranked.join(pieces, ["source", "block", "copy"])
    return joined.select("slot", F.when(F.col("source") != "n", F.substr("source", F.lit(2))).alias("source"), "epoch", "block", "doc_id", "start_token", "end_token")


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source, len(regexp_extract_all(text, '\S+'))::BIGINT AS n, md5(coalesce(doc_id::VARCHAR, '') || ':0') AS key FROM documents),
a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d WHERE n > 0),
p AS (SELECT source, doc_id, pos, n, unnest(range(pos // 4096, (pos + n - 1) // 4096 + 1)) AS block FROM a),
s AS (SELECT source, sum(n)::BIGINT AS t, floor(sqrt(sum(n)::DOUBLE)) AS w FROM d WHERE n > 0 GROUP BY source),
c AS (SELECT source, w, (t + 4095) // 4096 AS n_blocks, coalesce(sum(w) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low, sum(w) OVER () AS total FROM s),
e AS (SELECT source, n_blocks, floor(low / total * 4294967296.0)::BIGINT AS low, floor((low + w) / total * 4294967296.0)::BIGINT AS high FROM c),
i AS (SELECT unnest(range((SELECT max((n_blocks + 20) * 4294967296 // (high - low) + 1) FROM e))) AS slot),
q AS (SELECT e.source, i.slot, e.n_blocks, row_number() OVER (PARTITION BY e.source ORDER BY i.slot) - 1 AS rank FROM i JOIN e ON i.slot * 2654435769 % 4294967296 >= e.low AND i.slot * 2654435769 % 4294967296 < e.high),
r AS (SELECT * FROM q WHERE slot <= (SELECT max(slot) FROM q WHERE rank = n_blocks - 1))
SELECT r.slot, CASE WHEN r.source <> 'n' THEN r.source[2:] END AS source, r.rank // r.n_blocks AS epoch, p.block, p.doc_id, greatest(0, p.block * 4096 - p.pos) AS start_token, least(p.n, (p.block + 1) * 4096 - p.pos) AS end_token
FROM r JOIN p ON r.source = p.source AND r.rank % r.n_blocks = p.block
"""
