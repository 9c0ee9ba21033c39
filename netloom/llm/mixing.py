"""Mix sources to target weights, with a cut at each source's exact word budget.

Every document gets a hash-random key; a source is read in key order. Ranges of the key
give partial word counts per (source, range), their prefix sums give the words before
each range, and only the one range of a source that holds its cut is sorted. So a hot
source is spread over many ranges and no text is shuffled.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import table, with_unique_id
from netloom.plans.sizing import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
KEY_BITS = 60
# About so many rows per range of the key.
RANGE_ROWS = 2000
# A table of at most this many sources (some 50 bytes each) is broadcast.
SMALL_SOURCES = 20_000


def _source_key():
    """Source without nulls: a null is its own source behind all others."""
    return [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]


def _key(id_col: str, seed: int):
    """A random whole number of KEY_BITS bits for an id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size in words, key), stored; the texts are read once."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        _key(id_col, seed).alias("key"),
    )
    return durable(slim.select("id", "source", *_source_key(), "size", "key"), "sizes")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to (no_source, source_key, source_size): one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. Together they get
    ``share`` of all words. No target passes ``most`` times its source; what is above goes
    to the others by weight. With sources ordered by the level at which they fill up, the
    first one that a common level leaves unfilled fixes that level.
    """
    place = Window.orderBy("no_source", "source_key")  # one row per source
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))).cast("int")
    ranked = totals.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "no_source", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.sum("source_size").over(everywhere) * float(share)
    ranked = ranked.withColumn(
        "level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everywhere)["level"]
    filled = F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return ranked.withColumn("target", filled).select("no_source", "source_key", "source_size", "target")


def plan_mix(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """Per source of ``sized`` rows: source_size, target, whole ``epochs`` of every document,
    the (cut_key, cut_id) below which documents come once more, and ``cut_words`` of that document."""
    source = ["no_source", "source_key"]
    count = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, count) / RANGE_ROWS)))
    span = F.shiftright(F.col("key"), KEY_BITS - bits)
    ranged = rows.withColumn("span", span)
    parts = durable(ranged.groupBy(*source, "span").agg(F.sum("size").alias("words")), "ranges")
    goals = targets(parts.groupBy(*source).agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    goals = goals.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0),
        "budget": budget,
    }).withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("budget")
    goals = durable(goals, "goals")
    ahead = Window.partitionBy(*source).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("words_before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    hit = starts.join(goals, source).filter(
        (F.col("words_before") < F.col("left")) & (F.col("left") <= F.col("words_before") + F.col("words")))
    hit = hit.select(*source, "span", "words_before", "left")
    inside = ranged.join(_small(hit), [*source, "span"])
    upto = Window.partitionBy(*source, "span").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("words_before") + F.sum("size").over(upto))
    inside = inside.filter((F.col("end") - F.col("size") < F.col("left")) & (F.col("left") <= F.col("end")) & (F.col("size") > 0))
    cut = inside.select(*source, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"),
                        (F.col("left") - F.col("end") + F.col("size")).alias("cut_words"))
    return goals.join(cut, source, "left")


def _small(sources: DataFrame) -> DataFrame:
    """A broadcast hint when a table of one row per source is small; beyond that Spark joins by shuffle."""
    return F.broadcast(sources) if len(sources.limit(SMALL_SOURCES + 1).select(F.lit(1)).collect()) <= SMALL_SOURCES else sources


def _ahead():
    """Whether a row lies before its source's cut."""
    return F.coalesce(
        (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("id") < F.col("cut_id"))), F.lit(False))


def _at_cut():
    return F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("id") == F.col("cut_id")), F.lit(False))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """Words the mix takes of every document.

    Returns one row per row of ``docs``: the id, ``size`` (words; null text: 0),
    ``source_size``, ``target`` and ``taken``. A source gives whole epochs and then its
    documents in key order up to the exact budget (the target rounded to a whole word),
    the last of them in part. A document of no words gives none. Null or repeated ids keep
    their rows apart. A null source is one source; an empty table gives no rows. Reruns agree.
    """
    base, row_id = with_unique_id(docs, id_col, list(dict.fromkeys([id_col, text_col, source_col])), "mix")
    rows = sized(base, row_id, text_col, source_col, seed)
    extra = F.when(_ahead(), F.col("size")).when(_at_cut(), F.col("cut_words")).otherwise(0)
    out = rows.join(_small(plan_mix(rows, weights, share, most)), ["no_source", "source_key"]).select(
        "id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))
    if row_id == id_col:
        return out.withColumnRenamed("id", id_col)
    ids = base.select(F.col(row_id).alias("id"), F.col(id_col).alias(f"_{id_col}"))
    return out.join(ids, "id").drop("id").withColumnRenamed(f"_{id_col}", id_col)


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, repeated per epoch, the cut ones with their first words only.

    Columns are those of ``docs``. A document without words is kept once, as it takes
    nothing from the budget.
    """
    base, row_id = with_unique_id(docs, id_col, docs.columns, "mix")
    plan = _small(plan_mix(sized(base, row_id, text_col, source_col, seed), weights, share, most))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = base.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(row_id).alias("id"),
        F.col(source_col).cast("string").alias("source"), _key(row_id, seed).alias("key"))
    keyed = keyed.select("*", *_source_key()).join(plan, ["no_source", "source_key"])
    text = F.col(names[text_col])
    bare = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) == 0
    whole = F.when(bare, 1).otherwise(F.col("epochs") + F.when(_ahead(), 1).otherwise(0)).cast("int")
    part = F.when(_at_cut() & ~bare & (F.col("cut_words") > 0), 1).otherwise(0)
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    copies = keyed.where(whole + part > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), whole + part)))
    piece = F.when(F.col("copy") > whole, F.array_join(F.slice(words, 1, F.col("cut_words").cast("int")), "")).otherwise(text)
    return copies.select(*[(piece if c == text_col else F.col(n)).alias(c) for c, n in names.items()])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  ('0x' || substr(md5('7:' || doc_id), 1, {KEY_BITS // 4}))::BIGINT AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
r AS (SELECT *, {MOST_EPOCHS}.0::DOUBLE * source_size AS cap, {MOST_EPOCHS}.0::DOUBLE * source_size / w AS full_at FROM t),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at LIMIT 1)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM g),
p AS (SELECT d.*, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS left_over,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id)::BIGINT - size AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, left_over - ahead)))::BIGINT AS taken FROM p"""
