"""Queries on nearest neighbours, rebalancing and the end-to-end workflows."""

import math
import uuid

from pyspark.sql import functions as F

from netloom.catalogue import sql
from netloom.catalogue.flow_queries import _DIRTY, _SCALED, _THREE, _THREE_SQL, FLOWS, _dirty_flows, rounded, stored_flows
from netloom.catalogue.sql import r6
from netloom.operators import classify, neighbors, neighbourhoods, resample
from netloom.operators.evaluate import roc_auc
from netloom.plans import workflows
from netloom.plans.sizing import durable, scratch_path, step
from netloom.schema import ENGINEERED_SCHEMA, FLOW_SCHEMA, LABEL, MODEL_FEATURES, RESAMPLED_SCHEMA
from netloom.sources import flow_files
from netloom.sources.tables import flows, table

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- Nearest neighbours -----------------------------------------------------

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_DISTANCE = {
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2])))",
    "minkowski": "list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]) ** 3)) ** (1 / 3::DOUBLE)",
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
}


def _knn_sql(metric, k):
    return f"""WITH {_E}, d AS (SELECT a.id, b.id AS o, {_DISTANCE[metric]} AS dist
  FROM e a JOIN e b ON a.id <> b.id)
SELECT id AS vec_id, row_number() OVER (PARTITION BY id ORDER BY dist, o) AS rank, o AS neighbor_id,
  {r6('dist')} AS distance FROM d QUALIFY rank <= {k}"""


def _knn(spark, sf_dir, metric, k, **options):
    rows = neighbors.knn(
        table(spark, sf_dir, "embeddings"), k, metric, "vec_id", "embedding", **options
    )
    return rows.select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id", rounded("distance").alias("distance")
    )


@query(_knn_sql("euclidean", 5))
def knn_all(spark, sf_dir):
    return _knn(spark, sf_dir, "euclidean", 5)


@query(_knn_sql("euclidean", 3))
def knn_pivots(spark, sf_dir):
    """The same join through several pivot cells and small blocks."""
    return _knn(spark, sf_dir, "euclidean", 3, pivots=8, block_rows=100)


@query(_knn_sql("manhattan", 5))
def knn_manhattan(spark, sf_dir):
    return _knn(spark, sf_dir, "manhattan", 5)


@query(_knn_sql("minkowski", 5))
def knn_minkowski3(spark, sf_dir):
    return _knn(spark, sf_dir, "minkowski", 5, p=3.0)


@query(_knn_sql("chebyshev", 5))
def knn_chebyshev(spark, sf_dir):
    return _knn(spark, sf_dir, "chebyshev", 5)


@query(_knn_sql("cosine", 5))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine", 5)


@query(_knn_sql("cosine", 3))
def knn_cosine_pivots(spark, sf_dir):
    """The same join through several pivot cells of the scaled vectors."""
    return _knn(spark, sf_dir, "cosine", 3, pivots=8, block_rows=100)


@query(f"{FLOWS} SELECT count(*) * 5 AS neighbors, TRUE AS enough FROM flows")
def knn_recall(spark, sf_dir):
    """Whether approximate search among flows finds 0.9 of the exact neighbours."""
    vec = F.array(*[F.col(c).cast("double") for c in MODEL_FEATURES])
    df = durable(flows(spark, sf_dir).select("flow_id", vec.alias("vec")), "flow-vectors")
    cells = max(8, math.isqrt(df.count()))
    found = neighbors.knn_approximate(df, 5, id_col="flow_id", cells=cells)
    true = neighbors.knn(df, 5, id_col="flow_id")
    return neighbors.recall(found, true, "flow_id").select("neighbors", (F.col("recall") >= 0.9).alias("enough"))


@query(f"""WITH {_E}, f AS (SELECT min(id) AS id FROM e)
SELECT b.id AS neighbor_id, {r6(_DISTANCE['euclidean'])} AS distance
FROM e a JOIN f ON a.id = f.id JOIN e b ON a.id <> b.id
ORDER BY {_DISTANCE['euclidean']}, b.id LIMIT 5""")
def knn_one(spark, sf_dir):
    """Neighbours of one row, the one with the smallest id."""
    df = table(spark, sf_dir, "embeddings")
    first = df.agg(F.min("vec_id")).first()[0]
    rows = neighbors.knn_of(df, first, 5, "euclidean", "vec_id", "embedding")
    return rows.select("neighbor_id", rounded("distance").alias("distance"))


def _pairs_sql(radius, metric="euclidean"):
    return f"""WITH {_E}, g AS (SELECT min(id) AS id, v, count(*) AS n FROM e GROUP BY v)
SELECT a.id AS id_a, b.id AS id_b, {r6(_DISTANCE[metric])} AS distance, a.n AS copies_a, b.n AS copies_b
FROM g a JOIN g b ON a.id < b.id WHERE {_DISTANCE[metric]} <= {radius}
UNION ALL SELECT id, id, 0.0, n, n FROM g WHERE n > 1"""


_RADIUS = 1.2


@query(_pairs_sql(_RADIUS))
def pairwise_within(spark, sf_dir):
    rows = neighbors.pairs_within(
        table(spark, sf_dir, "embeddings"), _RADIUS, "euclidean", "vec_id", "embedding"
    )
    return rows.withColumn("distance", rounded("distance"))


@query(_pairs_sql(0.5, "cosine"))
def pairwise_cosine(spark, sf_dir):
    rows = neighbors.pairs_within(
        table(spark, sf_dir, "embeddings"), 0.5, "cosine", "vec_id", "embedding", pivots=8, block_rows=500
    )
    return rows.withColumn("distance", rounded("distance"))


# --- Rebalancing ------------------------------------------------------------

_DIMS = 64
_DIM_NAMES = [f"e{i}" for i in range(_DIMS)]


def _labelled(spark, sf_dir, label):
    value = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.get(value, F.lit(i)).alias(f"e{i}") for i in range(_DIMS)], label.alias("label")
    )


def _zero_or_rest(spark, sf_dir):
    """Class 0 against all others."""
    return _labelled(spark, sf_dir, F.when(F.col("label") == 0, 0).otherwise(1))


def _digest(df):
    total = sum((F.col(c) for c in _DIM_NAMES[1:]), F.col("e0"))
    mixed = sum((F.col(c) * (i + 1) for i, c in enumerate(_DIM_NAMES)), F.lit(0.0))
    return df.select(
        "vec_id", F.col("label").cast("int").alias("label"), "is_synthetic",
        rounded("e0").alias("e0"), rounded("e63").alias("e63"),
        rounded(total).alias("total"), rounded(mixed).alias("mixed"),
    )


def _smote_sql(ratio, k, metric):
    base = "b AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN 0 ELSE 1 END AS l FROM embeddings)"
    made = sql.smote_ctes("b", "sm", "vec_id", "v", "l", k, ratio, 42, _DISTANCE[metric])
    digest = (
        f"{r6('z[1]')} AS e0, {r6('z[64]')} AS e63, {r6('list_sum(z)')} AS total, "
        + r6("list_sum(list_transform(z, lambda x, i: x * i))") + " AS mixed"
    )
    return f"""WITH {base}, {made},
u AS (SELECT vec_id, l, FALSE AS s, v AS z FROM b UNION ALL SELECT -1 - n, sm_k.l, TRUE, z FROM sm, sm_k)
SELECT vec_id, l AS label, s AS is_synthetic, {digest} FROM u"""


@query(_smote_sql(0.5, 5, "euclidean"))
def smote_rows(spark, sf_dir):
    return _digest(resample.smote(_zero_or_rest(spark, sf_dir), "vec_id", _DIM_NAMES, "label", ratio=0.5))


@query(_smote_sql(0.5, 5, "euclidean"))
def smote_from_stored(spark, sf_dir):
    """The same rows from neighbourhoods in a bucketed table, whose vectors are not exchanged again."""
    df, name = _zero_or_rest(spark, sf_dir), f"neighbourhoods_{uuid.uuid4().hex}"
    neighbourhoods.store_neighbourhoods(df, "vec_id", _DIM_NAMES, name, max(4, df.count() // 100_000), "label",
                                         path=scratch_path(spark, "neighbourhoods"))
    return _digest(neighbourhoods.smote_stored(df, "vec_id", _DIM_NAMES, name, "label", ratio=0.5))


@query(_smote_sql(1.0, 3, "manhattan"))
def smote_manhattan(spark, sf_dir):
    df = _zero_or_rest(spark, sf_dir)
    return _digest(resample.smote(df, "vec_id", _DIM_NAMES, "label", k=3, metric="manhattan"))


_RATIO = 0.4831882086330935


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label <> 0) AS b
  FROM embeddings)
SELECT 0 AS label, FALSE AS is_synthetic, a AS n FROM c UNION ALL SELECT 1, FALSE, b FROM c
UNION ALL SELECT 0, TRUE, trunc((b - a) * {_RATIO}::DOUBLE)::BIGINT FROM c""")
def smote_counts(spark, sf_dir):
    df = resample.smote(_zero_or_rest(spark, sf_dir), "vec_id", _DIM_NAMES, "label", ratio=_RATIO)
    return df.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, FALSE AS is_synthetic, count(*) AS n FROM embeddings GROUP BY label")
def smote_skip_multiclass(spark, sf_dir):
    """Ten classes: the table comes back as it was."""
    df = _labelled(spark, sf_dir, F.col("label"))
    kept = resample.smote(df, "vec_id", _DIM_NAMES, "label", on_invalid="skip")
    return kept.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN label = 0 THEN 0 ELSE 1 END AS label, FALSE AS is_synthetic, count(*) AS n
FROM embeddings GROUP BY ALL""")
def smote_skip_missing(spark, sf_dir):
    """A feature is missing in minority rows: the table comes back as it was."""
    df = _zero_or_rest(spark, sf_dir)
    df = df.withColumn(_DIM_NAMES[0], F.when(F.col("label") != 0, F.col(_DIM_NAMES[0])))
    kept = resample.smote(df, "vec_id", _DIM_NAMES, "label", on_invalid="skip")
    return kept.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT count(*) AS n, 2 * count(*) FILTER (WHERE label <> 0) - count(*) AS gap FROM embeddings),
o AS (SELECT *, trunc(gap * 0.25)::BIGINT AS first FROM c)
SELECT n + first + trunc((gap - first) * 0.5)::BIGINT AS rows, n + first + trunc((gap - first) * 0.5)::BIGINT AS ids FROM o""")
def rebalance_twice(spark, sf_dir):
    """A second run on a rebalanced table gives new ids."""
    once = resample.smote(_zero_or_rest(spark, sf_dir), "vec_id", _DIM_NAMES, "label", ratio=0.25)
    once = durable(once.drop("is_synthetic"), "once")
    twice = resample.smote(once, "vec_id", _DIM_NAMES, "label", ratio=0.5)
    return twice.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"))


# --- Workflows --------------------------------------------------------------

_CAPPED = ["L7_PROTO", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"]
_SHOWN = [
    "FLOW_START_MILLISECONDS", "IN_BYTES", "OUT_PKTS", "L7_PROTO", "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES", "DST_TO_SRC_AVG_THROUGHPUT", "DNS_TTL_ANSWER", "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_STDDEV",
]
_VECTOR = "[" + ", ".join(f"{c}::DOUBLE" for c in MODEL_FEATURES) + "]"


@query(f"""{_DIRTY}, q AS (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS q_{c}' for c in _CAPPED)} FROM ok),
cp AS (SELECT ok.* REPLACE ({', '.join(f'least({c}, q_{c}) AS {c}' for c in _CAPPED)}) FROM ok, q),
vv AS (SELECT flow_id, Label, {_VECTOR} AS v FROM cp),
{sql.smote_ctes('vv', 'sm', 'flow_id', 'v', 'Label', 5, _RATIO, 42)},
al AS (SELECT flow_id, Label, FALSE AS is_synthetic, v AS z FROM vv
  UNION ALL SELECT -1 - n, sm_k.l, TRUE, z FROM sm, sm_k)
SELECT flow_id, Label, is_synthetic,
  {', '.join(f"{r6(f'z[{MODEL_FEATURES.index(c) + 1}]', 4)} AS {c}" for c in _SHOWN)} FROM al""")
def rebalance_flows(spark, sf_dir):
    """Clean, cap and balance the flow table."""
    df = workflows.rebalance(_dirty_flows(spark, sf_dir), "flow_id", ratio=_RATIO)
    return df.select("flow_id", LABEL, "is_synthetic", *[rounded(c, 4).alias(c) for c in _SHOWN])


_TAIL = ["IN_BYTES", "SRC_TO_DST_IAT_MAX", "FLOW_DURATION_MILLISECONDS"]
_TAIL_SQL = ", ".join(f"{r6(c)} AS {c}" for c in _TAIL)


@query(f"""{_SCALED}, {sql.feature_ctes('sc', 'ft')}
SELECT flow_id, Label, split, {_TAIL_SQL}, {_THREE_SQL} FROM ft""")
def engineer_flows(spark, sf_dir):
    """Split, standardise, then add the engineered features from the standardised columns."""
    df = workflows.engineer(stored_flows(spark, sf_dir), "flow_id")
    return df.select("flow_id", LABEL, "split", *[rounded(c).alias(c) for c in [*_TAIL, *_THREE]])


@query(f"""{FLOWS}, {sql.split_cte('flows', 'sp')}, {sql.feature_ctes('sp', 'ft')},
{sql.scale_cte('ft', 'sc', MODEL_FEATURES, "split = 'train'")}
SELECT flow_id, Label, split, {_TAIL_SQL}, {_THREE_SQL} FROM sc""")
def engineer_flows_raw(spark, sf_dir):
    """The same with features from the original columns."""
    df = workflows.engineer(stored_flows(spark, sf_dir), "flow_id", features_on="raw")
    return df.select("flow_id", LABEL, "split", *[rounded(c).alias(c) for c in [*_TAIL, *_THREE]])


_CAP = ", ".join(f"least({c}, q_{c}) AS {c}" for c in _CAPPED)
_UNPACKED = ", ".join(f"z[{i + 1}] AS {c}" for i, c in enumerate(MODEL_FEATURES))
_FINAL_SQL = ", ".join(f"{r6(c, 4)} AS {c}" for c in [*_TAIL, *_THREE])


@query(f"""{FLOWS}, q AS (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS q_{c}' for c in _CAPPED)} FROM flows),
cp AS (SELECT flows.* REPLACE ({_CAP}) FROM flows, q), vv AS (SELECT flow_id, Label, {_VECTOR} AS v FROM cp),
{sql.smote_ctes('vv', 'sm', 'flow_id', 'v', 'Label', 5, _RATIO, 42)},
al AS (SELECT flow_id, Label, v AS z FROM vv UNION ALL SELECT -1 - n, sm_k.l, z FROM sm, sm_k),
rs AS (SELECT flow_id, Label, {_UNPACKED} FROM al), {sql.split_cte('rs', 'sp')},
{sql.scale_cte('sp', 'sc', MODEL_FEATURES, "split = 'train'")}, {sql.feature_ctes('sc', 'ft')}
SELECT flow_id, Label, split, {_FINAL_SQL} FROM ft""")
def files_end_to_end(spark, sf_dir):
    """Both workflows from file to file: CSV, balanced CSV, engineered Parquet."""
    raw, made, final = (scratch_path(spark, name) for name in ("raw-csv", "resampled", "engineered"))
    key = F.col("flow_id").cast("bigint").alias("flow_id")
    packed = {"compression": "gzip", "rows_per_file": 250_000}
    flow_files.save_table(flows(spark, sf_dir), raw, "csv", **packed)
    with step():
        loaded = flow_files.load_flows(spark, raw).select(key, *FLOW_SCHEMA.names)
        balanced = workflows.rebalance(loaded, "flow_id", ratio=_RATIO, stored=False).drop("is_synthetic")
        saved = flow_files.save_resampled(balanced, made, "flows.csv", **packed)
    with step():
        again = flow_files.load_flows(spark, saved, schema=RESAMPLED_SCHEMA).select(key, *RESAMPLED_SCHEMA.names)
        again = durable(again, "loaded")  # CSV is parsed once, not in every pass
        flow_files.save_table(workflows.engineer(again, "flow_id"), final, "parquet", rows_per_file=10_000)
    df = flow_files.load_flows(spark, final, "parquet", ENGINEERED_SCHEMA)
    return df.select("flow_id", LABEL, "split", *[rounded(c, 4).alias(c) for c in [*_TAIL, *_THREE]])


@query()
def classifier_auc(spark, sf_dir):
    """Train on the training rows of the engineered table, evaluate on the test rows."""
    table_ = durable(workflows.engineer(stored_flows(spark, sf_dir), "flow_id"), "engineered")
    features = [*MODEL_FEATURES, *_THREE]
    model = classify.train(table_, features, rounds=5, split_col="split")
    scored = classify.score(table_.filter("split = 'test'"), model, features)
    result = roc_auc(scored.withColumn("s", F.get("scores", F.lit(1))), LABEL, "s")
    return result.withColumn("auc", F.round("auc", 3))


@query(f"""{FLOWS}, r AS (SELECT flow_id % 5 = 0 AS held, CASE WHEN IN_BYTES > OUT_BYTES THEN 1 ELSE 0 END AS more_in, Label FROM flows),
p AS (SELECT more_in, avg(Label) FILTER (WHERE NOT held) AS p, count(*) FILTER (WHERE held) AS rows FROM r GROUP BY more_in)
SELECT more_in, rows, {r6('p', 3)} AS probability FROM p WHERE rows > 0""")
def classifier_one_feature(spark, sf_dir):
    """With one yes-or-no feature the fitted model has a closed form: the share of each group."""
    rows = durable(flows(spark, sf_dir).select(
        "flow_id", LABEL, F.when(F.col("IN_BYTES") > F.col("OUT_BYTES"), 1.0).otherwise(0.0).alias("more_in"),
        F.when(F.col("flow_id") % 5 == 0, "test").otherwise("train").alias("split")), "one-feature")
    model = classify.train(rows, ["more_in"], rounds=100, split_col="split")
    scored = classify.score(rows.filter("split = 'test'"), model, ["more_in"])
    return scored.groupBy(F.col("more_in").cast("int").alias("more_in")).agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.avg(F.get("scores", F.lit(1))), 3).alias("probability"))
