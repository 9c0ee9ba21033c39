"""Queries on row features, cleaning, profiling, splitting and scaling."""

from pyspark.sql import functions as F

from netloom.catalogue import sql
from netloom.catalogue.sql import flow_ctes, r6, u
from netloom.functions import features as ft
from netloom.functions.address import ip_to_int
from netloom.functions.safety import INFINITY
from netloom.operators import clean, profile, split
from netloom.operators.mergeable import RANK_ERROR, merge_profiles, store_part, stored_parts
from netloom.operators.group_quantiles import grouped_quantiles, impute_by_group
from netloom.operators.quantiles import approximate_quantiles, exact_quantiles
from netloom.operators.scale import fit_scaler, scale
from netloom.plans.sizing import durable, scratch_path
from netloom.schema import (
    ATTACK, BYTES_FEATURES, FLOW_SCHEMA, ID_COLS, LABEL, MODEL_FEATURES, TIMING_FEATURES,
)
from netloom.sources import flow_files, partitioned
from netloom.sources.tables import flows, table

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def rounded(c, digits=6):
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + F.lit(sql.nudge(digits)), digits) + F.lit(0.0)


def stored_flows(spark, sf_dir):
    """The derived flow table, written once for operators that pass over it several times."""
    return durable(flows(spark, sf_dir), "flows")


FLOWS = "WITH " + flow_ctes()
_DOUBLES = [f.name for f in FLOW_SCHEMA.fields if f.dataType.simpleString() == "double"]


def _plain(columns):
    """The columns for Spark, floating ones rounded."""
    return [rounded(c).alias(c) if c in _DOUBLES else F.col(c) for c in columns]


def _plain_sql(columns):
    return ", ".join(f"{r6(c)} AS {c}" if c in _DOUBLES else c for c in columns)


# --- Row features -----------------------------------------------------------

@query(f"""{FLOWS}, {sql.noise_ctes('flows', 'nz')}
SELECT Label, count(*) AS flows, {r6('avg(quantum_noise_simulation)')} AS avg_noise,
  {r6('max(quantum_noise_simulation)')} AS max_noise FROM nz GROUP BY Label""")
def flow_noise_by_label(spark, sf_dir):
    """Do attack flows carry more channel noise?"""
    df = flows(spark, sf_dir)
    noisy = df.select(LABEL, ft.quantum_noise_simulation(df).alias("noise"))
    return noisy.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("flows"),
        rounded(F.avg("noise")).alias("avg_noise"),
        rounded(F.max("noise")).alias("max_noise"),
    )


_ALL_SQL = _plain_sql(FLOW_SCHEMA.names)


@query(f"{FLOWS} SELECT flow_id, {_ALL_SQL} FROM flows")
def flow_records(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", *_plain(FLOW_SCHEMA.names))


@query(f"{FLOWS} SELECT flow_id, {r6(sql.packet_entropy(BYTES_FEATURES))} AS packet_entropy FROM flows")
def flow_packet_entropy(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select("flow_id", rounded(ft.packet_entropy(df)).alias("packet_entropy"))


_SPARSE = ["OUT_BYTES", "LONGEST_FLOW_PKT", "NUM_PKTS_256_TO_512_BYTES"]


@query(f"""{FLOWS} SELECT flow_id, {r6(sql.packet_entropy(
    BYTES_FEATURES, [c for c in BYTES_FEATURES if c not in _SPARSE]))} AS packet_entropy FROM flows""")
def flow_packet_entropy_sparse_cols(spark, sf_dir):
    """Columns the table lacks count as zero."""
    df = flows(spark, sf_dir).drop(*_SPARSE)
    return df.select("flow_id", rounded(ft.packet_entropy(df)).alias("packet_entropy"))


_INNER, _GAPS, _OUTER = sql.timing_variance(TIMING_FEATURES)


@query(f"""{FLOWS}, s1 AS (SELECT flow_id, {_INNER} FROM flows), s2 AS (SELECT *, {_GAPS} FROM s1)
SELECT flow_id, {r6(_OUTER)} AS timing_variance FROM s2""")
def flow_timing_variance(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select("flow_id", rounded(ft.timing_variance(df)).alias("timing_variance"))


_PARTS_SQL = ", ".join(f"{r6(c, 9)} AS {c}" for c in ft.NOISE_PARTS)


@query(f"{FLOWS}, {sql.noise_ctes('flows', 'nz')} SELECT flow_id, {_PARTS_SQL} FROM nz")
def flow_noise_components(spark, sf_dir):
    df = ft.add_noise_components(flows(spark, sf_dir))
    return df.select("flow_id", *[rounded(c, 9).alias(c) for c in ft.NOISE_PARTS])


@query(f"""{FLOWS}, {sql.noise_ctes('flows', 'nz')}
SELECT flow_id, {r6('quantum_noise_simulation')} AS quantum_noise_simulation FROM nz""")
def flow_noise_entropy(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select("flow_id", rounded(ft.quantum_noise_simulation(df)).alias("quantum_noise_simulation"))


_RAW = f"""pk AS (SELECT o_orderkey AS flow_id, sum(l_quantity) AS IN_BYTES,
    sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS IN_PKTS,
    max(l_extendedprice) - min(l_extendedprice) AS SRC_TO_DST_IAT_MAX
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


@query(f"""WITH {_RAW}, s1 AS (SELECT flow_id, {sql.packet_entropy(
    BYTES_FEATURES, ['IN_BYTES'])} AS packet_entropy FROM pk)
SELECT flow_id, {r6('packet_entropy')} AS packet_entropy FROM s1""")
def packet_entropy_missing_values(spark, sf_dir):
    """Orders without line items have a missing byte count, which is skipped."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("IN_BYTES"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flow_id"))
    df = orders.join(items, orders.flow_id == items.l_orderkey, "left").drop("l_orderkey")
    return df.select("flow_id", rounded(ft.packet_entropy(df)).alias("packet_entropy"))


# --- Cleaning and projection ------------------------------------------------

_RATE = lambda b, d: (
    f"CASE WHEN {d} > 0 THEN {b} / {d}::DOUBLE WHEN {b} > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END"
)


def _dirty_flows(spark, sf_dir):
    """Orders without packets give NULL columns; one-time flows an infinite rate, one-way flows NaN."""
    df = flows(spark, sf_dir, "right")

    def rate(size, span):
        odd = F.when(F.col(size) > 0, F.lit(INFINITY)).when(F.col(size) == 0, F.lit(float("nan")))
        return F.when(F.col(span) > 0, F.col(size) / F.greatest(F.col(span), F.lit(1))).otherwise(odd)

    return df.withColumns(
        {
            "SRC_TO_DST_SECOND_BYTES": rate("IN_BYTES", "DURATION_IN"),
            "DST_TO_SRC_SECOND_BYTES": rate("OUT_BYTES", "DURATION_OUT"),
        }
    )


_DIRTY = f"""WITH {flow_ctes('LEFT JOIN')},
dirty AS (SELECT * REPLACE (
  CASE WHEN IN_BYTES IS NULL THEN NULL ELSE {_RATE('IN_BYTES', 'DURATION_IN')} END AS SRC_TO_DST_SECOND_BYTES,
  CASE WHEN OUT_BYTES IS NULL THEN NULL ELSE {_RATE('OUT_BYTES', 'DURATION_OUT')} END AS DST_TO_SRC_SECOND_BYTES)
  FROM flows),
ok AS (SELECT * FROM dirty WHERE IN_BYTES IS NOT NULL AND isfinite(SRC_TO_DST_SECOND_BYTES)
  AND isfinite(DST_TO_SRC_SECOND_BYTES))"""

_KEPT = [c for c in FLOW_SCHEMA.names if c not in ID_COLS]
_KEPT_SQL = _plain_sql(_KEPT)


@query(f"{_DIRTY} SELECT flow_id, {_KEPT_SQL} FROM ok")
def clean_flows(spark, sf_dir):
    df = clean.drop_incomplete(_dirty_flows(spark, sf_dir), drop_columns=ID_COLS)
    return df.select("flow_id", *_plain(_KEPT))


@query(f"""{_DIRTY} SELECT flow_id,
  {r6("CASE WHEN isfinite(SRC_TO_DST_SECOND_BYTES) THEN SRC_TO_DST_SECOND_BYTES END")} AS src,
  {r6("CASE WHEN isfinite(DST_TO_SRC_SECOND_BYTES) THEN DST_TO_SRC_SECOND_BYTES END")} AS dst FROM dirty""")
def infinite_to_null(spark, sf_dir):
    df = clean.infinite_to_null(_dirty_flows(spark, sf_dir))
    return df.select(
        "flow_id",
        rounded("SRC_TO_DST_SECOND_BYTES").alias("src"),
        rounded("DST_TO_SRC_SECOND_BYTES").alias("dst"),
    )


_ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""WITH q AS (SELECT {', '.join(f'quantile_cont({c}, 0.99) AS q_{c}' for c in _ITEM)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(f"{r6(f'least({c}, q_{c})')} AS {c}" for c in _ITEM)}
FROM lineitem, q""")
def clip_q99(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_ITEM)
    clipped = clean.clip_upper(df, clean.upper_quantiles(df, 0.99))
    return clipped.select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in _ITEM])


_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, {r6(f'quantile_cont({c}, {p})')} AS value FROM lineitem"
    for c in _ITEM for p in _PROBS))
def exact_quantiles_items(spark, sf_dir):
    df = exact_quantiles(table(spark, sf_dir, "lineitem"), _ITEM, _PROBS)
    return df.select("feature", "prob", rounded("value").alias("value"))


_GROUPED = ["IN_BYTES", "FLOW_DURATION_MILLISECONDS", "SRC_TO_DST_SECOND_BYTES"]
_GROUP_PROBS = [0.0, 0.5, 0.99]


@query(f"{FLOWS} " + " UNION ALL ".join(
    f"SELECT Attack, '{c}' AS feature, {p}::DOUBLE AS prob, count({c}) AS n, {r6(f'quantile_cont({c}::DOUBLE, {p})')} AS value "
    "FROM flows GROUP BY Attack" for c in _GROUPED for p in _GROUP_PROBS))
def quantiles_by_class(spark, sf_dir):
    df = grouped_quantiles(flows(spark, sf_dir), ["Attack"], _GROUPED, _GROUP_PROBS)
    return df.withColumn("value", rounded("value"))


@query(f"""SELECT user_id, 'value' AS feature, 0.5::DOUBLE AS prob, count(value) AS n, {r6('quantile_cont(value, 0.5)')} AS value
FROM events GROUP BY user_id HAVING count(value) > 0""")
def median_by_user(spark, sf_dir):
    df = grouped_quantiles(table(spark, sf_dir, "events"), ["user_id"], ["value"], [0.5])
    return df.withColumn("value", rounded("value"))


def _filled_sql(fill):
    odd = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
    filled = lambda c: f"coalesce({odd(c)}, {fill}({odd(c)}) OVER (PARTITION BY Attack)) AS {c}"
    return f"""{_DIRTY}, filled AS (SELECT flow_id, Attack, {filled('SRC_TO_DST_SECOND_BYTES')}, {filled('DST_TO_SRC_SECOND_BYTES')} FROM dirty)
SELECT flow_id, Attack, {r6('SRC_TO_DST_SECOND_BYTES')} AS src, {r6('DST_TO_SRC_SECOND_BYTES')} AS dst FROM filled"""


def _filled(spark, sf_dir, strategy):
    rates = ["SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"]
    df = impute_by_group(_dirty_flows(spark, sf_dir).select("flow_id", "Attack", *rates), ["Attack"], rates, strategy)
    return df.select("flow_id", "Attack", rounded(rates[0]).alias("src"), rounded(rates[1]).alias("dst"))


@query(_filled_sql("median"))
def impute_median_by_class(spark, sf_dir):
    return _filled(spark, sf_dir, "median")


@query(_filled_sql("avg"))
def impute_mean_by_class(spark, sf_dir):
    return _filled(spark, sf_dir, "mean")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, count({c}) > 0 AS close FROM lineitem"
    for c in _ITEM for p in _PROBS))
def approximate_quantiles_items(spark, sf_dir):
    """Whether each sketched quantile lies within the promised rank error (10 / accuracy here)."""
    items = table(spark, sf_dir, "lineitem").select(*_ITEM)
    found = approximate_quantiles(items, _ITEM, _PROBS, 10_000).collect()
    share = lambda test: F.count(F.when(test, 1)) / F.count(F.lit(1))
    rows = [
        F.struct(
            F.lit(r["feature"]).alias("feature"),
            F.lit(r["prob"]).alias("prob"),
            ((share(F.col(r["feature"]) < r["value"]) <= r["prob"] + 1e-3)
             & (share(F.col(r["feature"]) <= r["value"]) >= r["prob"] - 1e-3)).alias("close"),
        )
        for r in found
    ]
    return items.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


_MODEL_SQL = _plain_sql(MODEL_FEATURES)


@query(f"{FLOWS} SELECT flow_id, {_MODEL_SQL}, Label FROM flows")
def project_model_columns(spark, sf_dir):
    df = clean.project_model_columns(flows(spark, sf_dir))
    return clean.label_last(clean.canonical_order(df)).select("flow_id", *_plain(MODEL_FEATURES), LABEL)


_IP_INT = lambda c: "+".join(
    f"split_part({c}, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4)
)


@query(f"""{FLOWS} SELECT flow_id, {_IP_INT('IPV4_SRC_ADDR')} AS src, {_IP_INT('IPV4_DST_ADDR')} AS dst
FROM flows""")
def ipv4_numbers(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select(
        "flow_id", ip_to_int(F.col("IPV4_SRC_ADDR")).alias("src"), ip_to_int(F.col("IPV4_DST_ADDR")).alias("dst")
    )


@query(f"{FLOWS} SELECT flow_id, {_ALL_SQL} FROM flows")
def schema_cast(spark, sf_dir):
    """A table of strings gets the flow schema back."""
    df = flows(spark, sf_dir)
    text = df.select("flow_id", *[F.col(c).cast("string").alias(c) for c in FLOW_SCHEMA.names])
    return flow_files.apply_schema(text).select("flow_id", *_plain(FLOW_SCHEMA.names))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def load_sample(spark, sf_dir):
    """The five-row look at a fresh load."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return flow_files.sample_rows(orders.orderBy("o_orderkey"))


@query(f"{FLOWS} SELECT {_ALL_SQL} FROM flows")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "flows-csv")
    flow_files.save_table(flows(spark, sf_dir).drop("flow_id"), path, "csv")
    return flow_files.load_flows(spark, path, "csv").select(*_plain(FLOW_SCHEMA.names))


@query(f"{FLOWS} SELECT flow_id, {_ALL_SQL} FROM flows")
def csv_by_name(spark, sf_dir):
    """A CSV file with an id column and all columns in reverse order."""
    path = scratch_path(spark, "flows-csv")
    df = flows(spark, sf_dir)
    flow_files.save_table(df.select(*reversed(df.columns)), path, "csv")
    back = flow_files.load_flows(spark, path, "csv")
    return back.select(F.col("flow_id").cast(dict(df.dtypes)["flow_id"]).alias("flow_id"), *_plain(FLOW_SCHEMA.names))


@query(f"""{FLOWS} SELECT kind, kind IN ('csv', 'CSV', 'parquet') AS accepted, CASE WHEN accepted THEN n ELSE 0 END AS rows
FROM (SELECT count(*) AS n FROM flows), (VALUES ('csv'), ('CSV'), ('parquet'), ('json'), ('xlsx')) AS k(kind)""")
def load_formats(spark, sf_dir):
    """What the loader makes of a stored table's format name: rows, or a refusal."""
    df, out = flows(spark, sf_dir).drop("flow_id"), []
    paths = {kind: flow_files.save_table(df, scratch_path(spark, f"flows-{kind}"), kind) for kind in ("csv", "parquet")}
    for kind in ("csv", "CSV", "parquet", "json", "xlsx"):
        try:
            out.append((kind, True, flow_files.load_flows(spark, paths.get(kind.lower(), paths["csv"]), kind).count()))
        except ValueError:
            out.append((kind, False, 0))
    return spark.createDataFrame(out, "kind string, accepted boolean, rows bigint")


@query(f"{FLOWS} SELECT flow_id, {_ALL_SQL} FROM flows")
def load_prefixed_path(spark, sf_dir):
    """A path whose file name carries the dataset-type prefix, loaded into a given number of partitions."""
    folder = scratch_path(spark, "flows")
    flow_files.save_table(flows(spark, sf_dir), f"{folder}/flows.parquet", "parquet")
    back = flow_files.load_flows(spark, f"{folder}/DatasetType.flows.parquet", "parquet", partitions=6)
    if back.rdd.getNumPartitions() != 6:
        raise AssertionError("the loader was asked for 6 partitions")
    return back.select("flow_id", *_plain(FLOW_SCHEMA.names))


_PROFILED = ["IN_BYTES", "OUT_PKTS", "SRC_TO_DST_SECOND_BYTES"]


@query(f"{FLOWS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS "count", {r6(f'avg({c})', 4)} AS mean, {r6(f'stddev_samp({c})', 4)} AS std,
    {r6(f'min({c})::DOUBLE', 4)} AS min, {r6(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS p25,
    {r6(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS p50, {r6(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS p75,
    {r6(f'max({c})::DOUBLE', 4)} AS max FROM flows""" for c in _PROFILED))
def profile_of_load(spark, sf_dir):
    """The column statistics that go with a fresh load."""
    path = flow_files.save_table(flows(spark, sf_dir).select(*_PROFILED), scratch_path(spark, "flows"), "parquet")
    df = flow_files.load_profile(flow_files.load_flows(spark, path, "parquet"))
    return df.select("feature", "count", *[rounded(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _spoilt_file(spark, sf_dir):
    """A CSV file of flows in which some numbers are none."""
    path = scratch_path(spark, "flows-spoilt")
    text = flows(spark, sf_dir)
    text = text.withColumns({
        "IN_BYTES": F.when(F.col("flow_id") % 31 == 0, "12x").otherwise(F.col("IN_BYTES").cast("string")),
        "L7_PROTO": F.when(F.col("flow_id") % 62 == 0, "tcp").otherwise(F.col("L7_PROTO").cast("string")),
    })
    return flow_files.save_table(text, path, "csv")


@query(f"""{FLOWS} SELECT flow_id, CASE WHEN flow_id % 62 = 0 THEN 'L7_PROTO' ELSE '' END AS also FROM flows WHERE flow_id % 31 = 0""")
def quarantined_rows(spark, sf_dir):
    """The side table of records that do not fit the schema."""
    side = scratch_path(spark, "side")
    flow_files.load_and_quarantine(spark, _spoilt_file(spark, sf_dir), side)
    bad = spark.read.parquet(side).where(F.array_contains("reasons", "IN_BYTES"))
    also = F.array_join(F.filter("reasons", lambda r: r != "IN_BYTES"), ",")
    return bad.select(F.get_json_object("record", "$.flow_id").cast("bigint").alias("flow_id"), also.alias("also"))


@query(f"{FLOWS} SELECT flow_id, {_ALL_SQL} FROM flows WHERE flow_id % 31 <> 0")
def rows_beside_quarantine(spark, sf_dir):
    """The good rows of the same file, typed."""
    good, _ = flow_files.load_quarantined(spark, _spoilt_file(spark, sf_dir))
    return good.select(F.col("flow_id").cast("bigint").alias("flow_id"), *_plain(FLOW_SCHEMA.names))


_SHORT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query(f"""SELECT row_number() OVER (ORDER BY md5(concat_ws(chr(31), {', '.join(f'{c}::VARCHAR' for c in _SHORT)}))) AS row_id,
  {', '.join(_SHORT)} FROM lineitem""")
def flow_row_ids(spark, sf_dir):
    """Ids for a table without one and with many equal rows."""
    return flow_files.with_row_id(table(spark, sf_dir, "lineitem").select(*_SHORT), "row_id")


@query(f"{FLOWS} SELECT {_ALL_SQL} FROM flows")
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "flows-parquet")
    flow_files.save_table(flows(spark, sf_dir).drop("flow_id"), path, "parquet", rows_per_file=10_000)
    return flow_files.load_flows(spark, path, "parquet").select(*_plain(FLOW_SCHEMA.names))


def _twice_written(spark, sf_dir):
    """(root, rows) of a sink with two loads: the first ran twice, the second died once before it was committed."""
    root, df = scratch_path(spark, "sink"), flows(spark, sf_dir).select("flow_id", ATTACK, "IN_BYTES")
    df = durable(df, "sink-rows")
    halves = [df.where(F.col("flow_id") % 2 == i) for i in (0, 1)]
    partitioned.save_load(halves[0], root, [ATTACK], "even")
    partitioned.stage(halves[1], root, [ATTACK])
    partitioned.save_load(halves[1], root, [ATTACK], "odd")
    partitioned.save_load(halves[0], root, [ATTACK], "even")
    return root, df


@query(f"{FLOWS} SELECT flow_id, Attack, IN_BYTES FROM flows")
def sink_after_reruns(spark, sf_dir):
    """Loads into a partitioned sink, repeated and broken off: every flow is there once."""
    root, df = _twice_written(spark, sf_dir)
    return partitioned.read_table(spark, root, [ATTACK], df.schema)


@query(f"""{FLOWS} SELECT flow_id, Attack, CASE WHEN Attack IN ('DoS', 'Normal') THEN -IN_BYTES ELSE IN_BYTES END AS IN_BYTES FROM flows""")
def sink_replaced_partitions(spark, sf_dir):
    """Two classes of the same sink are written anew and replace their partitions in both loads."""
    root, df = _twice_written(spark, sf_dir)
    anew = df.where(F.col(ATTACK).isin("DoS", "Normal")).withColumn("IN_BYTES", (-F.col("IN_BYTES")).cast(df.schema["IN_BYTES"].dataType))
    partitioned.save_load(anew, root, [ATTACK], "corrected", replace=True)
    return partitioned.read_table(spark, root, [ATTACK], df.schema)


# --- Profiles ---------------------------------------------------------------

_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_ITEM]


_PARTED = ["l_quantity", "l_extendedprice"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS "count", {r6(f'avg({c})', 4)} AS mean, {r6(f'stddev_samp({c})', 4)} AS std,
    {r6(f'min({c})::DOUBLE', 4)} AS min, {r6(f'max({c})::DOUBLE', 4)} AS max, TRUE AS close FROM lineitem"""
    for c in _PARTED))
def merged_profile(spark, sf_dir):
    """A profile merged from stored parts (one written twice), and whether its quartiles keep the promised rank."""
    items, store = table(spark, sf_dir, "lineitem"), scratch_path(spark, "profile")
    for part, lines in enumerate([(1, 2), (3, 4), (5, 6, 7), (3, 4)]):
        store_part(items.where(F.col("l_linenumber").isin(*lines)), _PARTED, store, part % 3 if part < 3 else 1)
    found = merge_profiles(stored_parts(spark, store)).collect()  # one row per column
    share = lambda test: F.count(F.when(test, 1)) / F.count(F.lit(1))
    ranks = items.agg(*[share(F.col(r["feature"]) < r[p]).alias(f"lt_{r['feature']}_{p}") for r in found for p in ("p25", "p50", "p75")],
                      *[share(F.col(r["feature"]) <= r[p]).alias(f"le_{r['feature']}_{p}") for r in found for p in ("p25", "p50", "p75")]).first()
    close = lambda c: all(ranks[f"lt_{c}_{p}"] - RANK_ERROR <= q <= ranks[f"le_{c}_{p}"] + RANK_ERROR
                          for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    rows = [(r["feature"], r["count"], r["mean"], r["std"], r["min"], r["max"], close(r["feature"])) for r in found]
    df = spark.createDataFrame(rows, "feature string, count bigint, mean double, std double, min double, max double, close boolean")
    return df.select("feature", "count", *[rounded(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "close")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS "count", {r6(f'avg({c})', 4)} AS mean,
    {r6(f'stddev_samp({c})', 4)} AS std, {r6(f'min({c})::DOUBLE', 4)} AS min,
    {r6(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS p25, {r6(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS p50,
    {r6(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS p75, {r6(f'max({c})::DOUBLE', 4)} AS max FROM lineitem"""
    for c in _NUMBERS))
def describe_numeric(spark, sf_dir):
    df = profile.describe(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return df.select(
        "feature", "count", *[rounded(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query(f"""{FLOWS}, c AS (SELECT Label, count(*) AS n FROM flows GROUP BY Label)
SELECT Label, n, {r6('n / (SELECT arg_min(n, Label) FROM c)')} AS ratio,
  {r6('n / (SELECT sum(n) FROM c)')} AS share, n = (SELECT min(n) FROM c) AS is_minority FROM c""")
def class_balance(spark, sf_dir):
    return profile.class_balance(flows(spark, sf_dir)).select(
        LABEL, "n", rounded("ratio").alias("ratio"), rounded("share").alias("share"), "is_minority"
    )


@query('SELECT quality, count(*) AS "count" FROM labels GROUP BY quality')
def quality_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "labels"), "quality")


@query(f'{FLOWS} SELECT Attack, count(*) AS "count" FROM flows GROUP BY Attack')
def attack_counts(spark, sf_dir):
    return profile.value_counts(flows(spark, sf_dir), ATTACK)


def _histogram_sql(columns, bins, source, by=""):
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"AND g.{by} = b.{by}" if by else ""
    long = " UNION ALL ".join(f"SELECT {key}'{c}' AS feature, {c}::DOUBLE AS v FROM {source}" for c in columns)
    flat = f"""h_v AS ({long}),
h_r AS (SELECT {key}feature, min(v) AS lo0, max(v) AS hi0 FROM h_v GROUP BY {key}feature),
h_b AS (SELECT {key}feature, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM h_r),
h_g AS (SELECT h_b.*, i::INT AS bin FROM h_b, range(1, {bins} + 1) t(i)),
h_c AS (SELECT {f'v.{by}, ' if by else ''}v.feature, least(floor((v - lo) / (hi - lo) * {bins})::INT + 1, {bins}) AS bin,
  count(*) AS n FROM h_v v JOIN h_b b ON v.feature = b.feature {f'AND v.{by} = b.{by}' if by else ''}
  GROUP BY ALL)
SELECT {f'g.{by}, ' if by else ''}g.feature, g.bin, {r6(f'lo + (hi - lo) / {bins} * (g.bin - 1)', 4)} AS bin_low,
  {r6(f'lo + (hi - lo) / {bins} * g.bin', 4)} AS bin_high, coalesce(n, 0) AS n
FROM h_g g LEFT JOIN h_c b ON g.feature = b.feature AND g.bin = b.bin {on}"""
    return flat


def _histogram(df, bins, by=None):
    made = profile.histogram(df, MODEL_FEATURES, bins, by)
    keys = [by] if by else []
    return made.select(
        *keys, "feature", "bin", rounded("bin_low", 4).alias("bin_low"), rounded("bin_high", 4).alias("bin_high"), "n"
    )


@query(f"{FLOWS}, {_histogram_sql(MODEL_FEATURES, 10, 'flows')}")
def histogram_10(spark, sf_dir):
    return _histogram(stored_flows(spark, sf_dir), 10)


@query(f"{FLOWS}, {sql.split_cte('flows', 'sp')}, {_histogram_sql(MODEL_FEATURES, 30, 'sp', 'split')}")
def histogram_30_by_split(spark, sf_dir):
    return _histogram(split.stratified_split(stored_flows(spark, sf_dir), "flow_id"), 30, "split")


# --- Splitting and scaling --------------------------------------------------

@query(f"{FLOWS}, {sql.split_cte('flows', 'sp')} SELECT flow_id, Label, split FROM sp")
def stratified_split_rows(spark, sf_dir):
    return split.stratified_split(
        durable(flows(spark, sf_dir).select("flow_id", LABEL), "labels"), "flow_id"
    )


@query(f"""{FLOWS}, {sql.split_cte('flows', 'sp')}
SELECT Label, split, count(*) AS n FROM sp GROUP BY Label, split""")
def stratified_split_counts(spark, sf_dir):
    df = split.stratified_split(
        durable(flows(spark, sf_dir).select("flow_id", LABEL), "labels"), "flow_id"
    )
    return df.groupBy(LABEL, "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderkey,
  row_number() OVER (ORDER BY {u(42, 'shuffle', 'o_orderkey::VARCHAR')}, o_orderkey) - 1 AS position FROM orders""")
def seeded_shuffle_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.dense_index(orders, "o_orderkey", 42, "shuffle", out="position")


@query("SELECT o_orderkey, o_custkey FROM orders")
def seeded_shuffle(spark, sf_dir):
    return split.seeded_shuffle(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(f"{FLOWS}, {sql.split_cte('flows', 'sp')} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r6(f'avg({c})', 3)} AS mean, {r6(f'stddev_pop({c})', 3)} AS std
    FROM sp WHERE split = 'train'""" for c in MODEL_FEATURES))
def scaler_stats(spark, sf_dir):
    stats = fit_scaler(split.stratified_split(stored_flows(spark, sf_dir), "flow_id"), MODEL_FEATURES, "split")
    return stats.select("feature", rounded("mean", 3).alias("mean"), rounded("std", 3).alias("std"))


_SCALED = f"""{FLOWS}, {sql.split_cte('flows', 'sp')},
{sql.scale_cte('sp', 'sc', MODEL_FEATURES, "split = 'train'")}"""


@query(f"{_SCALED} SELECT flow_id, Label, split, {', '.join(f'{r6(c)} AS {c}' for c in MODEL_FEATURES)} FROM sc")
def scale_all_splits(spark, sf_dir):
    df = scale(split.stratified_split(stored_flows(spark, sf_dir), "flow_id"), MODEL_FEATURES)
    return df.select("flow_id", LABEL, "split", *[rounded(c).alias(c) for c in MODEL_FEATURES])


_THREE = ["packet_entropy", "timing_variance", "quantum_noise_simulation"]
_THREE_SQL = ", ".join(f"{r6(c)} AS {c}" for c in _THREE)


@query(f"{_SCALED}, {sql.feature_ctes('sc', 'ft')} SELECT flow_id, split, {_THREE_SQL} FROM ft")
def features_on_scaled(spark, sf_dir):
    """The engineered features computed from standardised columns."""
    df = scale(split.stratified_split(stored_flows(spark, sf_dir), "flow_id"), MODEL_FEATURES)
    return ft.add_engineered_features(df).select("flow_id", "split", *[rounded(c).alias(c) for c in _THREE])
