"""Queries on time series, payloads, noise channels, generation, evaluation and streams."""

import math

from pyspark.sql import functions as F

from netloom.catalogue import sql
from netloom.catalogue.flow_queries import _DIRTY, _THREE, FLOWS, _dirty_flows, rounded
from netloom.catalogue.sql import r6, u
from netloom.functions import channels as ch
from netloom.functions.instants import micros
from netloom.functions.features import add_noise_components, quantum_noise_simulation
from netloom.operators import clean, evaluate, frequent, series, states
from netloom.operators.profile import value_counts
from netloom.operators.resample import augment_gaussian
from netloom.operators.scale import fit_scaler
from netloom.plans.sizing import durable, scratch_path
from netloom.schema import ATTACK, ATTACK_CLASSES, FLOW_SCHEMA, LABEL, MODEL_FEATURES
from netloom.sources import flow_files
from netloom.sources.generate import DEFAULT_BASE_MS, generate_flows, poisson_cdf
from netloom.sources.tables import flows, table
from netloom.streaming import flow_stream, frequent_stream, running, scaler_stream

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


# --- Time series and payloads -----------------------------------------------

_MEAN = f"CASE WHEN events > 1 THEN {r6('gap_mean')} END AS gap_mean"
_SPREAD = f"""CASE WHEN events = 2 THEN 0.0 WHEN events > 2 THEN {r6('gap_std')} END AS gap_std,
  CASE WHEN events = 2 THEN 0.0 WHEN events > 2 THEN {r6('gap_std / gap_mean')} END AS gap_cv"""


def _gaps_sql(keys):
    return f"""WITH g AS (SELECT {keys}, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts)) / 1e6 AS gap
  FROM events), s AS (SELECT {keys}, count(*) AS events, avg(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_mean,
  stddev_samp(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_std FROM g GROUP BY {keys})
SELECT {keys}, events, {_MEAN}, {_SPREAD} FROM s"""


def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("us", micros(events, "ts"))


def _gaps(spark, sf_dir, keys):
    df = series.interarrival(_events(spark, sf_dir), keys, "us", unit=1e6)
    return df.select(*keys, "events", *[rounded(c).alias(c) for c in ("gap_mean", "gap_std", "gap_cv")])


@query(_gaps_sql("user_id"))
def interarrival_by_user(spark, sf_dir):
    return _gaps(spark, sf_dir, ["user_id"])


@query(_gaps_sql("user_id, event_type"))
def interarrival_by_user_type(spark, sf_dir):
    return _gaps(spark, sf_dir, ["user_id", "event_type"])


@query("""WITH b AS (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
SELECT user_id, NOT coalesce(bool_or(back), FALSE) AS in_order FROM b GROUP BY user_id""")
def events_in_time_order(spark, sf_dir):
    return series.in_time_order(_events(spark, sf_dir), ["user_id"], "event_id", "us", width=1000)


def _bytes_sql(keys, source, column):
    return f"""WITH h AS (SELECT {keys}, hex(encode({column})) AS x FROM {source} WHERE length({column}) > 0),
b AS (SELECT {keys}, unnest(regexp_extract_all(x, '..')) AS byte FROM h)
SELECT {keys}, count(*) AS bytes, {r6('entropy(byte)')} AS entropy FROM b GROUP BY {keys}"""


@query(_bytes_sql("doc_id", "documents", "text").replace("count(*) AS bytes, ", ""))
def document_byte_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", rounded(series.byte_entropy("text")).alias("entropy")
    )


@query(_bytes_sql("source", "documents", "text"))
def entropy_by_source(spark, sf_dir):
    df = series.byte_entropy_by(table(spark, sf_dir, "documents"), ["source"], "text")
    return df.withColumn("entropy", rounded("entropy"))


_BARE = "(SELECT source, CASE WHEN source = 'src1' THEN '' WHEN source <> 'src2' THEN text END AS text FROM documents)"


@query(f"""SELECT source, coalesce(bytes, 0) AS bytes, entropy FROM (SELECT DISTINCT source FROM documents)
LEFT JOIN ({_bytes_sql("source", _BARE, "text")}) USING (source)""")
def entropy_by_source_with_empty(spark, sf_dir):
    """One source with empty texts only, one with missing texts only."""
    text = F.when(F.col("source") == "src1", "").when(F.col("source") != "src2", F.col("text"))
    df = series.byte_entropy_by(table(spark, sf_dir, "documents").withColumn("text", text), ["source"], "text")
    return df.withColumn("entropy", rounded("entropy"))


@query(_bytes_sql("role", "conversations", "text"))
def entropy_by_role(spark, sf_dir):
    df = series.byte_entropy_by(table(spark, sf_dir, "conversations"), ["role"], "text")
    return df.withColumn("entropy", rounded("entropy"))


# --- Noise channels ---------------------------------------------------------

_GRID = ", ".join(f"{p!r}::DOUBLE" for p in ch.DEFAULT_GRID)


def _entropy_sql(g, base=2):
    log = "log2({0})" if base == 2 else f"(ln({{0}}) / ln({base}::DOUBLE))"
    part = lambda v: f"CASE WHEN {v} > 1e-15 THEN -({v}) * {log.format(v)} ELSE 0 END"
    return f"({part(f'((1 - {g}) / 2)')} + {part(f'((1 + {g}) / 2)')})"


def _sweep_sql(channel, base=2, state=None):
    bit = channel == "bit"
    c = "sqrt(q * (1 - q))" if state is None else "c0"
    source = state or f"{FLOWS}, {sql.noise_ctes('flows', 'nz')}, st AS (SELECT flow_id, q FROM nz)"
    return f"""{source},
s0 AS (SELECT flow_id, q, {c} AS c, unnest([{_GRID}]) AS p FROM st),
s1 AS (SELECT *, {'(1 - p) * q + p * (1 - q)' if bit else 'q'} AS r00, {'c' if bit else '(1 - p) * c - p * c'} AS r01 FROM s0),
s2 AS (SELECT *, sqrt((2 * r00 - 1) ** 2 + 4 * r01 * r01) AS g,
  least(1, greatest(0, q * r00 + (1 - q) * (1 - r00) + 2 * c * r01
    + 2 * sqrt(greatest(0, q * (1 - q) - c * c) * greatest(0, r00 * (1 - r00) - r01 * r01)))) AS f2 FROM s1)
SELECT flow_id, {r6('q')} AS q, {r6('c')} AS c, '{channel}' AS channel, p, {r6('sqrt(f2)', 5)} AS fidelity,
  {r6('f2')} AS fidelity_sq, {r6('(1 + g * g) / 2')} AS purity, {r6(_entropy_sql('g', base))} AS entropy,
  {r6('r00')} AS r00, {r6('r01')} AS r01, {r6('1 - r00')} AS r11 FROM s2"""


def _sweep(states_df, names, base=2):
    rows = states.channel_sweep(states_df, "flow_id", None, names, base)
    floats = ["q", "c", "fidelity_sq", "purity", "entropy", "r00", "r01", "r11"]
    return rows.withColumns({c: rounded(c) for c in floats}).withColumn("fidelity", rounded("fidelity", 5))


def _states(spark, sf_dir):
    return add_noise_components(flows(spark, sf_dir)).select("flow_id", "q")


@query(_sweep_sql("bit"))
def channel_sweep_bit(spark, sf_dir):
    return _sweep(_states(spark, sf_dir), ["bit"])


@query(_sweep_sql("bit"))
def channel_sweep_grid_table(spark, sf_dir):
    """The grid of p comes from a table."""
    grid = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 11 / 10).alias("p")).distinct()
    rows = states.channel_sweep(_states(spark, sf_dir), "flow_id", grid, ["bit"])
    floats = ["q", "c", "fidelity_sq", "purity", "entropy", "r00", "r01", "r11"]
    return rows.withColumns({c: rounded(c) for c in floats}).withColumn("fidelity", rounded("fidelity", 5))


@query(_sweep_sql("phase"))
def channel_sweep_phase(spark, sf_dir):
    return _sweep(_states(spark, sf_dir), ["phase"])


@query(_sweep_sql("phase", 2, "WITH st AS (SELECT o_orderkey AS flow_id, 0.5::DOUBLE AS q, 0.5::DOUBLE AS c0 FROM orders)"))
def channel_sweep_default_state(spark, sf_dir):
    """The equal superposition for every order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flow_id"))
    return _sweep(states.default_state(orders), ["phase"])


@query(f"""{FLOWS}, {sql.noise_ctes('flows', 'nz')}
SELECT flow_id, {r6(_entropy_sql('g_bit', math.e))} AS entropy_e, {r6(_entropy_sql('g_bit', 10))} AS entropy_10 FROM nz""")
def entropy_base_e(spark, sf_dir):
    df = add_noise_components(flows(spark, sf_dir))
    g = ch.spread(F.col("q"), ch.pure_coherence(F.col("q")), F.col("p"), "bit")
    return df.select(
        "flow_id",
        rounded(ch.spread_entropy(g, math.e)).alias("entropy_e"),
        rounded(ch.spread_entropy(g, 10)).alias("entropy_10"),
    )


_MATRIX = """mx AS (SELECT flow_id, IN_BYTES / (IN_BYTES + OUT_BYTES) AS r00, OUT_PKTS / (IN_PKTS + OUT_PKTS) AS r11,
  sqrt(RETRANSMITTED_IN_PKTS * RETRANSMITTED_OUT_PKTS) / (IN_PKTS + OUT_PKTS) AS r01,
  sqrt(RETRANSMITTED_IN_PKTS * RETRANSMITTED_IN_PKTS) / (IN_PKTS + OUT_PKTS) AS r10 FROM flows)"""


def _matrices(spark, sf_dir):
    """A 2x2 matrix per flow, from its traffic shares; many are no valid states."""
    packets = F.col("IN_PKTS") + F.col("OUT_PKTS")
    lost_in, lost_out = F.col("RETRANSMITTED_IN_PKTS"), F.col("RETRANSMITTED_OUT_PKTS")
    return flows(spark, sf_dir).select(
        "flow_id",
        (F.col("IN_BYTES") / (F.col("IN_BYTES") + F.col("OUT_BYTES"))).alias("r00"),
        (F.col("OUT_PKTS") / packets).alias("r11"),
        (F.sqrt((lost_in * lost_out).cast("double")) / packets).alias("r01"),
        (F.sqrt((lost_in * lost_in).cast("double")) / packets).alias("r10"),
    )


@query(f"""{FLOWS}, {_MATRIX}, fl AS (SELECT flow_id, abs(r01 - r10) <= 1e-10 AS hermitian, abs(r00 + r11 - 1) <= 1e-10 AS unit_trace,
  r00 >= -1e-10 AND r11 >= -1e-10 AND r01 * r10 <= r00 * r11 + 1e-10 AS positive FROM mx)
SELECT *, hermitian AND unit_trace AS valid FROM fl""")
def state_validity(spark, sf_dir):
    df = states.state_validity(_matrices(spark, sf_dir))
    return df.select("flow_id", "hermitian", "unit_trace", "positive", "valid")


_CLIP = lambda v: f"(CASE WHEN {v} <= 1e-15 THEN 0 ELSE {v} END)"
_XLOG = lambda v: f"(CASE WHEN {v} > 1e-15 THEN -({v}) * log2({v}) ELSE 0 END)"


@query(f"""{FLOWS}, {_MATRIX}, m1 AS (SELECT *, r00 + r11 AS t FROM mx),
m2 AS (SELECT *, sqrt((r00 - r11) ** 2 + 4 * r01 * r01) AS g FROM m1),
m3 AS (SELECT *, (t - g) / 2 AS lo, (t + g) / 2 AS hi,
  CASE WHEN abs(t) > 1e-8 THEN (1 - g / t) / 2 END AS nlo, CASE WHEN abs(t) > 1e-8 THEN (1 + g / t) / 2 END AS nhi FROM m2),
m4 AS (SELECT *, {_CLIP('nlo')} + {_CLIP('nhi')} AS s FROM m3)
SELECT flow_id, {r6(f"{_XLOG('lo')} + {_XLOG('hi')}")} AS plain,
  {r6(f"CASE WHEN abs(t) > 1e-8 THEN {_XLOG(_CLIP('nlo') + ' / s')} + {_XLOG(_CLIP('nhi') + ' / s')} ELSE 0 END")} AS normalized
FROM m4""")
def matrix_entropy(spark, sf_dir):
    """Entropy of matrices as they are, and divided by their trace."""
    parts = [F.col(c) for c in ("r00", "r01", "r11")]
    return _matrices(spark, sf_dir).select(
        "flow_id",
        rounded(ch.matrix_entropy(*parts)).alias("plain"),
        rounded(ch.matrix_entropy(*parts, normalize=True)).alias("normalized"),
    )


# --- Generator --------------------------------------------------------------

def _generated_sql(seed=42, base=DEFAULT_BASE_MS):
    key = "o_orderkey::VARCHAR"
    un = lambda tag: u(seed, tag, key) if tag == "start" else sql.draw(tag)
    exp = lambda tag, mean: f"(-{mean}::DOUBLE * ln(1 - {un(tag)}))"
    decay = lambda tag, mean: f"trunc({exp(tag, mean)})::BIGINT"
    normal = lambda tag: f"(sqrt(-2::DOUBLE * ln(1 - {un(tag + '.r')})) * cos(6.283185307179586e0 * {un(tag + '.a')}))"
    whole = lambda tag, a, b: f"({a} + floor({un(tag)} * {b - a}))::BIGINT"
    pick = lambda tag, values: f"([{', '.join(map(str, values))}])[{whole(tag, 0, len(values))} + 1]"
    steps = lambda rate: "[" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in poisson_cdf(rate)) + "]"
    poisson = lambda tag, rate: f"len(list_filter({steps(rate)}, lambda v: v <= {un(tag)}))::BIGINT"
    ip = lambda tag: " || '.' || ".join(
        f"{whole(f'{tag}{i}', a, b)}::VARCHAR" for i, (a, b) in enumerate([(1, 224), (0, 256), (0, 256), (1, 255)])
    )
    gamma = lambda tag, n: "(" + " + ".join(exp(f"{tag}.{i}", 1) for i in range(n)) + ")"
    windows = [65535, 8192, 16384, 32768]
    names = ", ".join(f"'{a}'" for a in ATTACK_CLASSES[1:])
    first = {
        "gap": decay("start", 3600000), "IPV4_SRC_ADDR": ip("src"), "L4_SRC_PORT": whole("sport", 1024, 65535),
        "IPV4_DST_ADDR": ip("dst"), "L4_DST_PORT": pick("dport", [80, 443, 22, 53, 25, 21, 23, 993, 995]),
        "PROTOCOL": f"CASE WHEN {un('protocol')} < 0.7::DOUBLE THEN 6 WHEN {un('protocol')} < 0.95::DOUBLE THEN 17 ELSE 1 END",
        "L7_PROTO": pick("l7", [1, 6, 17, 80, 443, 53]) + "::DOUBLE",
        "IN_BYTES": f"trunc(exp(10 + 2 * {normal('inbytes')}))::BIGINT",
        "OUT_BYTES": f"trunc(exp(9 + 2 * {normal('outbytes')}))::BIGINT",
        "IN_PKTS": poisson("inpkts", 20.0), "OUT_PKTS": poisson("outpkts", 15.0),
        "dur": f"greatest(1, {decay('duration', 1000)})", "TCP_FLAGS": whole("flags", 0, 8191),
        "MIN_TTL": pick("ttl", [64, 128, 255]), "SHORTEST_FLOW_PKT": whole("short", 40, 1500),
        "RETRANSMITTED_IN_PKTS": poisson("rein", 1.0), "RETRANSMITTED_OUT_PKTS": poisson("reout", 1.0),
        "TCP_WIN_MAX_IN": pick("winin", windows), "TCP_WIN_MAX_OUT": pick("winout", windows),
        "ICMP_IPV4_TYPE": pick("icmp", [0, 8, 3, 11]), "DNS_QUERY_ID": whole("dns", 1, 65535),
        "DNS_QUERY_TYPE": pick("dnstype", [1, 2, 5, 15, 28]), "DNS_TTL_ANSWER": pick("dnsttl", [300, 600, 3600, 86400]),
        "FTP_COMMAND_RET_CODE": pick("ftp", [200, 220, 230, 331, 530]),
        "SRC_TO_DST_IAT_MIN": f"greatest(1, {decay('siat', 10)})", "DST_TO_SRC_IAT_MIN": f"greatest(1, {decay('diat', 10)})",
        "smax": f"greatest(1, {decay('siatmax', 100)})", "dmax": f"greatest(1, {decay('diatmax', 100)})",
        "SRC_TO_DST_IAT_STDDEV": decay("ssd", 5), "DST_TO_SRC_IAT_STDDEV": decay("dsd", 5),
        "Label": f"CASE WHEN {un('label')} < 0.7::DOUBLE THEN 0 ELSE 1 END", "long": whole("long", 0, 500),
        "du": un("durin"), "dv": un("durout"), "cl": un("client"), "sv": un("server"),
        **{f"w{i}": gamma(f"size{i}", n) for i, n in enumerate([5, 4, 3, 2, 1])},
        "ttladd": whole("maxttl", 0, 10), "rl": whole("reinlen", 64, 1500), "sl": whole("reoutlen", 64, 1500),
        "code": whole("icmpcode", 0, 16), "sn": normal("siatavg"), "dn": normal("diatavg"),
        "kind": f"([{names}])[{whole('attack', 0, 8)} + 1]",
    }
    span = lambda d: f"trunc(dur * (0.3::DOUBLE + 0.4::DOUBLE * {d}))::BIGINT"
    squeeze = "CASE WHEN di + dx > dur THEN dur / greatest(di + dx, 1)::DOUBLE ELSE 1 END"
    seconds = "greatest(dur / 1000::DOUBLE, 0.001::DOUBLE)"
    mid = lambda p, m, n: (
        f"least({p}_IAT_MIN + {m}, greatest({p}_IAT_MIN, trunc((2 * {p}_IAT_MIN + {m}) / 2 + 5 * {n})::BIGINT))"
    )
    last = {
        "FLOW_START_MILLISECONDS": "st", "FLOW_END_MILLISECONDS": "st + dur", "FLOW_DURATION_MILLISECONDS": "dur",
        "CLIENT_TCP_FLAGS": "trunc(TCP_FLAGS * (0.4::DOUBLE + 0.2::DOUBLE * cl))::BIGINT",
        "SERVER_TCP_FLAGS": "trunc(TCP_FLAGS * (0.4::DOUBLE + 0.2::DOUBLE * sv))::BIGINT",
        "DURATION_IN": f"trunc(di * ({squeeze}))::BIGINT", "DURATION_OUT": f"trunc(dx * ({squeeze}))::BIGINT",
        "MAX_TTL": "MIN_TTL + ttladd", "LONGEST_FLOW_PKT": "SHORTEST_FLOW_PKT + long",
        "MIN_IP_PKT_LEN": "SHORTEST_FLOW_PKT", "MAX_IP_PKT_LEN": "SHORTEST_FLOW_PKT + long",
        "SRC_TO_DST_SECOND_BYTES": f"IN_BYTES / {seconds}", "DST_TO_SRC_SECOND_BYTES": f"OUT_BYTES / {seconds}",
        "RETRANSMITTED_IN_BYTES": "RETRANSMITTED_IN_PKTS * rl", "RETRANSMITTED_OUT_BYTES": "RETRANSMITTED_OUT_PKTS * sl",
        "SRC_TO_DST_AVG_THROUGHPUT": f"trunc(8 * (IN_BYTES / {seconds}))::BIGINT",
        "DST_TO_SRC_AVG_THROUGHPUT": f"trunc(8 * (OUT_BYTES / {seconds}))::BIGINT",
        "ICMP_TYPE": "ICMP_IPV4_TYPE * 256 + code",
        "SRC_TO_DST_IAT_MAX": "SRC_TO_DST_IAT_MIN + smax", "DST_TO_SRC_IAT_MAX": "DST_TO_SRC_IAT_MIN + dmax",
        "SRC_TO_DST_IAT_AVG": mid("SRC_TO_DST", "smax", "sn"), "DST_TO_SRC_IAT_AVG": mid("DST_TO_SRC", "dmax", "dn"),
        "Attack": "CASE WHEN Label = 0 THEN 'Normal' ELSE kind END",
    }
    total = "(w0 + w1 + w2 + w3 + w4)"
    for i, size in enumerate(["UP_TO_128", "128_TO_256", "256_TO_512", "512_TO_1024", "1024_TO_1514"]):
        last[f"NUM_PKTS_{size}_BYTES"] = f"trunc((IN_PKTS + OUT_PKTS) * (w{i} / {total}))::BIGINT"
    whole_numbers = [f.name for f in FLOW_SCHEMA.fields if f.dataType.simpleString() == "bigint"]

    def cell(n):
        value = last.get(n, n)
        if n in whole_numbers:
            return f"({value})::BIGINT"
        return r6(value, 3) if n.endswith("SECOND_BYTES") else value

    shown = ", ".join(f"{cell(n)} AS {n}" for n in FLOW_SCHEMA.names)
    return f"""WITH a AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in first.items())}
  FROM (SELECT o_orderkey, {sql.row_state(seed, key)} FROM orders)),
b AS (SELECT *, {base} - (sum(gap) OVER (ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS st,
  {span('du')} AS di, {span('dv')} AS dx FROM a)
SELECT o_orderkey, {shown} FROM b"""


@query(_generated_sql())
def generated_flows(spark, sf_dir):
    """One synthetic flow per order."""
    df = generate_flows(table(spark, sf_dir, "orders"), "o_orderkey")
    return df.withColumns(
        {c: rounded(c, 3) for c in ("SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES")}
    )


@query(f"""WITH g AS ({_generated_sql()}) SELECT Attack, count(*) AS "count" FROM g GROUP BY Attack""")
def generated_attack_counts(spark, sf_dir):
    """Generate, write, read back and count the classes."""
    path = scratch_path(spark, "generated")
    made = generate_flows(table(spark, sf_dir, "orders"), "o_orderkey").drop("o_orderkey")
    flow_files.save_table(made, path, "parquet")
    return value_counts(flow_files.load_flows(spark, path, "parquet"), ATTACK)


# --- Documented-only operators ----------------------------------------------

_RATES = ["SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES"]


def _impute_sql(aggregate):
    known = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
    fills = ", ".join(aggregate.format(known(c)) + f" AS f_{c}" for c in _RATES)
    shown = ", ".join(f"{r6(f'coalesce({known(c)}, f_{c})', 4)} AS {c}" for c in _RATES)
    return f"{_DIRTY}, fl AS (SELECT {fills} FROM dirty) SELECT flow_id, {shown} FROM dirty, fl"


def _impute(spark, sf_dir, strategy):
    df = clean.impute(_dirty_flows(spark, sf_dir).select("flow_id", *_RATES), _RATES, strategy)
    return df.select("flow_id", *[rounded(c, 4).alias(c) for c in _RATES])


@query(_impute_sql("avg({})"))
def impute_mean(spark, sf_dir):
    return _impute(spark, sf_dir, "mean")


@query(_impute_sql("quantile_cont({}, 0.5)"))
def impute_median(spark, sf_dir):
    return _impute(spark, sf_dir, "median")


@query(f"""{FLOWS}, {sql.noise_ctes('flows', 'nz')}
SELECT flow_id, {r6('''0.6::DOUBLE * quantum_noise_simulation + 0.25::DOUBLE * (SRC_TO_DST_IAT_AVG / 1000)
  + 0.15::DOUBLE * (MIN_TTL / 255)''')} AS level FROM nz""")
def security_level(spark, sf_dir):
    """Channel noise as threat, mean gap as latency, remaining hops as battery."""
    df = flows(spark, sf_dir)
    level = evaluate.security_level(
        quantum_noise_simulation(df), F.col("SRC_TO_DST_IAT_AVG") / 1000, F.col("MIN_TTL") / 255
    )
    return df.select("flow_id", rounded(level).alias("level"))


_NOISED = ["IN_BYTES", "OUT_BYTES", "SRC_TO_DST_IAT_AVG"]


def _augment_sql():
    noise = lambda c: (
        f"{c} + 2.5::DOUBLE * (sqrt(-2::DOUBLE * ln(1 - {u(42, f'noise.{c}.r', 'flow_id::VARCHAR')}))"
        f" * cos(6.283185307179586e0 * {u(42, f'noise.{c}.a', 'flow_id::VARCHAR')}))"
    )
    plain = ", ".join(f"{c}::DOUBLE AS {c}" for c in _NOISED)
    noisy = ", ".join(f"{r6(noise(c), 5)} AS {c}" for c in _NOISED)
    return (
        f"{FLOWS} SELECT flow_id, {plain}, FALSE AS is_augmented FROM flows"
        f" UNION ALL SELECT flow_id, {noisy}, TRUE FROM flows"
    )


@query(_augment_sql())
def augment_with_noise(spark, sf_dir):
    df = augment_gaussian(flows(spark, sf_dir).select("flow_id", *_NOISED), "flow_id", _NOISED, 2.5)
    return df.withColumns({c: rounded(c, 5) for c in _NOISED})


_SCORED = f"""{FLOWS}, {sql.noise_ctes('flows', 'nz')},
sc AS (SELECT flow_id, Label, round(quantum_noise_simulation, 9) AS s FROM nz)"""


def _scored(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.select("flow_id", LABEL, F.round(quantum_noise_simulation(df), 9).alias("s"))


@query(f"""{_SCORED}, rk AS (SELECT Label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM sc),
t AS (SELECT sum(r) FILTER (WHERE Label = 1) AS w, count(*) FILTER (WHERE Label = 1) AS p, count(*) FILTER (WHERE Label = 0) AS n FROM rk)
SELECT p AS positives, n AS negatives, {r6('(w - p * (p + 1) / 2) / (p::DOUBLE * n)')} AS auc FROM t""")
def auc_of_noise_score(spark, sf_dir):
    df = evaluate.roc_auc(_scored(spark, sf_dir), LABEL, "s")
    return df.withColumn("auc", rounded("auc"))


@query(f"""{_SCORED}, c AS (SELECT count(*) FILTER (WHERE Label = 1 AND s >= 0.3) AS tp,
  count(*) FILTER (WHERE Label = 0 AND s >= 0.3) AS fp, count(*) FILTER (WHERE Label = 1 AND s < 0.3) AS fn,
  avg(-CASE WHEN Label = 1 THEN ln(greatest(1e-15, s)) ELSE ln(1 - least(s, 1 - 1e-15)) END) AS ll FROM sc)
SELECT tp, fp, fn, {r6('tp / (tp + fp)')} AS precision, {r6('tp / (tp + fn)')} AS recall,
  {r6('2 * tp / (2 * tp + fp + fn)')} AS f1, {r6('ll')} AS log_loss FROM c""")
def f1_logloss_of_noise_score(spark, sf_dir):
    df = evaluate.threshold_metrics(_scored(spark, sf_dir), LABEL, "s", 0.3)
    return df.withColumns({c: rounded(c) for c in ("precision", "recall", "f1", "log_loss")})


_TOP_ADDRESSES = f"""{FLOWS} SELECT IPV4_SRC_ADDR, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, IPV4_SRC_ADDR LIMIT 100"""


@query(_TOP_ADDRESSES)
def top_source_addresses(spark, sf_dir):
    """The hundred most frequent source addresses, counted exactly behind a bounded summary."""
    narrow = durable(flows(spark, sf_dir).select("IPV4_SRC_ADDR"), "addresses")
    return frequent.top_values(narrow, "IPV4_SRC_ADDR", 100)


# --- Streams ----------------------------------------------------------------

@query(f"""{FLOWS}, {sql.scale_cte('flows', 'sc', MODEL_FEATURES)}, {sql.feature_ctes('sc', 'ft')}
SELECT flow_id, {', '.join(f'{r6(c)} AS {c}' for c in _THREE)} FROM ft""")
def stream_features(spark, sf_dir):
    """Flows arrive as files; features on scaler statistics frozen beforehand."""
    arriving = scratch_path(spark, "arriving")
    made = flows(spark, sf_dir)
    made.write.option("maxRecordsPerFile", 500_000).parquet(arriving)
    history = spark.read.schema(made.schema).parquet(arriving)
    stats = fit_scaler(history, MODEL_FEATURES)
    stream = flow_stream.read_stream(spark, arriving, made.schema, files_per_trigger=2)
    tasks = spark.sparkContext.defaultParallelism
    made = flow_stream.run_available(
        flow_stream.stream_features(stream, stats, tasks).select("flow_id", *_THREE), "features"
    )
    return made.select("flow_id", *[rounded(c).alias(c) for c in _THREE])


_LEARNED = ["IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS", "SRC_TO_DST_SECOND_BYTES"]


@query(f"{FLOWS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std FROM flows" for c in _LEARNED))
def stream_scaler(spark, sf_dir):
    """Scaler statistics learned from arriving files, batch by batch."""
    arriving, store = scratch_path(spark, "arriving"), scratch_path(spark, "scaler")
    history = flows(spark, sf_dir).select("flow_id", *_LEARNED)
    history.write.option("maxRecordsPerFile", 100_000).parquet(arriving)
    stream = flow_stream.read_stream(spark, arriving, history.schema, files_per_trigger=2)
    scaler_stream.run_learning(stream, _LEARNED, store, store + "-progress")
    stats = scaler_stream.learned_scaler(spark, store)
    return stats.select("feature", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(_TOP_ADDRESSES)
def stream_top_source_addresses(spark, sf_dir):
    """The same of arriving files: every batch leaves its summary, the arrived rows are counted behind all of them."""
    arriving, store = scratch_path(spark, "arriving"), scratch_path(spark, "summaries")
    flows(spark, sf_dir).select("IPV4_SRC_ADDR").write.option("maxRecordsPerFile", 500_000).parquet(arriving)
    arrived = spark.read.parquet(arriving)
    stream = flow_stream.read_stream(spark, arriving, arrived.schema, files_per_trigger=4)
    frequent_stream.run_summaries(stream, "IPV4_SRC_ADDR", store, store + "-progress")
    return frequent.top_values(arrived, "IPV4_SRC_ADDR", 100, frequent.stored_summary(spark, store))


def _windows_sql(closed):
    keep = "WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE" if closed else ""
    return f"""WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events),
g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY window_start, event_type ORDER BY ts)) / 1e6 AS gap FROM w),
s AS (SELECT window_start, event_type, count(*) AS events, avg(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_mean,
  stddev_samp(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_std FROM g GROUP BY 1, 2)
SELECT epoch_us(window_start) AS window_us, event_type, events, {_SPREAD} FROM s {keep}"""


def _window_columns(df):
    return df.withColumns({c: rounded(c) for c in ("gap_std", "gap_cv")})


@query(_windows_sql(False))
def interarrival_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _window_columns(flow_stream.interarrival_windows(events, ["event_type"], "ts", "6 hours"))


@query(_windows_sql(True))
def stream_interarrival_windows(spark, sf_dir):
    """The same on a stream; windows the watermark has not passed stay open."""
    schema = table(spark, sf_dir, "events").schema
    stream = flow_stream.read_stream(spark, sf_dir, schema, "events.parquet")
    windows = flow_stream.interarrival_windows(stream, ["event_type"], "ts", "6 hours")
    return _window_columns(flow_stream.run_available(windows, "windows"))


@query(f"""WITH e AS (SELECT * FROM events WHERE date_trunc('second', ts) + INTERVAL 1 SECOND
  <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE),
g AS (SELECT user_id, epoch_us(ts) AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM e),
s AS (SELECT user_id, max(us) AS upto_us, count(*) AS events, avg(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_mean,
  stddev_samp(CASE WHEN gap = 0 THEN 1e-9 ELSE gap END) AS gap_std FROM g GROUP BY user_id)
SELECT user_id, upto_us, events, {_MEAN}, {_SPREAD} FROM s""")
def stream_running_gaps(spark, sf_dir):
    """Deviation of all gaps of a user so far, kept in state across windows; panes behind the watermark count."""
    schema = table(spark, sf_dir, "events").schema
    stream = flow_stream.read_stream(spark, sf_dir, schema, "events.parquet")
    with running.keyed_state(spark):
        made = flow_stream.run_available(running.running_gaps(stream, ["user_id"], "ts"), "running")
    return running.latest(made, ["user_id"]).select(
        "user_id", "upto_us", "events", *[rounded(c).alias(c) for c in ("gap_mean", "gap_std", "gap_cv")])


def _entropy_windows_sql(closed):
    keep = """WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(window_start) FROM w) - INTERVAL 10 MINUTE""" if closed else ""
    return f"""WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events),
h AS (SELECT window_start, event_type, hex(encode(props)) AS x FROM w WHERE length(props) > 0),
b AS (SELECT window_start, event_type, unnest(regexp_extract_all(x, '..')) AS byte FROM h),
e AS (SELECT window_start, event_type, count(*) AS bytes, {r6('entropy(byte)')} AS entropy FROM b GROUP BY 1, 2)
SELECT epoch_us(window_start) AS window_us, event_type, coalesce(bytes, 0) AS bytes, entropy
FROM (SELECT DISTINCT window_start, event_type FROM w) LEFT JOIN e USING (window_start, event_type) {keep}"""


@query(_entropy_windows_sql(False))
def entropy_windows(spark, sf_dir):
    """Byte entropy of the events' properties per type and six hours."""
    windows = flow_stream.entropy_windows(table(spark, sf_dir, "events"), ["event_type"], "ts", "props", "6 hours")
    return windows.withColumn("entropy", rounded("entropy"))


@query(_entropy_windows_sql(True))
def stream_entropy_windows(spark, sf_dir):
    """The same on a stream; windows the watermark has not passed stay open."""
    schema = table(spark, sf_dir, "events").schema
    stream = flow_stream.read_stream(spark, sf_dir, schema, "events.parquet")
    windows = flow_stream.entropy_windows(stream, ["event_type"], "ts", "props", "6 hours")
    return flow_stream.run_available(windows, "entropy-windows").withColumn("entropy", rounded("entropy"))
