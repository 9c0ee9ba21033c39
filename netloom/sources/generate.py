"""Synthetic flow records: every value is a function of (seed, row id)."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import seeded
from netloom.plans.sizing import durable, join_small
from netloom.schema import ATTACK_CLASSES, FLOW_SCHEMA

DEFAULT_BASE_MS = 1_700_000_000_000
_RANGE = 8_192
# Ranges of ids that a task generates.
_TASK_RANGES = 16


def poisson_cdf(rate: float) -> list:
    """Cumulative Poisson probabilities up to double precision."""
    term = total = math.exp(-rate)
    out = [total]
    while total < 1 - 1e-13:
        term *= rate / len(out)
        total += term
        out.append(total)
    return out


def _poisson(u: Column, rate: float) -> Column:
    steps = F.array(*[F.lit(v) for v in poisson_cdf(rate)])
    return F.size(F.filter(steps, lambda v: v <= u)).cast("bigint")


def _whole(c: Column) -> Column:
    return c.cast("bigint")


def _later_sums(parts: DataFrame, levels: int) -> DataFrame:
    """``(_part, _after)``: sums of the later parts, over ``levels`` levels of ranges of parts.

    With two levels a task of the last window orders one row per _RANGE ** 3 ids.
    """
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return parts.select("_part", F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_after"))
    grouped = parts.withColumn("_group", F.floor(F.col("_part") / _RANGE).cast("bigint"))
    above = grouped.groupBy(F.col("_group").alias("_part")).agg(F.sum("_sum").alias("_sum"))
    outer = _later_sums(above, levels - 1).toDF("_group", "_outer")
    inner = Window.partitionBy("_group").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    own = grouped.withColumn("_own", F.coalesce(F.sum("_sum").over(inner), F.lit(0)))
    return own.join(outer, "_group").select("_part", (F.col("_own") + F.col("_outer")).alias("_after"))


def start_times(ids: DataFrame, id_col: str, seed, base_ms: int) -> DataFrame:
    """Adds FLOW_START_MILLISECONDS: base minus the sum of the hour-long gaps from this id on.

    Gaps are summed inside ranges of ids and shifted by the total of the later ranges, which
    is found alike over ranges of ranges.
    """
    rows = ids.withColumns(
        {
            "_gap": _whole(seeded.exponential(seeded.uniform(seed, "start", id_col), 3_600_000.0)),
            "_part": F.floor(F.col(id_col) / _RANGE).cast("bigint"),
        }
    )
    parts = durable(rows.groupBy("_part").agg(F.sum("_gap").alias("_sum")), "parts")
    offsets = _later_sums(parts, 2)
    # These rows are narrow, but what is made of them is not: tasks by number of ranges, not by bytes.
    tasks = max(ids.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // _TASK_RANGES))
    rows = rows.repartition(tasks, "_part")
    inside = Window.partitionBy("_part").orderBy(F.desc(id_col)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_gap").over(inside)
    return join_small(rows.withColumn("_own", total), offsets, ["_part"]).withColumn(
        "FLOW_START_MILLISECONDS", F.lit(base_ms).cast("bigint") - F.col("_own") - F.col("_after")
    ).drop("_gap", "_part", "_own", "_after")


def generate_flows(ids: DataFrame, id_col: str = "id", seed=42, base_ms: int = DEFAULT_BASE_MS) -> DataFrame:
    """One synthetic flow per id: the id and the 55 flow columns."""
    # Every uniform a column asks for is an item of one array, filled in a single expression.
    tags = []

    def u(tag: str) -> Column:
        tags.append(tag)
        return F.get("_u", F.lit(len(tags) - 1))

    normal = lambda tag: seeded.gaussian(u(f"{tag}.r"), u(f"{tag}.a"))
    pick = lambda tag, values: seeded.choice(u(tag), values)
    whole = lambda tag, low, high: seeded.integer(u(tag), low, high)
    lognormal = lambda tag, mu: _whole(F.exp(F.lit(mu) + 2.0 * normal(tag)))
    decay = lambda tag, mean: _whole(seeded.exponential(u(tag), mean))
    one = F.lit(1).cast("bigint")

    def address(tag: str) -> Column:
        octets = [(1, 224), (0, 256), (0, 256), (1, 255)]
        return F.concat_ws(".", *[whole(f"{tag}{i}", a, b).cast("string") for i, (a, b) in enumerate(octets)])

    share = u("protocol")
    drawn = {
        "IPV4_SRC_ADDR": address("src"),
        "L4_SRC_PORT": whole("sport", 1024, 65535),
        "IPV4_DST_ADDR": address("dst"),
        "L4_DST_PORT": pick("dport", [80, 443, 22, 53, 25, 21, 23, 993, 995]),
        "PROTOCOL": F.when(share < 0.7, 6).when(share < 0.95, 17).otherwise(1),
        "L7_PROTO": pick("l7", [1.0, 6.0, 17.0, 80.0, 443.0, 53.0]),
        "IN_BYTES": lognormal("inbytes", 10.0),
        "OUT_BYTES": lognormal("outbytes", 9.0),
        "IN_PKTS": _poisson(u("inpkts"), 20.0),
        "OUT_PKTS": _poisson(u("outpkts"), 15.0),
        "FLOW_DURATION_MILLISECONDS": F.greatest(one, decay("duration", 1000.0)),
        "TCP_FLAGS": whole("flags", 0, 8191),
        "MIN_TTL": pick("ttl", [64, 128, 255]),
        "SHORTEST_FLOW_PKT": whole("short", 40, 1500),
        "RETRANSMITTED_IN_PKTS": _poisson(u("rein"), 1.0),
        "RETRANSMITTED_OUT_PKTS": _poisson(u("reout"), 1.0),
        "TCP_WIN_MAX_IN": pick("winin", [65535, 8192, 16384, 32768]),
        "TCP_WIN_MAX_OUT": pick("winout", [65535, 8192, 16384, 32768]),
        "ICMP_IPV4_TYPE": pick("icmp", [0, 8, 3, 11]),
        "DNS_QUERY_ID": whole("dns", 1, 65535),
        "DNS_QUERY_TYPE": pick("dnstype", [1, 2, 5, 15, 28]),
        "DNS_TTL_ANSWER": pick("dnsttl", [300, 600, 3600, 86400]),
        "FTP_COMMAND_RET_CODE": pick("ftp", [200, 220, 230, 331, 530]),
        "SRC_TO_DST_IAT_MIN": F.greatest(one, decay("siat", 10.0)),
        "DST_TO_SRC_IAT_MIN": F.greatest(one, decay("diat", 10.0)),
        "SRC_TO_DST_IAT_STDDEV": decay("ssd", 5.0),
        "DST_TO_SRC_IAT_STDDEV": decay("dsd", 5.0),
        "Label": F.when(u("label") < 0.7, 0).otherwise(1),
    }
    c = F.col
    duration = c("FLOW_DURATION_MILLISECONDS")
    seconds = F.greatest(duration / 1000.0, F.lit(0.001))
    # Gamma variates of whole shape are sums of exponentials; their shares are a Dirichlet draw.
    gamma = lambda tag, shape: sum(
        (seeded.exponential(u(f"{tag}.{i}"), 1.0) for i in range(1, shape)),
        seeded.exponential(u(f"{tag}.0"), 1.0),
    )
    derived = {
        "_in": _whole(duration * (0.3 + 0.4 * u("durin"))),
        "_out": _whole(duration * (0.3 + 0.4 * u("durout"))),
        "_sizes": F.array(*[gamma(f"size{i}", shape) for i, shape in enumerate([5, 4, 3, 2, 1])]),
        "SRC_TO_DST_SECOND_BYTES": c("IN_BYTES") / seconds,
        "DST_TO_SRC_SECOND_BYTES": c("OUT_BYTES") / seconds,
        "SRC_TO_DST_IAT_MAX": c("SRC_TO_DST_IAT_MIN") + F.greatest(one, decay("siatmax", 100.0)),
        "DST_TO_SRC_IAT_MAX": c("DST_TO_SRC_IAT_MIN") + F.greatest(one, decay("diatmax", 100.0)),
        "LONGEST_FLOW_PKT": c("SHORTEST_FLOW_PKT") + whole("long", 0, 500),
    }
    both = c("_in") + c("_out")
    squeeze = F.when(both > duration, duration / F.greatest(both, one)).otherwise(1.0)
    weight = F.aggregate("_sizes", F.lit(0.0), lambda acc, v: acc + v)
    packets = c("IN_PKTS") + c("OUT_PKTS")
    slot = lambda i: _whole(packets * (F.get("_sizes", F.lit(i)) / weight))

    def middle(prefix: str, tag: str) -> Column:
        low, high = c(f"{prefix}_IAT_MIN"), c(f"{prefix}_IAT_MAX")
        return F.least(high, F.greatest(low, _whole((low + high) / 2.0 + 5.0 * normal(tag))))

    names = ["UP_TO_128", "128_TO_256", "256_TO_512", "512_TO_1024", "1024_TO_1514"]
    final = {
        "FLOW_END_MILLISECONDS": c("FLOW_START_MILLISECONDS") + duration,
        "DURATION_IN": _whole(c("_in") * squeeze),
        "DURATION_OUT": _whole(c("_out") * squeeze),
        "CLIENT_TCP_FLAGS": _whole(c("TCP_FLAGS") * (0.4 + 0.2 * u("client"))),
        "SERVER_TCP_FLAGS": _whole(c("TCP_FLAGS") * (0.4 + 0.2 * u("server"))),
        "MAX_TTL": c("MIN_TTL") + whole("maxttl", 0, 10),
        "MIN_IP_PKT_LEN": c("SHORTEST_FLOW_PKT"),
        "MAX_IP_PKT_LEN": c("LONGEST_FLOW_PKT"),
        "RETRANSMITTED_IN_BYTES": c("RETRANSMITTED_IN_PKTS") * whole("reinlen", 64, 1500),
        "RETRANSMITTED_OUT_BYTES": c("RETRANSMITTED_OUT_PKTS") * whole("reoutlen", 64, 1500),
        "SRC_TO_DST_AVG_THROUGHPUT": _whole(8 * c("SRC_TO_DST_SECOND_BYTES")),
        "DST_TO_SRC_AVG_THROUGHPUT": _whole(8 * c("DST_TO_SRC_SECOND_BYTES")),
        **{f"NUM_PKTS_{n}_BYTES": slot(i) for i, n in enumerate(names)},
        "ICMP_TYPE": c("ICMP_IPV4_TYPE") * 256 + whole("icmpcode", 0, 16),
        "SRC_TO_DST_IAT_AVG": middle("SRC_TO_DST", "siatavg"),
        "DST_TO_SRC_IAT_AVG": middle("DST_TO_SRC", "diatavg"),
        "Attack": F.when(c("Label") == 0, ATTACK_CLASSES[0]).otherwise(
            pick("attack", ATTACK_CLASSES[1:])
        ),
    }
    df = start_times(ids.select(id_col), id_col, seed, base_ms)
    x, y = seeded.row_state(seed, id_col)
    df = df.withColumns({"_x": x, "_y": y}).withColumn("_u", seeded.uniforms(tags, "_x", "_y"))
    for stage in (drawn, derived, final):
        df = df.withColumns(stage)
    return df.select(id_col, *[c(f.name).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA.fields])


def generate(spark: SparkSession, n: int = 50_000, seed=42, base_ms: int = DEFAULT_BASE_MS) -> DataFrame:
    """``n`` synthetic flows with ids 0..n-1."""
    return generate_flows(spark.range(n), "id", seed, base_ms)
