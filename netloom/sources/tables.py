"""Flow records derived from the order tables: an order is a flow, its line items the packets."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.schema import ATTACK_CLASSES, FLOW_SCHEMA


# Expected bytes of combined packets in a task, of packets in a task that combines them.
PART_BYTES, PACKET_BYTES = 4 << 20, 2 << 20
# Shares of the input that packets of equal flow, direction and time are combined in.
SHARES = 16


def _parts(rows: DataFrame, part_bytes=None) -> int:
    """Partitions by the size Spark expects of the rows: a task's share does not grow with the table."""
    spark, part_bytes = rows.sparkSession, part_bytes or PART_BYTES
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 2**62:  # not known, as of rows that come from an RDD
        size = part_bytes * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(spark.sparkContext.defaultParallelism, size // part_bytes), 100_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: list) -> Column:
    """Element ``key % len(values)`` of a fixed list."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _address(key: Column) -> Column:
    octet = lambda x: (x % 256).cast("string")
    return F.concat_ws(
        ".", F.lit("10"), octet(F.floor(key / 65536)), octet(F.floor(key / 256)), octet(key)
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet table: flow key, direction, time in days since the epoch, length, retransmission."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("flow_id"),
        (F.col("l_linestatus") == "O").alias("inbound"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("t"),
        (F.col("l_quantity") * 30).cast("bigint").alias("length"),
        (F.col("l_returnflag") == "R").alias("retransmitted"),
        F.col("l_suppkey").alias("peer"),
    )


def flow_counters(packets: DataFrame) -> DataFrame:
    """Per-flow packet counters.

    Packets are first combined per (flow, direction, time, share of the input), in as many
    tasks as their size asks for: a hot flow is spread over its times and shrinks to them, and
    no task holds the groups of a whole input split. One repartition by flow then serves the
    rest of the combining, the gap window, the flow aggregate and the join that follows.
    """
    length, one = F.col("length"), F.lit(1)
    count_when = lambda c: F.sum(F.when(c, one).otherwise(0)).cast("bigint")
    slot = ["flow_id", "inbound", "t"]
    dealt = packets.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    dealt = dealt.repartition(_parts(dealt, PACKET_BYTES), *slot, "share")
    shares = dealt.groupBy(*slot, "share").agg(
        F.count(one).alias("pkts"),
        F.sum(length).alias("bytes"),
        count_when(F.col("retransmitted")).alias("re_pkts"),
        F.sum(F.when(F.col("retransmitted"), length).otherwise(0)).alias("re_bytes"),
        F.max(length).alias("longest"),
        F.min(length).alias("shortest"),
        count_when(length <= 128).alias("n128"),
        count_when((length > 128) & (length <= 256)).alias("n256"),
        count_when((length > 256) & (length <= 512)).alias("n512"),
        count_when((length > 512) & (length <= 1024)).alias("n1024"),
        count_when(length > 1024).alias("n1514"),
        F.min("peer").alias("peer"),
    )
    rest = {"longest": F.max, "shortest": F.min, "peer": F.min}
    combined = [c for c in shares.columns if c not in (*slot, "share")]
    slots = shares.repartition(_parts(shares), "flow_id").groupBy(*slot).agg(
        *[rest.get(c, F.sum)(c).alias(c) for c in combined])
    by_time = Window.partitionBy("flow_id", "inbound").orderBy("t")
    slots = slots.withColumn("gap", F.col("t") - F.lag("t").over(by_time))

    def directed(side: Column, tag: str) -> list:
        only = lambda c: F.when(side, F.col(c))
        total = lambda c: F.coalesce(F.sum(only(c)), F.lit(0)).cast("bigint")
        # Packets that share a time are zero gaps apart.
        smallest = F.min(F.when(side, F.when(F.col("pkts") > 1, 0).otherwise(F.col("gap"))))
        return [
            total("pkts").alias(f"{tag}_pkts"),
            total("bytes").alias(f"{tag}_bytes"),
            total("re_pkts").alias(f"{tag}_re_pkts"),
            total("re_bytes").alias(f"{tag}_re_bytes"),
            F.coalesce(F.max(only("t")) - F.min(only("t")), F.lit(0)).alias(f"{tag}_span"),
            F.coalesce(smallest, F.lit(0)).cast("bigint").alias(f"{tag}_gap_min"),
            F.coalesce(F.max(only("gap")), F.lit(0)).cast("bigint").alias(f"{tag}_gap_max"),
            F.coalesce(F.sum(F.when(side, F.col("gap") * F.col("gap"))), F.lit(0))
            .cast("bigint")
            .alias(f"{tag}_gap_squares"),
        ]

    sums = ["n128", "n256", "n512", "n1024", "n1514"]
    return slots.groupBy("flow_id").agg(
        F.min("t").alias("t_first"),
        F.max("t").alias("t_last"),
        F.max("longest").alias("longest"),
        F.min("shortest").alias("shortest"),
        F.min("peer").alias("peer"),
        *[F.sum(c).cast("bigint").alias(c) for c in sums],
        *directed(F.col("inbound"), "in"),
        *directed(~F.col("inbound"), "out"),
    )


def _flow_columns() -> dict:
    key, label = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    seconds = F.greatest((F.col("t_last") - F.col("t_first")) / F.lit(1000.0), F.lit(0.001))
    rate = lambda tag: F.col(f"{tag}_bytes") / seconds
    icmp = _pick(key, [0, 8, 3, 11])
    min_ttl = _pick(key, [64, 128, 255])

    def gaps(tag: str, prefix: str) -> dict:
        m = F.col(f"{tag}_pkts") - 1
        span, squares = F.col(f"{tag}_span"), F.col(f"{tag}_gap_squares")
        spread = F.sqrt((m * squares - span * span).cast("double")) / m
        return {
            f"{prefix}_IAT_MIN": F.col(f"{tag}_gap_min"),
            f"{prefix}_IAT_MAX": F.col(f"{tag}_gap_max"),
            f"{prefix}_IAT_AVG": F.when(m > 0, F.floor(span / m)).otherwise(0),
            f"{prefix}_IAT_STDDEV": F.when(m > 0, F.floor(spread)).otherwise(0),
        }

    return {
        "FLOW_START_MILLISECONDS": F.col("t_first"),
        "FLOW_END_MILLISECONDS": F.col("t_last"),
        "IPV4_SRC_ADDR": _address(F.col("o_custkey")),
        "L4_SRC_PORT": 1024 + F.col("o_custkey") % 64511,
        "IPV4_DST_ADDR": _address(F.col("peer")),
        "L4_DST_PORT": _pick(key, [80, 443, 22, 53, 25, 21, 23, 993, 995]),
        "PROTOCOL": F.when(F.col("o_orderstatus") == "P", 6)
        .when(F.col("o_orderstatus") == "F", 17)
        .otherwise(1),
        "L7_PROTO": _pick(key, [1.0, 6.0, 17.0, 80.0, 443.0, 53.0]),
        "IN_BYTES": F.col("in_bytes"),
        "IN_PKTS": F.col("in_pkts"),
        "OUT_BYTES": F.col("out_bytes"),
        "OUT_PKTS": F.col("out_pkts"),
        "TCP_FLAGS": key % 8191,
        "CLIENT_TCP_FLAGS": F.floor((key % 8191) / 2),
        "SERVER_TCP_FLAGS": F.floor((key % 8191) / 2),
        "FLOW_DURATION_MILLISECONDS": F.col("t_last") - F.col("t_first"),
        "DURATION_IN": F.col("in_span"),
        "DURATION_OUT": F.col("out_span"),
        "MIN_TTL": min_ttl,
        "MAX_TTL": min_ttl + key % 10,
        "LONGEST_FLOW_PKT": F.col("longest"),
        "SHORTEST_FLOW_PKT": F.col("shortest"),
        "MIN_IP_PKT_LEN": F.col("shortest"),
        "MAX_IP_PKT_LEN": F.col("longest"),
        "SRC_TO_DST_SECOND_BYTES": rate("in"),
        "DST_TO_SRC_SECOND_BYTES": rate("out"),
        "RETRANSMITTED_IN_BYTES": F.col("in_re_bytes"),
        "RETRANSMITTED_IN_PKTS": F.col("in_re_pkts"),
        "RETRANSMITTED_OUT_BYTES": F.col("out_re_bytes"),
        "RETRANSMITTED_OUT_PKTS": F.col("out_re_pkts"),
        "SRC_TO_DST_AVG_THROUGHPUT": F.floor(8 * rate("in")),
        "DST_TO_SRC_AVG_THROUGHPUT": F.floor(8 * rate("out")),
        "NUM_PKTS_UP_TO_128_BYTES": F.col("n128"),
        "NUM_PKTS_128_TO_256_BYTES": F.col("n256"),
        "NUM_PKTS_256_TO_512_BYTES": F.col("n512"),
        "NUM_PKTS_512_TO_1024_BYTES": F.col("n1024"),
        "NUM_PKTS_1024_TO_1514_BYTES": F.col("n1514"),
        "TCP_WIN_MAX_IN": _pick(key, [65535, 8192, 16384, 32768]),
        "TCP_WIN_MAX_OUT": _pick(key, [8192, 65535, 32768, 16384]),
        "ICMP_TYPE": icmp * 256 + key % 16,
        "ICMP_IPV4_TYPE": icmp,
        "DNS_QUERY_ID": 1 + key % 65534,
        "DNS_QUERY_TYPE": _pick(key, [1, 2, 5, 15, 28]),
        "DNS_TTL_ANSWER": _pick(key, [300, 600, 3600, 86400]),
        "FTP_COMMAND_RET_CODE": _pick(key, [200, 220, 230, 331, 530]),
        **gaps("in", "SRC_TO_DST"),
        **gaps("out", "DST_TO_SRC"),
        "Label": F.when(label, 1).otherwise(0),
        "Attack": F.when(label, _pick(key, ATTACK_CLASSES[1:])).otherwise(ATTACK_CLASSES[0]),
    }


def flows(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """``flow_id`` plus the 55 flow columns. ``how='right'`` keeps orders without packets."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    counters = flow_counters(packets(spark, sf_dir))
    joined = counters.join(orders, counters.flow_id == orders.o_orderkey, how)
    made = _flow_columns()
    return joined.select(
        F.col("o_orderkey").alias("flow_id"),
        *[made[f.name].cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA.fields],
    )
