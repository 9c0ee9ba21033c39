"""The 55-column labelled network-flow record and its column groups."""

from pyspark.sql import types as T

# Names, order and types of the flow record.
_FLOW_COLUMNS = """
FLOW_START_MILLISECONDS bigint
FLOW_END_MILLISECONDS bigint
IPV4_SRC_ADDR string
L4_SRC_PORT bigint
IPV4_DST_ADDR string
L4_DST_PORT bigint
PROTOCOL bigint
L7_PROTO double
IN_BYTES bigint
IN_PKTS bigint
OUT_BYTES bigint
OUT_PKTS bigint
TCP_FLAGS bigint
CLIENT_TCP_FLAGS bigint
SERVER_TCP_FLAGS bigint
FLOW_DURATION_MILLISECONDS bigint
DURATION_IN bigint
DURATION_OUT bigint
MIN_TTL bigint
MAX_TTL bigint
LONGEST_FLOW_PKT bigint
SHORTEST_FLOW_PKT bigint
MIN_IP_PKT_LEN bigint
MAX_IP_PKT_LEN bigint
SRC_TO_DST_SECOND_BYTES double
DST_TO_SRC_SECOND_BYTES double
RETRANSMITTED_IN_BYTES bigint
RETRANSMITTED_IN_PKTS bigint
RETRANSMITTED_OUT_BYTES bigint
RETRANSMITTED_OUT_PKTS bigint
SRC_TO_DST_AVG_THROUGHPUT bigint
DST_TO_SRC_AVG_THROUGHPUT bigint
NUM_PKTS_UP_TO_128_BYTES bigint
NUM_PKTS_128_TO_256_BYTES bigint
NUM_PKTS_256_TO_512_BYTES bigint
NUM_PKTS_512_TO_1024_BYTES bigint
NUM_PKTS_1024_TO_1514_BYTES bigint
TCP_WIN_MAX_IN bigint
TCP_WIN_MAX_OUT bigint
ICMP_TYPE bigint
ICMP_IPV4_TYPE bigint
DNS_QUERY_ID bigint
DNS_QUERY_TYPE bigint
DNS_TTL_ANSWER bigint
FTP_COMMAND_RET_CODE bigint
SRC_TO_DST_IAT_MIN bigint
SRC_TO_DST_IAT_MAX bigint
SRC_TO_DST_IAT_AVG bigint
SRC_TO_DST_IAT_STDDEV bigint
DST_TO_SRC_IAT_MIN bigint
DST_TO_SRC_IAT_MAX bigint
DST_TO_SRC_IAT_AVG bigint
DST_TO_SRC_IAT_STDDEV bigint
Label bigint
Attack string
"""

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}

FLOW_SCHEMA = T.StructType(
    [
        T.StructField(name, _TYPES[kind])
        for name, kind in (line.split() for line in _FLOW_COLUMNS.split("\n") if line)
    ]
)

LABEL = "Label"
ATTACK = "Attack"

# Identifier columns that are dropped before modelling.
ID_COLS = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT"]

# Inputs of the packet-entropy feature.
BYTES_FEATURES = [
    "IN_BYTES",
    "OUT_BYTES",
    "LONGEST_FLOW_PKT",
    "SHORTEST_FLOW_PKT",
    "MIN_IP_PKT_LEN",
    "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES",
    "RETRANSMITTED_IN_BYTES",
    "RETRANSMITTED_OUT_BYTES",
    "NUM_PKTS_UP_TO_128_BYTES",
    "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES",
    "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES",
]

# Inputs of the timing-variance feature.
TIMING_FEATURES = [
    "FLOW_DURATION_MILLISECONDS",
    "DURATION_IN",
    "DURATION_OUT",
    "SRC_TO_DST_IAT_MIN",
    "SRC_TO_DST_IAT_MAX",
    "SRC_TO_DST_IAT_AVG",
    "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN",
    "DST_TO_SRC_IAT_MAX",
    "DST_TO_SRC_IAT_AVG",
    "DST_TO_SRC_IAT_STDDEV",
    "FLOW_START_MILLISECONDS",
    "FLOW_END_MILLISECONDS",
]

# Inputs of the noise-channel feature.
NOISE_FEATURES = [
    "IN_BYTES",
    "OUT_BYTES",
    "IN_PKTS",
    "OUT_PKTS",
    "RETRANSMITTED_IN_BYTES",
    "RETRANSMITTED_OUT_BYTES",
    "RETRANSMITTED_IN_PKTS",
    "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES",
    "SRC_TO_DST_IAT_MIN",
    "SRC_TO_DST_IAT_MAX",
    "SRC_TO_DST_IAT_AVG",
    "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN",
    "DST_TO_SRC_IAT_MAX",
    "DST_TO_SRC_IAT_AVG",
    "DST_TO_SRC_IAT_STDDEV",
]

# Class names; the first is the class with label 0.
ATTACK_CLASSES = [
    "Normal",
    "DoS",
    "Exploits",
    "Fuzzers",
    "Reconnaissance",
    "Worms",
    "Shellcode",
    "Backdoor",
    "Analysis",
]

ENGINEERED = ["packet_entropy", "timing_variance", "quantum_noise_simulation"]

# Every numeric column that a model is trained on (no identifiers, no label).
MODEL_FEATURES = [
    f.name
    for f in FLOW_SCHEMA.fields
    if f.name not in ID_COLS and f.name not in (LABEL, ATTACK)
]

# A balanced table, and the same with its split and engineered features.
RESAMPLED_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.LongType() if f.name == LABEL else T.DoubleType())
        for f in FLOW_SCHEMA.fields
        if f.name not in (*ID_COLS, ATTACK)
    ]
)
ENGINEERED_SCHEMA = T.StructType(
    [
        *RESAMPLED_SCHEMA.fields,
        T.StructField("split", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ENGINEERED],
    ]
)
