"""Shared DuckDB fragments for the oracle queries."""

import hashlib

from netloom.schema import ATTACK_CLASSES, FLOW_SCHEMA


def u(seed, tag, row_id):
    """Seeded uniform, written for DuckDB."""
    return (
        f"(('0x' || substr(md5('{seed}:{tag}:' || {row_id}), 1, 13))::BIGINT"
        f" / 4503599627370496::DOUBLE)"
    )


def draw(tag):
    """Uniform of a tag from the row's numbers ``ux`` and ``uy``, see ``row_state``."""
    digest = hashlib.md5(tag.encode()).hexdigest()
    a, b = (1 + int(digest[i : i + 15], 16) % 2147483646 for i in (0, 15))
    return f"(((ux * {a}) % 2147483647 + (uy * {b}) % 2147483647) % 2147483647 / 2147483647::DOUBLE)"


def row_state(seed, row_id):
    """Columns ``ux`` and ``uy``, written for DuckDB."""
    part = lambda start: f"('0x' || substr(md5('{seed}:' || {row_id}), {start}, 15))::BIGINT % 2147483647"
    return f"{part(1)} AS ux, {part(16)} AS uy"


def nudge(digits):
    """A shift far below the last kept digit, so that exact halves round alike in both engines."""
    return float(f"1.3e-{digits + 3}")


def r6(expr, digits=6):
    return f"round({expr} + {nudge(digits)!r}, {digits}) + 0.0"


def _pick(values, key="o_orderkey"):
    return f"([{', '.join(map(str, values))}])[({key} % {len(values)} + 1)::INT]"


def _address(key):
    return (
        f"'10.' || ({key} // 65536 % 256)::VARCHAR || '.' || ({key} // 256 % 256)::VARCHAR"
        f" || '.' || ({key} % 256)::VARCHAR"
    )


def _direction(prefix, tag):
    side = f"FILTER (WHERE d = '{tag}')"
    return f"""
    count(*) {side} AS {prefix}_pkts,
    coalesce(sum(len) {side}, 0)::BIGINT AS {prefix}_bytes,
    count(*) FILTER (WHERE d = '{tag}' AND r) AS {prefix}_re_pkts,
    coalesce(sum(len) FILTER (WHERE d = '{tag}' AND r), 0)::BIGINT AS {prefix}_re_bytes,
    coalesce(max(t) {side} - min(t) {side}, 0) AS {prefix}_span,
    coalesce(min(gap) {side}, 0) AS {prefix}_min,
    coalesce(max(gap) {side}, 0) AS {prefix}_max,
    coalesce(sum(gap) {side}, 0)::BIGINT AS {prefix}_s1,
    coalesce(sum(gap * gap) {side}, 0)::BIGINT AS {prefix}_s2"""


def _flow_select():
    seconds = "greatest((t1 - t0) / 1000::DOUBLE, 0.001::DOUBLE)"
    icmp = _pick([0, 8, 3, 11])
    ttl = _pick([64, 128, 255])
    names = ", ".join(f"'{a}'" for a in ATTACK_CLASSES[1:])
    out = {
        "FLOW_START_MILLISECONDS": "t0",
        "FLOW_END_MILLISECONDS": "t1",
        "IPV4_SRC_ADDR": _address("o_custkey"),
        "L4_SRC_PORT": "1024 + o_custkey % 64511",
        "IPV4_DST_ADDR": _address("supp"),
        "L4_DST_PORT": _pick([80, 443, 22, 53, 25, 21, 23, 993, 995]),
        "PROTOCOL": "CASE o_orderstatus WHEN 'P' THEN 6 WHEN 'F' THEN 17 ELSE 1 END",
        "L7_PROTO": _pick([1, 6, 17, 80, 443, 53]),
        "IN_BYTES": "i_bytes", "IN_PKTS": "i_pkts", "OUT_BYTES": "o_bytes", "OUT_PKTS": "o_pkts",
        "TCP_FLAGS": "o_orderkey % 8191",
        "CLIENT_TCP_FLAGS": "(o_orderkey % 8191) // 2",
        "SERVER_TCP_FLAGS": "(o_orderkey % 8191) // 2",
        "FLOW_DURATION_MILLISECONDS": "t1 - t0",
        "DURATION_IN": "i_span", "DURATION_OUT": "o_span",
        "MIN_TTL": ttl, "MAX_TTL": f"{ttl} + o_orderkey % 10",
        "LONGEST_FLOW_PKT": "hi", "SHORTEST_FLOW_PKT": "lo",
        "MIN_IP_PKT_LEN": "lo", "MAX_IP_PKT_LEN": "hi",
        "SRC_TO_DST_SECOND_BYTES": f"i_bytes / {seconds}",
        "DST_TO_SRC_SECOND_BYTES": f"o_bytes / {seconds}",
        "RETRANSMITTED_IN_BYTES": "i_re_bytes", "RETRANSMITTED_IN_PKTS": "i_re_pkts",
        "RETRANSMITTED_OUT_BYTES": "o_re_bytes", "RETRANSMITTED_OUT_PKTS": "o_re_pkts",
        "SRC_TO_DST_AVG_THROUGHPUT": f"trunc(8 * (i_bytes / {seconds}))",
        "DST_TO_SRC_AVG_THROUGHPUT": f"trunc(8 * (o_bytes / {seconds}))",
        "NUM_PKTS_UP_TO_128_BYTES": "n1", "NUM_PKTS_128_TO_256_BYTES": "n2",
        "NUM_PKTS_256_TO_512_BYTES": "n3", "NUM_PKTS_512_TO_1024_BYTES": "n4",
        "NUM_PKTS_1024_TO_1514_BYTES": "n5",
        "TCP_WIN_MAX_IN": _pick([65535, 8192, 16384, 32768]),
        "TCP_WIN_MAX_OUT": _pick([8192, 65535, 32768, 16384]),
        "ICMP_TYPE": f"{icmp} * 256 + o_orderkey % 16", "ICMP_IPV4_TYPE": icmp,
        "DNS_QUERY_ID": "1 + o_orderkey % 65534",
        "DNS_QUERY_TYPE": _pick([1, 2, 5, 15, 28]),
        "DNS_TTL_ANSWER": _pick([300, 600, 3600, 86400]),
        "FTP_COMMAND_RET_CODE": _pick([200, 220, 230, 331, 530]),
        "Label": "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END",
        "Attack": "CASE WHEN o_orderpriority = '1-URGENT' THEN "
        f"([{names}])[(o_orderkey % 8 + 1)::INT] ELSE 'Normal' END",
    }
    for prefix, d in (("SRC_TO_DST", "i"), ("DST_TO_SRC", "o")):
        m = f"({d}_pkts - 1)"
        out[f"{prefix}_IAT_MIN"] = f"{d}_min"
        out[f"{prefix}_IAT_MAX"] = f"{d}_max"
        out[f"{prefix}_IAT_AVG"] = f"CASE WHEN {m} > 0 THEN trunc({d}_s1 / {m}) ELSE 0 END"
        out[f"{prefix}_IAT_STDDEV"] = (
            f"CASE WHEN {m} > 0 THEN"
            f" trunc(sqrt(({m} * {d}_s2 - {d}_s1 * {d}_s1)::DOUBLE) / {m}) ELSE 0 END"
        )
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    return ",\n    ".join(
        f"({out[f.name]})::{kinds[f.dataType.simpleString()]} AS {f.name}"
        for f in FLOW_SCHEMA.fields
    )


def flow_ctes(join="JOIN"):
    """CTE list that ends in ``flows``: ``WITH`` + this + further CTEs + query."""
    return f"""pk AS (
  SELECT l_orderkey AS k, l_linestatus AS d, epoch_ms(l_shipdate) // 86400000 AS t,
         (l_quantity * 30)::BIGINT AS len, l_returnflag = 'R' AS r, l_suppkey AS s
  FROM lineitem),
gp AS (SELECT *, t - lag(t) OVER (PARTITION BY k, d ORDER BY t) AS gap FROM pk),
ag AS (
  SELECT k, min(t) AS t0, max(t) AS t1, max(len) AS hi, min(len) AS lo, min(s) AS supp,
    count(*) FILTER (WHERE len <= 128) AS n1,
    count(*) FILTER (WHERE len > 128 AND len <= 256) AS n2,
    count(*) FILTER (WHERE len > 256 AND len <= 512) AS n3,
    count(*) FILTER (WHERE len > 512 AND len <= 1024) AS n4,
    count(*) FILTER (WHERE len > 1024) AS n5,{_direction("i", "O")},{_direction("o", "F")}
  FROM gp GROUP BY k),
flows AS (
  SELECT o_orderkey AS flow_id,
    {_flow_select()}
  FROM orders {join} ag ON k = o_orderkey)"""


def _values(columns, source_columns, default):
    return ", ".join(
        f"{c}::DOUBLE" if c in source_columns else default for c in columns if c in source_columns or default
    )


def packet_entropy(columns, present=None):
    present = columns if present is None else present
    values = _values(columns, present, "0::DOUBLE")
    byte = "CASE WHEN abs(v) < 2147483648 THEN ((trunc(v) % 256) + 256) % 256 ELSE 0 END"
    kept = f"list_filter([{values}], lambda v: v IS NOT NULL AND NOT isnan(v))"
    return f"coalesce(list_aggregate(list_transform({kept}, lambda v: {byte}), 'entropy'), 0)"


def timing_variance(columns):
    """Needs a subquery: returns (column list for the inner select, outer expression)."""
    values = _values(columns, columns, "")
    inner = f"list_sort(list_filter([{values}], lambda v: v IS NOT NULL AND NOT isnan(v))) AS tv_s"
    gaps = (
        "list_transform(range(1, len(tv_s)), lambda i:"
        " CASE WHEN tv_s[i + 1] = tv_s[i] THEN 1e-9 ELSE tv_s[i + 1] - tv_s[i] END) AS tv_g"
    )
    outer = (
        "CASE WHEN len(tv_s) < 3 THEN 0 ELSE"
        " list_aggregate(tv_g, 'stddev_samp') / list_aggregate(tv_g, 'avg') END"
    )
    return inner, gaps, outer


def noise_ctes(source, target, keep="*"):
    """CTEs from a flow table to its flip probability parts and entropy (``target``)."""
    v = lambda c: f"greatest(0, CASE WHEN {c} IS NULL OR isnan({c}::DOUBLE) THEN 0 ELSE {c} END)::DOUBLE"
    mean = lambda a: f"({v('SRC_TO_DST_' + a)} + {v('DST_TO_SRC_' + a)}) / 2"
    part = "CASE WHEN {0} > 1e-15 THEN -({0}) * log2({0}) ELSE 0 END"
    ent = lambda g: "(" + part.format(f"((1 - {g}) / 2)") + " + " + part.format(f"((1 + {g}) / 2)") + ")"
    return f"""{target}_a AS (SELECT {keep},
    {v('IN_BYTES')} AS z_in, {v('IN_BYTES')} + {v('OUT_BYTES')} AS z_total,
    {v('RETRANSMITTED_IN_BYTES')} + {v('RETRANSMITTED_OUT_BYTES')} AS z_lost,
    ({v('RETRANSMITTED_IN_PKTS')} / greatest(1, {v('IN_PKTS')})
      + {v('RETRANSMITTED_OUT_PKTS')} / greatest(1, {v('OUT_PKTS')})) / 2 AS p_retrans,
    0.1::DOUBLE * least(1, {mean('IAT_STDDEV')} / 1000) AS p_iat,
    {mean('IAT_MAX')} AS z_max, {mean('IAT_AVG')} AS z_avg, {mean('IAT_MIN')} AS z_min,
    {mean('SECOND_BYTES')} AS z_rate FROM {source}),
{target}_b AS (SELECT *,
    CASE WHEN z_total > 0 THEN z_in / z_total ELSE 0.5::DOUBLE END AS q,
    CASE WHEN z_total > 0 THEN z_lost / z_total ELSE 0 END AS p_bytes,
    CASE WHEN z_avg > 0 THEN
        CASE WHEN z_max / z_avg > 1 THEN least(0.25::DOUBLE, (z_max / z_avg - 1) / 10) ELSE 0 END
      WHEN z_max > 0 THEN least(0.25::DOUBLE, z_max / 10000) ELSE 0 END AS p_timing_iat,
    CASE WHEN z_max > 0 THEN least(0.05::DOUBLE, (z_max - z_min) / z_max * 0.1::DOUBLE)
      ELSE 0 END AS p_timing_range,
    CASE WHEN z_rate > 0 THEN least(0.05::DOUBLE, greatest(0, (1000 - z_rate) / 10000))
      ELSE 0.05::DOUBLE END AS p_timing_speed
  FROM {target}_a),
{target}_c AS (SELECT *, least(0.3::DOUBLE, p_timing_iat + p_timing_speed + p_timing_range) AS p_timing
  FROM {target}_b),
{target}_d AS (SELECT *, greatest(0.001::DOUBLE, least(1, greatest(0, 0.5::DOUBLE * p_retrans
    + 0.2::DOUBLE * p_iat + 0.2::DOUBLE * p_bytes + 0.1::DOUBLE * p_timing))) AS p FROM {target}_c),
{target}_e AS (SELECT *, (2 * q - 1) ** 2 AS z_d, 4 * q * (1 - q) AS z_o, (1 - 2 * p) ** 2 AS z_f
  FROM {target}_d),
{target}_f AS (SELECT *, sqrt(z_f * z_d + z_o) AS g_bit, sqrt(z_d + z_f * z_o) AS g_phase FROM {target}_e),
{target} AS (SELECT *, ({ent('g_bit')} + {ent('g_phase')}) / 2 AS quantum_noise_simulation
  FROM {target}_f)"""


def feature_ctes(source, target):
    """CTEs that add the three engineered features to a flow table."""
    from netloom.schema import BYTES_FEATURES, TIMING_FEATURES

    inner, gaps, outer = timing_variance(TIMING_FEATURES)
    return f"""{target}_1 AS (SELECT *, {packet_entropy(BYTES_FEATURES)} AS packet_entropy, {inner}
  FROM {source}),
{target}_2 AS (SELECT *, {gaps} FROM {target}_1),
{target}_3 AS (SELECT *, {outer} AS timing_variance FROM {target}_2),
{noise_ctes(target + '_3', target)}"""


def split_cte(source, target, key="flow_id", label="Label", seed=42):
    """CTE that adds the 60/20/20 ``split`` by label."""
    rank = (
        f"row_number() OVER (PARTITION BY {label} ORDER BY {u(seed, 'split', key + '::VARCHAR')}, {key}) - 1"
    )
    return f"""{target}_n AS (SELECT *, {rank} AS sp_r, count(*) OVER (PARTITION BY {label}) AS sp_n
  FROM {source}),
{target}_h AS (SELECT *, ceil(sp_n * 0.4::DOUBLE)::BIGINT AS sp_h FROM {target}_n),
{target} AS (SELECT * EXCLUDE (sp_r, sp_n, sp_h), CASE WHEN sp_r < sp_n - sp_h THEN 'train'
    WHEN sp_r < sp_n - ceil(sp_h * 0.5::DOUBLE)::BIGINT THEN 'val' ELSE 'test' END AS split
  FROM {target}_h)"""


def scale_cte(source, target, features, where="TRUE"):
    """CTEs that standardise ``features`` with the statistics of the rows in ``where``."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features)
    scaled = ", ".join(
        f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in features
    )
    return f"""{target}_s AS (SELECT {stats} FROM {source} WHERE {where}),
{target} AS (SELECT {source}.* REPLACE ({scaled}) FROM {source}, {target}_s)"""


def smote_ctes(source, target, key, vec, label, k, ratio, seed, distance="list_distance(a.v, b.v)"):
    """CTEs for the synthetic rows ``(n, z)`` of a table with vector ``vec`` and 0/1 classes.

    ``source`` must hold the columns key, vec and label; ``target`` gets n and z.
    """
    pool_u = u(seed, "smote.pool", f"{key}::VARCHAR")
    return f"""{target}_c AS (SELECT {label} AS l, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n, l),
{target}_k AS (SELECT min(n) AS n_min, max(n) AS n_maj, arg_min(l, n * 10 + l) AS l FROM {target}_c),
{target}_p AS (SELECT {key} AS id, {vec} AS v, row_number() OVER (ORDER BY {pool_u}, {key}) - 1 AS idx
  FROM {source}, {target}_k WHERE {source}.{label} = {target}_k.l),
{target}_d AS (SELECT a.id, b.id AS nid, row_number() OVER (PARTITION BY a.id
    ORDER BY {distance}, b.id) AS r FROM {target}_p a JOIN {target}_p b ON a.id <> b.id
  QUALIFY r <= {k}),
{target}_w AS (SELECT range AS n FROM range((SELECT trunc((n_maj - n_min) * {ratio}::DOUBLE)::BIGINT FROM {target}_k))),
{target}_x AS (SELECT n, floor({u(seed, 'smote.row', 'n::VARCHAR')} * n_min)::BIGINT AS idx,
    floor({u(seed, 'smote.neighbour', 'n::VARCHAR')} * {k})::BIGINT + 1 AS r,
    {u(seed, 'smote.alpha', 'n::VARCHAR')} AS alpha FROM {target}_w, {target}_k),
{target} AS (SELECT n, p.v AS x, o.v AS y, alpha,
    list_transform(list_zip(p.v, o.v), lambda t: t[1] + alpha * (t[2] - t[1])) AS z
  FROM {target}_x w JOIN {target}_p p ON p.idx = w.idx
  JOIN {target}_d d ON d.id = p.id AND d.r = w.r JOIN {target}_p o ON o.id = d.nid)"""
