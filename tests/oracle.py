"""Compare one Spark query with its DuckDB oracle, independent of row order."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"
}


def type_differences(df, sql, con):
    """Columns whose types differ between the two sides."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    want = {row[0]: _TYPES.get(row[1], row[1]) for row in described}
    got = dict(df.dtypes)
    return {c: (got.get(c), want.get(c)) for c in set(got) | set(want) if got.get(c) != want.get(c)}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, sql, con, show=3):
    """List of human-readable differences; empty when both sides agree."""
    got_columns = df.columns
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows_of(want_columns, cursor.fetchall())
    problems = []
    if sorted(got_columns) != sorted(want_columns):
        problems.append(f"columns {sorted(got_columns)} != {sorted(want_columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want and not problems:
        pairs = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(pairs)} rows differ; columns {sorted(got_columns)}")
        problems += [f"  spark {a}\n  duck  {b}" for a, b in pairs[:show]]
    elif got != want:
        extra = set(got) - set(want)
        missing = set(want) - set(got)
        problems.append(f"only spark {list(extra)[:show]}, only duck {list(missing)[:show]}")
    return problems
