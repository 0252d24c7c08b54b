"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(_cell, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(table, names):
    columns = [[_cell(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def compare(spark, query, sql, sf_dir):
    """None, or what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).to_arrow_table()
    got = query(spark, sf_dir).toArrow()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"
    names = sorted(got.column_names)
    types = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1] != t[2] and {t[1], t[2]} not in ({"string", "large_string"}, {"timestamp[us]", "timestamp[us, tz=UTC]"})]
    a, b = _rows(got, names), _rows(want, names)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} rows against {len(b)}; {names}: first difference {diff}; types {odd}"
    return f"types {odd}" if odd else None
