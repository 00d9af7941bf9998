"""Compares a query's rows with those of its SQL in DuckDB, as unordered collections of values by column name."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'' if os.path.isfile(path) else '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names))), key=lambda r: tuple(map(repr, r)))


def kinds(table):
    out = {}
    for f in table.schema:
        t = str(f.type)
        out[f.name] = "int" if t.startswith(("int", "uint")) else "float" if t.startswith(("double", "float")) else "text" if "string" in t else t
    return out


def difference(df, con, sql):
    """None if equal; else what differs."""
    got, want = df.toArrow(), con.execute(sql).to_arrow_table()
    (a, x), (b, y) = rows(got), rows(want)
    if a != b:
        return f"columns {a} and {b}"
    odd = {n: (kinds(got)[n], kinds(want)[n]) for n in a if kinds(got)[n] != kinds(want)[n]}
    if len(x) != len(y) or x != y:
        first = next(((p, q) for p, q in zip(x, y) if p != q), None)
        return f"{len(x)} and {len(y)} rows; types {odd}; first difference {str(first)[:600]}"
    return f"types {odd}" if odd else None
