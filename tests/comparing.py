"""Comparison of Spark and DuckDB results."""

import math


def same_rows(df, con, sql, digits=5):
    """Rows of a DataFrame and of a DuckDB query, sorted and rounded."""
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, digits) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return norm(v.item()) if hasattr(v, "item") else v

    columns = sorted(df.columns)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted((tuple(norm(x[c]) for c in columns) for x in df.collect()), key=repr), sorted((tuple(norm(x[k]) for k in at) for x in r.fetchall()), key=repr)
