"""Rows of a Spark query against rows of its DuckDB SQL, in any order."""

import math


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v) if not isinstance(v, bool) else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, relation):
    a = canonical([tuple(r) for r in df.collect()], df.columns)
    b = canonical(relation.fetchall(), list(relation.columns))
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
