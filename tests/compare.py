"""Rows of a Spark result and of an SQL result in one form."""

import math

import pandas as pd


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


def same(df, con, sql):
    found = df.collect()
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    return rows(df.columns, found) == rows(relation.columns, relation.fetchall())
