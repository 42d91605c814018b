"""Rows of two results as comparable lists, and where the tables are."""

import math

DATA = "/root/testdata/sf0.001"


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(value(r[k]) for k in order) for r in records), key=repr)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    cursor = con.execute(sql)
    return rows([d[0] for d in cursor.description], cursor.fetchall())
