"""Shared by the tests: the smoke tables' folder, and rows of a frame in a fixed order."""

SMOKE = "/root/testdata/sf0.001"


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
