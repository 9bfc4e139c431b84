"""Shared by the tests: rows of a DataFrame in a form that can be compared."""


def values(df, *columns):
    """Sorted tuples of the given columns (all when none are given)."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])
