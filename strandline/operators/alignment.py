"""Global pairwise alignment with affine gaps, in numpy on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_matrix(text: str) -> dict[tuple[str, str], float]:
    """A substitution matrix in the public NCBI text format: # comments, a line of symbols,
    then a line for each symbol."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    names = lines[0]
    return {(row[0], n): float(v) for row in lines[1:] for n, v in zip(names, row[1:])}


def matrix_rows(scores: dict[tuple[str, str], float], alphabet: str) -> dict[str, tuple[float, ...]]:
    """A substitution matrix as the table of ``encode_all``; it has to be symmetric."""
    if any(scores[a, b] != scores[b, a] for a in alphabet for b in alphabet):
        raise ValueError("the matrix is not symmetric")
    return {a: tuple(scores[a, b] for b in alphabet) for a in alphabet}


def gotoh(a: str, b: str, score=None, opening: float = 10.0, extending: float = 0.5) -> tuple[float, str, str]:
    """Best global alignment: score and the two gapped strings. A gap of n symbols costs
    opening + (n - 1) * extending. ``score`` is a matrix; without it, 5 and -4."""
    value = (lambda x, y: score.get((x, y), -4.0)) if score else (lambda x, y: 5.0 if x == y else -4.0)
    n, m = len(a), len(b)
    low = -1e18
    best, up, left = (np.full((n + 1, m + 1), low) for _ in range(3))
    best[0, 0] = 0
    for i in range(1, n + 1):
        up[i, 0] = -opening - (i - 1) * extending
    for j in range(1, m + 1):
        left[0, j] = -opening - (j - 1) * extending
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1], up[i - 1, j - 1], left[i - 1, j - 1]) + value(a[i - 1], b[j - 1])
            up[i, j] = max(max(best[i - 1, j], left[i - 1, j]) - opening, up[i - 1, j] - extending)
            left[i, j] = max(max(best[i, j - 1], up[i, j - 1]) - opening, left[i, j - 1] - extending)
    tables = (best, up, left)
    i, j, state = n, m, int(np.argmax([t[n, m] for t in tables]))
    total, x, y = float(tables[state][n, m]), [], []
    while i or j:
        here = tables[state][i, j]
        if state == 0:
            x.append(a[i - 1]), y.append(b[j - 1])
            rest = here - value(a[i - 1], b[j - 1])
            i, j = i - 1, j - 1
            state = next(s for s in range(3) if abs(tables[s][i, j] - rest) < 1e-6)
        elif state == 1:
            x.append(a[i - 1]), y.append("-")
            i -= 1
            state = next(s for s in (1, 0, 2) if abs(tables[s][i, j] - (extending if s == 1 else opening) - here) < 1e-6) if i or j else 0
        else:
            x.append("-"), y.append(b[j - 1])
            j -= 1
            state = next(s for s in (2, 0, 1) if abs(tables[s][i, j] - (extending if s == 2 else opening) - here) < 1e-6) if i or j else 0
    return total, "".join(reversed(x)), "".join(reversed(y))


def align(df: DataFrame, a: str, b: str, **options) -> DataFrame:
    """The rows with score, identity and gaps of the alignment of two columns."""

    @F.pandas_udf("score double, identical int, gaps int, columns int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y):
            s, u, v = gotoh(p, q, **options)
            out.append((s, sum(c == d for c, d in zip(u, v)), u.count("-") + v.count("-"), len(u)))
        return pd.DataFrame(out, columns=["score", "identical", "gaps", "columns"])

    return df.withColumn("_a", run(a, b)).select("*", "_a.*").drop("_a")
