"""Edit distances as columns.

Standard Levenshtein is Spark's own ``levenshtein`` (code points, thresholded, in codegen). The others have no native
expression; they run as Arrow UDFs that fill one dynamic-programming table for a whole batch of pairs at a time, and are
meant to stand behind the lossless native prefilter of ``within``: each of their extra operations is at most two plain
edits, so a distance of n implies a Levenshtein distance of at most 2 n.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD, TRANSPOSITION, MERGE_AND_SPLIT = "standard", "transposition", "merge_and_split"
ALGORITHMS = (STANDARD, TRANSPOSITION, MERGE_AND_SPLIT)
_FAR = 1 << 20


def byte_view(text: Column) -> Column:
    """A text with one character for each UTF-8 byte, so that distances over it count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def batch_distance(left: list[str], right: list[str], algorithm: str, free: frozenset[tuple[int, int]] = frozenset()) -> np.ndarray:
    """Distances of pairs. free: (code of left, code of right) that match at no cost."""
    n = len(left)
    out = np.zeros(n, np.int32)
    lengths = np.array([[len(x), len(y)] for x, y in zip(left, right)]).reshape(n, 2)
    order = np.argsort(lengths.max(axis=1) if n else np.empty(0), kind="stable")
    for at in range(0, n, 2048):  # pairs of like length share a table
        own = order[at : at + 2048]
        out[own] = _table([left[k] for k in own], [right[k] for k in own], algorithm, free)
    return out


def _table(left: list[str], right: list[str], algorithm: str, free: frozenset[tuple[int, int]]) -> np.ndarray:
    la, lb = np.array([*map(len, left)]), np.array([*map(len, right)])
    wa, wb = int(la.max()), int(lb.max())
    a, b = _codes(left, wa), _codes(right, wb)
    if free:  # characters of pairs by number, and which numbers match; all others are number 0, which matches none
        letters = np.array(sorted({c for p in free for c in p}), np.int32)
        number = lambda m: np.where(letters[k := np.minimum(np.searchsorted(letters, m), len(letters) - 1)] == m, k + 1, 0)
        na, nb, match = number(a), number(b), np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x, y in free:
            match[np.searchsorted(letters, x) + 1, np.searchsorted(letters, y) + 1] = True
    rows = [np.tile(np.arange(wb + 1, dtype=np.int32)[:, None], (1, len(left)))]
    out = np.where(la == 0, lb, 0).astype(np.int32)
    for i in range(1, wa + 1):
        row = np.empty_like(rows[0])
        row[0] = i
        for j in range(1, wb + 1):
            same = a[:, i - 1] == b[:, j - 1]
            if free:
                same = same | match[na[:, i - 1], nb[:, j - 1]]
            best = np.minimum(np.minimum(rows[-1][j], row[j - 1]) + 1, rows[-1][j - 1] + ~same)
            if algorithm == TRANSPOSITION and i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, rows[-2][j - 2] + 1), best)
            elif algorithm == MERGE_AND_SPLIT:
                if i > 1:
                    best = np.minimum(best, rows[-2][j - 1] + 1)
                if j > 1:
                    best = np.minimum(best, rows[-1][j - 2] + 1)
            row[j] = best
        rows = [rows[-1], row]
        done = np.flatnonzero(la == i)
        out[done] = row[lb[done], done]
    return out


def _udf(algorithm: str, free: frozenset[tuple[int, int]] = frozenset()):
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = pd.Series([None] * len(x), dtype="Int32")
        if known.any():
            out[known.to_numpy()] = batch_distance(x[known].tolist(), y[known].tolist(), algorithm, free)
        return out

    return run


def distance(a: Column, b: Column, algorithm: str = STANDARD) -> Column:
    """Distance in code points; null if either side is null."""
    if algorithm == STANDARD:
        return F.levenshtein(a, b)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {ALGORITHMS}")
    return _udf(algorithm)(a, b)


def reach(n: int, algorithm: str) -> int:
    """Plain edits that a distance of n stands for at most."""
    return n if algorithm == STANDARD else 2 * n


def may_be_within(a: Column, b: Column, n: int, algorithm: str = STANDARD) -> Column:
    """Native and lossless: true wherever the distance is at most n; no operation changes the length by more than one."""
    return (F.abs(F.length(a) - F.length(b)) <= n) & (F.levenshtein(a, b, reach(n, algorithm)) >= 0)


def restricted_distance(term: Column, query: Column, pairs: Iterable[tuple[str, str]], algorithm: str = STANDARD) -> Column:
    """Distance in which (term's character, query's character) pairs match at no cost."""
    return _udf(algorithm, frozenset((ord(x), ord(y)) for x, y in pairs if len(x) == len(y) == 1))(term, query)


def prefix_distance(query: Column, term: Column, n: int) -> Column:
    """Least distance of the query to a prefix of the term, null above n; only prefixes of near length can count."""
    low, high = F.greatest(F.length(query) - n, F.lit(0)), F.least(F.length(query) + n, F.length(term))
    tried = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.levenshtein(query, F.substring(term, F.lit(1), k), n)))
    return F.array_min(F.filter(tried, lambda d: d >= 0))


def capped_prefix_distance(query: Column, term: Column, n: int) -> Column:
    """prefix_distance for a small n that is not 0, n + 1 above n: in codegen, without arrays, and each distance stands there once."""
    def tried(j: int) -> Column:
        size = F.length(query) + j
        near = F.pmod(F.levenshtein(query, F.substring(term, F.lit(1), size), n), F.lit(n + 2))  # -1 becomes n + 1
        return F.when((size >= 0) & (size <= F.length(term)), near).otherwise(n + 1)

    return F.least(*[tried(j) for j in range(-n, n + 1)])


def common_affixes(a: Column, b: Column) -> Column:
    """(prefix, suffix): lengths of the common prefix and of the common suffix of the rest."""
    shorter = F.least(F.length(a), F.length(b))
    count = lambda most, same: F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, k: F.when((acc == k - 1) & same(k), k).otherwise(acc))
    prefix = count(shorter, lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1)))
    suffix = count(shorter - prefix, lambda k: F.substring(a, F.length(a) - k + 1, F.lit(1)) == F.substring(b, F.length(b) - k + 1, F.lit(1)))
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))


def generalized_distance(operations: list[dict], floor_weights: bool = False):
    """A UDF (term, query) -> double: the cheapest sequence of weighted operations.

    An operation is {name, consume_x, consume_y, weight[, pairs]}: it takes that many characters of term and query; with
    pairs of (term's part, query's part) only these, without: equal parts at weight 0 for a match, a swap for (2, 2), and
    any for the rest. floor_weights drops fractions of weights.
    """
    ops = [(o["consume_x"], o["consume_y"], float(int(o["weight"])) if floor_weights else float(o["weight"]), {tuple(p) for p in o["pairs"]} if o.get("pairs") is not None else None) for o in operations]

    def table(left: list[str], right: list[str]) -> np.ndarray:
        """One table for all pairs at a time; a cell is a column of numbers, one for each pair."""
        la, lb = np.array([*map(len, left)]), np.array([*map(len, right)])
        wa, wb = int(la.max()), int(lb.max())
        a, b = _codes(left, wa), _codes(right, wb)
        furthest = max(cx for cx, *_ in ops)
        listed = [None if pairs is None else {tuple(map(ord, s + t)) for s, t in pairs if len(s) == cx and len(t) == cy} for cx, cy, _, pairs in ops]
        cells = {(0, 0): np.zeros(len(left))}
        out = np.full(len(left), np.inf)
        for i in range(wa + 1):
            for j in range(wb + 1):
                best = cells.pop((i, j)) if (i, j) in cells else np.full(len(left), np.inf)
                for (cx, cy, weight, pairs), codes in zip(ops, listed):
                    if cx > i or cy > j or not cx + cy:
                        continue
                    own = [a[:, i - cx + k] for k in range(cx)] + [b[:, j - cy + k] for k in range(cy)]
                    if codes is not None:
                        fits = np.zeros(len(left), bool)
                        for want in codes:
                            fits |= np.logical_and.reduce([c == w for c, w in zip(own, want)])
                    elif not weight and cx == cy == 1:
                        fits = own[0] == own[1]
                    elif cx == cy == 2:
                        fits = (own[0] == own[3]) & (own[1] == own[2])
                    else:
                        fits = np.ones(len(left), bool)
                    best = np.where(fits, np.minimum(best, cells[i - cx, j - cy] + weight), best)
                cells[i, j] = best
                done = (la == i) & (lb == j)
                out[done] = best[done]
            for j in range(wb + 1):  # no operation reaches further back
                cells.pop((i - furthest, j), None)
        return out

    def many(left: list[str], right: list[str]) -> np.ndarray:
        out = np.zeros(len(left))
        order = np.argsort([max(len(x), len(y)) for x, y in zip(left, right)], kind="stable")
        for at in range(0, len(left), 2048):  # pairs of like length share a table
            own = order[at : at + 2048]
            out[own] = table([left[k] for k in own], [right[k] for k in own])
        return out

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = many(x[known].tolist(), y[known].tolist())
        return pd.Series(out).astype(object).where(known, None).astype("Float64")

    return run
