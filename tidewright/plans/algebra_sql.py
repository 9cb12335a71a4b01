"""Pieces of SQL for small dense algebra on lists, for the SQL forms of the decompositions.

A matrix is a list of rows, of type DOUBLE[][]. Each function returns the text of an expression or of a common
table expression. Eigenvectors come from repeated squaring (which leaves the leading one) and deflation, roots of
characteristic polynomials from the simultaneous iteration of Weierstrass, inverses from Newton's iteration; so
none of this follows the way of the operators.
"""

from __future__ import annotations

from itertools import count

_names = count()


def _v(n: int) -> list[str]:
    return [f"q{next(_names)}" for _ in range(n)]


def transpose(m: str) -> str:
    j, r = _v(2)
    return f"list_transform(range(1, len({m}[1]) + 1), lambda {j}: list_transform({m}, lambda {r}: {r}[{j}]))"


def times_transposed(a: str, b: str) -> str:
    """a b^T."""
    r, c = _v(2)
    return f"list_transform({a}, lambda {r}: list_transform({b}, lambda {c}: list_dot_product({r}, {c})))"


def times_vector(a: str, v: str) -> str:
    (r,) = _v(1)
    return f"list_transform({a}, lambda {r}: list_dot_product({r}, {v}))"


def scaled(m: str, by: str) -> str:
    r, x = _v(2)
    return f"list_transform({m}, lambda {r}: list_transform({r}, lambda {x}: {x} * ({by})))"


def entries(n: str, formula: str, cols: str | None = None) -> str:
    """An n x n (or n x cols) matrix from a formula in {i} and {j}, which count from 1."""
    i, j = _v(2)
    return f"list_transform(range(1, {n} + 1), lambda {i}: list_transform(range(1, {cols or n} + 1), lambda {j}: CAST({formula.format(i=i, j=j)} AS DOUBLE)))"


def vector(n: str, formula: str) -> str:
    (i,) = _v(1)
    return f"list_transform(range(1, {n} + 1), lambda {i}: CAST({formula.format(i=i)} AS DOUBLE))"


def trace(m: str) -> str:
    (i,) = _v(1)
    return f"list_sum(list_transform(range(1, len({m}) + 1), lambda {i}: {m}[{i}][{i}]))"


def as_lists(name: str, table: str, i: str, j: str, v: str) -> str:
    """A table of entries as one row with the matrix ``m``."""
    return f"{name} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT {i} AS i, list(CAST({v} AS DOUBLE) ORDER BY {j}) AS r FROM {table} GROUP BY {i}))"


def eigen(name: str, source: str, pairs: int, steps: int = 30) -> str:
    """One row: ``vals`` and ``vecs`` of the leading pairs of the symmetric matrix ``m`` of ``source``."""
    (i,) = _v(1)
    unit = scaled("m", f"1 / {trace('m')}")
    square = times_transposed("m", "m")
    return f"""{name}_r AS (
  SELECT 0 AS p, 0 AS k, m AS g, {unit} AS m, CAST([] AS DOUBLE[]) AS vals, CAST([] AS DOUBLE[][]) AS vecs FROM {source}
  UNION ALL
  SELECT CASE WHEN k < {steps} THEN p ELSE p + 1 END, CASE WHEN k < {steps} THEN k + 1 ELSE 0 END, g2, {scaled("m2", f"1 / greatest({trace('m2')}, 1e-300)")}, CASE WHEN k < {steps} THEN vals ELSE list_append(vals, val) END, CASE WHEN k < {steps} THEN vecs ELSE list_append(vecs, v) END
  FROM (SELECT *, CASE WHEN k < {steps} THEN {square} ELSE g2 END AS m2 FROM (
    SELECT *, CASE WHEN k < {steps} THEN g ELSE {entries("len(g)", "g[{i}][{j}] - val * v[{i}] * v[{j}]")} END AS g2 FROM (
      SELECT *, list_dot_product(v, {times_vector("g", "v")}) AS val FROM (
        SELECT *, {vector("len(m)", "lead[{i}] / sqrt(list_dot_product(lead, lead))")} AS v FROM (
          SELECT *, m[list_position(diag, list_max(diag))] AS lead FROM (
            SELECT *, list_transform(range(1, len(m) + 1), lambda {i}: m[{i}][{i}]) AS diag FROM {name}_r WHERE p < {pairs})))))))
, {name} AS (SELECT vals, vecs FROM {name}_r WHERE p = {pairs})"""


def inverse(name: str, source: str, steps: int = 80) -> str:
    """One row with the inverse ``x`` of the positive definite ``m`` of ``source``."""
    turn = times_transposed("x", entries("len(m)", "CASE WHEN {i} = {j} THEN 2 ELSE 0 END - mx[{j}][{i}]"))
    return f"""{name}_r AS (
  SELECT 0 AS k, m, {scaled("m", f"1 / pow({trace('m')}, 2)")} AS x FROM {source}
  UNION ALL SELECT k + 1, m, {turn} FROM (SELECT *, {times_transposed("m", transpose("x"))} AS mx FROM {name}_r WHERE k < {steps}))
, {name} AS (SELECT x FROM {name}_r WHERE k = {steps})"""


def root_trace(name: str, source: str, steps: int = 40) -> str:
    """One row with ``s``: the trace of the square root of ``m``, which for a Gram matrix is the sum of all singular values."""
    turn = entries("len(y)", "CASE WHEN {i} = {j} THEN 1.5 ELSE 0 END - 0.5 * zy[{i}][{j}]")
    return f"""{name}_r AS (
  SELECT 0 AS k, scale, {scaled("m", "1 / scale")} AS y, {entries("len(m)", "CASE WHEN {i} = {j} THEN 1 ELSE 0 END")} AS z FROM (SELECT m, {trace("m")} AS scale FROM {source})
  UNION ALL SELECT k + 1, scale, {times_transposed("y", "t")}, {times_transposed("t", "z")} FROM (SELECT *, {turn} AS t FROM (SELECT *, {times_transposed("z", "y")} AS zy FROM {name}_r WHERE k < {steps})))
, {name} AS (SELECT sqrt(scale) * {trace("y")} AS s FROM {name}_r WHERE k = {steps})"""


def spectrum(name: str, source: str, steps: int = 120) -> str:
    """Rows k, re, im: the eigenvalues of the real matrix ``a`` of ``source`` (one row), by its characteristic polynomial."""
    i, j, c, h, w = _v(5)
    product = f"list_reduce(list_filter(list_transform(range(1, n + 1), lambda {j}: CASE WHEN {j} = {i} THEN {{'re': CAST(1 AS DOUBLE), 'im': CAST(0 AS DOUBLE)}} ELSE {{'re': z[{i}].re - z[{j}].re, 'im': z[{i}].im - z[{j}].im}} END), lambda {w}: true), lambda {h}, {c}: {{'re': {h}.re * {c}.re - {h}.im * {c}.im, 'im': {h}.re * {c}.im + {h}.im * {c}.re}})"
    g, e = _v(2)
    horner = f"list_reduce(coef, lambda {g}, {e}: {{'re': {g}.re * z[{i}].re - {g}.im * z[{i}].im + {e}.re, 'im': {g}.re * z[{i}].im + {g}.im * z[{i}].re + {e}.im}})"
    o, s, u = _v(3)
    return f"""{name}_p AS (SELECT 1 AS k, a, a AS m, [{trace("a")}] AS sums FROM {source}
  UNION ALL SELECT k + 1, a, {times_transposed("m", transpose("a"))}, sums FROM {name}_p WHERE k < len(a))
, {name}_s AS (SELECT list({trace("m")} ORDER BY k) AS p FROM {name}_p)
, {name}_e AS (SELECT 0 AS k, p, [CAST(1 AS DOUBLE)] AS e FROM {name}_s
  UNION ALL SELECT k + 1, p, list_append(e, list_sum(list_transform(range(1, k + 2), lambda {o}: pow(-1, {o} - 1) * e[k + 2 - {o}] * p[{o}])) / (k + 1)) FROM {name}_e WHERE k < len(p))
, {name}_c AS (SELECT len(p) AS n, list_transform(range(1, len(p) + 2), lambda {s}: {{'re': pow(-1, {s} - 1) * e[{s}], 'im': CAST(0 AS DOUBLE)}}) AS coef FROM {name}_e WHERE k = len(p))
, {name}_z AS (SELECT 0 AS step, n, coef, list_transform(range(1, n + 1), lambda {u}: {{'re': pow(0.97, {u}) * cos(0.9 * {u} + 0.4), 'im': pow(0.97, {u}) * sin(0.9 * {u} + 0.4)}}) AS z FROM {name}_c
  UNION ALL SELECT step + 1, n, coef, list_transform(range(1, n + 1), lambda {i}: {{
    're': z[{i}].re - (top[{i}].re * low[{i}].re + top[{i}].im * low[{i}].im) / (low[{i}].re * low[{i}].re + low[{i}].im * low[{i}].im),
    'im': z[{i}].im - (top[{i}].im * low[{i}].re - top[{i}].re * low[{i}].im) / (low[{i}].re * low[{i}].re + low[{i}].im * low[{i}].im)}})
  FROM (SELECT *, list_transform(range(1, n + 1), lambda {i}: {horner}) AS top, list_transform(range(1, n + 1), lambda {i}: {product}) AS low FROM {name}_z WHERE step < {steps}))
, {name} AS (SELECT row_number() OVER () AS k, z.re AS re, z.im AS im FROM (SELECT unnest(z) AS z FROM {name}_z WHERE step = {steps}))"""


def shares(name: str, source: str, roots: str) -> str:
    """Rows k, re, im, cr, ci: of the vector ``q`` of ``source`` the part (lists) in the eigenspace of each root of its ``a``.

    The part is the product of (a - root_j) / (root_k - root_j) over the other roots, applied to q.
    """
    i = _v(4)
    return f"""{name}_l AS (SELECT list({{'re': re, 'im': im}} ORDER BY k) AS l FROM {roots})
, {name}_w AS (SELECT r.k, 0 AS j, l, a, q AS cr, {vector("len(q)", "0 * {i}")} AS ci FROM {roots} r CROSS JOIN {name}_l CROSS JOIN {source}
  UNION ALL SELECT k, j, l, a, CASE WHEN j = k THEN cr ELSE list_transform(range(1, len(cr) + 1), lambda {i[0]}: (ur[{i[0]}] * dr + ui[{i[0]}] * di) / (dr * dr + di * di)) END, CASE WHEN j = k THEN ci ELSE list_transform(range(1, len(cr) + 1), lambda {i[1]}: (ui[{i[1]}] * dr - ur[{i[1]}] * di) / (dr * dr + di * di)) END
  FROM (SELECT *, l[k].re - l[j].re AS dr, l[k].im - l[j].im AS di,
      list_transform(range(1, len(cr) + 1), lambda {i[2]}: list_dot_product(a[{i[2]}], cr) - l[j].re * cr[{i[2]}] + l[j].im * ci[{i[2]}]) AS ur, list_transform(range(1, len(cr) + 1), lambda {i[3]}: list_dot_product(a[{i[3]}], ci) - l[j].re * ci[{i[3]}] - l[j].im * cr[{i[3]}]) AS ui
    FROM (SELECT k, j + 1 AS j, l, a, cr, ci FROM {name}_w WHERE j < len(l))))
, {name} AS (SELECT k, l[k].re AS re, l[k].im AS im, cr, ci FROM {name}_w WHERE j = len(l))"""


def polar(name: str, source: str, steps: int = 60) -> str:
    """One row with ``a``: the orthogonal factor of ``m``."""
    turn = times_transposed("x", entries("len(x)", "CASE WHEN {i} = {j} THEN 1.5 ELSE 0 END - 0.5 * xx[{j}][{i}]"))
    return f"""{name}_r AS (
  SELECT 0 AS k, {scaled("m", f"1 / sqrt({trace(times_transposed('m', 'm'))})")} AS x FROM {source}
  UNION ALL SELECT k + 1, {turn} FROM (SELECT *, {times_transposed(transpose("x"), transpose("x"))} AS xx FROM {name}_r WHERE k < {steps}))
, {name} AS (SELECT x AS a FROM {name}_r WHERE k = {steps})"""
