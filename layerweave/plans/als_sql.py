"""The decomposition as SQL: rank-two alternating least squares with one common table expression per update.

All sweeps are written out; the result takes the first one at which the stop rule holds.
"""

from __future__ import annotations

MODES = ("i", "j", "k")


def md5_start(mode: int, column: int, seed: int, index: str = "idx") -> str:
    """The starting value of an entry, drawn from the MD5 of seed, mode, index and column."""
    return f"((('0x' || substr(md5('{seed}:{mode}:' || {index} || ':{column}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def als_sql(cells: str, sweeps: int, tolerance: float, seed: int = 6, strict_fit: bool = False) -> str:
    """``WITH`` parts over the table ``cells`` (i, j, k, value).

    They end in ``solution`` (sweep, mode, idx, f0, f1), ``errors`` (sweep, error, w0, w1) and ``stopped`` (sweep,
    converged).  ``strict_fit`` scales by the largest entry after the first sweep and stops on the fit, strictly.
    """
    parts = [f"size AS MATERIALIZED (SELECT sqrt(sum(value * value)) AS s FROM {cells})"]
    for mode in (1, 2):
        parts.append(
            f"f{mode}_0 AS MATERIALIZED (SELECT idx, {md5_start(mode, 0, seed)} AS f0, {md5_start(mode, 1, seed)} AS f1 "
            f"FROM range((SELECT max({MODES[mode]}) + 1 FROM {cells})) r(idx))"
        )
        parts.append(_gram(f"f{mode}_0"))
    for sweep in range(1, sweeps + 1):
        for mode in range(3):
            a, b = (m for m in range(3) if m != mode)
            left, right = (f"f{m}_{sweep if m < mode else sweep - 1}" for m in (a, b))
            name = f"f{mode}_{sweep}"
            largest = strict_fit and sweep > 1
            norms = ", ".join(f"greatest(max(r{n}), 1.0) AS n{n}" if largest else f"sqrt(sum(r{n} * r{n})) AS n{n}" for n in (0, 1))
            parts.append(
                f"p{name} AS MATERIALIZED (SELECT {MODES[mode]} AS idx, sum(value * a.f0 * b.f0) AS p0, sum(value * a.f1 * b.f1) AS p1 "
                f"FROM {cells} c JOIN {left} a ON c.{MODES[a]} = a.idx JOIN {right} b ON c.{MODES[b]} = b.idx GROUP BY ALL)"
            )
            parts.append(
                f"r{name} AS MATERIALIZED (SELECT idx, p0, p1, (p0 * v11 - p1 * v01) / (v00 * v11 - v01 * v01) AS r0, (p1 * v00 - p0 * v01) / (v00 * v11 - v01 * v01) AS r1 "
                f"FROM p{name}, (SELECT x.g00 * y.g00 AS v00, x.g01 * y.g01 AS v01, x.g11 * y.g11 AS v11 FROM g{left} x, g{right} y))"
            )
            parts.append(f"n{name} AS MATERIALIZED (SELECT {norms} FROM r{name})")
            parts.append(f"{name} AS MATERIALIZED (SELECT idx, r0 / n0 AS f0, r1 / n1 AS f1, p0, p1 FROM r{name}, n{name})")
            parts.append(_gram(name))
        parts.append(
            f"e{sweep} AS MATERIALIZED (SELECT {sweep} AS sweep, n0 AS w0, n1 AS w1, sqrt(greatest(s * s - 2 * (n0 * q0 + n1 * q1) + abs("
            f"n0 * n0 * a.g00 * b.g00 * c.g00 + 2 * n0 * n1 * a.g01 * b.g01 * c.g01 + n1 * n1 * a.g11 * b.g11 * c.g11), 0)) / s AS error "
            f"FROM size, nf2_{sweep}, gf0_{sweep} a, gf1_{sweep} b, gf2_{sweep} c, (SELECT sum(p0 * f0) AS q0, sum(p1 * f1) AS q1 FROM f2_{sweep}))"
        )
    parts.append("errors AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM e{s}" for s in range(1, sweeps + 1)) + ")")
    if strict_fit:
        held = f"abs((1 - error) - coalesce(1 - lag(error) OVER (ORDER BY sweep), 0)) < {tolerance}"
    else:
        held = f"coalesce(abs(lag(error) OVER (ORDER BY sweep) - error) <= {tolerance}, false)"
    parts.append(
        f"stopped AS MATERIALIZED (SELECT coalesce(min(CASE WHEN held THEN sweep END), {sweeps}) AS sweep, bool_or(held) AS converged "
        f"FROM (SELECT sweep, {held} AS held FROM errors))"
    )
    parts.append("solution AS (" + " UNION ALL ".join(
        f"SELECT {s} AS sweep, {m} AS mode, idx, f0, f1 FROM f{m}_{s}" for s in range(1, sweeps + 1) for m in range(3)
    ) + ")")
    return ", ".join(parts)


def _gram(name: str) -> str:
    return f"g{name} AS MATERIALIZED (SELECT sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11 FROM {name})"
