"""DuckDB SQL of the wavelet families: analysis, thresholds and synthesis, level by level.

Each statement part starts from a relation win (window_id, i, x) and ret (retain). Orthogonal families are joined with
a table of their taps at circular places; the biorthogonal one runs its lifting steps over neighbours.
"""

from __future__ import annotations

from ..functions.wavelets import LIFTING, LIFTING_SCALE, filters


def ident(family: str) -> str:
    return "f_" + family.replace(".", "_")


def analysis(family: str, size: int, levels: int, source: str = "(SELECT window_id, i AS k, x AS a FROM win)", keys: str = "window_id", name: str | None = None) -> str:
    """<f>_c1 ... (keys, k, a, d), <f>_d (keys, level, k, d) of a relation (keys, k, a); f is the name, if any, or the family."""
    f, parts = name or ident(family), []
    if family != "bior4.4":
        h, g = filters(family)
        parts.append(f"{f}_t(m, h, g) AS (VALUES {', '.join(f'({m}, {a!r}, {b!r})' for m, (a, b) in enumerate(zip(h.tolist(), g.tolist())))})")
    for j in range(1, levels + 1):
        n = size >> (j - 1)
        if family != "bior4.4":
            parts.append(f"{f}_c{j} AS MATERIALIZED (SELECT {keys}, ((k - m + {64 * n}) % {n}) // 2 AS k, sum(h * a) AS a, sum(g * a) AS d FROM {source} JOIN {f}_t ON (k - m) % 2 = 0 GROUP BY ALL)")
        else:
            step = f"(SELECT {keys}, k // 2 AS k, max(CASE WHEN k % 2 = 0 THEN a END) AS s, max(CASE WHEN k % 2 = 1 THEN a END) AS d FROM {source} GROUP BY {keys}, k // 2)"
            for i, c in enumerate(LIFTING):
                step = lifted(step, i, c, keys)
            parts.append(f"{f}_c{j} AS MATERIALIZED (SELECT {keys}, k, s * {LIFTING_SCALE!r} AS a, d / {LIFTING_SCALE!r} AS d FROM {step})")
        source = f"{f}_c{j}"
    parts.append(f"{f}_d AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {keys}, {j} AS level, k, d FROM {f}_c{j}' for j in range(1, levels + 1))})")
    return ",\n".join(parts)


def hurst(source: str, keys: str, low: int, floor: float = 0.0) -> str:
    """(keys, H) of a relation (keys, level, k, d)."""
    energies = f"SELECT {keys}, level, avg(d * d) AS e FROM {source} WHERE level >= {low} GROUP BY {keys}, level"
    return f"(SELECT {keys}, CASE WHEN count(*) > 1 THEN (regr_slope(log2(e), level) + 1) / 2 END AS H FROM ({energies}) WHERE e > {floor} GROUP BY {keys})"


def spectrum(source: str, keys: str, low: int, faint: float = 0.0) -> str:
    """(keys, alpha_min, alpha_max, alpha_width, alpha_peak, f_alpha_peak) of a relation (keys, level, k, d); sizes below faint count as zero."""
    source = f"(SELECT {keys}, level, k, CASE WHEN abs(d) < {faint} THEN 0.0 ELSE d END AS d FROM {source})" if faint else source
    sums = f"SELECT {keys}, level, q, CASE WHEN q = 0 THEN avg(ln(abs(d) + 1e-12)) / ln(2.0) ELSE log2(avg(power(abs(d) + 1e-12, q))) END AS y FROM {source}, (SELECT CAST(unnest(range(-5, 6)) AS DOUBLE) AS q) WHERE level >= {low} GROUP BY {keys}, level, q"
    zeta = f"SELECT {keys}, q, -regr_slope(y, level) AS zeta FROM ({sums}) GROUP BY {keys}, q"
    alpha = f"SELECT {keys}, q, zeta, (coalesce(lead(zeta) OVER s, zeta) - coalesce(lag(zeta) OVER s, zeta)) / (coalesce(lead(q) OVER s, q) - coalesce(lag(q) OVER s, q)) AS alpha FROM ({zeta}) WINDOW s AS (PARTITION BY {keys} ORDER BY q)"
    return f"(SELECT {keys}, min(alpha) AS alpha_min, max(alpha) AS alpha_max, max(alpha) - min(alpha) AS alpha_width, arg_max(alpha, q * alpha - zeta + 1) AS alpha_peak, max(q * alpha - zeta + 1) AS f_alpha_peak FROM ({alpha}) GROUP BY {keys})"


def lifted(step: str, i: int, c: float, keys: str) -> str:
    """One lifting step over a relation (keys, k, s, d): even numbers change d by the next s, odd ones s by the last d."""
    by = f"PARTITION BY {keys} ORDER BY k"
    if i % 2 == 0:
        return f"(SELECT {keys}, k, s, d + {c!r} * (s + coalesce(lead(s) OVER ({by}), first_value(s) OVER ({by}))) AS d FROM {step})"
    return f"(SELECT {keys}, k, s + {c!r} * (d + coalesce(lag(d) OVER ({by}), last_value(d) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) AS s, d FROM {step})"


def thresholds(family: str, pool: bool) -> str:
    """<f>_h (window_id, retain, level, k, d, stays): what the shares keep."""
    f = ident(family)
    by, order = ("window_id", "abs(d) DESC, level, k") if pool else ("window_id, level", "abs(d) DESC, k")
    cut = "retain >= 1 OR r <= greatest(1, round_even(retain * n, 0))" if pool else "r <= ceil(retain * n)"
    return f"""{f}_h AS MATERIALIZED (SELECT window_id, retain, level, k, CASE WHEN {cut} THEN d ELSE 0.0 END AS d, {cut} AS stays
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {f}_d), ret)"""


def synthesis(family: str, size: int, levels: int) -> str:
    """<f>_y0 (window_id, retain, k, y): the signal that the kept coefficients give."""
    f = ident(family)
    parts = [f"{f}_y{levels} AS MATERIALIZED (SELECT window_id, retain, k, a AS y FROM {f}_c{levels}, ret)"]
    for j in range(levels, 0, -1):
        n = size >> (j - 1)
        both = f"(SELECT y.window_id, y.retain, y.k, y.y AS a, h.d FROM {f}_y{j} y JOIN {f}_h h ON y.window_id = h.window_id AND y.retain = h.retain AND y.k = h.k AND h.level = {j})"
        if family != "bior4.4":
            made = f"SELECT window_id, retain, (2 * k + m) % {n} AS k, sum(h * a + g * d) AS y FROM {both}, {f}_t GROUP BY ALL"
        else:
            step = f"(SELECT window_id, retain, k, a / {LIFTING_SCALE!r} AS s, d * {LIFTING_SCALE!r} AS d FROM {both})"
            for i, c in reversed(list(enumerate(LIFTING))):
                step = lifted(step, i, -c, "window_id, retain")
            made = f"SELECT window_id, retain, 2 * k + o AS k, CASE WHEN o = 0 THEN s ELSE d END AS y FROM {step}, (SELECT unnest([0, 1]) AS o)"
        parts.append(f"{f}_y{j - 1} AS MATERIALIZED ({made})")
    return ",\n".join(parts)


def results(families: dict[str, str], size: int, levels: int, eps: float, low: int | None = None, few: int = 5, by: str | None = None) -> str:
    """fr (method, window_id, retain, psnr, kept, total, H): methods by name and their families; `_pool` ends a name of one
    pool, and `learned` has the `few` levels of trained()'s bank. H is by Haar levels; with `by`, by that family's, and
    fr has alpha_width, alpha_peak and f_alpha_peak too."""
    parts, rows = [], []
    for method, family in families.items():
        f = ident(family)
        if method == "learned":  # of the filters in `bank`
            parts.append(learned(size, few))
        else:
            parts += [analysis(family, size, levels), thresholds(family, method.endswith("_pool")), synthesis(family, size, levels)]
        psnr = f"(SELECT window_id, retain, CASE WHEN avg(power(y - x, 2)) >= {eps} AND max(abs(x)) > 0 THEN 10 * log10(power(max(abs(x)), 2) / avg(power(y - x, 2))) END AS psnr FROM {f}_y0 JOIN win USING (window_id) WHERE i = k GROUP BY ALL)"
        kept = f"(SELECT window_id, retain, CAST(count(*) FILTER (WHERE stays) AS INTEGER) AS kept, CAST(count(*) AS INTEGER) AS total FROM {f}_h GROUP BY ALL)"
        h = "(SELECT window_id, retain, CAST(NULL AS DOUBLE) AS H FROM " + f"{f}_y0 GROUP BY ALL)"
        if low:
            d = f"SELECT window_id, retain, level, k >> level AS q, sum(CASE WHEN (k >> (level - 1)) % 2 = 0 THEN y ELSE -y END) / sqrt(CAST(1 << level AS DOUBLE)) AS d FROM {f}_y0, (SELECT unnest(range({low}, {levels + 1})) AS level) GROUP BY window_id, retain, level, k >> level"
            h = f"(SELECT window_id, retain, CASE WHEN count(*) > 1 THEN (regr_slope(log2(e), level) + 1) / 2 END AS H FROM (SELECT window_id, retain, level, avg(d * d) AS e FROM ({d}) GROUP BY window_id, retain, level) WHERE e > 1e-28 GROUP BY window_id, retain)"
        more = ""
        if by:
            parts.append(analysis(by, size, levels, f"(SELECT window_id, retain, k, y AS a FROM {f}_y0)", "window_id, retain", f"{f}_by"))
            h, more = hurst(f"{f}_by_d", "window_id, retain", low, 1e-28), f" LEFT JOIN {spectrum(f'{f}_by_d', 'window_id, retain', low, 1e-10)} USING (window_id, retain)"
        extra = ", alpha_width, alpha_peak, f_alpha_peak" if by else ""
        rows.append(f"SELECT '{method}' AS method, window_id, retain, CAST(round_even(retain * 1e6, 0) AS INTEGER) AS retain_ppm, psnr, kept, total, H{extra} FROM {psnr} JOIN {kept} USING (window_id, retain) LEFT JOIN {h} USING (window_id, retain){more}")
    return ",\n".join(parts) + ",\nfr AS (" + " UNION ALL ".join(rows) + ")\n"


def trained(stages: tuple[tuple[int, float], ...], size: int, levels: int, bank: str = "bank") -> str:
    """bank0, bank1, ... (window_id, level, it, loss, h0, h1, g0, g1 and Adam's moments): one recursion for each stage of
    (iterations, learning rate), from Haar filters; `bank` is the last stage's end. loss is that before the update.

    The bank stays a reflection at every level: steps are too small to change the sign of a determinant.
    """
    m, r = size - (size >> levels), 0.5**0.5
    zero = "0e0 AS m0, 0e0 AS m1, 0e0 AS v0, 0e0 AS v1"
    start = f"SELECT window_id, level, 0 AS it, CAST(NULL AS DOUBLE) AS loss, {r!r}e0 AS h0, {r!r}e0 AS h1, {r!r}e0 AS g0, -{r!r}e0 AS g1, {zero} FROM (SELECT DISTINCT window_id FROM win), (SELECT unnest(range(1, {levels + 1})) AS level)"
    parts = []
    for s, (iterations, lr) in enumerate(stages):
        inner, source = [], "(SELECT window_id, i AS k, x AS a FROM win)"
        for j in range(1, levels + 1):
            both = ", ".join(f"sum(a * CASE k % 2 WHEN 0 THEN {f}0 ELSE {f}1 END) AS {n}" for f, n in (("h", "a"), ("g", "d")))
            inner.append(f"c{j} AS MATERIALIZED (SELECT window_id, k // 2 AS k, {both} FROM {source} JOIN {bank}{s} USING (window_id) WHERE level = {j} GROUP BY window_id, k // 2)")
            source = f"c{j}"
        inner.append(f"e{levels} AS MATERIALIZED (SELECT *, 0e0 AS back FROM c{levels})")
        for j in range(levels - 1, 0, -1):
            back = f"CASE c.k % 2 WHEN 0 THEN e.back * h0 + sign(e.d) / {m} * g0 ELSE e.back * h1 + sign(e.d) / {m} * g1 END"
            inner.append(f"e{j} AS MATERIALIZED (SELECT c.*, {back} AS back FROM c{j} c JOIN e{j + 1} e ON e.window_id = c.window_id AND e.k = c.k // 2 JOIN {bank}{s} b ON b.window_id = c.window_id AND b.level = {j + 1})")
        turns = " UNION ALL ".join(f"SELECT window_id, {j} AS level, sum(back * d) - sum(sign(d) * a) / {m} AS slope, sum(abs(d)) / {m} AS part FROM e{j} GROUP BY window_id" for j in range(1, levels + 1))
        moments = ", ".join(f"0.9 * m{c} + 0.1 * slope * g{c} AS m{c}, 0.999 * v{c} + 0.001 * power(slope * g{c}, 2) AS v{c}" for c in (0, 1))
        moved = ", ".join(f"h{c} - {lr} * (m{c} / (1 - power(0.9, it))) / (sqrt(v{c} / (1 - power(0.999, it))) + 1e-8) AS n{c}" for c in (0, 1))
        step = f"SELECT window_id, level, it + 1 AS it, sum(part) OVER (PARTITION BY window_id) AS loss, h0, h1, g0, g1, {moments} FROM {bank}{s} JOIN ({turns}) USING (window_id, level) WHERE it < {iterations}"
        step = f"SELECT *, n0 - g1 AS p, n1 + g0 AS q FROM (SELECT *, {moved} FROM ({step}))"
        step = f"SELECT window_id, level, it, loss, p / s, q / s, q / s, -p / s, m0, m1, v0, v1 FROM (SELECT *, sqrt(p * p + q * q) AS s FROM ({step}))"
        parts.append(f"{bank}{s} AS ({start} UNION ALL (WITH {', '.join(inner)} {step}))")
        start = f"SELECT window_id, level, 0 AS it, loss, h0, h1, g0, g1, {zero} FROM {bank}{s} WHERE it = {iterations}"
    parts.append(f"{bank} AS MATERIALIZED (SELECT * FROM {bank}{len(stages) - 1} WHERE it = {stages[-1][0]})")
    return ",\n".join(parts)


def learned(size: int, levels: int) -> str:
    """f_learned_c1 ..., f_learned_d, _h and _y0 of the filters in `bank`, as analysis, thresholds and synthesis give them."""
    parts, source = [], "(SELECT window_id, i AS k, x AS a FROM win)"
    for j in range(1, levels + 1):
        both = ", ".join(f"sum(a * CASE k % 2 WHEN 0 THEN {f}0 ELSE {f}1 END) AS {n}" for f, n in (("h", "a"), ("g", "d")))
        parts.append(f"f_learned_c{j} AS MATERIALIZED (SELECT window_id, k // 2 AS k, {both} FROM {source} JOIN bank USING (window_id) WHERE level = {j} GROUP BY window_id, k // 2)")
        source = f"f_learned_c{j}"
    parts.append(f"f_learned_d AS MATERIALIZED ({' UNION ALL '.join(f'SELECT window_id, {j} AS level, k, d FROM f_learned_c{j}' for j in range(1, levels + 1))})")
    parts.append(thresholds("learned", False))
    parts.append(f"f_learned_y{levels} AS MATERIALIZED (SELECT window_id, retain, k, a AS y FROM f_learned_c{levels}, ret)")
    for j in range(levels, 0, -1):
        made = f"SELECT y.window_id, y.retain, 2 * y.k + o AS k, CASE o WHEN 0 THEN h0 * y.y + g0 * h.d ELSE h1 * y.y + g1 * h.d END AS y FROM f_learned_y{j} y JOIN f_learned_h h ON y.window_id = h.window_id AND y.retain = h.retain AND y.k = h.k AND h.level = {j} JOIN bank b ON b.window_id = y.window_id AND b.level = {j}, (SELECT unnest([0, 1]) AS o)"
        parts.append(f"f_learned_y{j - 1} AS MATERIALIZED ({made})")
    return ",\n".join(parts)
