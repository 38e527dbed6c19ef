"""Building blocks of the DuckDB comparison SQL.

Each function returns ``[(name, body), ...]``; ``sql`` strings them together.
They are written the plain way (recursion over rows, self-joins, whole-table
windows) so that they check the Spark side rather than repeat it.
"""

from __future__ import annotations

KEYS = {"type": "p.p_type", "brand": "p.p_brand", "supplier": "CAST(l.l_suppkey AS VARCHAR)"}
VALUES = ["open", "high", "low", "close", "volume"]
FEATURES = ["rsi_dev", "macd_hist_norm", "ema_slope", "vol20", "ret10"]
W = "PARTITION BY ticker ORDER BY dt"


def sql(ctes: list[tuple[str, str]], final: str) -> str:
    parts = [f"{name} AS {'' if 'RECURSIVE' in name else 'MATERIALIZED '}({body})" for name, body in ctes]
    parts = [p.replace("RECURSIVE ", "") for p in parts]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


def bars(universe: str = "brand", name: str = "bars", spiky: bool = False):
    key = KEYS[universe]
    px = "l.l_extendedprice / l.l_quantity" if spiky else "100.0 + l.l_extendedprice / 10000.0"
    return [(name, f"""
SELECT ticker, dt, MIN_BY(px, rn) AS open, MAX(px) AS high, MIN(px) AS low,
       MAX_BY(px, rn) AS close, SUM(qty) AS volume
FROM (SELECT {key} AS ticker, CAST(l.l_shipdate AS DATE) AS dt, {px} AS px, l.l_quantity AS qty,
        ROW_NUMBER() OVER (PARTITION BY {key}, CAST(l.l_shipdate AS DATE)
          ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
                   l.l_extendedprice, l.l_discount, l.l_tax) AS rn
      FROM lineitem l {'' if universe == 'supplier' else 'JOIN part p ON l.l_partkey = p.p_partkey'})
GROUP BY ticker, dt""")]


def position(source: str, name: str):
    return [(name, f"SELECT *, ROW_NUMBER() OVER ({W}) - 1 AS seq, COUNT(*) OVER (PARTITION BY ticker) AS n FROM {source}")]


def fill(source: str, name: str):
    ff = ", ".join(f"LAST_VALUE({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {c}" for c in VALUES)
    bf = ", ".join(
        f"FIRST_VALUE({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in VALUES
    )
    return [(name + "_ff", f"SELECT ticker, dt, {ff} FROM {source}"),
            (name, f"SELECT * FROM (SELECT ticker, dt, {bf} FROM {name}_ff) WHERE close IS NOT NULL")]


def outliers(source: str, name: str):
    return [
        (name + "_r", f"SELECT *, close / LAG(close) OVER ({W}) - 1 AS r FROM {source}"),
        (name + "_q", f"SELECT ticker, QUANTILE_CONT(r, 0.25) AS q1, QUANTILE_CONT(r, 0.75) AS q3 FROM {name}_r GROUP BY ticker"),
        (name, f"""SELECT b.* EXCLUDE (r), NOT (r IS NULL OR r BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)) AS outlier
FROM {name}_r b JOIN {name}_q q USING (ticker)"""),
    ]


def winsor(source: str, name: str):
    q = ", ".join(f"QUANTILE_CONT({c}, 0.01) AS {c}_lo, QUANTILE_CONT({c}, 0.99) AS {c}_hi" for c in VALUES)
    clip = ", ".join(f"LEAST(GREATEST({c}, {c}_lo), {c}_hi) AS {c}" for c in VALUES)
    return [(name + "_q", f"SELECT ticker, {q} FROM {source} GROUP BY ticker"),
            (name, f"SELECT ticker, dt, {clip} FROM {source} JOIN {name}_q USING (ticker)")]


def cleaned(source: str = "bars", name: str = "clean"):
    """Plain bars have neither gaps nor infinities, so cleaning is filter and clip."""
    return outliers(source, "flagged") + [("kept", "SELECT * EXCLUDE (outlier) FROM flagged WHERE NOT outlier")] + winsor("kept", name)


def indicators(source: str = "bars", name: str = "ind"):
    """All indicator columns on every row; averages by recursion over rows."""
    w14 = f"{W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW"
    return position(source, name + "_p") + [
        (name + "_e RECURSIVE", f"""
SELECT ticker, seq, close AS e12, close AS e20, close AS e26, CAST(0 AS DOUBLE) AS sig FROM {name}_p WHERE seq = 0
UNION ALL
SELECT ticker, seq, e12, e20, e26, sig + 0.2 * ((e12 - e26) - sig) FROM (
  SELECT p.ticker, p.seq, e.e12 + 2.0 / 13 * (p.close - e.e12) AS e12, e.e20 + 2.0 / 21 * (p.close - e.e20) AS e20,
         e.e26 + 2.0 / 27 * (p.close - e.e26) AS e26, e.sig
  FROM {name}_e e JOIN {name}_p p ON p.ticker = e.ticker AND p.seq = e.seq + 1)"""),
        (name + "_d", f"""SELECT p.*, e.e20 AS ema20, e.e12 - e.e26 AS macd, e.sig AS macd_signal, e.e12 - e.e26 - e.sig AS macd_hist,
  close / LAG(close) OVER ({W}) - 1 AS ret, LN(close) - LAG(LN(close)) OVER ({W}) AS log_return,
  close - LAG(close) OVER ({W}) AS delta, ISODOW(dt) - 1 AS day_of_week
FROM {name}_p p JOIN {name}_e e USING (ticker, seq)"""),
        (name, f"""SELECT * EXCLUDE (delta), CASE WHEN COUNT(delta) OVER ({w14}) = 14 THEN
  100 - 100 / (1 + AVG(CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0 END) OVER ({w14})
               / (AVG(CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0 END) OVER ({w14}) + 1e-9)) END AS rsi14
FROM {name}_d"""),
    ]


def engineered(source: str = "bars", name: str = "feat"):
    return indicators(source, name + "_i") + [
        (name + "_t", f"SELECT * EXCLUDE (seq, n) FROM {name}_i WHERE rsi14 IS NOT NULL")] + position(name + "_t", name)


def guarded(agg: str, n: int, col: str) -> str:
    w = f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN COUNT({col}) OVER ({w}) = {n} THEN {agg}({col}) OVER ({w}) END"


def regime_raw(source: str, name: str):
    return [(name, f"""SELECT *, {guarded('STDDEV_SAMP', 20, 'log_return')} AS vol20, rsi14 - 50 AS rsi_dev,
  macd_hist / ({guarded('AVG', 20, 'close')} * 0.01 + 1e-9) AS macd_hist_norm,
  (ema20 - LAG(ema20, 10) OVER ({W})) / (LAG(ema20, 10) OVER ({W}) + 1e-9) * 100 AS ema_slope,
  (close / LAG(close, 10) OVER ({W}) - 1) * 100 AS ret10 FROM {source}""")]


def regime_bfill(source: str = "feat", name: str = "rf"):
    """Windows over trimmed rows; warm-up rows take the first full value."""
    cols = ", ".join(
        f"COALESCE({c}, FIRST_VALUE({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in FEATURES
    )
    return regime_raw(source, name + "_w") + [(name, f"SELECT * REPLACE ({cols}) FROM {name}_w")]


def regime_drop(source: str = "ind", name: str = "rf"):
    """Windows over all rows; incomplete rows are dropped."""
    return regime_raw(source, name + "_w") + [
        (name + "_t", f"SELECT * EXCLUDE (seq, n) FROM {name}_w WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES + ["log_return"]))
    ] + position(name + "_t", name)


def zscores(source: str = "rf", name: str = "z"):
    cols = ", ".join(
        f"({c} - AVG({c}) OVER (PARTITION BY ticker)) / CASE WHEN STDDEV_POP({c}) OVER (PARTITION BY ticker) > 0 "
        f"THEN STDDEV_POP({c}) OVER (PARTITION BY ticker) ELSE 1 END AS z{i}" for i, c in enumerate(FEATURES)
    )
    return [(name, f"SELECT *, {cols} FROM {source}")]


def kmeans(source: str = "z", name: str = "lab"):
    """Lloyd iterations per ticker by recursion until its centres rest; then the semantic order."""
    ms, zs = [f"m{i}" for i in range(5)], [f"z{i}" for i in range(5)]
    dist = " + ".join(f"POW(p.z{i} - c.m{i}, 2)" for i in range(5))
    avgs = ", ".join(f"COALESCE(AVG(a.z{i}), ANY_VALUE(c.m{i})) AS m{i}" for i in range(5))
    olds = ", ".join(f"ANY_VALUE(c.m{i}) AS o{i}" for i in range(5))
    step = "GREATEST(" + ", ".join(f"ABS(m{i} - o{i})" for i in range(5)) + ")"
    nearest = f"ARG_MIN(c.k, (FLOOR(({dist}) * 1e9 + 0.5), c.k))"
    return [
        (name + "_i", f"SELECT ticker, dt, NTILE(6) OVER (PARTITION BY ticker ORDER BY 2 * z4 + 1.5 * z0 - 3 * z3 DESC, dt) - 1 AS k FROM {source}"),
        (name + "_c0", f"SELECT ticker, k, {', '.join(f'AVG(z{i}) AS m{i}' for i in range(5))} FROM {source} JOIN {name}_i USING (ticker, dt) GROUP BY ticker, k"),
        (name + "_c RECURSIVE", f"""
SELECT ticker, k, 0 AS it, TRUE AS moved, {', '.join(ms)} FROM {name}_c0
UNION ALL
SELECT ticker, k, it, MAX({step}) OVER (PARTITION BY ticker) > 1e-10, {', '.join(ms)} FROM (
  SELECT c.ticker, c.k, c.it + 1 AS it, {avgs}, {olds}
  FROM {name}_c c LEFT JOIN (
    SELECT p.ticker, p.dt, {', '.join(f'ANY_VALUE(p.{z}) AS {z}' for z in zs)}, {nearest} AS k
    FROM {source} p JOIN {name}_c c ON p.ticker = c.ticker WHERE c.moved GROUP BY p.ticker, p.dt) a
  ON a.ticker = c.ticker AND a.k = c.k
  WHERE c.moved AND c.it < 1000 GROUP BY c.ticker, c.k, c.it)"""),
        (name + "_f", f"SELECT * FROM {name}_c WHERE NOT moved"),
        (name + "_a", f"SELECT p.ticker, p.dt, {nearest} AS k FROM {source} p JOIN {name}_f c ON p.ticker = c.ticker GROUP BY p.ticker, p.dt"),
        (name + "_m", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ROUND(2 * m4 + 1.5 * m0 - 3 * m3, 9) DESC, k) - 1 AS regime FROM {name}_f"),
        (name, f"SELECT s.*, a.k AS cluster, m.regime FROM {source} s JOIN {name}_a a USING (ticker, dt) JOIN {name}_m m ON m.ticker = s.ticker AND m.k = a.k"),
    ]


def kmeans_restarts(starts: int, source: str = "z", name: str = "lab"):
    """Lloyd from several starts: slices of the score, and seeds drawn by distance from hashes of (start, centre)."""
    ms = [f"m{i}" for i in range(5)]
    draw = "(CAST('0x' || SUBSTR(MD5(s || ':' || {j}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    run = "OVER (PARTITION BY ticker, s ORDER BY dt ROWS UNBOUNDED PRECEDING)"
    away = " + ".join(f"POW(p.z{i} - c.m{i}, 2)" for i in range(5))
    at = ", ".join(f"z{i} AS m{i}" for i in range(5))
    out = [
        (name + "_p", f"SELECT ticker, dt, ROW_NUMBER() OVER ({W}) - 1 AS i, COUNT(*) OVER (PARTITION BY ticker) AS n, z0, z1, z2, z3, z4 FROM {source}"),
        (name + "_s0", f"SELECT ticker, s, 0 AS k, {at} FROM {name}_p, (SELECT UNNEST(RANGE(1, {starts})) AS s) WHERE i = LEAST(CAST(FLOOR({draw.format(j=0)} * n) AS BIGINT), n - 1)"),
        (name + "_d0", f"SELECT p.*, s, {away} AS d FROM {name}_p p JOIN {name}_s0 c USING (ticker)"),
    ]
    for j in range(1, 6):
        out += [
            (f"{name}_s{j}", f"""SELECT ticker, s, {j} AS k, {', '.join(f'ARG_MIN(z{i}, i) AS m{i}' for i in range(5))} FROM (
  SELECT *, SUM(d) {run} AS c, SUM(d) OVER (PARTITION BY ticker, s) AS t FROM {name}_d{j - 1})
WHERE CASE WHEN t > 0 THEN c >= {draw.format(j=j)} * t ELSE i = {j} END GROUP BY ticker, s"""),
        ]
        if j < 5:
            out.append((f"{name}_d{j}", f"SELECT p.* EXCLUDE (d), LEAST(d, {away}) AS d FROM {name}_d{j - 1} p JOIN {name}_s{j} c USING (ticker, s)"))
    whole = " + ".join(f"POW(p.z{i} - c.m{i}, 2)" for i in range(5))
    key = f"CAST(FLOOR(({whole}) * 1e9 + 0.5) AS BIGINT) * 8 + c.k"
    avgs = ", ".join(f"COALESCE(AVG(a.z{i}), ANY_VALUE(c.m{i})) AS m{i}" for i in range(5))
    olds = ", ".join(f"ANY_VALUE(c.m{i}) AS o{i}" for i in range(5))
    step = "GREATEST(" + ", ".join(f"ABS(m{i} - o{i})" for i in range(5)) + ")"
    zs = ", ".join(f"ANY_VALUE(p.z{i}) AS z{i}" for i in range(5))
    slices = f"SELECT ticker, dt, NTILE(6) OVER (PARTITION BY ticker ORDER BY 2 * z4 + 1.5 * z0 - 3 * z3 DESC, dt) - 1 AS k FROM {name}_p"
    return out + [
        (name + "_i", slices),
        (name + "_c0", f"SELECT ticker, 0 AS s, k, {', '.join(f'AVG(z{i}) AS m{i}' for i in range(5))} FROM {name}_p JOIN {name}_i USING (ticker, dt) GROUP BY ticker, k UNION ALL "
            + " UNION ALL ".join(f"SELECT * FROM {name}_s{j}" for j in range(6))),
        (name + "_c RECURSIVE", f"""
SELECT ticker, s, k, 0 AS it, TRUE AS moved, {', '.join(ms)} FROM {name}_c0
UNION ALL
SELECT ticker, s, k, it, MAX({step}) OVER (PARTITION BY ticker, s) > 1e-10, {', '.join(ms)} FROM (
  SELECT c.ticker, c.s, c.k, c.it + 1 AS it, {avgs}, {olds}
  FROM {name}_c c LEFT JOIN (
    SELECT p.ticker, c.s, p.i, {zs}, MIN({key}) % 8 AS k
    FROM {name}_p p JOIN {name}_c c ON p.ticker = c.ticker WHERE c.moved GROUP BY p.ticker, c.s, p.i) a
  ON a.ticker = c.ticker AND a.s = c.s AND a.k = c.k
  WHERE c.moved AND c.it < 1000 GROUP BY c.ticker, c.s, c.k, c.it)"""),
        (name + "_f", f"SELECT * FROM {name}_c WHERE NOT moved"),
        (name + "_n", f"SELECT p.ticker, c.s, p.dt, MIN({key}) % 8 AS k, MIN({whole}) AS d FROM {name}_p p JOIN {name}_f c ON p.ticker = c.ticker GROUP BY p.ticker, c.s, p.dt"),
        (name + "_w", f"SELECT ticker, ARG_MIN(s, (FLOOR(inertia * 1e6 + 0.5), s)) AS s FROM (SELECT ticker, s, SUM(d) AS inertia FROM {name}_n GROUP BY ticker, s) GROUP BY ticker"),
        (name + "_m", f"SELECT f.*, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ROUND(2 * m4 + 1.5 * m0 - 3 * m3, 9) DESC, k) - 1 AS regime FROM {name}_f f JOIN {name}_w USING (ticker, s)"),
        (name, f"SELECT n.ticker, n.dt, n.s AS start, n.k AS cluster, m.regime FROM {name}_n n JOIN {name}_m m USING (ticker, s, k)"),
    ]


def risk(source: str = "lab", name: str = "risk"):
    v20, v90 = guarded("STDDEV_SAMP", 20, "log_return"), guarded("STDDEV_SAMP", 90, "log_return")
    return [
        (name + "_v", f"SELECT *, {v20} AS rv20, {v90} AS rv90 FROM {source}"),
        (name + "_r", f"""SELECT *, LEAST(GREATEST(
  LEAST(GREATEST((LEAST(GREATEST(rv20 / CASE WHEN rv90 = 0 THEN 1e-9 ELSE rv90 END, 0.5), 3.0) - 0.5) / 2.5 * 3.0, 0), 3)
  + LEAST(GREATEST(ABS(rsi14 - 50) / 50 * 3, 0), 3) + CASE WHEN close < ema20 THEN 2.0 ELSE 0.0 END
  + CASE WHEN macd_hist < 0 THEN 2.0 ELSE 0.0 END, 0), 10) AS raw0 FROM {name}_v"""),
        (name + "_w", f"SELECT *, CASE WHEN rv20 IS NULL OR rv90 IS NULL THEN NULL ELSE raw0 END AS raw FROM {name}_r"),
        (name + "_m", f"SELECT *, {guarded('AVG', 5, 'raw')} AS sm FROM {name}_w"),
        (name + "_o", f"SELECT *, CASE WHEN sm IS NOT NULL THEN LEAST(GREATEST(CASE WHEN regime IN (4, 5) THEN GREATEST(sm, 7.5) ELSE sm END, 0), 10) END AS sc FROM {name}_m"),
        (name, f"SELECT *, COALESCE(LAST_VALUE(sc IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 5.0) AS risk_score FROM {name}_o"),
    ]


def service_regimes(universe: str = "brand"):
    return bars(universe) + cleaned() + engineered("clean") + regime_bfill() + zscores() + kmeans()


def report_regimes(universe: str = "brand"):
    """Report variant: raw closes, incomplete rows dropped, dates shared with the benchmark."""
    return (
        bars(universe) + indicators() + regime_drop("ind", "rf_all") + bars("type", "tbars")
        + [("mbars", "SELECT * FROM tbars WHERE ticker = 'ECONOMY'")] + indicators("mbars", "mind") + regime_drop("mind", "mrf")
        + [("common", "SELECT f.* EXCLUDE (seq, n), m.log_return AS bench_ret FROM rf_all f JOIN mrf m USING (dt)")]
        + position("common", "rf") + zscores() + kmeans()
    )
