"""SQL of the thinning that keeps peaks, for the queries that thin: cadence, breaks, runs and the reruns."""

from __future__ import annotations


def broken_sql(source: str, keys: list[str], most: str, to: str = "th", pairs: int | None = 2048) -> str:
    """CTEs that end in ``{to}_src(keys, ordinal, t_us, value, p, n, most, broken)`` of the samples in ``source``.

    The cadence is that of evenly picked ``pairs`` of neighbours, or of all of them (None).
    """
    k, w = ", ".join(keys), f"(PARTITION BY {', '.join(keys)} ORDER BY t_us, ordinal)"
    both = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    picks, at = (f"""
 {to}_c AS (SELECT DISTINCT {k}, n, least({pairs}, n - 1) AS c FROM {to}_p),
 {to}_pk AS (SELECT {k}, 1 + (i * (n - 1)) // c AS p FROM {to}_c, (SELECT unnest(range({pairs})) AS i) WHERE i < c),""", f" JOIN {to}_pk b ON {both} AND a.p = b.p") if pairs is not None else ("", "")
    return f""", {to}_p AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY {k}) AS n, t_us - lag(t_us) OVER w AS step, lag(usable) OVER w AS bu, lead(usable) OVER w AS au FROM {source} WINDOW w AS {w}),{picks}
 {to}_st AS (SELECT {', '.join('a.' + c for c in keys)}, step, row_number() OVER (PARTITION BY {', '.join('a.' + c for c in keys)} ORDER BY step, a.p) - 1 AS r, count(*) OVER (PARTITION BY {', '.join('a.' + c for c in keys)}) AS m FROM {to}_p a{at} WHERE usable AND bu AND step > 0),
 {to}_t AS (SELECT {k}, step * 4 AS threshold_us FROM {to}_st WHERE r = m // 2),
 {to}_b AS (SELECT a.*, bu IS NOT NULL AND NOT (usable AND bu AND step <= coalesce(threshold_us, 9e18)) AND (usable OR bu) AS mark FROM {to}_p a LEFT JOIN {to}_t USING ({k})),
 {to}_src AS (SELECT {k}, ordinal, t_us, value, p, n, {most} AS most, mark OR coalesce(lead(mark) OVER w, false) OR (bu IS NULL AND NOT usable) OR (au IS NULL AND NOT usable) AS broken FROM {to}_b WINDOW w AS {w})"""


def thinned_sql(keys: list[str], measures: tuple[str, ...] = ("value",), per_run: int = 6, to: str = "th") -> str:
    """CTEs that end in ``{to}_kept(keys, p)``: what stays of ``{to}_src``, after up to three reruns with more runs."""
    k = ", ".join(keys)
    picks = "min(p), max(p), min(p) FILTER (broken), max(p) FILTER (broken)"
    for m in measures:
        picks += "".join(f", arg_min(p, {{'v': {sign}{m}, 'p': p}}) FILTER ({m} IS NOT NULL)" for sign in ("", "-"))

    def kept(runs: str) -> str:
        cut = f"SELECT s.*, ((s.p + 1) * r.runs - 1) // s.n AS run FROM {to}_src s JOIN {runs} r USING ({k})"
        return f"SELECT DISTINCT {k}, p FROM (SELECT {k}, unnest([{picks}]) AS p FROM ({cut}) GROUP BY {k}, run) WHERE p IS NOT NULL"

    def counted(runs: str) -> str:
        return f"(SELECT {k}, count(*) AS cnt FROM ({kept(runs)}) GROUP BY {k})"

    out = f""", {to}_r AS (SELECT {k}, any_value(n) AS n, any_value(most) AS most, any_value(most) // {per_run} AS runs FROM {to}_src WHERE n > most AND most >= {per_run} GROUP BY {k}),
 {to}_g0 AS (SELECT r.*, cnt AS got FROM {to}_r r JOIN {counted(f"{to}_r")} USING ({k}))"""
    for i in range(3):
        more = "least(n, runs * most // got)"
        out += f""", {to}_t{i} AS (SELECT {k}, {more} AS runs FROM {to}_g{i} WHERE got < 0.9 * most AND {more} > runs),
 {to}_n{i} AS (SELECT {k}, t.runs AS more, cnt FROM {to}_t{i} t JOIN {counted(f"{to}_t{i}")} USING ({k})),
 {to}_g{i + 1} AS (SELECT {k}, n, most, CASE WHEN cnt <= most THEN more ELSE runs END AS runs, CASE WHEN cnt <= most THEN cnt ELSE got END AS got FROM {to}_g{i} LEFT JOIN {to}_n{i} USING ({k}))"""
    return out + f""", {to}_kept AS ({kept(f"{to}_g3")} UNION ALL SELECT {k}, p FROM {to}_src WHERE n <= most
  UNION ALL SELECT DISTINCT {k}, p FROM (SELECT s.*, unnest(range(greatest(most, 0))) AS i FROM {to}_src s WHERE n > most AND most < {per_run}) WHERE p = CASE WHEN most = 1 THEN 0 ELSE floor(i * (n - 1)::DOUBLE / (most - 1) + 0.5) END)"""
