"""DuckDB statements that give the same rows as the problem queries."""

from __future__ import annotations


def label(c: str) -> str:
    """The period key of free text, as in functions.periods."""
    s = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    lead, tail = r"^(\d{4})[-/ ]?q([1-4])$", r"^(?:q([1-4])|([1-4])q|qtr ([1-4]),?)[-/ ]*''?(\d{4}|\d{2})$"
    word = r"^(?:(first|second|third|fourth) quarter|three months ended (march|june|september|december) \d+,?|(jan-mar|apr-jun|jul-sep|oct-dec)) (\d{4})$"
    half, lead_half, year = r"^(?:([12])h|h([12])|(first|second) half) ?(\d{4})$", r"^(\d{4})h([12])$", r"^(?:fy ?|full year )?((?:19|20)\d{2})$"
    ex = lambda p, i: f"regexp_extract({s}, '{p}', {i})"
    has = lambda p: f"regexp_matches({s}, '{p}')"
    y = f"(CASE WHEN length({ex(tail, 4)}) = 2 THEN '20' || {ex(tail, 4)} ELSE {ex(tail, 4)} END)"
    w = f"({ex(word, 1)} || {ex(word, 2)} || {ex(word, 3)})"
    wq = f"(CASE WHEN {w} IN ('first','march','jan-mar') THEN '1' WHEN {w} IN ('second','june','apr-jun') THEN '2' WHEN {w} IN ('third','september','jul-sep') THEN '3' ELSE '4' END)"
    h = f"({ex(half, 1)} || {ex(half, 2)} || CASE {ex(half, 3)} WHEN 'first' THEN '1' WHEN 'second' THEN '2' ELSE '' END)"
    return (
        f"(CASE WHEN {has(lead)} THEN {ex(lead, 1)} || 'Q' || {ex(lead, 2)} WHEN {has(tail)} THEN {y} || 'Q' || {ex(tail, 1)} || {ex(tail, 2)} || {ex(tail, 3)} "
        f"WHEN {has(word)} THEN {ex(word, 4)} || 'Q' || {wq} WHEN {has(year)} THEN {ex(year, 1)} WHEN {has(half)} THEN {ex(half, 4)} || 'H' || {h} "
        f"WHEN {has(lead_half)} THEN {ex(lead_half, 1)} || 'H' || {ex(lead_half, 2)} END)"
    )


def qidx(c: str) -> str:
    return f"(CASE WHEN {c} LIKE '____Q_' THEN CAST(substr({c}, 1, 4) AS INT) * 4 + CAST(substr({c}, 6, 1) AS INT) - 1 END)"


LABEL_OF = "(CAST(floor({0} / 4) AS INT) || 'Q' || ({0} % 4 + 1))"
_QUARTERS = f"labels AS (SELECT *, {label('period')} AS k FROM quarterly_revenue), quarters AS (SELECT *, {qidx('k')} AS q FROM labels WHERE k LIKE '____Q_')"
_POINTS = (
    f"WITH {_QUARTERS}, held AS (SELECT DISTINCT series_identity, q FROM quarters WHERE value_reported IS NOT NULL), "
    "spans AS (SELECT series_identity, min(q) AS lo, max(q) AS hi FROM held GROUP BY 1), "
    "grid AS (SELECT series_identity, unnest(range(lo, hi + 1)) AS q FROM spans)"
)
P1 = f"{_POINTS} SELECT g.series_identity, {LABEL_OF.format('g.q')} AS period FROM grid g ANTI JOIN held h ON g.series_identity = h.series_identity AND g.q = h.q"


def _normal_equations(ridge: float) -> str:
    """The grid's regression by LDL' of its five normal equations, one aliased step after another."""
    terms = ["1.0::DOUBLE", "(i - 8060) / 40.0::DOUBLE", "cos((i - 8060) * pi() / 2)", "sin((i - 8060) * pi() / 2)", "cos((i - 8060) * pi())"]
    n = range(len(terms))
    sums = [f"sum({terms[a]} * {terms[b]}) + {(ridge * (1e-3 if a == 0 else 1)) if a == b else 0.0}::DOUBLE AS a{a}{b}" for a in n for b in n if b <= a] + [f"sum({terms[a]} * v) AS r{a}" for a in n]
    steps = []
    for j in n:
        steps.append(f"a{j}{j}" + "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j)) + f" AS d{j}")
        steps += [f"(a{a}{j}" + "".join(f" - l{a}{k} * l{j}{k} * d{k}" for k in range(j)) + f") / d{j} AS l{a}{j}" for a in n if a > j]
    steps += [f"r{j}" + "".join(f" - l{j}{k} * z{k}" for k in range(j)) + f" AS z{j}" for j in n]
    steps += [f"z{j} / d{j}" + "".join(f" - l{a}{j} * b{a}" for a in n if a > j) + f" AS b{j}" for j in reversed(n)]
    fit = lambda x: "(" + " + ".join(f"b{k} * {t.replace('i - ', x + ' - ')}" for k, t in enumerate(terms)) + ")"
    return (
        f"WITH {_QUARTERS}, o AS (SELECT series_identity, q AS i, arg_max(value_reported, (reported_at, row_id)) AS v FROM quarters WHERE value_reported IS NOT NULL AND series_identity IS NOT NULL GROUP BY 1, 2), "
        f"u AS (SELECT series_identity, {', '.join(sums)} FROM o GROUP BY 1), f AS (SELECT series_identity, {', '.join(steps)} FROM u), "
        "w AS (SELECT *, lead(i) OVER (PARTITION BY series_identity ORDER BY i) AS ni, lead(v) OVER (PARTITION BY series_identity ORDER BY i) AS nv FROM o), "
        f"g AS (SELECT *, v - {fit('i')} AS le, nv - {fit('ni')} AS ri FROM (SELECT *, unnest(range(i, coalesce(ni, i + 1))) AS g FROM w) JOIN f USING (series_identity)), "
        f"e AS (SELECT *, {fit('g')} AS fitted, (g - i) / (ni - i)::DOUBLE AS share FROM g), h AS (SELECT *, fitted + le + share * (ri - le) AS fill FROM e) "
        f"SELECT series_identity, {LABEL_OF.format('g')} AS period, round(CASE WHEN g = i THEN v WHEN fill < 0 AND v >= 0 AND nv >= 0 THEN 0 ELSE fill END, 4) AS value_reported, round(fitted, 4) AS fitted, CASE WHEN g = i THEN 'observed' ELSE 'filled' END AS status FROM h"
    )


P1_GRID = _normal_equations(1e-3)
_TOTALS = (
    f"WITH {_QUARTERS}, latest AS (SELECT series_identity, q, arg_max(CAST(value_normalized_usd_millions AS DECIMAL(28,6)), (reported_at, row_id)) AS v, "
    "max_by(value_normalized_usd_millions IS NULL, (reported_at, row_id)) AS none FROM quarters GROUP BY 1, 2), "
    "held AS (SELECT series_identity, q, v FROM latest WHERE NOT none), spans AS (SELECT series_identity, min(q) AS lo, max(q) AS hi FROM held GROUP BY 1), "
    "grid AS (SELECT series_identity, unnest(range(lo, hi + 1)) AS q FROM spans), "
    "dense AS (SELECT g.series_identity, g.q, coalesce(h.v, 0) AS v FROM grid g LEFT JOIN held h ON g.series_identity = h.series_identity AND g.q = h.q), "
    "sums AS (SELECT series_identity, q, row_number() OVER w AS n, "
    + ", ".join(f"sum(v) OVER (PARTITION BY series_identity ORDER BY q ROWS {n - 1} PRECEDING) AS t{n}" for n in (2, 4, 8))
    + " FROM dense WINDOW w AS (PARTITION BY series_identity ORDER BY q))"
)
P2 = (
    f"{_TOTALS}, ranked AS (SELECT series_identity, q, row_number() OVER (PARTITION BY series_identity ORDER BY round(t4, 3) DESC, q) AS r FROM sums WHERE n >= 4) "
    f"SELECT series_identity, {LABEL_OF.format('q')} AS period FROM ranked WHERE r = 1"
)
P2_ALL = (
    f"{_TOTALS} SELECT series_identity, {LABEL_OF.format('q')} AS period, "
    + ", ".join(f"CAST(t{n} AS DOUBLE) AS total_{n}, CAST(t{n} AS DOUBLE) / least(n, {n}) AS average_{n}, n >= {n} AS full_{n}" for n in (2, 4, 8))
    + " FROM sums"
)


def _plain(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


_N = "replace(replace(trim(value_reported), ',', ''), ' ', '')"
_NUMBER = f"TRY_CAST(CASE WHEN {_N} LIKE '(%)' THEN '-' || substr({_N}, 2, length({_N}) - 2) WHEN {_N} LIKE '+%' THEN substr({_N}, 2) ELSE {_N} END AS DOUBLE)"
_SIDE = "SELECT row_id, any_value({n}) AS drug_name, any_value({p}) AS period, any_value({v}) AS value_reported, any_value({c}) AS currency FROM {t} GROUP BY 1"
_MEANT = f"coalesce({label('period')}, {_plain('period')})"
P4 = (
    "WITH a AS (" + _SIDE.format(n=_plain("drug_name"), p=_MEANT, v="value_reported", c=_plain("currency"), t="quarterly_revenue") + "), "
    "b AS (" + _SIDE.format(n=_plain("drug_name"), p=_MEANT, v=_NUMBER, c=_plain("currency"), t="revenue_export") + "), "
    "j AS (SELECT a.row_id, a.drug_name IS DISTINCT FROM b.drug_name AS n, a.period IS DISTINCT FROM b.period AS p, a.currency IS DISTINCT FROM b.currency AS c, "
    "CASE WHEN a.value_reported IS NULL AND b.value_reported IS NULL THEN false WHEN a.value_reported IS NULL OR b.value_reported IS NULL THEN true "
    "ELSE abs(a.value_reported - b.value_reported) > 0.000500001 END AS v FROM a JOIN b USING (row_id)) "
    "SELECT row_id, 'missing_in_export' AS difference FROM a ANTI JOIN b USING (row_id) UNION ALL SELECT row_id, 'missing_in_revenue' FROM b ANTI JOIN a USING (row_id) "
    "UNION ALL SELECT row_id, 'drug_name' FROM j WHERE n UNION ALL SELECT row_id, 'period' FROM j WHERE p "
    "UNION ALL SELECT row_id, 'value_reported' FROM j WHERE v UNION ALL SELECT row_id, 'currency' FROM j WHERE c"
)

_P4_BOTH = P4.split("SELECT a.row_id, a.drug_name IS DISTINCT FROM")[0]
_P4_DIFF = "list_filter([" + ", ".join(
    f"CASE WHEN {cond} THEN '{f}=' || coalesce(CAST(a.{f} AS VARCHAR), 'null') || '|' || coalesce(CAST(b.{f} AS VARCHAR), 'null') END"
    for f, cond in [
        ("drug_name", "a.drug_name IS DISTINCT FROM b.drug_name"), ("period", "a.period IS DISTINCT FROM b.period"),
        ("value_reported", "NOT coalesce(abs(a.value_reported - b.value_reported) <= 0.000500001, a.value_reported IS NULL AND b.value_reported IS NULL)"), ("currency", "a.currency IS DISTINCT FROM b.currency"),
    ]
) + "], lambda x: x IS NOT NULL)"
P4_ALL = (
    f"{_P4_BOTH.rsplit('j AS (', 1)[0].rstrip().rstrip(',')} SELECT row_id, 'missing_in_right' AS status, NULL AS differences FROM a ANTI JOIN b USING (row_id) UNION ALL SELECT row_id, 'missing_in_left', NULL FROM b ANTI JOIN a USING (row_id) "
    f"UNION ALL SELECT * FROM (SELECT a.row_id, 'differs', {_P4_DIFF} AS differences FROM a JOIN b USING (row_id)) WHERE len(differences) > 0"
)


def p7(explained: str, floor: float, steepness: float, frozen: int) -> str:
    """Implausible records, by the multiscale median transform over each series' latest figures."""
    limit = f"({floor}::DOUBLE + {steepness}::DOUBLE * coalesce(scale, 0))"
    smooth = lambda c, l1, r1, l2, r2: f"list_sort([{c}, coalesce({l1}, {c}), coalesce({r1}, {c}), coalesce({l2}, {l1}, {c}), coalesce({r2}, {r1}, {c})])[3]"
    out = lambda d: f"l1 IS NOT NULL AND r1 IS NOT NULL AND (({d} > {limit} AND NOT x) OR {d} < -{limit})"
    mid = lambda a, b, c: f"list_sort([{a}, {b}, {c}])[2]"
    return (
        f"WITH {_QUARTERS}, r AS (SELECT series_identity AS k, q AS i, value_reported AS v, reported_at, row_id, coalesce(regexp_matches(source_quote, '{explained}'), false) AS x FROM quarters WHERE value_reported IS NOT NULL AND NOT isnan(value_reported) AND series_identity IS NOT NULL AND q IS NOT NULL), "
        "s AS (SELECT k, i, arg_max(row_id, (reported_at, row_id)) AS row_id, arg_max(v, (reported_at, row_id)) AS v, arg_max(x, (reported_at, row_id)) AS x, min(row_id) <> max(row_id) AS several FROM r GROUP BY 1, 2), "
        "f AS (SELECT *, CASE WHEN lag(v) OVER w = v AND lag(i) OVER w = i - 1 THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY k ORDER BY i)), "
        "g AS (SELECT *, sum(starts) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f), h AS (SELECT *, count(*) OVER (PARTITION BY k, run) AS n FROM g), "
        "y AS (SELECT *, ln(v) AS y FROM s WHERE v > 0), n AS (SELECT *, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lead(y, 1) OVER w AS r1, lead(y, 2) OVER w AS r2 FROM y WINDOW w AS (PARTITION BY k ORDER BY i)), "
        f"c AS (SELECT *, {mid('y', 'coalesce(l1, y)', 'coalesce(r1, y)')} AS c, quantile_cont(abs(y - (l1 + r1) / 2), 0.5) OVER (PARTITION BY k) * 1.4826::DOUBLE AS scale FROM n), "
        "t AS (SELECT *, lag(c, 1) OVER w AS cl1, lag(c, 2) OVER w AS cl2, lead(c, 1) OVER w AS cr1, lead(c, 2) OVER w AS cr2 FROM c WINDOW w AS (PARTITION BY k ORDER BY i)), "
        f"z AS (SELECT r.row_id, ln(r.v) AS y, r.x, l1, r1, l2, r2, cl2, cr2, scale FROM r JOIN t ON r.k = t.k AND r.i = t.i WHERE r.v > 0 AND t.several AND r.row_id <> t.row_id), "
        f"o AS (SELECT *, {mid('y', 'l1', 'r1')} AS c, {mid('l1', 'y', 'coalesce(l2, l1)')} AS a, {mid('r1', 'y', 'coalesce(r2, r1)')} AS b FROM z) "
        f"SELECT row_id, 'impossible' AS problem FROM r WHERE v <= 0 UNION SELECT row_id, 'frozen' FROM h WHERE n >= {frozen} AND starts = 0 "
        f"UNION SELECT row_id, 'spike' FROM (SELECT *, y - {smooth('c', 'cl1', 'cr1', 'cl2', 'cr2')} AS d FROM t) WHERE {out('d')} "
        f"UNION SELECT row_id, 'spike' FROM (SELECT *, y - {smooth('c', 'a', 'b', 'cl2', 'cr2')} AS d FROM o) WHERE {out('d')}"
    )


_CONFLICT = lambda side, t, v: " UNION ALL ".join(f"SELECT row_id, '{side}' AS copy, '{f}' AS field, CAST(min({e}) AS VARCHAR) AS least, CAST(max({e}) AS VARCHAR) AS greatest FROM {t} GROUP BY row_id HAVING min({e}) <> max({e}) OR count({e}) NOT IN (0, count(*))" for f, e in [("drug_name", _plain("drug_name")), ("period", _MEANT), ("value_reported", v), ("currency", _plain("currency"))])
P4_CONFLICTS = _CONFLICT("revenue", "quarterly_revenue", "value_reported") + " UNION ALL " + _CONFLICT("export", "revenue_export", _NUMBER)

ORACLES = {"p1_found": P1, "p1_grid": P1_GRID, "p2_found": P2, "p2_trailing": P2_ALL, "p4_found": P4, "p4_differences": P4_ALL, "p4_conflicts": P4_CONFLICTS}
