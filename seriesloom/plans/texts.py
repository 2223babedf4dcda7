"""Queries over labels, quotes and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import text as X
from seriesloom.functions.periods import loose_date, period_label, quarter_index
from seriesloom.operators import prose
from seriesloom.plans.problem_sql import label, qidx
from seriesloom.plans.readings import DP, SRC, readings, sources
from seriesloom.plans.scalars import COMPARATIVE
from seriesloom.plans.workbench import JOB, jobs
from seriesloom import vocab as V
from seriesloom.session import table

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "drug_name", "doc_type", "lang")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Readings with their job's names."""
    j = jobs(spark, d).select(c("id").alias("job_id"), "drug_name", "generic_name")
    return readings(spark, d).join(j, "job_id", "left").withColumn("own", F.array_compact(F.array("drug_name", "generic_name")))


# --- labels and sentences --------------------------------------------------------------------------


def _t(pattern: str) -> str:
    """A pattern or text as SQL text."""
    return "'" + pattern.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_t(v) for v in values) + "]"


def _words(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{prose.ACCENTS[0]}', '{prose.ACCENTS[1]}'), {_t(prose.LETTER_OR_DIGIT)})"


def _squash(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{prose.ACCENTS[0]}', '{prose.ACCENTS[1]}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _near(a: str, b: str) -> str:
    return f"(length({a}) >= 5 AND length({b}) >= 5 AND levenshtein({a}, {b}) * 5 <= greatest(length({a}), length({b})))"


def _sentences(source: str, text: str) -> str:
    """A CTE ``sen``: ``source`` with the list ``s`` of the sentences of ``text``."""
    return (
        f"ln AS (SELECT *, list_filter(list_transform(regexp_split_to_array({text}, {_t(prose.BREAKS)}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM {source}), "
        "st AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR regexp_matches(l[i], '\\p{L}')) AS b FROM ln), "
        f"sen AS (SELECT * EXCLUDE (l, b), flatten(list_transform(range(1, len(b) + 1), lambda k: string_split(regexp_replace(array_to_string(l[b[k]:(CASE WHEN k < len(b) THEN b[k + 1] - 1 ELSE len(l) END)], ' '), {_t(prose.STOP)}, '\\1\n\\2', 'g'), '\n'))) AS s FROM st)"
    )


_LABELLED = f"{DP}, {JOB}, lab AS (SELECT dp.*, list_filter([drug_name, generic_name], lambda x: x IS NOT NULL) AS own, coalesce(combined, []) AS others FROM dp LEFT JOIN jobs ON dp.job_id = jobs.id)"
_HOLDS = f"({_squash('n')} <> '' AND contains({_squash('product')}, {_squash('n')}))"
_X18 = (
    f"WITH {_LABELLED}, h AS (SELECT *, {_words('product')} AS w, coalesce(list_filter(own, lambda n: {_HOLDS})[1], list_filter(own, lambda n: len(list_filter({_words('product')}, lambda x: {_near('x', _squash('n'))})) > 0)[1]) AS matched, list_filter(others, lambda n: {_HOLDS}) AS cmb FROM lab), "
    f"k AS (SELECT *, list_concat(flatten(list_transform(list_concat(own, cmb), lambda n: {_words('n')})), {_list(prose.PLACE_WORDS + prose.SUM_WORDS + prose.PLAIN_WORDS)}) AS known FROM h), "
    f"r AS (SELECT *, nullif(array_to_string(list_filter(w, lambda x: NOT list_contains(known, x) AND len(list_filter(own, lambda n: {_near('x', _squash('n'))})) = 0), ' '), '') AS residue FROM k) "
    "SELECT id, matched, CASE " + " ".join(f"WHEN regexp_matches(lower(product), {_t(p)}) THEN '{place}'" for place, p in prose.PLACES) + f" END AS scope, len(list_intersect(w, {_list(prose.SUM_WORDS)})) > 0 AS is_total, len(cmb) AS others, residue, "
    "array_to_string(list_filter([CASE WHEN matched IS NOT NULL AND residue IS NOT NULL THEN 'label_not_understood' END, CASE WHEN matched IS NOT NULL AND len(cmb) > 0 THEN 'combined_line' END], lambda x: x IS NOT NULL), ',') AS flags FROM r"
)


@query("q_x18_read_label", _X18)
def x18(spark: SparkSession, d: str) -> DataFrame:
    r = labelled(spark, d).select("id", prose.read_label(c("product"), c("own"), c("combined")).alias("l"))
    return r.select("id", "l.matched", "l.scope", "l.is_total", F.size("l.combined").cast("long").alias("others"), "l.residue", F.array_join("l.flags", ",").alias("flags"))


@query("q_x19_read_footnote", f"WITH {_LABELLED} SELECT id, CASE WHEN regexp_matches(lower(quote), '\\binclud(?:es|ing|ed)\\b|\\btogether with\\b') THEN len(list_filter(others, lambda o: contains(lower(quote), lower(o)))) ELSE 0 END AS includes, "
       f"regexp_matches(lower(quote), {_t(prose.NO_SALES)}) AS no_sales, regexp_matches(lower(quote), {_t(prose.PART_PERIOD)}) AS partial, len(list_filter(own, lambda a: contains(lower(quote), lower(a)))) > 0 AS names_own FROM lab WHERE quote IS NOT NULL")  # fmt: skip
def x19(spark: SparkSession, d: str) -> DataFrame:
    r = labelled(spark, d).filter("quote is not null").select("id", prose.read_footnote(c("quote"), c("own"), c("combined")).alias("n"))
    return r.select("id", F.size("n.includes").cast("long").alias("includes"), "n.no_sales", "n.partial", "n.names_own")


@query("q_x26_sentences", f"WITH {_sentences('(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)', 'text')} SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM sen")
def x26(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", F.posexplode(prose.sentences(c("text"))).alias("place", "sentence")).withColumn("place", c("place").cast("long"))


_SPELLS = "contains(lower(replace(x, ',', '')), regexp_replace(regexp_replace(printf('%.10f', reported), '0+$', ''), '\\.$', '')) OR contains(replace(x, ',', ''), printf('%.1f', reported)) OR contains(replace(x, ',', ''), printf('%.0f', reported))"


@query("q_x27_sentence_carrying", f"WITH {_LABELLED}, {_sentences('(SELECT id, quote, reported FROM lab WHERE quote IS NOT NULL AND reported IS NOT NULL)', 'quote')} SELECT id, list_filter(s, lambda x: {_SPELLS})[1] AS sentence FROM sen")
def x27(spark: SparkSession, d: str) -> DataFrame:
    r = labelled(spark, d).filter("quote is not null and reported is not null").withColumn("s", prose.sentences(c("quote")))
    v = c("reported")
    return r.select("id", F.try_element_at(F.filter("s", lambda s: X.quote_contains(s, v)), F.lit(1)).alias("sentence"))


def _said(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(text, {_t(pattern)}, 1), lambda t: coalesce(TRY_CAST(replace(t, ',', '') AS DOUBLE) = v, false))) > 0"


@query("q_p36_change_not_level", "WITH q AS (SELECT row_id, any_value(source_quote) AS text, any_value(value_reported) AS v FROM quarterly_revenue GROUP BY 1) "
       f"SELECT row_id, coalesce(regexp_matches(text, {_t(prose.RISE_OR_FALL)}) AND {_said(prose.BY_AMOUNT)} AND NOT {_said(prose.TO_AMOUNT)}, false) AS change FROM q WHERE text IS NOT NULL")  # fmt: skip
def p36(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quarterly_revenue").groupBy("row_id").agg(F.max(F.struct("reported_at", "source_quote", "value_reported")).alias("r")).select("row_id", "r.*")
    return q.filter("source_quote is not null").select("row_id", prose.states_a_change(c("source_quote"), c("value_reported")).alias("change"))


_MINE = f"len(list_filter(own, lambda n: contains(p, array_to_string({_words('n')}, ' ')) OR contains(array_to_string({_words('n')}, ' '), p) OR {_near(chr(40) + 'replace(p, chr(32), chr(0)))'.replace('chr(0)', chr(39) * 2), _squash('n'))})) > 0"
_P13 = (
    f"WITH {_LABELLED}, pt AS (SELECT id, own, list_transform(others, lambda o: array_to_string({_words('o')}, ' ')) AS sib, list_filter(list_transform(regexp_split_to_array(product, {_t(prose.JOINERS)}), lambda p: array_to_string(list_filter({_words('p')}, lambda w: NOT list_contains({_list(prose.PLAIN_WORDS)}, w)), ' ')), lambda p: p <> '') AS parts FROM lab) "
    f"SELECT id, list_filter(parts, lambda p: NOT ({_MINE}) AND (len(list_filter(string_split(p, ' '), lambda w: NOT list_contains({_list(prose.GROUP_WORDS)}, w))) = 0 OR len(parts) > 1 OR list_contains(sib, p)))[1] AS other FROM pt"
)


@query("q_p13_competing_product", _P13)
def p13(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("id", prose.names_a_competing_product(c("product"), c("own"), c("combined")).alias("other"))


_BY = _t(rf"(?i)\bby (?:about |some |nearly |almost )?{prose.MONEY}\b")
_KIND = _t(rf"(?i)^{prose.QUARTER}$")
_PROSE = (
    f"{_sentences('(SELECT doc_id, text, drug_name FROM documents WHERE drug_name IS NOT NULL AND text IS NOT NULL)', 'text')}, "
    "one AS (SELECT doc_id, drug_name, unnest(s) AS x FROM sen), "
    f"tk AS (SELECT doc_id, x, regexp_extract_all(regexp_replace(x, {_BY}, 'by so much', 'g'), {_t(rf'(?i)\b(?:{prose.QUARTER}|{prose.MONEY})\b')}) AS t FROM one WHERE drug_name <> '' AND contains(lower(x), lower(drug_name)) "
    f"AND len(list_filter(regexp_extract_all(x, '([\\p{{L}}\\p{{N}}-]+)[®™]', 1), lambda m: NOT contains(lower(drug_name), lower(m)))) = 0 AND NOT regexp_matches(x, {_t(prose.GROUPED)})), "
    f"kd AS (SELECT *, list_transform(t, lambda y: regexp_matches(y, {_KIND})) AS k FROM tk), "
    f"pr AS (SELECT doc_id, list_filter(t, lambda y: regexp_matches(y, {_KIND})) AS q, list_filter(t, lambda y: NOT regexp_matches(y, {_KIND})) AS a, regexp_matches(x, {_t(prose.PAIRED)}) OR len(list_filter(range(2, len(t) + 1), lambda i: k[i] = k[i - 1])) = 0 AS ok FROM kd), "
    "fg AS (SELECT doc_id, unnest(q) AS p, unnest(a) AS m FROM pr WHERE ok AND len(q) > 0 AND len(q) = len(a)), "
    f"c32 AS (SELECT doc_id, {label('p')} AS period, TRY_CAST(replace(string_split(m, ' ')[1], ',', '') AS DOUBLE) AS value, lower(string_split(m, ' ')[-1]) AS unit FROM fg)"
)


@query("q_c32_read_prose", f"WITH {_PROSE} SELECT doc_id, period, value, unit FROM c32")
def c32(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter("drug_name is not null").select("doc_id", F.explode(prose.read_prose(c("text"), F.array("drug_name"))).alias("v"))
    return x.select("doc_id", period_label(c("v.period")).alias("period"), "v.value", "v.unit")


_SCALE = "CASE unit WHEN 'billion' THEN 1000.0::DOUBLE WHEN 'thousand' THEN 0.001::DOUBLE WHEN 'crore' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END"


@query("q_c35_revenue_candidates", f"WITH {_PROSE} SELECT doc_id, period, min(v) AS value, count(*) AS n FROM (SELECT doc_id, period, value * {_SCALE} AS v FROM c32) GROUP BY 1, 2 HAVING max(v) - min(v) <= greatest(0.005::DOUBLE * abs(max(v)), 0.05::DOUBLE)")
def c35(spark: SparkSession, d: str) -> DataFrame:
    """Prose values in millions, one per document and period, contradicting ones rejected."""
    scale = F.when(c("unit") == "billion", 1000.0).when(c("unit") == "thousand", 0.001).when(c("unit") == "crore", 10.0).otherwise(1.0)
    v = c32(spark, d).select("doc_id", "period", (c("value") * scale).alias("v"))
    g = v.groupBy("doc_id", "period").agg(F.min("v").alias("value"), F.max("v").alias("hi"), F.count("*").alias("n"))
    return g.filter("hi - value <= greatest(0.005d * abs(hi), 0.05d)").drop("hi")


@query("q_t02_evidence_windows")
def t02(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter("drug_name is not null and text is not null")
    return x.select("doc_id", prose.evidence_windows("text", F.array("drug_name")).alias("e")).select("doc_id", F.length("e.passages").alias("chars"), "e.windows", "e.mentions")


def _one(pattern: str) -> str:
    return f"nullif(regexp_extract(x, {_t(pattern)}, 1), '')"


@query("q_x23_parse_indications", f"WITH {_sentences('(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)', 'text')}, one AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS x FROM sen), "
       f"ind AS (SELECT doc_id, i, nullif(trim(regexp_extract(x, {_t(prose.DISEASE)}, 1)), '') AS disease, lower({_one(prose.SETTING)}) AS setting, lower({_one(prose.POPULATION)}) AS population, {_one(prose.MARKER)} AS biomarker FROM one) "
       "SELECT doc_id, disease, setting, population, biomarker FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(disease) ORDER BY i) AS n FROM ind WHERE disease IS NOT NULL) WHERE n = 1")  # fmt: skip
def x23(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter("text is not null").select("doc_id", F.explode(prose.parse_indications(c("text"))).alias("i"))
    return x.select("doc_id", "i.*")


@query("q_c31_choose_filings")
def c31(spark: SparkSession, d: str) -> DataFrame:
    """A greedy cover of asked quarters by filings per job; a job's filings are its index, never the table."""
    s = sources(spark, d).withColumn("filed", loose_date(c("source_date"))).filter("filed is not null")
    order = F.when(X.form_family(c("filing_type")).isin("10-K", "20-F", "40-F"), 0).when(X.reports_a_period(c("filing_type")), 1).otherwise(2)
    end = F.year("filed") * 4 + F.quarter("filed") - 2
    f = s.select("job_id", "id", order.alias("o"), F.when(order == 0, F.sequence(end - 3, end)).otherwise(F.array(end)).alias("states"))

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        wanted = {q for states in pdf["states"] for q in states}
        got = prose.set_cover([(i, int(o), [int(q) for q in st]) for i, (o, st) in enumerate(zip(pdf["o"], pdf["states"]))], wanted, 2)
        return pd.DataFrame([(pdf["job_id"][i], pdf["id"][i], q) for i, q in got], columns=["job_id", "id", "q"])

    return f.groupBy("job_id").applyInPandas(cover, "job_id string, id string, q int")


QUERIES["q_j10_set_cover"] = lambda spark, d: c31(spark, d).groupBy("job_id").agg(F.count_distinct("id").alias("filings"), F.count("*").alias("quarters"))

# --- regex readers -----------------------------------------------------------------------------

_Q = r"(?i)\b(Q[1-4][ -/]?(?:19|20)\d{2}|(?:19|20)\d{2}[ -/]?Q[1-4]|[1-4]Q ?(?:19|20)\d{2}|(?:first|second|third|fourth) quarter (?:19|20)\d{2})\b"
_QSQL = _Q.replace("'", "''")


@query("q_d11_periods_named", f"SELECT doc_id, len(regexp_extract_all(text, '{_QSQL}', 1)) AS n FROM documents WHERE text IS NOT NULL")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_Q), 1)).cast("long").alias("n"))


@query("q_d10_period_context", f"WITH named AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_QSQL}', 1)) AS p FROM documents WHERE text IS NOT NULL), lb AS (SELECT doc_id, {label('p')} AS k FROM named), n AS (SELECT doc_id, {qidx('k')} AS q, count(*) AS n FROM lb GROUP BY 1, 2), "
       "t AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM n WHERE q IS NOT NULL) SELECT doc_id, max(q) AS q FROM t WHERE n * 2 >= top GROUP BY 1")  # fmt: skip
def d10(spark: SparkSession, d: str) -> DataFrame:
    """The dominant quarter of each document: the latest of those named at least half as often as the most named."""
    named = docs(spark, d).filter("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_Q), 1)).alias("p"))
    n = named.select("doc_id", quarter_index(period_label(c("p"))).alias("q")).filter("q is not null").groupBy("doc_id", "q").agg(F.count("*").alias("n"))
    top = n.groupBy("doc_id").agg(F.max("n").alias("top"))
    return n.join(top, "doc_id").filter("n * 2 >= top").groupBy("doc_id").agg(F.max("q").alias("q"))


_DATE = r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, (?:19|20)\d{2})\b"


@query("q_d12_dates_named", f"SELECT doc_id, len(regexp_extract_all(text, '{_DATE}', 1)) AS n FROM documents WHERE text IS NOT NULL")
def d12(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit(_DATE), 1), lambda x: F.try_to_date(F.regexp_replace(x, ",", ""), "MMMM d yyyy"))
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(F.array_compact(found)).cast("long").alias("n"))


# Wordings of a line of therapy, each with the treatments that came before.
LINES = [(2, r"(?i)\b(?:third|later)[- ]line\b|\b(?:two|three|2|3) (?:or more )?(?:prior|previous|earlier) (?:\w+ ){0,2}(?:therap|treatment|line|regimen)"), (1, r"(?i)\bsecond[- ]line\b|\b(?:one|1|a) (?:prior|previous|earlier) (?:\w+ ){0,2}(?:therap|treatment|line|regimen)"), (0, r"(?i)\bfirst[- ]line\b|\buntreated\b|\bnewly diagnosed\b")]
SOME_EARLIER = r"(?i)\b(?:relapsed|refractory|pretreated|previously treated|restarted|switched from)\b"


def line_of_therapy(text):
    """The class a text's wording states, by how many treatments came before; a first line beside a later one is unresolved."""
    t = F.coalesce(text, F.lit(""))
    third, second, first = (t.rlike(p) for _, p in LINES)
    nothing = (F.trim(t) == "") | (first & (second | third))
    return F.when(nothing, "unresolved").when(third, "third_line_plus").when(second, "second_line_plus").when(first, "first_line").when(t.rlike(SOME_EARLIER), "subsequent_unspecified").otherwise("all_lines_or_unspecified")


_LOT = [_t(p) for _, p in LINES]


@query("q_x21_line_of_therapy", f"WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, CASE WHEN trim(x) = '' OR (regexp_matches(x, {_LOT[2]}) AND (regexp_matches(x, {_LOT[1]}) OR regexp_matches(x, {_LOT[0]}))) THEN 'unresolved' WHEN regexp_matches(x, {_LOT[0]}) THEN 'third_line_plus' WHEN regexp_matches(x, {_LOT[1]}) THEN 'second_line_plus' "
       f"WHEN regexp_matches(x, {_LOT[2]}) THEN 'first_line' WHEN regexp_matches(x, {_t(SOME_EARLIER)}) THEN 'subsequent_unspecified' ELSE 'all_lines_or_unspecified' END AS lot FROM t")  # fmt: skip
def x21(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", line_of_therapy(c("text")).alias("lot"))


def therapeutic_area(disease):
    """A disease without parenthetical and trailing qualifiers, nested up to four deep."""
    t = X.collapse(disease)
    for _ in range(4):
        t = F.regexp_replace(t, r"\s*\([^()]*\)\s*$|\s*,[^,]*$|\s+(?:of|with|in|due to)\s+\S+(?:\s+\S+)*$", "")
    return F.lower(F.regexp_replace(t, r"[\s.,;:/-]+$", ""))


@query("q_x22_therapeutic_area", f"WITH {JOB} SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(indication, '\\s+', ' ', 'g')), "
       + "'A', ''), 'A', ''), 'A', ''), 'A', ''), '[\\s.,;:/-]+$', '')) AS area FROM jobs".replace("'A'", "'\\s*\\([^()]*\\)\\s*$|\\s*,[^,]*$|\\s+(?:of|with|in|due to)\\s+\\S+(?:\\s+\\S+)*$'"))
def x22(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", therapeutic_area(c("indication")).alias("area"))


_UNITS = [("billions", r"(?i)\bin billions\b|\bbillions of\b"), ("millions", r"(?i)\bin millions\b|\bmillions of\b|\bMio\b"), ("thousands", r"(?i)\bin thousands\b|\bthousands of\b|'000")]


@query("q_x24_detect_unit", f"WITH {DP} SELECT id, " + "CASE " + " ".join(f"WHEN regexp_matches(quote, '{p.replace(chr(39), chr(39) * 2)}') THEN '{u}'" for u, p in _UNITS) + " ELSE 'millions' END AS unit, " + " OR ".join(f"regexp_matches(quote, '{p.replace(chr(39), chr(39) * 2)}')" for _, p in _UNITS) + " AS declared FROM dp WHERE quote IS NOT NULL")
def x24(spark: SparkSession, d: str) -> DataFrame:
    case, said = F.lit("millions"), F.lit(False)
    for u, p in reversed(_UNITS):
        case, said = F.when(c("quote").rlike(p), u).otherwise(case), said | c("quote").rlike(p)
    return readings(spark, d).filter("quote is not null").select("id", case.alias("unit"), said.alias("declared"))


_CURR = [("CHF", r"(?i)\bCHF\b|Swiss francs"), ("GBP", r"(?i)\bGBP\b|£|pounds sterling"), ("EUR", r"(?i)\bEUR\b|€|\beuros?\b"), ("JPY", r"(?i)\bJPY\b|¥|\byen\b"), ("USD", r"(?i)\bUSD\b|\$|U\.S\. dollars")]


@query("q_x25_detect_currency", f"WITH {DP} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(quote, '{p}') THEN '{u}'" for u, p in _CURR) + " ELSE 'USD' END AS currency FROM dp WHERE quote IS NOT NULL")
def x25(spark: SparkSession, d: str) -> DataFrame:
    case = F.lit("USD")
    for u, p in reversed(_CURR):
        case = F.when(c("quote").rlike(p), u).otherwise(case)
    return readings(spark, d).filter("quote is not null").select("id", case.alias("currency"))


@query("q_x31_normalise_route", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'oral' WHEN 1 THEN 'intravenous' WHEN 2 THEN 'inhaled' ELSE lower(p_type) END AS route FROM part")
def x31(spark: SparkSession, d: str) -> DataFrame:
    from seriesloom.operators.peers import declared

    k = c("p_partkey") % 4
    raw = F.when(k == 0, " By  Mouth").when(k == 1, "IV").when(k == 2, "Respiratory (inhalation)").otherwise(c("p_type"))
    return table(spark, d, "part").select("p_partkey", declared("route_of_administration", raw).alias("route"))


@query("q_x30_clean_moa", "SELECT p_partkey, p_name AS moa FROM part")
def x30(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("12.1 Mechanism of Action "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(raw, r"(?i)^\s*\d+(?:\.\d+)*\s+(?:mechanism of action|clinical pharmacology)\b[:.]?", "")).alias("moa"))


@query("q_x33_reported_as", f"WITH {DP} SELECT id, CASE WHEN len(combined) > 0 THEN product || ' / ' || array_to_string(combined, ' / ') END AS reported_as FROM dp")
def x33(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("id", F.when(F.size("combined") > 0, F.concat_ws(" / ", "product", F.array_join("combined", " / "))).alias("reported_as"))


@query("q_x37_spellings", f"WITH {DP} SELECT id, printf('%.1f', reported) AS one, format('{{:,.1f}}', reported) AS grouped FROM dp WHERE abs(reported * 10 - round(reported * 10)) < 1e-6")
def x37(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).filter(F.abs(c("reported") * 10 - F.round(c("reported") * 10)) < 1e-6)
    return r.select("id", F.translate(F.format_number("reported", 1), ",", "").alias("one"), F.format_number("reported", 1).alias("grouped"))


@query("q_x38_scrub_prose", f"WITH {SRC} SELECT id, CASE WHEN source_url LIKE '%sec.gov%' THEN 'see ' || source_url ELSE 'see [link]' END AS prose FROM src")
def x38(spark: SparkSession, d: str) -> DataFrame:
    return sources(spark, d).select("id", F.regexp_replace(F.concat(F.lit("see "), "source_url"), r"https?://(?!\S*sec\.gov)\S+", "[link]").alias("prose"))


@query("q_x42_footnotes_by_mark", "SELECT p_partkey, 2 AS notes, 'Note on ' || p_name AS first_note FROM part")
def x42(spark: SparkSession, d: str) -> DataFrame:
    notes = F.array(F.concat(F.lit("(1) Note on "), "p_name"), F.lit("(2) other"), F.lit("no mark"))
    pairs = F.filter(F.transform(notes, lambda n: F.struct(F.regexp_extract(n, r"^\((\w{1,2})\)", 1).alias("k"), F.regexp_replace(n, r"^\(\w{1,2}\)\s*", "").alias("v"))), lambda e: e["k"] != "")
    return table(spark, d, "part").select("p_partkey", F.size(F.map_from_entries(pairs)).alias("notes"), F.map_from_entries(pairs)["1"].alias("first_note"))


@query("q_x40_positional_block", f"WITH {DP} SELECT id, count(*) AS figures FROM (SELECT id, unnest(regexp_extract_all(quote, '(?:^|[|] ?)(-|\\d[\\d,]*(?:\\.\\d+)?)', 1)) AS v FROM dp WHERE quote LIKE '%|%') GROUP BY 1")
def x40(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).filter("quote like '%|%'").select("id", F.explode(F.regexp_extract_all("quote", F.lit(r"(?:^|[|] ?)(-|\d[\d,]*(?:\.\d+)?)"), 1)).alias("v"))
    return r.groupBy("id").agg(F.count("*").alias("figures"))


def _member_words(x: str) -> str:
    split = rf"regexp_replace(regexp_replace(regexp_replace(string_split({x}, ':')[-1], 'Member$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({split}), '[^a-z0-9]+'), lambda w: w <> '')"


# over members m(id, w): each one's verdict and, where exactly one product answers, the product
_MATCH = (
    f"p AS (SELECT k, count(*) AS claimants, min(drug_name) AS product FROM (SELECT DISTINCT array_to_string({_member_words('drug_name')}, '') AS k, drug_name FROM jobs) GROUP BY 1), "
    "r AS (SELECT *, CASE WHEN len(w) = 0 THEN 'unknown' WHEN list_has_any(w, ['and', 'with', 'plus']) THEN 'joined' WHEN list_has_any(w[1:greatest(len(w) - 1, 1)], ['excluding', 'excluded', 'except', 'excludes', 'other', 'than', 'outside', 'without']) THEN 'excluding' END AS refusal FROM m), "
    "u AS (SELECT id, len(w) AS total, n, array_to_string(w[len(w) - n + 1:len(w)], '') AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM r WHERE refusal IS NULL)), "
    "b AS (SELECT id, max(n) AS n, any_value(total) AS total, arg_max(claimants, n) AS claimants, arg_max(product, n) AS product FROM u JOIN p USING (k) GROUP BY 1), "
    "ruled AS (SELECT id, coalesce(refusal, CASE WHEN claimants > 1 THEN 'ambiguous' WHEN n = total THEN 'exact' WHEN n IS NOT NULL THEN 'suffix' ELSE 'unmatched' END) AS verdict, CASE WHEN refusal IS NULL AND claimants = 1 THEN product END AS product FROM r LEFT JOIN b USING (id))"
)
_LABEL_MEMBER = "'co:' || regexp_replace(product, '\\s*[/+]\\s*', ' And ', 'g')"
_X15 = f"WITH {DP}, {JOB}, m AS (SELECT id, {_member_words(_LABEL_MEMBER)} AS w FROM dp), {_MATCH} SELECT id, verdict FROM ruled"


@query("q_x15_member_match", _X15)
def x15(spark: SparkSession, d: str) -> DataFrame:
    """Printed labels as members of a tagged instance, against the requested products."""
    m = readings(spark, d).select("id", F.concat(F.lit("co:"), F.regexp_replace("product", r"\s*[/+]\s*", " And ")).alias("member"))
    return match_members(m, "id", jobs(spark, d).select(c("drug_name").alias("product"))).select("id", "verdict")


def match_members(members: DataFrame, key: str, products: DataFrame) -> DataFrame:
    """The product whose words end a member's words, the longest run counting; joins, exclusions and ambiguity are refusals.

    Trailing runs are exploded (a member has few words) and met by an equi-join on the joined words.
    """
    w = X.member_words(c("member"))
    m = members.withColumn("w", w)
    refusal = F.when(F.size("w") == 0, "unknown").when(F.arrays_overlap("w", F.array(F.lit("and"), F.lit("with"), F.lit("plus"))), "joined")
    refusal = F.coalesce(refusal, F.when(F.arrays_overlap(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))), F.array(*[F.lit(x) for x in ("excluding", "excluded", "except", "excludes", "other", "than", "outside", "without")])), "excluding"))
    m = m.withColumn("refusal", refusal)
    runs = m.filter("refusal is null").select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    runs = runs.select(key, "n", F.size("w").alias("all"), F.array_join(F.slice("w", F.size("w") - c("n") + 1, c("n")), "").alias("k"))
    p = products.select(F.array_join(X.member_words(c("product")), "").alias("k"), "product").distinct().groupBy("k").agg(F.count("*").alias("claimants"), F.min("product").alias("product"))
    best = runs.join(p, "k").groupBy(key).agg(F.max(F.struct("n", "all", "claimants", "product")).alias("b"))
    hit = F.when(c("b.claimants") > 1, "ambiguous").when(c("b.n") == c("b.all"), "exact").when(c("b").isNotNull(), "suffix").otherwise("unmatched")
    return m.join(best, key, "left").select(key, F.coalesce("refusal", hit).alias("verdict"), F.when(c("refusal").isNull() & (c("b.claimants") == 1), c("b.product")).alias("product"))


_NAME_MEMBER = "'co:' || regexp_replace(drug_name, '[^A-Za-z0-9]', '', 'g') || 'Member'"
_CANON = "regexp_replace(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'), 'Member$', '')), '[^a-z0-9]', '', 'g')"


@query("q_j16_resolve_members", f"WITH {JOB}, j AS (SELECT DISTINCT id, drug_name FROM jobs WHERE drug_name IS NOT NULL), m AS (SELECT id, {_member_words(_NAME_MEMBER)} AS w FROM j), {_MATCH}, "
       f"reg AS (SELECT {_CANON.format('drug_name')} AS k, min(drug_name) AS known FROM jobs WHERE status = 'completed' AND drug_name IS NOT NULL GROUP BY 1) "
       f"SELECT id, coalesce(known, product) AS product, CASE WHEN known IS NOT NULL THEN 'register' ELSE verdict END AS verdict FROM j JOIN ruled USING (id) LEFT JOIN reg ON reg.k = {_CANON.format('j.drug_name')}")  # fmt: skip
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The register first, then the rules."""
    j = jobs(spark, d).filter("drug_name is not null")
    m = j.select("id", F.concat(F.lit("co:"), F.regexp_replace("drug_name", "[^A-Za-z0-9]", ""), F.lit("Member")).alias("member")).distinct()
    register = j.filter("status = 'completed'").select(X.canonical_member(F.regexp_replace("drug_name", "[^A-Za-z0-9]", "")).alias("k"), "drug_name").groupBy("k").agg(F.min("drug_name").alias("known"))
    ruled = match_members(m, "id", j.select(c("drug_name").alias("product")))
    out = m.withColumn("k", X.canonical_member(c("member"))).join(register, "k", "left").join(ruled, "id")
    return out.select("id", F.coalesce("known", "product").alias("product"), F.when(c("known").isNotNull(), "register").otherwise(c("verdict")).alias("verdict"))


# --- candidate filters and judgement -------------------------------------------------------------


def drop_reason(quote, aliases, period, value, scope):
    """The first rule that drops a candidate; null where it is kept."""
    named = X.mentions(quote, aliases)
    noise = quote.rlike(V.TAXONOMY_MEMBER) | (F.trim(quote).rlike(V.TAXONOMY_NAME) & quote.contains(":"))
    total = quote.rlike(r"(?i)\btotal (?:net )?(?:revenues?|sales)\b")
    zero = quote.rlike(V.STATES_ZERO)
    return (
        F.when(F.coalesce(F.trim(quote), F.lit("")) == "", "missing_quote").when(noise, "xbrl_taxonomy_noise").when(~period.rlike("[0-9]") & (F.lower(period) != "unknown"), "placeholder_period")
        .when(total & ~named, "company_total_not_product").when(scope.isin("Worldwide", "U.S.", "Product family") & ~named, "product_scope_without_product_in_quote").when(value.isNull(), "missing_value")
        .when((value == 0) & (~named | ~zero), "zero_value_unsupported")
    )


_NAMED = "contains(lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(product, '\\s+', ' ', 'g'))))"
_DROP = f"CASE WHEN coalesce(trim(quote), '') = '' THEN 'missing_quote' WHEN regexp_matches(quote, '{V.TAXONOMY_MEMBER}') OR (regexp_matches(trim(quote), '{V.TAXONOMY_NAME}') AND contains(quote, ':')) THEN 'xbrl_taxonomy_noise' WHEN NOT regexp_matches(period, '[0-9]') AND lower(period) <> 'unknown' THEN 'placeholder_period' WHEN regexp_matches(quote, '(?i)\\btotal (?:net )?(?:revenues?|sales)\\b') AND NOT {_NAMED} THEN 'company_total_not_product' WHEN scope IN ('Worldwide', 'U.S.', 'Product family') AND NOT {_NAMED} THEN 'product_scope_without_product_in_quote' WHEN reported IS NULL THEN 'missing_value' WHEN reported = 0 THEN 'zero_value_unsupported' END"


@query("q_p09_filter_candidates", f"WITH {DP} SELECT id, {_DROP} AS drop_reason FROM dp")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("id", drop_reason(c("quote"), F.array("product"), c("period"), c("reported"), c("scope")).alias("drop_reason"))


@query("q_g26_drop_histogram", f"WITH {DP} SELECT source_id, {_DROP} AS drop_reason, count(*) AS n FROM dp GROUP BY 1, 2")
def g26(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).select("source_id", drop_reason(c("quote"), F.array("product"), c("period"), c("reported"), c("scope")).alias("drop_reason"))
    return r.groupBy("source_id", "drop_reason").agg(F.count("*").alias("n"))


@query("q_p11_generic_only", f"WITH {DP}, {JOB} SELECT dp.id FROM dp JOIN jobs ON dp.job_id = jobs.id WHERE quote IS NOT NULL AND generic_name IS NOT NULL AND contains(lower(quote), lower(generic_name)) AND NOT contains(lower(quote), lower(drug_name))")
def p11(spark: SparkSession, d: str) -> DataFrame:
    q = F.lower("quote")
    return labelled(spark, d).filter(c("quote").isNotNull() & c("generic_name").isNotNull() & q.contains(F.lower("generic_name")) & ~q.contains(F.lower("drug_name"))).select("id")


@query("q_p12_other_brand", f"WITH {DP} SELECT id, lower(combined[1]) AS other FROM dp WHERE len(combined) > 0 AND quote IS NOT NULL AND regexp_matches(lower(quote), '\\b' || regexp_escape(lower(combined[1])) || '\\b')")
def p12(spark: SparkSession, d: str) -> DataFrame:
    q = F.lower(X.collapse(c("quote")))
    hit = F.filter("combined", lambda p: F.regexp(q, F.concat(F.lit(r"\b\Q"), F.lower(p), F.lit(r"\E\b"))))
    return readings(spark, d).filter("quote is not null").select("id", F.lower(F.try_element_at(hit, F.lit(1))).alias("other")).filter("other is not null")


_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("q_p18_verbatim", f"WITH {DP}, src AS (SELECT job_id, product, max_by(quote, (length(quote), quote)) AS source FROM dp WHERE quote IS NOT NULL GROUP BY 1, 2) SELECT id, length(trim(quote)) >= 1 AND (contains(source, quote) OR contains({_FLAT.format('source')}, {_FLAT.format('quote')})) AS verbatim FROM dp JOIN src USING (job_id, product) WHERE quote IS NOT NULL")
def p18(spark: SparkSession, d: str) -> DataFrame:
    """Whether each quote stands in the longest quote its job has of the product."""
    r = readings(spark, d).filter("quote is not null").select("id", "job_id", "product", "quote")
    source = r.groupBy("job_id", "product").agg(F.max(F.struct(F.length("quote").alias("n"), "quote")).alias("m")).select("job_id", "product", c("m.quote").alias("source"))
    return r.join(source, ["job_id", "product"]).select("id", X.verbatim(c("quote"), c("source")).alias("verbatim"))


@query("q_p21_blends_sibling", f"WITH {JOB} SELECT id, contains(lower(coalesce(indication, '')), lower(drug_name) || ' ') AS blends FROM jobs")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", F.lower(F.coalesce("indication", F.lit(""))).contains(F.concat(F.lower("drug_name"), F.lit(" "))).alias("blends"))


@query("q_p37_non_revenue_metric", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(cost of (?:goods|sales)|R&D|research and development|inventor(?:y|ies)|operating expenses?)\\b') THEN 'non_revenue' END AS metric FROM documents")
def p37(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.when(c("text").rlike(r"(?i)\b(cost of (?:goods|sales)|R&D|research and development|inventor(?:y|ies)|operating expenses?)\b"), "non_revenue").alias("metric"))


@query("q_p35_epc_as_moa", "WITH t AS (SELECT p_brand, list(DISTINCT lower(trim(split_part(p_type, ' ', 1)))) AS terms FROM part GROUP BY 1) SELECT p_partkey FROM part JOIN t USING (p_brand) WHERE list_contains(terms, lower(trim(split_part(p_name, ' ', 1))))")
def p35(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name begins with a class their brand's types begin with: a class given for a mechanism."""
    p = table(spark, d, "part")
    first = lambda x: F.lower(F.trim(F.substring_index(x, " ", 1)))
    terms = p.groupBy("p_brand").agg(F.collect_set(first("p_type")).alias("terms"))
    return p.join(terms, "p_brand").filter(F.array_contains("terms", first("p_name"))).select("p_partkey")


_JUDGE = f"CASE WHEN quote IS NULL OR NOT {_NAMED} THEN 'misclassified' WHEN list_contains(flags, 'label_not_understood') THEN 'undecided' WHEN period_type NOT IN ('quarterly', 'annual') THEN 'partial' WHEN contains(replace(quote, ',', ''), regexp_replace(regexp_replace(printf('%.10f', reported), '0+$', ''), '\\.$', '')) OR contains(replace(quote, ',', ''), printf('%.1f', reported)) OR contains(replace(quote, ',', ''), printf('%.0f', reported)) THEN CASE WHEN scope NOT IN ('', 'Unknown') THEN 'supported' ELSE 'undecided' END ELSE 'undecided' END"


def judgement():
    """Support class of a reading without a model: veto, not understood, span, then the clean case."""
    named = F.coalesce(X.mentions(c("quote"), F.array("product")), F.lit(False)) & c("quote").isNotNull()
    clean = X.quote_contains(c("quote"), c("reported")) & ~c("scope").isin("", "Unknown")
    return F.when(~named, "misclassified").when(F.array_contains("flags", "label_not_understood"), "undecided").when(~c("period_type").isin("quarterly", "annual"), "partial").when(clean, "supported").otherwise("undecided")


@query("q_c21_deterministic_judgment", f"WITH {DP} SELECT id, {_JUDGE} AS support FROM dp")
def c21(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("id", judgement().alias("support"))


@query("q_c20_hard_vetoes", f"WITH {DP} SELECT id, quote IS NULL OR NOT {_NAMED} AS vetoed FROM dp")
def c20(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("id", (judgement() == "misclassified").alias("vetoed"))


@query("q_c51_judge", f"WITH {DP} SELECT id, CASE WHEN {_JUDGE} = 'supported' AND status NOT LIKE 'derived%' THEN 'auto_pass' ELSE 'needs_review' END AS status, CASE WHEN {_JUDGE} = 'supported' THEN greatest(0.85, 0.75) ELSE 0.55 END AS confidence FROM dp")
def c51(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows always go to review; a quote that holds the value lifts confidence, anything else caps it."""
    ok = judgement() == "supported"
    return readings(spark, d).select("id", F.when(ok & ~c("status").startswith("derived"), "auto_pass").otherwise("needs_review").alias("status"), F.when(ok, F.greatest(F.lit(0.85), F.lit(0.75))).otherwise(0.55).alias("confidence"))


@query("q_c52_peer_names", f"WITH {DP} SELECT job_id, list_sort(list(DISTINCT lower(o))) AS peers FROM (SELECT job_id, unnest(combined) AS o FROM dp) GROUP BY 1")
def c52(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).select("job_id", F.explode("combined").alias("o"))
    return r.groupBy("job_id").agg(F.array_sort(F.collect_set(F.lower("o"))).alias("peers"))


@query("q_c27_document_coverage", f"WITH {_PROSE}, carried AS (SELECT doc_id, count(DISTINCT period) AS quarters FROM c32 GROUP BY 1) SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN quarters > 0 THEN 'answers' WHEN contains(lower(text), lower(drug_name)) THEN 'names_only' ELSE 'absent' END AS verdict, coalesce(quarters, 0) AS quarters FROM documents LEFT JOIN carried USING (doc_id) WHERE drug_name IS NOT NULL")
def c27(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document carries figures of its product per quarter, only names it, or is silent."""
    carried = c32(spark, d).groupBy("doc_id").agg(F.count_distinct("period").alias("quarters"))
    x = docs(spark, d).filter("drug_name is not null").join(carried, "doc_id", "left")
    named = F.lower("text").contains(F.lower("drug_name"))
    return x.select("doc_id", F.when(c("text").isNull(), "unreadable").when(c("quarters") > 0, "answers").when(named, "names_only").otherwise("absent").alias("verdict"), F.coalesce("quarters", F.lit(0)).alias("quarters"))


_YEAR_BEFORE = "(CASE WHEN regexp_matches(period, '^[0-9]{4}(Q[1-4]|H[12]|M9)?$') THEN CAST(CAST(substr(period, 1, 4) AS INT) - 1 AS VARCHAR) || substr(period, 5) END)"


@query("q_c36_comparative_candidates", f"WITH {DP}, {COMPARATIVE}, made AS (SELECT job_id, product, {_YEAR_BEFORE} AS period, v, round(v, 3) AS k FROM cmp WHERE v IS NOT NULL AND reported IS NOT NULL), one AS (SELECT job_id, product, period, k, any_value(v) AS value FROM made WHERE period IS NOT NULL GROUP BY 1, 2, 3, 4) "
       "SELECT job_id, product, period, value FROM one ANTI JOIN (SELECT job_id, product, period, round(reported, 3) AS k FROM dp WHERE quote IS NOT NULL AND reported IS NOT NULL) r USING (job_id, product, period, k)")  # fmt: skip
def c36(spark: SparkSession, d: str) -> DataFrame:
    """Prior-year figures proven by the arithmetic of their row, where no reading has them yet."""
    from seriesloom.functions.periods import year_before

    r = readings(spark, d).filter("quote is not null and reported is not null")
    made = r.select("job_id", "product", year_before(c("period")).alias("period"), X.comparative_value(c("quote"), c("reported")).alias("v")).filter("v is not null and period is not null")
    made = made.withColumn("k", F.round("v", 3)).dropDuplicates(["job_id", "product", "period", "k"])
    return made.join(r.select("job_id", "product", "period", F.round("reported", 3).alias("k")), ["job_id", "product", "period", "k"], "left_anti").select("job_id", "product", "period", c("v").alias("value"))


@query("q_w13_column_edges", "WITH s AS (SELECT DISTINCT l_orderkey, l_quantity AS a, l_quantity + 3 AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM s), g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a - pb >= 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT l_orderkey, min(a) AS left_edge, max(b) AS right_edge FROM g GROUP BY l_orderkey, n")
def w13(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select("l_orderkey", c("l_quantity").alias("a"), (c("l_quantity") + 3).alias("b"))
    return merge_spans(s, "l_orderkey", "a", "b", 1.5)


def merge_spans(spans: DataFrame, key: str, left: str, right: str, gap: float) -> DataFrame:
    """Intervals less than ``gap`` apart merged (gaps and islands); equal intervals are one, so ties cannot part an island."""
    spans = spans.select(key, left, right).distinct()
    w = Window.partitionBy(key).orderBy(left, right)
    reach = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = spans.withColumn("_r", reach).withColumn("_new", F.when(c("_r").isNull() | (c(left) - c("_r") >= gap), 1).otherwise(0))
    m = m.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(key, "_n").agg(F.min(left).alias("left_edge"), F.max(right).alias("right_edge")).drop("_n")


@query("q_a08_parse_reply", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def a08(spark: SparkSession, d: str) -> DataFrame:
    """An object from a reply that may be fenced or prefixed by prose."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    body = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").alias("k"))


@query("q_a11_label_record", "SELECT p_partkey, p_brand AS brand, 'openfda' AS path FROM part")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """The first path of a nested record that states a value, with the path recorded."""
    js = F.to_json(F.struct(F.struct(F.array("p_brand").alias("brand_name")).alias("openfda"), F.array(F.struct(F.lit("X").alias("brand_name"))).alias("products")))
    paths = [("openfda", "$.openfda.brand_name[0]"), ("products", "$.products[0].brand_name")]
    found = [F.get_json_object(js, p) for _, p in paths]
    return table(spark, d, "part").select("p_partkey", F.coalesce(*found).alias("brand"), F.coalesce(*[F.when(f.isNotNull(), n) for f, (n, _) in zip(found, paths)]).alias("path"))


@query("q_a13_brand_names", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type])) AS brands FROM part")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_union(F.array("p_brand"), F.array("p_type", "p_brand"))).alias("brands"))


@query("q_a15_brand_matched_results", f"WITH {JOB}, e AS (SELECT DISTINCT lower(trim(drug_name)) AS b FROM jobs), x AS (SELECT e.b, count(*) FILTER (f.b = e.b) AS exact, count(*) FILTER (f.b LIKE e.b || ' %') AS ext FROM e JOIN e f ON split_part(f.b, ' ', 1) = split_part(e.b, ' ', 1) GROUP BY 1) SELECT b AS brand, CASE WHEN exact > 0 THEN 'exact' WHEN ext > 0 THEN 'extension' END AS kind FROM x")
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Exact brand matches, else extensions, never both; candidates meet on the first word."""
    e = jobs(spark, d).select(F.lower(F.trim("drug_name")).alias("b")).filter("b is not null").distinct().withColumn("w", F.substring_index("b", " ", 1))
    f = e.select(c("b").alias("o"), "w")
    x = e.join(f, "w").groupBy("b").agg(F.count_if(c("o") == c("b")).alias("exact"), F.count_if(c("o").startswith(F.concat("b", F.lit(" ")))).alias("ext"))
    return x.select(c("b").alias("brand"), F.when(c("exact") > 0, "exact").when(c("ext") > 0, "extension").alias("kind"))
