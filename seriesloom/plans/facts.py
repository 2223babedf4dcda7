"""Queries over tagged facts, bulk extracts and HTML tables; documents are built from stored rows, so results can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import text as X
from seriesloom.functions.numeric import text_number
from seriesloom.sources import files, markup
from seriesloom.session import table
from seriesloom.vocab import HYPOTHETICAL

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- HTML --------------------------------------------------------------------------------------


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One page per part: a heading over two columns, a cell over two rows, figures below."""
    p = table(spark, d, "part")
    html = F.concat(
        F.lit("<html><p>x</p><table><tr><th rowspan='2'>Product</th><th colspan=2>Three months ended June 30,</th></tr><tr><td>2020</td><td>2019</td></tr><tr><td> "), "p_name", F.lit(" &amp; co</td><td>"), c("p_size").cast("string"),
        F.lit("</td><td>"), (c("p_size") + 1).cast("string"), F.lit("</td></tr><tr><td>Total</td><td>"), (c("p_size") * 2).cast("string"), F.lit("</td><td>-</td></tr></table></html>"),
    )
    return p.select(c("p_partkey").alias("page_id"), html.alias("html"), "p_name", "p_size")


_CELLS = (
    "cells AS (SELECT p_partkey AS page_id, 0 AS table_no, unnest([0,0,0,1,1,1,2,2,2,3,3,3]) AS row, unnest([0,1,2,0,1,2,0,1,2,0,1,2]) AS col, unnest(['Product', 'Three months ended June 30,', NULL, NULL, '2020', '2019', trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' & co', CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), 'Total', CAST(p_size * 2 AS VARCHAR), '-']) AS text, "
    "unnest([true, true, false, false, true, true, true, true, true, true, true, true]) AS is_origin FROM part)"
)


@query("q_s19_html_table_grid", f"WITH {_CELLS} SELECT * FROM cells")
def s19(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_cells(pages(spark, d), "page_id", "html")


@query("q_a01_flatten_grid", f"WITH {_CELLS} SELECT page_id, row, count(text) AS cells FROM cells GROUP BY 1, 2 HAVING count(text) > 0")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return s19(spark, d).filter("text is not null").groupBy("page_id", "row").agg(F.count("*").alias("cells"))


@query("q_a02_covering", f"WITH {_CELLS} SELECT page_id, row, col, last_value(text IGNORE NULLS) OVER (PARTITION BY page_id, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS covering FROM cells")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return markup.covering(s19(spark, d), "page_id").select("page_id", "row", "col", "covering")


@query("q_a03_stated_periods", f"WITH {_CELLS} SELECT page_id, col, CASE col WHEN 1 THEN '2020Q2' WHEN 2 THEN '2019Q2' END AS period FROM cells WHERE row = 1 AND col > 0")
def a03(spark: SparkSession, d: str) -> DataFrame:
    """Per column the heading cells that cover it, stacked and read as a period."""
    from seriesloom.functions.periods import period_label

    g = markup.covering(s19(spark, d), "page_id").filter("row < 2 and col > 0").groupBy("page_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "covering"))).alias("h"))
    return g.select("page_id", "col", period_label(F.array_join(F.transform("h", lambda x: x["covering"]), " ")).alias("period"))


_PLACES = r"(?i)\b(u\.?s\.?|united states|americas?|europe|asia|worldwide|international|rest of world)\b"


@query("q_a04_column_scopes", f"SELECT r_regionkey AS page_id, 1 AS col FROM region WHERE regexp_matches(r_name, '{_PLACES}')")
def a04(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose stacked headings name a geography: pages with a region over their figures."""
    html = F.concat(F.lit("<table><tr><th>Product</th><th>Sales in "), F.initcap("r_name"), F.lit("</th></tr><tr><td>2020</td><td>1</td></tr></table>"))
    p = table(spark, d, "region").select(c("r_regionkey").alias("page_id"), html.alias("html"))
    g = markup.covering(markup.html_cells(p, "page_id", "html"), "page_id").filter("row < 2")
    return g.filter(c("covering").rlike(_PLACES)).select("page_id", "col").distinct()


@query("q_a05_table_relevance", f"WITH {_CELLS} SELECT page_id, table_no, CAST(count(DISTINCT row) FILTER (regexp_matches(text, '^\\(?[$€£]?\\d[\\d,]*(?:\\.\\d+)?\\)?%?$')) + 2 AS BIGINT) + CASE WHEN bool_or(regexp_matches(text, '(?i)[$€£]|\\b(million|thousand|billion|revenue|sales)')) THEN 2 ELSE 0 END AS score FROM cells GROUP BY 1, 2")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return markup.relevance(s19(spark, d), "page_id").withColumn("score", c("score").cast("long"))


@query("q_c28_read_table", "SELECT p_partkey AS page_id, unnest(['2020Q2', '2019Q2']) AS period, unnest([CAST(p_size AS DOUBLE), CAST(p_size + 1 AS DOUBLE)]) AS value FROM part")
def c28(spark: SparkSession, d: str) -> DataFrame:
    """The product's row of each table, its figures under the period its column states."""
    k = s19(spark, d)
    own = k.filter("col = 0 and row >= 2").join(pages(spark, d).select("page_id", "p_name"), "page_id").filter(F.lower("text").startswith(F.lower(X.collapse(c("p_name"))))).select("page_id", "row")
    figures = k.join(own, ["page_id", "row"]).filter("col > 0").select("page_id", "col", text_number(c("text")).alias("value"))
    return figures.join(a03(spark, d), ["page_id", "col"]).select("page_id", "period", "value")


@query("q_g27_regroup", "SELECT p_type, '2020Q2' AS period, sum(p_size)::DOUBLE AS value FROM part GROUP BY 1 UNION ALL SELECT p_type, '2019Q2', sum(p_size + 1)::DOUBLE FROM part GROUP BY 1")
def g27(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(c("p_partkey").alias("page_id"), "p_type")
    return c28(spark, d).join(p, "page_id").groupBy("p_type", "period").agg(F.sum("value").alias("value"))


# --- tagged instances --------------------------------------------------------------------------


def instances(spark: SparkSession, d: str) -> DataFrame:
    """One instance per supplier: a quarter's revenue of a product, and the same in one country."""
    s = table(spark, d, "supplier")
    head = '<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:iso4217="http://www.xbrl.org/2003/iso4217">'
    ctx = lambda name, extra: f'<xbrli:context id="{name}"><xbrli:entity><xbrli:segment><xbrldi:explicitMember xmlns:xbrldi="http://xbrl.org/2006/xbrldi" dimension="srt:ProductOrServiceAxis">co:AlphaMember</xbrldi:explicitMember>{extra}</xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2023-04-01</xbrli:startDate><xbrli:endDate>2023-06-30</xbrli:endDate></xbrli:period></xbrli:context>'
    country = '<m:explicitMember xmlns:m="http://xbrl.org/2006/xbrldi" dimension="srt:StatementGeographicalAxis">country:US</m:explicitMember>'
    unit = '<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>'
    fact = lambda ref, v, sign: F.concat(F.lit(f'<us-gaap:Revenues contextRef="{ref}" unitRef="usd" decimals="-5"{sign}>'), v, F.lit("</us-gaap:Revenues>"))
    n = (c("s_suppkey") * 100000).cast("string")
    xml = F.concat(F.lit(head + ctx("all", "") + ctx("us", country) + unit), fact("all", n, ""), fact("us", n, ' sign="-"'), F.lit('<us-gaap:Note contextRef="all">text</us-gaap:Note></xbrli:xbrl>'))
    return s.select("s_suppkey", xml.alias("xml"))


@query("q_s14_parse_facts", "SELECT s_suppkey, 'us-gaap:Revenues' AS element, unnest([s_suppkey * 100000, -s_suppkey * 100000])::DOUBLE AS value, unnest([1, 2]) AS n_members, DATE '2023-04-01' AS start, DATE '2023-06-30' AS \"end\", 'USD' AS unit, '-5' AS decimals FROM supplier")
def s14(spark: SparkSession, d: str) -> DataFrame:
    f = markup.tagged_facts(instances(spark, d), "s_suppkey", "xml")
    return f.select("s_suppkey", "element", (c("value") + 0.0).alias("value"), F.size("members").alias("n_members"), "start", "end", "unit", "decimals")


def fact_period(start, end):
    """Key of a span by its middle, for spans of 3, 6, 9 or 12 months."""
    from seriesloom.functions.periods import label_of

    days = F.datediff(end, start)
    months, middle = F.bround(days / 30.44).cast("int"), F.date_add(start, F.floor(days / 2).cast("int"))
    return label_of(F.year(middle), months, F.quarter(middle))


@query("q_s15_contexts", "SELECT s_suppkey, unnest(['all', 'us']) AS context_id, unnest(['srt:ProductOrServiceAxis', 'srt:ProductOrServiceAxis,srt:StatementGeographicalAxis']) AS axes FROM supplier")
def s15(spark: SparkSession, d: str) -> DataFrame:
    f = markup.tagged_facts(instances(spark, d), "s_suppkey", "xml")
    return f.select("s_suppkey", "context_id", F.array_join(F.array_sort(F.map_keys("members")), ",").alias("axes")).distinct()


@query("q_c33_instance_candidates", "SELECT s_suppkey, '2023Q2' AS period, s_suppkey * 100000.0 / 1e6 AS value, 0.05 AS bound FROM supplier WHERE s_suppkey > 0")
def c33(spark: SparkSession, d: str) -> DataFrame:
    """Worldwide product facts of an amount above zero as candidates in millions, one per period and value."""
    from seriesloom.functions.numeric import declared_bound

    f = markup.tagged_facts(instances(spark, d), "s_suppkey", "xml")
    world = ~F.exists(F.map_keys("members"), lambda a: a.rlike("Geograph|Country"))
    ok = f.filter(world & c("unit").rlike("^[A-Z]{3}$") & (c("value") > 0))
    return ok.select("s_suppkey", fact_period(c("start"), c("end")).alias("period"), (c("value") / 1e6).alias("value"), declared_bound(c("decimals")).alias("bound")).dropDuplicates(["s_suppkey", "period", "value"])


@query("q_x35_citation", "SELECT s_suppkey, 'us-gaap:Revenues [2023-04-01..2023-06-30] ProductOrServiceAxis=AlphaMember = ' || format('{:,}', s_suppkey * 100000) AS citation FROM supplier")
def x35(spark: SparkSession, d: str) -> DataFrame:
    f = markup.tagged_facts(instances(spark, d), "s_suppkey", "xml").filter("context_id = 'all'")
    local = lambda s: F.element_at(F.split(s, ":"), -1)
    where = F.array_join(F.transform(F.array_sort(F.map_entries("members")), lambda e: F.concat(local(e["key"]), F.lit("="), local(e["value"]))), " ")
    amount = F.regexp_replace(F.regexp_replace(F.format_number("value", 4), "0+$", ""), r"\.$", "")
    return f.select("s_suppkey", F.concat("element", F.lit(" ["), c("start").cast("string"), F.lit(".."), c("end").cast("string"), F.lit("] "), where, F.lit(" = "), amount).alias("citation"))


def linkbases(spark: SparkSession, d: str) -> DataFrame:
    """One linkbase per supplier: net income from revenue less cost, revenue from product sales."""
    loc = lambda n: f'<l:loc xmlns:l="http://www.xbrl.org/2003/linkbase" x:label="{n}" x:href="e.xsd#co_{n}"/>'
    arc = lambda a, b, w: f'<l:calculationArc xmlns:l="http://www.xbrl.org/2003/linkbase" x:from="{a}" x:to="{b}" weight="{w}"/>'
    xml = '<r xmlns:x="http://www.w3.org/1999/xlink">' + "".join(map(loc, ("Net", "Revenue", "Cost", "Sales"))) + arc("Net", "Revenue", 1) + arc("Net", "Cost", -1) + arc("Revenue", "Sales", 1) + "</r>"
    return table(spark, d, "supplier").select("s_suppkey", F.lit(xml).alias("xml"))


@query("q_s17_calculation_arcs", "SELECT s_suppkey, unnest(['co:Net', 'co:Net', 'co:Revenue']) AS parent, unnest(['co:Revenue', 'co:Cost', 'co:Sales']) AS child, unnest([1, -1, 1]) AS weight FROM supplier")
def s17(spark: SparkSession, d: str) -> DataFrame:
    return markup.calculation_arcs(linkbases(spark, d), "s_suppkey", "xml")


@query("q_c30_calculation_roots", "SELECT s_suppkey, unnest(['co:Revenue', 'co:Cost', 'co:Sales']) AS element, 'co:Net' AS root, unnest([1, -1, 1]) AS sign FROM supplier")
def c30(spark: SparkSession, d: str) -> DataFrame:
    return markup.calculation_roots(s17(spark, d), "s_suppkey")


@query("q_c30_product_facts", "SELECT s_suppkey, s_suppkey * 100000.0::DOUBLE AS value FROM supplier")
def c30p(spark: SparkSession, d: str) -> DataFrame:
    """Per member, period and span the least qualified facts, hypothetical ones left out."""
    f = markup.tagged_facts(instances(spark, d), "s_suppkey", "xml").withColumn("member", F.try_element_at("members", F.lit("srt:ProductOrServiceAxis"))).withColumn("n", F.size("members"))
    marks = F.exists(F.map_entries("members"), lambda e: F.concat(e["key"], e["value"]).rlike("|".join(HYPOTHETICAL)))
    f = f.filter(c("member").isNotNull() & ~marks).withColumn("period", fact_period(c("start"), c("end")))
    least = f.groupBy("s_suppkey", "member", "period").agg(F.min("n").alias("n"))
    return f.join(least, ["s_suppkey", "member", "period", "n"]).select("s_suppkey", "value")


# --- bulk extracts -----------------------------------------------------------------------------

_BULK = (
    "subs AS (SELECT CAST(o_orderkey AS VARCHAR) AS adsh, o_custkey AS cik, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM orders), "
    "num AS (SELECT CAST(l_orderkey AS VARCHAR) AS adsh, l_extendedprice AS value, strftime(last_day(CAST(l_shipdate AS DATE)), '%Y%m%d') AS ddate, l_linenumber % 3 AS qtrs, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey END AS dimh FROM lineitem)"
)


def bulk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as submissions, parts as dimensions, line items as facts: all text, as an extract holds them."""
    o, p, li = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "lineitem")
    sub = o.select(c("o_orderkey").cast("string").alias("adsh"), c("o_custkey").cast("string").alias("cik"), F.lit(" n ").alias("name"), F.when(c("o_orderkey") % 3 == 0, "10-K").otherwise("10-Q").alias("form"), F.lit("").alias("period"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed"))
    dim = p.select(c("p_partkey").cast("string").alias("dimhash"), F.concat(F.lit("ProductOrService="), "p_brand", F.lit(";")).alias("segments"))
    num = li.select(c("l_orderkey").cast("string").alias("adsh"), F.lit("Revenues").alias("tag"), F.lit("us-gaap/2023").alias("version"), F.date_format(F.last_day(F.to_date("l_shipdate")), "yyyyMMdd").alias("ddate"), (c("l_linenumber") % 3).cast("string").alias("qtrs"), F.lit("USD").alias("uom"),
                    F.when(c("l_partkey") % 5 != 0, c("l_partkey").cast("string")).alias("dimh"), c("l_extendedprice").cast("string").alias("value"), F.lit("32767").alias("dcml"))
    return sub, dim, num


@query("q_s11_load_submissions", f"WITH {_BULK} SELECT adsh, cik, form FROM subs WHERE form = '10-K'")
def s11(spark: SparkSession, d: str) -> DataFrame:
    return files.submissions(bulk(spark, d)[0], forms=["10-K"]).select("adsh", "cik", "form")


@query("q_s12_load_dimensions", "SELECT CAST(p_partkey AS VARCHAR) AS dimhash, 'ProductOrService=' || p_brand || ';' AS segments FROM part")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return bulk(spark, d)[1]


@query("q_j03_facts_semi_dims", f"WITH {_BULK} SELECT count(*) AS facts, count(p_brand) AS with_member, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS total, count(CASE WHEN qtrs > 0 THEN 1 END) AS spans FROM num SEMI JOIN (SELECT adsh FROM subs WHERE form = '10-K') s ON num.adsh = s.adsh LEFT JOIN part ON dimh = p_partkey")
def j03(spark: SparkSession, d: str) -> DataFrame:
    sub, dim, num = bulk(spark, d)
    f = files.bulk_facts(num, files.submissions(sub, forms=["10-K"]), dim)
    return f.agg(F.count("*").alias("facts"), F.count(F.try_element_at("members", F.lit("ProductOrService"))).alias("with_member"), F.sum(c("value").cast("decimal(24,6)")).cast("double").alias("total"), F.count("start").alias("spans"))


@query("q_s13_iter_facts", f"WITH {_BULK} SELECT p_brand AS member, strptime(ddate, '%Y%m%d')::DATE AS \"end\", count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS value FROM num SEMI JOIN (SELECT adsh FROM subs WHERE form = '10-K') s ON num.adsh = s.adsh JOIN part ON dimh = p_partkey GROUP BY 1, 2")
def s13(spark: SparkSession, d: str) -> DataFrame:
    sub, dim, num = bulk(spark, d)
    f = files.bulk_facts(num, files.submissions(sub, forms=["10-K"]), dim).withColumn("member", F.try_element_at("members", F.lit("ProductOrService"))).filter("member is not null")
    return f.groupBy("member", "end").agg(F.count("*").alias("n"), F.sum(c("value").cast("decimal(24,6)")).cast("double").alias("value"))


@query("q_c34_notes_candidates", f"WITH {_BULK}, x AS (SELECT p_brand AS member, ddate, num.adsh, CAST(o_orderdate AS DATE) AS filed, value FROM num JOIN part ON dimh = p_partkey JOIN orders ON o_orderkey = CAST(num.adsh AS BIGINT) WHERE qtrs = 1) SELECT member, ddate, arg_min(value, (filed, adsh, value)) AS value FROM x GROUP BY 1, 2")
def c34(spark: SparkSession, d: str) -> DataFrame:
    """Single quarters per member, the earliest filing cited."""
    sub, dim, num = bulk(spark, d)
    f = files.bulk_facts(num, files.submissions(sub), dim).withColumn("member", F.try_element_at("members", F.lit("ProductOrService"))).filter("member is not null and start is not null")
    one = f.filter(F.months_between(F.date_add("end", 1), "start") == 3).join(sub.select("adsh", "filed"), "adsh")
    return one.groupBy("member", F.date_format("end", "yyyyMMdd").alias("ddate")).agg(F.min(F.struct("filed", "adsh", "value")).alias("b")).select("member", "ddate", c("b.value").alias("value"))


@query("q_s21_peak_estimates_csv", "SELECT DISTINCT row_id, CASE WHEN coalesce(trim(value_reported), '') = '' THEN 'missing_value' WHEN NOT regexp_matches(trim(value_reported), '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') THEN 'value_not_a_number' ELSE 'accepted' END AS outcome FROM revenue_export")
def s21(spark: SparkSession, d: str) -> DataFrame:
    """The export read as a file of cited estimates: what is accepted, and why the rest is not."""
    raw = table(spark, d, "revenue_export").select(
        c("row_id").cast("string").alias("product"), F.lit("consensus").alias("estimate_type"), c("value_reported").alias("value"), F.lit("USD").alias("currency"), F.lit("Worldwide").alias("geography"),
        F.lit("Product family").alias("revenue_scope"), F.date_format("exported_at", "yyyy-MM-dd").alias("as_of_date"), F.lit("https://example.test/report").alias("source_url"),
    )
    ok, bad = files.check_estimates(raw)
    return ok.select(c("product").cast("long").alias("row_id"), F.lit("accepted").alias("outcome")).unionByName(bad.select(c("product").cast("long").alias("row_id"), c("problem").alias("outcome"))).distinct()


@query("q_s23_product_list", "SELECT DISTINCT trim(drug_name) AS product FROM drug_jobs WHERE trim(drug_name) <> ''")
def s23(spark: SparkSession, d: str) -> DataFrame:
    return files.product_list(table(spark, d, "drug_jobs"), "drug_name")


@query("q_s25_drugs_csv", "SELECT DISTINCT trim(drug_name) AS drug_name, nullif(trim(ticker), '') AS ticker FROM drug_jobs WHERE drug_name IS NOT NULL")
def s25(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "drug_jobs").select(c("drug_name").alias("Product"), "ticker", "manufacturer", "indication", "generic_name")
    return files.read_drugs(raw).select("drug_name", "ticker").distinct()


@query("q_s02_filings_covering", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def s02(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter((c("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("q_s03_earnings_exhibits", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY manufacturer ORDER BY created_at DESC, id) AS rn FROM (SELECT DISTINCT * FROM drug_jobs) WHERE list_contains(quality_flags, 'mixed_currency')) WHERE rn <= 3")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """The three newest filings of each filer that state an item; jobs and their flags stand for filings and items, and the budget is the feature."""
    o = table(spark, d, "drug_jobs").distinct().withColumn("items", F.array_join("quality_flags", ", "))
    w = Window.partitionBy("manufacturer").orderBy(F.desc("created_at"), "id")
    return o.filter(X.states_item(c("items"), "mixed_currency")).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("id")


@query("q_s07_search_queries", "SELECT p_partkey, unnest([0, 1, 2]) AS place, unnest(['brand', 'brand', 'generic']) AS scope FROM part")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """Queries in their order: brand paths before generic ones."""
    q = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(p).alias("path")) for s, p in (("brand", "openfda.brand_name.exact"), ("brand", "products.brand_name"), ("generic", "openfda.generic_name"))])
    return table(spark, d, "part").select("p_partkey", F.posexplode(q).alias("place", "q")).select("p_partkey", "place", c("q.scope").alias("scope"))
