"""Documents to rows: HTML tables and tagged (XML) instances, one document to many rows per Arrow batch."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

SPAN_LIMITS = {"colspan": 1000, "rowspan": 65534}  # the HTML standard's own


class _Tables(HTMLParser):
    """Collects (table, row, column, text, is_origin); spans are filled with cells that have no text."""

    def __init__(self, row_limit: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.row_limit = row_limit
        self.cells: list[tuple[int, int, int, str | None, bool]] = []
        self.table = -1
        self.stack: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.table += 1
            self.stack.append({"no": self.table, "row": -1, "taken": set(), "col": 0})
        elif self.stack and tag == "tr":
            self._close()
            self.stack[-1]["row"] += 1
            self.stack[-1]["col"] = 0
        elif self.stack and tag in ("td", "th"):
            self._close()
            at = dict(attrs)
            size = lambda k: min(max(1, int(at[k])), SPAN_LIMITS[k]) if re.fullmatch("[0-9]+", at.get(k) or "") else 1
            self.open = {"across": size("colspan"), "down": size("rowspan"), "text": []}

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.stack:
            self.stack.pop()

    def _close(self) -> None:
        cell, self.open = self.open, None
        if cell is None or not self.stack:
            return
        t = self.stack[-1]
        r = max(t["row"], 0)
        if self.row_limit is not None and r >= self.row_limit:
            return
        while (r, t["col"]) in t["taken"]:
            t["col"] += 1
        text = " ".join(" ".join(cell["text"]).split())
        for i in range(cell["down"]):
            for j in range(cell["across"]):
                t["taken"].add((r + i, t["col"] + j))
                origin = i == j == 0
                self.cells.append((t["no"], r + i, t["col"] + j, text if origin else None, origin))
        t["col"] += cell["across"]


def html_cells(documents: DataFrame, key: str, html: str, row_limit: int | None = None) -> DataFrame:
    """(key, table_no, row, col, text, is_origin) of every table of every document.

    All rows of a table are read unless ``row_limit`` is given. Null and
    table-less documents yield nothing; malformed markup is read as far as it goes.
    """
    dtype = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["h"]):
                if text:
                    p = _Tables(row_limit)
                    p.feed(text)
                    p.close()
                    p._close()
                    out += [(k, *c) for c in p.cells]
            yield pd.DataFrame(out, columns=[key, "table_no", "row", "col", "text", "is_origin"])

    picked = documents.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return picked.mapInPandas(run, f"{key} {dtype}, table_no int, row int, col int, text string, is_origin boolean")


def covering(cells: DataFrame, key: str) -> DataFrame:
    """Each cell with the nearest text at or left of it in its row."""
    w = Window.partitionBy(key, "table_no", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("covering", F.last("text", ignorenulls=True).over(w))


def relevance(cells: DataFrame, key: str) -> DataFrame:
    """Score of each table: rows with figures, twice for money words, twice for period words; fewer than two figure rows score 0."""
    figure = F.col("text").rlike(r"^\(?[$€£]?\d[\d,]*(?:\.\d+)?\)?%?$")
    row = cells.groupBy(key, "table_no", "row").agg(F.max(F.coalesce(figure, F.lit(False)).cast("int")).alias("f"), F.concat_ws(" ", F.collect_list("text")).alias("t"))
    money, period = F.col("t").rlike(r"(?i)[$€£]|\b(million|thousand|billion|revenue|sales)"), F.col("t").rlike(r"(?i)\b(19|20)\d{2}\b|quarter|months ended|\bQ[1-4]\b")
    g = row.groupBy(key, "table_no").agg(F.sum("f").alias("figures"), F.max(money.cast("int")).alias("m"), F.max(period.cast("int")).alias("p"))
    return g.select(key, "table_no", F.when(F.col("figures") < 2, 0).otherwise(F.col("figures") + 2 * F.col("m") + 2 * F.col("p")).alias("score"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _facts(raw: str) -> list[tuple]:
    prefixes = {uri: p for p, uri in re.findall(r'xmlns:([\w.-]+)="([^"]+)"', raw)}
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return []
    contexts, units = {}, {}
    for node in root.iter():
        kind = _local(node.tag)
        if kind == "context":
            members, dates = {}, {}
            for child in node.iter():
                name = _local(child.tag)
                if name == "explicitMember" and child.get("dimension") and child.text:
                    members[child.get("dimension").strip()] = child.text.strip()
                elif name in ("startDate", "endDate"):
                    dates[name] = (child.text or "").strip()
            contexts[node.get("id")] = (members, dates.get("startDate"), dates.get("endDate"))
        elif kind == "unit":
            units[node.get("id")] = "/".join((m.text or "").strip().split(":")[-1] for m in node.iter() if _local(m.tag) == "measure" and m.text)
    out = []
    for node in root.iter():
        ref, text = node.get("contextRef"), (node.text or "").strip().replace(",", "")
        if ref and re.fullmatch(r"-?\d+(?:\.\d+)?", text):
            members, start, end = contexts.get(ref, ({}, None, None))
            uri = node.tag[1:].split("}")[0] if node.tag.startswith("{") else ""
            name = f"{prefixes[uri]}:{_local(node.tag)}" if uri in prefixes else _local(node.tag)
            out.append((name, float(text) * (-1 if node.get("sign") == "-" else 1), members, start, end, units.get(node.get("unitRef")), node.get("decimals"), ref))
    return out


FACT_SCHEMA = "element string, value double, members map<string,string>, start string, end string, unit string, decimals string, context_id string"


def tagged_facts(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """One row per numeric fact of every instance, with its context resolved; unreadable instances yield nothing."""
    dtype = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *f) for k, raw in zip(pdf["k"], pdf["x"]) if raw for f in _facts(raw)]
            yield pd.DataFrame(out, columns=[key, "element", "value", "members", "start", "end", "unit", "decimals", "context_id"])

    rows = documents.select(F.col(key).alias("k"), F.col(xml).alias("x")).mapInPandas(run, f"{key} {dtype}, {FACT_SCHEMA}")
    return rows.withColumn("start", F.try_to_date("start")).withColumn("end", F.try_to_date("end"))


def calculation_arcs(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, parent, child, weight) of every calculation linkbase."""
    dtype = dict(documents.dtypes)[key]
    link = "{http://www.w3.org/1999/xlink}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, raw in zip(pdf["k"], pdf["x"]):
                try:
                    root = ET.fromstring(raw or "")
                except ET.ParseError:
                    continue
                names = {n.get(link + "label"): n.get(link + "href", "").partition("#")[2].replace("_", ":", 1) for n in root.iter() if _local(n.tag) == "loc"}
                for n in root.iter():
                    if _local(n.tag) == "calculationArc" and names.get(n.get(link + "from")) and names.get(n.get(link + "to")):
                        try:
                            weight = 1 if float(n.get("weight", "1")) >= 0 else -1
                        except ValueError:
                            weight = 1
                        out.append((k, names[n.get(link + "from")], names[n.get(link + "to")], weight))
            yield pd.DataFrame(out, columns=[key, "parent", "child", "weight"])

    return documents.select(F.col(key).alias("k"), F.col(xml).alias("x")).mapInPandas(run, f"{key} {dtype}, parent string, child string, weight int")


def calculation_roots(arcs: DataFrame, key: str, depth: int | None = None) -> DataFrame:
    """(key, element, root, sign): the tops each element rolls up to and whether a negative arc lies on the way.

    The climb goes on until no element reaches anything new, so a cycle ends
    with it; a stated ``depth`` bounds it. An element whose every way ends in
    a cycle has no top: its root is null.
    """
    up = cut_lineage(arcs.select(key, F.col("child").alias("at"), F.col("parent").alias("next"), "weight").distinct())
    new = reached = up.select(key, F.col("at").alias("element"), "at").distinct().withColumn("sign", F.lit(1))
    rounds = 0
    while depth is None or rounds < depth:
        step = new.join(up, [key, "at"]).select(key, "element", F.col("next").alias("at"), F.least(F.col("sign"), F.coalesce("weight", F.lit(1))).alias("sign")).distinct()
        new = cut_lineage(step.join(reached, [key, "element", "at", "sign"], "left_anti"))
        if new.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(new))
        rounds += 1
    tops = reached.join(up.select(key, "at").distinct(), [key, "at"], "left_anti").groupBy(key, "element", F.col("at").alias("root")).agg(F.min("sign").alias("sign"))
    topless = reached.join(tops, [key, "element"], "left_anti").groupBy(key, "element").agg(F.min("sign").alias("sign"))
    return tops.unionByName(topless.select(key, "element", F.lit(None).cast("string").alias("root"), "sign"))
