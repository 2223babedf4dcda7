"""Filling fixed-capacity containers with items (problem 8).

Method: first-fit decreasing with a tournament tree of the room left in each
container, run independently in randomised groups of documents. Texts larger
than a container are cut into full pieces, which need no packing, and a rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 20_000  # documents per group: thousands of containers, so the last one of a group weighs little
# letters, numbers and underscore are word characters; other visible characters form runs of their own
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"
TOKEN = rf"[{_WORD}]+|[^{_WORD}{_SPACE}]+"


def token_count(text: Column) -> Column:
    """Runs of word characters or of other non-space characters."""
    return F.regexp_count(text, F.lit(TOKEN))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (sizes at most ``capacity``): largest first, into the first that has room.

    The tree holds the most room under each node; a descent to the left finds
    the first container that fits in the logarithm of their number.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = np.zeros(len(sizes), np.int64)
    for item in order.tolist():
        need, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        out[item] = node - leaves
        tree[node] -= need
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            top = a if a > b else b
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The container of every text, or of each piece of a text larger than a container.

    Returns ``doc_id``, ``piece`` (from 1), ``pieces``, ``n_tokens``,
    ``first_token`` (from 0) and ``container``. Texts without a token take no
    room and lie in their group's first container; null texts are no texts and
    have no row. Repeated rows of a ``doc_id`` are one document. Groups are drawn
    by a hash of the id, so their number grows with the table and none is hot.
    """
    sized = documents.select("doc_id", token_count(F.col("text")).alias("n")).filter("n is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    groups = max(1, round(documents.count() / group_items))
    sized = sized.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(groups)).cast("int"))
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    sized = sized.withColumn("pieces", pieces).withColumn("rest", (F.col("n") - (F.col("pieces") - 1) * capacity).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        pdf["bin"] = first_fit_decreasing(pdf["rest"].to_numpy(), capacity)
        return pdf

    packed = sized.groupBy("g").applyInPandas(pack, "doc_id long, n int, g int, pieces int, rest int, bin long")
    last = packed.select("doc_id", F.col("pieces").alias("piece"), "pieces", F.col("rest").alias("n_tokens"), F.format_string("g%d-%d", "g", "bin").alias("container"))
    full = sized.filter("pieces > 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pieces") - 1)).alias("piece"), "pieces")
    full = full.select("doc_id", "piece", "pieces", F.lit(capacity).alias("n_tokens"), F.format_string("d%d-%d", "doc_id", "piece").alias("container"))
    both = last.unionByName(full)
    return both.select("doc_id", "piece", "pieces", "n_tokens", ((F.col("piece") - 1) * capacity).alias("first_token"), "container")
