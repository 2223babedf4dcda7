"""Evaluation texts leaking into training text (problem 9).

Method: winnowing. Of each window of consecutive word k-grams the one with the
least hash is kept; fingerprints of items and documents are joined and each hit
is extended over the words around it. With k = 8 and windows of 5 every shared
run of 12 words keeps the same k-gram on both sides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.chars import code_points, mix, powers, prefix_hashes, sliding_last_min, window_hashes

RUN, K = 12, 8
BROADCAST_CHARS = 50_000_000  # items of up to this many characters are broadcast, more are joined by shuffle
_SIDES = [f"{side}{n}" for side in "lr" for n in range(1, RUN - K + 1)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter or digit, and its lower case (one code point for one)."""
    size = 0x32000
    word, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for c in range(size):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind == "Nd":
            word[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return word, lower


def words(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of the texts in words) of chunked texts."""
    word, lower = _tables()
    known = np.minimum(codes, len(word) - 1)
    is_word = word[known] & (codes < len(word))
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    before = np.append(False, is_word[:-1])
    begins = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(np.append(is_word, False) & (~np.append(is_word[1:], [False, False]) | np.append(edge[1:], True)))
    prefix = prefix_hashes(np.where(codes < len(word), lower[known], codes))
    _, down = powers(len(prefix))
    h = mix((prefix[ends + 1] - prefix[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return h, np.searchsorted(begins, bounds)


def fingerprints(texts: DataFrame, key: str, run: int = RUN, k: int = K) -> DataFrame:
    """(key, h, l1.., r1..): the kept k-grams with short hashes of the words to their left and right.

    A missing neighbour (the text's end) is null and equals nothing. Null and
    empty texts and those of fewer than ``run`` words have no fingerprint.
    """
    reach, width = run - k, run - k + 1
    fields = [T.StructField(key, T.LongType()), T.StructField("h", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in _SIDES]
    schema = pa.schema([(key, pa.int64()), ("h", pa.int64())] + [(c, pa.int32()) for c in _SIDES])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, codes, bounds in code_points(batch.column(1)):
                h, wb = words(codes, bounds)
                if len(h) < run:
                    continue
                grams = window_hashes(prefix_hashes(h), np.arange(len(h) - k + 1), k)
                least = sliding_last_min(grams, width)
                doc = np.repeat(np.arange(len(wb) - 1), np.diff(wb))
                inside = wb[doc[: len(least)] + 1] - np.arange(len(least)) >= run
                at = least[inside]
                if not len(at):
                    continue
                at = at[np.append(True, at[1:] != at[:-1])]
                owner, short = doc[at], (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [pa.array(ids[first + owner]), pa.array(grams[at].view(np.int64))]
                for side, step in (("l", -1), ("r", 1)):
                    for n in range(1, reach + 1):
                        p = at - n if step < 0 else at + k - 1 + n
                        ok = (p >= wb[owner]) & (p < wb[owner + 1])
                        columns.append(pa.array(short[np.where(ok, p, 0)], mask=~ok))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts.select(F.col(key).cast("long").alias(key), "text").filter("text is not null").mapInArrow(run_, T.StructType(fields))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = K) -> DataFrame:
    """(doc_id, item_id) where the document holds ``run`` or more consecutive words of the item.

    A word is a run of letters or digits; case, punctuation and spacing do not
    matter. Each pair comes once, however often it hits. Items are broadcast
    only behind a check of their size; beyond it the join shuffles by hash.
    """
    mine = fingerprints(items, "item_id", run, k).select("item_id", "h", *[F.col(c).alias(f"i{c}") for c in _SIDES]).distinct()
    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    theirs = fingerprints(documents, "doc_id", run, k)
    hits = theirs.join(F.broadcast(mine) if size <= BROADCAST_CHARS else mine, "h")

    def reach(side: str) -> Column:
        """How many neighbours on that side agree, nearest first."""
        out = F.lit(0)
        for n in range(run - k, 0, -1):
            out = F.when(F.coalesce(F.col(f"{side}{n}") == F.col(f"i{side}{n}"), F.lit(False)), 1 + out).otherwise(0)
        return out

    return hits.filter(reach("l") + reach("r") >= run - k).select("doc_id", "item_id").distinct()
