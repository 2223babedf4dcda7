"""Long exact spans shared between records (problem 10).

Method: level-wise doubling. Windows of half the asked length, picked by
winnowing so that every shared span holds one at the same place in all its
records, are counted; only those that stand in more than one record are
extended to twice the length, at every placement around them; of those, only
windows that again stand in more than one record survive, and so on.

Placements are tested in blocks of up to BLOCK neighbouring windows. All windows
of a block hold its core, and the block's extent holds them all: a core of one
record alone ends the block, a core around which every record has the same
extent settles it, and only what lies between is taken window by window, once
per distinct extent. So the rows that travel grow with the places where records
begin to differ rather than with the characters they share, and every count is
a combined aggregation, whatever share of the records one window holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.chars import code_points, mix, prefix_hashes, sliding_last_min, window_hashes
from seriesloom.session import write_once

MIN_SPAN = 320
BLOCK = 32  # neighbouring windows tested together
PAIR_BLOCK = 2000  # records of a class that are paired in one task; larger classes are split into pairs of blocks
_U = np.uint64
_ANCHORS, _ANCHORS_ARROW = "h long, doc long, ver long, pos int", pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("ver", pa.int64()), ("pos", pa.int32())])
_BLOCKS = "core long, extent long, doc long, ver long, at int, lo int, hi int"
_BLOCKS_ARROW = pa.schema([("core", pa.int64()), ("extent", pa.int64()), ("doc", pa.int64()), ("ver", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_WINDOWS = "w long, extent long, d0 long, d1 long, off int"
_WINDOWS_ARROW = pa.schema([("w", pa.int64()), ("extent", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("off", pa.int32())])


def texts_of(documents: DataFrame, least: int) -> DataFrame:
    """(doc, ver, text) of texts of ``least`` characters or more; ``ver`` tells the texts of one ``doc_id`` apart.

    Rows without an id are no records.
    """
    return documents.filter(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("ver"), "text")


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(h, doc, ver, pos): the windows of ``length`` characters that winnowing picks.

    Of each ``length + 1`` consecutive windows the one with the least hash is
    kept, so a span of twice the length, wherever it stands, keeps the same one.
    """
    width = length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, codes, bounds in code_points(batch.column(2)):
                if len(codes) < length + width - 1:
                    continue
                h = window_hashes(prefix_hashes(codes), np.arange(len(codes) - length + 1), length)
                least = sliding_last_min(h, width)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
                inside = bounds[doc + 1] - np.arange(len(least)) >= length + width - 1
                at = least[inside]
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                if len(at):
                    owner = np.searchsorted(bounds, at, "right") - 1
                    columns = [h[at].view(np.int64), ids[first + owner], vers[first + owner], (at - bounds[owner]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_ANCHORS_ARROW)

    return texts.select("doc", "ver", "text").mapInArrow(run, _ANCHORS)


def candidates(texts: DataFrame, length: int) -> DataFrame:
    """(doc, ver, text, held): each text that holds windows of ``length`` standing in more than one record, with their places.

    The anchors are written once and read twice: to be counted, combined before
    the shuffle, and to be met by the counts in a join that AQE may split, so a
    window of a third of all records gathers nowhere. The texts of candidates,
    each once however often its row is repeated, are written for the passes to
    come.
    """
    first = write_once(anchors(texts, length))
    groups = first.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("h")
    held = first.join(groups, "h").groupBy("doc", "ver").agg(F.collect_set("pos").alias("held"))
    joined = texts.join(held, ["doc", "ver"])
    return write_once(joined.groupBy("doc", "ver").agg(F.max("text").alias("text"), F.first("held").alias("held")))


def blocks(found: DataFrame, length: int) -> DataFrame:
    """(core, extent, doc, ver, at, lo, hi): the blocks of windows of ``2 * length`` whose own anchor is held.

    A window's anchor is the least of the windows of ``length`` inside it, so it
    depends on the window's characters alone. A block is the run of windows of
    one anchor whose distances to it share a multiple of BLOCK; ``core`` is the
    hash of what they all hold and ``extent`` that of what they span together,
    ``at`` the anchor's place and ``lo``, ``hi`` the first and last window's
    place from there.
    """
    span, width = 2 * length, length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = batch.column(3)
            begins, places = np.asarray(rows.offsets), rows.values.to_numpy(zero_copy_only=False)
            for first, codes, bounds in code_points(batch.column(2)):
                if len(codes) < span:
                    continue
                prefix = prefix_hashes(codes)
                least = sliding_last_min(window_hashes(prefix, np.arange(len(codes) - length + 1), length), width)
                held = np.zeros(len(codes), bool)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(begins[first : first + len(bounds)]))
                held[bounds[owner] + places[begins[first] : begins[first + len(bounds) - 1]]] = True
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
                p = np.flatnonzero((bounds[doc + 1] - np.arange(len(least)) >= span) & held[least])
                if not len(p):
                    continue
                a = least[p]
                j = (a - p) // BLOCK
                new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (j[1:] != j[:-1])))
                lo, hi, a, j = p[new], p[np.append(new[1:], len(p)) - 1], a[new], j[new]
                far = np.minimum(j * BLOCK + BLOCK - 1, length)  # the core is that of the whole block, were it all there
                core = mix(_hash(prefix, a - j * BLOCK, a - far + span) + j.astype(_U))
                extent = mix(_hash(prefix, lo, hi + span) + (a - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + (a - hi).astype(_U))
                k = doc[lo]
                columns = [core.view(np.int64), extent.view(np.int64), ids[first + k], vers[first + k]] + [x.astype(np.int32) for x in (a - bounds[k], lo - a, hi - a)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_BLOCKS_ARROW)

    return found.select("doc", "ver", "text", "held").mapInArrow(run, _BLOCKS)


def _hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of any lengths; equal spans have equal hashes wherever they lie."""
    return window_hashes(prefix, begin, end - begin)


def singled(found: DataFrame, open_blocks: DataFrame, length: int) -> DataFrame:
    """(w, extent, d0, d1, off): the windows of each extent in ``open_blocks``, read off one text that holds it."""
    span = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            begins, flat = np.asarray(rows.offsets), rows.values
            extent, d0, d1, at, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            for first, codes, bounds in code_points(batch.column(0)):
                inside = slice(begins[first], begins[first + len(bounds) - 1])
                if inside.start == inside.stop:
                    continue
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(begins[first : first + len(bounds)]))
                sizes = (hi[inside] - lo[inside] + 1).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                off = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[inside][row]
                w = window_hashes(prefix_hashes(codes), bounds[owner][row] + at[inside][row] + off, span)
                columns = [w.view(np.int64), extent[inside][row], d0[inside][row], d1[inside][row], off.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_WINDOWS_ARROW)

    per = open_blocks.groupBy(F.col("rep.doc").alias("doc"), F.col("rep.ver").alias("ver")).agg(F.collect_list(F.struct("extent", "d0", "d1", "rep.at", "rep.lo", "rep.hi")).alias("rows"))
    return found.select("doc", "ver", "text").join(per, ["doc", "ver"]).select("text", "rows").mapInArrow(run, _WINDOWS)


@dataclass(frozen=True)
class Shared:
    """Windows of ``span`` characters that stand in two or more records.

    ``texts``: (doc, ver, text) of all records that may hold some; ``places``:
    where each extent of a block stands; ``settled``: the extents all of whose
    windows are shared; ``single``: the shared windows of the others.
    """

    span: int
    texts: DataFrame
    places: DataFrame
    settled: DataFrame
    single: DataFrame


def shared_level(texts: DataFrame, span: int) -> Shared:
    """The windows of ``span`` characters that stand in two or more records of ``texts``; see ``shared_windows``."""
    length = span // 2
    found = candidates(texts, length)
    places = write_once(blocks(found, length))
    extents = places.groupBy("core", "extent").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min(F.struct("doc", "ver", "at", "lo", "hi")).alias("rep"))
    cores = extents.groupBy("core").agg(F.count("*").alias("n"), F.min("d0").alias("c0"), F.max("d1").alias("c1")).filter("c0 < c1").select("core", "n")
    live = write_once(extents.join(cores, "core"))
    windows = write_once(singled(found, live.filter("n > 1"), length))
    repeated = windows.groupBy("w").agg(F.min("d0").alias("w0"), F.max("d1").alias("w1")).filter("w0 < w1").select("w")
    return Shared(span, found.select("doc", "ver", "text"), places, live.filter("n = 1").select("extent"), windows.join(repeated, "w").select("w", "extent", "off"))


def shared_windows(documents: DataFrame, min_span: int = MIN_SPAN) -> Shared:
    """The windows of ``min_span`` characters that stand in two or more records.

    Rows of one ``doc_id`` are one record, whatever texts they hold; each of its
    different texts is searched. Null, empty and shorter texts have none;
    repetition within one record alone is none. Other columns are not read.
    """
    return shared_level(texts_of(documents, min_span), min_span)


def sharing_classes(shared: Shared) -> DataFrame:
    """(class, n, doc): one class per distinct set of records that share some window, and the set's size.

    An extent settled as a whole is shared by the records that hold it; a single
    window by those that hold any extent it lies in.
    """
    holds = shared.places.select("extent", "doc").distinct()
    of_window = shared.single.groupBy("w").agg(F.bit_xor(F.xxhash64("extent")).alias("g"), F.count("*").alias("m"))
    grouped = shared.single.join(of_window, "w").select(F.xxhash64("g", "m").alias("g"), "extent").distinct()
    grouped = grouped.unionByName(shared.settled.select(F.col("extent").alias("g"), "extent").distinct())
    members = write_once(grouped.join(holds, "extent").select("g", "doc").distinct())
    signs = members.groupBy("g").agg(F.bit_xor(F.xxhash64("doc")).alias("class"), F.count("*").alias("n"))
    return members.join(signs, "g").select("class", "n", "doc").distinct()


def sharing_pairs(shared: Shared) -> DataFrame:
    """Each pair of records that share a window, once.

    The records of a class are dealt to blocks of about PAIR_BLOCK, and each two
    blocks meet under a key of their own, so no class is paired in one task.
    """
    c = sharing_classes(shared)
    b = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    c = c.select("class", "doc", b.alias("b"), F.pmod(F.xxhash64("doc", F.lit(10)), b).cast("int").alias("i"))
    left = c.select("class", F.col("doc").alias("x"), F.col("i"), F.explode(F.sequence(F.col("i"), F.col("b") - 1)).alias("j"))
    right = c.select("class", F.col("doc").alias("y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    pairs = left.join(right, ["class", "i", "j"]).filter("x < y or (i < j and x > y)")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def stretches(shared: Shared) -> DataFrame:
    """(doc, ver, begin, end): maximal runs of characters that stand elsewhere too; adjoining ones are merged."""
    whole = shared.settled.join(shared.places, "extent").select("doc", "ver", (F.col("at") + F.col("lo")).alias("begin"), (F.col("at") + F.col("hi") + shared.span).alias("end"))
    # the windows of an extent are at most BLOCK: runs of neighbours among them are one piece
    w = Window.partitionBy("extent").orderBy("off")
    runs = shared.single.select("extent", "off", (F.col("off") - F.row_number().over(w)).alias("run")).groupBy("extent", "run").agg(F.min("off").alias("o0"), F.max("off").alias("o1"))
    parts = runs.join(shared.places, "extent").select("doc", "ver", (F.col("at") + F.col("o0")).alias("begin"), (F.col("at") + F.col("o1") + shared.span).alias("end"))
    pieces = whole.unionByName(parts).groupBy("doc", "ver", "begin").agg(F.max("end").alias("end"))
    v = Window.partitionBy("doc", "ver").orderBy("begin")
    reach = F.max("end").over(v.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(v))
    return marked.groupBy("doc", "ver", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def levels(documents: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc, span): each record's longest level of doubling with a repeated window; ends when none survive.

    Only texts that have a repeated window at one level, and room for the next,
    are taken to it.
    """
    texts, span, out = texts_of(documents, min_span), min_span, None
    while True:
        now = shared_level(texts, span)
        live = now.settled.unionByName(now.single.select("extent")).distinct()
        holders = write_once(now.places.join(live, "extent", "left_semi").select("doc", "ver").distinct())
        here = holders.select(F.lit(span).alias("span"), "doc")
        out = here if out is None else out.unionByName(here)
        if holders.isEmpty():
            return out.groupBy("doc").agg(F.max("span").alias("span"))
        span *= 2
        texts = now.texts.join(holders, ["doc", "ver"], "left_semi").filter(F.length("text") >= span)
