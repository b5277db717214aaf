"""Substring deduplication by content-defined chunks: a gear rolling hash cuts texts where their bytes say so, so an insertion moves only the cuts around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import release, settle
from tallyfold.llm.textbytes import U, flat, lean, mix, pieces, seeded

WINDOW = 32  # bytes that a cut depends on


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash (h << 1) + G[byte], of which 32 bits hold the last 32 bytes; doubled up instead of rolled."""
    h = (seeded(256, 3) >> U(32)).astype(np.uint32)[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(data: np.ndarray, bits: int, least: int, most: int) -> np.ndarray:
    """Ends of the chunks of one text: after a byte whose hash has `bits` leading zeros, from `least` bytes on; after `most` bytes at the latest. Never inside a character."""
    if not len(data):
        return np.zeros(0, np.int64)
    inside = np.zeros(len(data), bool)
    inside[:-1] = (data[1:] & 0xC0) == 0x80
    places = np.flatnonzero(((gear(data) >> np.uint32(32 - bits)) == 0) & ~inside) + 1
    out, last, n = [], 0, len(data)
    for p in [*places.tolist(), n]:
        while p - last > most:
            end = last + most
            while end > last + 1 and inside[end - 1]:
                end -= 1
            out.append(end)
            last = end
        if p - last >= least or p == n and p > last:
            out.append(p)
            last = p
    return np.array(out, np.int64)


def _chunks(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = U(0x9FB21C651E98DF25)
        letters = [seeded(256, 5), seeded(256, 6)]
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 19):
                data, at = flat(batch.column("text"))
                power = np.full(most + 1, base, U)
                power[0] = 1
                power = np.cumprod(power, dtype=U)
                ends = [cuts(data[a:b], bits, least, most) for a, b in zip(at[:-1], at[1:], strict=True)]
                row = np.repeat(np.arange(len(ends)), [len(x) for x in ends])
                if not len(row):
                    continue
                stop = np.concatenate([x + a for x, a in zip(ends, at[:-1], strict=True)])
                start = np.r_[0, stop[:-1]]
                size = stop - start
                offset = np.arange(len(data)) - np.repeat(start, size)
                digest = [mix(np.add.reduceat(x[data] * power[offset], start) + size.astype(U)) for x in letters]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array((start - at[row]).astype(np.int32)), pa.array(size.astype(np.int32)), *(pa.array(d.view(np.int64)) for d in digest)],
                    names=["doc_id", "start", "size", "d1", "d2"],
                )

    return lean(run)


def repeated_chunks(docs: DataFrame, bits: int = 4, least: int = 32, most: int = 256) -> DataFrame:
    """(doc_id, start, size, first_doc, first_start, copies) of each chunk whose bytes stand at another place too, in the same document or another, first places included.

    Chunks have `least` to `most` bytes; the last of a text may be shorter. They are compared by two 64-bit digests. start counts
    bytes of the UTF-8 text.
    """
    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_chunks(bits, least, most), "doc_id bigint, start int, size int, d1 bigint, d2 bigint")
    several = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.max(F.struct("doc_id", "start")).alias("last"), F.count("*").alias("copies")).where("at < last")
    several = settle(several)
    release(docs.sparkSession)
    return found.join(several, ["d1", "d2"]).select("doc_id", "start", "size", F.col("at.doc_id").alias("first_doc"), F.col("at.start").alias("first_start"), "copies")


def substring_dedup(docs: DataFrame, bits: int = 4, least: int = 32, most: int = 256, shortest: int = 96) -> DataFrame:
    """(doc_id, n_spans, repeated_bytes, removed_bytes, spans, sources) of each document that holds a repeated passage.

    Neighbouring repeated chunks form a span; spans of fewer than `shortest` bytes count as chance and don't matter. spans
    has (start, size, first) in bytes, in order, first telling whether it is the first place of what it holds: a
    deduplicated text keeps first spans and loses the others. sources holds the documents in which the first chunks of
    lost spans stand. Null and empty texts hold nothing; repeated rows count as one text; a null doc_id takes no part; an
    empty table gives an empty result; other columns are ignored. Chunks repeated in one document or several
    are grouped by document: very long texts are cut whole, and a document's chunks are bounded by its length.
    """
    chunks = repeated_chunks(docs, bits, least, most).distinct()
    first = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    each = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size", first.alias("first"), "first_doc"))).alias("chunks"))
    empty = F.array().cast("array<struct<start:int,size:int,first:boolean>>")

    def add(spans, c):  # a chunk goes on with the span before it, or begins one
        last = F.element_at(spans, -1)
        joins = (F.size(spans) > 0) & (last.start + last.size == c.start) & (last["first"] == c["first"])
        longer = F.struct(last.start.alias("start"), (last.size + c.size).alias("size"), last["first"].alias("first"))
        return F.when(joins, F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(spans, F.array(F.struct(c.start.alias("start"), c.size.alias("size"), c["first"].alias("first")))))

    spans = F.filter(F.aggregate("chunks", empty, add), lambda s: s.size >= shortest)
    out = each.select("doc_id", "chunks", spans.alias("spans")).where(F.size("spans") > 0)
    lost = F.filter("spans", lambda s: ~s["first"])
    within = F.filter("chunks", lambda c: ~c["first"] & F.exists("spans", lambda s: ~s["first"] & (c.start >= s.start) & (c.start < s.start + s.size)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, s: n + s.size)
    return out.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), total("spans").alias("repeated_bytes"), total(lost).alias("removed_bytes"), "spans", F.array_sort(F.array_distinct(F.transform(within, lambda c: c.first_doc))).alias("sources"))
