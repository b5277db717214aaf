"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti, Kaushik 2006).

Sets of similar size share an instance of the scheme. In it the feature domain is cut into n1 partitions, each of them
into n2 parts; a signature is the sum of the scrambled features that lie in one choice of n2 - k2 parts of one partition.
Two sets that differ in at most k features differ in at most k2 of them in some partition, so at most k2 of its parts
differ and some choice of the others agrees: similar sets share a signature for certain.

Equal sets are one set, known by a 64-bit name: a task signs it once, and one of the documents that have it is compared.

Many sets of one group would make a pair of each two. So of the sets that share a signature each is first tied to that of
the least document, one pair a set, and these pairs are verified. Where sets of different groups still meet under a signature,
each is then tied to one of the least group. Only signatures under which groups meet even so give all pairs between groups.
So components are found without a look at the pairs inside a group.

The links themselves all lie inside components. They are counted there, over all pairs of different sets of a component, in
blocks of sets; equal sets count by how many rows have them. Of a component of two sets the one link is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.components import components
from tallyfold.llm.scratch import drop, partitions, release, settle
from tallyfold.llm.textbytes import U, Words, lean, mix, pieces, shingles

SKETCH = 16  # words of 64 bits
PAIRS = 256  # pairs of one document that a task verifies
PART = 512, 1 << 20  # sets and features of a block whose links a task counts
BLOCK = 1024  # sets of one signature that a task compares with the others
BITS = 1 << 27  # of the largest bitmap that goes to all tasks: 16 MB


@lru_cache(maxsize=None)
def bands(percent: int, top: int = 1 << 31) -> tuple[list[int], list[int]]:
    """First and last sizes of the bands. A set can only be similar to sets of its own band and the bands beside it."""
    first, last = [1], [100 // percent]
    while last[-1] < top:
        first.append(last[-1] + 1)
        last.append(max(first[-1], first[-1] * 100 // percent))
    return first, last


def apart(total: int, percent: int) -> int:
    """Features by which two sets with `total` elements together may differ at the most."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=None)
def scheme(k: int) -> tuple[int, int, np.ndarray]:
    """n2, k2 and the choices of parts for sets that differ in up to k features. Any values are right; these keep 5 to 7 features a signature, so that
    long texts that only share a passage seldom meet."""
    k2, n2 = (k, k + 2) if k <= 8 else (1, 3)
    left_out = list(combinations(range(n2), k2))
    chosen = np.ones((len(left_out), n2), U)
    for i, parts in enumerate(left_out):
        chosen[i, list(parts)] = 0
    return n2, k2, chosen


def used(k: np.ndarray | int, k2: int) -> np.ndarray | int:
    """Partitions that a set emits which differs in at most k features from those it may link with: k // (k2 + 1) of them can be
    spoilt, one must be left, and some more stand for those where a choice is empty. A similar set emits these or more."""
    spoilt = k // (k2 + 1)
    return spoilt + 1 + (spoilt > 0) * (1 + spoilt // 12)


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of distinct scrambled features."""
    n = len(features)
    first, last = bands(percent)
    band = int(np.searchsorted(first, n, side="right")) - 1
    out = []
    for instance in (band, band + 1):
        top = last[instance]
        partner = min(top, n * 100 // percent)
        k = max(apart(t, percent) for t in (n + partner, n + partner - 1))
        if not n or k <= 0:
            continue  # only equal sets can be similar
        most = max(apart(t, percent) for t in (2 * top, 2 * top - 1))
        n2, k2, chosen = scheme(most)
        n1, m = used(most, k2), used(k, k2)
        g = mix(features ^ U((instance + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        part = (g % U(n1 * n2)).astype(np.int64)
        near = part < m * n2
        g, part = g[near], part[near]
        sums = np.zeros(m * n2, U)
        with np.errstate(over="ignore"):
            np.add.at(sums, part, mix(g + U(1)))
            filled = np.bincount(part, minlength=m * n2).reshape(m, n2) @ chosen.T.astype(np.int64) > 0
            place = np.arange(m * len(chosen), dtype=U).reshape(m, -1) + U(instance << 40)
            value = mix(sums.reshape(m, n2) @ chosen.T ^ mix(place))
        # Among the partitions that a partner emits too, more must have no empty choice than can be spoilt. Where that isn't
        # certain the set keeps its empty choices. So a pair is lost only if neither could do without them, and then both have them.
        weak = np.cumsum(~filled.all(axis=1))
        each = np.arange(max(0, k * 7 // 10 - 1), k + 1)
        if np.any(weak[used(each, k2) - 1] >= used(each, k2) - each // (k2 + 1)):
            filled[:] = True
        out.append(value[filled])
    return np.concatenate(out) if out else np.zeros(0, U)


SUMMARY = "doc_id bigint, n int, name bigint, " + ", ".join(f"s{i} bigint" for i in range(SKETCH)) + ", parity binary"
TRAITS = ["n", *(f"s{i}" for i in range(SKETCH)), "parity"]


def _parity(features: np.ndarray) -> bytes:
    """Parity of the features over about as many bits as the set has features."""
    bits = np.zeros(max(512, 1 << len(features).bit_length()), np.uint8)
    np.add.at(bits, (mix(features ^ U(0x5A5A5A5A)) % U(len(bits))).astype(np.int64), np.uint8(1))
    return np.packbits(bits & 1).tobytes()


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, U)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def _names(sets: list[np.ndarray]) -> pa.Array:
    every, row = _joined(sets)
    out = np.zeros(len(sets), U)
    with np.errstate(over="ignore"):
        np.add.at(out, row, mix(every + U(7)))
    return pa.array(mix(out + np.array([len(x) for x in sets], U)).view(np.int64))


def _summary(k: int):
    """Per document the size and name of its set, and the parity of its features over 1024 bits and over more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 19):
                sets = shingles(Words(batch.column("text")), k)
                every, row = _joined(sets)
                bit = (mix(every ^ U(0xA5A5A5A5)) % U(SKETCH * 64)).astype(np.int64)
                sketch = np.bincount(row * (SKETCH * 64) + bit, minlength=len(sets) * SKETCH * 64).astype(np.uint8).reshape(len(sets), -1)
                packed = np.packbits(sketch & 1, axis=1).view(np.int64)
                sizes = pa.array(np.array([len(x) for x in sets], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, _names(sets), *(pa.array(packed[:, i].copy()) for i in range(SKETCH)), pa.array([_parity(x) for x in sets], pa.binary())], names=["doc_id", "n", "name", *TRAITS[1:]])

    return lean(run)


def _held(batch: pa.RecordBatch, wanted: bytes) -> pa.RecordBatch:
    """The rows whose doc_id is in a bitmap of ids modulo its size; it only saves work."""
    bits = np.frombuffer(wanted, np.uint8)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False) & (8 * len(bits) - 1)
    return batch.filter(pa.array((bits[ids >> 3] >> (ids & 7).astype(np.uint8) & 1).astype(bool)))


def _signed(k: int, percent: int):
    """(sig, name) of the sets of a task, each signed once however many of its documents have it. A signature keeps 48 bits: chance meetings
    stay rare, and it takes less room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 19):
                sets = shingles(Words(batch.column("text")), k)
                names = _names(sets)
                new = [i for i, name in enumerate(names.to_pylist()) if name not in seen and not seen.add(name)]
                every, row = _joined([signatures(sets[i], percent) for i in new])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array((every >> U(16)).view(np.int64)), names.take(pa.array(new)).take(pa.array(row))], names=["sig", "name"])

    return lean(run)


def _sets(k: int, wanted: bytes):
    """(doc_id, name, features): the sets, as sorted 64-bit hashes, of the documents in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(_held(whole, wanted), "text", 1 << 19):
                found = shingles(Words(batch.column("text")), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _names(found), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "name", "features"])

    return lean(run)


def _bitmap(ids: DataFrame) -> bytes:
    """A bitmap of doc_id, 16 bits a row up to BITS; whatever its size, it holds all ids."""
    bits = min(BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod("doc_id", F.lit(bits))
    maps = ids.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in maps:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(out)


def _fetched(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The columns of `wanted` (name, rep and others) and the features of each set: those of a document `rep` that has it. Repeated rows bring a set again."""
    found = docs.mapInArrow(_sets(k, _bitmap(wanted.select(F.col("rep").alias("doc_id")))), "doc_id bigint, name bigint, features binary")
    return found.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "name"]).drop("doc_id")


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(p) + len(q) - shared))
        return pa.array(out, pa.bool_())

    return similar


@F.arrow_udf(T.IntegerType())
def _flips(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits by which two parities differ; the longer one is folded to the length of the other."""
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = sorted((np.frombuffer(z.as_buffer(), np.uint8) for z in (x, y)), key=len)
        out.append(int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum()))
    return pa.array(out, pa.int32())


def _distinct(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), dealt by both. Dealt by `a` alone, the join before would have to keep all pairs of a large group's head in one task."""
    return pairs.select("a", "b").repartition(partitions(pairs.sparkSession), "a", "b").distinct()


def _likely(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Without pairs whose parities show that they differ in too many features. Each feature that only one set has flips one bit at most."""
    side = lambda c: traits.select(F.col("name").alias(c), F.col("parity").alias(f"p{c}"), F.col("n").cast("bigint").alias(f"n{c}"))
    found = pairs.join(side("b"), "b").join(side("a"), "a")
    return _distinct(found.where(_flips("pa", "pb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)))


def _verified(pairs: DataFrame, docs: DataFrame, same: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of names whose sets are similar. A set that stands in many pairs as `a` is dealt over several keys."""
    spark = docs.sparkSession
    pairs = settle(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    wanted = settle(same.select("name", "rep").join(ids, "name"))
    # Dealt by name once and kept so: no later join moves the sets that it looks up.
    sets = _fetched(docs, wanted, k).repartition(partitions(spark), "name").dropDuplicates(["name"]).persist(StorageLevel.DISK_ONLY)
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts"))
    left = pairs.join(heads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    left = left.join(sets.select(F.col("name").alias("b"), F.col("features").alias("fb")), "b")
    right = heads.join(sets.select(F.col("name").alias("a"), F.col("features").alias("fa")), "a")
    right = right.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "fa")
    out = settle(left.join(right, ["a", "salt"]).where(_similar(percent)("fa", "fb")).select("a", "b"))
    sets.unpersist()
    drop(pairs, wanted)
    return out


def _shared(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of p with each of q. Features of one side alone are left out; the rest goes by columns."""
    (a, row_a), (b, row_b) = _joined(p), _joined(q)
    both = np.intersect1d(a, b)
    out = np.zeros((len(p), len(q)), np.int64)
    near_a, near_b = np.isin(a, both), np.isin(b, both)
    at_a, at_b, row_a, row_b = np.searchsorted(both, a[near_a]), np.searchsorted(both, b[near_b]), row_a[near_a], row_b[near_b]
    for first in range(0, len(both), 4096):
        sides = []
        for at, row, n in ((at_a, row_a, len(p)), (at_b, row_b, len(q))):
            here = (at >= first) & (at < first + 4096)
            side = np.zeros((n, min(4096, len(both) - first)), np.float32)
            side[row[here], at[here] - first] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


COUNTED = "name bigint, links bigint"


def _counted(percent: int):
    """Links of each set with the others of its block (i = j) or with those of the other block. Rows come sorted by component, i, j, block and name."""

    def count(p: list, q: list | None) -> Iterator[pa.RecordBatch]:
        other = p if q is None else q
        if not p or not other:
            return
        shared = _shared([x[2] for x in p], [x[2] for x in other])
        n, m = (np.array([len(x[2]) for x in side], np.int64) for side in (p, other))
        link = 100 * shared >= percent * (n[:, None] + m - shared)
        if q is None:
            np.fill_diagonal(link, False)
        many, more = (np.array([x[1] for x in side], np.int64) for side in (p, other))
        for side, links in [(p, link @ more)] if q is None else [(p, link @ more), (q, many @ link)]:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in side], pa.int64()), pa.array(links, pa.int64())], names=["name", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides, last = None, ([], []), None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "block", "name", "docs")), batch.column("features"), strict=True)
            for component, i, j, block, name, docs, features in rows:
                if group != (component, i, j):
                    if group is not None:
                        yield from count(sides[0], sides[1] if group[1] != group[2] else None)
                    group, sides, last = (component, i, j), ([], []), None
                if last != name:  # a repeated row brings its set again
                    sides[int(block != i)].append((name, docs, np.frombuffer(features.as_buffer(), U)))
                last = name
        if group is not None:
            yield from count(sides[0], sides[1] if group[1] != group[2] else None)

    return lean(run)


def _links(least: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(name, links) of the sets that link with different ones: how many rows have a set that links with theirs. `least` has name, n,
    rep, docs and component of each set."""
    spark = docs.sparkSession
    sizes = least.groupBy("component").agg(F.count("*").alias("sets"), F.sum(F.col("n").cast("bigint")).alias("features"), F.sum("docs").alias("rows")).where("sets > 1")
    grouped = settle(least.join(sizes, "component"))
    two = grouped.where("sets = 2").select("name", (F.col("rows") - F.col("docs")).alias("links"))
    salts = F.ceil(F.greatest(F.col("sets") / PART[0], F.col("features") / PART[1])).cast("int")
    more = settle(grouped.where("sets > 2").select("name", "rep", "docs", "component", salts.alias("salts")))
    found = _fetched(docs, more, k)
    found = found.withColumn("block", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = found.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "docs", "features")
    dealt = found.repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "name")
    out = settle(dealt.mapInArrow(_counted(percent), COUNTED).unionAll(two).groupBy("name").agg(F.sum("links").alias("links")))
    drop(grouped, more)
    return out


def _may_link(percent: int) -> Column:
    """Of the sets x and y, by their sizes and parities: each feature that only one set has flips one parity bit at most."""
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    near = differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    return near & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs (doc_id bigint, text string).

    Words are runs of other characters than white space, A-Z lower-cased; a set holds the distinct k-word shingles of a
    text, with fewer words the whole sequence as one. Two documents link when 100 * |intersection| >= percent * |union|;
    component_id is the least doc_id that links reach; n_links counts the other rows with a doc_id whose text links with that of the row,
    equal texts included. Texts that are null or without words have an empty set and link
    with nothing, not with each other. Repeated rows come back repeated; rows of one doc_id with different texts are linked
    each by its own text. A null doc_id comes back with its n_shingles and a null component and null n_links. Other columns are ignored; an
    empty table gives an empty one. Very long texts are compared whole, the longer the more signatures they have. Shingles and
    sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = settle(docs.mapInArrow(_summary(k), SUMMARY))
    same = settle(known.where("n > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), *(F.any_value(c).alias(c) for c in TRAITS)))

    by_sig = Window.partitionBy("sig")
    whole = docs.where("doc_id IS NOT NULL")
    met = whole.mapInArrow(_signed(k, percent), "sig bigint, name bigint")
    # Tasks may have signed the same set.
    met = settle(met.withColumns({"least": F.min("name").over(by_sig), "most": F.max("name").over(by_sig)}).where("least < most").select("sig", "name").distinct())
    release(spark)
    sketch = same.drop("rep", "docs", "parity")

    def likely(tied: DataFrame) -> DataFrame:
        """Of (name, a) the pairs that sketches and parities let through."""
        wide = tied.join(sketch.alias("x"), "name").join(sketch.withColumnRenamed("name", "a").alias("y"), "a").where(_may_link(percent))
        return _likely(_distinct(wide.select("a", F.col("name").alias("b"))), same, percent)

    def grouped(edges: DataFrame) -> DataFrame:
        """The rows of `met` under whose signature several groups meet, with the label of their group, the least of them, and how many sets share the signature."""
        label = components(edges, "a", "b").select(F.col("node").alias("name"), F.col("component").alias("label"))
        rows = met.select("sig", "name").join(label, "name", "left").withColumn("label", F.coalesce("label", "name"))
        rows = rows.withColumns({"low": F.min("label").over(by_sig), "high": F.max("label").over(by_sig), "sets": F.count("*").over(by_sig)}).where("low < high")
        return settle(rows.select("sig", "name", "label", "low", "sets"))

    def chosen(rows: DataFrame) -> DataFrame:
        """Of the partners (name, least) of each set the one with which it shares most signatures."""
        often = rows.groupBy("name", "least").agg(F.count("*").alias("n"))
        return often.groupBy("name").agg(F.max_by("least", F.struct("n", "least")).alias("a"))

    first = met.join(same.select("name", "rep"), "name").withColumn("least", F.min(F.struct("rep", "name")).over(by_sig)["name"])
    near = _verified(likely(chosen(first.where("least <> name"))), whole, same, k, percent)
    release(spark)
    split = grouped(near)
    least = split.withColumn("least", F.min(F.when(F.col("label") == F.col("low"), F.col("name"))).over(by_sig))
    more = _verified(likely(chosen(least.where("label <> low"))), whole, same, k, percent)
    drop(split)
    edges = settle(near.unionAll(more))
    split = grouped(edges)
    wide = settle(split.select("sig", "name", "label", F.ceil(F.col("sets") / BLOCK).cast("int").alias("salts")).join(sketch, "name"))
    drop(met, split, near, more)
    release(spark)
    left = wide.withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int")).alias("x")
    right = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    apart_yet = (F.col("x.label") != F.col("y.label")) & (F.col("x.name") < F.col("y.name"))
    pairs = left.join(right, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.salt") == F.col("y.salt")) & apart_yet & _may_link(percent))
    far = _verified(_likely(pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct(), same, percent), whole, same, k, percent)
    drop(wide)
    release(spark)

    linked = components(edges.unionAll(far), "a", "b")
    least = settle(same.select("name", "n", "rep", "docs").join(linked.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name")))
    links = _links(least, whole, k, percent)
    ends = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = least.join(ends, "component").join(links, "name", "left").select("name", "component_id", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # Texts without words are dealt by their ids, so that they don't all meet in one task.
    some = F.col("n") > 0
    every = known.select("doc_id", "n", F.when(some, F.col("name")).otherwise(F.xxhash64("doc_id")).alias("name")).join(told, "name", "left")
    given = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    out = settle(every.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), given(F.when(some, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"), given(F.when(some, F.col("n_links")).otherwise(0)).cast("bigint").alias("n_links")))
    drop(known, same, edges, far, least, links)
    release(spark)
    return out
