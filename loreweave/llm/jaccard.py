"""Similarity join on word n-grams with Bayesian candidate pruning, verified exactly.

Documents with the same set of shingles are one node. Nodes that share a band of MinHash values are candidates; a
candidate pair compares its MinHash values ``STEP`` at a time and is dropped as soon as the posterior probability
that its similarity reaches the threshold, given the matches so far and a uniform prior, falls below ``TOLERANCE``.
All that are left are verified on their whole shingle sets. A pair at the threshold itself is missed by the bands
with probability 3e-6 and dropped by a step with probability of about ``TOLERANCE``; above it with less.

Scale. Buckets are split into blocks of bounded size and block pairs are dealt out, so neither a hot bucket nor the
pairs within it meet in one task; pairs are never rows. A pair is compared only in the first band it shares, and
buckets with the same members only once. Tasks return, per node, the number of verified links and the root of its
local component; components are then joined by label propagation over these stars.

Edge cases: a text of fewer than n words, but not none, has one shingle of all its words; null, empty and wordless
texts have no shingles, no links and are classes of their own; rows with equal sets are linked to each other; a null
doc_id ranks behind all others; repeated rows are copies of each other and one of them stays; an empty table gives no
rows. ``keep_one`` passes other columns through, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import Words, chunks, mix, shingles
from .common import small, stage

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: A block holds about so many nodes, and so many shingles, at most.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20

_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles in rising order text after text, bounds of each text)."""
    h, text = shingles(Words(data, offsets), n)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def sketch_column(text: Column, n: int) -> Column:
    """Struct (a, b, size, sig): a fingerprint of the shingle set, its size and its MinHash values."""

    @F.arrow_udf("a bigint, b bigint, size bigint, sig binary")
    def run(texts: pa.Array) -> pa.Array:
        a, b, size = (np.zeros(len(texts), np.int64) for _ in range(3))
        sig: list[bytes | None] = [None] * len(texts)
        for first, end, data, offsets in chunks(texts):
            h, bounds = shingle_sets(data, offsets, n)
            count = np.diff(bounds)
            some = np.flatnonzero(count)
            if len(some) == 0:
                continue
            at = bounds[:-1][some]
            size[first + some] = count[some]
            a[first + some] = np.add.reduceat(mix(h), at).view(np.int64)
            b[first + some] = np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), at).view(np.int64)
            values = np.empty((len(some), HASHES), np.uint32)
            for k in range(HASHES):
                values[:, k] = np.minimum.reduceat(((h ^ _B[k]) * _A[k]) >> np.uint64(32), at)
            for row, i in enumerate(some):
                sig[first + i] = values[row].tobytes()
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(size), pa.array(sig, pa.binary())], ["a", "b", "size", "sig"])

    return run(text)


def set_column(text: Column, n: int) -> Column:
    """The distinct shingles of each whole text as bytes."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in chunks(texts):
            h, bounds = shingle_sets(data, offsets, n)
            out += [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(bounds) - 1)]
        return pa.array(out, pa.binary())

    return run(text)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 1, 2, ... steps: the fewest matches with which a pair stays. With a uniform prior, the posterior after m of n
    matches is P(J >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a stream that is sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for low, high in zip(cuts, cuts[1:]):
            if held and held[0].column(key)[0].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def pruner(threshold: float, tolerance: float):
    """Function for ``mapInArrow`` over (block, band, side, node, sig), sorted by block: rows (block, node, partners) of
    the pairs that stay, with a row for every node of such a pair."""
    least = least_matches(threshold, tolerance)

    def pairs(left: np.ndarray, right: np.ndarray, band: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
        keys = [np.ascontiguousarray(s).view(np.uint64).reshape(len(s), BANDS, ROWS // 2) for s in (left, right)]
        out = []
        for low in range(0, len(left), 128):
            a = left[low : low + 128]
            ok = np.ones((len(a), len(right)), bool)
            if within:
                ok &= (low + np.arange(len(a)))[:, None] < np.arange(len(right))[None, :]
            # Pairs that share an earlier band are compared there.
            for k in range(band):
                x, y = keys[0][low : low + 128, k], keys[1][:, k]
                ok &= ~((x[:, None, 0] == y[None, :, 0]) & (x[:, None, 1] == y[None, :, 1]))
            i, j = np.nonzero(ok)
            match = np.zeros(len(i), np.int64)
            for step, need in enumerate(least):
                if len(i) == 0:
                    break
                for h in range(step * STEP, (step + 1) * STEP):
                    match += a[i, h] == right[j, h]
                stay = match >= need
                i, j, match = i[stay], j[stay], match[stay]
            out.append((i + low, j))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "block"):
            node, side = t["node"].to_numpy(), t["side"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = len(two) == 0 and t["alone"][0].as_py()
            if within:
                two = one
            if len(one) == 0 or len(two) == 0:
                continue
            i, j = pairs(sig[one], sig[two], t["band"][0].as_py(), within)
            if len(i) == 0:
                continue
            i, j = one[i], two[j]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            used = np.unique(np.concatenate([i, j]))
            bounds = np.searchsorted(i, np.append(used, len(node)))
            bounds[-1] = len(i)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(node[j]))
            block = np.full(len(used), t["block"][0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(node[used]), lists], ["block", "node", "partners"])

    return run


def verifier(threshold: float):
    """Function for ``mapInArrow`` over (block, node, partners, copies, shingles), sorted by block: rows (node, links,
    root) of the nodes with a verified pair; ``links`` counts the documents of the partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "block"):
            node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets])
            _, place = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(node)
            mark = np.zeros(int(place.max()) + 1, bool)
            left, right = [], []
            for i, partners in enumerate(t["partners"]):
                mates = order[np.searchsorted(node, partners.values.to_numpy(), sorter=order)] if len(partners) else ()
                if len(mates) == 0:
                    continue
                own = place[starts[i] : starts[i + 1]]
                mark[own] = True
                common = np.array([np.count_nonzero(mark[place[starts[j] : starts[j + 1]]]) for j in mates])
                mark[own] = False
                good = mates[common >= threshold * (size[i] + size[mates] - common) - 1e-9]
                left.append(np.full(len(good), i))
                right.append(good)
            if not left or not sum(map(len, left)):
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = node.copy()
            while True:
                before = root.copy()
                np.minimum.at(root, i, before[j])
                np.minimum.at(root, j, before[i])
                if np.array_equal(root, before):
                    break
            used = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(links[used].astype(np.int64)), pa.array(root[used])], ["node", "links", "root"])

    return run


def components(stars: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (node, root); the component is its smallest node."""
    e = stars.select("node", F.col("root").alias("other")).filter("node <> other").distinct()
    edges = stage(e.union(e.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "jaccard-edges")
    label = stage(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "jaccard-label")
    while True:
        near = edges.join(label.select(F.col("node").alias("other"), "component"), "other").select("node", "component")
        low = near.union(label).groupBy("node").agg(F.min("component").alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = low.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"))
        new = stage(new, "jaccard-label")
        changed = new.join(label, ["node", "component"], "left_anti")
        label = new
        if changed.isEmpty():
            return label


def classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, text_key, class_id, first_key, class_size, n_links) per row: class_id is the smallest doc_id of the class
    and first_key the text_key of the row that stays."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), sketch_column(F.col("text"), n).alias("s"))
    sketches = stage(d.select("doc_id", "text_key", "s.*"), "jaccard-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    nodes = sketches.filter("size > 0").groupBy("a", "b", "size").agg(
        F.min(first).alias("low"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")
    )
    nodes = stage(nodes.withColumn("node", F.xxhash64("a", "b", "size")), "jaccard-nodes")

    # Candidate buckets; of those with the same members, that of the first band.
    bands = nodes.select("node", "size", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig")
    keys = bands.select("node", "size", "band", F.xxhash64("band", F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})")).alias("bucket"))
    buckets = keys.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("band").alias("band")
    ).filter("n > 1")
    kept = stage(buckets.groupBy("n", "total", "x", "y").agg(F.min_by("bucket", "band").alias("bucket")), "jaccard-buckets")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    members = keys.select("node", "band", "bucket").join(kept.select("bucket", parts.alias("parts")), "bucket")
    members = members.withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    dealt = dealt.select(F.xxhash64("bucket", low, high).alias("block"), "band", (F.col("own") > F.col("with")).cast("int").alias("side"), (low == high).alias("alone"), "node")
    rows = dealt.join(nodes.select("node", "sig"), "node").repartition("block").sortWithinPartitions("block")
    left = stage(rows.mapInArrow(pruner(threshold, tolerance), "block bigint, node bigint, partners array<bigint>"), "jaccard-candidates")

    # Whole shingle sets of the nodes that still have a candidate.
    wanted = left.select("node").distinct().join(nodes.select("node", "copies", F.col("low.id").alias("id"), F.col("low.key").alias("key")), "node")
    wanted = small(stage(wanted, "jaccard-wanted"))
    texts = docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = stage(texts.select("node", "copies", set_column(F.col("text"), n).alias("shingles")).dropDuplicates(["node"]), "jaccard-sets")
    checked = left.join(sets, "node").select("block", "node", "partners", "copies", "shingles").repartition("block").sortWithinPartitions("block")
    stars = stage(checked.mapInArrow(verifier(threshold), "node bigint, links bigint, root bigint"), "jaccard-stars")

    links = stars.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "a", "b", "size", "low", "copies").join(links, "node", "left").join(components(stars), "node", "left")
    known = stage(known.withColumn("component", F.coalesce("component", "node")), "jaccard-known")
    whole = known.groupBy("component").agg(F.min("low").alias("first"), F.sum("copies").alias("class_size"))
    known = known.join(whole, "component").select(
        "a", "b", "size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size", F.col("first.id").alias("class_id"), F.col("first.key").alias("first_key")
    )
    some = sketches.filter("size > 0").join(known, ["a", "b", "size"])
    none = sketches.filter("size = 0").select("*", F.lit(0).alias("n_links"), F.lit(1).alias("class_size"), F.col("doc_id").alias("class_id"), F.col("text_key").alias("first_key"))
    columns = ["doc_id", "text_key", "class_id", "first_key", "size", "class_size", "n_links"]
    return some.select(columns).unionByName(none.select(columns))


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline form: of each class the row with the smallest doc_id stays; wordless rows all stay."""
    c = stage(classes(docs, n, threshold), "jaccard-classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("first_key"))
    gone = small(stage(c.filter(~stays).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "jaccard-gone"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    left = d.join(gone, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left_anti")
    # Rows that repeat id and text and have words: normally none.
    twice = stage(c.filter(stays & (F.col("size") > 0)).groupBy("doc_id", "text_key").count().filter("count > 1"), "jaccard-twice")
    if twice.isEmpty():
        return left.select("row.*")
    same = (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    one = left.join(twice, same, "left_semi").withColumn("_turn", F.row_number().over(Window.partitionBy("_key", "_id").orderBy("_key"))).filter("_turn = 1")
    return left.join(twice, same, "left_anti").select("row.*").unionByName(one.select("row.*"))
