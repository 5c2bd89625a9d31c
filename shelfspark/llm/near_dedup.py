"""Operator 7: near-duplicates by HyperMinHash.

Each document's set of word shingles is hashed to 64 bits and dealt over buckets by its first
bits; a bucket's register keeps, of its smallest hash, the count of leading zeros and the
mantissa bits behind them. Empty buckets borrow the register of another bucket, in an order
fixed for each bucket, so small sets can be banded too. Bands of registers find candidates;
documents with equal sets stand once, so groups of copies cost nothing here. Candidates that
hang together form a cluster. Within a cluster only sets of similar size meet (the ratio of
sizes bounds the similarity), in blocks: there the registers give a collision-corrected
estimate, and pairs that it does not rule out are compared on the full sets, unless they are
already known to be connected. What leaves a block are at most as many links as it has sets.
Links become components.

At a similarity s, a pair of documents shares none of the ``bands`` with probability about
(1 - s^rows)^bands: 4e-11 at 0.85 and 5e-8 at 0.8 for 32 bands of 4.

Cases: null texts and texts without words have the empty set and are linked with nothing;
shorter texts than a shingle count as one; null identifiers are passed over when the smallest
identifier of a component is chosen, and kept only where no row of it has one; of rows with the
kept identifier and different texts one text is kept, and rows that repeat both identifier and
text stay or go together; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import gather, read, slices, texts_of, without, words_of
from shelfspark.llm.components import components
from shelfspark.session import cut_lineage

WORDS = 5
REGISTERS, MANTISSA = 128, 10
BANDS = 32
#: Estimates more than so many standard errors below the threshold rule a pair out.
ERRORS = 6.0
#: Sets, and bytes of them, on one side of a block.
BLOCK_SETS, BLOCK_BYTES = 256, 16 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct 64-bit hashes of each text's shingles. Words are what
    stands between ASCII white space, A-Z lower-cased."""
    import xxhash
    for c in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, c, " ")
    codes, offsets, distinct = words_of(pc.ascii_lower(texts))
    distinct = distinct.to_pylist()
    real = np.fromiter(map(len, distinct), np.int64, len(distinct)) > 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    keep = real[codes]
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    h = hashes[codes[keep]]
    if not len(h):
        return h, np.zeros(len(texts) + 1, np.int64)
    rolled = h.copy()
    for k in range(1, words):  # at the last words of a text these run into the next one and are not used
        rolled = rolled * _M1 + np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])[:len(h)]
    rolled = _mix(rolled)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist())):
        if b - a >= words:
            s = np.unique(rolled[a:b - words + 1])
        elif b > a:
            s = h[a]
            for x in h[a + 1:b]:
                s = s * _M1 + x
            s = _mix(np.array([s + np.uint64(b - a)]) * _M1)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def _borrow_order(registers: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(registers) for _ in range(registers)])


def hyper_registers(hashes: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA):
    """(registers as uint16 rows, filled): leading zeros and mantissa of the smallest hash of
    each bucket; 0 where a bucket is empty."""
    n = len(offsets) - 1
    bits = registers.bit_length() - 1
    out = np.zeros((n, registers), np.uint16)
    filled = np.zeros((n, registers), bool)
    if len(hashes):
        row = np.repeat(np.arange(n), np.diff(offsets))
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        key = row * registers + bucket
        first = np.concatenate([[True], key[1:] != key[:-1]])  # sorted, so the smallest of its bucket
        rest = hashes[first] << np.uint64(bits)
        zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        zeros = np.minimum(zeros, 53)
        tail = np.left_shift(rest, np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - mantissa)
        out.reshape(-1)[key[first]] = (zeros.astype(np.uint64) << np.uint64(mantissa) | tail).astype(np.uint16)
        filled.reshape(-1)[key[first]] = True
    return out, filled


def band_keys(registers: np.ndarray, filled: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each row and band, empty buckets filled in the borrowing order."""
    n, m = registers.shape
    regs, have = registers.copy(), filled.copy()
    order = _borrow_order(m)
    todo = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    for t in range(m):
        if not len(todo):
            break
        source = order[:, t]
        use = ~have[todo] & filled[todo][:, source]
        regs[todo] = np.where(use, registers[todo][:, source], regs[todo])
        have[todo] |= use
        todo = todo[~have[todo].all(axis=1)]
    groups = regs.reshape(n, bands, m // bands).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1, (n, bands)).copy()
    for k in range(groups.shape[2]):
        keys = _mix(keys + groups[:, :, k] + np.uint64(1)) * _M1
    return keys.view(np.int64)


def estimate(a: np.ndarray, fa: np.ndarray, na: int, b: np.ndarray, fb: np.ndarray, nb: np.ndarray, mantissa: int = MANTISSA):
    """(Jaccard estimate, registers it rests on) of one set against many, corrected for registers
    that agree by chance."""
    either = (fa | fb).sum(axis=1)
    equal = ((a == b) & fa & fb).sum(axis=1)
    m = a.shape[-1]
    load = np.maximum(na, nb) / m
    chance = 0.169919487159739 * (4 * load / (1 + load) ** 2) * m * 2.0 ** -mantissa
    return np.maximum(equal - chance, 0) / np.maximum(either, 1), either


def _describe(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, offsets = shingle_sets(texts_of(part), words)
                keys = band_keys(*hyper_registers(hashes, offsets))
                sizes = np.diff(offsets)
                signature = [hashlib.blake2b(hashes[a:b], digest_size=16).digest() if b > a else None
                             for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                flat = pa.array(keys.reshape(-1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), flat)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": sizes,
                                       "signature": pa.array(signature, pa.binary()), "bands": bands})
    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, offsets = shingle_sets(texts_of(part), words)
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
                yield pa.record_batch({"rep": part.column("rep"), "cluster": part.column("cluster"),
                                       "places": part.column("places"), "hashes": sets})
    return run


def _links(share: int, of: int):
    """Confirmed links between the sets of a block, as a forest."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("side", "ascending"), ("rep", "ascending")])
        rep, side = block.column("rep").to_pylist(), block.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block.column("hashes").to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        regs, filled = hyper_registers(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        other = int(np.searchsorted(side, 1))  # from here on the second side; a block with one side meets itself
        found = []
        for i in range(other if other < len(sets) else len(sets)):
            lo = other if other < len(sets) else i + 1
            if lo >= len(sets):
                break
            near, on = estimate(regs[i], filled[i], sizes[i], regs[lo:], filled[lo:], sizes[lo:])
            t = share / of
            able = near >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(on, 1))
            able &= of * np.minimum(sizes[i], sizes[lo:]) >= share * np.maximum(sizes[i], sizes[lo:])
            for j in (lo + np.flatnonzero(able)).tolist():
                if find(i) == find(j):
                    continue
                common = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if of * common >= share * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
                    found.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
    return run


def near_groups(docs: DataFrame, share: int = 80, of: int = 100, words: int = WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest identifier reachable over
    links of at least ``share`` / ``of`` similarity), kept, text_key (md5 of the text)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.md5("text"))
    described = cut_lineage(rows.mapInArrow(_describe(words), "doc_id long, text_key string, n_shingles long, signature binary, "
                                                              "bands array<long>"), "registers")
    # documents with equal sets stand once
    one = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key", "n_shingles")).alias("one")
    sets = cut_lineage(described.where("signature is not null").groupBy("signature").agg(one, F.first("bands").alias("bands"))
                       .select("signature", "one", F.col("one.doc_id").alias("own_id"), "one.text_key", "one.n_shingles", "bands",
                               F.monotonically_increasing_id().alias("rep")), "distinct-sets")
    banded = sets.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = banded.join(shared.select("band", "first"), "band").where("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    cluster = components(stars).select(F.col("vertex").alias("rep"), F.col("component").alias("cluster"))
    # classes of size: a link's sizes are in the same class or in neighbouring ones
    width = float(np.log(of / share) * 1.0001) if share < of else 1e-9
    member = cut_lineage(cluster.join(sets.drop("bands", "signature", "one"), "rep")
                         .withColumn("cls", F.floor(F.log("n_shingles") / width).cast("long")), "cluster-members")
    blocks = member.groupBy("cluster", "cls").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    beside = lambda by, name: blocks.select("cluster", (F.col("cls") + by).alias("cls"), F.col("blocks").alias(name))
    placed = (member.join(beside(0, "own"), ["cluster", "cls"]).join(beside(-1, "above"), ["cluster", "cls"], "left")
              .join(beside(1, "below"), ["cluster", "cls"], "left")
              .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")))
    upto = lambda name: F.when(F.col(name).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(name) - 1))
    place = lambda c1, p1, c2, p2, side: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"), side.cast("int").alias("side"))
    cls, part = F.col("cls"), F.col("part")
    placed = placed.withColumn("places", F.concat(
        F.transform(upto("own"), lambda j: place(cls, F.least(part, j), cls, F.greatest(part, j), part > j)),
        F.transform(upto("above"), lambda j: place(cls, part, cls + 1, j, F.lit(0))),
        F.transform(upto("below"), lambda j: place(cls - 1, j, cls, part, F.lit(1)))))
    texts = (rows.join(placed.select("rep", "cluster", "places", "text_key", F.col("own_id").alias("id")),
                       ["text_key"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
             .groupBy("rep").agg(F.first("cluster").alias("cluster"), F.first("places").alias("places"), F.first("text").alias("text")))
    shape = ("rep long, cluster long, places array<struct<c1:bigint,p1:int,c2:bigint,p2:int,side:int>>, hashes binary")
    links = (texts.mapInArrow(_sets(words), shape).select("rep", "cluster", "hashes", F.inline("places"))
             .groupBy("cluster", "c1", "p1", "c2", "p2").applyInArrow(_links(share, of), "a long, b long"))
    # the best document of each component, found among the distinct sets: a large component or
    # group of copies meets in partial aggregates, and documents are joined by signature only
    found = cut_lineage(components(links).withColumnRenamed("vertex", "rep")
                        .join(sets.select("rep", "one"), "rep"), "linked-sets")
    best_of = found.groupBy("component").agg(F.min("one").alias("best"))
    linked = sets.select("signature", "rep", "one").join(
        found.select("rep", "component").join(best_of, "component").select("rep", "best"), "rep", "left").select(
        "signature", F.coalesce("best", "one").alias("best"))
    placed_docs = described.drop("bands").join(linked, "signature", "left")
    alone = F.col("best").isNull()  # the empty set
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return (placed_docs
            .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
                    (alone | best).alias("kept"), "text_key"))


def keep_one(docs: DataFrame, share: int = 80, of: int = 100) -> DataFrame:
    """The documents with one of each group of near-duplicates, all their columns unchanged."""
    verdicts = near_groups(docs, share, of).select("doc_id", F.col("text_key").alias("key"), "kept")
    return without(docs, verdicts, F.md5(F.coalesce(F.col("text"), F.lit(""))), "near-verdicts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"), share=85)
    # a filter keeps one row of a repeated identifier; here every row that bears the component's stays
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
