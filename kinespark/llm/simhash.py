"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits have a common variant within r bits of each. Every fingerprint therefore emits all its
variants within half the radius, these are shuffled, and fingerprints that meet on a variant are linked. A shuffled row
stands for all variants of a fingerprint whose leading bits name one bucket: the receiving task flips the remaining
bits itself, so a fingerprint travels a few dozen times, not once for each of its 2,081 variants. Fingerprints that meet
on a variant are within the radius of each other, so each group is linked as a star and thinned to a forest at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import cut, keyed_text, small_batches, stored
from kinespark.llm.components import connected

BITS = 64
RADIUS = 4
SHINGLE = 4
#: Variants that a task holds at a time, and the number that a bucket is planned for.
BUCKET_VARIANTS = 6_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: bit set where over half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, n)
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    count = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[a : a + _CHUNK], ends[a : a + _CHUNK], strict=True)])
        count += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(starts)).tobytes(), "big")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed 64-bit number."""
    small_batches(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, fp long")


def flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most so many of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as links (a, b), at most one less than there are nodes, all to the least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        lo, hi = np.minimum(ru, rv), np.maximum(ru, rv)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root != root[root]).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def meet(fps: np.ndarray, bucket: int, top: int, half: int, most: int = BUCKET_VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant whose top leading bits are the bucket."""
    fps = np.unique(fps)
    low_bits = BITS - top
    lead = (fps >> np.uint64(low_bits)) if top else np.zeros(len(fps), dtype=np.uint64)
    spent = np.bitwise_count(lead ^ np.uint64(bucket)).astype(np.int64)
    low = fps & np.uint64((1 << low_bits) - 1)
    own = [np.flatnonzero(spent == t) for t in range(half + 1)]
    masks = [flips(list(range(low_bits)), half - t) for t in range(half + 1)]
    total = sum(len(o) * len(m) for o, m in zip(own, masks, strict=True))
    slices = 1 << max(0, int(np.ceil(np.log2(max(1.0, total / most)))))
    shift = np.uint64(low_bits - int(np.log2(slices)))
    found_a, found_b = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    for s in range(slices):
        variants, who = [], []
        for o, m in zip(own, masks, strict=True):
            step = max(1, most // max(1, len(m)))
            for a in range(0, len(o), step):
                v = (low[o[a : a + step], None] ^ m[None, :]).ravel()
                w = np.repeat(o[a : a + step], len(m))
                if slices > 1:
                    keep = (v >> shift) == np.uint64(s)
                    v, w = v[keep], w[keep]
                variants.append(v)
                who.append(w.astype(np.uint32))
        v, w = np.concatenate(variants), np.concatenate(who)
        order = np.argsort(v)
        v, w = v[order], w[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        x, y = fps[w[same]], fps[w[same + 1]]  # each met group as a path
        fine = np.bitwise_count(x ^ y) <= 2 * half
        found_a.append(x[fine])
        found_b.append(y[fine])
        if sum(map(len, found_a)) > most:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, radius: int = RADIUS, bucket_variants: int = BUCKET_VARIANTS) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, distinct) which lie within the radius, an even number of bits."""
    half = radius // 2
    count = distinct.count()
    full = len(flips(list(range(BITS)), half))
    top = min(24, max(0, int(np.ceil(np.log2(max(1.0, count * full / bucket_variants))))))
    near = flips(list(range(top)), half).astype(np.int64).tolist()
    lead = F.shiftrightunsigned("fp", BITS - top) if top else F.lit(0).cast("long")
    dealt = distinct.select("fp", lead.alias("lead")).select("fp", F.explode(F.array(*map(F.lit, near))).alias("mask"), "lead").select("fp", F.col("lead").bitwiseXOR(F.col("mask").cast("long")).alias("bucket"))

    def work(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = meet(fps, bucket, top, half, bucket_variants)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.groupBy("bucket").applyInArrow(work, "a long, b long")


def components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, with_root: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links of fingerprints lead to; with_root adds root,
    the component's least fingerprint, which tells components apart where rows repeat an id.

    Fingerprints link at radius or fewer differing bits, equal ones included; texts without words, null included, have
    fingerprint 0. A row for each row of documents. Null ids do not count as least; a component of null ids has null.
    """
    fps = cut(fingerprints(documents, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected(links(classes.select("fp"), radius))
    rooted = found.join(classes, found["node"] == classes["fp"]).select("node", "root", "least")
    best = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    joined = rooted.join(best, "root").select(F.col("node").alias("fp"), "component_id", "root")
    # a table of its own, so that the last join can split a fingerprint that very many documents have
    named = stored(classes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", *["root"] * with_root)


def keep_first(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of documents, with all its columns, for each component: that of the least id.

    Rows that repeat an id are rows of their own: of several with the component's least id the one whose text has the
    least hash stays; of rows that repeat id and text any one. A row without an id goes if its component has one with an
    id; else it takes part under a number made of its text, and one row of the component stays. Null and empty texts are
    copies of one another; an empty table stays empty.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = "__id"
    while any(c.startswith(own) for c in documents.columns):
        own += "_"
    key = own + "k"
    rows = documents.withColumn(own, F.coalesce(F.col(f"`{id_col}`"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)))
    found = components(rows, id_col=own, text_col=text_col, radius=radius, with_root=True).where("doc_id = component_id")
    stay = cut(found.groupBy("doc_id", "root").agg(F.count("*").alias("n")))
    stay = stay.withColumn("n", F.sum("n").over(Window.partitionBy("doc_id")))  # a row for each component of an id
    kept = rows.join(stay.where("n = 1").select(F.col("doc_id").alias(own)), own, "left_semi")
    several = stay.where("n > 1")
    if several.limit(1).count():
        # rows of ids that several rows have: told apart by id and text
        again = rows.join(several.select(F.col("doc_id").alias(own)).distinct(), own, "left_semi").withColumn(key, F.xxhash64(F.col(own), text))
        fps = fingerprints(again, id_col=key, text_col=text_col).select(F.col("doc_id").alias(key), "fp").distinct()
        of = again.select(own, key).distinct().join(fps, key)
        roots = found.select(F.col("doc_id").alias(own), "fp", "root").distinct()
        first = of.join(roots, [own, "fp"]).groupBy(own, "root").agg(F.min(key).alias(key)).select(key)
        kept = kept.unionByName(again.join(first, key, "left_semi").dropDuplicates([key]).drop(key))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
