"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k least 64-bit hashes of a text's distinct shingles. Sketches of parts merge into
the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import cut, keyed_text

K = 128
SHINGLE = 5


def words(text: Column) -> Column:
    """Lower-cased words between white space; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingle_hashes(word_hashes: Column, n: int = SHINGLE) -> Column:
    """Hashes of runs of n words, or of the whole sequence if it is shorter; none without words."""
    size = F.size(word_hashes)
    runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i, n)))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size <= n, F.array(F.xxhash64(word_hashes))).otherwise(runs)


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Add the bottom-k sketch of a text column; the steps are separate projections so that each is computed once."""
    return (
        df.withColumn("__w", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
        .withColumn("__h", shingle_hashes(F.col("__w"), n))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct("__h")), 1, k))
        .drop("__w", "__h")
    )


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the share of the union's sketch that both have. Two empty sets: 1."""
    both = F.size(F.array_intersect(F.array_intersect(union_sketch(a, b, k), a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(union_sketch(a, b, k)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    shared = j * distinct_count(union_sketch(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Fixed-width hex digits of the hashes, space-separated."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def merge_sketches(df: DataFrame, key: str, sketch: str, k: int = K, fan_in: int = 32) -> DataFrame:
    """One sketch for each key from the sketches of its parts.

    Parts are merged some fan_in at a time in rounds, dealt at random, so that no task gathers all parts of a hot key.
    A null key is a key; null sketches count as empty.
    """
    parts = df.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{sketch}`"), F.array().cast("array<bigint>")).alias(sketch))
    most = parts.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = max(1, -(-most // fan_in))
        salted = parts.withColumn("__salt", F.floor(F.rand(11) * groups).cast("long") if groups > 1 else F.lit(0).cast("long"))
        parts = salted.groupBy(key, "__salt").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k).alias(sketch)).drop("__salt")
        if groups == 1:
            return parts
        parts, most = cut(parts), groups


def _cuts_below(cuts: list[float], x: Column) -> Column:
    """How many of the sorted cuts are at most x: first among every step-th of them, then within one step."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    count = lambda values: F.size(F.filter(values, lambda c: c <= x))
    whole = F.array(*map(F.lit, cuts))
    coarse = count(F.array(*map(F.lit, cuts[::step])))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + count(F.slice(whole, (coarse - 1) * step + 1, step)))


def with_next(df: DataFrame, id_col: str, text_col: str, buckets: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Add next_text: the text of the row that follows by descending id; after the last comes the first. So with columns
    named in `also`.

    Rows go to buckets of neighbouring ids; the first row of each bucket is also put at the end of the one before, so
    that a window within buckets sees every neighbour. One shuffle, and no task holds more than a bucket. Rows of one
    id are ordered by their texts; null ids come last.
    """
    spark = df.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(1 << 63)
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col), F.lit(low)).alias("__id"), *also)
    x = F.col("__id").cast("double")
    cuts = base.select(x.alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = sorted(set(cuts))
    base = base.withColumn("__bucket", F.lit(len(cuts)) - _cuts_below(cuts, x))
    heads = {r["__bucket"]: r["head"] for r in base.groupBy("__bucket").agg(F.max("__id").alias("head")).collect()}  # a row for each bucket
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    at = lambda values, kind: F.element_at(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(len(cuts) + 1)]), F.col("__bucket") + 1)
    own, guest = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(at(before, "int").alias("bucket"), F.lit(1).alias("guest"))
    copies = F.when(at(heads, "long") == F.col("__id"), F.array(own, guest)).otherwise(F.array(own))
    dealt = base.withColumn("__c", F.explode(copies)).select("doc_id", "text", "__id", *also, F.col("__c.bucket").alias("__bucket"), F.col("__c.guest").alias("__guest"))
    own = Window.partitionBy("__bucket").orderBy("__guest", F.desc("__id"), F.xxhash64("text"), "text")
    names = ("text", *also)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(own) for c in names}).where("__guest = 0").select("doc_id", *names, *(f"next_{c}" for c in names))


def fingerprint_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike these and their neighbours are.

    The edited text has its last floor(n_chars/3) code points replaced by as many first ones of the next document (all
    of a shorter one). A row for each row of documents; null texts count as empty; an empty text has an empty
    fingerprint, like 1 to another empty one and 0 to the rest; a single document is its own next.
    """
    rows = keyed_text(documents, id_col, text_col)
    rows = with_next(with_sketch(rows, "text", "sketch", k, n), "doc_id", "text", also=("sketch",))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    rows = with_sketch(rows, "edited", "edited_sketch", k, n)
    return rows.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")


def with_digest(rows: DataFrame, k: int = K) -> DataFrame:
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_in_text"),
    )
