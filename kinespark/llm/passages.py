"""Fuzzy repeated passages by collinear chaining.

Every fifth k-mer of words, by its hash, is a seed. Occurrences of a seed that several documents have are told apart by
what stands around them: the least word hash of the words behind or before it, and the LONG words that begin with it. Of
those alike in one of these, each is linked with the first, so that a passage in m documents makes about m - 1 links, and
documents that share it find each other although others hold parts of it. Links whose neighbouring words do not agree
are dropped before any text is moved. The links of two documents are merged along diagonals and chained with gap costs through a Fenwick tree; chains are aligned word by word, and they or
their parts are kept if long and alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import cut, discard, keyed_text, release, small_batches, stored
from kinespark.llm.components import connected
from kinespark.llm.decontaminate import _LOWER, SHARD_BYTES, split_words

K = 4
#: One of so many k-mers, by hash, is a seed.
EVERY = 5
#: Words on one side of a seed of which the least hash is taken.
NEAR_SEED = 12
#: Words that begin with a seed and must agree as a whole.
LONG = 40
#: Of the four words before and the four behind a seed, so many must agree at least (in four bits of their hashes).
AGREE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
GAP_COST = 0.05
#: Words that are compared at once where an alignment is extended, and how far its score may fall below the best.
BLOCK = 32
DROP = 24
#: How far the score may fall below the best at the end of a passage that would be too short without.
SLACK = 4
#: Words between links of one diagonal that are still merged.
NEAR = 64
#: Words on both sides of a document's links that are first sent to its partner; where these agree to their end, all are.
REACH = 256
#: Most pairs of which a list of ids is broadcast; the texts of more are shuffled.
FEW = 100_000
#: Cells, of a bit each, of a table from which a gap's common subsequence is read.
TABLE_BITS = 1 << 27
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    starts, _, hashes = split_words(_LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)], offsets)
    return hashes, np.searchsorted(starts, offsets)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each element and the width - 1 after it; what lies beyond the end does not count."""
    f, fill, size = (np.minimum, _FAR, 1) if least else (np.maximum, np.uint64(0), 1)
    pad = np.concatenate([x, np.full(width, fill, dtype=np.uint64)])
    while 2 * size <= width:
        pad[: len(pad) - size] = f(pad[: len(pad) - size], pad[size:])
        size *= 2
    rest = width - size
    return f(pad[: len(x)], pad[rest : rest + len(x)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = [np.full(n, base, dtype=np.uint64) for base in (int(_MIX), pow(int(_MIX), -1, 1 << 64))]
    for x in steps:
        x[0] = 1
    return tuple(np.cumprod(x, dtype=np.uint64) for x in steps)


def seeds_of(hashes: np.ndarray, bounds: np.ndarray, k: int = K, every: int = EVERY, least_words: int = MIN_WORDS, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(hash, document, position, contexts, neighbours) of the seeds of texts that have least_words words or more.

    Contexts are three packed numbers of 16 bits, 0 where the text ends too soon: the least hash of NEAR_SEED words behind
    and before the seed, and the hash of the LONG words that begin with it. Neighbours are four bits of each of the eight
    next words. All depend on a text's own words only, and whether a k-mer is a seed on its words alone.
    """
    sizes = np.diff(bounds)
    sizes = np.where(sizes >= max(least_words, k), sizes, 0)
    starts = np.r_[0, np.cumsum(sizes + NEAR_SEED)][:-1] + NEAR_SEED
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.r_[0, np.cumsum(sizes)][:-1]
    pos = np.arange(len(doc)) - first[doc]
    n = int(starts[-1] + sizes[-1]) + NEAR_SEED if len(sizes) else NEAR_SEED
    if not len(doc):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int32))
    at = starts[doc] + pos  # words stand NEAR_SEED places apart from those of other texts
    words = np.zeros(n, dtype=np.uint64)
    words[at] = hashes[bounds[doc] + pos]
    whole = pos + k <= sizes[doc]
    mers = np.zeros(len(doc), dtype=np.uint64)
    for j in range(k):
        mers = mers * _MIX + words[at + j]
    mers = _mixed(mers)
    own = np.flatnonzero(whole & ((mers >> np.uint64(40)) % np.uint64(every) == 0))
    mers, doc, pos, at = mers[own], doc[own], pos[own], at[own]
    if not contexts:
        return mers, doc, pos, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    ranks = np.where(words == 0, _FAR, _mixed(words * _MIX) >> np.uint64(1))
    least = _slide(ranks, NEAR_SEED, True)
    up, down = _powers(1 << max(20, n.bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(words * up[:n], dtype=np.uint64)]
    packed = np.zeros(len(at), dtype=np.uint64)
    end = starts[doc] + sizes[doc]
    for t, (a, there) in enumerate(((at + k, None), (at - NEAR_SEED, None), (at, at + LONG <= end))):
        if there is None:
            x = least[a]
            there = x != _FAR
        else:
            a = np.where(there, a, 0)
            x = _mixed((sums[np.minimum(a + LONG, n)] - sums[a]) * down[a])
        packed |= np.where(there, np.maximum(_mixed(x * _MIX) >> np.uint64(48), np.uint64(1)), np.uint64(0)) << np.uint64(16 * t)
    bits = (words * _MIX >> np.uint64(60)).astype(np.uint32)
    near = np.zeros(len(at), dtype=np.uint32)
    for j, step in enumerate((-4, -3, -2, -1, k, k + 1, k + 2, k + 3)):
        near |= bits[at + step] << np.uint32(4 * j)
    return mers, doc, pos, packed.view(np.int64), near.view(np.int32)


#: Bits of a position in a packed place; a text of 2 GB, the longest that a row can hold, has fewer words.
POSITION_BITS = 30


class Places:
    """A document and a position as one sortable column: a packed number if ids are close enough together, else a struct."""

    def __init__(self, documents: DataFrame, id_col: str):
        low, high = documents.agg(F.min(f"`{id_col}`"), F.max(f"`{id_col}`")).first()
        self.low = low or 0
        self.packed = low is None or (high - low).bit_length() + POSITION_BITS <= 63
        self.type = "long" if self.packed else "struct<doc:long,pos:int>"

    def make(self, ids: np.ndarray, pos: np.ndarray) -> pa.Array:
        if self.packed:
            return pa.array((ids - self.low) << POSITION_BITS | pos)
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(pos.astype(np.int32))], names=["doc", "pos"])

    def doc(self, place: Column) -> Column:
        return F.shiftright(place, POSITION_BITS) + F.lit(self.low) if self.packed else place["doc"]

    def pos(self, place: Column) -> Column:
        return place.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int") if self.packed else place["pos"]


def seeds(documents: DataFrame, places: Places, id_col: str, text_col: str, k: int, every: int, min_words: int, contexts: bool) -> DataFrame:
    """(h, place) of all seeds, and their contexts if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
            a, size = 0, 0
            for b, t in enumerate(texts):
                size += len(t or "")
                if size >= SHARD_BYTES // 2 or b == len(texts) - 1:
                    h, doc, pos, around, near = seeds_of(*_text_words(texts[a : b + 1]), k, every, min_words, contexts)
                    columns = [pa.array(h.view(np.int64)), places.make(ids[a + doc], pos), pa.array(around), pa.array(near)]
                    yield pa.RecordBatch.from_arrays(columns[: 2 + 2 * contexts], names=["h", "place", "around", "near"][: 2 + 2 * contexts])
                    a, size = b + 1, 0

    return keyed_text(documents, id_col, text_col).where("doc_id is not null").mapInArrow(work, f"h long, place {places.type}" + ", around long, near int" * contexts)


def _links(documents: DataFrame, id_col: str, text_col: str, k: int, every: int, min_words: int) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(doc, pos, rep, rep_pos): occurrences of seeds and, of those alike around them, the first, some more than once; and
    the stored tables that these are read from."""
    places = Places(documents, id_col)
    first, last, here = F.col("first"), F.col("last"), F.col("place")
    both = [F.min("place").alias("first"), F.max("place").alias("last")]
    several = places.doc(first) < places.doc(last)
    # what is shared is a table of its own, so that joins with it can split very common keys
    common = stored(seeds(documents, places, id_col, text_col, k, every, min_words, False).groupBy("h").agg(*both).where(several).select("h"))
    held = stored(seeds(documents, places, id_col, text_col, k, every, min_words, True).join(common, "h"))
    release(documents.sparkSession)
    around = F.array(*(F.shiftrightunsigned("around", 16 * t).bitwiseAND(F.lit(0xFFFF)) for t in range(3)))
    keys = held.select("h", "place", "near", F.posexplode(around).alias("side", "what")).where("what <> 0").select(F.xxhash64("h", "side", "what").alias("key"), "place", "near")
    firsts = stored(keys.groupBy("key").agg(*both, F.min_by("near", "place").alias("first_near")).where(several).select("key", "first", "first_near"))
    unlike = F.col("near").bitwiseXOR(F.col("first_near"))
    unlike = unlike.bitwiseOR(F.shiftrightunsigned(unlike, 2))
    unlike = unlike.bitwiseOR(F.shiftrightunsigned(unlike, 1)).bitwiseAND(F.lit(0x11111111))
    links = keys.join(firsts, "key").where(places.doc(here) != places.doc(first)).where(F.bit_count(unlike) <= 8 - AGREE)
    links = links.select(places.doc(here).alias("doc"), places.pos(here).alias("pos"), places.doc(first).alias("rep"), places.pos(first).alias("rep_pos"))
    return links, (common, held, firsts)


# --- chains ----------------------------------------------------------------------------------------------------------


class Fenwick:
    """Prefix maxima of (value, number) by rank."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, at: int, value: float, number: int) -> None:
        at += 1
        while at < len(self.best):
            if self.best[at][0] < value:
                self.best[at] = (value, number)
            at += at & -at

    def top(self, at: int) -> tuple[float, int]:
        """Greatest value at ranks below at."""
        out = (-np.inf, -1)
        while at > 0:
            out = max(out, self.best[at])
            at -= at & -at
        return out


def chain(segments: list[tuple[int, int, int, int]], cost: float = GAP_COST) -> list[list[int]]:
    """Best collinear chains of segments (x0, x1, y0, y1), ends exclusive, each segment in one chain at most.

    A chain scores its segments' lengths less cost for each word of a gap on either side.
    """
    n = len(segments)
    order = sorted(range(n), key=lambda i: segments[i])
    ends = sorted(range(n), key=lambda i: segments[i][1])
    ranks = {y: r for r, y in enumerate(sorted({s[3] for s in segments}))}
    heights = np.array(sorted(ranks))
    tree, score, before, done = Fenwick(len(ranks)), [0.0] * n, [-1] * n, 0
    for i in order:
        x0, x1, y0, _ = segments[i]
        while done < n and segments[ends[done]][1] <= x0:
            e = ends[done]
            if score[e] > 0:
                tree.put(ranks[segments[e][3]], score[e] + cost * (segments[e][1] + segments[e][3]), e)
            done += 1
        value, number = tree.top(int(np.searchsorted(heights, y0, "right")))
        gain = value - cost * (x0 + y0)
        score[i] = x1 - x0
        if gain > 0:
            score[i] += gain
            before[i] = number
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(own[::-1])
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole pairs' links, each once, from batches that are sorted by pair and place."""
    held: list[np.ndarray] = []
    for b in batches:
        new = [b.column(j).to_numpy(zero_copy_only=False) for j in range(4)]
        own = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not len(own[0]):
            continue
        once = np.r_[True, np.any([np.diff(x) != 0 for x in own], axis=0)]
        own = [x[once] for x in own]
        last = int(np.flatnonzero(np.r_[True, (np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)])[-1])
        if last:
            yield tuple(x[:last] for x in own)
        held = [x[last:] for x in own]
    if held and len(held[0]):
        yield tuple(held)


def chains(links: DataFrame, k: int, cost: float) -> DataFrame:
    """(doc, rep, segments): merged links of each chain, as (chain, x0, x1, y0, y1). A task holds one pair's links and a batch."""
    rows = links.repartition("doc", "rep").sortWithinPartitions("doc", "rep", "pos", "rep_pos").select("doc", "rep", "pos", "rep_pos")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for doc, rep, pos, rep_pos in _pairs(batches):
            pair = np.r_[True, (np.diff(doc) != 0) | (np.diff(rep) != 0)]
            diagonal, step = pos - rep_pos, np.r_[0, np.diff(pos)]
            new = pair | np.r_[True, np.diff(diagonal) != 0] | (step > NEAR)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(doc)] - 1
            x0, x1, y0, y1 = pos[first], pos[last] + k, rep_pos[first], rep_pos[last] + k
            head = np.flatnonzero(pair[first])
            out: list[tuple[int, int, list[int]]] = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(first)], strict=True):
                d, r = int(doc[first[a]]), int(rep[first[a]])
                if b - a == 1:
                    out.append((d, r, [0, int(x0[a]), int(x1[a]), int(y0[a]), int(y1[a])]))
                    continue
                own = list(zip(x0[a:b].tolist(), x1[a:b].tolist(), y0[a:b].tolist(), y1[a:b].tolist(), strict=True))
                flat: list[int] = []
                for c, members in enumerate(chain(own, cost)):
                    for i in members:
                        flat += [c, *own[i]]
                out.append((d, r, flat))
            for a in range(0, len(out), 2000):
                d, r, s = zip(*out[a : a + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(s, kind)], names=["doc", "rep", "segments"])

    return rows.mapInArrow(work, "doc long, rep long, segments array<int>")


# --- alignment -------------------------------------------------------------------------------------------------------


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each word of a, the places of b that make no common subsequence with it longer, as bits."""
    every = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    row = every
    for w in a:
        both = row & places.get(w, 0)
        row = (row + both | row - both) & every
        yield row


def _read(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, read from the table's end."""
    rows = list(_rows(a, b))
    x, y, out = len(a), len(b), []
    while x and y:
        if rows[x - 1] >> y - 1 & 1:
            y -= 1
            continue
        x -= 1
        if not x or rows[x - 1] >> y - 1 & 1:
            y -= 1
            out.append((x, y))
    return out[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each start of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.r_[0, np.cumsum(1 - bits[: len(b)].astype(np.int64))]


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of a longest common subsequence. Halves are matched one by one where the table has over TABLE_BITS."""
    if len(a) <= 2 * BLOCK and len(b) <= 2 * BLOCK:  # not worth a set operation
        found = np.array(_read(a.tolist(), b.tolist()), dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    i, j = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    a, b = a[i], b[j]
    if not len(a):
        return i, j
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        at = int((_lengths(a[:half].tolist(), b.tolist()) + _lengths(a[half:][::-1].tolist(), b[::-1].tolist())[::-1]).argmax())
        (x0, y0), (x1, y1) = _common(a[:half], b[:at]), _common(a[half:], b[at:])
        return i[np.r_[x0, half + x1]], j[np.r_[y0, at + y1]]
    found = np.array(_read(a.tolist(), b.tolist()), dtype=np.int64).reshape(-1, 2)
    return i[found[:, 0]], j[found[:, 1]]


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Places of equal words from the start on, how many of them outweigh the words between them (the others do so but for
    SLACK), and whether a ended before that was clear."""
    xs: list[int] = []
    ys: list[int] = []
    x = y = score = best = kept = far = 0
    while x < len(a) and y < len(b) and best - score <= DROP:
        n = min(len(a) - x, len(b) - y, 64 * BLOCK)
        differ = np.flatnonzero(a[x : x + n] != b[y : y + n])
        run = int(differ[0]) if len(differ) else n
        if run:
            xs += range(x, x + run)
            ys += range(y, y + run)
            x, y, score = x + run, y + run, score + run
        else:
            block = _read(a[x : x + BLOCK].tolist(), b[y : y + BLOCK].tolist())
            if not block:
                score -= BLOCK
                break
            px = py = -1
            for u, v in block:
                score += 2 - max(u - px, v - py)
                px, py = u, v
                xs.append(x + u)
                ys.append(y + v)
                if score > best:
                    best, kept = score, len(xs)
                if best - score <= SLACK:
                    far = len(xs)
            x, y = x + px + 1, y + py + 1
        if score > best:
            best, kept = score, len(xs)
        if best - score <= SLACK:
            far = len(xs)
    return np.array(xs[:far], dtype=np.int64), np.array(ys[:far], dtype=np.int64), kept, len(a) - x < BLOCK and y < len(b) and best - score <= DROP


def align(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, slice, tuple[bool, bool]]:
    """Places of a chain's equal words in both texts, beyond its ends as far as words agree, the slice of them that does not
    count on SLACK, and whether the first text ended while words still agreed, on either side."""
    xs, ys = [], []

    def add(x: int, y: int, at: tuple[np.ndarray, np.ndarray]) -> None:
        xs.append(x + at[0])
        ys.append(y + at[1])

    def between(x1: int, y1: int) -> None:
        if x1 > x and y1 > y and max(x1 - x, y1 - y) > 1:
            add(x, y, _common(a[x:x1], b[y:y1]))

    x, _, y, _ = segments[0]
    u, v, kept, over_left = _extend(a[:x][::-1], b[:y][::-1])
    add(x, y, (-1 - u[::-1], -1 - v[::-1]))
    left = len(u) - kept
    for x0, x1, y0, y1 in segments:
        # Equal words of a link's length are certain; what lies between them is measured in the same way as gaps.
        ends = np.r_[-1, np.flatnonzero(a[x0:x1] != b[y0:y1]), x1 - x0]
        for r in np.flatnonzero(np.diff(ends) > K).tolist():
            begin, n = int(ends[r]) + 1, int(ends[r + 1] - ends[r]) - 1
            between(x0 + begin, y0 + begin)
            add(x0 + begin, y0 + begin, (np.arange(n),) * 2)
            x, y = x0 + begin + n, y0 + begin + n
        between(x1, y1)
        x, y = x1, y1
    u, v, kept, over_right = _extend(a[x:], b[y:])
    add(x, y, (u, v))
    xs, ys = np.concatenate(xs), np.concatenate(ys)
    return xs, ys, slice(left, len(xs) - len(u) + kept), (over_left, over_right)


def parts(xs: np.ndarray, ys: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, likeness) of an aligned chain if it is alike enough, else of its longest parts that are.

    A part begins and ends with equal words; one within another that is alike enough is left out, others may overlap.
    """
    if len(xs) < similarity * min_words:
        return []
    x0, x1, y0, y1 = int(xs[0]), int(xs[-1]) + 1, int(ys[0]), int(ys[-1]) + 1
    like = len(xs) / max(x1 - x0, y1 - y0)
    if like >= similarity:
        return [(x0, x1, y0, y1, like)] if min(x1 - x0, y1 - y0) >= min_words else []
    # Equal words in a row only add to likeness, so parts begin and end where such runs do.
    step = np.flatnonzero((np.diff(xs) != 1) | (np.diff(ys) != 1))
    head, tail = np.r_[0, step + 1], np.r_[step, len(xs) - 1]
    xa, ya, xb, yb = xs[head], ys[head], xs[tail] + 1, ys[tail] + 1
    # The last run that can end a part from each run on: no later one makes up for the words that differ.
    last = np.full(len(head), len(head) - 1)
    for begin, end in ((xa, xb), (ya, yb)):
        highest = np.maximum.accumulate((tail + 1 - similarity * end)[::-1])
        last = np.minimum(last, len(head) - 1 - np.searchsorted(highest, head - similarity * begin - 1e-6))
    out, done = [], -1
    for r in range(len(head)):
        low = max(r, done + 1)
        if last[r] < low:
            continue
        own = slice(low, last[r] + 1)
        share = (tail[own] + 1 - head[r]) / np.maximum(xb[own] - xa[r], yb[own] - ya[r])
        fit = np.flatnonzero(share >= similarity)
        if len(fit):
            done = low + int(fit[-1])
            if min(xb[done] - xa[r], yb[done] - ya[r]) >= min_words:
                out.append((int(xa[r]), int(xb[done]), int(ya[r]), int(yb[done]), float(share[fit[-1]])))
    return out


def _with_slices(pairs: DataFrame, texts: DataFrame, reach: int | None) -> DataFrame:
    """Pairs with the words of doc from `reach` before the first link to `reach` behind the last (all words without one).

    start: words before the slice; left, right: whether words are missing on that side.
    """
    joined = pairs.join(texts.select(F.col("doc_id").alias("doc"), F.col("text").alias("a")), "doc").select("doc", "rep", "segments", "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raw, starts, ends = None, b"", None, None
        for batch in batches:
            keep, slices, begin, left, right = [], [], [], [], []
            for k, (flat, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last is None or text != last:
                    last, raw = text, (text or "").encode("utf-8", "surrogatepass")
                    starts, ends, _ = split_words(_LOWER[np.frombuffer(raw, dtype=np.uint8)], np.array([0, len(raw)]))
                low, high = min(flat[1::5]), max(flat[2::5])
                if high > len(starts):
                    continue  # another row of a repeated id
                if reach is None:
                    low, high = 0, len(starts)
                else:
                    low, high = max(0, low - reach), min(len(starts), high + reach)
                keep.append(k)
                slices.append(raw[starts[low] : ends[high - 1]])
                begin.append(low)
                left.append(low > 0)
                right.append(high < len(starts))
            part = batch.take(pa.array(keep, pa.int64()))
            made = [pa.array([s.decode("utf-8", "surrogatepass") for s in slices], pa.string()), pa.array(begin, pa.int32()), pa.array(left, pa.bool_()), pa.array(right, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(3)), *made], names=["doc", "rep", "segments", "a", "start", "left", "right"])

    return joined.mapInArrow(work, "doc long, rep long, segments array<int>, a string, start int, left boolean, right boolean")


def _aligned(pairs: DataFrame, texts: DataFrame, reach: int | None, min_words: int, similarity: float) -> DataFrame:
    """Parts of aligned chains that are long and alike enough, and any chain whose alignment came to the edge of a slice (`open`)."""
    both = _with_slices(pairs, texts, reach).join(texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("b")), "rep")
    both = both.select("doc", "rep", "segments", "a", "start", "left", "right", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "rep", "x0", "x1", "y0", "y1", "likeness", "open"]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.bool_()]
        last, b = None, None
        for batch in batches:
            out = []
            for d, r, flat, ta, start, left, right, tb in zip(*(batch.column(j).to_pylist() for j in range(8)), strict=True):
                a, _ = _text_words([ta])
                if last is None or tb != last:
                    last, (b, _) = tb, _text_words([tb])
                own: dict[int, list[tuple[int, int, int, int]]] = {}
                for i in range(0, len(flat), 5):
                    c, x0, x1, y0, y1 = flat[i : i + 5]
                    own.setdefault(c, []).append((x0 - start, x1 - start, y0, y1))
                done: list[tuple[int, int, int, int]] = []
                for segments in own.values():  # the best ones first
                    if any(x0 <= segments[0][0] and segments[-1][1] <= x1 for x0, x1, _, _ in done) and any(y0 <= segments[0][2] and segments[-1][3] <= y1 for _, _, y0, y1 in done):
                        continue  # within passages of this pair on both sides
                    if segments[-1][3] > len(b):
                        continue  # another row of a repeated id
                    xs, ys, sure, over = align(a, b, segments)
                    if left and over[0] or right and over[1]:
                        out.append((d, r, start, start, 0, 0, 0.0, True))
                        continue
                    for x0, x1, y0, y1, like in parts(xs[sure], ys[sure], min_words, similarity) or parts(xs, ys, min_words, similarity):
                        done.append((x0, x1, y0, y1))
                        out.append((d, r, x0 + start, x1 + start, y0, y1, like, False))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return both.mapInArrow(work, "doc long, rep long, x0 int, x1 int, y0 int, y1 int, likeness double, open boolean")


def passages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, every: int = EVERY, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, cost: float = GAP_COST, reach: int | None = REACH) -> DataFrame:
    """(doc, rep, x0, x1, y0, y1, likeness): passages, as word ranges, that a document shares with an earlier one.

    Passages have min_words words or more on both sides, of which the share `similarity` at least is equal and in one
    order. Rows without an id take no part; rows of one id count as one document; null and short texts have no passages;
    repeats within a document do not count.
    """
    small_batches(documents.sparkSession)
    links, tables = _links(documents, id_col, text_col, k, every, min_words)
    pairs = cut(chains(links, k, cost))
    discard(*tables)
    release(documents.sparkSession)
    texts = keyed_text(documents, id_col, text_col).where("doc_id is not null")
    found = cut(_aligned(pairs, texts, reach, min_words, similarity))
    again = cut(found.where("open").select("doc", "rep").distinct())
    n = again.count()
    if n:  # words beyond a slice agree too: align these pairs' whole texts
        if n <= FEW:  # 16 bytes each, so their ids can be sent to the texts
            ids = again.select(F.explode(F.array("doc", "rep")).alias("doc_id")).distinct()
            texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
        whole = _aligned(pairs.join(again, ["doc", "rep"], "left_semi"), texts, None, min_words, similarity)
        found = cut(found.join(again, ["doc", "rep"], "left_anti").unionByName(whole))
    return found.drop("open")


def repeated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Repeated passages of each row of documents.

    passages: merged word ranges, start:end, comma-joined; n_words in them; n_links: documents linked directly; class_id:
    the least id that links lead to, the own one without any. Null ids have no passages and no class.
    """
    found = passages(documents, id_col=id_col, text_col=text_col, **options)
    sides = found.select("doc", "x0", "x1").unionByName(found.select(F.col("rep").alias("doc"), F.col("y0").alias("x0"), F.col("y1").alias("x1")))
    starts = sides.groupBy("doc", "x0").agg(F.max("x1").alias("x1"))  # no more rows than the document has words
    by = Window.partitionBy("doc").orderBy("x0")
    new = F.coalesce(F.col("x0") > F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = starts.withColumn("new", new.cast("int")).withColumn("number", F.sum("new").over(by))
    spans = spans.groupBy("doc", "number").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    merged = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("spans"))
    ends = found.select("doc", "rep").distinct()
    n_links = ends.select("doc").unionByName(ends.select(F.col("rep").alias("doc"))).groupBy("doc").agg(F.count("*").alias("n_links"))
    classes = connected(ends, "doc", "rep").select(F.col("node").alias("doc"), F.col("root").alias("class_id"))
    facts = merged.join(n_links, "doc").join(classes, "doc")
    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"))
    return rows.join(facts, rows["doc_id"] == facts["doc"], "left").select(
        "doc_id",
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["x0"], s["x1"])), ","), F.lit("")).alias("passages"),
        F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["x1"] - s["x0"]), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"),
    )
