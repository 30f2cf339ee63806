"""Benchmark decontamination by suffix arrays over shards of the training texts.

A task cuts its documents into shards of SHARD_BYTES, maps each shard's words to the vocabulary of the test items and
sorts the suffixes of the shard. Every test suffix that can start a window is then searched for by bisection, one word
deeper at a time, which gives its longest verbatim match and all the places where its first window stands. A training
position enters the array only if enough words of the test vocabulary follow it to complete a window; this leaves out
nothing that could match. Texts are never shuffled: only the test set travels, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import BATCH_BYTES, filter_rows, keyed_text, small_batches

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Words of the test items in one broadcast block (some 30 MB). Larger test sets are searched for block by block.
BLOCK_WORDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once lower-cased: digits, letters and all bytes of non-ASCII characters.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

OUT = (
    "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>, "
    "longest long, longest_at long, longest_item string, longest_item_at long"
)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        steps = [np.full(max(n, SHARD_BYTES + 1), x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        _POWERS[base] = np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)
    return _POWERS[base]


def split_words(data: np.ndarray, offsets: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes, and 64-bit hashes; no word crosses one of the offsets."""
    n = len(data)
    mask = _IS_WORD[data]
    first, last = mask.copy(), mask.copy()
    if n:
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1, base)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, hashes ^ (hashes >> np.uint64(29))


class TestBlock:
    """Test items, ready for search: word ids, vocabulary, and the suffixes that can start a window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, base: int = _BASE):
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
        data = _LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.bytes, self.base = data, base
        while True:  # until no two words have one hash
            starts, ends, hashes = split_words(data, offsets, self.base)
            self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
            self.word_start, self.word_len = np.r_[0, starts[first]], np.r_[0, ends[first] - starts[first]]
            if not self.differs(ids + 1, data, starts, ends).any():
                break
            self.base = (self.base * 5 + 2) % (1 << 64) | 1
        vocab = self.vocab
        bounds = np.searchsorted(starts, offsets)
        self.longest = 0
        parts, q_start, q_window, q_item, q_at, at = [], [], [], [], [], 0
        for k, (name, _) in enumerate(items):
            own = ids[bounds[k] : bounds[k + 1]] + 1
            n = len(own)
            if not n:
                continue
            w = min(window, n)
            here = np.arange(n - w + 1)
            q_start.append(at + here)
            q_at.append(here)
            q_window.append(np.full(len(here), w))
            q_item.append(np.full(len(here), number[name]))
            parts.append(np.r_[own, 0])
            at += n + 1
            self.longest = max(self.longest, n)
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
        self.tokens = np.r_[cat(parts), np.zeros(1, dtype=np.int64)]
        self.q_start, self.q_window, self.q_item, self.q_at = cat(q_start), cat(q_window), cat(q_item), cat(q_at)
        self.least = np.full(len(vocab) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.tokens[self.q_start], self.q_window)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[vocab >> np.uint64(44)] = True

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.zeros(len(hashes), dtype=np.int64)
        may = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        if len(may):
            at = np.searchsorted(self.vocab, hashes[may])
            at[at == len(self.vocab)] = 0
            same = self.vocab[at] == hashes[may]
            ids[may[same]] = at[same] + 1
        return ids

    def differs(self, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word's bytes differ from those of the test word with its id."""
        lens = ends - starts
        bad = lens != self.word_len[ids]
        left = np.flatnonzero(~bad)
        for k in range(int(lens.max(initial=0))):
            left = left[lens[left] > k]
            wrong = data[starts[left] + k] != self.bytes[self.word_start[ids[left]] + k]
            bad[left[wrong]] = True
            left = left[~wrong]
        return bad


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first depth tokens at least, by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and rank.max(initial=0) < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        there = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, there[1:] != there[:-1]])
        k *= 2
    return order


def _bisect(words: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, after: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        got = words[order[mid] + depth]
        right = got <= want[open_] if after else got < want[open_]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(block: TestBlock, words: np.ndarray, order: np.ndarray):
    """Longest match of every test suffix (its length and range in order), and the range where its window stands."""
    n = len(block.q_start)
    best, best_lo, best_hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    win_lo, win_hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    alive = np.arange(n)
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(order), dtype=np.int64)
    heads = words[order]
    depth = 0
    while len(alive):
        want = block.tokens[block.q_start[alive] + depth]
        if depth:
            new_lo = _bisect(words, order, lo, hi, depth, want, False)
            new_hi = _bisect(words, order, new_lo, hi, depth, want, True)
        else:
            new_lo, new_hi = np.searchsorted(heads, want, "left"), np.searchsorted(heads, want, "right")
        keep = (new_lo < new_hi) & (want > 0)
        alive, lo, hi = alive[keep], new_lo[keep], new_hi[keep]
        depth += 1
        best[alive], best_lo[alive], best_hi[alive] = depth, lo, hi
        full = block.q_window[alive] == depth
        win_lo[alive[full]], win_hi[alive[full]] = lo[full], hi[full]
    return best, best_lo, best_hi, win_lo, win_hi


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which range, and which number in it, for all numbers of all ranges, a bounded count at a time."""
    size = hi - lo
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, most):
        number = np.arange(a, min(a + most, total))
        which = np.searchsorted(ends, number, "right")
        yield which, lo[which] + number - (ends[which] - size[which])


def scan(data: np.ndarray, offsets: np.ndarray, blocks, most: int = 1 << 20) -> list[dict]:
    """Search one shard of documents (bytes and their offsets) for the test items of all blocks."""
    data = _LOWER[data]
    starts, ends, hashes = split_words(data, offsets)
    base = _BASE
    n_docs, n_words = len(offsets) - 1, len(starts)
    bounds = np.searchsorted(starts, offsets)
    out = [{"n_words": int(b - a), "items": set(), "longest": 0, "longest_at": None, "longest_item": None, "longest_item_at": None} for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    cover = np.zeros(n_words + 1, dtype=np.int64)
    begins = np.zeros(n_words + 1, dtype=bool)
    begins[bounds] = True
    for block in blocks:
        if block.base != base:
            base, hashes = block.base, split_words(data, offsets, block.base)[2]
        ids = block.word_ids(hashes)
        while True:
            at = np.flatnonzero(ids)
            if not len(at):
                break
            new = np.r_[True, np.diff(at) != 1] | begins[at]
            run = np.cumsum(new) - 1
            stop = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]] + 1
            can = stop[run] - at >= block.least[ids[at]]
            used = np.zeros(len(stop), dtype=bool)
            used[run[can]] = True
            part = used[run]
            bad = block.differs(ids[at[part]], data, starts[at[part]], ends[at[part]])
            if not bad.any():
                break
            ids[at[part][bad]] = 0
        if not len(at) or not part.any():
            continue
        # the used runs one after the other, with a 0 behind each
        shift = np.cumsum(new[part]) - 1
        place = np.arange(int(part.sum())) + shift
        words = np.zeros(len(place) + int(shift[-1]) + 1 + block.longest + 1, dtype=np.int64)
        words[place] = ids[at[part]]
        origin = np.full(len(words), -1)
        origin[place[can[part]]] = at[part][can[part]]
        order = suffix_array(words[: len(words) - block.longest - 1], block.longest)
        order = order[origin[order] >= 0]
        best, best_lo, best_hi, win_lo, win_hi = search(block, words, order)
        hit = np.flatnonzero(win_lo < win_hi)
        if not len(hit):
            continue
        pairs = set()
        for which, number in _ranges(win_lo[hit], win_hi[hit], most):
            pos, q = origin[order[number]], hit[which]
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + block.q_window[q], -1)
            doc = np.searchsorted(bounds, pos, "right") - 1
            pairs.update(np.unique(doc * len(block.names) + block.q_item[q]).tolist())
        for pair in pairs:
            out[pair // len(block.names)]["items"].add(block.names[pair % len(block.names)])
        for which, number in _ranges(best_lo[hit], best_hi[hit], most):
            pos, q = origin[order[number]], hit[which]
            doc = np.searchsorted(bounds, pos, "right") - 1
            rank = np.lexsort((q, pos, -best[q], doc))
            lead = rank[np.r_[True, np.diff(doc[rank]) != 0]]
            for d, p, k in zip(doc[lead].tolist(), pos[lead].tolist(), q[lead].tolist(), strict=True):
                if best[k] > out[d]["longest"]:
                    out[d] |= {"longest": int(best[k]), "longest_at": int(p - bounds[d]), "longest_item": block.names[block.q_item[k]], "longest_item_at": int(block.q_at[k])}
    hit = np.cumsum(cover[:-1]) > 0
    total = np.r_[0, np.cumsum(hit)]
    for d in range(n_docs):
        a, b = int(bounds[d]), int(bounds[d + 1])
        out[d]["n_hit"] = n = int(total[b] - total[a])
        edge = np.flatnonzero(np.diff(np.r_[0, hit[a:b].view(np.int8), 0])) if n else np.zeros(0, dtype=np.int64)
        out[d]["spans"] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)]
        out[d]["items"] = sorted(out[d]["items"])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list:
    """Broadcast the test items in blocks of some block_words words; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    blocks, own, size = [], [], 0
    for row in rows.toLocalIterator():
        own.append((row["id"], row["text"]))
        size += len(row["text"])
        if size >= 6 * block_words:
            blocks.append(sc.broadcast(TestBlock(own, window)))
            own, size = [], 0
    if own:
        blocks.append(sc.broadcast(TestBlock(own, window)))
    return blocks


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Verbatim matches of test items in every document.

    One row for each row of documents: doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted
    ids, as strings, of items with occurring windows), spans (ranges of hit words), and the longest match: its length,
    its place in the document, its item and its place there. A document without words, null text included, has zeros
    and no items; items without words match nothing; an item whose id is null counts under the empty id; repeated rows
    and ties are each answered alike; an empty test set hits nothing.
    """
    scanned = _scanner(documents, benchmark, item_col, item_text_col, window, block_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scanned(batch.column(1))
            names = ["n_words", "n_hit", "items", "spans", "longest", "longest_at", "longest_item", "longest_item_at"]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], type=t) for k, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *names])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, OUT)


def _scanner(documents: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int):
    """A function that scans an Arrow array of texts, shard by shard."""
    small_batches(documents.sparkSession)
    shared = _blocks(benchmark, item_col, item_text_col, window, block_words)

    def loaded():
        for b in shared:
            yield b.value
            if len(shared) > 1:  # hold one block at a time
                b.__dict__.pop("_value", None)

    def scanned(texts: pa.Array) -> list[dict]:
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        _, where, raw = texts.buffers()
        where = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        # of several blocks each is loaded once a batch
        rows, a, size = [], 0, SHARD_BYTES if len(shared) < 2 else BATCH_BYTES
        while a < n:
            b = max(a + 1, int(np.searchsorted(where, where[a] + size, "right")) - 1)
            rows += scan(raw[where[a] : where[b]], where[a : b + 1] - where[a], loaded())
            a = b
        return rows

    return scanned


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of documents, with all their columns, that no window of a test item occurs in."""
    scanned = _scanner(documents, benchmark, item_col, item_text_col, window, block_words)
    return filter_rows(documents, text_col, lambda texts: [r["n_hit"] == 0 for r in scanned(pa.array(texts, pa.string()))])


def with_digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items; the spans and longest matches stay with find_contamination."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

