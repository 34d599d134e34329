"""Near-duplicate records by pigeonring filtering.

Two word sets with Jaccard similarity t or more differ in at most H = (1-t)/(1+t) * (|x|+|y|) words, the Hamming distance of
their word vectors. Three steps, none of which loses a pair:

1. First box. The words are in one order, the rarest first, and a word in more than so many records is frequent. Similar sets
   that share a rare word have the first such word within the first |x| - ceil(t|x|) + 1 of each, so these words are keys.
   Sets that share none have spent both sides' rare words of the budget H. What is left, the words of x that y may lack and
   those of y that x may lack, is below zero for most records and sizes of partner, and a few words for the others. Their
   frequent words are dealt into so many boxes and one more: in one box at least the sets agree in full, so each box is a
   key. Where that would join too many, k boxes more are dealt and k together make a key. Both sides take the boxes of each
   cell (size class and budget level of the one, of the other) in which the whole table has records on the other side.
   Words are in more records as the table grows; were the limit of frequency fixed, few words would stay rare and a set
   would need thousands of boxes. A sample tells at which limit the keys and the meetings cost least; none loses a pair.
2. Ring. The word vector is folded into SEGMENTS segments of parity bits. If the segments together differ in at most H
   bits, there is a segment from which on every chain of l consecutive segments differs in at most l * H / SEGMENTS bits.
   Candidates without such a start are pruned, chain by chain.
3. The full check counts the shared words of what is left.

Equal word sets are one class before that, so copies never meet each other in the join. Keys travel packed, one row for
each slice of records and bucket, and meet inside a bucket by sorting. What a task holds is bounded by words, keys and pairs,
not by records: slices end after so many words or keys, the number of buckets follows the number of keys, which the budgets
tell beforehand, and a bucket's pairs leave it in parts.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import Scratch

#: Bins of the word counts, one byte each: 32 for each record, at least and at most so many bits of them (64 MB at the most).
LEAST_BITS, MOST_BITS = 18, 26
#: A word in more records than this is no key by itself: one of these limits, as a sample of the records tells.
HOTS = (128, 512, 2048, 8192, 32768)
#: Records that may be expected to agree in a key of boxes.
HOT = 128
#: Records in that sample, their characters at most, and how many meetings a key costs.
SAMPLE, SAMPLE_CHARS, KEY_COST = 1000, 20_000, 20
#: Keys of one record for one cell at most, where more boxes to a key would not pay.
MOST_KEYS = 256
#: Segments of the ring, of 16 parity bits each.
SEGMENTS = 8
#: Keys in one join partition; the number of partitions follows the number of keys.
KEYS_A_BUCKET = 500_000
#: Words, and keys, that are worked on at a time; a record with more of them is worked on alone.
WORDS_A_SLICE, KEYS_A_SLICE = 1 << 19, 1 << 18
#: Meetings that are tested at a time, and pairs that a task gathers before they leave it.
MEETINGS_A_STEP, PAIRS_A_PART = 1 << 17, 1 << 18
#: Sizes of one class differ by less than this factor.
CLASS = 1.06
#: Records of a class that may share their members' pairs in one task.
SHARD = 2_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def words(*columns: str):
    """The distinct words of the columns together: runs of a-z, 0-9 or _ after lower-casing; null counts as empty."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), 0))


def _scaled(count):
    """A count on a scale of eighths of its logarithm, one byte: 0 for 0, 8 for 1; the same order as the counts themselves."""
    return np.minimum(255, np.round(8 * np.log2(np.asarray(count, float) + 1))).astype(np.uint8)


def _pack_counts(b: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(4096, np.uint8)
    out[b["bin"].to_numpy() & 4095] = _scaled(b["n"].to_numpy())
    return pd.DataFrame({"part": [int(b["bin"].iloc[0]) >> 12], "counts": [out.tobytes()]})


def word_bins(numbers: DataFrame, n: int) -> np.ndarray:
    """In how many records the words of each bin occur, scaled to a byte. Every record counts; sums are partial before the shuffle."""
    bits = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(32 * max(n, 1)))))
    counted = numbers.select(F.explode("ws").alias("w")).groupBy(F.shiftrightunsigned("w", 64 - bits).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(F.shiftright("bin", 12).alias("part")).applyInPandas(_pack_counts, "part int, counts binary")
    bins = np.zeros(1 << bits, np.uint8)
    for r in packed.toLocalIterator():
        bins[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(bytes(r.counts), np.uint8)
    return bins


def _bin(word: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(64 - (len(bins).bit_length() - 1))).astype(np.int64)


def size_class(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / math.log(CLASS) + 1e-9).astype(np.int64)


def _low(cls: np.ndarray) -> np.ndarray:
    """No size of a class is less."""
    return np.floor(CLASS**cls + 1e-6).astype(np.int64)


def _overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Words that sets of these sizes share at least, if they are similar."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def partners(size: np.ndarray, rare: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, own class, partner's class, budget) for each class of sizes in which a record that shares no rare word could have a partner."""
    first, last = size_class(np.ceil(t * size - 1e-9)), size_class(np.floor(size / t + 1e-9))
    many = last - first + 1
    rec = np.repeat(np.arange(len(size)), many)
    other = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(rec))
    least = np.maximum(_low(other), np.ceil(t * size[rec] - 1e-9).astype(np.int64))
    budget = size[rec] - rare[rec] - _overlap(size[rec], least, t)
    some = budget >= 0
    rec, other, budget = rec[some], other[some], budget[some]
    return rec, size_class(size[rec]), other, level(budget)


def level(budget: np.ndarray) -> np.ndarray:
    """A budget as it is up to 4, then rounded up to 6, 8, 12, 16, 24 ..., so that few levels occur."""
    half = 1 << np.maximum(np.floor(np.log2(np.maximum(budget - 1, 1))).astype(np.int64) - 1, 0)
    return np.where(budget <= 4, budget, -(-budget // half) * half)


FEATURES = "cid bigint, size int, rare int, sketch binary, plain binary, frequent binary, budgets array<struct<own:int,other:int,level:int,n:int>>"


def slices(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of successive slices of records, each of `most` weight at most or one record."""
    total, a = np.r_[0, np.cumsum(weight)], 0
    while a < len(weight):
        z = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, z
        a = z


def _binaries(numbers: np.ndarray, many: np.ndarray) -> pa.Array:
    """One binary for each record, of the next many[r] numbers."""
    ends = np.r_[0, np.cumsum(many * numbers.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])


def _features(bins: np.ndarray, t: float, hot: int):
    """A function for mapInArrow: (cid, ws) batches to a row for each record; the first row of a slice has the budgets of all."""
    warm, single = int(_scaled(hot)), int(_scaled(1))

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("ws")
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten().to_numpy().view(np.uint64)
        c = bins[_bin(flat, bins)]
        flat = _mix(flat)
        rec = np.repeat(np.arange(len(size)), size)
        place = _mix(flat + np.uint64(1))
        segment = rec * SEGMENTS + (place >> np.uint64(61)).astype(np.int64)
        sketch = np.zeros((len(size) * SEGMENTS, 16), np.uint8)
        np.add.at(sketch.reshape(-1), segment * 16 + ((place >> np.uint64(40)) & np.uint64(15)).astype(np.int64), 1)
        sketch = np.packbits(sketch & 1, axis=1).view(np.uint16).reshape(-1)
        # the rarest words first: record, count and the word's leading bits in one number
        order = np.argsort((rec.astype(np.uint64) << np.uint64(40)) | (c.astype(np.uint64) << np.uint64(32)) | (flat >> np.uint64(32)), kind="stable")
        f, c = flat[order], c[order]
        start = np.r_[0, np.cumsum(size)[:-1]]
        pos = np.arange(len(f)) - start[rec]
        p = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
        is_rare = c <= warm
        rare = np.bincount(rec[is_rare], minlength=len(size))
        plain = is_rare & (pos < p[rec]) & (c > single)  # a word of one record only meets nothing
        cell, count = np.unique(np.stack(partners(size, rare, t)[1:], 1), axis=0, return_counts=True)
        budgets = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (*cell.T, count)], ["own", "other", "level", "n"])
        columns = [
            b.column("cid").cast(pa.int64()), pa.array(size, pa.int32()), pa.array(rare, pa.int32()), _binaries(sketch, np.full(len(size), SEGMENTS)),
            _binaries(f[plain], np.bincount(rec[plain], minlength=len(size))), _binaries(f[~is_rare], size - rare), pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(len(size), len(count))], pa.int32()), budgets),
        ]
        return pa.RecordBatch.from_arrays(columns, names="cid size rare sketch plain frequent budgets".split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, z in slices(np.diff(b.column("ws").offsets.to_numpy()), WORDS_A_SLICE):
                yield features(b.slice(x, z - x))

    return run


def boxes(word: np.ndarray, many: np.ndarray, rec: np.ndarray, m: int) -> np.ndarray:
    """For each of the records `rec` its words in m boxes, each box as one number; record r has the next many[r] of `word`."""
    start = (np.cumsum(many) - many)[rec]
    at = np.repeat(start - (np.cumsum(many[rec]) - many[rec]), many[rec]) + np.arange(int(many[rec].sum()))
    w = word[at]
    cell = np.repeat(np.arange(len(rec)) * m, many[rec]) + ((w >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    out = np.zeros(len(rec) * m, np.uint64)
    if len(cell):
        order = np.argsort(cell, kind="stable")
        cell, w = cell[order], _mix(w[order])
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out[cell[first]] = np.add.reduceat(w, first)
    return out.reshape(-1, m)


def together(crowd: int, words: int, spent: int, hot: int) -> int:
    """How many boxes make one key: as few as let no more than `hot` of `crowd` records be expected to agree in them by chance.

    Of spent + k boxes, k at least agree. A word is taken to agree by chance in two of three cases; this only decides on costs.
    """
    k = 1
    while crowd * (2 / 3) ** (words * k / (spent + k)) > hot and k < 4 and math.comb(spent + k + 1, k + 1) <= MOST_KEYS:
        k += 1
    return k


def _seed(*numbers: int) -> int:
    """One number for a pair of cells."""
    out = 0
    for x in numbers:
        out = (out * 1_000_003 + x + 1) & 0xFFFFFFFFFFFFFFFF
    return out


def choose_hot(counts: list[np.ndarray], t: float, n: int) -> int:
    """The limit of word frequency at which keys and meetings cost least. counts: the scaled counts of the words of some of the n records."""
    if not counts:
        return HOT
    size = np.array([len(c) for c in counts])
    c, rec = np.concatenate([np.sort(c) for c in counts]), np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(c)) - (np.cumsum(size) - size)[rec]
    first = pos < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[rec]
    costs = []
    for hot in HOTS:
        is_rare = c <= _scaled(hot)
        plain = c[is_rare & first & (c > _scaled(1))]
        cell, many = np.unique(np.stack(partners(size, np.bincount(rec[is_rare], minlength=len(size)), t)[1:], 1), axis=0, return_counts=True)
        ways = dealing({tuple(x): math.ceil(k * n / len(size)) for x, k in zip(cell.tolist(), many.tolist())}, t, HOT)
        keys = len(plain) + sum(k * keys_of_a_record(ways(*x)) for x, k in zip(cell.tolist(), many.tolist()))
        costs.append(KEY_COST * keys + float((2 ** (plain / 8) - 1).sum()) / 2)
    return HOTS[int(np.argmin(costs))]


def dealing(crowds: dict[tuple[int, int, int], int], t: float, hot: int) -> Callable[[int, int, int], list[tuple[int, int, int]]]:
    """A function that tells how the records of a cell (own class, partner's class, budget level) deal their words: boxes, boxes to a key and seed, once for each level at which the other class has records."""
    facing: dict[tuple[int, int], dict[int, int]] = {}
    for (own, other, lv), c in crowds.items():
        facing.setdefault((own, other), {})[lv] = c
    known: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}

    def ways(x: int, y: int, mine: int) -> list[tuple[int, int, int]]:
        if (x, y, mine) not in known:
            out = known[x, y, mine] = []
            for theirs, n in facing.get((y, x), {}).items():
                spent = mine + theirs
                side = [(x, mine), (y, theirs)] if (x, mine) <= (y, theirs) else [(y, theirs), (x, mine)]
                k = together(min(n, facing[x, y][mine]), int(_overlap(_low(np.int64(x)), _low(np.int64(y)), t)), spent, hot)
                out.append((spent + k, k, _seed(*side[0], *side[1])))
        return known[x, y, mine]

    return ways


def keys_of_a_record(ways: list[tuple[int, int, int]]) -> int:
    return sum(math.comb(m, k) for m, k, _ in ways)


def _keys(crowds: dict[tuple[int, int, int], int], t: float, n_buckets: int, hot: int, most: float = math.inf):
    """A function for mapInPandas: features to rows of packed keys, one for each bucket and slice of records of at most `most` keys together."""

    def packed(b: pd.DataFrame, rec: np.ndarray, cell: np.ndarray, ways: Callable[[int, int, int], list[tuple[int, int, int]]]) -> pd.DataFrame:
        """b: one slice; rec, cell: its records' cells, sorted by cell."""
        size, rare = b["size"].to_numpy().astype(np.int64), b["rare"].to_numpy().astype(np.int64)
        word, many = np.frombuffer(b"".join(b["frequent"]), np.uint64), size - rare
        keys, owners, made = [np.frombuffer(b"".join(b["plain"]), np.uint64)], [np.repeat(np.arange(len(b), dtype=np.int32), b["plain"].map(len) // 8)], {}
        cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(cell) else []
        for a, z in zip(cuts, [*cuts[1:], len(cell)]):
            for m, k, seed in ways(*map(int, cell[a])):
                made.setdefault((m, k), []).append((rec[a:z], seed))
        for (m, k), wanted in made.items():
            who, seed = np.concatenate([w for w, _ in wanted]), np.repeat(np.array([x for _, x in wanted], np.uint64), [len(w) for w, _ in wanted])
            once, again = np.unique(who, return_inverse=True)
            box = boxes(word, many, once, m)[again]
            some = np.array(list(itertools.combinations(range(m), k)))
            acc = np.broadcast_to(seed[:, None], (len(who), len(some)))
            for i in range(k):
                acc = _mix(acc + box[:, some[:, i]] + some[:, i].astype(np.uint64))
            keys.append(acc.reshape(-1))
            owners.append(np.repeat(who, len(some)).astype(np.int32))
        key, holder = np.concatenate(keys), np.concatenate(owners)
        bucket = ((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        place = bucket * len(b) + holder  # one number for each bucket and record
        order = np.argsort(place, kind="stable")
        key, place = key[order].astype(np.uint32), place[order]
        new = np.r_[True, place[1:] != place[:-1]] if len(place) else np.empty(0, bool)
        bucket, who = np.divmod(place[new], len(b))  # the records of each bucket
        x, start, many_records = np.unique(bucket, return_index=True, return_counts=True)
        nth = np.cumsum(new) - 1
        many_keys = np.bincount(np.repeat(np.arange(len(x)), many_records)[nth], minlength=len(x)).astype(np.int64)
        local = (nth - np.repeat(start, many_keys)).astype(np.int32)
        cid, sketch = b["cid"].to_numpy().astype(np.int64), np.frombuffer(b"".join(b["sketch"]), np.uint16).reshape(-1, SEGMENTS)
        columns = {"keys": (key, many_keys), "owners": (local, many_keys), "cids": (cid[who], many_records), "sketches": (sketch[who].reshape(-1), many_records * SEGMENTS), "sizes": (size[who].astype(np.int32), many_records)}
        return pd.DataFrame({"bucket": x.astype(np.int32)} | {c: _binaries(numbers, n).to_pandas() for c, (numbers, n) in columns.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = dealing(crowds, t, hot)
        for b in batches:
            rec, own, other, lv = partners(b["size"].to_numpy().astype(np.int64), b["rare"].to_numpy().astype(np.int64), t)
            order = np.lexsort((lv, other, own))
            rec, cell = rec[order], np.stack([own, other, lv], 1)[order]
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)]) if len(cell) else np.empty(0, np.int64)
            each = np.repeat([keys_of_a_record(ways(*map(int, cell[a]))) for a in cuts], np.diff(np.r_[cuts, len(cell)]))
            weight = b["plain"].map(len).to_numpy() // 8 + np.bincount(rec, each, len(b)).astype(np.int64)
            for a, z in slices(weight, most):
                mine = (rec >= a) & (rec < z)
                yield packed(b.iloc[a:z], rec[mine] - a, cell[mine], ways)

    return run


def chained(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the ring of sketch segments has a start from which every chain of l segments differs in at most l * h / SEGMENTS bits.

    A sketch segment holds the parity of its words, so it differs in no more bits than the sets differ in words there: no
    pair within h is lost. Chains grow by one segment at a time, for the pairs that still have a start.
    """
    ok = np.zeros(len(h), bool)
    live = np.arange(len(h))
    d = np.bitwise_count(x ^ y).astype(np.int32)
    reach, starts = d, d * SEGMENTS <= h[:, None]
    for l in range(2, SEGMENTS + 1):
        some = starts.any(axis=1)
        live, d, reach, starts = live[some], d[some], reach[some], starts[some]
        reach = reach + np.roll(d, 1 - l, axis=1)
        starts = starts & (reach * SEGMENTS <= l * h[live][:, None])
    ok[live[starts.any(axis=1)]] = True
    return ok


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Value, start and end of each run of equal values."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[at].tolist(), at.tolist(), np.r_[at[1:], len(x)].astype(int).tolist() if len(x) else []


def meet(key: np.ndarray, own: np.ndarray, cid: np.ndarray, sketch: np.ndarray, size: np.ndarray, t: float) -> Iterator[np.ndarray]:
    """Candidate pairs of cids that share a key and pass the chain filter, in parts; a pair may be in several of them."""
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    found, held = [], 0
    step, live = 1, np.flatnonzero(key[1:] == key[:-1])
    while len(live):  # neighbours at distance 1, 2, ... within runs of equal keys; a run of n ends after n - 1 steps
        for at in range(0, len(live), MEETINGS_A_STEP):
            some = live[at : at + MEETINGS_A_STEP]
            x, y = own[some], own[some + step]
            fit = np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9
            x, y = x[fit], y[fit]
            near = chained(sketch[x], sketch[y], (1 - t) / (1 + t) * (size[x] + size[y]) + 1e-9)
            p = np.stack([np.minimum(cid[x], cid[y])[near], np.maximum(cid[x], cid[y])[near]], 1)
            found.append(p[p[:, 0] != p[:, 1]])
            held += len(found[-1])
            if held > PAIRS_A_PART or len(found) > 64:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0])
                if held > PAIRS_A_PART // 2:
                    yield found.pop()
                    held = 0
        step += 1
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
    if held:
        yield np.unique(np.concatenate(found), axis=0)


def _meet(t: float):
    """A function for applyInPandas: the packed keys of one bucket to candidate pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, cid, sketch, size, n = [], [], [], [], [], 0
        for b in batches:
            for r in b.itertuples():
                key.append(np.frombuffer(r.keys, np.uint32))
                own.append(np.frombuffer(r.owners, np.int32) + np.int32(n))
                cid.append(np.frombuffer(r.cids, np.int64))
                sketch.append(np.frombuffer(r.sketches, np.uint16).reshape(-1, SEGMENTS))
                size.append(np.frombuffer(r.sizes, np.int32))
                n += len(cid[-1])
        key, own, cid, sketch, size = (np.concatenate(x) for x in (key, own, cid, sketch, size))
        for pairs in meet(key, own, cid, sketch, size, t):
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_pairs(spark: SparkSession, records: DataFrame, key: str, columns: list[str], t: float = 0.75, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(class_id, id) puts each record into the class of its word set, named by its least id;
    pairs(class_a, class_b, shared, size_a, size_b) has each pair of classes of similarity t or more, smaller id first.

    `key` is a bigint; rows of one key are one record. Null columns count as empty. Records without any word form one
    class that pairs with nothing (their similarity to each other is undefined, not 1). All found pairs are exact, whatever
    limit of word frequency `hot` sets; without it a sample tells the cheapest.
    """
    if not 0.5 <= t < 1:
        raise ValueError("t must be in [0.5, 1)")
    tmp = Scratch(spark)
    text = F.array_join(F.sort_array(words(*columns)), " ")
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    rows = tmp.write(rows)  # tokenised once: both the classes and their members come from here
    sets = tmp.write(rows.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.first("text").alias("text")))
    n_words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).alias("n_words")
    members = tmp.write(rows.select("id", "h1", "h2").distinct().join(sets.select("h1", "h2", F.col("cid").alias("class_id"), n_words), ["h1", "h2"]).select("class_id", "id", "n_words"))
    tmp.drop(rows)
    sets = sets.where("text <> ''").select("cid", "text")
    number = lambda d: d.select("cid", F.transform(F.split("text", " "), lambda x: F.xxhash64(x)).alias("ws"))
    n = sets.count()
    bins = word_bins(number(sets), n)
    crowd = HOT if hot is None else hot
    if hot is None:
        some = sets.where((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("cid"), F.lit(max(1, n // SAMPLE))) == 0))
        hot = choose_hot([bins[_bin(np.array(r.ws, np.int64).view(np.uint64), bins)] for r in number(some).collect()], t, n)
    features = tmp.write(number(sets).mapInArrow(_features(bins, t, hot), FEATURES))
    crowds = features.select(F.explode("budgets").alias("x")).groupBy("x.own", "x.other", "x.level").agg(F.sum("x.n").alias("n")).collect()  # a row for each pair of size classes
    crowds = {(r.own, r.other, r.level): r.n for r in crowds}
    ways = dealing(crowds, t, crowd)
    n_keys = (features.agg(F.sum(F.length("plain"))).first()[0] or 0) // 8 + sum(c * keys_of_a_record(ways(*cell)) for cell, c in crowds.items())
    n_buckets = max(16, math.ceil(n_keys / KEYS_A_BUCKET))
    keys = _keys(crowds, t, n_buckets, crowd, KEYS_A_SLICE)
    packed = features.drop("budgets").mapInPandas(keys, "bucket int, keys binary, owners binary, cids binary, sketches binary, sizes binary")
    candidates = tmp.write(packed.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(_meet(t), "a bigint, b bigint").distinct())
    tmp.drop(features)
    met = candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    needed = tmp.write(number(sets.join(met, "cid", "left_semi")))
    left, right = needed.select(F.col("cid").alias("a"), F.col("ws").alias("wa")), needed.select(F.col("cid").alias("b"), F.col("ws").alias("wb"))
    both = candidates.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    exact = both.select("a", "b", shared.alias("shared"), F.size("wa").alias("size_a"), F.size("wb").alias("size_b"))
    exact = exact.where(F.col("shared") >= F.lit(t) * (F.col("size_a") + F.col("size_b") - F.col("shared")) - F.lit(1e-9))
    return members, exact.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "shared", "size_a", "size_b")


def record_pairs(members: DataFrame, pairs: DataFrame, shard: int = SHARD) -> DataFrame:
    """a, b: each pair of distinct records of one class or of two paired classes, smaller id first.

    The records of a large class are spread over shards of about `shard` each, so no task holds all the pairs of one class.
    """
    full = members.where("n_words > 0")
    sizes = full.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    placed = full.join(sizes.where("shards > 1"), "class_id", "left").select("class_id", "id", F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"))
    links = pairs.select("class_a", "class_b").unionByName(sizes.where("n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    for side in ("a", "b"):
        count = sizes.select(F.col("class_id").alias(f"class_{side}"), F.col("shards").alias("k"))
        links = links.join(count, f"class_{side}").withColumn(f"shard_{side}", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    a = placed.select(F.col("class_id").alias("class_a"), F.col("shard").alias("shard_a"), F.col("id").alias("x"))
    b = placed.select(F.col("class_id").alias("class_b"), F.col("shard").alias("shard_b"), F.col("id").alias("y"))
    both = links.join(a, ["class_a", "shard_a"]).join(b, ["class_b", "shard_b"]).where((F.col("class_a") != F.col("class_b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(spark: SparkSession, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, class_id, links, group_id: each record with its class, the number of classes near it, and the least class id that near pairs lead to."""
    near = pairs.select("class_a", "class_b")
    both = near.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    lead = components(spark, members.select(F.col("class_id").alias("id")), near.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    out = members.join(both, "class_id", "left").join(lead.select(F.col("id").alias("class_id"), F.col("component").alias("group_id")), "class_id")
    return out.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
