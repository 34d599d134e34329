import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seamquarry.llm import neardup as D

SCHEMA = "finding_id bigint, issue string, reasoning string, mitigation string, class_id string"
COLS = ["issue", "reasoning", "mitigation"]


def brute(rows, t):
    sets = {r[0]: set(re.findall("[a-z0-9_]+", " ".join(x or "" for x in r[1:4]).lower())) for r in rows}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    rare = [f"id_{i}" for i in range(400)]
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.6:
            ws = " ".join(x or "" for x in rng.choice(rows)[1:4]).split()
            for _ in range(rng.randrange(0, 6)):
                if ws and rng.random() < 0.5:
                    ws.pop(rng.randrange(len(ws)))
                else:
                    ws.append(rng.choice(common + rare))
        else:
            ws = rng.choices(common, k=rng.randrange(0, 12)) + rng.choices(rare, k=rng.randrange(0, 25))
        rng.shuffle(ws)
        k = rng.randrange(len(ws) + 1)
        rows.append((i, " ".join(ws[:k]) or None, " ".join(ws[k:]).upper(), rng.choice([None, ""]), "clash"))
    rows += [(300 + i, "the same Words here", None, None, "c") for i in range(30)] + [(400, None, None, None, None), (401, "", "-!", None, None)]
    return rows + rows[:25]


@pytest.mark.parametrize("hot,t", [(128, 0.75), (2, 0.75), (2, 0.8), (0, 0.75)])
def test_pairs_match_brute_force(spark, hot, t):
    rows = corpus(hot)
    m, p = D.near_pairs(spark, spark.createDataFrame(rows, SCHEMA), "finding_id", COLS, t, hot)
    got = [tuple(r) for r in D.record_pairs(m, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t)


@pytest.mark.parametrize("hot", [0, 128])
def test_frequent_words_only(spark, hot):
    # every word is in a third of all rows or more, but few rows are alike
    rng = random.Random(2)
    ws = [f"c{i}" for i in range(9)]
    rows = [(i, " ".join(sorted(rng.sample(ws, rng.randrange(3, 9)))), None, None, "") for i in range(120)]
    m, p = D.near_pairs(spark, spark.createDataFrame(rows, SCHEMA), "finding_id", COLS, 0.75, hot)
    assert {tuple(r) for r in D.record_pairs(m, p).collect()} == brute(rows, 0.75)


def _run(sets, t, hot, grown):
    """The keys of each set, as if the table had `grown` times as many records."""
    number = lambda s: np.array([hash((x, 7)) for x in sorted(s)], np.int64)
    ws = [number(s) for s in sets]
    bins = np.zeros(1 << 18, np.uint8)
    at, n = np.unique(D._bin(np.concatenate(ws).view(np.uint64), bins), return_counts=True)
    bins[at] = D._scaled(n * grown)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ws))), pa.array([w.tolist() for w in ws], pa.list_(pa.int64()))], names=["cid", "ws"])
    f = pa.Table.from_batches(list(D._features(bins, t, hot)(iter([batch])))).to_pandas()
    crowds = {}
    for x in f["budgets"][0]:
        crowds[x["own"], x["other"], x["level"]] = x["n"] * grown
    keys = [set() for _ in sets]
    for r in next(D._keys(crowds, t, 1, hot)(iter([f]))).itertuples():
        who = np.frombuffer(r.cids, np.int64)[np.frombuffer(r.owners, np.int32)]
        for k, w in zip(np.frombuffer(r.keys, np.uint32).tolist(), who.tolist()):
            keys[w].add(k)
    return keys


@pytest.mark.parametrize("t,grown", [(0.5, 1), (0.75, 1), (0.75, 10**4), (0.75, 10**7), (0.8, 10**9)])
def test_similar_sets_share_a_key(t, grown):
    rng = random.Random(7)
    sets = []
    for _ in range(400):
        x = set(rng.sample(range(60), rng.randrange(2, 40)))
        sets += [x, x ^ set(rng.sample(range(60), rng.randrange(1, 6)))]
    sets = [s for s in sets if s]
    keys = _run(sets, t, 128, grown)
    met = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= t * len(a | sets[j]):
                assert keys[i] & keys[j], (a, sets[j])
                met += len(a) != len(sets[j])
    assert met > 100


def test_keys_stay_few_as_the_table_grows():
    rng = random.Random(9)
    sets = [set(rng.sample(range(400), 20)) for _ in range(500)]  # each word in a twentieth of all records
    few, many = (sum(map(len, _run(sets, 0.75, 128, g))) / 500 for g in (100, 10**7))
    assert many < 8 * few


def test_budget_levels():
    b = np.arange(200)
    assert (D.level(b) >= b).all() and (D.level(b) <= 1.5 * b + 2).all() and (D.level(b[:5]) == b[:5]).all()


def test_ring_never_loses_a_near_pair():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**16, (4000, D.SEGMENTS), dtype=np.uint16)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.integers(0, D.SEGMENTS * 16, rng.integers(0, 40)):
            y[i, b // 16] ^= np.uint16(1 << (b % 16))
    d = np.bitwise_count(x ^ y).sum(axis=1)
    assert (D.chained(x, y, np.full(len(x), 20.0)) == (d <= 20)).all()


def test_small_tables(spark):
    for rows in ([], [(1, None, None, None, None)], [(1, "a", None, None, None)], [(None, "a", None, None, None)]):
        m, p = D.near_pairs(spark, spark.createDataFrame(rows, SCHEMA), "finding_id", COLS)
        assert D.record_pairs(m, p).count() == 0


def test_shards_and_groups(spark):
    rows = [(i, "the same words", None, None, "") for i in range(40)] + [(50 + i, "the same words here", None, None, "") for i in range(9)] + [(90, "quite other text", None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    m, p = D.near_pairs(spark, df, "finding_id", COLS)
    got = [tuple(r) for r in D.record_pairs(m, p, shard=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.75)
    g = {r.id: (r.class_id, r.links, r.group_id) for r in D.groups(spark, m, p).collect()}
    assert len(g) == 50 and g[3] == (0, 1, 0) and g[55] == (50, 1, 0) and g[90] == (90, 0, 90)


def _table(n, words):
    """n sets of numbered words as one batch, and bins that make every word frequent."""
    rng = np.random.default_rng(3)
    ws = [np.unique(rng.integers(1, 2**63, words)) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([w.tolist() for w in ws], pa.list_(pa.int64()))], names=["cid", "ws"])
    return batch, np.full(1 << 18, 255, np.uint8)


def test_tasks_hold_bounded_slices(monkeypatch):
    # the keys of a batch leave in slices, however many records and keys it has, and none is lost or altered
    monkeypatch.setattr(D, "WORDS_A_SLICE", 300)
    batch, bins = _table(100, 20)
    parts = list(D._features(bins, 0.75, 128)(iter([batch])))
    assert all(len(p) <= 15 for p in parts) and sum(len(p) for p in parts) == 100
    f = pa.Table.from_batches(parts).to_pandas()
    crowds = {}
    for x in f["budgets"].explode().dropna():
        crowds[x["own"], x["other"], x["level"]] = crowds.get((x["own"], x["other"], x["level"]), 0) + x["n"]
    expected = sum(n * D.keys_of_a_record(D.dealing(crowds, 0.75, 128)(*cell)) for cell, n in crowds.items())

    def held(frames):
        out = []
        for r in frames:
            key, own, cid = np.frombuffer(r.keys, np.uint32), np.frombuffer(r.owners, np.int32), np.frombuffer(r.cids, np.int64)
            sketch, size = np.frombuffer(r.sketches, np.uint16).reshape(-1, D.SEGMENTS), np.frombuffer(r.sizes, np.int32)
            assert len(cid) == len(set(cid.tolist())) == len(size) == len(sketch)
            out += zip([r.bucket] * len(key), key.tolist(), cid[own].tolist(), sketch[own].tolist(), size[own].tolist())
        return out

    whole = list(D._keys(crowds, 0.75, 5, 128)(iter([f])))
    most = expected // 20
    cut = list(D._keys(crowds, 0.75, 5, 128, most)(iter([f])))
    assert len(whole) == 1 and len(cut) > 10
    assert all(sum(map(len, p["keys"])) // 4 <= most for p in cut)
    a, b = sorted(held(whole[0].itertuples())), sorted(x for p in cut for x in held(p.itertuples()))
    assert a == b and len(a) == expected


def test_pairs_leave_a_bucket_in_parts(monkeypatch):
    # records that all meet at one key: every pair comes, in parts of bounded size
    n = 90
    key, own, cid = np.zeros(n, np.uint32), np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int64) * 3
    sketch, size = np.zeros((n, D.SEGMENTS), np.uint16), np.full(n, 30, np.int32)
    monkeypatch.setattr(D, "PAIRS_A_PART", 200)
    monkeypatch.setattr(D, "MEETINGS_A_STEP", 50)
    parts = list(D.meet(key, own, cid, sketch, size, 0.75))
    assert len(parts) > 10 and all(len(p) <= 250 for p in parts)
    assert {tuple(x) for p in parts for x in p.tolist()} == {(3 * a, 3 * b) for a in range(n) for b in range(a + 1, n)}


def test_bounds_lose_no_pairs(spark, monkeypatch):
    for name, value in (("WORDS_A_SLICE", 40), ("KEYS_A_SLICE", 60), ("KEYS_A_BUCKET", 100), ("MEETINGS_A_STEP", 7), ("PAIRS_A_PART", 9)):
        monkeypatch.setattr(D, name, value)
    rows = corpus(2)
    m, p = D.near_pairs(spark, spark.createDataFrame(rows, SCHEMA), "finding_id", COLS, 0.75, 2)
    got = [tuple(r) for r in D.record_pairs(m, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.75)


def test_keys_stay_few_as_words_get_frequent():
    # of 40 to 100 words some are in few records, some in more and more as the table grows, the others in many
    rng = random.Random(4)
    sets = [(rng.randrange(2, 9), rng.randrange(2, 11), rng.randrange(36, 82)) for _ in range(500)]
    for n in (10**5, 3 * 10**6, 2 * 10**7):
        per_record = {}
        counts = [np.r_[np.zeros(few), D._scaled([n * 1e-4 / rng.uniform(1, 3) for _ in range(more)]), D._scaled([n * rng.uniform(0.05, 0.5) for _ in range(many)])].astype(np.uint8) for few, more, many in sets]
        size = np.array([len(c) for c in counts])
        for hot in (128, D.choose_hot(counts, 0.75, n)):
            cell, many = np.unique(np.stack(D.partners(size, np.array([(c <= D._scaled(hot)).sum() for c in counts]), 0.75)[1:], 1), axis=0, return_counts=True)
            ways = D.dealing({tuple(x): k * n // 500 for x, k in zip(cell.tolist(), many.tolist())}, 0.75, D.HOT)
            per_record[hot] = sum(k * D.keys_of_a_record(ways(*x)) for x, k in zip(cell.tolist(), many.tolist())) / 500
        assert n == 10**5 or per_record[128] > 3 * per_record[hot], (n, per_record)


def test_chosen_limit_finds_all(spark, monkeypatch):
    rows = corpus(0)
    for hots in ((0,), (3,), (10**6,)):
        monkeypatch.setattr(D, "HOTS", hots)
        m, p = D.near_pairs(spark, spark.createDataFrame(rows, SCHEMA), "finding_id", COLS)
        got = [tuple(r) for r in D.record_pairs(m, p).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.75)
