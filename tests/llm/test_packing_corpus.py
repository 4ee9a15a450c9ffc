"""Neighbours of packing are searched over the whole corpus, with all terms of the seed."""

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spantable.llm import packing

SF = "/root/testdata/sf0.001"


def test_seeds_find_the_best_of_all():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 400, rng.integers(1, 90)) for _ in range(300)]
    df = np.zeros(400, int)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean = np.log1p((300 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    seeds = packing.Seeds(np.arange(20), [np.unique(d) for d in docs[:20]], idf, mean, np.argsort(-df)[:50], 7)
    for at in range(0, 300, 64):
        seeds.show(np.arange(at, min(at + 64, 300)), docs[at : at + 64])
    for q in range(20):
        want = [sum(idf[t] * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(docs[q])) for d in docs]
        mine = seeds.best[0] == q
        assert np.allclose(seeds.best[3][mine], sorted(want, reverse=True)[:7], rtol=1e-4)
        assert np.allclose([want[k] for k in seeds.best[1][mine]], seeds.best[3][mine], rtol=1e-4)
    index = packing.Bm25Shard(docs, idf, mean)
    long = int(np.argmax([len(np.unique(d)) for d in docs]))
    assert len(np.unique(docs[long])) > 32
    want = [sum(idf[t] * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(docs[long])) for d in docs]
    assert np.allclose(index.scores(long), want)


def test_estimates_leave_out_seeds_and_keep_the_best(monkeypatch):
    """Recall of the lists against the exact search, where most pairs of a block and a seed are left out."""
    rng = np.random.default_rng(7)
    ranks = [rng.permutation(600) for _ in range(12)]
    # words of a topic by Zipf's law, long documents and short ones
    docs = [np.minimum(ranks[i % 12][np.minimum(rng.zipf(1.3, n), 600) - 1], 599) for i, n in enumerate(rng.lognormal(4, 1, 6000).astype(int) + 5)]
    bags = [packing._terms(d) for d in docs]
    df = np.bincount(np.concatenate([t for t, _ in bags]), minlength=600)
    idf, mean = np.log1p((6000 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    lengths, counts = (np.array([len(x) for x in v]) for v in (docs, [t for t, _ in bags]))
    shown = packing.Documents.of(np.arange(6000), lengths, counts, *(np.concatenate(v) for v in zip(*bags)), idf, mean)
    found, work = [], []
    concerned = packing.Seeds._concerned
    monkeypatch.setattr(packing.Seeds, "_concerned", lambda self, *a: work.append(np.arange(len(self.names))[got := concerned(self, *a)].size) or got)
    monkeypatch.setattr(packing, "TOGETHER", 64)
    for estimate in (False, True):
        args = (np.arange(1000), [t for t, _ in bags[:1000]], idf, mean, np.argsort(-df)[:300], 16)
        plain = packing.Seeds(*args)
        seeds = packing.Seeds(*args, plain.centres, packing.axes(plain.wants) if estimate else None)
        work.clear()
        blocks = list(seeds.in_turn(shown))
        assert sorted(np.concatenate([b.keys for b in blocks]).tolist()) == list(range(6000))
        for b in blocks:
            seeds.show_all(b)
        found.append((sum(work), set(zip(seeds.best[0].tolist(), seeds.best[1].tolist()))))
    (all_, exact), (some, near) = found
    assert len(exact) == len(near) == 16000
    assert len(exact & near) >= 0.9 * len(exact) and some < 0.7 * all_, (len(exact & near), some, all_)


def test_used_keys_and_drafts():
    used, rng = packing._Used(), np.random.default_rng(2)
    keys = rng.integers(0, 3, 500) << 32 | rng.integers(0, 200, 500)
    used.add(keys[:200])
    assert used.has_all(keys).tolist() == [used.has(k) for k in keys.tolist()] and used.has_all(keys[:200]).all() and not used.has_all(keys).all()
    # the first of chain 4 is taken before chain 9 has its turn; chain 7 has no list
    lists = [(9, [5, 6, 8], [10, 10, 10]), (4, [5, 8, 6], [3, 9, 9])]
    claims = pa.table({"chain": [c for c, *_ in lists], "keys": [np.array(k, "<i8").tobytes() for _, k, _ in lists], "ns": [np.array(n, "<u4").tobytes() for *_, n in lists]})
    of, key, size, where = packing._draft(claims, np.array([4, 7, 9]), np.array([10, 10, 15]))
    assert (of.tolist(), key.tolist(), size.tolist(), where.tolist()) == ([4, 4, 9], [5, 8, 6], [3, 9, 10], [0, 0, 2])
    assert packing._flat(pa.array([b"", b"abcd", b"abcdefgh"], pa.binary()).slice(1), "<u4")[0].tolist() == [1, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_alike_meet_across_the_corpus(spark):
    """Documents of a topic share many middling words; each has two rare words of its own, which says nothing about the topic."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, 6)) for _ in range(1200)]
    texts = []
    for i in range(240):
        topic = words[i % 8 * 40 : i % 8 * 40 + 40]
        texts.append((i, " ".join([*rng.choice(topic, 60), *[words[400 + 2 * i]] * 9, *[words[401 + 2 * i]] * 9])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.pack(docs, window=1024, shard_tokens=1 << 21, shard_docs=20).collect()
    seqs, total = defaultdict(set), defaultdict(int)
    for r in rows:
        seqs[r["sequence_id"]].add(r["doc_id"] % 8)
        total[r["doc_id"]] += r["length"]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    full = [len(x) for s, x in seqs.items() if sizes[s] == 1024]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows) and len(total) == 240
    assert np.mean(full) < 2.5, full


def test_ids_move_once(spark):
    """Only places are dealt out to meet the documents, in a plan that is the same at any size; every document comes, in the order of its chain."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, buckets = packing._encoded(spark.range(0, 500, 1, 7).selectExpr("id AS doc_id", "concat('word ', id) AS text"), packing.TOKENIZER, packing.END)
        all_ = sorted(rows.select("key", "doc_id").collect())
        # of the first part every other document has a place, of the last none
        places = [(r["key"], r["key"] % 5, i) for i, r in enumerate(all_) if r["key"] >> 32 < 6 and (r["key"] >> 32 or r["key"] % 2)]
        got = packing._by_chain(buckets, spark.createDataFrame(places, "key long, chain long, at long").repartition(3))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan, plan
        assert plan.count("Exchange hashpartitioning(") == 2, plan  # of the places, to make a row a part and to meet the buckets
        doc = dict(all_)
        assert sorted((r["chain"], r["at"], r["doc_id"]) for r in got.collect()) == sorted((c, i, doc[k]) for k, c, i in places)
        assert got.filter("ids IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
