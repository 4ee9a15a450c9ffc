"""Every registered opN query and each stage of the pipeline on whole small tables, against their contracts and brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spantable.llm import mixing, packing, quality, registry, simhash, tokens, wordpiece

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: the smallest tables, and rows with nulls, repeats, no letters, one word, long words."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    known = docs.filter("n_chars > 300").orderBy("doc_id").limit(3).collect()
    odd = [(90_000 + i, r["text"], r["lang"], r["source"], r["n_chars"]) for i, r in enumerate(known)]
    odd += [(known[0]["doc_id"], known[0]["text"], "en", None, 1), (None, known[1]["text"], None, None, None), (None, "no id of its own but words enough to be read as text", "en", "src0", 1)]
    odd += [(90_010, None, "en", "src0", None), (90_011, "", "en", "src0", 0), (90_012, " \t\n", None, "src1", 3), (90_013, "12 34", "en", None, 5), (90_014, "One", "en", "src0", 3), (90_015, "x" * 9000, None, "src0", 1), (known[2]["doc_id"], "another text under an id that is there", "en", "src1", 1)]
    docs.union(spark.createDataFrame(odd, SCHEMA)).repartition(3).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def ask(spark, folder, name, types):
    df = registry.queries()[name](spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][: len(types)] == types
    return df.collect()


def multiset(rows):
    return Counter(repr(tuple(r)) for r in rows)


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return [regex.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def held(doc_id, of, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == rest


def test_op3(spark, folder, docs):
    got = ask(spark, folder, "op3_token_counts", [("doc_id", "bigint"), ("n_words", "bigint"), ("n_tokens", "bigint"), ("n_unknown", "bigint")])
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((r["doc_id"], len(words(r["text"]))) for r in docs)
    counter = wordpiece.piece_counter("word_bpe_49k.json")
    each = Counter((r["doc_id"], sum(counter.count(w.encode()) for w in lowered(r["text"]))) for r in docs)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got if not r["n_unknown"]) == each


def brute_prints(docs):
    out = []
    for r in docs:
        w = lowered(r["text"])
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(out)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(out)):
        for j in range(i):
            if (out[i] ^ out[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return out, [top(i) for i in range(len(out))]


def test_op4(spark, folder, docs):
    got = ask(spark, folder, "op4_simhash_near_dedup", [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")])
    prints, group = brute_prints(docs)
    least = defaultdict(list)
    for r, g in zip(docs, group):
        if r["doc_id"] is not None:
            least[g].append(r["doc_id"])
    assert multiset(got) == Counter(repr((r["doc_id"], f"{p:016x}", min(least[g], default=None))) for r, p, g in zip(docs, prints, group))


@pytest.fixture(scope="module")
def encoded(docs):
    tok = Tokenizer.from_file(tokens.resolve("word_bpe_49k.json"))
    return [np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in docs]


def test_op5(spark, folder, docs, encoded):
    got = sorted(ask(spark, folder, "op5_token_shards", [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d["doc_id"], len(x), zlib.crc32(x)) for d, x in zip(docs, encoded))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / max(1, (~pos).sum())


def test_op6(spark, folder, docs):
    got = ask(spark, folder, "op6_quality_classifier", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    some = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    if len({y for _, y in some}) == 2:
        assert auc(np.array([s for s, _ in some]), np.array([y for _, y in some])) > 0.8


def test_quality_fit_is_ridge_and_isotonic_regression(spark, folder, docs):
    """The same model from one least-squares problem over all labelled rows, instead of sums by partition."""
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] is not None]
    frame, table = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(frame, table)
    hashes = {r["doc_id"]: r["h"] for r in table.select("doc_id", F.xxhash64(F.lit(quality.SEED), "doc_id").alias("h")).collect()}
    stats = defaultdict(list)
    for r in docs:
        stats[r["doc_id"]].append([float(x) for x in quality.statistics(r["text"])])
    rows = [(min(stats[r["doc_id"]]), r["quality"], (hashes[r["doc_id"]] >> 8) % 4 == 0) for r in labels if r["doc_id"] in stats]
    x, y, cal = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    scale = np.where(x.std(0) < 1e-9, 1, x.std(0))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, scale)
    phi = quality.fourier(x, model.mean, model.scale, model.omega, model.phase)
    penalty = np.sqrt(quality.RIDGE * np.array([1.0] * (phi.shape[1] - 1) + [1e-6]))
    w = np.linalg.lstsq(np.vstack([phi[~cal], np.diag(penalty)]), np.concatenate([y[~cal], np.zeros(phi.shape[1])]), rcond=None)[0]
    assert np.allclose(model.weights, w, atol=1e-5)
    raw = phi[cal] @ w
    order = np.argsort(raw)
    # isotonic regression by its min-max formula
    n = len(order)
    means = [[y[cal][order][a : b + 1].mean() for b in range(a, n)] for a in range(n)]
    best = [max(min(means[a][b - a] for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.sum(np.diff(best) > 1e-12) + 1 == len(model.knots) and (np.diff(model.levels) >= 0).all()


def test_quality_fit_of_repeated_ids_is_bounded(spark):
    """Many rows under one labelled id are one row of the fit."""
    docs = spark.createDataFrame([(1, "good words here")] * 500 + [(2, "bad!!"), (2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    once = quality.fit(docs.dropDuplicates(), labels)
    assert np.allclose(quality.fit(docs, labels).mean, once.mean)


def test_op7(spark, folder, docs):
    got = ask(spark, folder, "op7_language_id", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    letters = Counter((r["doc_id"], regex.search(r"\p{L}", r["text"] or "") is not None) for r in docs)
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in got) == letters
    learned = {r["lang"] for r in docs if r["lang"] and not held(r["doc_id"], 4, 2)}
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in learned | {"und"} for r in got)
    lang = {r["doc_id"]: r["lang"] for r in docs if r["doc_id"] is not None and r["doc_id"] < 90_000 and r["lang"]}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in lang and r["lang_pred"] != "und"]
    assert np.mean(right) > 0.9


def test_op8(spark, folder, docs):
    got = ask(spark, folder, "op8_lm_scoring", [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")])
    train, n_docs = Counter(), 0
    for r in docs:
        if not held(r["doc_id"], 7, 2):
            train.update(lowered(r["text"]))
            n_docs += 1
    n, v = sum(train.values()) + n_docs, len(train) + 1
    log = lambda c: float(np.log10((c + 1) / (n + v + 1)))
    want = defaultdict(list)
    for r in docs:
        w = lowered(r["text"])
        want[r["doc_id"]].append((held(r["doc_id"], 7, 2), len(w) + 1, sum(x in train for x in w) + 1, n, sum(log(train[x]) for x in w) + log(n_docs)))
    assert len(got) == len(docs)
    for r in got:
        assert any(x[:4] == (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) and abs(x[4] - r["base_score"]) < 1e-6 for x in want[r["doc_id"]])
        assert np.isfinite(r["score"]) and r["score"] < 0


def check_pieces(rows, ids_of):
    """Each id of each row lies in one piece; sequences are gapless and full, or of a power of two."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0
    have, want = Counter(), Counter()
    for d, pieces in by_doc.items():
        for r in pieces:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids_of[d])
            have.update((d, r["doc_tokens"], i) for i in range(r["start"], r["start"] + r["length"]))
    for d, xs in ids_of.items():
        for x in xs:
            want.update((d, len(x), i) for i in range(len(x)))
    assert have == want


PIECES = [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]


def test_op9(spark, folder, docs, encoded):
    ids_of = defaultdict(list)
    for r, x in zip(docs, encoded):
        ids_of[r["doc_id"]].append(x)
    check_pieces(ask(spark, folder, "op9_packing", PIECES), ids_of)


def test_packing_search_finds_the_best_of_the_corpus(spark, encoded):
    """Recall of the neighbours that seeds are given, against BM25 over all documents by brute force."""
    import pandas as pd

    dtype = np.dtype("<u2")
    rows = spark.createDataFrame(pd.DataFrame({"key": np.arange(len(encoded)), "n": [len(x) for x in encoded], "terms": [np.unique(x).astype(dtype).tobytes() for x in encoded], "tfs": [np.unique(x, return_counts=True)[1].astype("<u4").tobytes() for x in encoded]}), "key long, n long, terms binary, tfs binary").repartition(4)
    df = np.zeros(49408, int)
    for x in encoded:
        df[np.unique(x)] += 1
    n, mean = len(encoded), float(np.mean([len(x) for x in encoded]))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    seeds, used = np.arange(0, n, 7), packing._Used()
    used.add(seeds)
    found = packing._neighbours(rows, used, seeds, seeds, (idf, mean, np.argsort(-df)[: packing.DENSE]), dtype.str, 40).to_pandas()
    bags = [dict(zip(*np.unique(x, return_counts=True))) for x in encoded]
    rest = [i for i in range(n) if i % 7]
    hits = []
    for s in seeds:
        score = {i: sum(idf[t] * bags[i][t] * 2.2 / (bags[i][t] + 1.2 * (0.25 + 0.75 * len(encoded[i]) / mean)) for t in bags[s] if t in bags[i]) for i in rest}
        mine = found[found["chain"] == s]
        assert len(mine) >= 5
        bar = sorted(score.values(), reverse=True)[len(mine) - 1]
        hits += [score[k] >= bar * (1 - 1e-5) for k in mine["key"]]
    assert np.mean(hits) >= 0.99


def test_op10(spark, folder, docs):
    types = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    got = ask(spark, folder, "op10_tiff_media", types)
    want = Counter()
    for r in docs:
        raw = (r["text"] or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    same = {}
    for r in got:
        assert same.setdefault(r["payload_sha256"] + str(r["n_bytes"]), (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"]) and r["feature"]


# --- the pipeline ------------------------------------------------------------


def columns_of(df, docs):
    assert df.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    return df.collect()


def test_stages(spark, folder, docs, encoded):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    good, known, once, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    # 6: rows whose score, of a model that learns outside the held-out fifth, is 0.3 or more
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(frame, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    want = [r for r in docs if model.score(np.array([quality.statistics(r["text"])]))[0] >= 0.3]
    assert multiset(columns_of(good(spark, frame, folder), docs)) == multiset(want) and 0 < len(want) < len(docs)
    # 7: rows with a letter
    assert multiset(columns_of(known(spark, frame, folder), docs)) == multiset(r for r in docs if regex.search(r"\p{L}", r["text"] or ""))
    # 4: one row a group, of its least id
    _, group = brute_prints(docs)
    kept = columns_of(once(spark, frame, folder), docs)
    members = defaultdict(list)
    for r, g in zip(docs, group):
        members[g].append(r)
    assert len(kept) == len(members)
    assert Counter(repr(r["doc_id"]) for r in kept) == Counter(repr(min((r["doc_id"] for r in m if r["doc_id"] is not None), default=None)) for m in members.values())
    assert not multiset(kept) - multiset(docs)
    # 1: each row as often as the SQL has it
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[c] for r in docs], t) for c, t in (("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()))}))
    times = Counter()
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL}) WHERE size > 0").fetchall():
        times[repr(doc_id), size] += taken // size
    made = columns_of(mixed(spark, frame, folder), docs)
    assert Counter((repr(r["doc_id"]), len(words(r["text"]))) for r in made if words(r["text"])) == +times
    # 9: every row, repeated ones too
    ids_of = defaultdict(list)
    for r, x in zip(docs, encoded):
        ids_of[r["doc_id"]].append(x)
    check_pieces(packed(spark, frame, folder).collect(), ids_of)


def test_run(spark, folder, docs):
    """run() is the stages in turn; whole documents come out as often as the mix takes them."""
    out = frame = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{folder}/stage{i}.parquet"
        f(spark, out, folder).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.schema == frame.schema
    rows = corpus_pipeline.run(spark, folder)
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema.fields] == PIECES
    tok = Tokenizer.from_file(tokens.resolve("word_bpe_49k.json"))
    ids_of = defaultdict(list)
    for r in out.collect():
        ids_of[r["doc_id"]].append(np.array(tok.encode(r["text"], add_special_tokens=False).ids + [2], "<u4"))
    check_pieces(rows.collect(), ids_of)
    prints, group = brute_prints([r for r in out.dropDuplicates(["text"]).collect()])
    assert len(set(group)) == len(group)


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_free_what_they_staged(spark, folder):
    """After run() the shared folder holds what its lazy result still reads, no more."""
    from spantable import cluster

    before = set(cluster._staged)
    rows = corpus_pipeline.run(spark, folder)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in cluster._staged if p not in before]
    assert not [n for n in left if n.startswith(("simhash", "cc-", "mix-", "quality", "langid"))], left
    assert rows.count() > 0
    with cluster.scratch() as keep:
        a, b = cluster.stage(spark.range(3), "a"), cluster.stage(spark.range(4), "b")
        keep.append(b)
    assert b.count() == 4 and a._staged_at not in cluster._staged and b._staged_at in cluster._staged


def test_one_of_each_matches_near_duplicates(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["component_id"] for r in simhash.near_duplicates(frame.select("doc_id", "text")).collect()}
    kept = {r["doc_id"] for r in simhash.one_of_each(frame).collect()}
    assert kept - {None} == found - {None}
