"""op3 to op9 against brute force, exact round trips and held-out accuracy."""

import gc
import os
import random
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spantable.llm import langid, packing, ppm, quality, simhash, text, tokens, wavelet, wordpiece

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tions"]) + str(rng.randrange(50)) for _ in range(300))
    near = [base.replace("alpha", "alpha", 1) + f" end{i}" for i in range(12)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([base] * 6 + near)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \t\n", "en", None, 3), (103, "one", "en", "s", 3), (104, "ONE", "en", "s", 3), (105, "one two", None, "s", 7)]
    rows += [(106, "Ünïcode façade l'été don't <|endoftext|> naïve ﬁ ǅ İ K 12 3.5", "fr", "s", 1), (107, "x" * 5000, "en", "s", 1), (108, "long words here " * 9000, "en", "s", 1), (109, "中文 é \x00\x1c z", "zh", "s", 1)]
    rows += [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (103, "one", "en", "s", 3)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits=3):
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("limit", [4, 2048])
def test_simhash(spark, odd, limit):
    rows = odd.collect()
    prints = [brute_print(r["text"]) for r in rows]
    group = brute_groups(prints)
    least = defaultdict(list)
    for r, g in zip(rows, group):
        if r["doc_id"] is not None:
            least[g].append(r["doc_id"])
    want = sorted(repr((r["doc_id"], p, min(least[g], default=None))) for r, p, g in zip(rows, prints, group))
    got = simhash.near_duplicates(odd.select("doc_id", "text"), limit=limit).collect()
    assert sorted(repr((r["doc_id"], r["simhash"] & (1 << 64) - 1, r["component_id"])) for r in got) == want
    kept = sorted(simhash.one_of_each(odd, limit=limit).collect(), key=repr)
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(min(least[g], default=None)) for g in set(group))
    assert all(tuple(r) in set(map(tuple, rows)) for r in kept)
    assert simhash.near_duplicates(odd.filter("false")).count() == 0


def test_one_of_each_decides_by_row(spark):
    """Null and repeated ids, rows of one id in two groups, clashing columns; the text of the least id stays."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (None, one), (5, one), (5, two), (None, two), (5, two), (None, three), (None, three), (9, ""), (4, None), (6, " \t")]
    docs = spark.createDataFrame([(*r, i, "x", "y", i) for i, r in enumerate(rows)], "doc_id long, text string, row int, fp string, `simhash` string, `a.b` int")
    got = simhash.one_of_each(docs.repartition(3))
    assert got.columns == docs.columns and got.schema == docs.schema
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["row"]) for r in got.collect())
    assert [x[:2] for x in got] == [(0, three), (1, one), (4, ""), (5, two)] and got[0][2] in (6, 7) and got[3][2] in (3, 5)
    assert simhash.one_of_each(docs.filter("false")).collect() == []
    kinds = simhash.near_duplicates(docs).collect()
    assert len(kinds) == len(rows) and all(r["row"] is not None and r["fp"] == "x" for r in kinds)


def test_fingerprints_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8), (2, None, 9, 10)], "doc_id long, text string, `a.b` int, `c``d` int")
    got = simhash.with_fingerprint(docs).orderBy("doc_id")
    assert got.columns == [*docs.columns, "simhash"]
    assert [tuple(r) for r in got.collect()] == [(1, "a b c d", 7, 8, simhash.fingerprint("a b c d")), (2, None, 9, 10, simhash.fingerprint(None))]
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["a.b"], r["c`d"]) for r in rows) == [(1, 7, 8), (2, 9, 10)]


def test_links_and_components_of_random_prints(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(25)]
    prints = set(seeds)
    for s in seeds:
        x = s
        for _ in range(12):  # chains
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_groups([p & (1 << 64) - 1 for p in prints])
    for limit in (3, 2048):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, limit=limit)).collect()}
        got = [roots.get(p, p) for p in prints]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_tokens_are_those_of_the_library(spark, odd):
    texts = [r["text"] or "" for r in odd.collect()]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    enc = tokens.WordTokens("word_bpe_49k.json")
    whole = [x.ids + [2] for x in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [enc.encode(t).tolist() for t in texts] == whole
    assert enc.encode(None).tolist() == [2]
    other = tokens.WordTokens("byte_bpe_50k.json", None)
    assert not other.by_word and other.encode("a  b").tolist() == other.tok.encode("a  b", add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 512, 5000):
        ids = (rng.zipf(1.3, n) % 300).astype(np.uint16)
        shard = wavelet.Shard(wavelet.write_shard([5, None], [ids[: n // 2], ids[n // 2 :]], 9))
        m = shard.tokens
        assert (m.decode() == ids).all() and (m.access(np.arange(n)) == ids).all()
        assert shard.doc_ids.tolist() == [5, wavelet.NULL_ID] and shard.lengths.tolist() == [n // 2, n - n // 2]
        for s in (0, 1, 2, 7, 299, 511, 600):
            where = np.flatnonzero(ids == s)
            assert m.count(s) == len(where) and m.positions(s).tolist() == where.tolist()
            assert m.rank(s, n // 3) == int((where < n // 3).sum()) and m.count(s, 10, n // 2) == int(((where >= 10) & (where < n // 2)).sum())
        assert m.select(1, [n, -1]).tolist() == [-1, -1]
        assert m.select(300, 0).tolist() == [-1]
    with pytest.raises(ValueError):
        wavelet.Shard(b"XXXX" + bytes(40))


def test_planes_are_read_when_needed():
    ids = np.arange(3000, dtype=np.uint16) % 500
    data, read = wavelet.write_shard([1], [ids], 9), []
    source = type("Source", (), {"read_at": lambda self, n, at: read.append(n) or data[at : at + n]})()
    shard = wavelet.Shard(source)
    opened = sum(read)
    assert shard.tokens.planes.held == [None] * 9 and opened < len(data) // 2
    assert shard.tokens.planes[0] is shard.tokens.planes[0] and sum(x is not None for x in shard.tokens.planes.held) == 1
    assert shard.tokens.select(7, [0, 5]).tolist() == [7, 2507]


@pytest.mark.parametrize("shard_tokens", [50, 1 << 22])
def test_token_shards(spark, odd, shard_tokens):
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    tok = tokens.WordTokens("word_bpe_49k.json").tok
    shards = wavelet.write_tokens(odd, shard_tokens=shard_tokens)
    got = sorted(map(tuple, wavelet.read_tokens(shards).collect()), key=lambda r: r[1])
    at, want = 0, []
    for r in rows:
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    listed = shards.collect()
    assert all(os.path.getsize(r["path"].removeprefix("file:")) == r["n_bytes"] and r["file"] is None for r in listed) and len({r["path"] for r in listed}) == len(listed)
    assert wavelet.read_tokens(wavelet.write_tokens(odd.filter("false"))).count() == 0


def test_equal_rows_are_dealt_to_many_shards(spark):
    docs = spark.createDataFrame([(None, "same text")] * 300 + [(3, "more")] * 300, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with large partitions
    shards = wavelet.write_tokens(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["part"] for r in shards.collect()}) > 2
    got = sorted(map(tuple, wavelet.read_tokens(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 300 + [3] * 300 and len(set(r[2:] for r in got)) == 2 and [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()


def test_the_next_operator_frees_the_words_remembered():
    """Encoders and their words refer to each other, so dropping them is not enough: a worker held them until the collector came by."""
    text.take_over("tokens")
    enc = tokens.word_tokens(tokens.TOKENIZER, tokens.END)
    assert len(enc.encode("some words")) > 2
    gone = weakref.ref(enc)
    del enc
    gc.disable()
    try:
        text.take_over("packing")
        assert gone() is None
    finally:
        gc.enable()


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    """A file whose pattern or normalizer differs is not taken apart into words."""
    import json

    say = json.load(open(tokens.resolve("word_bpe_49k.json")))
    for change in ("pattern", "normalizer"):
        other = json.loads(json.dumps(say))
        if change == "pattern":
            other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[^x]+"
        else:
            other["normalizer"]["normalizers"].pop()
        path = str(tmp_path / f"{change}.json")
        json.dump(other, open(path, "w"))
        enc = tokens.WordTokens(path)
        assert not enc.by_word
        for text in ("Two Words, It's 12", "xaxb  c", ""):
            assert enc.encode(text).tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, 2]
    assert tokens.WordTokens("word_bpe_49k.json").by_word


def brute_pieces(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        known = first if at == 0 else inner
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_piece_counter():
    rng = random.Random(6)
    for _ in range(60):
        make = lambda: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        first, inner = make(), make()
        c = wordpiece.PieceCounter(first, inner)
        for _ in range(80):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            assert c.count(w) == brute_pieces(w, first, inner), (w, first, inner)


def test_token_counts(spark, odd, tmp_path):
    c = wordpiece.piece_counter("word_bpe_49k.json")
    pieces = {b for b in _pieces(c)}
    got = {r["doc_id"]: r for r in wordpiece.token_counts(odd.withColumnRenamed("n_chars", "n_tokens")).collect()}
    for r in odd.collect():
        w = [x for x in (r["text"] or "").encode().translate(wordpiece.words.__globals__["FOLD_BYTES"]).split(b" ") if x]
        few = w[:200] if len(w) > 5000 else w
        if few is w:
            assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_tokens"]) == (len(w), sum(brute_pieces(x, pieces, pieces) for x in w))
        assert got[r["doc_id"]]["n_unknown"] == 0
    vocabulary = tmp_path / "v.txt"
    vocabulary.write_text("a\nab\n##b\n##bc\n[UNK]\n")
    df = spark.createDataFrame([(1, "abb A xyz abbc"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, wordpiece.token_counts(df, str(vocabulary)).collect())) == [(1, 4, 6, 1), (2, 0, 0, 0)]
    assert wordpiece.token_counts(df.filter("false")).count() == 0


def _pieces(counter):
    """All pieces of an automaton, read back from its trie."""
    children = defaultdict(list)
    for key, node in counter.go.items():
        children[key >> 8].append((key & 255, node))
    todo = [(wordpiece.ROOT, b"")]
    while todo:
        node, text = todo.pop()
        if text and counter.fail[node] == wordpiece.INNER and counter.pops[node] == 1:
            yield text
        todo += [(n, text + bytes((c,))) for c, n in children[node]]


def test_word_piece_library_agrees():
    from tokenizers import Tokenizer, models

    rng = random.Random(9)
    vocab = {"[UNK]": 0}
    for _ in range(40):
        p = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
        vocab.setdefault(p, len(vocab))
        vocab.setdefault("##" + p[::-1], len(vocab))
    t = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000))
    c = wordpiece.PieceCounter([p.encode() for p in vocab if p[0] not in "[#"], [p[2:].encode() for p in vocab if p.startswith("##")])
    for _ in range(300):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 20)))
        assert abs(c.count(w.encode())) == len(t.encode(w).ids)


def test_isotonic():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-raw))).astype(float)
    knots, levels = quality.isotonic(raw, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels[0] <= levels[-1] <= 1
    assert quality.isotonic(np.zeros(0), np.zeros(0))[1].tolist() == [0.5]


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out(0, 5)
    model = quality.fit(docs, labels.filter(~out(F.col("doc_id"))))
    got = quality.classify(docs, model).join(labels, "doc_id").filter(out(F.col("doc_id"))).select("quality_score", "quality_predicted", "quality").collect()
    good, bad = ([r["quality_score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 5 and np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r["quality_predicted"] == r["quality"] for r in got]) > 0.93
    scored = quality.classify(odd.withColumnRenamed("source", "quality_score"), model)
    rows = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert scored.count() == odd.count() and all(0 <= x <= 1 for x in rows.values()) and rows[100] == rows[101]
    nothing = quality.fit(docs, labels.filter("false"))
    assert quality.classify(odd, nothing).agg({"quality_score": "max"}).first()[0] == pytest.approx(0.5, abs=0.01)
    assert quality.classify(odd.filter("false"), model).count() == 0


def brute_viterbi(scores, switch):
    import itertools

    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])))
    return list(best)


def test_viterbi():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 7, 1, 6])
    scores = rng.normal(0, 2, (18, 3))
    got, at = langid.viterbi(scores, lengths, 1.5), 0
    for n in lengths.tolist():
        if n:
            assert got[at : at + n].tolist() == brute_viterbi(scores[at : at + n], 1.5)
        at += n


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    held = quality.held_out(2, 4)(F.col("doc_id"))
    model = langid.fit(docs.filter(~held))
    got = langid.detect(docs.filter(held).drop("n_chars"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    a, b = (next(r["text"] for r in got if r["lang"] == x and r["lang_pred"] == x and len(r["text"]) > 800) for x in ("de", "fr"))
    mixed = " ".join(a.split()[:60] + b.split()[:90])
    df = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, " 12 | !! ", "x"), (4, "", "x")], "doc_id long, text string, lang_pred string")
    rows = {r["doc_id"]: r for r in langid.detect(df, model).collect()}
    spans = rows[1]["lang_spans"]
    assert rows[1]["lang_pred"] == "fr" and 0.5 < rows[1]["lang_score"] < 0.7 and {s["lang"] for s in spans} >= {"de", "fr"}
    assert abs(next(s["start"] for s in spans if s["lang"] == "fr") - 60) <= 2 and spans[-1]["end"] == 150
    assert all((rows[i]["lang_pred"], rows[i]["lang_score"]) == ("und", 0.0) for i in (2, 3, 4))
    assert langid.detect(odd, model).count() == odd.count() and langid.detect(odd.filter("false"), model).count() == 0
    assert {r["lang_pred"] for r in langid.detect(odd, langid.fit(docs.filter("false"))).collect()} == {"und"}


def test_scripts_narrow():
    model = langid.Model(["en", "ru"], np.zeros((langid.BUCKETS, 2)), np.array([[n == "latin", n == "cyrillic"] for n in [*langid.NAMES, ""]]))
    s, scripts = model.word_scores(["мир".encode(), b"peace", b"12", "中".encode()])
    assert s[0, 1] > s[0, 0] and s[1, 0] > s[1, 1] and s[2].tolist() == [0, 0] and s[3, 0] == s[3, 1] and scripts[2] == -1


def test_lm_scores(spark, odd):
    docs = odd.filter("doc_id is null or doc_id <> 108").unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 25").withColumn("doc_id", F.col("doc_id") + 1000))
    held = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    rows = docs.withColumn("h", F.coalesce(held, F.lit(False))).collect()
    train = Counter(w for r in rows if not r["h"] for w in ppm.words(r["text"]))
    n_docs = sum(not r["h"] for r in rows)
    n, v = sum(train.values()) + n_docs, len(train) + 1
    langs = Counter(r["lang"] for r in rows if not r["h"])
    models, seen = defaultdict(ppm.AdaptivePpm), Counter()
    for r in rows:
        if not r["h"]:
            key = r["lang"]
            seen[key] += 1
            for word, c in Counter(ppm.words(r["text"])).items():
                ctx = ppm.START
                for s in word + b" ":
                    models[key].learn(ctx[-4:], s, c)
                    ctx += bytes((s,))
            models[key].learn(ppm.START, ppm.END)
    assert len(langs) <= ppm.LANGUAGES + 1
    prior = {k: np.log10((seen[k] + 1) / (n_docs + len(langs))) for k in langs}
    want = {}
    for r in rows:
        w = ppm.words(r["text"])
        base = sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w) + np.log10((n_docs + 1) / (n + v + 1))
        each = np.array([prior[k] + models[k].code_length(r["text"], learn=False) for k in langs])
        want.setdefault(repr(r["doc_id"]), []).append((len(w) + 1, sum(x in train for x in w) + 1, base, each.max() + np.log10((10 ** (each - each.max())).sum())))
    for block in (2000, 1 << 24):
        got = ppm.score(docs, held, block_bytes=block).collect()
        assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
        for r in got:
            close = [x for x in want[repr(r["doc_id"])] if x[:2] == (r["n_tokens"], r["n_known"]) and abs(x[2] - r["base_score"]) < 1e-6 and abs(x[3] - r["score"]) < 1e-6]
            assert close, (tuple(r), want[repr(r["doc_id"])])
    assert ppm.score(docs.filter("false")).count() == 0


def test_adaptive_ppm_is_a_distribution():
    m = ppm.AdaptivePpm(3)
    m.code_length("the theme of these themes")
    for ctx in (b"", b"the", b" th", b"zzz"):
        assert sum(m.probability(ctx, s) for s in range(256)) == pytest.approx(1.0)


@pytest.mark.parametrize(("shard_tokens", "shard_docs"), [(3000, 7), (1 << 21, 4096)])
def test_packing(spark, odd, shard_tokens, shard_docs):
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id between 200 and 9999"))
    enc = tokens.WordTokens("word_bpe_49k.json")
    got = packing.pack(docs, shard_tokens=shard_tokens, shard_docs=shard_docs).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 4096
    want, have = defaultdict(Counter), defaultdict(Counter)
    for r in docs.collect():
        want[r["doc_id"]].update(enumerate(enc.encode(r["text"]).tolist()))
    for d, rows in by_doc.items():
        for r in rows:
            have[d].update(enumerate(np.frombuffer(r["ids"], "<u4").tolist(), r["start"]))
    assert have == want
    assert packing.pack(docs.filter("false")).count() == 0


def test_packing_puts_alike_together():
    rng = random.Random(8)
    topics = [[rng.randrange(100, 40000) for _ in range(60)] for _ in range(6)]
    docs = [np.array([rng.choice(topics[i % 6]) for _ in range(120)]) for i in range(60)]
    df = np.zeros(49408, int)
    for d in docs:
        df[np.unique(d)] += 1
    seqs = list(packing.pack_shard(docs, np.log1p((60 - df + 0.5) / (df + 0.5)), 120.0, 480))
    pure = [len({d % 6 for d, _, _ in s}) for s in seqs]
    assert np.mean(pure) < 2 and sum(n for s in seqs for _, _, n in s) == 60 * 120
