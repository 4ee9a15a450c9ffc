"""PPM scores of op8 with contexts that run over spaces, against brute force."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantable.llm import ppm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


def test_query_scores_running_text(spark, tmp_path):
    """A text and the same words in another order differ, and all scores are those of running contexts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 30").select("doc_id", "text", "lang")
    first = docs.filter("text is not null").orderBy("doc_id").first()
    words = first["text"].split()
    more = [(900, " ".join(words), "en"), (901, " ".join(sorted(words)), "en"), (902, None, None), (903, " ", "en")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    models, seen = defaultdict(ppm.AdaptivePpm), Counter()
    for r in rows:
        if not r["h"]:
            seen[r["lang"]] += 1
            text = ppm.START + b"".join(w + b" " for w in ppm.words(r["text"])) + bytes((ppm.END,))
            for i in range(4, len(text)):
                models[r["lang"]].learn(text[i - 4 : i], text[i])
    seen[None] += 0  # the class of the rest is there even without documents
    prior = {k: np.log10((n + 1) / (sum(seen.values()) + len(seen))) for k, n in seen.items()}
    want = {}
    for r in rows:
        each = np.array([prior[k] + models[k].code_length(r["text"], learn=False, running=True) for k in seen])
        want[r["doc_id"]] = each.max() + np.log10((10 ** (each - each.max())).sum())
    got = {r["doc_id"]: r["score"] for r in ppm.query(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)
    assert abs(got[900] - got[901]) > 1e-3
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    again = {r["doc_id"]: r["score"] for r in ppm.score(docs, held, block_bytes=2000, running=True).collect()}
    assert all(again[d] == pytest.approx(want[d], abs=1e-6) for d in want)
