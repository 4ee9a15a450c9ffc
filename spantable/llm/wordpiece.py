"""Word-piece token counts by a linear longest-match automaton.

The trie holds all pieces; its failure links and the number of pieces that
following a link pops are computed once. Reading a word byte by byte then gives
the number of pieces of greedy longest match without building any, in time
linear in the word however the matches overlap.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from spantable.cluster import ship
from spantable.llm.text import forget_with, take_over, words
from spantable.llm.tokens import _BYTE, REMEMBERED, TOKENIZER, resolve

ROOT, INNER, NONE = 0, 1, -1


class PieceCounter:
    """Automaton over bytes. `first` are the pieces that begin words, `inner` those that go on."""

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]) -> None:
        go: dict[int, int] = {}  # node << 8 | byte -> node
        parent, byte, whole = [NONE, NONE], [0, 0], [False, False]
        for root, pieces in ((ROOT, first), (INNER, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = go.get(node << 8 | c)
                    if nxt is None:
                        nxt = go[node << 8 | c] = len(parent)
                        parent.append(node)
                        byte.append(c)
                        whole.append(False)
                    node = nxt
                if piece:
                    whole[node] = True
        # by depth: a link only needs links of shorter strings
        depth = [0] * len(parent)
        for v in range(2, len(parent)):
            depth[v] = depth[parent[v]] + 1
        fail, pops = [NONE] * len(parent), [0] * len(parent)
        for v in sorted(range(2, len(parent)), key=depth.__getitem__):
            if whole[v]:
                fail[v], pops[v] = INNER, 1
                continue
            u, popped = fail[parent[v]], pops[parent[v]]
            while u != NONE and u << 8 | byte[v] not in go:
                popped += pops[u]
                u = fail[u]
            if u != NONE:
                fail[v], pops[v] = go[u << 8 | byte[v]], popped
        self.go, self.fail, self.pops = go, fail, pops
        self.memory: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 for an empty word, -1 if greedy longest match cannot cover it."""
        go, fail, pops = self.go, self.fail, self.pops
        node, n = ROOT, 0
        for c in word:
            nxt = go.get(node << 8 | c)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node == NONE:
                    return -1
                nxt = go.get(node << 8 | c)
            node = nxt
        while node > INNER:
            n += pops[node]
            node = fail[node]
            if node == NONE:
                return -1
        return n

    def remembered(self, word: bytes) -> int:
        n = self.memory.get(word)
        if n is None:
            n = self.older.get(word)
            self.memory[word] = n = self.count(word) if n is None else n
            if len(self.memory) > REMEMBERED:
                self.older, self.memory = self.memory, {}
        return n


@lru_cache(2)
def piece_counter(path: str) -> PieceCounter:
    """The automaton of a vocabulary file, built once a worker.

    A .txt file has a piece a line, those that go on marked with ##. Of a
    tokenizer file, each ordinary entry without its word-end mark is a piece
    for both places; entries of byte-level files are turned into their bytes.
    """
    path = resolve(path)
    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as f:
            lines = [x.rstrip("\n") for x in f]
        return PieceCounter([x.encode() for x in lines if x and not x.startswith("##")], [x[2:].encode() for x in lines if x.startswith("##")])
    with open(path, encoding="utf-8") as f:
        say = json.load(f)
    mark = say["model"].get("end_of_word_suffix") or ""
    special = {x["content"] for x in say.get("added_tokens", [])}
    back = {chr(c): b for b, c in _BYTE.items()}
    byte_level = "ByteLevel" in json.dumps(say.get("pre_tokenizer"))
    pieces = {(x.removesuffix(mark) if mark and x != mark else x) for x in say["model"]["vocab"] if x not in special}
    raw = sorted({bytes(back[c] for c in x) for x in pieces} if byte_level else {x.encode() for x in pieces})
    return PieceCounter(raw, raw)


forget_with(piece_counter.cache_clear)


def token_counts(docs: DataFrame, vocabulary: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_tokens and n_unknown (longs; columns of these names are replaced).

    Words are runs between ASCII white space, A-Z lower-cased. A word that
    greedy longest match cannot cover is one token and counts as unknown. Null
    and empty texts: zeros. Whole texts of any length; a worker remembers a
    bounded number of words. One row per input row, no shuffle.
    """
    ship(docs.sparkSession)
    new = ["n_words", "n_tokens", "n_unknown"]
    keep = [c for c in docs.columns if c != text_col and c not in new]
    schema = StructType([docs.schema[c] for c in keep])
    for c in new:
        schema.add(c, LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("pieces")
        counter = piece_counter(vocabulary)
        for b in batches:
            out: list[list[int]] = [[], [], []]
            for t in b.column("_text"):
                n = list(map(counter.remembered, words(t.as_py())))
                unknown = n.count(-1)
                for c, x in zip(out, (len(n), sum(n) + 2 * unknown, unknown)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in out)], names=keep + new)

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(count, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
