"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their
8 positional bytes. The inverted index holds, for each fingerprint, keys made of
three positional bytes: the triples within positions 0-3 and those within 4-7.
Of any five shared positions three lie in one half, so each pair to be found
meets under at least one of these eight triples. Where fingerprints meet, the
positional bytes that they share are tallied, pairs with at least the
guaranteed 5 are kept, and their bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from spantable.cluster import free, scratch, ship, stage
from spantable.llm.text import words

BITS = 3
SHINGLE = 3
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Members of a posting list that one task compares; longer lists are compared in pairs of blocks.
LIMIT = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 without words."""
    w = words(text)
    if not w:
        return 0
    # one buffer of space-joined words: a shingle is a slice of it
    data = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    view, h64 = memoryview(data), xxhash.xxh64_intdigest
    n, ones = len(w) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # long texts in pieces
        s, e = starts[at : min(n, at + 65536)].tolist(), ends[at + k - 1 : min(n, at + 65536) + k - 1].tolist()
        h = np.array([h64(view[a:b], 42) for a, b in zip(s, e)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "simhash") -> DataFrame:
    """docs with the fingerprint of text, a long, as the last column; a column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(name)
    columns = [F.col(f"`{c.replace('`', '``')}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]  # mapInArrow asks for columns by name: not for one with a dot
    text, names = [c.lower() for c in docs.columns].index("text"), [*docs.columns, name]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, h], names=names)

    return docs.select(*columns).mapInArrow(add, StructType(list(docs.schema.fields)).add(name, LongType()))


def links(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph in which distinct fingerprints are joined at `bits` or fewer differing bits.

    Walks the graph from member to member; each step tallies shared positional
    bytes against the members not yet reached, so a dense group costs about its
    size and no list of pairs is made.
    """
    rest = np.unique(prints)
    froms, tos = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            x = todo.pop()
            diff = rest ^ x
            tally = np.count_nonzero(diff.view(np.uint8).reshape(-1, 8) == 0, axis=1)
            near = np.flatnonzero(tally >= 8 - bits)
            near = near[np.bitwise_count(diff[near].view(np.uint64)) <= bits]
            if len(near):
                found = rest[near]
                froms.append(np.full(len(found), root))
                tos.append(found)
                todo += found.tolist()
                rest = np.delete(rest, near)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (empty, empty)


def _postings(prints: DataFrame) -> DataFrame:
    """key and fp for each of the eight triples of positional bytes."""

    def byte(i: int):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))

    keys = [F.lit(n << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for n, (a, b, c) in enumerate(TRIPLES)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def near_links(prints: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints fp that differ in `bits` or fewer bits, bits at most 3.

    Posting lists of one member go before any shuffle of pairs. A list of more
    than `limit` members is cut into blocks by a hash and every pair of blocks
    is compared in a task of its own, so no task holds more than about twice
    the limit whatever the skew, and no link is lost. Lists reach a task sorted
    and are cut where the key changes; short ones are compared many at a time.
    """
    ship(prints.sparkSession)
    postings = _postings(prints)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sizes = stage(sizes.withColumn("blocks", F.ceil(F.col("n") / limit).cast("int")).drop("n"), "simhash-lists")
    rows = postings.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    rows = rows.select("fp", "key", task.alias("task")).repartition("key", "task").sortWithinPartitions("key", "task")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for b in batches:
            now = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "task", "fp"))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            last = np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0]
            if last:
                yield pairs(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if held is not None:
            yield pairs(*held)

    def pairs(key: np.ndarray, task: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begins = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(task) != 0)) + 1, [len(key)]))
        sizes = np.diff(begins)
        a, b = [], []
        # lists of m members, m small: all of them at once, member by member
        for m in range(2, 9):
            at = begins[:-1][sizes == m]
            for i, j in combinations(range(m), 2):
                x, y = fp[at + i], fp[at + j]
                diff = x ^ y
                ok = np.count_nonzero(diff.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= 8 - bits
                ok[ok] = np.bitwise_count(diff[ok].view(np.uint64)) <= bits
                a.append(x[ok])
                b.append(y[ok])
        for s, m in zip(begins[:-1][sizes > 8], sizes[sizes > 8]):
            x, y = links(fp[s : s + m], bits)
            a.append(x)
            b.append(y)
        empty = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [empty]), pa.int64()) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(cut, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that can be reached, for every node of the links (a, b).

    Alternates a minimum over neighbours with a jump to the root's root, until
    nothing changes; a chain of n links takes about log n rounds. Every round
    is cut off by a table in the shared folder, and frees those of the round before.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.filter("a <> b").distinct(), "cc-links")
    roots = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        # hang each old root, too, below the least root that any of its members sees
        moved = roots.join(seen.select(F.col("a").alias("node"), "m"), "node", "left").select("node", "root", F.least("root", "m").alias("m"))
        hung = moved.select("node", "m").union(moved.select(F.col("root").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("root"))
        hung = stage(hung, "cc-hung")
        top = hung.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = stage(hung.join(top, "root", "left").select("node", F.least("root", F.coalesce("upper", "root")).alias("root")), "cc-roots")
        changed = new.join(roots.select("node", F.col("root").alias("old")), "node").filter("root <> old").limit(1).count()
        free(roots, hung)
        roots = new
        if not changed:
            free(both)
            return roots


def _groups(prints: DataFrame, bits: int, limit: int) -> DataFrame:
    """fp and root, one fingerprint of its group, for each distinct fingerprint fp."""
    roots = components(stage(near_links(prints, bits, limit), "simhash-links"))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """docs without text, with simhash (long) and component_id, the smallest doc_id of the document's group.

    Documents are linked when their fingerprints differ in `bits` (at most 3)
    or fewer bits; a group is what links connect. Equal fingerprints, such as
    those of exact copies, are one node of the graph however many rows have
    them, so copies are never paired.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Null doc_id: its group's id is the smallest non-null one, null if there is
    none. Repeated rows each get a row. Empty table: no rows. Other columns
    pass through; columns named simhash or component_id are replaced.
    """
    fp, of_group = _fresh(docs.columns, "fp"), "component_id"
    rest = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in ("text", "simhash", "component_id")]
    with scratch() as keep:
        rows = stage(with_fingerprint(docs.select(*rest, "text"), shingle).drop("text"), "simhash-prints")
        prints = stage(rows.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
        group = stage(_groups(prints.select("fp"), bits, limit).join(prints, "fp"), "simhash-groups")
        least = group.groupBy("root").agg(F.min("least").alias(of_group))
        of = stage(group.join(least, "root").select(F.col("fp").alias(fp), of_group), "simhash-components")
        keep += [rows, of]
    return rows.join(of, rows["simhash"] == of[fp]).drop(fp)


def _fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row of docs for each group of near duplicates, that of the smallest doc_id.

    Decided row by row: of a group's rows the one with the least doc_id stays,
    null ids last, and of rows that repeat it the first. So each group keeps
    exactly one row, also where ids are null or repeated, and a row of another
    group that has the same id is none of its business. Null and empty texts
    are one group, with texts whose fingerprint is close to 0. Empty table: no
    rows. Columns come back as they were, whatever their names.

    Rows are staged once with their fingerprint and a number; everything is
    decided on these. Texts move once, to meet the numbers that stay, by a
    shuffle at every size.
    """
    fp, row = _fresh(docs.columns, "fp"), _fresh(docs.columns, "row")
    with scratch() as keep:
        rows = stage(with_fingerprint(docs, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))).alias("first")
        # partial minima per fingerprint keep a group of copies from meeting in one task
        prints = stage(rows.groupBy(F.col(fp).alias("fp")).agg(first), "simhash-distinct")
        groups = _groups(prints.select("fp"), bits, limit).join(prints, "fp")
        kept = stage(groups.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "simhash-kept")
        keep += [rows, kept]
    return rows.join(kept.hint("shuffle_hash"), row).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")

