"""Exact n-gram Jaccard self-join of documents through a token-group matrix.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Documents with equal sets are one node.

1. Similar nodes are put into groups. Nodes that share a minimum hash are compared with one node among them, first another
   one for each hash function, then the one with the fewest shingles of its own, which of a group of near copies is the
   one that most others link with. Nodes that link join a group.
2. The token-group matrix holds, for each shingle that can matter, the groups whose union contains it. Only each set's
   prefix in one order of all shingles (frequent ones last) can matter.
3. A query (a node) overlaps a group's union by no more than what the query, and any member, holds from their first common
   shingle on. A group whose bound is below the overlap that its smallest fitting member would need stays closed.
4. In open groups the same bound is taken for each member that shares such a shingle. Pairs that pass it are compared by
   sketches, then by their whole texts.

The minimum hashes decide how much work remains, never which links are found.

The frequent shingles come from counts of all shingles of all documents in 2**16 buckets, and from exact counts over
first prefixes kept as a bitmap, so what tasks are sent has the same size for any corpus. No pair within a group of copies is listed.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import Workspace, bitmap, components, in_bitmap

BUCKETS = 16
ID_BITS = 24
U = np.uint64


def sets_of(column: pa.Array, k: int):
    """(first row, list of each text's sorted distinct shingle hashes) for runs of texts."""
    for first, last, data, offsets in T.slices(column):
        word, begin = T.words(data, offsets)
        hashed, at = T.shingles(word, begin, k)
        out = []
        for i in range(last - first):
            x = np.sort(hashed[at[i] : at[i + 1]])
            out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x)
        yield first, out


def _profile(k: int):
    def run(batches):
        counts = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            ids, rows = batch.column(0), []
            for _, sets in sets_of(batch.column(1), k):
                for s in sets:
                    m = T.mix(s)
                    rows.append((len(s), int(m.sum(dtype=U)), int(np.bitwise_xor.reduce(m)) if len(s) else 0))
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> U(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
            n, h1, h2 = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, U), (2, U)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "n", "h1", "h2"])
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.array(-1 - full), pa.array(counts[full]), pa.nulls(len(full), pa.int64())], ["id", "n", "h1", "h2"])

    return run


def sketch_of(s: np.ndarray) -> bytes | None:
    """Counts of a set's hashes in 2**q equal ranges, two to a byte, about 2 to 4 hashes in each; none if one is over 15.

    The sum of the smaller counts of two sets bounds the size of their intersection from above.
    """
    q = max(2, (len(s) - 1).bit_length() - 2)
    counts = np.bincount((s >> U(64 - q)).astype(np.int64), minlength=1 << q)
    return None if counts.max() > 15 else (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def bound(x: bytes, y: bytes) -> int:
    """At least the size of the intersection of the sets with these sketches."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    a, b = (np.stack([z & 15, z >> 4], 1).reshape(-1).astype(np.int64) for z in (a, b))
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)).sum())


def _bounded(num: int, den: int):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("nx", "ny", "kx", "ky")), strict=True)
            keep = [x is None or y is None or (num + den) * bound(x, y) >= num * (m + n) for m, n, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def prefix_of(s: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first hashes of a set in the common order (frequent ones last) of which a linked set must hold at least one."""
    many = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
    rare = s[~often]
    return np.concatenate([rare, s[often]])[:many] if many > len(rare) else rare[:many]


def _reorder(k: int, num: int, den: int, heavy: np.ndarray, crowded: np.ndarray):
    """Prefixes again, with the hashes in the bitmap crowded among the frequent ones, and how many hashes are neither."""

    def run(batches):
        for batch in batches:
            pre, own = [], []
            for _, sets in sets_of(batch.column(1), k):
                for s in sets:
                    often = heavy[(s >> U(64 - BUCKETS)).astype(np.int64)] | in_bitmap(crowded, s)
                    pre.append(prefix_of(s, often, num, den))
                    own.append(len(s) - int(often.sum()))
            begin = np.concatenate([[0], np.cumsum([len(p) for p in pre])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), T.nested(np.concatenate([np.zeros(0, U), *pre]), begin), pa.array(own, pa.int32())], ["id", "prefix", "own"])

    return run


def _sign(k: int, num: int, den: int, functions: int, heavy: np.ndarray):
    seeds = np.random.default_rng(11).integers(1, 2**63, functions, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            ids, n, low, pre, begin, sketch = batch.column(0), [], [], [], [0], []
            for _, sets in sets_of(batch.column(1), k):
                for s in sets:
                    often = heavy[(s >> U(64 - BUCKETS)).astype(np.int64)]
                    rare = s[~often]
                    own = rare if len(rare) else s
                    n.append(len(s))
                    sketch.append(sketch_of(s))
                    # Half of the functions see all of a set, also what a large group of copies makes frequent, half only what is rare.
                    low.append([T.mix((s if i % 2 else own) ^ x).min() for i, x in enumerate(seeds)] if len(s) else [U(0)] * functions)
                    pre.append(prefix_of(s, often, num, den))
                    begin.append(begin[-1] + len(pre[-1]))
            low = np.array(low, U).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), T.nested(low, np.arange(0, len(low) + 1, functions)), T.nested(np.concatenate([np.zeros(0, U), *pre]), np.array(begin)), pa.array(sketch, pa.binary())],
                ["id", "n", "low", "prefix", "sketch"],
            )

    return run


def _among(ids: np.ndarray):
    def run(batches):
        for batch in batches:
            own = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bitmap(ids, own.view(U))))

    return run


def _compare(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            left = [s for _, x in sets_of(batch.column(2), k) for s in x]
            right = [s for _, x in sets_of(batch.column(3), k) for s in x]
            keep = []
            for x, y in zip(left, right, strict=True):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared) and len(both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tokens(k: int):
    def run(batches):
        for batch in batches:
            found = [s for _, sets in sets_of(batch.column(0), k) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U), *found]).view(np.int64))], ["token"])

    return run


def _common(docs: DataFrame, star: DataFrame, k: int, crowd: int) -> DataFrame:
    """Shingles that two of five documents around one centre share, for centres with `crowd` neighbours or more.

    They are what a group of near copies has in common; put last in the order, they leave each copy's own shingles first.
    """
    some = star.groupBy("a").agg(F.count("*").alias("c"), *(F.min_by("b", F.xxhash64("b", F.lit(j))).alias(f"b{j}") for j in range(4))).where(F.col("c") >= crowd)
    ids = some.select(F.explode(F.array("a", "b0", "b1", "b2", "b3")).alias("id")).distinct()
    near = docs.mapInArrow(_among(bitmap(ids, "id", ID_BITS)), "id long, text string").join(ids, "id", "left_semi").select("text")
    return near.mapInArrow(_tokens(k), "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")


def _least_common(num: int, den: int, one: str, other: str) -> str:
    """SQL for the smallest intersection with which two sets of these sizes link."""
    return f"(({num} * (cast({one} as long) + {other}) + {num + den - 1}) div {num + den})"


def _query_groups(work: Workspace, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes of different groups. rows: token, grp, id, n (set size), at (place of the token in the set's order)."""
    matrix = rows.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.expr("n - at")).alias("room"))
    shared = matrix.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    matrix = work.keep(matrix.join(shared, "token"), "matrix")
    query = rows.select("token", F.col("grp").alias("grpx"), F.col("id").alias("a"), F.col("n").alias("nx"), F.col("at").alias("atx"))
    # The overlap of a query with a member is at most what either set holds from their first common shingle on, and must be
    # the more the larger the member: the smallest size that a member here can have gives the group's bound.
    smallest = f"greatest(lo, (cast(nx as long) * {num} + {den - 1}) div {den})"
    opens = F.expr(f"grpx < grp and nx * {den} >= lo * {num} and hi * {den} >= nx * {num} and least(nx - atx, room) >= {_least_common(num, den, 'nx', smallest)}")
    held = work.keep(query.join(matrix, "token").where(opens).select("token", "a", "nx", "atx", "grp"), "held")
    work.drop("matrix")
    member = rows.select("token", "grp", F.col("id").alias("b"), F.col("n").alias("ny"), F.col("at").alias("aty"))
    fits = F.expr(f"nx * {den} >= ny * {num} and ny * {den} >= nx * {num} and least(nx - atx, ny - aty) >= {_least_common(num, den, 'nx', 'ny')}")
    pairs = work.keep(held.join(member, ["token", "grp"]).where(fits).select("a", "b").distinct(), "pairs")
    work.drop("held")
    return pairs


def _links(work: Workspace, docs: DataFrame, signed: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts link. Sketches of a few bytes for each word sort out most others; texts decide the rest."""
    short = signed.select("id", "n", "sketch")
    both = pairs.join(short.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("kx")), "a")
    both = both.join(short.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("ky")), "b")
    pairs = work.keep(both.select("a", "b", "nx", "ny", "kx", "ky").mapInArrow(_bounded(num, den), "a long, b long").distinct(), f"open-{uuid.uuid4().hex}")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = docs.mapInArrow(_among(bitmap(ids, "id", ID_BITS)), "id long, text string")
    both = pairs.join(near.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(near.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_compare(k, num, den), "a long, b long")


def similar_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, num: int = 80, den: int = 100, functions: int = 12, crowd: int = 8, often: float = 0.002
) -> DataFrame:
    """Returns a row for each document: doc_id, n_shingles (its set's size), component_id (smallest id reachable by links).

    Two documents link when den * |A and B| >= num * |A or B|. A document without words, or with a null text, has an
    empty set and links with nothing. Rows with a null id are no documents and are left out. Rows that repeat an id are one
    document: links of any of them count, n_shingles is the largest. Other columns of docs are ignored.
    functions says how many minimum hashes a document is compared by with a node that has the same one; often
    is the share of documents from which a bucket of shingles counts as frequent, crowd the number of prefixes from which
    a shingle does. These three change the cost only.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    found = work.keep(docs.mapInArrow(_profile(words), "id long, n long, h1 long, h2 long"), "sets")
    sets = found.where("id is not null")
    total = sets.count()
    counts = found.where("id is null").groupBy("n").agg(F.sum("h1").alias("c"))
    mean = counts.agg(F.sum("c")).first()[0] or 0
    # At most one number for each of the 2**16 buckets reaches the driver.
    full = [-1 - r.n for r in counts.where(F.col("c") > 2 * mean / (1 << BUCKETS) + max(often * total, 8)).select("n").collect()]
    heavy = np.zeros(1 << BUCKETS, bool)
    heavy[full] = True

    nodes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("id")).select("id", F.col("n").alias("size"))
    signed = work.keep(docs.mapInArrow(_sign(words, num, den, functions, heavy), "id long, n long, low array<long>, prefix array<long>, sketch binary"), "signed")

    low = signed.select("id", "n", "low").join(nodes, (nodes.id == signed.id) & (nodes.size == signed.n), "left_semi").select("id", "n", F.posexplode("low").alias("f", "m"))
    first = low.groupBy("f", "m").agg(F.min_by("id", F.xxhash64("id", "f")).alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    star = low.drop("n").join(first, ["f", "m"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    star = work.keep(star, "star")
    near = work.keep(_links(work, docs, signed, star, words, num, den).distinct(), "near")
    group = work.keep(components(work, near, "group").select("id", F.col("component").alias("grp")), "groups")

    tokens = signed.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= crowd)
    crowded = bitmap(tokens.select("token").unionByName(_common(docs, star, words, crowd)), "token", ID_BITS)
    prefixes = work.keep(docs.mapInArrow(_reorder(words, num, den, heavy, crowded), "id long, prefix array<long>, own int"), "prefixes")
    work.drop("star")

    # Of each bucket's nodes of like size the one with the fewest shingles of its own, and of a node's buckets the one where that is smallest.
    like = F.floor(F.log("n") / F.log(F.lit(den / num)) if num < den else F.col("n")).alias("like")
    bare = low.join(prefixes.select("id", "own"), "id").join(group, "id", "left").select("f", "m", like, "id", "own", F.coalesce("grp", "id").alias("grp"))
    plain = bare.groupBy("f", "m", "like").agg(F.min(F.struct("own", "id", "grp")).alias("p"), F.count("*").alias("c")).where("c > 1").select("f", "m", "like", "p")
    again = bare.join(plain, ["f", "m", "like"]).where("grp <> p.grp").groupBy(F.col("id").alias("b")).agg(F.min("p").alias("p")).select(F.col("p.id").alias("a"), "b")
    near = near.unionByName(work.keep(_links(work, docs, signed, work.keep(again, "again"), words, num, den), "near-again"))
    group = work.keep(components(work, near, "grown").select("id", F.col("component").alias("grp")), "grown-groups")

    rows = prefixes.where(F.size("prefix") > 0).join(signed.select("id", "n").join(nodes, (nodes.id == signed.id) & (nodes.size == signed.n), "left_semi"), "id")
    rows = rows.join(group, "id", "left").select(F.coalesce("grp", "id").alias("grp"), "id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    twice = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    rows = work.keep(rows.join(twice, "token"), "rows")
    pairs = _query_groups(work, rows, num, den)
    work.drop("rows")
    work.drop("prefixes")
    linked = components(work, near.unionByName(_links(work, docs, signed, pairs, words, num, den)), "linked")

    small = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("node"))
    own = sets.join(small, ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("node", "id").alias("node"))
    own = own.join(linked.select(F.col("id").alias("node"), "component"), "node", "left")
    own = own.groupBy(F.col("id").alias("doc_id")).agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "node")).alias("component_id"))
    own = work.keep(own, "own")
    work.only("own")
    return own
