"""N-gram Jaccard join with rare-first prefix filtering.

A document's set holds its distinct 5-word shingles as 64-bit hashes; equal
sets are one class.  Shingles are ordered rare first by how often their hash
bucket occurs in the corpus (a table of ``BUCKETS`` counts, whatever the
corpus size), then by hash.  Two sets linked at 0.8 share a shingle in the
first fifth of both; these prefixes are grouped by shingle, and the length and
positional filters decide which classes of one shingle may link.  Candidates
pass a suffix filter on shingle counts by hash range, and each remaining pair
is verified once on the whole sets.

A group of near copies shares its prefix shingles, and all its pairs would
grow with the square of its size.  What is asked for is components, so
``PIVOT_ROUNDS`` rounds of pivots come first: each shingle's class with the
fewest rarer shingles is compared with the others, and links join components.
Then only pairs of classes that still lie in different components are
enumerated, and none of those is left out.

Prefix rows are tested for a second class in packed form: what a chunk of
texts already shows to be shared is dealt out evenly, and one row of it goes
on to the global test, so a shingle that many classes share gathers nowhere.

Defined cases: null or empty text, or text of white space alone, has an empty
set and links with nothing; fewer than five words are one shingle; repeated
rows and texts with equal sets are one class; a null doc_id takes the smallest
doc_id of its component if there is one; extra columns are ignored or, in
``drop_copies``, pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load, small_batches, with_key
from retentio.llm.suffix_dedup import in_two
from retentio.llm.tokens import large, text_chunks

WORDS = 5
#: Similarity as a fraction: NUM / DEN.
NUM, DEN = 4, 5
BUCKETS = 1 << 20
#: Counts travel in pieces of this many buckets.
PIECE = 1 << 14
#: Bits of the filter that picks the texts whose sets are gathered (8 MB; more texts only gather
#: more sets).
FILTER_BITS = 1 << 26
RANGES = 64
PIVOT_ROUNDS = 2
CHUNK = 2 << 20
#: Bytes of text for each part of the test for a second class.
PART_BYTES = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the texts in them); words are runs of other than
    ASCII white space, A-Z lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(large(texts)))
    off = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64), off - off[0]
    words = coded.dictionary.to_pylist()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    # splitting leaves empty strings at the ends of a text
    real = np.fromiter((w != "" for w in words), bool, len(words))[codes]
    return of[codes[real]], np.r_[0, np.cumsum(real)][off - off[0]]


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ hashes[j:len(hashes) - n + 1 + j]) * MIX
        out ^= out >> np.uint64(31)
    return out


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, off = word_hashes(texts)
    whole = chain(hashes, n)
    return [np.unique(whole[a:b - n + 1]) if b - a >= n else chain(hashes[a:b], b - a) if b > a
            else np.zeros(0, np.uint64) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def class_of(shingles: np.ndarray) -> int | None:
    """64-bit name of a set; None for the empty one."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def members_and_counts(docs: DataFrame) -> DataFrame:
    """A row (doc_id, t, n, c, ranges) for each document, ranges being how many shingles lie in each of
    ``RANGES`` hash ranges; and each task's shingle counts (piece, blob)."""
    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for rows in text_chunks(batch, "text", CHUNK):
                sets = shingle_sets(rows.column("text"))
                if not sets:
                    continue
                flat = np.concatenate(sets)
                counts += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
                n = np.asarray([len(s) for s in sets])
                of = np.repeat(np.arange(len(n)), n) * RANGES + (flat >> np.uint64(58)).astype(np.int64)
                ranges = np.bincount(of, minlength=len(n) * RANGES).astype("<i4").reshape(len(n), RANGES)
                yield table({"doc_id": rows.column("doc_id"), "t": rows.column("t"), "n": pa.array(n, pa.int64()),
                             "c": pa.array([class_of(s) for s in sets], pa.int64()),
                             "ranges": pa.array([r.tobytes() for r in ranges], pa.binary()),
                             "piece": pa.nulls(len(n), pa.int32()), "blob": pa.nulls(len(n), pa.binary())})
        used = [i for i in range(BUCKETS // PIECE) if counts[i * PIECE:(i + 1) * PIECE].any()]
        none = pa.nulls(len(used), pa.int64())
        yield table({"doc_id": none, "t": none, "n": none, "c": none, "ranges": pa.nulls(len(used), pa.binary()),
                     "piece": pa.array(used, pa.int32()), "blob": pa.array(
                         [pack(counts[i * PIECE:(i + 1) * PIECE]) for i in used], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, t long, n long, c long, ranges binary, piece int, blob binary")


def corpus_counts(pieces: DataFrame) -> np.ndarray:
    """The tasks' counts added up, ``BUCKETS`` numbers."""
    def add(batches):
        sums = {}
        for batch in batches:
            for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("blob")):
                part = unpack(blob.as_py())[0]
                sums[piece] = sums[piece] + part if piece in sums else part
        yield table({"piece": pa.array(list(sums), pa.int32()), "blob": pa.array([pack(x) for x in sums.values()], pa.binary())})

    got = pieces.repartition("piece").mapInArrow(add, "piece int, blob binary").toArrow()
    out = np.zeros(BUCKETS, np.int64)
    for piece, blob in zip(got.column("piece").to_pylist(), got.column("blob")):
        out[piece * PIECE:(piece + 1) * PIECE] = unpack(blob.as_py())[0]
    return out


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as one compressed value, as differences."""
    body = b"".join(np.diff(x.astype(np.int64), prepend=0).astype("<i8").tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns).to_bytes(8, "little") + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    body = np.frombuffer(raw, "<i8", offset=8).reshape(int.from_bytes(raw[:8], "little"), -1)
    return list(np.cumsum(body, axis=1))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def prefixes(shingles: list[np.ndarray], freq: np.ndarray) -> tuple[np.ndarray, ...]:
    """(token, c, n, pos) of the rarest shingles of each set, as many as a link can need; equal sets
    once."""
    out, seen = ([], [], [], []), set()
    for s in shingles:
        c = class_of(s)
        if c is None or c in seen:
            continue
        seen.add(c)
        k = prefix_size(len(s))
        # a stable sort of the sorted hashes: rare buckets first, then by hash
        rare = np.argsort(freq[(s % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")[:k]
        for x, y in zip(out, (s[rare].view(np.int64), np.full(k, c), np.full(k, len(s)), np.arange(k))):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


ROW = "token long, c long, n long, pos long"


def shared_rows(docs: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """(token, c, n, pos): the prefix rows whose shingle is in the prefix of another class too."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def look(batches):
        for batch in batches:
            for rows in text_chunks(batch, "text", CHUNK):
                cols = prefixes(shingle_sets(rows.column("text")), shared.value)
                token = cols[0]
                here = in_two(token, cols[1])
                at, ask = np.flatnonzero(here), ~here
                ask[at[np.unique(token[at], return_index=True)[1]]] = True
                ask = np.flatnonzero(ask)
                part = (token[ask].view(np.uint64) >> np.uint64(20)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
                out = [(p, False, pack(*(x[ask[order[a:b]]] for x in cols)))
                       for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                if len(at):
                    out.append((int(token[at[0]]) % parts, True, pack(*(x[at] for x in cols))))
                yield table({"part": pa.array([x[0] for x in out], pa.int32()), "known": pa.array([x[1] for x in out], pa.bool_()),
                             "blob": pa.array([x[2] for x in out], pa.binary())})

    def meet(batches):
        names, got = ("token", "c", "n", "pos"), []
        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("blob")):
                if known:
                    yield table(dict(zip(names, unpack(blob.as_py()))))
                else:
                    got.append(blob.as_py())
        if got:
            cols = [np.concatenate(x) for x in zip(*map(unpack, got))]
            at = np.flatnonzero(in_two(cols[0], cols[1]))
            for i in range(0, len(at), 200_000):
                yield table({k: x[at[i:i + 200_000]] for k, x in zip(names, cols)})

    asked = docs.mapInArrow(look, "part int, known boolean, blob binary").repartition(parts, "part")
    return asked.select("known", "blob").mapInArrow(meet, ROW).dropDuplicates(["token", "c"])


def gathered_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(c, shingles): the sets, as bytes, of the texts whose hash ``t`` the bit filter may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        seen = set()
        for batch in batches:
            mine = batch.filter(pa.array(may_hold(shared.value, batch.column("t").to_numpy())))
            for rows in text_chunks(mine, "text", CHUNK):
                out = {c: s for s in shingle_sets(rows.column("text")) if (c := class_of(s)) not in seen and c is not None}
                seen |= set(out)
                yield table({"c": pa.array(list(out), pa.int64()),
                             "shingles": pa.array([s.tobytes() for s in out.values()], pa.binary())})

    return docs.select("t", "text").mapInArrow(run, "c long, shingles binary").dropDuplicates(["c"])


def may_hold(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    at = t % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(rows: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits with those of all ``t`` set; no more than the field itself is collected."""
    at = F.pmod("t", F.lit(FILTER_BITS))
    got = (rows.select(F.floor(at / 8).cast("int").alias("at"), F.expr("shiftleft(1, int(pmod(t, 8)))").alias("byte"))
           .groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[got.column("at").to_numpy()] = got.column("byte").to_numpy()
    return bits


def filtered(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Length and positional filter of two sets that meet in a shingle at ``px`` and ``py``, if it is
    their first common one: 9 * overlap >= 4 * (nx + ny) can still hold."""
    most = F.least(nx - px, ny - py)
    return ((DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)) & ((NUM + DEN) * most >= NUM * (nx + ny)))


def pair(c1: str, c2: str) -> list[Column]:
    return [F.least(c1, c2).alias("a"), F.greatest(c1, c2).alias("b")]


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): in each token's rows, the class with the lowest position against every class of
    another component."""
    lists = rows.groupBy("token").agg(F.min(F.struct("pos", "c", "n", "comp")).alias("p"))
    met = rows.join(lists.select("token", "p"), "token").where(
        (F.col("comp") != F.col("p.comp"))
        & filtered(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    return met.select(*pair("c", "p.c")).distinct()


def cross_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): every two classes of different components that meet in a token and pass the filters."""
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, "token").where((F.col("x.c") < F.col("y.c")) & (F.col("x.comp") != F.col("y.comp"))
                                   & filtered(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    return met.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def suffix_filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets may overlap enough by their counts in each hash range."""
    of = lambda x: classes.select(F.col("c").alias(x), F.col("ranges").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4").reshape(-1, RANGES) for c in ("ra", "rb"))
            # sets that differ by more in their hash ranges than a link allows
            keep = (NUM + DEN) * np.abs(x - y).sum(axis=1) <= (DEN - NUM) * (x.sum(axis=1) + y.sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of NUM / DEN or more."""
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("sa"), batch.column("sb"), []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append((NUM + DEN) * common >= NUM * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, comp) for the nodes of ``links`` (a, b): the smallest node reachable.  Each round takes the
    smallest label of the neighbours, then the label of that label, and is written."""
    edges = scratch.table(links.select("a", "b").union(links.select("b", "a")))
    labels = scratch.table(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.col("c"), F.min("b")).alias("comp")))
    while True:
        near = (edges.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c"))
                .agg(F.min("comp").alias("near")))
        step = labels.join(near, "c").select("c", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        far = labels.select(F.col("c").alias("comp"), F.col("comp").alias("far"))
        step = scratch.table(step.join(far, "comp", "left").select("c", "old", F.coalesce("far", "comp").alias("comp")))
        done = not step.where("old != comp").limit(1).count()
        labels = step.select("c", "comp")
        if done:
            return labels


def relabelled(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (c, comp) after joining the components that ``links`` connect."""
    if labels is None:
        return components(links, scratch)
    of = lambda x: labels.select(F.col("c").alias(x), F.col("comp").alias(f"c{x}"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct())
    merged = components(between, scratch).select(F.col("c").alias("comp"), F.col("comp").alias("top"))
    kept = labels.join(merged, "comp", "left").select("c", F.coalesce("top", "comp").alias("comp"))
    # a merged node that no label names yet is a class by itself
    fresh = merged.join(labels, merged["comp"] == labels["c"], "left_anti").select(
        F.col("comp").alias("c"), F.col("top").alias("comp"))
    return scratch.table(kept.unionByName(fresh))


def similar_classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, c) of each document of (doc_id, t, text), and (c, comp) of each class that is
    linked with another."""
    docs = docs.select("doc_id", "t", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first = scratch.table(members_and_counts(docs))
    members = first.where("piece IS NULL").select("doc_id", "t", "n", "c")
    counts = corpus_counts(first.where("piece IS NOT NULL").select("piece", "blob"))
    rows = scratch.table(shared_rows(docs, counts, max(8, -(-total // PART_BYTES))))
    scratch.release()
    # of each class that may link: the ranges, and the hash of one of its texts
    asked = rows.select("c").distinct()
    classes = scratch.table(first.where("c IS NOT NULL").join(asked, "c").groupBy("c").agg(
        F.min(F.struct("t", "ranges")).alias("x")).select("c", "x.t", "x.ranges"))
    sets, labels, tried = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        now = rows.withColumn("comp", F.col("c")) if labels is None else rows.join(labels, "c", "left").withColumn(
            "comp", F.coalesce("comp", "c"))
        mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
        now = scratch.table(now.join(mixed.select("token"), "token").select("token", "c", "n", "pos", "comp"))
        pairs = cross_pairs(now) if turn == PIVOT_ROUNDS else pivot_pairs(now)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(suffix_filtered(pairs, classes))
        tried = pairs if tried is None else tried.union(pairs)
        need = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        need = need if sets is None else need.join(sets.select("c"), "c", "left_anti")
        more = scratch.table(gathered_sets(docs, bit_filter(classes.join(need, "c").select("t"))))
        sets = more if sets is None else sets.union(more.join(sets.select("c"), "c", "left_anti"))
        links = scratch.table(verified(pairs, sets))
        labels = relabelled(labels, links, scratch)
        if turn < PIVOT_ROUNDS:
            # the pivots have now met all rows of their tokens
            met = now.groupBy("token").agg(F.min(F.struct("pos", "c")).alias("p"))
            rows = now.join(met, "token").where(F.col("c") != F.col("p.c")).select("token", "c", "n", "pos")
    return members, labels


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n, comp) of each row of (doc_id, d, t, text); comp is null for empty sets."""
    with small_batches(docs.sparkSession):
        members, labels = similar_classes(docs, Scratch(docs.sparkSession, "jaccard"))
    return members.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    named = grouped(with_key(docs))
    smallest = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the smallest doc_id
    (null before any other; of equal ones the smallest text hash; of equal rows one).  Rows with an
    empty set all stay."""
    named = grouped(with_key(docs)).withColumn("d", F.coalesce("doc_id", F.lit(-2**63)))
    stay = (named.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("d", "t")).alias("k"))
            .select("k.*", F.lit(True).alias("one"))
            .unionByName(named.where("comp IS NULL").select("d", "t", F.lit(False).alias("one")).distinct()))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(-2**63)).alias("d"), F.xxhash64(text).alias("t"))
    same = Window.partitionBy("d", "t").orderBy(F.lit(0))
    kept = rows.join(stay, ["d", "t"]).withColumn("nth", F.row_number().over(same))
    return kept.where(~F.col("one") | (F.col("nth") == 1)).select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(load(spark, sf_dir, "documents"))
