"""Exact substring dedup by column-wise construction of a collection's suffix array.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
in a document with a smaller doc_id.  Equal strings have equal minimizers (the
least hash of their ``KMER``-byte strings), so the strings of a document are
cut into runs of one minimizer.  Only runs whose minimizer occurs in another
document too can hold a repeat.  The distinct strings of such runs form
collections by minimizer (a string that is alone with its minimizer needs
none), and each collection is built column-wise: round after round the
next symbol of every string, from its end, is inserted; the Burrows-Wheeler
transform gives the place of the new suffixes, and the common prefixes of the
neighbours follow from the range minima of the round before.  Suffixes that
share ``LENGTH`` bytes lie together at the end, with their smallest doc_id.

Every array of a round is read and written once from front to back, like the
files of an external construction.  A collection is bounded (``COLLECTION``
strings), so its arrays stay in the task's memory; the files between the steps
are Spark's shuffle files and tables in the shared folder.

Hot minimizers: within a chunk of texts a repeat is known at once and only one
row of each distinct string goes on to the global test; texts are read for one
run of each distinct string alone; a minimizer with more than ``HEAVY`` distinct
strings is dealt out by its ``LENGTH``-byte strings instead, so no collection
grows with a common passage.

Defined cases: null or empty text and texts under ``LENGTH`` bytes lose
nothing; a null doc_id is smaller than any other; rows with equal doc_id do
not remove each other's bytes; rows equal in doc_id and text share one result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, load, with_key
from retentio.llm.tokens import buffers, large, text_chunks

LENGTH = 50
KMER = 20
#: Strings of a run at most; longer runs (of periodic texts) are cut.
RUN = 32
HEAVY = 4096
COLLECTION = 4_000
CHUNK = 3 << 20
#: Bytes of text hashed at once, so that the hashes stay in the processor's cache.
BLOCK = 1 << 14
#: Collections that a task of many builds one after another.
COLLECTIONS_IN_TASK = 8
#: Bytes of text for each part of the minimizer test.
PART_BYTES = 16 << 20
#: Runs that a task gathers before it deals them out: each part gets a blob of them, so the number of
#: blobs would otherwise grow with the square of the corpus.
TOLD = 300_000
KEY = ["d", "t"]
#: Slots that tell which doc_ids may be repeated.
SLOTS = 1 << 14


def with_place(docs: DataFrame) -> DataFrame:
    """(d, t, text): doc_id with a stand-in for null, and a 64-bit hash of the text that tells rows of
    one doc_id apart.  A doc_id of one row needs none: where no id that shares its slot is repeated,
    t is 0 and takes no room in the files.  The slots depend on d alone, so rows of one doc_id agree."""
    rows = with_key(docs).select("d", "t", "text")
    slot = F.pmod(F.xxhash64("d"), F.lit(SLOTS))
    again = rows.select("d").groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(slot.alias("slot")).distinct()
    words = np.zeros(SLOTS // 64, np.uint64)
    for r in again.collect():
        words[r.slot // 64] |= np.uint64(1 << r.slot % 64)
    bits = F.array(*[F.lit(x).cast("long") for x in words.view(np.int64).tolist()])
    hit = F.getbit(F.element_at(bits, F.shiftright(slot, 6).cast("int") + 1), slot.bitwiseAND(63).cast("int"))
    return rows.withColumn("t", F.when(hit == 1, F.col("t")).otherwise(F.lit(0).cast("long")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of strings made of one of ``a`` and the one of ``b`` that starts ``shift`` bytes on."""
    n = len(b) - shift
    b = b[shift:]
    return a[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(33)))


def kmer_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each byte on, by doubling."""
    out = np.empty(max(0, len(raw) - k + 1), np.uint64)
    for i in range(0, len(out), BLOCK):
        out[i:i + BLOCK] = block_hashes(raw[i:i + BLOCK + k - 1], k)
    return out


def block_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    size, power, out, have = 1, (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), None, 0
    while k:
        if k & 1:
            out, have = (power, size) if out is None else (joined(out, power, have), have + size)
        k >>= 1
        if k:
            power, size = joined(power, power, size), size * 2
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out = np.empty(max(0, len(x) - w + 1), x.dtype)
    for i in range(0, len(out), BLOCK):
        out[i:i + BLOCK] = block_min(x[i:i + BLOCK + w - 1], w)
    return out


def block_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (w - size)], x[w - size:]) if w > size else x


def sums_before(x: np.ndarray) -> np.ndarray:
    """Sum of the elements before each place, one more place than elements."""
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


def runs(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = KMER):
    """(minimizer of 48 bits, name, row, start in the row, number of strings) of each run of strings
    of one minimizer in the texts ``raw[off[i]:off[i + 1]]``; the name is a hash of the run's bytes."""
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty
    hashes = kmer_hashes(raw, k)
    least = sliding_min(hashes, length - k + 1)
    # strings that do not cross the end of their text
    size = np.diff(off)
    ok = size >= length
    step = np.zeros(len(least) + 1, np.int8)
    step[off[:-1][ok]] += 1
    np.add.at(step, off[1:][ok] - length + 1, -1)
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    opens[off[:-1][ok]] = True
    at = np.flatnonzero(opens)
    # a run ends before the next one or where its text has no more strings
    row = np.searchsorted(off, at, "right") - 1
    end = np.minimum(np.r_[at[1:], len(least)], off[row + 1] - length + 1)
    n = end - at
    if len(n) and n.max() > RUN:
        cut = -(-n // RUN)
        which = np.repeat(np.arange(len(n)), cut)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
        at, row, n = at[which] + nth * RUN, row[which], np.minimum(RUN, n[which] - nth * RUN)
    # hashes of the run's k-byte strings, each weighted by its place, modulo 2**64
    plain = sums_before(hashes)
    place = np.arange(1, BLOCK + 1, dtype=np.uint64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i:i + BLOCK]
        part *= place[:len(part)] + np.uint64(i)
    placed = sums_before(hashes)
    end = at + n + length - k
    flat = plain[end] - plain[at]
    name = mixed((placed[end] - placed[at] - flat * at.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + flat + n.astype(np.uint64))
    return (least[at] >> np.uint64(16)).astype(np.int64), name.view(np.int64), row, at - off[row], n


#: A run; kind 0: where it occurs.  The others are one row for each distinct string, with its smallest
#: doc_id: 1 alone with its minimizer, 2 with other strings, 3 with more than HEAVY others.
FOUND = "h long, name long, d long, t long, start long, n int, kind int"


def packed(h, name, d, t, start, n) -> bytes:
    """Columns of runs as one compressed value: 6 bytes for the minimizer, differences for places."""
    diff = lambda x: np.diff(x, prepend=0).astype("<i8").tobytes()
    parts = [(h & 0xFFFFFFFF).astype("<u4").tobytes(), (h >> 32).astype("<u2").tobytes(), name.astype("<i8").tobytes(),
             diff(d), diff(t), diff(start), n.astype("u1").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(len(h).to_bytes(8, "little") + b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind, width in (("<u4", 4), ("<u2", 2), ("<i8", 8), ("<i8", 8), ("<i8", 8), ("<i8", 8), ("u1", 1)):
        out.append(np.frombuffer(raw, kind, m, at))
        at += width * m
    lo, hi, name, d, t, start, n = out
    return [lo | hi.astype(np.int64) << 32, name.copy(), np.cumsum(d), np.cumsum(t), np.cumsum(start).astype(np.int32), n.copy()]


def all_unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """The blobs' columns end to end; the list is emptied."""
    some, out = [unpacked(b) for b in blobs], []
    blobs.clear()
    while some[0]:
        out.append(np.concatenate([x.pop() for x in some]))
    return out[::-1]


def in_two(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which rows' minimizer occurs with more than one doc_id."""
    order = np.lexsort((d, h))
    hs, ds = h[order], d[order]
    first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(hs)] - 1
    out = np.zeros(len(h), bool)
    if len(first):
        out[order] = np.repeat(ds[first] != ds[last], last - first + 1)
    return out


def record(kind, *columns) -> pa.RecordBatch:
    names = ("h", "name", "d", "t", "start", "n", "kind")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    if np.isscalar(kind):
        kind = np.full(len(columns[0]), kind)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((*columns, kind), types)], names=list(names))


def first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, mask): rows sorted by ``keys``, and which of them open a new value of the first two."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)


KNOWN = 64  # added to a run's number of strings: its chunk shows the repeat


def ask(parts: int):
    """Task function on (d, t, text): runs of the texts (part, known, blob), dealt to parts by minimizer."""
    def dealt(asked):
        told = [np.concatenate(x) for x in zip(*asked)]
        asked.clear()
        part = (told[0] % parts).astype(np.min_scalar_type(parts))
        order = np.argsort(part, kind="stable")
        told = [x[order] for x in told]
        cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
        return [(p, False, packed(*(x[a:b] for x in told)))
                for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]

    def blobs(out):
        return pa.RecordBatch.from_pydict({"part": pa.array([x[0] for x in out], pa.int32()),
                                           "known": pa.array([x[1] for x in out], pa.bool_()),
                                           "blob": pa.array([x[2] for x in out], pa.binary())})

    def run(batches):
        asked, held = [], 0
        for batch in batches:
            for rows in text_chunks(batch, "text", CHUNK):
                raw, off = buffers(large(rows.column("text")))
                h, name, row, start, n = runs(raw, off)
                cols = h, name, rows.column("d").to_numpy()[row], rows.column("t").to_numpy()[row], start, n
                # repeats within the chunk are known; one row of each string tells the other chunks
                here = in_two(h, cols[2])
                at = np.flatnonzero(here)
                order, opens = first_of_each(*(x[at] for x in cols[:3]))
                of = np.r_[np.flatnonzero(~here), at[order[opens]]]
                asked.append([x[of] for x in (*cols[:4], start.astype(np.int32), (n + KNOWN * here).astype(np.uint8))])
                held += len(of)
                if len(at):
                    yield blobs([(int(name[at[0]]) % parts, True, packed(*(x[at] for x in cols)))])
                if held >= TOLD:
                    yield blobs(dealt(asked))
                    held = 0
        if held:
            yield blobs(dealt(asked))
    return run


def repeated_runs(docs: DataFrame, parts: int) -> DataFrame:
    """``FOUND``: the runs whose minimizer occurs in another document too, and their distinct strings."""
    def meet(batches):
        got = []
        for batch in batches:
            for known, blob in zip(batch.column("known").to_pylist(), batch.column("blob")):
                if known:
                    yield record(0, *unpacked(blob.as_py()))
                else:
                    got.append(blob.as_py())
        if not got:
            return
        cols = all_unpacked(got)
        h, told = cols[0], cols[5] >= KNOWN
        cols[5] = cols[5] % KNOWN
        held = in_two(h, cols[2]) | np.isin(h, h[told])
        at = np.flatnonzero(held & ~told)
        for i in range(0, len(at), 200_000):
            yield record(0, *(x[at[i:i + 200_000]] for x in cols))
        at = np.flatnonzero(held)
        order, opens = first_of_each(*(x[at] for x in cols[:3]))
        at = at[order[opens]]
        # how many distinct strings a minimizer has
        same = np.flatnonzero(np.r_[True, h[at][1:] != h[at][:-1]]) if len(at) else np.zeros(0, np.int64)
        times = np.diff(np.r_[same, len(at)])
        kind = np.repeat(np.where(times == 1, 1, np.where(times <= HEAVY, 2, 3)), times)
        for i in range(0, len(at), 200_000):
            yield record(kind[i:i + 200_000], *(x[at[i:i + 200_000]] for x in cols))

    asked = docs.mapInArrow(ask(parts), "part int, known boolean, blob binary").repartition(parts, "part")
    return asked.select("known", "blob").mapInArrow(meet, FOUND)


STRINGS = "collection int, h long, name long, base int, s binary, lo long"


def strings_of(collections: int):
    """Task function on (d, text, runs): the runs' bytes, dealt to collections by minimizer; the runs of
    a heavy minimizer become their single strings, dealt one by one."""
    def run(batches):
        for batch in batches:
            for rows in text_chunks(batch, "text", CHUNK // 2):
                raw, off = buffers(large(rows.column("text")))
                listed = rows.column("runs")
                lists = listed.offsets.to_numpy().astype(np.int64)
                items = listed.values.slice(lists[0], lists[-1] - lists[0])
                start, n, h, name, heavy = (items.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                row = np.repeat(np.arange(rows.num_rows), np.diff(lists))
                times = np.where(heavy, n, 1).astype(np.int64)
                which = np.repeat(np.arange(len(n)), times)
                base = np.where(heavy[which], np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times), 0)
                begin = off[row[which]] + start[which] + base
                size = np.where(heavy[which], 1, n[which]).astype(np.int64) + LENGTH - 1
                strings = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + size).tolist())]
                deal = (h[which] * 0x5851F42D >> 7) % collections
                for i in np.flatnonzero(heavy[which]).tolist():
                    deal[i] = xxhash.xxh3_64_intdigest(strings[i]) % collections
                yield pa.RecordBatch.from_pydict({
                    "collection": pa.array(deal, pa.int32()), "h": pa.array(h[which], pa.int64()),
                    "name": pa.array(name[which], pa.int64()), "base": pa.array(base, pa.int32()),
                    "s": pa.array(strings, pa.binary()), "lo": rows.column("d").take(pa.array(row[which]))})
    return run


class RangeMin:
    """Minima of ranges of a byte array: a table over powers of two up to ``BLOCK``, and one of the
    blocks' minima for longer ranges."""

    BLOCK = 32

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.fine = self.levels(x, self.BLOCK)
        blocks = x[:self.n - self.n % self.BLOCK].reshape(-1, self.BLOCK)
        self.blocks = len(blocks)
        self.coarse = self.levels(self.fine[-self.n:][:blocks.size:self.BLOCK], self.blocks) if self.blocks else blocks

    @staticmethod
    def levels(x: np.ndarray, most: int) -> np.ndarray:
        """Minima of 1, 2, 4, ... elements from each place on, up to ``most``, in a row."""
        n, depth = len(x), max(1, min(most, len(x)).bit_length())
        table = np.empty(depth * n, x.dtype)
        table[:n] = x
        for k in range(1, depth):
            half, last, now = 1 << (k - 1), table[(k - 1) * n:k * n], table[k * n:(k + 1) * n]
            np.minimum(last[:n - half], last[half:], out=now[:n - half])
            now[n - half:] = last[n - half:]
        return table

    @staticmethod
    def least(table: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Minimum of the two windows, of at most ``most`` elements, at the ends of a..b."""
        k = np.minimum(np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1, most.bit_length() - 1)
        base = k * n
        return np.minimum(table[base + a], table[base + b - (1 << k) + 1])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of x[a..b], both ends included, a <= b."""
        out = self.least(self.fine, self.n, a, b, self.BLOCK)
        # a long range: the whole blocks between its ends as well
        far = np.flatnonzero(b - a >= 2 * self.BLOCK)
        if len(far):
            inner = self.least(self.coarse, self.blocks, -(-a[far] // self.BLOCK), (b[far] + 1) // self.BLOCK - 1, self.blocks)
            out[far] = np.minimum(out[far], inner)
        return out


def build(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction: (string, suffix length, common prefix with the one before) of all
    suffixes of the collection in order.

    After round j the arrays hold the suffixes of at most j symbols: ``bwt`` the symbol before each
    (0 at the start of a string), ``lcp``, and ``ref``, which names string and length.
    """
    count = len(strings)
    size = np.fromiter((len(s) for s in strings), np.int64, count)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(size)
    deep = int(size.max(initial=0))

    def before(who: np.ndarray, length: int) -> np.ndarray:
        """Symbol in front of the suffixes of ``length`` symbols; 0 for whole strings.  UTF-8 has no
        byte above 0xF4, so bytes move up by one."""
        out = np.zeros(len(who), np.uint8)
        more = size[who] > length
        out[more] = flat[ends[who[more]] - length - 1] + np.uint8(1)
        return out

    # round 0: the empty suffix of every string, in the strings' order
    who = np.arange(count, dtype=np.int32)
    bwt, lcp, ref = before(who, 0), np.zeros(count, np.uint8), who * np.int32(128)
    new = np.ones(count, bool)
    for j in range(1, deep + 1):
        # whole strings have no symbol in front and come first
        order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt):]
        # behind the empty suffixes: a suffix for each symbol of the transform, in its order
        at = np.flatnonzero(new[order])
        who = ref[order[at]] >> 7
        new = np.zeros(count + len(order), bool)
        new[count + at] = True
        old = ~new
        out = [np.empty(len(new), x.dtype) for x in (bwt, lcp, ref)]
        for y, x, put in zip(out, (bwt, lcp, ref), (before(who, j), 0, who * np.int32(128) + np.int32(j))):
            y[old] = x
            y[count + at] = put
        # common prefixes of the new suffixes with the ones before, and of the ones behind with them
        touched = np.zeros(len(order) + 1, bool)
        touched[at] = True
        touched[at + 1] = True
        look = np.flatnonzero(touched[:-1])
        out[1][count + look] = 0
        look = look[look > 0]
        x, y = order[look - 1], order[look]
        same = bwt[x] == bwt[y]
        if same.any():
            out[1][count + look[same]] = 1 + RangeMin(lcp)(x[same] + 1, y[same])
        bwt, lcp, ref = out
    return ref >> 7, ref & 127, lcp


def first_documents(strings: list[bytes], lo: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Smallest doc_id in which each ``length``-byte string of each string starts: string after
    string, by offset."""
    who, size, lcp = build(strings)
    long = size >= length
    who, size, lcp = who[long], size[long].astype(np.int64), lcp[long]
    group = np.flatnonzero(np.r_[True, lcp[1:] < length]) if len(who) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(lo[who], group) if len(who) else lo[:0]
    least = np.repeat(least, np.diff(np.r_[group, len(who)]))
    whole = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    base = np.r_[0, np.cumsum(whole - length + 1)]
    out = np.empty(base[-1], np.int64)
    out[base[who] + whole[who] - size] = least
    return out


def solve(batches):
    """Task function on one part of the collections: runs (h, name, from, to, first) of each string, from
    one offset to the one after the last, with the smallest doc_id in which the strings there start."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    whole = pa.concat_tables(tables).combine_chunks()
    tables.clear()
    collection = whole.column("collection").to_numpy()
    for c in np.unique(collection):
        rows = whole.take(pa.array(np.flatnonzero(collection == c)))
        coded = rows.column("s").combine_chunks().dictionary_encode()
        code, strings = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        lo = np.full(len(strings), 2**63 - 1)
        np.minimum.at(lo, code, rows.column("lo").to_numpy())
        first = first_documents(strings, lo)
        n = np.fromiter((len(s) for s in strings), np.int64, len(strings)) - LENGTH + 1
        place = np.cumsum(n) - n
        # offsets of each row's string, and where the smallest doc_id changes
        times = n[code]
        of = np.repeat(np.arange(len(code)), times)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        first = first[place[code][of] + offset]
        a = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (first[1:] != first[:-1])])
        b = np.r_[a[1:], len(of)] - 1
        base = rows.column("base").to_numpy().astype(np.int64)[of[a]]
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(rows.column("h").to_numpy()[of[a]], pa.int64()), "name": pa.array(rows.column("name").to_numpy()[of[a]], pa.int64()),
            "from": pa.array(base + offset[a], pa.int32()), "to": pa.array(base + offset[b] + 1, pa.int32()),
            "first": pa.array(first[a], pa.int64())})


def merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the maximal ranges that the ranges a..b of each row cover; ranges that touch are
    one.  Places count over all rows, so those of a row lie behind those of the rows before it."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    reach = np.maximum.accumulate(b) if len(b) else b
    opens = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (a[1:] > reach[:-1])]) if len(b) else np.zeros(0, np.int64)
    return row[opens], a[opens], reach[np.r_[opens[1:], len(b)] - 1] if len(b) else b


def cut(batches):
    """Task function: the bytes of each text that lie outside its covered ranges."""
    for batch in batches:
        for rows in text_chunks(batch, "text", CHUNK):
            raw, off = buffers(large(rows.column("text")))
            listed = rows.column("ranges")
            row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy())
            items = listed.flatten()
            row, a, b = merged(row, *(off[row] + items.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            # bytes are kept between the ranges
            step = np.zeros(len(raw) + 1, np.int8)
            step[a] += 1
            step[b] -= 1
            kept = raw[np.cumsum(step[:-1], dtype=np.int8) == 0]
            gone = np.bincount(row, b - a, rows.num_rows).astype(np.int64)
            size = np.diff(off)
            ends = sums_before(size - gone)
            data = memoryview(kept)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(rows.column("d").to_numpy(), mask=rows.column("d").to_numpy() == -2**63),
                "n_bytes": pa.array(size), "n_removed": pa.array(gone),
                "n_spans": pa.array(np.bincount(row, minlength=rows.num_rows)),
                "kept_sha256": pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())],
                                        pa.string()),
                "kept": pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [
                    None, pa.py_buffer(ends), pa.py_buffer(kept)]).cast(pa.binary())})


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes
    that remain (they need not be valid UTF-8)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    placed = with_place(docs)
    total = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // PART_BYTES))
    found = scratch.table(repeated_runs(placed, parts), "zstd")
    scratch.release()
    groups = found.where("kind > 1")
    collections = max(1, -(-groups.count() // COLLECTION))
    by_doc = groups.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "h", "name", (F.col("kind") == 3).alias("heavy"))).alias("runs"))
    # the texts are dealt out once: the strings and the cut both read this exchange
    dealt = placed.repartition(*[F.col(k) for k in KEY])
    strings = dealt.join(by_doc, KEY).select("d", "text", "runs").mapInArrow(strings_of(collections), STRINGS)
    tasks = max(min(collections, 32), -(-collections // COLLECTIONS_IN_TASK))
    solved = strings.repartition(tasks, "collection").mapInArrow(
        solve, "h long, name long, from int, to int, first long")
    # a string's name and 16 bits of its minimizer stand for it: 80 bits
    few = F.col("h").bitwiseAND(0xFFFF).cast("int").alias("h")
    alone = found.where("kind = 1").select(few, "name", F.lit(0).alias("from"), F.col("n").alias("to"), F.col("d").alias("first"))
    places = found.where("kind = 0").select(few, "name", *KEY, "start")
    covered = (places.join(solved.withColumn("h", few).unionByName(alone), ["h", "name"]).where("first < d")
               .select(*KEY, (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to") + LENGTH - 1).alias("b")))
    ranges = covered.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    return dealt.join(ranges, KEY, "left").select("d", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(load(spark, sf_dir, "documents")).drop("kept")
