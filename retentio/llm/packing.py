"""Packing by Karmarkar-Karp multiway differencing.

Each document's ids, closed by id 1, are cut: whole windows of 2048 first, the
rest into equal pieces of at most 512.  Pieces are dealt by hash into groups
of about 1024, and each group is partitioned by multiway differencing: partial
partitions start as single pieces, the two with the largest imbalance merge
with opposing order (the fullest window of one meets the emptiest of the
other) until one is left.  If a window exceeds the capacity, the group's
window count rises and the differencing runs again, so windows come out near
equal and little is padded.

Only slim piece rows are shuffled, never texts or ids.  Ids depend on the text
alone and groups on the written piece table, so a lost executor costs only its
own tasks.

Defined cases: null or empty text is the single id 1; repeated rows are packed
each; a null doc_id stays null; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch, id_and_text, load, small_batches
from retentio.llm.tokens import WordIds, leave_stage, stage_state, text_chunks

CAPACITY = 2048
PIECE = 512
GROUP = 1024
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Windows of one group have ids group * GROUP_IDS and on.
GROUP_IDS = 1 << 20


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    whole, rest = divmod(n, capacity)
    k = -(-rest // piece)
    return [capacity] * whole + [rest // k + (i < rest % k) for i in range(k)]


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary, a few MB

    def run(batches):
        ids_of = stage_state(("ids", zlib.crc32(shipped.value.encode())), lambda: WordIds(shipped.value))
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                flat, off = ids_of.encode(rows.column("text"))
                ids = np.insert(flat, off[1:], END_ID).astype("<u4")
                off = off + np.arange(len(off))
                n = np.diff(off).tolist()
                parts = [cuts(x, capacity, piece) for x in n]
                count = np.asarray([len(p) for p in parts])
                length = np.asarray([x for p in parts for x in p], np.int64)
                row = np.repeat(np.arange(len(n)), count)
                end = np.cumsum(length)
                begin = end - length
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").take(pa.array(row)), pa.array(begin - off[row]), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.diff(off)[row])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each piece, fill of each window).

    A partial partition is its nonempty fills, falling, with a node for each;
    windows not listed are empty.  Merging adds the fills of one to the
    reversed fills of the other; nodes that meet become the children of a new
    one.
    """
    n = len(sizes)
    partial = {i: (sizes[i:i + 1], np.array([i])) for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    nodes, left, right = n, [], []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (fa, na), (fb, nb) = partial.pop(a), partial.pop(b)
        fb, nb = fb[::-1], nb[::-1]
        both = max(0, len(fa) + len(fb) - windows)
        alone = len(fa) - both
        fills = np.concatenate((fa[:alone], fa[alone:] + fb[:both], fb[both:]))
        ids = np.concatenate((na[:alone], np.arange(nodes, nodes + both), nb[both:]))
        left.append(na[alone:])
        right.append(nb[:both])
        nodes += both
        order = np.argsort(-fills, kind="stable")
        fills, ids = fills[order], ids[order]
        imbalance = int(fills[0]) - (int(fills[-1]) if len(fills) == windows else 0)
        partial[a] = (fills, ids)
        heapq.heappush(heap, (-imbalance, a))
    fills, ids = next(iter(partial.values()))
    window = np.empty(nodes, np.int64)
    window[ids] = np.arange(len(ids))
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        for j in range(len(left) - 1, -1, -1):
            window[left[j]] = window[right[j]] = window[n + j]
    return window[:n], fills


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each piece of at most ``capacity``; the window count rises until all fit."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, fills = difference(sizes, windows)
        if fills[0] <= capacity:
            return window
        windows += max(1, windows // 200)


def pack_group(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    leave_stage()
    rows = rows.sort_values("rid", kind="stable")
    whole = rows["length"].to_numpy() == capacity
    rest = rows["length"].to_numpy()[~whole].astype(np.int64)
    window = np.zeros(len(rows), np.int64)
    if len(rest):
        window[~whole] = pack_sizes(rest, capacity)
    window[whole] = (window[~whole].max() + 1 if len(rest) else 0) + np.arange(whole.sum())
    rows = rows.assign(sequence_id=rows["g"].to_numpy() * GROUP_IDS + window)
    # longest first inside a window, then in the order of the piece table
    rows = rows.sort_values(["sequence_id", "length", "rid"], ascending=[True, False, True], kind="stable")
    rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE,
         group: int = GROUP) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    with small_batches(spark):
        cut = Scratch(spark, "packing").table(pieces(docs, vocabulary, capacity, piece))
    groups = max(1, -(-cut.count() // group))
    # the written table does not change, so neither does the number given to its rows
    numbered = cut.withColumn("rid", F.monotonically_increasing_id())
    numbered = numbered.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    return numbered.groupBy("g").applyInPandas(lambda rows: pack_group(rows, capacity), PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
