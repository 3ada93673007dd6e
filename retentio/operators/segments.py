"""A customer's whole feedback text as ordered segments of bounded size (A3).

``feedback_text`` makes one string per customer, which one task builds and one
row holds, however much a customer wrote.  Here every text's place in that
string comes from running totals of lengths (over buckets of like size, so a
customer with a third of all rows is spread), texts are cut where a segment
ends, and only the pieces of one segment meet: no group and no row exceeds
``limit`` characters.  Put together in order, the segments are the string.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.resolve import with_text_column
from retentio.operators.features import KEY
from retentio.operators.lsa import EMBEDDING
from retentio.operators.ranking import range_bucket, running_totals

LIMIT = 1 << 15

# the functions that run in tasks travel with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def feedback_segments(feedback: DataFrame | None, order_by: str = "feedback_id", limit: int = LIMIT) -> DataFrame | None:
    """(customer_id, segment, start, segment_text): characters ``start`` to ``start + limit`` of a customer's
    non-null texts joined by one space in ``order_by`` order; segment 0 is there even if empty.  Texts equal
    in ``order_by`` follow in the order of a hash.  None without a text or key column."""
    if feedback is None or KEY not in feedback.columns:
        return None
    fb = with_text_column(feedback)
    if fb is None:
        return None
    if order_by not in fb.columns:
        raise ValueError(f"feedback needs an order column ({order_by!r}) to join texts deterministically")
    fb = fb.where(F.col(KEY).isNotNull()).select(KEY, F.col(order_by).alias("_at"), F.col("feedback_text").alias("_text"))
    texts = fb.where(F.col("_text").isNotNull()).withColumns({
        "_len": F.length("_text").cast("bigint") + 1, "_one": F.lit(1).cast("bigint")})
    texts = running_totals(range_bucket(texts, [KEY, "_at"]), ["_at", "_tie"], ["_len", "_one"], by=[KEY], bucket="_b")
    first = F.col("_one_cum") == 1
    placed = texts.select(
        KEY, F.when(first, F.col("_text")).otherwise(F.concat(F.lit(" "), "_text")).alias("_piece"),
        (F.col("_len_cum") - F.col("_len") - F.when(first, 0).otherwise(1)).alias("_from"))
    last = F.greatest(F.col("_from") + F.length("_piece") - 1, F.col("_from"))
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("_from") / limit), F.floor(last / limit))).alias("segment"))
    begin = F.greatest(F.col("_from"), F.col("segment") * limit)
    end = F.least(F.col("_from") + F.length("_piece"), (F.col("segment") + 1) * limit)
    cut = cut.select(KEY, "segment", F.struct(begin.alias("at"), F.substring(
        "_piece", (begin - F.col("_from") + 1).cast("int"), (end - begin).cast("int")).alias("text")).alias("part"))
    # empty parts carry nothing; a customer of empty texts alone keeps the one row of the second branch
    cut = cut.where(F.length("part.text") > 0)
    filled = cut.groupBy(KEY, "segment").agg(F.array_join(F.sort_array(F.collect_list("part")).getField("text"), "").alias("segment_text"))
    empty = fb.select(KEY).distinct().join(cut.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.lit(0).cast("bigint").alias("segment"), F.lit("").alias("segment_text"))
    return filled.unionByName(empty).select(KEY, "segment", (F.col("segment") * limit).alias("start"), "segment_text")


def fold_texts(segments: DataFrame, make_fold: Callable) -> DataFrame:
    """customer_id, emb_vector of an encoder that reads a customer's segments in order.

    ``make_fold()`` runs once per task and returns an object with ``start() -> state``, ``step(state, text)
    -> state`` and ``finish(state) -> sequence of float``.  A task holds one state and one batch of segments.
    """
    key_type = segments.schema[KEY].dataType.simpleString()

    def run(batches):
        fold, key, state, begun = make_fold(), None, None, False
        for batch in batches:
            keys, vectors = [], []
            for k, text in zip(batch.column(KEY).to_pylist(), batch.column("segment_text")):
                if not begun or k != key:
                    if begun:
                        keys.append(key)
                        vectors.append(list(map(float, fold.finish(state))))
                    key, state, begun = k, fold.start(), True
                state = fold.step(state, text.as_py())
            if keys:
                yield pa.RecordBatch.from_pydict({KEY: keys, EMBEDDING: pa.array(vectors, pa.list_(pa.float32()))})
        if begun:
            yield pa.RecordBatch.from_pydict({KEY: [key], EMBEDDING: pa.array(
                [list(map(float, fold.finish(state)))], pa.list_(pa.float32()))})

    ordered = segments.select(KEY, "segment", "segment_text").repartition(KEY).sortWithinPartitions(KEY, "segment")
    return ordered.select(KEY, "segment_text").mapInArrow(run, f"{KEY} {key_type}, {EMBEDDING} array<float>")
