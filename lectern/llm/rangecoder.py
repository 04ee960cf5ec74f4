"""Adaptive context-mixing range coder for token ids, as two functions of the JVM (``RangeCoder.java``).

A block starts from the same state and knows nothing of others.

Prediction: order 2 (a hash of the last two ids) and order 1 (the last id) each remember an id with a confidence.  The
first candidate is the order-2 id if there is one, else the order-1 id; the second is the order-1 id if it differs.  How
likely the first is comes from mixing three adaptive chances in the logistic domain with weights learned online: by the
order-2 confidence, by the order-1 confidence and agreement, and by the order-0 frequency of the candidate.  The second
has a mixer of its own, over the two confidences and its frequency.  An id that is neither is coded by the block's
order-0 frequencies, kept in a Fenwick tree.

Coding: a range coder with a 56-bit range that gives out 16 bits at a time and carries into what was given out.  All
arithmetic is on integers, so every machine decodes what any other encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jvm

#: Ids in a block.
BLOCK = 1 << 15
#: Ids that can be coded.
VOCABULARY = 1 << 16

_FUNCTIONS = {"lectern_range_encode": ("lectern.RangeEncoder", "binary"), "lectern_range_decode": ("lectern.RangeDecoder", "binary"), "lectern_crc32_join": ("lectern.Crc32Joiner", "long")}


def encoded(spark: SparkSession, ids: Column) -> Column:
    """A block's payload; ids: binary, little-endian 16-bit numbers.  Null gives null, no ids an empty payload."""
    jvm.register(spark, "RangeCoder.java", _FUNCTIONS)
    return F.call_udf("lectern_range_encode", ids)


def decoded(spark: SparkSession, payload: Column, n_ids: Column) -> Column:
    """A block's ids as little-endian 32-bit numbers.  A damaged payload gives wrong ids, but ends."""
    jvm.register(spark, "RangeCoder.java", _FUNCTIONS)
    return F.call_udf("lectern_range_decode", payload, n_ids)


def joined_crc32(spark: SparkSession, sums: Column, sizes: Column) -> Column:
    """crc32 of byte strings one after another from theirs and their sizes, two arrays in order."""
    jvm.register(spark, "RangeCoder.java", _FUNCTIONS)
    return F.call_udf("lectern_crc32_join", sums, sizes)
