"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.  DataFrame functions only.

1. A document's size is its number of words; sources (null is one, last in code-point order) weigh 3, 1, 2, repeating.
   Targets share 150 % of all sizes by weight; a target above twice its source's size stops there and the excess goes
   to the others by weight (water filling over the sources sorted by their limit for each unit of weight).
2. A source is dealt by a hash of the id into shards of about ``SHARD_WORDS`` words, so a source with a third of all
   rows is many shards.  A shard's documents, in id order, form one run of words that is cut into ``n`` blocks of about
   ``BLOCK_WORDS`` words that differ by one word at most.
3. Sources get whole blocks by the highest quotients claim / (2 k + 1), and so do the shards of a source.  Only
   quotients near the end of the race are made: the seats that every divisor in question gives are given at once.
4. A shard with quota q takes each block q div n times and q mod n blocks once more, chosen by a seeded permutation of
   the block numbers.  A document gets the words of its blocks, so at most twice its size.

Null texts have size 0 and take 0.  Repeated rows are separate documents; rows that repeat an id lie in one shard, in
the order of their sizes.  Equal quotients go to the first source by name, or the first shard by number.  Very long texts
lie in one shard, which then has more words.  An empty table gives an empty result; columns that aren't named, whatever
their names, play no part.

Any number of sources and shards will do: running sums and ranks over all of them are made by ranges, none in one task.
Only words and ids are shuffled, never texts (whole documents once, where they are wanted).  The tables of sources and
shards are joined without hints: they are broadcast only if their size at run time allows it, and a hot source is split
by the adaptive skew join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
#: Primes above any number of blocks in a shard: strides of the block permutation.
STRIDES = (2147483549, 2147483563, 2147483579, 2147483587, 2147483629, 2147483647)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each of sums, its total over the rows before in the order, which no two rows share a place in.  Rows
    are dealt by ranges of the order, and what stands in a range is written with it; only one row a range meets in one
    task."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target, full): one row for each source; full means the target is the limit."""
    source = F.col("source").asc_nulls_last()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turned = running(totals, [source], {"turn": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    weighed = turned.withColumn("weight", weight).drop("turn").withColumn("limit", F.col("source_size") * float(most))
    weighed = running(weighed.withColumn("ratio", F.col("limit") / F.col("weight")), [F.col("ratio"), source], {"limits": F.col("limit"), "weights": F.col("weight")}, "limits")
    weighed = materialize(weighed, "weighed")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()  # one row
    total, all_weight = (whole["size"] or 0) * share, whole["weight"] or 0.0
    left = F.lit(total) - F.col("limits")
    shared = weighed.withColumn("full", F.col("limit") * (F.lit(all_weight) - F.col("weights")) <= F.col("weight") * left)
    rest = shared.agg(F.sum(F.when(F.col("full"), F.col("limit"))).alias("given"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * (total - (rest["given"] or 0.0)) / F.lit(rest["weight"] or 1.0))
    return shared.select("source", "source_size", "n_docs", target.alias("target"), "full")


def sainte_lague(claims: DataFrame, group: list[str], tie: list[str]) -> DataFrame:
    """Adds ``quota`` long to claims(claim double, limit long, seats long, ...): in each group, ``seats`` seats go to
    the highest quotients claim / (2 k + 1), k < limit; of equal ones to the first by tie.  The claims of a group must sum
    to about its seats.

    A divisor that hands out the seats differs from 1 by at most rows / (2 seats); the seats below that band are sure,
    those above it impossible, so a row makes few quotients and a group as many as a small multiple of its rows.  A group
    may have any number of rows: its quotients are ranked by ranges, not in one task.
    """

    def with_group(df: DataFrame, found: DataFrame) -> DataFrame:
        named = found.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[c for c in found.columns if c not in group])
        same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
        return df.join(named, same).drop(*[f"_g_{c}" for c in group])

    band = with_group(claims, claims.groupBy(*group).agg(F.count("*").alias("_rows")))
    band = band.withColumn("_r", F.col("claim") * F.col("_rows") / F.greatest(F.col("seats"), F.lit(1)) + 3)
    band = band.withColumn("_low", F.greatest(F.lit(0), F.least(F.col("limit"), F.floor(F.col("claim") - F.col("_r")))).cast("long"))
    band = band.withColumn("_high", F.greatest(F.col("_low"), F.least(F.col("limit"), F.floor(F.col("claim") + F.col("_r")))).cast("long"))
    band = materialize(band, "bands")
    free = band.groupBy(*group).agg((F.first("seats") - F.sum("_low")).alias("_free"))
    some = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    keys = list(dict.fromkeys(group + tie))
    raced = band.select(*keys, F.explode(some).alias("_k"), "claim").withColumn("_q", F.col("claim") / (2 * F.col("_k") + 1))
    order = [*[F.col(c).asc_nulls_last() for c in group], F.col("_q").desc(), *[F.col(c).asc_nulls_last() for c in tie], F.col("_k")]
    placed = materialize(running(raced, order, {"_n": F.lit(1)}, "quotients"), "ranked")
    within = with_group(placed, placed.groupBy(*group).agg(F.min("_n").alias("_first")).join(free.select(*[F.col(c).alias(f"_f_{c}") for c in group], "_free"), [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in group]).select(*group, "_first", "_free"))
    won = within.where("_n - _first < _free").groupBy(*keys).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], "_won")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = band.join(won, same, "left").withColumn("quota", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0)))
    return out.select(*claims.columns, "quota")


def _shard(doc_id: Column, n_shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id), n_shards)


def quotas(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with their shard, shards with their quota of blocks)."""
    goals = materialize(targets(sized), "targets")
    n_shards = F.ceil((F.col("source_size") + F.col("n_docs")) / shard_words).cast("long")
    named = goals.select(F.col("source").alias("_source"), "source_size", "target", "full", n_shards.alias("_n_shards"))
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", _shard(F.col("doc_id"), F.col("_n_shards"))).drop("_source")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("_n_shards").alias("n_shards"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("full").alias("full"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("long")
    shards = materialize(shards.withColumn("blocks", blocks), "shards")
    sources = shards.groupBy("source").agg(F.sum("blocks").alias("source_blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("full").alias("full"))
    claim = F.coalesce(F.col("target") * F.col("source_blocks") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    open_ = sources.where("not full").withColumn("claim", claim).withColumn("limit", MOST * F.col("source_blocks"))
    seats = round(open_.agg(F.sum("claim")).first()[0] or 0.0)  # one number
    open_ = open_.withColumn("all", F.lit(0)).withColumn("seats", F.lit(seats).cast("long"))
    given = sainte_lague(open_.select("all", "source", "source_blocks", "claim", "limit", "seats"), ["all"], ["source"])
    full = sources.where("full").select("source", "source_blocks", (MOST * F.col("source_blocks")).alias("quota"))
    by_source = given.select("source", "source_blocks", "quota").union(full).select(F.col("source").alias("_source"), "source_blocks", F.col("quota").alias("seats"))
    parts = shards.select("source", "shard", "n_shards", "words", "blocks").join(by_source, F.col("source").eqNullSafe(F.col("_source")))
    parts = parts.withColumn("claim", F.coalesce(F.col("seats") * F.col("blocks") / F.nullif(F.col("source_blocks"), F.lit(0)), F.lit(0.0))).withColumn("limit", MOST * F.col("blocks"))
    final = sainte_lague(parts.select("source", "shard", "n_shards", "words", "blocks", "claim", "limit", "seats"), ["source"], ["shard"])
    return dealt.drop("_n_shards"), final.select("source", "shard", "n_shards", "words", "blocks", "quota")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row for each row of df; taken counts repeats."""
    sized = materialize(sizes(df, id_col, text_col, source_col), "sizes")
    dealt, shards = quotas(sized, block_words, shard_words)
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "words", "blocks", "quota")
    run = Window.partitionBy("source", "shard").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(run)).withColumn("start", F.col("stop") - F.col("size"))
    joined = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (F.pmod(F.xxhash64(F.lit(SEED + 1), "source", "shard"), F.lit(len(STRIDES))) + 1).cast("int"))
    joined = joined.withColumn("stride", stride).withColumn("shift", F.pmod(F.xxhash64(F.lit(SEED + 2), "source", "shard"), F.nullif(F.col("blocks"), F.lit(0))))
    taken = F.expr("""
        case when size = 0 then 0L
             when quota % blocks = 0 then (quota div blocks) * size
             else (quota div blocks) * size + aggregate(
                 sequence((start * blocks) div words, ((stop - 1) * blocks) div words), 0L,
                 (sum, i) -> sum + if((i * stride + shift) % blocks < quota % blocks,
                     least(stop, ((i + 1) * words + blocks - 1) div blocks) - greatest(start, (i * words + blocks - 1) div blocks), 0L))
        end""")
    return joined.select("doc_id", "source", "size", "source_size", F.coalesce(F.col("target"), F.lit(0.0)).alias("target"), taken.alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of df, all columns, as whole documents: the quotas of blocks in integers of documents.

    A shard with a quota of q of its n blocks stands its documents in the order of their sizes, and the r-th of them
    appears as often as multiples of n lie in (s + (r - 1) q, s + r q], with a seeded start s below n: q div n times, and
    once more for q mod n of every n documents, evenly over all sizes.  So a shard's words differ from its quota by no
    more than its largest document.  Documents without words go.  Rows that repeat an id are documents of their own.
    Texts are shuffled once, by source and shard.
    """
    _, shards = quotas(materialize(sizes(df, id_col, text_col, source_col), "sizes"), block_words, shard_words)
    shards = materialize(shards.where("blocks > 0"), "quotas")
    numbers = shards.groupBy("source").agg(F.first("n_shards").alias("_n_shards")).withColumnRenamed("source", "_source")
    row, doc_id = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id")
    rows = df.select(row, doc_id, F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("h")).where("size > 0")
    placed = rows.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", _shard(F.col("doc_id"), F.col("_n_shards")))
    # The quotas come as a row of their own into each shard's window: no second shuffle joins them.
    given = shards.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("doc_id"), "source", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("h"), "shard", "quota", "blocks")
    both = given.unionByName(placed.select("row", "doc_id", "source", "size", "h", "shard", F.lit(None).cast("long").alias("quota"), F.lit(None).cast("long").alias("blocks")))
    shard = Window.partitionBy("source", "shard").orderBy(F.col("size").desc_nulls_first(), "doc_id", "h")
    first = shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = both.select("row", (F.row_number().over(shard) - 1).cast("long").alias("r"), F.first("quota").over(first).alias("q"), F.first("blocks").over(first).alias("n"), F.pmod(F.xxhash64(F.lit(SEED + 3), "source", "shard"), F.first("blocks").over(first)).alias("s"))
    copies = F.expr("cast((s + r * q) div n - (s + (r - 1) * q) div n as int)")
    repeated = ranked.where("row is not null").select("row", copies.alias("copies")).where("copies > 0")
    return repeated.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
