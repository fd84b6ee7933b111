"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: sources in code-point order (null last) have the given weights in turn and share all words; a target stops at
`most` times its source's size and the excess is shared anew by weight (closed form: the water level over sources sorted
by capacity per weight). Equal blocks of `block_words` words go to the sources by highest quotients target / (2k - 1),
and each source's blocks to its shards in the same way. A shard is laid out as one stream of words, its documents in an
order drawn from the seed; whole passes come first, and the blocks of the last, partial pass are drawn evenly spaced from
a seeded start. What a document gives is the part of its words in drawn blocks, so nothing is listed block by block.

Scale: text is read once; then rows hold a few numbers. Sources are split into shards of about `shard_words` words (at
most `most_shards`, then larger ones), so a source with a third of all rows is spread over many tasks. Tables over
sources and shards are aggregated first; only those see a sort without a key (sources) or by source (shards).

Defined results: a null text has size 0 and gives nothing; null sources form one source, the last; rows are drawn by doc_id
(null as the text "null") and text, so rows without ids or with repeated ids are spread by their texts; only rows that repeat
both stay together in one shard; repeated rows are separate documents; columns beside doc_id, text and source are ignored;
an empty table gives an empty result. A source of fewer words than half a block may give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._kit import WORD, Scratch

#: Sources up to which their quotas are broadcast; more are joined by a shuffle.
MOST_SENT = 20_000


def water_level(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size), one for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("room", (F.col("source_size") * most).cast("double"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "rank")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole).cast("double") - before) / left)
    s = s.withColumn("level", F.max("level").over(whole))
    return s.withColumn("target", F.least(F.col("room"), F.col("level") * F.col("weight"))).drop("room", "level")


def sainte_lague(rows: DataFrame, by: list[str], order: str, votes: Column, seats: Column) -> DataFrame:
    """Adds `quota`: in each group of `by`, `seats` go by the highest quotients votes / (2k - 1), ties by `order`.

    Only seats whose quotient can be near the last one's are compared: with n rows and m seats, a row of share q gets at
    least q (1 - n / 2m) - 1/2 seats and at most q (1 + n / 2m) + 1/2, so about 2n + 5n seats are listed, whatever m is.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    r = rows.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats.cast("double"))
    r = r.withColumn("_n", F.sum(F.when(F.col("_votes") > 0, 1).otherwise(0)).over(group)).withColumn("_all", F.sum("_votes").over(group))
    slack = F.col("_n") / (2 * F.col("_seats"))
    live = (F.col("_seats") > 0) & (F.col("_votes") > 0)
    share = F.col("_votes") / F.col("_all") * F.col("_seats")
    r = r.withColumn("_least", F.when(live, F.greatest(F.lit(0.0), F.floor(share * (1 - slack) - 0.5).cast("double"))).otherwise(0.0).cast("long"))
    r = r.withColumn("_most", F.when(live, F.ceil(share * (1 + slack) + 1.5)).otherwise(F.lit(0)).cast("long"))
    r = r.withColumn("_open", F.col("_seats").cast("long") - F.sum("_least").over(group))
    k = F.explode_outer(F.when(F.col("_most") > F.col("_least"), F.sequence(F.col("_least") + 1, F.col("_most"))))
    listed = r.withColumn("_k", k).withColumn("_quotient", F.col("_votes") / (2 * F.col("_k") - 1))
    place = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("_quotient").desc_nulls_last(), order, "_k"))
    won = listed.withColumn("_won", (F.col("_k").isNotNull() & (place <= F.col("_open"))).cast("long"))
    kept = [c for c in rows.columns]
    return won.groupBy(*kept, "_least").agg(F.sum("_won").alias("_w")).select(*kept, (F.col("_least") + F.col("_w")).alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 1024, shard_words: int = 1 << 17, most_shards: int = 4096, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, taken for each row."""
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.md5(F.coalesce("text", F.lit(""))))), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"))
    scratch = Scratch(spark, "mix")
    sized = scratch.table(sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "sizes")
    sources = water_level(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, most)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("_total", total)
    quotas = sainte_lague(sources, [], "rank", F.col("target"), F.round(F.col("_total") / block_words))
    quotas = quotas.select("key", "source_size", "target", F.col("quota").alias("source_quota"), F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long").alias("n_shards"))
    quotas = scratch.table(quotas, "quotas")
    if quotas.count() <= MOST_SENT:  # rows of a few numbers and a name
        quotas = F.broadcast(quotas)
    placed = sized.join(quotas, "key").withColumn("shard", F.col("draw") % F.col("n_shards"))
    shards = placed.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["key"], "shard", F.col("shard_size"), F.col("source_quota"))
    s = F.col("shard_size")
    give = F.least(F.col("quota") * block_words, most * s)
    shards = shards.withColumn("passes", F.when(s > 0, F.floor(give / s)).otherwise(0).cast("long"))
    shards = shards.withColumn("blocks", F.floor(s / block_words).cast("long"))
    shards = shards.withColumn("drawn", F.least(F.col("blocks"), F.round((give - F.col("passes") * s) / block_words)).cast("long"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "key", F.lit("/"), F.col("shard").cast("string"))), 1, 15), 16, 10).cast("long")
    shards = shards.select("key", "shard", "passes", "blocks", "drawn", F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(0).alias("start"))
    stream = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_end", F.sum("size").over(stream)).join(shards, ["key", "shard"])

    def drawn_before(x: Column) -> Column:
        j = F.least(F.floor(x / block_words), F.col("blocks"))
        until = lambda i: F.floor((i * F.col("drawn") + F.col("start")) / F.col("blocks"))
        part = F.when(j < F.col("blocks"), (until(j + 1) - until(j)) * (x - j * block_words)).otherwise(0)
        return F.when(F.col("blocks") > 0, until(j) * block_words + part).otherwise(0)

    taken = F.col("passes") * F.col("size") + drawn_before(F.col("_end")) - drawn_before(F.col("_end") - F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))
