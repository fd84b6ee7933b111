"""Secret scans over a blob ledger, in DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content. The ledger holds one row for each (blob, rule version)
pair that was scanned, with its findings; a scan reads only blobs that the ledger lacks under the present rules, one copy
of each whatever the number of paths, and findings are joined back to all paths. Spans and redacted texts take time in
proportion to a text's length and its matches.

Rules: leftmost non-overlapping matches of each kind, then a least length; the base kinds are assign, access and hex, and
the further ones pem and hub only add spans. Offsets are code points, ends exclusive. A match's place comes from the
lengths of the pieces between matches (split) and of the matches themselves.

A ledger may be kept at a path between runs (scan_and_keep); one without a path starts empty.

Scale: one pass addresses the blobs; the text of one row for each blob moves once, unsorted, by its doc_id and blob, so a blob that a
third of all rows share is scanned once and no key gathers its copies, as long as they have ids of their own (rows that
repeat both, or have the same text and no id, all move and are scanned). Only blobs with findings join back.

Defined results: null and empty texts have no findings; repeated rows and a null doc_id are kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._kit import Scratch, fresh

RULE_VERSION = "1"
#: Fixed values, in the order that breaks ties between kinds: kind, pattern, group judged, least length, a cheap test.
RULES = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, None),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    ("hex", "[0-9a-f]{16,}", 0, 16, None),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    ("hub", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 40, None),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Code points of the pieces that a text is cut into before parts of it are taken: a part of a whole text is sought from its start.
PIECE = 1024


def matches_of(text: Column, rank: int, pattern: str, group: int, least: int, needs: str | None) -> Column:
    """A rule's place with its matches in order: the lengths of what lies before each, of the match, and of the part that is judged."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    own = F.transform(found, F.char_length)
    parts = F.arrays_zip(F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(own)).alias("gap"), own.alias("own"), F.transform(judged, F.char_length).alias("judged"))
    has = text.contains(needs) if needs else text.rlike(pattern)
    parts = F.when(has, parts).otherwise(F.array().cast("array<struct<gap:int,own:int,judged:int>>"))
    return F.struct(F.lit(rank).alias("rank"), F.lit(least).alias("least"), parts.alias("parts"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_blobs(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """blob, spans of rows (blob, text), a row for each blob that has findings.

    Texts leave nothing but lengths, a row for each match, which move once; the places of matches are their running sums. A
    list that grows in a fold would be copied for every match.
    """
    found = F.explode(F.array(*(matches_of(F.col("text"), k, *r) for k, (_, *r) in enumerate(rules))))
    rows = blobs.select("blob", found.alias("r")).select("blob", "r.rank", "r.least", F.posexplode("r.parts").alias("nth", "m"))
    rows = rows.select("blob", "rank", "nth", "m.gap", "m.own", (F.col("m.judged") >= F.col("least")).alias("kept"))
    rows = rows.repartition("blob").dropDuplicates(["blob", "rank", "nth"])
    before = Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(before).cast("int")).where("kept")
    kind = F.element_at(F.array(*(F.lit(r[0]) for r in rules)), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("own")).alias("start"), "rank", "end", kind.alias("kind"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def address(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


LEDGER = f"blob binary, rule_version string, spans {SPAN}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; an empty one where nothing was kept yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan_and_keep(docs: DataFrame, path: str | None, rules: tuple = RULES, version: str = RULE_VERSION) -> DataFrame:
    """The findings of scan_history, its ledger read from `path` and what it lacked added there; no path: a ledger of its own.

    Rows are added after their scan; a run that is lost before adds nothing, and a blob that two runs add counts once.
    """
    spark = docs.sparkSession
    found, new = scan_history(docs, read_ledger(spark, path) if path else None, rules, version)
    if path:
        new.write.mode("append").parquet(path)
    return found


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings: doc_id, blob, spans of every row; the rows that the ledger lacked: blob, rule_version, spans).

    The findings are read from tables that are written here, so a ledger may grow afterwards.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    paths = scratch.table(address(docs).select("doc_id", "blob").hint("rebalance"), "paths")  # few files, whatever the splits
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        unseen = scratch.table(unseen.join(ledger.where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti"), "unseen")
    # The short rows are hashed; texts stream past them and are not sorted.
    here = address(docs).alias("d").join(unseen.alias("u").hint("shuffle_hash"), (F.col("d.doc_id").eqNullSafe(F.col("u.doc_id"))) & (F.col("d.blob") == F.col("u.blob")), "left_semi")
    hits = scratch.table(scan_blobs(here, rules), "hits")
    none = F.array().cast(SPAN)
    new = unseen.join(hits, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", none).alias("spans"))
    if ledger is not None:
        old = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).join(paths.select("blob").distinct(), "blob", "left_semi")
        hits = hits.unionByName(scratch.table(old.dropDuplicates(["blob"]).select("blob", "spans"), "old"))
    found = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))
    return found, new


def merged(found: DataFrame) -> DataFrame:
    """(blob, spans: start, end) of rows (blob, spans), one for each blob: spans that overlap or touch as one, in order."""
    rows = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    by = Window.partitionBy("blob").orderBy("start", "end")
    until = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.sum(F.when(until.isNull() | (F.col("start") > until), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its merged spans replaced by a mark."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    gaps = F.arrays_zip(starts.alias("a"), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text))).alias("b"))

    def part(pieces: Column, g: Column) -> Column:
        first = F.floor(g["a"] / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.greatest(F.floor((g["b"] - 1) / PIECE).cast("int") - first + 1, F.lit(1)))
        return F.when(g["b"] > g["a"], F.substring(F.array_join(some, ""), g["a"] % PIECE + 1, g["b"] - g["a"])).otherwise("")

    cut = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))  # bound to a variable, so cut once
    kept = F.flatten(F.transform(cut, lambda pieces: F.transform(gaps, lambda g: part(pieces, g))))
    return F.when(F.size(spans) > 0, F.array_join(kept, mark)).otherwise(text)


def redacted(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, with all their columns, after a scan: texts without their secrets, and n_chars, where there is one, counted anew."""
    blob, spans = fresh(docs, "_blob"), fresh(docs, "_spans")
    hits = merged(scan_and_keep(docs, ledger).where(F.size("spans") > 0).dropDuplicates(["blob"]))
    hits = Scratch(docs.sparkSession, "redact").table(hits.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "hits")
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    whole = docs.join(hits.hint("shuffle_hash"), own == F.col(blob), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(spans), mark))
    new = {"text": text}
    if (kind := dict(docs.dtypes).get("n_chars")) is not None:
        new["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(kind))
    return whole.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
