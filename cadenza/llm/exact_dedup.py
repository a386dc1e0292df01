"""Exact deduplication with a stateful stream.

The keys of the documents (digest of the normalised text, rank, stable identifier and content locator, which is
the file) run through a Structured Streaming aggregation whose keyed state lives in RocksDB, on disk, and never
expires: no watermark, one entry per digest, holding the copy that stays, where its
content is, and how many copies came. Later batches meet the entries of earlier ones; a table is read in BATCHES of them. A hit is checked on
the full bytes: content of the members of groups is fetched by identifier and locator, and each copy's normalised text is compared with that of the
copy that stays. Texts with equal digests that differ (a collision) are grouped by their bytes instead.

Everything is DataFrame operations. Only keys are shuffled by digest, and the answer is made of keys alone: each text is hashed
once, and the texts of copies once more, when they are fetched. Entries are combined before the shuffle, so that a third of all rows in one
group is one row per task; the join back on the digest of such a group is one that Spark can split.

Null texts count as empty ones, which are equal to each other. Ties of rank fall to the smallest identifier, null identifiers
coming last. Repeated rows are copies of each other that share an identifier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, free_name, scratch, stored

#: Deleted before texts are compared; fixed by contract.
BLANKS = " \t\n\x0b\f\r"
#: Micro-batches in which a table's keys are read.
BATCHES = 2
#: State on disk; a store is closed when its task has committed, so that an executor has as many open as it has tasks.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keys_of(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """What the stream carries of each document; other, a second hash, tells members of a collision apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(normalised(text).alias("norm"), F.length(text).alias("rank"), F.col(id_col).cast("long").alias("id"), F.input_file_name().alias("locator"))
    return keys.select(digest(F.col("norm")).alias("digest"), "rank", "id", "locator", F.xxhash64("norm").alias("other"), *([] if digest is sha256 else [sha256(F.col("norm")).alias("text_sha256")]))


def keyed_state(keys: DataFrame) -> DataFrame:
    """One row per digest of a batch or stream of keys: the copy that stays, its locator, the number of copies."""
    order = F.struct("rank", F.col("id").isNotNull().alias("known"), F.bitwise_not(F.col("id")).alias("first"))
    best = F.max_by(F.struct("id", "locator", "rank"), order)
    return keys.groupBy("digest").agg(best.alias("kept"), F.count("*").alias("group_size"))


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_state(spark: SparkSession, keys_path: str, schema, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the key files at keys_path through the keyed state and return its entries.

    The checkpoint below folder is the state; a further call with the same folder goes on where the last one ended.
    Each batch writes the entries that it changed, under its number, so that a batch that is repeated after a failure
    replaces its own output. The entry of the last batch holds.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/entries/batch={batch}")

    with _state_settings(spark):
        query = (
            keyed_state(reader.parquet(keys_path)).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    kept = "kept struct<id:bigint,locator:string,rank:int>"
    entries = spark.read.schema(f"digest string, {kept}, group_size bigint, batch int").parquet(f"{folder}/entries")
    last = entries.groupBy("digest").agg(F.max_by(F.struct("kept", "group_size"), "batch").alias("e"))
    return last.select("digest", F.col("e.kept.id").alias("keep_id"), F.col("e.kept.rank").alias("keep_rank"), F.col("e.kept.locator").alias("keep_locator"), F.col("e.group_size").alias("group_size"))


def _content(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], own: Scratch) -> DataFrame:
    """digest, id, rank, other and normalised text of the rows of docs that members (digest, id, rank, locator, other) names, fetched by identifier and locator.

    Where locators do not hold (docs that come out of a shuffle have none), identifiers alone lead to the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.input_file_name().alias("own_locator"), normalised(text).alias("norm"), F.length(text).alias("own_rank"))
    wanted = members.select("digest", "id", "rank", "locator", "other").distinct()
    own_row = (F.col("own_rank") == F.col("rank")) & (F.xxhash64("norm") == F.col("other")) & (digest(F.col("norm")) == F.col("digest"))

    def fetch(same: Column, wanted: DataFrame) -> DataFrame:
        found = rows.join(wanted, F.col("own_id").eqNullSafe(F.col("id")) & same).where(own_row)
        return own.keep(found.select("digest", "id", "rank", "other", "norm"), "content")

    found = fetch(F.col("own_locator") == F.col("locator"), wanted)
    if found.count() < members.count():
        found = fetch(F.lit(True), wanted.drop("locator").distinct())
    return found


def differing(content: DataFrame, entries: DataFrame, own: Scratch) -> DataFrame:
    """The rows of content whose full bytes differ from those of the copy that stays."""
    stays = content.join(entries.select("digest", "keep_id", "keep_rank"), "digest").where(_KEPT)
    stays = own.keep(stays.groupBy("digest").agg(F.min("norm").alias("stays")), "stays")
    return own.keep(content.join(stays, "digest").where("norm != stays").drop("stays"), "differing")


def _regrouped(marked: DataFrame, collided: DataFrame, own: Scratch) -> DataFrame:
    """marked, with the texts that only share a digest grouped by their bytes."""
    order = F.struct("rank", F.col("id").isNotNull().alias("known"), F.bitwise_not(F.col("id")).alias("first"))
    texts = own.keep(collided.groupBy("digest", "norm").agg(F.max_by(F.struct("id", "rank"), order).alias("k"), F.count("*").alias("n")), "texts")
    fewer = own.keep(collided.groupBy("digest").agg(F.count("*").alias("fewer")), "fewer")
    rows = collided.join(texts, ["digest", "norm"]).select("digest", F.col("id").alias("c_id"), F.col("rank").alias("c_rank"), F.col("other").alias("c_other"), "k", "n").distinct()
    same = (F.col("m.digest") == F.col("c.digest")) & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("rank") == F.col("c_rank")) & (F.col("other") == F.col("c_other"))
    marked = marked.join(fewer, "digest", "left").alias("m").join(own.keep(rows, "collided").alias("c"), same, "left").drop(F.col("c.digest"))
    apart = F.col("n").isNotNull()
    return marked.withColumns({
        "keep_id": F.when(apart, F.col("k.id")).otherwise(F.col("keep_id")),
        "keep_rank": F.when(apart, F.col("k.rank")).otherwise(F.col("keep_rank")),
        "group_size": F.when(apart, F.col("n")).otherwise(F.col("group_size") - F.coalesce("fewer", F.lit(0))),
    })


def _marked(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], batches: int, own: Scratch) -> DataFrame:
    """One row per row of docs: id, rank, digest, keep_id, keep_rank, group_size, text_sha256."""
    spark = docs.sparkSession
    keys = own.keep(keys_of(docs, id_col, text_col, digest), "keys")
    files = max(1, len(keys.inputFiles()))
    entries = own.keep(run_state(spark, own.path_of(keys), keys.schema, f"{own.folder}/stream", -(-files // batches)), "entries")
    marked = keys.join(entries, "digest")
    members = own.keep(marked.where("group_size > 1").select("digest", "id", "rank", "locator", "other"), "members")
    collided = differing(_content(docs, members, id_col, text_col, digest, own), entries, own)
    if not collided.isEmpty():
        marked = _regrouped(marked, collided, own)
    hashed = F.col("digest") if digest is sha256 else F.col("text_sha256")
    return marked.select("id", "rank", "digest", "keep_id", "keep_rank", "group_size", hashed.alias("text_sha256"))


#: Whether a marked row is the copy that stays.
_KEPT = "id <=> keep_id and rank = keep_rank"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: the identifier, keep_id, group_size, kept and text_sha256.

    All repeated rows of the copy that stays count as kept here, since nothing tells them apart; drop_copies leaves one
    of them. The result is a table in the shared folder; state and keys are removed.
    """
    with scratch(docs.sparkSession, "exact-dedup") as own:
        marked = _marked(docs, id_col, text_col, digest, batches, own)
        return stored(marked.select(F.col("id").alias(id_col), "keep_id", "group_size", F.expr(_KEPT).alias("kept"), "text_sha256"), "exact-dedup-result")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one row of each group of equal texts. Where identifiers are unique, they alone lead to the rows that go."""
    spark = docs.sparkSession
    with scratch(spark, "exact-dedup") as own:
        marked = own.keep(_marked(docs, id_col, text_col, sha256, BATCHES, own), "marked")
        unique = marked.groupBy("id").count().where("count > 1 or id is null").isEmpty()
        if unique:
            gone = stored(marked.where(f"not ({_KEPT})").select("id"), "exact-dedup-gone")
        else:
            stay = stored(marked.where(_KEPT).select("id", "rank", "digest").distinct(), "exact-dedup-stay")
    if unique:
        name = free_name(docs, "gone_id")
        return docs.join(gone.withColumnRenamed("id", name), F.col(id_col).cast("long") == F.col(name), "left_anti")
    text, own_key = F.coalesce(F.col(text_col), F.lit("")), free_name(docs, "own_key")
    key = lambda i, rank, digest: F.concat_ws(":", digest, rank.cast("string"), i.cast("string"))
    keyed = docs.withColumn(own_key, key(F.col(id_col).cast("long"), F.length(text), sha256(normalised(text))))
    stay = stay.select(key(F.col("id"), F.col("rank"), F.col("digest")).alias(own_key))
    return keyed.join(stay, own_key, "left_semi").dropDuplicates([own_key]).select(*docs.columns)
