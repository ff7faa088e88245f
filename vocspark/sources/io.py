"""Reading and writing messages, runs and KPI tables as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.sources.shared import fresh

MESSAGES = T.StructType([T.StructField("tweet_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"))])

#: What a raw row holds where its file has no such column.
RAW_DEFAULTS = {"sentiment": "pending", "topic_keywords": "Pending AI Discovery", "priority": "normal", "detected_language": "en", "resolution_status": "open"}
ENRICHED = ("tweet_id", "conversation_id", "author_id", "inbound", "created_at", "text", "clean_text", "detected_language", "sentiment", "sentiment_score", "priority", "topic_keywords", "cluster_name", "response_time_minutes", "dataset_run_id")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MESSAGES, landing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows) of CSV files with a header; quoted fields may hold line breaks.

    No row is skipped in silence: a row that does not fit the schema is in the second frame, as
    text. The files are parsed once, into a Parquet table at ``landing``, and both frames read it.
    """
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    landing = landing or fresh(spark, "landing")
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    spark.read.schema(kept).options(**options).csv(path).write.parquet(landing)
    rows = spark.read.schema(kept).parquet(landing)
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def csv_schema(spark: SparkSession, path: str, rows: int = 1000, **options: object) -> T.StructType:
    """The schema of CSV files with a header, resolved once on the first ``rows``: long, double, boolean, timestamp, else string."""
    first = spark.read.options(header=True, multiLine=True, escape='"').options(**options).csv(path).limit(rows)
    kinds = ("bigint", "double", "boolean", "timestamp")
    fits = {(c, k): F.count(F.col(f"`{c}`").try_cast(k)) == F.count(f"`{c}`") for c in first.columns for k in kinds}
    some = {c: F.count(f"`{c}`") > 0 for c in first.columns}
    found = first.agg(*(x.alias(f"fit_{i}") for i, x in enumerate([*fits.values(), *some.values()]))).first()
    known = dict(zip([*fits, *some], found))
    return T.StructType([T.StructField(c, T._parse_datatype_string(next((k for k in kinds if known[c] and known[c, k]), "string"))) for c in first.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def match_columns(df: DataFrame, target: T.StructType) -> DataFrame:
    """``df`` in the columns of ``target``, matched in any letter case; missing ones are null."""
    low = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{low[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in low else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields))


def match_rows(df: DataFrame, target: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows in the columns of ``target``, bad rows as they came with ``bad_columns``): see ``match_columns``.

    A row is bad if a value that is there does not fit its column's type; it goes to the second
    frame, and loading goes on.
    """
    low = {c.lower(): c for c in df.columns}
    fields = [f for f in target.fields if f.name.lower() in low]
    misfit = lambda f: F.col(f"`{low[f.name.lower()]}`").isNotNull() & F.col(f"`{low[f.name.lower()]}`").try_cast(f.dataType).isNull()
    names = F.array_compact(F.array(*(F.when(misfit(f), f.name) for f in fields))) if fields else F.array().cast("array<string>")
    judged = df.select(F.struct("*").alias("row"), names.alias("names"))
    return match_columns(judged.where("size(names) = 0").select("row.*"), target), judged.where("size(names) > 0").select("row.*", F.col("names").alias("bad_columns"))


def with_defaults(df: DataFrame, run_id: str) -> DataFrame:
    """Raw rows ready to append: defaults for missing columns, a negative number in place of an id that is none.

    Rows that are equal in id, time, author and text get equal numbers.
    """
    for name, value in RAW_DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    number = F.col("tweet_id").cast("string").try_cast("long")
    # A negative number from the row's own hash needs no ordering of all rows, and is the same in a second run.
    own = -1 - F.abs(F.xxhash64("tweet_id", "created_at", "author_id", "text") % (1 << 62))
    return df.withColumn("tweet_id", F.coalesce(number, own)).withColumn("dataset_run_id", F.lit(run_id))


def append_messages(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("dataset_run_id").parquet(path)


def enriched(df: DataFrame) -> DataFrame:
    """The fixed columns of enriched messages, in order; missing ones are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ENRICHED))


def fill_in(messages: DataFrame, enrichment: DataFrame, columns: list[str], keys: tuple[str, ...] = ("tweet_id", "dataset_run_id"), only_empty: str | None = None) -> DataFrame:
    """``messages`` with ``columns`` taken from ``enrichment`` where it has a value; with ``only_empty``, only where that column is empty."""
    new = enrichment.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)).dropDuplicates(list(keys))
    joined = messages.join(new, list(keys), "left")
    may = F.lit(True) if only_empty is None else F.coalesce(F.trim(only_empty) == "", F.lit(True))
    return joined.select(*(F.when(may, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in messages.columns))


def replace_runs(df: DataFrame, path: str, run: str = "dataset_run_id") -> None:
    """Write ``df`` over the partitions of the runs it has; other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str = "created_at") -> DataFrame:
    """Rows of both, one per key: the newest, and the new table's on ties."""
    both = old.select("*", F.lit(0).alias("upsert_side")).unionByName(new.select("*", F.lit(1).alias("upsert_side")), allowMissingColumns=True)
    rows = both.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col(newest).alias("newest"), "upsert_side", F.struct(*(c for c in both.columns if c != "upsert_side")).alias("row"))
    latest = rows.groupBy(*(f"key_{i}" for i in range(len(keys)))).agg(F.max_by("row", F.struct("newest", "upsert_side")).alias("row"))
    return latest.select("row.*")


def without_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("dataset_run_id") != run_id)


def drop_run(spark: SparkSession, path: str, run_id: str | None, run: str = "dataset_run_id") -> bool:
    """Take a run out of a table partitioned by run; whether it was there. No other run is read or written.

    The run's folder gets a hidden name in one step, so that who starts to read sees all of it or
    nothing, and is deleted then; what a lost driver leaves under such a name no reader sees. A
    store without renames moves file by file. Null names the rows without a run.
    """
    jvm = spark._jvm.org.apache
    folder = jvm.hadoop.fs.Path(path, jvm.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(run, run_id))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = jvm.hadoop.fs.Path(path, f"_dropped-{uuid.uuid4().hex}")
    if not files.exists(folder) or not files.rename(folder, hidden):
        return False
    files.delete(hidden, True)
    return True


def payloads(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., payload): all other columns as one JSON document."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias("payload"))


def latest_runs(messages: DataFrame, most: int = 10) -> DataFrame:
    """The catalogue of runs, newest first."""
    runs = messages.groupBy("dataset_run_id").agg(F.count("*").alias("records"), F.max("created_at").alias("uploaded_at"))
    return runs.orderBy(F.desc("uploaded_at"), "dataset_run_id").limit(most)


LEGACY = "kpis struct<total: long, negative: long>, topics array<struct<topic: string, volume: long>>, new_issues array<string>, recurring_issues array<string>, emerging_issues array<string>"


def migrate_topics(documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Topic rows (run_id, topic, volume) of legacy JSON documents (run_id, payload) that ``existing`` lacks."""
    rows = documents.select("run_id", F.explode(F.from_json("payload", LEGACY)["topics"]).alias("t")).select("run_id", "t.topic", "t.volume")
    return rows.join(existing.select("run_id", "topic"), ["run_id", "topic"], "left_anti")


def migrate_issues(documents: DataFrame) -> DataFrame:
    """(run_id, kind, issue) of the three lists of issues; a run without issues has none."""
    doc = documents.select("run_id", F.from_json("payload", LEGACY).alias("d"))
    kinds = [doc.select("run_id", F.lit(k).alias("kind"), F.explode(F.col(f"d.{k}_issues")).alias("issue")) for k in ("new", "recurring", "emerging")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def current_status(history: DataFrame) -> DataFrame:
    """The latest status (status, message) of each run from an append-only history."""
    return history.groupBy("run_id").agg(F.max_by(F.struct("status", "message"), F.struct("at", "seq")).alias("s")).select("run_id", "s.status", "s.message")


def last_rows(history: DataFrame, most: int = 15) -> DataFrame:
    return history.orderBy(F.desc("at"), F.desc("seq")).limit(most)


def read_jdbc(spark: SparkSession, url: str, table: str, id_col: str, low: int, high: int, partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table in equal ranges of its id, read in parallel. Needs the driver's jar and a server."""
    options = {"url": url, "dbtable": table, "partitionColumn": id_col, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


#: Parts into which one query of counts divides a range of ids.
JDBC_PARTS = 256


def jdbc_ranges(spark: SparkSession, url: str, table: str, id_col: str, most_rows: int, properties: dict[str, str] | None = None) -> list[tuple[int, int]]:
    """Ranges [low, high) of a whole-number id that cover a table in order, of at most ``most_rows`` rows each as counted.

    The database counts rows in ``JDBC_PARTS`` parts of a range; a part with too many is counted in
    parts again, and neighbours are put together while they fit. Only a single id that occurs more
    often than that is a range by itself. The driver gets counts of parts, never rows. Empty for
    a table without ids; nulls are in no range.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(id_col)

    def ask(query: str) -> list:
        return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load().collect()

    low, high = ask(f"select min({name}) as a, max({name}) as b from {table}")[0]
    if low is None:
        return []
    counted, open_ = [], [(int(low), int(high) + 1)]
    while open_:
        first, end = open_.pop()
        width = max(1, -(-(end - first) // JDBC_PARTS))
        place = f"{name} - ({first})"
        part = f"({place} - mod({place}, {width})) / {width}"
        rows = ask(f"select part, count(*) as n from (select {part} as part from {table} where {name} >= {first} and {name} < {end}) p group by part")
        for no, n in rows:
            begin = first + int(no) * width
            if n > most_rows and width > 1:
                open_.append((begin, min(end, begin + width)))
            else:
                counted.append((begin, min(end, begin + width), int(n)))
    ranges: list[tuple[int, int]] = []
    held = 0
    for begin, end, n in sorted(counted):
        if ranges and held + n <= most_rows:
            ranges[-1], held = (ranges[-1][0], end), held + n
        else:
            ranges.append((begin, end))
            held = n
    return ranges


def read_jdbc_measured(spark: SparkSession, url: str, table: str, id_col: str, most_rows: int = 1_000_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table in parallel reads of about ``most_rows`` rows by counted ranges of its id (``jdbc_ranges``), however its ids lie.

    The reads cover every id: each begins where the one before ends, the first and last are open, so
    that rows which come in after the count are read too, and rows without an id are one read more.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(id_col)
    cuts = [begin for begin, _ in jdbc_ranges(spark, url, table, id_col, most_rows, properties)][1:]
    sides = [f"{name} >= {cut}" for cut in cuts], [f"{name} < {cut}" for cut in cuts]
    reads = [" and ".join(filter(None, pair)) for pair in zip([None, *sides[0]], [*sides[1], None], strict=True)]
    reads = [r or f"{name} is not null" for r in reads]
    return spark.read.jdbc(url, table, predicates=[*reads, f"{name} is null"], properties=properties or {})
