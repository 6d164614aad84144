"""Raw logs, baselines, cases, ground truth and answers, read with declared schemas; case and log type come from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import running

#: Fields of the raw rows of each log type, in the order in which the types rank when times tie.
RAW = {
    "auth": "timestamp string, event_type string, username string, ip_address string, result string, session string",
    "file": "timestamp string, event_type string, username string, file_path string, ip_address string, result string, session string, file_size_bytes long",
    "admin": "timestamp string, event_type string, username string, target string, detail string, ip_address string, result string",
    "network": "timestamp string, event_type string, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, action string, rule_name string, bytes_transferred long",
    "db": "timestamp string, event_type string, username string, database string, query string, src_ip string, result string, rows_affected long, duration_ms long",
    "web": "timestamp string, method string, url string, src_ip string, status_code string, user_agent string, response_size long, duration_ms long",
    "email": "timestamp string, event_type string, sender string, recipients array<string>, subject string, attachments array<string>, attachment_size_bytes long, result string",
}
META = "file_size_bytes long, detail string, protocol string, dst_ip string, src_port int, dst_port int, rule_name string, bytes_transferred long, database string, rows_affected long, duration_ms long, user_agent string, response_size long, method string, status_code string, subject string, attachments array<string>, attachment_size_bytes long"
EVENT = f"event_id: string, timestamp: string, source_type: string, user: string, action: string, resource: string, source_ip: string, status: string, session_id: string, severity: string, metadata: struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in META.split(', '))}>"
BASELINE = "department string, role string, normal_hours string, timezone string, normal_ips array<string>, normal_directories array<string>, avg_files_per_day int, avg_downloads_per_day int"
TRUTH = "id string, name string, label string, attacker string, attack_steps array<string>, challenge string"
ANSWER = "verdict string, incident_occurred string, confidence string, confidence_explanation string, suspect string, attack_chain array<struct<step: int, event_id: string, description: string, confidence: string>>, evidence_for array<string>, evidence_against array<string>, gaps array<string>, narrative string, source string"
_NAME = r"scenario_(\d+)_([a-z]+)_logs\.json$"


def minute_of(text: Column) -> Column:
    """Minute of the day of the wall clock as written in an ISO-8601 string."""
    return (F.substring(text, 12, 2).try_cast("int") * 60 + F.substring(text, 15, 2).try_cast("int")).cast("int")


def micros_of(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text))


def objects(pieces: DataFrame) -> DataFrame:
    """file, pos and text of the outermost objects of JSON files, from pieces (file, block, at, value): what stands between closing
    braces, in order of at within a block of a file.

    Whether a piece starts inside a string and how deep depends on all before it. Each block works both out for either start, a
    row a block carries them on, and each block then knows its own start: a file of any size is as many tasks as it has blocks.
    """
    # escapes hide no brace or quote of the structure, and none is cut: no escape ends in a brace
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    outside = lambda text: F.regexp_replace(text, r'"[^"]*+("|\z)', "")
    rows = pieces.withColumn("_b", bare).withColumn("_q", count(F.col("_b"), '"')).withColumn("_o0", count(outside(F.col("_b")), "{")).withColumn("_o1", count(outside(F.concat(F.lit('"'), "_b")), "{")).drop("_b")
    through = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.sum("_q").over(through) - F.col("_q"))
    for h in (0, 1):  # quotes open where the block starts: what the piece opens, and whether its brace closes
        odd = (F.col("_p") + h) % 2 == 1
        closes = ((F.col("_p") + F.col("_q") + h) % 2 == 0).cast("int")
        rows = rows.withColumn(f"_c{h}", closes).withColumn(f"_n{h}", F.when(odd, F.col("_o1")).otherwise(F.col("_o0")) - closes)
    rows = rows.withColumn("_d0", F.sum("_n0").over(through)).withColumn("_d1", F.sum("_n1").over(through))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("_q").alias("q"), F.sum("_n0").alias("n0"), F.sum("_n1").alias("n1"))
    blocks = blocks.withColumn("open", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("depth", F.coalesce(F.sum(F.when(F.col("open"), F.col("n1")).otherwise(F.col("n0"))).over(earlier), F.lit(0)))
    pick = lambda c: F.when(F.col("open"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    known = rows.join(blocks.select("file", "block", "open", "depth"), ["file", "block"])
    ends = ((pick("_c") == 1) & (F.col("depth") + pick("_d") == 0)).cast("int")
    placed = running(known.select("file", "block", "at", "value", ends.alias("_e")), ["file"], F.col("block"), ["at"], F.col("_e"), "pos")
    whole = placed.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("_v"), F.max("_e").alias("_e")).where("_e = 1")
    text = F.concat(F.array_join(F.transform("_v", lambda x: x["value"]), "}"), F.lit("}"))
    return whole.select("file", "pos", F.regexp_replace(text, r"^[^{]*+", "").alias("text"))


def read_raw(spark: SparkSession, path: str, log_type: str) -> DataFrame:
    """case_id, pos (place in the file) and the fields of all files of one type below path; each holds an array of objects or one.

    No files: no rows. Spark cuts files to blocks of spark.sql.files.maxPartitionBytes, whatever their lines, and objects() puts
    together what belongs to one object. An object that isn't JSON has null fields; one that the file's end cuts off is left out.
    """
    row = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in RAW[log_type].split(", ")))
    cut = spark.read.option("pathGlobFilter", f"scenario_*_{log_type}_logs.json").option("lineSep", "}").text(path)
    pieces = cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    named = objects(pieces).select(F.regexp_extract("file", _NAME, 1).alias("case_id"), "pos", F.from_json("text", f"struct<{row}>").alias("x"))
    return named.select("case_id", "pos", "x.*")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each user of an object keyed by user, with the first and last minute of normal hours."""
    kind = f"map<string, struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in BASELINE.split(', ')))}>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("user", "b")).select("user", "b.*")
    minute = lambda k: (F.substring(F.get(F.split("normal_hours", "-"), k), 1, 2).try_cast("int") * 60 + F.substring(F.get(F.split("normal_hours", "-"), k), 4, 2).try_cast("int")).cast("int")
    return rows.withColumn("start_minute", minute(F.lit(0))).withColumn("end_minute", minute(F.lit(1)))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"scenarios array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in TRUTH.split(', ')))}>>").json(path, multiLine=True)
    return rows.select(F.explode("scenarios").alias("x")).select(F.regexp_extract("x.id", r"(\d+)", 1).alias("case_id"), "x.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Events of case definitions, in order of seq within their case."""
    rows = spark.read.schema(f"scenario_id string, name string, label string, description string, events array<struct<{EVENT}>>").json(path, multiLine=True)
    named = rows.select(F.regexp_extract("scenario_id", r"(\d+)", 1).alias("case_id"), F.posexplode("events").alias("seq", "x"))
    return with_times(named.select("case_id", F.col("seq").cast("long").alias("seq"), "x.*"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER).json(path, multiLine=True).withColumn("case_id", F.regexp_extract(F.col("_metadata.file_path"), r"scenario_(\d+)", 1))


def with_times(events: DataFrame) -> DataFrame:
    """Events with t (micros of the instant), local_minute and bytes, as the rules use them."""
    return events.withColumn("t", micros_of(F.col("timestamp"))).withColumn("local_minute", minute_of(F.col("timestamp"))).withColumn("bytes", F.col("metadata.bytes_transferred"))
