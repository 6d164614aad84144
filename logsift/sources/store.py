"""Writing results and reading them back: by case, appended without repeats, and replaced by key.

Tables are Parquet folders. A keyed table is cut to buckets by hash; a new version writes the buckets it touches beside the old
ones and names all folders in a manifest, put in its place last, so that a write that fails midway changes nothing.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below one of the process's own where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        _local[:] = _local or [tempfile.mkdtemp(prefix="logsift-")]
        root = _local[0]
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows written once to a shared folder and read back, for plans that read them several times."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_by_case(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder a case; only the cases in rows are overwritten. Tasks are of even size: a large case is several
    files, small ones share a task (those that hash to a large one's partition are cut with it)."""
    rows.hint("rebalance", F.col("case_id")).write.partitionBy("case_id").option("partitionOverwriteMode", "dynamic").format(form).mode("overwrite").save(path)


def read_case(spark: SparkSession, path: str, schema: str, case_id: str, form: str = "parquet") -> DataFrame:
    """The rows of one case, whose folder alone is read; a case that isn't there has none."""
    reader = spark.read.schema(f"{schema}, case_id string").format(form)
    if re.fullmatch(r"[A-Za-z0-9_-]+", case_id):  # the folder's name as it is, so no other is listed
        jvm, files = _files(spark, path)
        folder = f"{path}/case_id={case_id}"
        reader, path = reader.option("basePath", path), folder if files.exists(jvm.Path(folder)) else path
    return reader.load(path).where(F.col("case_id") == case_id)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, empty if there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_new(rows: DataFrame, path: str, staging: str, key: str = "event_id") -> DataFrame:
    """Appends the rows whose key is neither stored nor repeated; gives the rows added, as written to the new folder staging.

    Of rows that repeat a key the one with the least hash is taken, on every run; null is a key like others. A run that died
    after staging may be run again: what it staged is written anew.
    """
    spark = rows.sparkSession
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_r")).select("_r.*")
    old = stored(spark, path, rows).select(F.col(key).alias("_key"))
    one.join(old, F.col(key).eqNullSafe(F.col("_key")), "left_anti").select(*rows.columns).write.mode("overwrite").parquet(staging)
    new = spark.read.schema(rows.schema).parquet(staging)
    append(new, path)
    return new


def _files(spark: SparkSession, path: str):
    """Hadoop's paths, and the file system of path."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm, jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    jvm, files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(jvm.Path(path))] if files.exists(jvm.Path(path)) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last manifest: how many buckets, and the folders of each; 0 and nothing if there is none."""
    last = max((int(m[1]) for n in _names(spark, f"{path}/manifest") if (m := re.fullmatch(r"(\d+)\.json", n))), default=0)
    return last, json.loads(spark.read.text(f"{path}/manifest/{last}.json", wholetext=True).first()[0]) if last else {"buckets": 0, "folders": {}}


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Puts a manifest in its place whole; false if another writer has taken its number."""
    jvm, files = _files(spark, path)
    draft, place = jvm.Path(f"{path}/draft/{uuid.uuid4().hex}"), jvm.Path(f"{path}/manifest/{number}.json")
    files.mkdirs(place.getParent())
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0))  # never over another
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The last version of a keyed table, empty if there is none yet."""
    folders = [f"{path}/data/{f}" for of in _manifest(spark, path)[1]["folders"].values() for f in of]
    return spark.read.schema(like.schema).parquet(*folders) if folders else like.limit(0)


def replace_keyed(rows: DataFrame, path: str, key: str = "case_id", buckets: int = 64) -> DataFrame:
    """Puts rows in the place of those stored under the same keys, null too; gives the new version.

    Keys are dealt to buckets by hash, as many as the first writer says. Only buckets that rows touch are read and written anew;
    the manifest, put in its place last, names the folders of all others as before. If another writer was first, what rows touch is
    worked out again upon its version, so neither loses rows. Older versions stay readable until vacuum().
    """
    spark, new = rows.sparkSession, uuid.uuid4().hex
    count = _manifest(spark, path)[1]["buckets"] or buckets
    rows.withColumn("_bucket", _bucket(key, count)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/data/{new}")
    touched = sorted(n.removeprefix("_bucket=") for n in _names(spark, f"{path}/data/{new}") if n.startswith("_bucket="))
    while True:
        number, old = _manifest(spark, path)
        if old["buckets"] not in (0, count):  # another writer was the first, with other buckets
            return replace_keyed(rows, path, key, buckets)
        kept, folders, stale = uuid.uuid4().hex, dict(old["folders"]), [f for k in touched for f in old["folders"].get(k, [])]
        for k in touched:
            folders[k] = [f"{new}/_bucket={k}"]
        if stale:
            before = spark.read.schema(rows.schema).parquet(*(f"{path}/data/{f}" for f in stale))
            given = spark.read.schema(rows.schema).parquet(f"{path}/data/{new}").select(F.col(key).alias("_key")).distinct()
            left = before.join(given, F.col(key).eqNullSafe(F.col("_key")), "left_anti").withColumn("_bucket", _bucket(key, count))
            left.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{path}/data/{kept}")
            for n in _names(spark, f"{path}/data/{kept}"):
                if n.startswith("_bucket="):
                    folders[n.removeprefix("_bucket=")].append(f"{kept}/{n}")
        if _commit(spark, path, number + 1, {"buckets": count, "folders": folders}):
            return latest(spark, path, rows)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes all but the last version of a keyed table, and what writers left that failed; none may write or read older ones meanwhile."""
    jvm, files = _files(spark, path)
    number, last = _manifest(spark, path)
    live = {f for of in last["folders"].values() for f in of}
    for write in _names(spark, f"{path}/data"):
        for bucket in _names(spark, f"{path}/data/{write}"):
            if f"{write}/{bucket}" not in live:
                files.delete(jvm.Path(f"{path}/data/{write}/{bucket}"), True)
    for name in _names(spark, f"{path}/manifest"):
        if name != f"{number}.json":
            files.delete(jvm.Path(f"{path}/manifest/{name}"), False)
    files.delete(jvm.Path(f"{path}/draft"), True)


def of_case(rows: DataFrame, case_id: str | None = None, *order: str) -> DataFrame:
    """Stored rows, of one case if it is named, in order."""
    return (rows.where(F.col("case_id") == case_id) if case_id else rows).orderBy(*(order or ("case_id",)))


def load_events(events: DataFrame, path: str, staging: str) -> DataFrame:
    """Adds events to the store; how many of each case were given and added."""
    given = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("in_file"))
    added = append_new(events, path, staging).groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    return given.join(added, "case_id", "left").select("case_id", "in_file", F.coalesce("_n", F.lit(0)).cast("long").alias("inserted"))


def load_all(path: str, staging: str, events: DataFrame, alerts: DataFrame, answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Loads all stored artefacts: events and alerts are added, answers and evaluations replace those of their cases.

    Gives case_id, artefact, in_file and stored: rows given and, of events, those that were new. A case may have an answer and an
    evaluation only once; alerts have no key, so a second load adds them again.
    """
    counts = load_events(events, f"{path}/events", f"{staging}/events").select("case_id", F.lit("events").alias("artefact"), "in_file", F.col("inserted").alias("stored"))
    append(alerts, f"{path}/alerts")
    for name, rows in (("answers", answers), ("evaluations", evaluations)):
        replace_keyed(rows, f"{path}/{name}")
    given = {"alerts": alerts, "answers": answers, "evaluations": evaluations}
    each = [rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("in_file")).select("case_id", F.lit(name).alias("artefact"), "in_file", F.col("in_file").alias("stored")) for name, rows in given.items()]
    return reduce(DataFrame.unionByName, each, counts)
