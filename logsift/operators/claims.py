"""Claims in answers' texts (times, volumes, names) checked against the events of their case.

Texts are cut to matches by built-in functions; facts are one row a case, and only claims meet events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = "array<struct<step: int, event_id: string, description: string>>"
MARK = "\u0001"
#: Patterns of claims, and the words that make a number of files one of downloads or a size one of all.
TIMES = (r"(?iU)\d+\s*(?:minutes?|hours?|seconds?)\s*(?:after|before|later|of)", r"(?iU)within\s+\d+\s*(?:minutes?|hours?|seconds?)", r"(?iU)shortly\s+after")
FILES = r"(?iU)\d+\s*(?:files?|documents?)"
SIZES = r"(?iU)[~(]?\s*\d+(?:\.\d+)?\s*(?:bytes?|KB|MB|GB)\s*\)?"
SPANS = r"(?iU)(?:over|within|in|across)\s+\d+\s*(?:minutes?|hours?|days?|weeks?)"
DOWNLOAD_WORDS = ("download", "exfiltrat", "collect", "stole", "bulk")
TOTAL_WORDS = ("total", "~", "approximately")
ENTITIES = {"user": r"(?U)\buser_\d+\b", "ip_address": r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "file_path": r"(?U)/(?:data|var|etc|tmp|home|opt)/[\w./\-]+"}
EVENT_ID = r"(?U)evt_\w+"
TOLERANCE, SHORTLY = 5.0, 10.0  # minutes


def chain_of(column: str = "attack_chain") -> Column:
    """The steps of a chain, whatever else they hold; null is none."""
    return F.coalesce(F.transform(column, lambda s: F.struct(s["step"].alias("step"), s["event_id"].alias("event_id"), s["description"].alias("description"))), F.array().cast(CHAIN))


def texts(answers: DataFrame) -> DataFrame:
    """case_id, pos (null: the narrative), event_id of the step, and text, of every text of each answer."""
    steps = F.transform(chain_of(), lambda s, i: F.struct(i.alias("pos"), s["event_id"].alias("event_id"), s["description"].alias("text")))
    told = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("event_id"), F.col("narrative").alias("text")))
    return answers.select("case_id", F.explode(F.concat(steps, told)).alias("_x")).select("case_id", "_x.*").where("text <> ''").withColumn("text", F.replace("text", F.lit(MARK), F.lit(" ")))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_context(text: Column, pattern: str, reach: int) -> Column:
    """Each match with up to reach characters on either side, in lower case: array of (claim, context)."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)

    def one(i: Column, p: Column) -> Column:
        start = F.aggregate(F.slice(p, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        back, claim = F.least(start, F.lit(reach)), F.get(p, i)
        return F.struct(claim.alias("claim"), F.lower(F.substring(text, start - back + 1, back + F.length(claim) + reach)).alias("context"))

    # an array of one element binds the pieces once; matches stand at odd places
    found = lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i % 2 == 1), lambda i: one(i, p))
    return F.transform(F.array(pieces), found)[0]


def _number(claim: Column) -> Column:
    return F.regexp_extract(claim, r"(\d+(?:\.\d+)?)", 1).cast("double")


def _unit(claim: Column, units: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in units.items():
        out = F.when(F.lower(claim).rlike(rf"\d\s*{name}"), value).otherwise(out)
    return out


def _per_case(answers: DataFrame, found: DataFrame, checked: str, wrong: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("wrong").alias("_w"))
    return answers.select("case_id").join(sums, "case_id", "left").select("case_id", zero("_n").alias(checked), zero("_w").alias(wrong))


def temporal_claims(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Claims of a lapse of time, and how many are more than TOLERANCE minutes off the span of the events cited with them.

    A step cites a set of ids, its own too; the narrative a list, in which an id named twice counts as two. Fewer than two
    known ids: no error.
    """
    said = texts(answers).withColumn("claims", F.flatten(F.array(*(matches(F.col("text"), p) for p in TIMES)))).where(F.size("claims") > 0).withColumn("_row", F.coalesce("pos", F.lit(-1)))
    ids = matches(F.col("text"), EVENT_ID)
    cited = F.when(F.col("pos").isNull(), ids).otherwise(F.array_distinct(F.concat(ids, F.when(F.col("event_id") != "", F.array("event_id")).otherwise(F.array().cast("array<string>")))))
    timed = said.select("case_id", "_row", F.explode(cited).alias("event_id")).join(events.where("t is not null").select("case_id", "event_id", "t"), ["case_id", "event_id"])
    gaps = timed.groupBy("case_id", "_row").agg(F.count(F.lit(1)).alias("_n"), ((F.max("t") - F.min("t")) / 6e7).alias("_gap"))
    rows = said.select("case_id", "_row", F.explode("claims").alias("claim")).join(gaps, ["case_id", "_row"], "left")
    shortly = F.lower("claim").startswith("shortly")
    claimed = _number(F.col("claim")) * _unit(F.col("claim"), {"second": 1 / 60, "minute": 1.0, "hour": 60.0})
    off = F.when(shortly, F.col("_gap") > SHORTLY + TOLERANCE).otherwise(F.abs(F.col("_gap") - claimed) > TOLERANCE)
    return _per_case(answers, rows.withColumn("wrong", (F.col("_n") >= 2) & off), "temporal_claims", "temporal_errors")


def case_facts(events: DataFrame, size: Column | None = None) -> DataFrame:
    """Downloads, their bytes and the span in micros of each case."""
    size = size if size is not None else F.col("metadata.file_size_bytes") if "metadata" in events.columns else F.col("bytes")
    download = F.col("action") == "file_download"
    return events.groupBy("case_id").agg(F.count_if(download).alias("downloads"), F.coalesce(F.sum(F.when(download, size)), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("t") - F.min("t"), F.lit(0)).alias("span"))


def volume_claims(answers: DataFrame, events: DataFrame, size: Column | None = None) -> DataFrame:
    """Claims of numbers of files, of sizes and of time spans, and how many of each are wrong.

    A number of files counts near a word of DOWNLOAD_WORDS (40 characters) and may be off by one. A size counts in the
    narrative or near a word of TOTAL_WORDS (60 characters), if the case has any bytes; it is wrong beyond twice or below half
    of them. A span may be off by 5 minutes, an hour or a day, by its unit.
    """
    facts, text, said = case_facts(events, size), F.col("text"), texts(answers)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("context"), w))
    near = lambda p, reach: said.select("case_id", "pos", F.explode(with_context(text, p, reach)).alias("_c")).select("case_id", "pos", "_c.*").join(facts, "case_id", "left")
    n, c = _number(F.col("claim")), F.col("claim")
    files = near(FILES, 40).where(any_of(DOWNLOAD_WORDS)).withColumn("wrong", F.abs(n - F.coalesce("downloads", F.lit(0))) > 1)
    total = F.col("total_bytes")
    claimed = n * _unit(c, {"byte": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3})
    sizes = near(SIZES, 60).where((total > 0) & (F.col("pos").isNull() | any_of(TOTAL_WORDS))).withColumn("wrong", (claimed > 2 * total) | (claimed < 0.5 * total))
    minute = 6e7
    lasted = n * _unit(c, {"minute": minute, "hour": 60 * minute, "day": 1440 * minute, "week": 10080 * minute})
    slack = _unit(c, {"minute": 5 * minute, "hour": 60 * minute, "day": 1440 * minute, "week": 1440 * minute})
    spans = said.select("case_id", F.explode(matches(text, SPANS)).alias("claim")).join(facts, "case_id", "left").withColumn("wrong", F.abs(F.coalesce("span", F.lit(0)) - lasted) > slack)
    out = answers.select("case_id")
    for name, rows in (("file", files), ("size", sizes), ("span", spans)):
        out = out.join(_per_case(answers, rows.select("case_id", F.coalesce("wrong", F.lit(False)).alias("wrong")), f"{name}_claims", f"{name}_errors"), "case_id")
    return out


def entities(answers: DataFrame) -> DataFrame:
    """case_id, type and value of each distinct user, address and path that an answer's texts name."""
    text = F.concat_ws(" ", "narrative", F.transform("attack_chain", lambda s: s["description"]))
    typed = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    named = F.concat(*(F.transform(F.array_distinct(matches(text, p)), typed(k)) for k, p in ENTITIES.items()))
    return answers.select("case_id", F.explode(named).alias("_e")).select("case_id", "_e.*")


def unknown_paths(paths: DataFrame, resources: DataFrame, salts: int = 16) -> DataFrame:
    """The distinct paths (case_id, value) that begin no resource of their case and that none begins; rows are linear in both sides.

    In order of bytes what begins with x lies between x and x with a byte FF, which UTF-8 never holds. So one resource begins a
    path if the furthest such end of the resources up to it lies beyond it, and a path begins one if the next resource lies before
    the path's own end: a running maximum and a running minimum. Resources are dealt to salts, and each path goes to all of them,
    so a case with any share of the resources is many tasks' work.
    """
    paths = paths.where("value is not null").distinct()
    known = resources.where("resource <> ''").join(paths.select("case_id").distinct(), "case_id", "left_semi").distinct()
    dealt = known.select("case_id", F.pmod(F.xxhash64("resource"), F.lit(salts)).cast("int").alias("_s"), F.col("resource").cast("binary").alias("v"), F.lit(0).alias("kind"))
    asked = paths.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"), F.col("value").cast("binary").alias("v"), F.lit(1).alias("kind"))
    end, part = F.concat(F.col("v"), F.expr("X'FF'")), Window.partitionBy("case_id", "_s")
    up, down = (part.orderBy(v, "kind").rowsBetween(Window.unboundedPreceding, 0) for v in (F.col("v").asc(), F.col("v").desc()))
    rows = dealt.unionByName(asked).withColumn("_reach", F.max(F.when(F.col("kind") == 0, end)).over(up)).withColumn("_next", F.min(F.when(F.col("kind") == 0, F.col("v"))).over(down))
    met = F.coalesce(F.col("_reach") > F.col("v"), F.lit(False)) | F.coalesce(F.col("_next") < end, F.lit(False))
    return rows.where("kind = 1").groupBy("case_id", F.col("v").cast("string").alias("value")).agg(F.bool_or(met).alias("_met")).where("not _met").drop("_met")


def unknown_entities(answers: DataFrame, events: DataFrame) -> DataFrame:
    """The entities that no event of their case holds; a path also counts as known if it begins one or one begins it."""
    named = entities(answers)
    plain = lambda kind, column: named.where(F.col("type") == kind).join(events.select("case_id", F.col(column).alias("value")).distinct(), ["case_id", "value"], "left_anti")
    unknown = unknown_paths(named.where("type = 'file_path'").select("case_id", "value"), events.select("case_id", "resource")).withColumn("type", F.lit("file_path"))
    return plain("user", "user").unionByName(plain("ip_address", "source_ip")).unionByName(unknown).select("case_id", "type", "value")
