"""Run logs: parsed lines, stages with durations, progress, telemetry; raw files and streams of them.

A line is ``[21 May 2026 15:19:03 UTC INFO] message``; where the bracket has no
time, or there is none, the level is told from the text.  A run's end is a line
of its own, with the exit code in ``exit_code``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphband.session import materialise, shared_dir, ship_package

#: Stages in their order, and what a message of each says, as regular expressions.
STAGES = (
    ("initialization", "Converting matrices to graphs|Graph G_K with"),
    ("coarsening", "Coarsening Heavy Edge Matching|Coarse graph has"),
    ("partitioning", "Multilevel Partitioning Scheme using METIS|Running simulated quantum annealing|Running quantum annealing|Partitioning QAOA|Running QAOA on|Partitioning on coarse graph"),
    ("uncoarsening", "Uncoarsening Kernighan-Lin"),
    ("permutation", "Permuting matrices|Permutation check"),
)
#: Levels that a bracket can end with, and how times are written.
LEVELS = "INFO|VERBOSE|WARNING|ERROR"
TIMES = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
LINE = rf"^\[(?:([^\]]*\b\d{{2}}:\d{{2}}:\d{{2}}\b[^\]]*?)\s+)?({LEVELS})\]\s*(.*)$"


def stage_of(message: Column) -> Column:
    """The first stage whose pattern the message has."""
    stage = F.lit(None).cast("string")
    for name, pattern in reversed(STAGES):
        stage = F.when(message.rlike(pattern), name).otherwise(stage)
    return stage


def parse(lines: DataFrame) -> DataFrame:
    """job_id, seq, ts, hms, level, message, stage and other columns of raw lines (job_id, seq, value, more); terminal colours are stripped.

    Without a bracket a line is its own message: ERROR where it starts with
    ``error:`` or has a traceback, WARNING where it starts with ``warning:`` or
    has a UserWarning.  A message that starts with ``warning:`` is one at any
    lower level.
    """
    clean = F.rtrim(F.regexp_replace("value", "\x1b\\[[0-9;]*m", ""), F.lit("\r\n"))
    x = lines.withColumn("value", clean)
    part = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    low = F.lower("value")
    bare = F.when(low.startswith("error:") | low.contains("traceback (most recent call last)"), "ERROR").when(low.startswith("warning:") | low.contains("userwarning:"), "WARNING").otherwise("INFO")
    bracket = F.col("value").rlike(LINE)
    message = F.when(bracket, F.trim(F.regexp_extract("value", LINE, 3))).otherwise(F.col("value"))
    level = F.coalesce(part(2), bare)
    level = F.when(level.isin("INFO", "VERBOSE") & F.lower(message).startswith("warning:"), "WARNING").otherwise(level)
    ts = F.coalesce(*[F.try_to_timestamp(part(1), F.lit(t)) for t in TIMES])
    more = [c for c in lines.columns if c not in ("job_id", "seq", "value")]
    hms = F.nullif(F.regexp_extract(F.coalesce(part(1), F.lit("")), r"\b(\d{2}:\d{2}:\d{2})\b", 1), F.lit(""))
    x = x.select("job_id", "seq", ts.alias("ts"), hms.alias("hms"), level.alias("level"), message.alias("message"), *more)
    return x.withColumn("stage", stage_of(F.col("message")))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, seq, value of raw log files: lines are numbered from 0 in each file.

    Rows of a split come in the file's order; splits are shifted by the lines
    of those before them, so that a long file is not one task's.
    """
    raw = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    own = F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1  # a split's lines
    counts = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a file's splits
    shift = counts.select("file", "start", before.alias("before"))
    return raw.withColumn("own", own).join(shift, ["file", "start"]).select("file", (F.col("own") + F.col("before")).cast("long").alias("seq"), "value")


def stage_durations(parsed: DataFrame) -> DataFrame:
    """job_id, stage, seconds, visits: time from each change of stage to the next, summed."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    x = parsed.where("stage is not null").withColumn("until", F.lead("ts").over(w)).withColumn("last", F.lag("stage").over(w))
    seconds = F.coalesce(F.unix_timestamp("until") - F.unix_timestamp("ts"), F.lit(0))
    new = F.count_if(F.col("last").isNull() | (F.col("last") != F.col("stage")))
    return x.groupBy("job_id", "stage").agg(F.sum(seconds).cast("long").alias("seconds"), new.alias("visits"))


def job_states(parsed: DataFrame) -> DataFrame:
    """A row for each job of parsed lines with ``exit_code``: status, stage, percent, seconds in each stage, telemetry.

    The first line with an exit code ends a job: later ones do not count, the
    open stage is closed at its time, and success is 100 percent.  A line
    without a time counts for telemetry and errors alone.
    """
    # Both what ends a job and what comes before read the lines, which are parsed once.
    parsed = materialise(parsed.select("job_id", "seq", "ts", "level", "message", "stage", "exit_code"))
    order = F.struct("seq")
    end = parsed.where("exit_code is not null").groupBy("job_id").agg(F.min_by(F.struct("seq", "ts", "exit_code"), order).alias("end"))
    x = parsed.join(end, "job_id", "left").where("end is null OR seq <= end.seq")
    timed = x.where("stage is not null AND ts is not null AND exit_code is null")
    until = F.coalesce(F.lead("ts").over(Window.partitionBy("job_id").orderBy("seq")), F.col("end.ts"), F.col("ts"))  # a job's stage lines
    spans = timed.withColumn("s", F.greatest(F.lit(0), F.unix_timestamp(until) - F.unix_timestamp("ts")))
    seconds = [F.coalesce(F.sum(F.when(F.col("stage") == name, F.col("s"))), F.lit(0)).cast("long").alias(name) for name, _ in STAGES]
    stages = spans.groupBy("job_id").agg(*seconds, F.max_by("stage", order).alias("stage"))
    numbers = telemetry(x.where("exit_code is null").withColumn("ts", F.lit(None).cast("timestamp")))
    found = x.groupBy("job_id").agg(F.max("end.exit_code").alias("code")).join(stages, "job_id", "left").join(numbers, "job_id", "left")
    index = F.lit(None).cast("int")
    for i, (name, _) in enumerate(STAGES):
        index = F.when(F.col("stage") == name, i).otherwise(index)
    status = F.when(F.col("code").isNull(), "running").when(F.col("code") == 0, "completed").otherwise("failed")
    percent = F.when(F.col("code") == 0, 100).when(index.isNull(), 0).otherwise(F.least(F.lit(95), (index + 1) * 18)).cast("long")
    zero = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name, _ in STAGES]
    return found.select("job_id", status.alias("status"), "stage", percent.alias("percent"), *zero, *TELEMETRY, "result_dir", "first_error")


def level_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def newest(parsed: DataFrame, n: int = 40) -> DataFrame:
    """The n jobs with the latest lines."""
    return parsed.groupBy("job_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("lines")).orderBy(F.desc("last_ts"), "job_id").limit(n)


def stream_levels(spark: SparkSession, folder: str, minutes: int = 5) -> DataFrame:
    """Level counts by time window over text files that arrive in ``folder`` (columns job_id, seq, value as JSON lines)."""
    raw = spark.readStream.schema("job_id long, seq long, value string").json(folder)
    return parse(raw).withWatermark("ts", "10 minutes").groupBy(F.window("ts", f"{minutes} minutes").alias("span"), "level").agg(F.count(F.lit(1)).alias("n"))


#: What run messages say, as regular expressions with the numbers in groups, by telemetry name.
TELEMETRY = {
    "initial_nodes": (r"Graph G_K with (\d+) nodes and (\d+) edges", 1),
    "initial_edges": (r"Graph G_K with (\d+) nodes and (\d+) edges", 2),
    "coarse_nodes": (r"Coarse graph has (\d+) nodes and (\d+) edges with (\d+) levels", 1),
    "coarse_edges": (r"Coarse graph has (\d+) nodes and (\d+) edges with (\d+) levels", 2),
    "coarsening_levels": (r"Coarse graph has (\d+) nodes and (\d+) edges with (\d+) levels", 3),
    "coarse_parts": (r"Partitioning on coarse graph produced (\d+) parts", 1),
}
RESULTS = r"Results saved in (.+)$"


def telemetry(parsed: DataFrame) -> DataFrame:
    """A row for each job: the last number of each kind that its lines name, its last result folder and first error."""
    order = F.struct("ts", "seq")
    number = lambda rx, g: F.nullif(F.regexp_extract("message", rx, g), F.lit("")).cast("long")
    last = [F.max_by(number(rx, g), F.when(number(rx, g).isNotNull(), order)).alias(name) for name, (rx, g) in TELEMETRY.items()]
    saved = F.nullif(F.regexp_extract("message", RESULTS, 1), F.lit(""))
    bad = F.col("level") == "ERROR"
    return parsed.groupBy("job_id").agg(*last, F.max_by(saved, F.when(saved.isNotNull(), order)).alias("result_dir"), F.min_by("message", F.when(bad, order)).alias("first_error"))


_STATE = ["status", "stage", "percent", *(name for name, _ in STAGES), *TELEMETRY, "result_dir", "first_error"]
STATE = "status string, stage string, percent long, " + ", ".join(f"{n} long" for n, _ in STAGES) + ", " + ", ".join(f"{n} long" for n in TELEMETRY) + ", result_dir string, first_error string"
LIVE = f"job_id long, seq long, {STATE}, live_seconds double"


def live_states(parsed: DataFrame, timer: str | None = None) -> DataFrame:
    """A stream of ``job_states``: a row for each job that a batch has lines of, from state kept by job.

    A stage is closed when it changes or the job ends, and a job that has ended
    stays as it is.  ``live_seconds`` is the time in the open stage up to the
    job's last line; with ``timer`` (processing time) an open job without new
    lines is told of again each time it runs out, with the time up to then.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ship_package(parsed.sparkSession)
    index = {name: i for i, (name, _) in enumerate(STAGES)}
    numbers = list(TELEMETRY)
    whole = {"percent", *index, *numbers}
    wait = None if timer is None else int(pd.Timedelta(timer).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        job = dict(zip(_STATE, [None] * len(_STATE), strict=True))
        if state.exists:
            (kept,) = state.get
            job, seq, since, now = json.loads(kept)
        else:
            seq, since, now = -1, None, None
            job |= {"status": "running", "percent": 0} | {name: 0 for name in index}
        if not state.hasTimedOut:
            lines = [r for b in batches if len(b) for r in b.to_dict("records")]
            for r in sorted(lines, key=lambda r: r["seq"]):
                if job["status"] != "running" or r["seq"] <= seq:
                    continue
                seq = r["seq"]
                at = None if pd.isna(r["at"]) else int(r["at"])
                if not pd.isna(r["exit_code"]):
                    if at is not None and since is not None:
                        job[job["stage"]] += max(0, at - since)
                    since, now = None, None
                    job["status"] = "failed" if r["exit_code"] else "completed"
                    job["percent"] = job["percent"] if r["exit_code"] else 100
                    continue
                if isinstance(r["stage"], str) and at is not None:
                    if since is not None:
                        job[job["stage"]] += max(0, at - since)
                    job["stage"], since, now = r["stage"], at, at
                    job["percent"] = min(95, (index[r["stage"]] + 1) * 18)
                elif at is not None and since is not None:
                    now = max(now, at)
                for n in (*numbers, "result_dir"):
                    if not pd.isna(r[n]):
                        job[n] = r[n] if n == "result_dir" else int(r[n])
                if r["level"] == "ERROR" and job["first_error"] is None:
                    job["first_error"] = r["message"]
        elif now is not None:
            now += wait / 1000
        state.update((json.dumps((job, int(seq), since, now)),))  # with nulls as they are
        if wait is not None and job["status"] == "running":
            state.setTimeoutDuration(wait)
        row = {"job_id": key[0], "seq": int(seq), **job, "live_seconds": None if now is None else float(now - since)}
        yield pd.DataFrame({c: pd.array([x], "Int64") if c in whole else [x] for c, x in row.items()})

    number = lambda rx, g: F.nullif(F.regexp_extract("message", rx, g), F.lit("")).cast("long")
    told = [number(rx, g).alias(name) for name, (rx, g) in TELEMETRY.items()]
    saved = F.nullif(F.regexp_extract("message", RESULTS, 1), F.lit("")).alias("result_dir")
    rows = parsed.select("job_id", "seq", F.unix_timestamp("ts").alias("at"), "level", "message", "stage", "exit_code", *told, saved)
    timeout = GroupStateTimeout.NoTimeout if timer is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("job_id").applyInPandasWithState(run, LIVE, "kept string", "update", timeout)


def replayed(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """``job_states`` of JSON lines (job_id, seq, value, exit_code) in a folder, by way of the stream: ``files`` of them a batch, to the end.

    Each batch's rows are written under its number, so that one that is done
    again after a failure replaces its own, and a job's last row is its state.
    """
    raw = spark.readStream.schema("job_id long, seq long, value string, exit_code int").option("maxFilesPerTrigger", files).json(folder)
    out, offsets = shared_dir(spark), shared_dir(spark)
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    live_states(parse(raw)).writeStream.outputMode("update").option("checkpointLocation", offsets).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(f"{LIVE}, batch long").parquet(out)
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*_STATE), F.struct("batch", "seq")).alias("x")).select("job_id", "x.*")


def progress(parsed: DataFrame) -> DataFrame:
    """(job_id, stage, percent): the stage each job is in, and 18 percent for each stage begun, 95 at most; ``job_states`` has 100 for success."""
    index = F.lit(None).cast("int")
    for i, (name, _) in enumerate(STAGES):
        index = F.when(F.col("stage") == name, i).otherwise(index)
    now = parsed.where("stage is not null").groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "seq")).alias("stage"))
    return now.select("job_id", "stage", F.least(F.lit(95), (index + 1) * 18).cast("long").alias("percent"))


def tail(parsed: DataFrame, n: int = 40, characters: int = 400) -> DataFrame:
    """(job_id, text): the end of each job's log, of its last ``n`` lines."""
    last = parsed.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("r") <= n)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), "\n")
    return last.groupBy("job_id").agg(text.alias("t")).select("job_id", F.substring("t", -characters, characters).alias("text"))


def push(spark: SparkSession, folder: str, checkpoint: str, send, interval: str = "400 milliseconds"):
    """A running query that hands each batch of new lines' telemetry to ``send``; offsets stand in ``checkpoint``, so that a restart goes on where it stopped."""
    raw = spark.readStream.schema("job_id long, seq long, value string").json(folder)
    out = raw.writeStream.foreachBatch(lambda batch, number: send(number, telemetry(parse(batch)))).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=interval).start()


def line(level: str, message: str, at: str) -> str:
    """A log line in the form that ``parse`` reads; ``at`` is like 21 May 2026 15:19:03 UTC."""
    return f"[{at} {level}] {message}"
