"""Job events: latest state, remaining time, frames, sessions of a warm model, replies.

Each works on a batch and on a stream; watermarks only bound state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

IDLE = "5 minutes"


def latest(events: DataFrame) -> DataFrame:
    """Each job's last event (use output mode 'update' on a stream)."""
    return events.groupBy("job").agg(F.max_by("type", F.struct("ts", "event_id")).alias("type"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))


def eta(done: Column, total: Column, elapsed_ms: Column, projected_ms: Column) -> Column:
    """Remaining milliseconds from progress, else from the projection."""
    return F.when(done > 0, elapsed_ms / done * (total - done)).otherwise(F.greatest(F.lit(0.0), projected_ms - elapsed_ms))


def frames(chunks: DataFrame) -> DataFrame:
    """Lines of a channel whose chunks cut them anywhere; an unfinished last line waits (is left out).

    A piece's line is the number of breaks before it, a running sum over the channel's
    chunks, so only a line's own pieces are ever put together.
    """
    w = Window.partitionBy("channel").orderBy("seq")
    breaks = F.char_length("data") - F.char_length(F.replace("data", F.lit("\n"), F.lit("")))
    counted = chunks.withColumn("breaks", breaks)
    before = counted.select("channel", "seq", "data", (F.sum("breaks").over(w) - F.col("breaks")).alias("begun"), F.sum("breaks").over(Window.partitionBy("channel")).alias("ended"))
    pieces = before.select("channel", "seq", "begun", "ended", F.posexplode(F.split("data", "\n"))).withColumn("line_no", (F.col("begun") + F.col("pos")).cast("int"))
    lines = pieces.where("line_no < ended and col <> ''").groupBy("channel", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "col"))), lambda x: x["col"]), "").alias("line"))
    return lines.select("channel", "line_no", "line")


def frames_stream(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """``frames`` of a stream (channel string, seq long, data string): the unfinished rest is a channel's state.

    Chunks of a channel must come in order; a rest that stays ``idle`` is dropped.
    """
    import pandas as pd

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        rest, number = state.get if state.exists else ("", 0)
        whole = pd.concat(list(parts)).sort_values("seq")
        lines = (rest + "".join(whole["data"])).split("\n")
        rest = lines.pop()
        yield pd.DataFrame([(key[0], number + i, line) for i, line in enumerate(lines) if line], columns=["channel", "line_no", "line"])
        state.update((rest, number + len(lines)))
        state.setTimeoutDuration(wait)

    return chunks.groupBy("channel").applyInPandasWithState(step, "channel string, line_no long, line string", "rest string, number long", "append", "ProcessingTimeTimeout")


def observed(work: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``work``, and an observation whose ``get`` gives the rows done and failed once it has run."""
    seen = Observation(name)
    failed = F.count_if(F.col("error").isNotNull()) if "error" in work.columns else F.count_if(F.lit(False))
    return work.observe(seen, F.count(F.lit(1)).alias("done"), failed.alias("failed")), seen


def sessions(events: DataFrame, gap: str = IDLE) -> DataFrame:
    """Spans in which a model stays loaded: uses no more than ``gap`` apart."""
    return events.groupBy("job", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def replies(requests: DataFrame, answers: DataFrame, wait: str | None = None) -> DataFrame:
    """Requests with their reply by id; on streams give ``wait``, which bounds both sides' state."""
    if wait:
        requests, answers = requests.withWatermark("asked", wait), answers.withWatermark("answered", wait)
        return requests.join(answers, (requests["id"] == answers["id"]) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {wait}"))).drop(answers["id"])
    return requests.join(answers, "id")


def progress_order(events: DataFrame) -> DataFrame:
    """Events numbered within their job."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy("job").orderBy("ts", "event_id")))
