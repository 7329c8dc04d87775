"""Pages recognised by a plugged-in engine, cached by content; PDF spans by a plugged-in decoder."""

from __future__ import annotations

import base64
import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

REGIONS = "book_id string, page int, pos int, text string, label string, x double, y double, w double, h double, error string"
SPANS = "path string, page int, width double, height double, text string, font string, size double, x double, y double, w double, h double, error string"

Engine = Callable[[bytes, list[str]], list[dict]]


def cache_key(identity: str, png: Column, languages: list[str]) -> Column:
    """SHA-256 of engine, page image and languages, parted by zero bytes."""
    head, tail = (identity + "\0").encode(), ("\0" + ",".join(languages)).encode()
    return F.sha2(F.concat(F.lit(head), png, F.lit(tail)), 256)


def misses(pages: DataFrame, cache: DataFrame, fresh: bool = False) -> DataFrame:
    """Pages whose key the cache lacks; all of them with ``fresh``.

    Appending what these give makes a run that broke off go on where it stopped.
    """
    return pages if fresh else pages.join(cache.select("key").distinct(), "key", "left_anti")


def recognise(pages: DataFrame, make_engine: Callable[[], Engine], languages: list[str]) -> DataFrame:
    """Regions of each page (book_id, page, png); a page that fails is a row with its error.

    ``make_engine`` runs once a task, so a model is loaded once and stays warm.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        names = [c.split()[0] for c in REGIONS.split(", ")]
        for pdf in batches:
            rows = []
            for book, page, png in zip(pdf["book_id"], pdf["page"], pdf["png"], strict=True):
                try:
                    found = engine(png, languages)
                    rows += [{"book_id": book, "page": page, "pos": i} | r for i, r in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one bad page must not end the job
                    rows.append({"book_id": book, "page": page, "error": str(e)})
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"pos": "Int32"}).astype(object).where(out.notna(), None)

    return pages.select("book_id", "page", "png").mapInPandas(run, REGIONS)


def process_engine(command: list[str]) -> Callable[[], Engine]:
    """An engine that is a process of its own: one JSON request a line, one JSON reply a line.

    Requests hold id, png (base64) and languages; replies hold the id with regions or an error.
    The process lives as long as its task; one that has ended is started again.
    """

    def make() -> Engine:
        state = {"id": 0, "process": None}

        def ask(png: bytes, languages: list[str]) -> list[dict]:
            if state["process"] is None or state["process"].poll() is not None:
                state["process"] = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
            state["id"] += 1
            process = state["process"]
            process.stdin.write(json.dumps({"id": state["id"], "png": base64.b64encode(bytes(png)).decode(), "languages": languages}) + "\n")
            process.stdin.flush()
            line = process.stdout.readline()
            if not line:
                raise RuntimeError("the engine ended without a reply")
            reply = json.loads(line)
            if reply.get("id") != state["id"]:
                raise RuntimeError("the engine answered another request")
            if reply.get("error"):
                raise RuntimeError(reply["error"])
            return reply["regions"]

        return ask

    return make


def recognise_stream(pages: DataFrame, make_engine: Callable[[], Engine], languages: list[str], identity: str, cache: str, checkpoint: str) -> StreamingQuery:
    """Recognises a stream of pages (book_id, page, png) batch by batch into the table ``cache``.

    Only pages whose key the cache lacks are recognised, so a batch that is run again adds
    nothing twice; a page that failed is tried again by the next run.
    """
    schema = "key string, " + REGIONS

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # the first batch finds a table
        known = spark.read.schema(schema).parquet(cache).where("error is null")
        wanted = misses(batch.withColumn("key", cache_key(identity, F.col("png"), languages)), known).dropDuplicates(["key", "book_id", "page"])
        found = recognise(wanted, make_engine, languages)
        found.join(wanted.select("book_id", "page", "key"), ["book_id", "page"]).select("key", *(c.split()[0] for c in REGIONS.split(", "))).write.mode("append").parquet(cache)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spans(files: DataFrame, make_decoder: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Styled spans of PDF files (path, content) by a decoder that the caller brings.

    A file that it rejects is a row with its error.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = make_decoder()
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [{"path": path} | s for s in decode(content)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append({"path": path, "error": str(e)})
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")]).astype({"page": "Int32"})
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, SPANS)


IMAGES = "path string, page int, y double, w double, h double, hash string, png binary, error string"


def image_bytes(files: DataFrame, wanted: DataFrame, make_reader: Callable[[], Callable[[bytes, list[int]], list[dict]]]) -> DataFrame:
    """Images of the pages asked for (path, page), by a reader that the caller brings.

    Only files with such a page are opened, each once with the list of its pages.
    """
    pages = wanted.groupBy("path").agg(F.array_sort(F.collect_set("page")).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        reader = make_reader()
        for pdf in batches:
            rows = []
            for path, content, listed in zip(pdf["path"], pdf["content"], pdf["pages"], strict=True):
                try:
                    rows += [{"path": path, "hash": hashlib.sha256(i["png"]).hexdigest()[:16]} | i for i in reader(content, list(listed))]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append({"path": path, "error": str(e)})
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGES.split(", ")]).astype({"page": "Int32"})
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").join(pages, "path").mapInPandas(run, IMAGES)
