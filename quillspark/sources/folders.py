"""Book folders: ``<root>/<book_id>/book.json`` beside the files that the book names.

A task writes one book at a time to a folder of its own name, files first and
``book.json`` last, so a folder without it is not a book; a task that is run again
writes the same files. Any store that pyarrow knows will do.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .epub import assets_of


def write(books: DataFrame, assets: DataFrame, root: str) -> DataFrame:
    """(book_id, json) and (book_id, path, content) -> book_id, folder, n_assets, bytes, error."""

    def pair(book: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        known, rows = dict(zip(files["path"], files["content"], strict=True)), []
        for key, text in zip(book["book_id"], book["json"], strict=True):
            folder = f"{root.rstrip('/')}/{key}"
            try:
                wanted = assets_of(json.loads(text))
                if lacking := [p for p in wanted if p not in known]:
                    raise ValueError(f"missing assets: {', '.join(lacking)}")
                if any(p.startswith("/") or ".." in p.split("/") for p in wanted):
                    raise ValueError("a file outside of the book's folder")
                store, path = fs.FileSystem.from_uri(folder)
                parts = [*((p, known[p]) for p in wanted), ("book.json", text.encode())]
                for name, data in parts:
                    store.create_dir(f"{path}/{name}".rpartition("/")[0])
                    with store.open_output_stream(f"{path}/{name}") as out:
                        out.write(data)
                rows.append((key, folder, len(wanted), sum(len(d) for _, d in parts), None))
            except (ValueError, KeyError, TypeError, OSError) as e:
                rows.append((key, folder, 0, 0, str(e)))
        return pd.DataFrame(rows, columns=["book_id", "folder", "n_assets", "bytes", "error"])

    schema = "book_id long, folder string, n_assets int, bytes long, error string"
    files = assets.select(F.col("book_id").alias("book_id"), "path", "content")  # may come from the same plan as the books
    return books.select("book_id", "json").groupBy("book_id").cogroup(files.groupBy("book_id")).applyInPandas(pair, schema)


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(book_id, json) and (book_id, path, content) of all book folders below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.regexp_extract("path", r"/([0-9]+)/((?:assets/)?[^/]+)$", 0)
    named = files.withColumns({"place": place}).where("place <> ''").select(F.regexp_extract("place", r"^/([0-9]+)/", 1).cast("long").alias("book_id"), F.regexp_replace("place", r"^/[0-9]+/", "").alias("path"), "content")
    books = named.where("path = 'book.json'").select("book_id", F.decode("content", "UTF-8").alias("json"))
    return books, named.where("path <> 'book.json'").join(books.select("book_id"), "book_id", "left_semi")


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of every folder directly below ``root``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.split("://")[-1].rstrip("/")
    below = F.regexp_extract("path", "/" + re.escape(base.strip("/")) + "/([^/]+)/", 1)
    return files.withColumn("folder", below).where("folder <> ''").groupBy("folder").agg(F.sum("length").alias("bytes"), F.count("*").alias("n_files"))
