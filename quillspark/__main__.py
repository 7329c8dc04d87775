"""Command line: ``python -m quillspark COMMAND ...``; every command works on whole folders.

pack ROOT OUT       book folders below ROOT to OUT/<book_id>.epub
unpack EPUBS ROOT   EPUB files (named <number>.epub) below EPUBS to book folders below ROOT
validate ROOT       issues of all book folders; exit code 1 if there are any
query NAME DATA OUT a listed query over the tables in DATA, as Parquet
queries             the names of all queries
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession, functions as F

from . import registry
from .functions import contract
from .session import keep, ship
from .sources import epub, folders

USES = {"pack": 2, "unpack": 2, "validate": 1, "query": 3, "queries": 0}


def pack(spark: SparkSession, root: str, out: str) -> int:
    from pyarrow import fs

    def save(pdf):
        store, path = fs.FileSystem.from_uri(out)
        store.create_dir(path)
        for key, data in zip(pdf["book_id"], pdf["epub"], strict=True):
            with store.open_output_stream(f"{path}/{key}.epub") as f:
                f.write(data)
        return pdf[["book_id"]]

    made = keep(epub.write_books(*folders.read(spark, root)))
    made.where("epub is not null").select("book_id", "epub").mapInPandas(lambda it: map(save, it), "book_id long").count()
    return _told(made.where("error is not null").select("book_id", "error"))


def unpack(spark: SparkSession, epubs: str, root: str) -> int:
    files = spark.read.format("binaryFile").load(epubs).select(F.regexp_extract("path", r"([0-9]+)\.epub$", 1).alias("path"), "content").where("path <> ''")
    read = keep(epub.read_books(files).withColumn("book_id", F.col("path").cast("long")))
    assets = read.select("book_id", F.explode("assets").alias("a")).select("book_id", "a.path", "a.content")
    done = keep(folders.write(read.where("json is not null").select("book_id", "json"), assets, root))
    return _told(done.where("error is not null").select("book_id", "error").union(read.where("json is null").select("book_id", F.get("warnings", F.lit(0)))))


def validate(spark: SparkSession, root: str) -> int:
    return _told(contract.book_issues(folders.read(spark, root)[0]))


def query(spark: SparkSession, name: str, data: str, out: str) -> int:
    registry.queries()[name](spark, data).write.mode("overwrite").parquet(out)
    return 0


def queries(spark: SparkSession) -> int:
    print("\n".join(registry.queries()))
    return 0


def _told(rows) -> int:
    """Prints what went wrong, row by row as it comes."""
    bad = 0
    for r in rows.toLocalIterator():
        print(": ".join(map(str, r)), file=sys.stderr)
        bad = 1
    return bad


def main(args: list[str]) -> int:
    if not args or USES.get(args[0]) != len(args) - 1:
        print(__doc__, file=sys.stderr)
        return 2
    return globals()[args[0]](ship(SparkSession.builder.getOrCreate()), *args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
