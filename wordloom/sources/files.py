"""Helpers shared by the file readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """Name of the logical file behind a path.

    A folder of `part-*` files, as Spark writes it, counts as one file under the folder's
    name; a `column=value` folder is named by its value.
    """
    # The last two steps say it all; the expression tries every character before the name.
    steps = F.substring_index(path, "/", -2)
    decoded = F.url_decode(F.replace(steps, F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(decoded, r"([^/]+?)(?:/part-[^/]*)?$", 1)
    return F.regexp_replace(name, r"^[^=/]+=", "")


def dot_part(name: Column, position: int) -> Column:
    """Dot-separated part of a name; negative positions count from the end."""
    return F.try_element_at(F.split(name, r"\."), F.lit(position))


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _high_characters(encoding: str) -> tuple[str, str]:
    """The upper 128 characters of ISO-8859-1, and of a single-byte encoding."""
    both = [
        (chr(code), bytes([code]).decode(encoding, errors="ignore") or chr(code))
        for code in range(0x80, 0x100)
    ]
    return "".join(a for a, _ in both), "".join(b for _, b in both)


def line_order() -> Column:
    """The place of a row in the files of a scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("line_order")


def text_lines(
    spark: SparkSession, paths: str | list[str], glob: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Non-blank lines with their file name and `line_order`, sortable within one file.

    `glob` selects by logical file name.  The order is (path, block start, running id):
    the running id alone is not the order of the file.
    """
    if encoding:
        # The line reader is UTF-8; single-byte files go through the CSV reader, where a
        # separator that cannot occur keeps the line whole.
        lines = (
            spark.read.schema("value STRING").option("encoding", "ISO-8859-1")
            .option("sep", "\x1f").option("quote", "").csv(paths)
        )
        lines = lines.withColumn("value", F.translate("value", *_high_characters(encoding)))
    else:
        lines = spark.read.text(paths)
    if glob is not None:
        # Before the running id, so that files are left out when the scan is planned.
        lines = lines.filter(file_name(F.col("_metadata.file_path")).rlike(glob_pattern(glob)))
    lines = lines.select(
        "value",
        file_name(F.col("_metadata.file_path")).alias("file"), line_order(),
    )
    return lines.filter(F.col("value") != "")


def glob_pattern(glob: str) -> str:
    """A file-name glob with `*`, `?` and `[...]` as a regular expression."""
    special = {"*": ".*", "?": ".", "[": "[", "]": "]", "-": "-"}
    return "^" + "".join(
        special.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in glob) + "$"


def escaped_cells(line: Column, sep: str, count: int) -> list[Column]:
    """The cells of a line whose separators and backslashes may be escaped or quoted.

    Empty cells are NULL; a line with more than `count` cells stops the job.
    """
    # Possessive runs: the expression never keeps a way back, so long cells cost no stack.
    cell = rf'((?:"(?:[^"\\]++|\\.)*+"|\\.|[^{sep}\\"]++|")*+){sep}'
    cells = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(cell), F.lit(1))
    cells = F.when(
        F.size(cells) > count, F.raise_error(F.concat(F.lit("too many cells: "), line))
    ).otherwise(cells)
    bare = F.transform(cells, lambda c: F.regexp_replace(
        F.regexp_replace(c, '^"(.*)"$', "$1"), r"\\(.)", "$1"))
    return [F.nullif(F.get(bare, F.lit(i)), F.lit("")) for i in range(count)]


def delimited(
    spark: SparkSession, paths: str | list[str], schema: str, sep: str, header: bool = False,
    **options: str,
) -> DataFrame:
    """Delimited text under a declared schema; quotes are ordinary characters by default."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    for key, value in {"quote": "", **options}.items():
        reader = reader.option(key, value)
    return reader.csv(paths)
