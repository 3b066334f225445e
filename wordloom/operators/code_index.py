"""A stored layout of paradigms by their codes, which lookups by any of the codes read in part.

The rows lie on a Z-order curve: each code is replaced by its place among quantiles and the bits
of the four places are interleaved, so a file holds a small range of every code.  The ranges are
kept beside the files, one row a file, and a lookup opens only files whose ranges hold what it
asks for; within them the scan prunes row groups.  A second copy lies by word.  After paradigms
change, build the index anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.operators.lookup import Words, for_words, is_listed
from wordloom.operators.paradigm_queries import CODES
from wordloom.schema import MODEL

#: Bits of a code's place on the curve.
BITS = 8
#: Most different codes for which files are chosen; more of them read all files.
MOST_ASKED = 10_000


def _curve(paradigms: DataFrame) -> Column:
    """The place on the curve, by quantiles of each code: 255 values a code at most."""
    steps = [i / 2 ** BITS for i in range(1, 2 ** BITS)]
    found = paradigms.agg(*[F.percentile_approx(c, steps).alias(c) for c in CODES]).first()
    key = F.lit(0).cast("long")
    for j, code in enumerate(CODES):
        # Repeated ones too: a frequent code takes up as much of the curve as its rows.
        bounds = sorted(found[code] or [])
        place = F.lit(0).cast("long")
        if bounds:
            value = F.col(code)
            place = F.size(F.filter(F.lit(bounds), lambda b: b < value)).cast("long")
        for i in range(BITS):
            bit = F.shiftright(place, i).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, len(CODES) * i + len(CODES) - 1 - j))
    return key


@dataclass(frozen=True)
class CodeIndex:
    """The tables of one index folder."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(model: Model, path: str, files: int | None = None) -> CodeIndex:
        """Write the index of a model's paradigms below `path`; `files` by size if not given."""
        rows = model.paradigms.select(*MODEL["paradigms"].fieldNames())
        numbers = [] if files is None else [files]
        rows.withColumn("_curve", _curve(rows)).repartitionByRange(
            *numbers, "_curve", "wordform").sortWithinPartitions("_curve", "wordform").drop(
            "_curve").write.parquet(f"{path}/by_codes")
        rows.repartitionByRange(*numbers, "wordform").sortWithinPartitions(
            "wordform").write.parquet(f"{path}/by_word")
        index = CodeIndex(rows.sparkSession, path)
        index._read("by_codes").groupBy(F.col("_metadata.file_name").alias("file")).agg(*[
            f(c).alias(f"{name}_{c}") for c in CODES
            for name, f in (("least", F.min), ("most", F.max))
        ]).coalesce(1).write.parquet(f"{path}/ranges")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> CodeIndex:
        return CodeIndex(spark, path)

    def _read(self, table: str, files: Sequence[str] = ("",)) -> DataFrame:
        schema = MODEL["paradigms"]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(
            *[f"{self.path}/{table}/{file}".rstrip("/") for file in files])

    def at(self, model: Model, **codes: int) -> Model:
        """The model with the paradigm rows of the given codes (any of Z, Y, X, W) only.

        For `variants_by_codes`, `nearest_x`, `frequent_x`, `frequent_lemmas`, `top_lemma_per_x`
        and `paradigm_count`, which filter by codes.
        """
        if unknown := set(codes) - set(CODES):
            raise ValueError(f"no codes: {sorted(unknown)}")
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        for code, value in codes.items():
            ranges = ranges.filter(F.lit(value).between(F.col(f"least_{code}"), F.col(f"most_{code}")))
        rows = self._read("by_codes", sorted(r["file"] for r in ranges.select("file").collect()))
        for code, value in codes.items():
            rows = rows.filter(F.col(code) == value)
        return replace(model, paradigms=rows)

    def of_words(self, model: Model, words: Words, codes: Sequence[str] = tuple(CODES)) -> Model:
        """The model with the paradigm rows in files that may share `codes` with listed words.

        All rows of the words' own paradigms are there, and rows of others.  For `morph_links`,
        `lemmas_for_wordform`, `paradigms_of_word`, `codes_of_word`, `variants_of_word` and what
        builds on it; with the codes Z and Y for `paradigm_network`.  Words in a DataFrame, or
        all, read all files.
        """
        if not is_listed(words):
            return replace(model, paradigms=self._read("by_codes"))
        asked = for_words(self._read("by_word"), words).select(*codes).distinct().limit(
            MOST_ASKED + 1).collect()
        if len(asked) > MOST_ASKED:
            return replace(model, paradigms=self._read("by_codes"))
        ranges = self.spark.read.parquet(f"{self.path}/ranges").dropna(
            subset=[f"least_{c}" for c in codes]).collect()
        complete = [row for row in asked if None not in row]
        chosen = sorted(
            r["file"] for r in ranges
            if any(all(r[f"least_{c}"] <= row[c] <= r[f"most_{c}"] for c in codes)
                   for row in complete))
        rows = self._read("by_codes", chosen)
        if len(complete) < len(asked):
            # Rows of the words without a code are in no paradigm, but are theirs.
            incomplete = F.lit(False)
            for code in codes:
                incomplete |= F.col(code).isNull()
            held = rows.filter(~incomplete)
            rows = held.unionByName(for_words(self._read("by_word"), words).filter(incomplete))
        return replace(model, paradigms=rows)
