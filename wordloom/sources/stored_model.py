"""A model on disk that is changed in place.

Each table lies in folders `version=N/part=K`.  A part is a bucket of the table's key, sorted
within its files; a change writes new folders for the parts that it touches, and then one small
manifest that says which folders make up each part.  Folders are never written again, so
a change may read what it replaces, readers keep the version that they opened, and other parts stay as
they are.  A change has a name: named again, also by a job that starts anew after a failure, it is
done once.  What a failed change left behind is in no manifest and is overwritten by the next.

There is one writer at a time.  Everything goes through Spark's readers and writers, so any store will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.model import Model
from wordloom.operators import corpora, lexica, words
from wordloom.operators.marks import Marked, marked
from wordloom.schema import MODEL

Additions = dict[str, DataFrame]
#: Of each table, what its parts are buckets of, and the order within a part.
KEYS: dict[str, list[str]] = {
    "words": ["wordform"], "lexica": ["lexicon_id"], "lexicon_words": ["lexicon_id", "wordform"],
    "links": ["wordform_from", "wordform_to"],
    "link_sources": ["lexicon_id", "wordform_from", "wordform_to"], "corpora": ["corpus_id"],
    "documents": ["document_id"], "corpus_documents": ["corpus_id", "document_id"],
    "attestations": ["wordform", "document_id"], "paradigms": ["wordform"],
    "external_links": ["wordform"], "word_frequency": ["wordform"],
    "ranked_variants": ["wordform"], "marked": ["wordform", "document_id"],
}
#: Columns that hold a spelling of the word table.
SPELLINGS: dict[str, list[str]] = {
    "words": ["wordform"], "lexicon_words": ["wordform"], "links": ["wordform_from", "wordform_to"],
    "link_sources": ["wordform_from", "wordform_to"], "attestations": ["wordform"],
    "paradigms": ["wordform"], "external_links": ["wordform"], "word_frequency": ["wordform"],
    "marked": ["wordform"],
}
SCHEMAS = {**MODEL, "marked": T.StructType(
    [*MODEL["attestations"].fields, T.StructField("title", T.StringType()),
     *(T.StructField(c, T.LongType()) for c in ("word_count", "pub_year", "year")),
     T.StructField("corpora", T.ArrayType(T.StructType([
         T.StructField("block", T.LongType()), T.StructField("bits", T.LongType())])))])}
MARKED_FROM = ("attestations", "documents", "corpus_documents")


@dataclass(frozen=True)
class Manifest:
    """`tables[table][part]` are the versions whose folders make up a part."""

    version: int
    parts: int
    tables: dict[str, dict[str, list[int]]]
    #: The parts of the tables that the marked attestations were made from.
    marked_from: dict[str, dict[str, list[int]]] | None = None


class StoredModel:
    """The model in a folder, at its newest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._manifests()
        if not found:
            raise FileNotFoundError(f"no stored model in {path}")
        self.changes = {change for change, _ in found}
        self.manifest = max((m for _, m in found), key=lambda m: m.version)

    @classmethod
    def create(cls, spark: SparkSession, path: str, model: Model, parts: int = 16) -> "StoredModel":
        """Write a model to an empty folder, with its marked attestations."""
        made = cls.__new__(cls)
        made.spark, made.path, made.changes = spark, path.rstrip("/"), set()
        if made._manifests():
            raise FileExistsError(f"{path} has a stored model already")
        made.manifest = Manifest(0, parts, {})
        rows = {**model.tables(), "marked": marked(model)}
        made._commit("created", {
            name: (None, df) for name, df in rows.items() if not df.isEmpty()}, marks=True)
        return made

    def _manifests(self) -> list[tuple[str, Manifest]]:
        try:
            lines = self.spark.read.text(f"{self.path}/manifests/*/*.txt").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        told = [json.loads(row["value"]) for row in lines]
        return [(m.pop("change"), Manifest(**m)) for m in told]

    # Reading.

    def rows(self, table: str, parts: Sequence[int] | None = None) -> DataFrame:
        """A table, or some of its parts."""
        entries = self.manifest.tables.get(table, {})
        chosen = entries if parts is None else [str(p) for p in parts if str(p) in entries]
        folders = [
            f"{self.path}/{table}/version={v}/part={p}" for p in chosen for v in entries[p]]
        schema = SCHEMAS[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).select(*schema.names)

    def model(self) -> Model:
        model = Model(**{name: self.rows(name) for name in MODEL})
        if self.has_marks():
            model = replace(model, marked=Marked.of(self.rows("marked"), model))
        return model

    def has_marks(self) -> bool:
        """Whether the marked attestations are of the tables as they are now."""
        tables = self.manifest.tables
        return self.manifest.marked_from == {t: tables.get(t, {}) for t in MARKED_FROM}

    def part_of(self, table: str, key: Column | None = None) -> Column:
        column = F.col(KEYS[table][0]) if key is None else key
        return F.pmod(F.xxhash64(column), F.lit(self.manifest.parts)).cast("int")

    def parts_with(self, table: str, keys: DataFrame) -> list[int]:
        """The parts that hold rows of the given keys: one number a part."""
        key = F.col(keys.columns[0]).cast(SCHEMAS[table][KEYS[table][0]].dataType)
        found = keys.select(self.part_of(table, key).alias("part")).distinct().collect()
        return sorted(row["part"] for row in found)

    # Writing.

    def _written(self, table: str, rows: DataFrame, version: int) -> list[str]:
        """Write rows as a version of a table; the parts that got any."""
        folder = f"{self.path}/{table}/version={version}"
        names = SCHEMAS[table].names
        # A range of part and key: a part with many rows spreads over tasks and files.
        rows.select(*names, self.part_of(table).alias("part")).repartitionByRange(
            "part", *KEYS[table]).sortWithinPartitions("part", *KEYS[table]).write.mode(
            "overwrite").partitionBy("part").parquet(folder)
        files = self.spark.read.schema(SCHEMAS[table]).parquet(folder).inputFiles()
        return sorted({re.search(r"/part=(\d+)/", f).group(1) for f in files})

    def _commit(
        self, change: str, written: dict[str, tuple[list[int] | None, DataFrame]],
        added: Additions | None = None, marks: bool = False,
    ) -> None:
        """Replace parts (None: all) of tables by rows, add rows to others, and say so."""
        version = self.manifest.version + 1
        tables = {t: dict(entries) for t, entries in self.manifest.tables.items()}
        for table, (parts, rows) in written.items():
            entries = tables.setdefault(table, {})
            for part in list(entries) if parts is None else map(str, parts):
                entries.pop(part, None)
            entries.update({p: [version] for p in self._written(table, rows, version)})
        for table, rows in (added or {}).items():
            entries = tables.setdefault(table, {})
            for part in self._written(table, rows, version):
                entries[part] = [*entries.get(part, []), version]
        told = {t: tables.get(t, {}) for t in MARKED_FROM} if marks else self.manifest.marked_from
        manifest = Manifest(version, self.manifest.parts, tables, told)
        line = json.dumps({"change": change, **manifest.__dict__})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(
            f"{self.path}/manifests/{version:08d}")
        self.manifest = manifest
        self.changes.add(change)

    def add(
        self, change: str, additions: Callable[[Model], Additions],
        replacing: Sequence[str] = (),
    ) -> bool:
        """Add rows to tables; no part is written again.  False if the change was done before.

        Tables named in `replacing` have only the new rows then.  Rows of a corpus whose documents are all
        new get their marks with them.
        """
        if change in self.changes:
            return False
        model = self.model()
        rows = additions(model)
        marks = self.has_marks() and self._only_new(model, rows)
        if marks and "attestations" in rows:
            rows = {**rows, "marked": marked(replace(
                model, marked=None, **{t: rows[t] for t in MARKED_FROM}))}
        instead = {t: (None, rows[t]) for t in replacing if t in rows}
        self._commit(
            change, instead, {t: df for t, df in rows.items() if t not in instead}, marks)
        return True

    def _only_new(self, model: Model, rows: Additions) -> bool:
        """Whether added memberships and attestations are of added documents, and those are new."""
        given = [t for t in MARKED_FROM if t in rows]
        if not given:
            return True
        if len(given) < len(MARKED_FROM):
            return False
        new = rows["documents"].select("document_id")
        others = rows["attestations"].select("document_id").unionByName(
            rows["corpus_documents"].select("document_id")).distinct().join(
            new, "document_id", "left_anti")
        return others.isEmpty() and new.join(
            model.documents, "document_id", "left_semi").isEmpty()

    def append(self, change: str, table: str, rows: DataFrame) -> bool:
        return self.add(change, lambda model: {table: rows})

    def empty(self, change: str, table: str) -> bool:
        """A table without rows; nothing is deleted that an older version reads."""
        if change in self.changes:
            return False
        self._commit(change, {table: (None, self.spark.createDataFrame([], SCHEMAS[table]))})
        return True

    def delete_lexicon(self, change: str, lexicon_id: int) -> bool:
        """Without the lexicon, its membership and its statements; words and links stay."""
        if change in self.changes:
            return False
        gone = self.spark.createDataFrame([(lexicon_id,)], "lexicon_id long")
        written = {}
        for table in ("lexica", "lexicon_words", "link_sources"):
            parts = self.parts_with(table, gone)
            written[table] = (parts, self.rows(table, parts).filter(
                ~F.col("lexicon_id").eqNullSafe(lexicon_id)))
        self._commit(change, written)
        return True

    def set_document_years(
        self, change: str, corpus_name: str, year_from: int | None, year_to: int | None,
    ) -> bool:
        """The year range of one corpus's documents; marks no longer hold until refreshed."""
        if change in self.changes:
            return False
        model = self.model()
        members = model.corpus_documents.join(
            model.corpora.filter(F.col("name") == corpus_name), "corpus_id", "left_semi")
        parts = self.parts_with("documents", members.select("document_id"))
        some = replace(model, documents=self.rows("documents", parts))
        self._commit(change, {"documents": (
            parts, corpora.set_document_years(some, corpus_name, year_from, year_to))})
        return True

    def normalize_words(self, change: str) -> bool:
        """Respell words by the cleaning rule, in every table that holds a spelling.

        A word whose new spelling exists already stays.  Only the parts that hold a renamed word, or
        get one, are written.
        """
        if change in self.changes:
            return False
        renamed = words.normalize_words(self.rows("words")).filter("renamed").select(
            F.col("wordform").alias("old"), F.col("new_wordform").alias("new"))
        path = f"{self.path}/renamed/version={self.manifest.version + 1}"
        renamed.write.mode("overwrite").parquet(path)
        renamed = self.spark.read.schema("old string, new string").parquet(path)
        written = {}
        for table, columns in SPELLINGS.items():
            if not self.manifest.tables.get(table):
                continue
            parts = self._parts_renamed(table, columns, renamed)
            if parts:
                rows = self.rows(table, parts)
                for column in columns:
                    rows = self._respelled(rows, column, renamed)
                if table == "words":
                    rows = rows.withColumn("wordform_lowercase", F.lower("wordform"))
                written[table] = (parts, rows)
        self._commit(change, written, marks=self.has_marks() and self._marks_follow(written))
        return True

    @staticmethod
    def _marks_follow(written: dict) -> bool:
        return ("marked" in written) == ("attestations" in written)

    def _parts_renamed(
        self, table: str, columns: list[str], renamed: DataFrame,
    ) -> list[int]:
        by_spelling = KEYS[table][0] in columns
        if by_spelling and len(columns) == 1:
            # The part follows from the spelling: no row of the table is looked at.
            keys = renamed.select(F.explode(F.array("old", "new")).alias("key"))
            return self.parts_with(table, keys)
        rows, found = self.rows(table), set()
        for column in columns:
            hit = rows.join(
                renamed.withColumnRenamed("old", column), column).select(*rows.columns, "new")
            found |= set(self.parts_with(table, hit.select(KEYS[table][0])))
            if column == KEYS[table][0]:
                found |= set(self.parts_with(table, hit.select("new")))
        return sorted(found)

    @staticmethod
    def _respelled(rows: DataFrame, column: str, renamed: DataFrame) -> DataFrame:
        names = rows.columns
        return rows.join(renamed.withColumnRenamed("old", column), column, "left").withColumn(
            column, F.coalesce("new", column)).select(*names)

    def fill_anahashes(
        self, change: str, alphabet: dict[str, int] | None = None, reset: bool = False,
    ) -> bool:
        """Hash the words that have none, or all; parts without such words stay."""
        if change in self.changes:
            return False
        rows = self.rows("words")
        asked = rows if reset else rows.filter("anahash is null")
        parts = self.parts_with("words", asked.select("wordform"))
        some = self.rows("words", parts)
        some = words.reset_anahashes(some) if reset else some
        self._commit(change, {"words": (parts, words.fill_anahashes(some, alphabet))})
        return True

    def refresh_frequencies(self, change: str, missing_as_zero: bool = False) -> bool:
        """The table of total frequencies, from the attestations as they are."""
        if change in self.changes:
            return False
        table = corpora.word_frequencies(self.model(), missing_as_zero)
        self._commit(change, {"word_frequency": (None, table)})
        return True

    def refresh_marks(self, change: str) -> bool:
        """Marked attestations from the tables as they are."""
        if change in self.changes:
            return False
        model = replace(self.model(), marked=None)
        self._commit(change, {"marked": (None, marked(model))}, marks=True)
        return True

    def compact(self, change: str, table: str) -> bool:
        """Parts that were added to become one folder again."""
        if change in self.changes:
            return False
        parts = [int(p) for p, v in self.manifest.tables.get(table, {}).items() if len(v) > 1]
        marks = self.has_marks()
        self._commit(change, {table: (parts, self.rows(table, parts))} if parts else {}, marks=marks)
        return True

    def add_lexicon(self, change: str, name: str, vocabulary: bool, wordforms: DataFrame,
                    **options) -> bool:
        return self.add(change, lambda model: lexica.add_lexicon(
            model, name, vocabulary, wordforms, **options))

    def add_corpus(self, change: str, name: str, documents: DataFrame, frequencies: DataFrame,
                   **options) -> bool:
        return self.add(change, lambda model: corpora.add_corpus(
            model, name, documents, frequencies, **options))
