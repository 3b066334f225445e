"""Loading named sources into a model, one Spark job per source."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from wordloom.model import Model
from wordloom.operators import corpora, lexica, words
from wordloom.schema import MODEL
from wordloom.scratch import stored
from wordloom.sources import frequency_files, paradigm_files, variant_files, word_lists
from wordloom.sources.stored_model import StoredModel

Additions = dict[str, DataFrame]
Loader = Callable[[SparkSession, list[str], Model], Additions]


@dataclass(frozen=True)
class Source:
    paths: Sequence[str]
    load: Loader
    replaces: Sequence[str] = ()


def _word_list(name: str, read=word_lists.read_word_list) -> Loader:
    def load(spark, paths, model):
        return lexica.add_lexicon(model, name, True, read(spark, paths))

    return load


def _pairs(name: str, read, from_column: str, to_column: str, from_correct: bool) -> Loader:
    def load(spark, paths, model):
        return lexica.add_lexicon_with_links(
            model, name, from_correct, read(spark, paths), from_column, to_column,
            from_correct, True, order_by="line_order")

    return load


def _corpus(layout: str) -> Loader:
    def load(spark, paths, model):
        chosen = frequency_files.LAYOUTS[layout]
        documents, frequencies = frequency_files.read_corpus(spark, paths, chosen)
        return corpora.add_corpus(
            model, chosen.corpus, documents, stored(frequencies, "frequencies"))

    return load


def _paradigms(spark, paths, model):
    rows = paradigm_files.read_paradigm_file(spark, paths)
    return corpora.add_paradigms(model, rows, first_paradigm_id=1)


def _frequencies(spark, paths, model):
    return {"word_frequency": corpora.word_frequencies(model)}


def _variants(spark, paths, model):
    return {"ranked_variants": variant_files.read_ranked_variants(spark, paths).select(
        *MODEL["ranked_variants"].names)}


# The names of the lexica.  Sources are loaded in this order.
SOURCES: dict[str, Source] = {
    "twente": Source(["twente"], _pairs(
        "Published Dutch typos (Dutch Newspapers 2002)", word_lists.read_correction_list,
        "wf", "corr", False)),
    "inl": Source(["inl"], _word_list(
        "Dutch Historical Lexicon INT (prerelease)", word_lists.read_word_csv)),
    "sonar": Source(["sonar"], _corpus("sonar")),
    "elex": Source(["elex"], _pairs("e-Lex", word_lists.read_pairs, "lemma", "variant", True)),
    "gb1914": Source(["gb1914"], _word_list("Green Booklet 1914 (Gutenberg)")),
    "gb1995": Source(["gb1995"], _word_list("Green Booklets 1995 and 2005 (merged)")),
    "opentaal": Source(["opentaal"], _word_list("Open Taal modern Dutch word list")),
    "sgd": Source(["sgd"], _corpus("sgd")),
    "edbo": Source(["edbo"], _corpus("edbo")),
    "dbnl": Source(["dbnl"], _corpus("dbnl")),
    "paradigms": Source(["paradigms"], _paradigms, replaces=["paradigms"]),
    "frequencies": Source([], _frequencies, replaces=["word_frequency"]),
    "variants": Source(["variants"], _variants),
}


def empty_model(spark: SparkSession) -> Model:
    return Model(**{
        name: spark.createDataFrame([], schema) for name, schema in MODEL.items()})


def chosen_sources(
    include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
) -> dict[str, Source]:
    if include and exclude:
        raise ValueError("give sources to include or to exclude, not both")
    if include:
        return {name: SOURCES[name] for name in include}
    return {name: s for name, s in SOURCES.items() if name not in (exclude or ())}


def ingest(
    spark: SparkSession, base: str, model: Model | None = None,
    include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
    paths: dict[str, Sequence[str]] | None = None, hash_words: bool = True,
    reset_hashes: bool = False, alphabet: dict[str, int] | None = None,
) -> Model:
    """Load sources from below `base` into a model (by default an empty one).

    The rows each source adds are written to the shared folder before the next source is
    loaded, so the plans stay short and a lost executor costs one source at most.
    """
    sources = chosen_sources(include, exclude)
    model = model or empty_model(spark)
    for name, source in sources.items():
        where = [os.path.join(base, p) for p in (paths or {}).get(name, source.paths)]
        added = {
            table: stored(rows, f"{name}-{table}")
            for table, rows in source.load(spark, where, model).items()
        }
        model = replace(model, **{
            table: model_rows(model, table, table in source.replaces).unionByName(rows)
            for table, rows in added.items()
        })
    table = words.reset_anahashes(model.words) if reset_hashes else model.words
    if hash_words:
        table = stored(words.fill_anahashes(table, alphabet), "words")
    return replace(model, words=table)


def ingest_into(
    store: StoredModel, base: str, include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None, paths: dict[str, Sequence[str]] | None = None,
    hash_words: bool = True, reset_hashes: bool = False,
    alphabet: dict[str, int] | None = None, load: str = "load",
) -> Model:
    """Load sources into a stored model, each as one change named after `load` and the source.

    A job that starts anew after a failure goes on with the first source that is not loaded; to
    load a source a second time, give another name of the load.
    """
    for name, source in chosen_sources(include, exclude).items():
        where = [os.path.join(base, p) for p in (paths or {}).get(name, source.paths)]

        def additions(model: Model, name=name, source=source, where=where) -> Additions:
            return {
                table: stored(rows, f"{name}-{table}")
                for table, rows in source.load(store.spark, where, model).items()}

        store.add(f"{load} {name}", additions, source.replaces)
    if hash_words or reset_hashes:
        store.fill_anahashes(f"{load} hashes", alphabet, reset_hashes)
    return store.model()


def model_rows(model: Model, table: str, emptied: bool) -> DataFrame:
    rows = getattr(model, table)
    return corpora.empty(rows) if emptied else rows
