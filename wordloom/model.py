"""The model: one DataFrame per table of `schema.MODEL`, and what is kept beside them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from wordloom.operators.marks import Marked


@dataclass(frozen=True)
class Model:
    words: DataFrame
    lexica: DataFrame
    lexicon_words: DataFrame
    links: DataFrame
    link_sources: DataFrame
    corpora: DataFrame
    documents: DataFrame
    corpus_documents: DataFrame
    attestations: DataFrame
    paradigms: DataFrame
    external_links: DataFrame
    word_frequency: DataFrame
    ranked_variants: DataFrame
    #: Attestations with the marks of their documents, if they were written.
    marked: Marked | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "marked"}
