"""Table schemas.

The model is keyed by natural keys: a word is identified by its spelling, so the
big fact table needs no join to be read or grouped by word.  Corpora, lexica,
documents and paradigm rows keep the numeric ids that callers use as parameters.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, S, B, I = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DOCUMENT_COLUMNS = dict(
    document_id=L, persistent_id=S, word_count=L, encoding=L, title=S, year_from=L, year_to=L,
    pub_year=L, author=S, editor=S, publisher=S, publishing_location=S, text_type=S, region=S,
    language=S, other_languages=S, spelling=S, parent_document=L,
)

# The tables every operator works on.
MODEL = {
    "words": _table(wordform=S, wordform_lowercase=S, anahash=L),
    "lexica": _table(lexicon_id=L, lexicon_name=S, vocabulary=B),
    "lexicon_words": _table(lexicon_id=L, wordform=S),
    "links": _table(wordform_from=S, wordform_to=S),
    "link_sources": _table(
        wordform_from=S, wordform_to=S, lexicon_id=L, wordform_from_correct=B,
        wordform_to_correct=B, ld=I, anahash_difference=L,
    ),
    "corpora": _table(corpus_id=L, name=S),
    "documents": _table(**DOCUMENT_COLUMNS),
    "corpus_documents": _table(corpus_id=L, document_id=L),
    "attestations": _table(wordform=S, document_id=L, frequency=L),
    "paradigms": _table(
        paradigm_id=L, Z=L, Y=L, X=L, W=L, V=L, word_type_code=S, word_type_number=L, wordform=S,
    ),
    "external_links": _table(wordform=S, source_name=S, source_id=S),
    "word_frequency": _table(wordform=S, frequency=L),
    "ranked_variants": _table(
        wordform=S, wordform_source=S, levenshtein_distance=L, frequency=L,
    ),
}

# The same model as fourteen id-keyed tables, the exchange format of `sources.tables`.
RELATIONAL = {
    "anahashes": _table(anahash_id=L, anahash=L),
    "corpora": MODEL["corpora"],
    "corpusId_x_documentId": MODEL["corpus_documents"],
    "documents": MODEL["documents"],
    "external_links": _table(
        external_link_id=L, wordform_id=L, source_name=S, source_id=S,
    ),
    "lexica": _table(lexicon_id=L, lexicon_name=S, vocabulary=I),
    "lexical_source_wordform": _table(wordform_source_id=L, lexicon_id=L, wordform_id=L),
    "morphological_paradigms": _table(
        paradigm_id=L, Z=L, Y=L, X=L, W=L, V=L, word_type_code=S, word_type_number=L,
        wordform_id=L,
    ),
    "source_x_wordform_link": _table(
        source_x_wordform_link_id=L, wordform_from=L, wordform_to=L, lexicon_id=L,
        wordform_from_correct=I, wordform_to_correct=I, ld=I, anahash_difference=L,
    ),
    "text_attestations": _table(attestation_id=L, frequency=L, wordform_id=L, document_id=L),
    "ranked_variants": _table(
        variant_id=L, wordform=S, wordform_source=S, wordform_source_id=L,
        levenshtein_distance=L, frequency=L,
    ),
    "wordform_frequency": _table(wordform_id=L, wordform=S, frequency=L),
    "wordform_links": _table(wordform_from=L, wordform_to=L),
    "wordforms": _table(wordform_id=L, wordform=S, anahash_id=L, wordform_lowercase=S),
}

# The lemma database: tokens analysed with a part of speech and a modern lemma.
LEMMA_DB = {
    "wordforms": _table(wordform=S, has_analysis=B),
    "analyses": _table(
        analysis_id=L, wordform=S, part_of_speech=S, lemma_id=L, multiple_lemmata_analysis_id=L,
        verified_by=L,
    ),
    "lemmata": _table(lemma_id=L, modern_lemma=S, lemma_part_of_speech=S),
    "token_attestations": _table(analysis_id=L, document_id=L),
    "documents": _table(document_id=L, persistent_id=S, word_count=L, pub_year=L),
}
