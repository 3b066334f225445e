"""Morphological paradigms: words that share the codes Z, Y, X and W."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import paradigm_code
from wordloom.model import Model
from wordloom.operators.corpus_queries import word_in_corpora_over_time, year_bound
from wordloom.operators.lexicon_queries import corrections
from wordloom.operators.lookup import Words, for_words, is_listed
from wordloom.operators.marks import each_corpus, marked
from wordloom.scratch import stored

CODES = ["Z", "Y", "X", "W"]
# The type code of a lemma, and of the forms listed with it.
LEMMA, MEMBER = "HCL", "HCM"


def _rows():
    return F.count(F.lit(1))


def word_type_codes(model: Model) -> DataFrame:
    return model.paradigms.select(F.col("word_type_code").alias("code")).distinct()


def paradigms_of_word(model: Model, words: Words) -> DataFrame:
    return for_words(model.paradigms, words).select("wordform", *CODES, "word_type_code")


def paradigms_asked(model: Model, words: Words) -> DataFrame:
    """(lookup_word, Z, Y, X, W): each paradigm of a looked-up word once."""
    return for_words(model.paradigms, words).select(
        F.col("wordform").alias("lookup_word"), *CODES).distinct()


def morph_links(model: Model, words: Words) -> DataFrame:
    """Words in the paradigms of a word; once per pair of rows that meet."""
    mine = for_words(model.paradigms, words).select(
        F.col("wordform").alias("lookup_word"), *CODES)
    if is_listed(words):
        # Written first: of a known size, so the paradigms are scanned, not shuffled, for a few.
        mine = stored(mine, "looked-up")
    return mine.join(model.paradigms, CODES).select("lookup_word", "wordform")


def lemmas_for_wordform(model: Model, words: Words) -> DataFrame:
    """The lemma rows of a word's paradigms."""
    lemmas = model.paradigms.filter(F.col("word_type_code") == LEMMA)
    return lemmas.join(paradigms_asked(model, words), CODES).select(
        "lookup_word", "paradigm_id", "wordform", "W", "X", "Y", "Z")


def variants_for_lemma(
    model: Model, paradigm_id: int | DataFrame, distinct_attestations: bool = False,
) -> DataFrame:
    """Forms of a paradigm with corpora, lexica, paradigms, years and frequency.

    `frequency` counts an attestation once per corpus of its document, per lexicon and per
    paradigm row of the word, as a plain join of all tables gives it; `distinct_attestations`
    counts it once.  `num_paradigms` counts distinct sums W+X+Y+Z.  All are aggregated per word
    before they meet, so the join never multiplies rows.  Missing values are 0.
    """
    if isinstance(paradigm_id, DataFrame):
        chosen = model.paradigms.join(paradigm_id, "paradigm_id", "left_semi")
    else:
        chosen = model.paradigms.filter(F.col("paradigm_id") == paradigm_id)
    forms = (
        model.paradigms.join(
            chosen.select(F.col("paradigm_id").alias("lemma_id"), *CODES), CODES)
        .groupBy("lemma_id", "V", "W", "X", "Y", "Z", "word_type_code", "wordform")
        .agg(_rows().alias("copies"))
    )
    # Written first: read four times, and of a known size, so that the attestations are
    # scanned, not shuffled, when the forms are few.
    forms = stored(forms, "forms")
    words = stored(forms.select("wordform").distinct(), "form-words")
    mine = marked(model, words, few=not isinstance(paradigm_id, DataFrame))
    by_set = mine.groupBy("wordform", "corpora").agg(
        F.sum("frequency").alias("f"), F.min("year").alias("first"), F.max("year").alias("last"))
    # Per word and corpus first: the second step counts corpora without a distinct.
    per_corpus = each_corpus(by_set, outer=True).groupBy("wordform", "corpus_id").agg(
        F.sum("f").alias("f"), F.min("first").alias("first"), F.max("last").alias("last"))
    attested = per_corpus.groupBy("wordform").agg(
        F.sum("f").alias("per_corpus"), F.count("corpus_id").alias("num_corpora"),
        F.min("first").alias("min_year"), F.max("last").alias("max_year"))
    in_lexica = model.lexicon_words.join(words, "wordform", "left_semi").groupBy(
        "wordform").agg(
        F.count_distinct("lexicon_id").alias("num_lexica"), _rows().alias("lexicon_rows"))
    in_paradigms = model.paradigms.join(words, "wordform", "left_semi").groupBy(
        "wordform").agg(
        F.count_distinct(sum((F.col(c) for c in CODES), F.lit(0))).alias("num_paradigms"),
        _rows().alias("paradigm_rows"))
    joined = forms
    for part in (attested, in_lexica, in_paradigms):
        joined = joined.join(part, "wordform", "left")
    if distinct_attestations:
        once = mine.groupBy("wordform").agg(F.sum("frequency").alias("once"))
        joined = joined.join(once, "wordform", "left")
        frequency = F.col("once")
    else:
        frequency = (
            F.col("per_corpus") * F.col("copies")
            * F.coalesce("lexicon_rows", F.lit(1)) * F.coalesce("paradigm_rows", F.lit(1)))
    counted = [
        F.coalesce(c, F.lit(0).cast("long")).alias(c)
        for c in ("num_corpora", "num_lexica", "min_year", "max_year", "num_paradigms")
    ]
    return joined.select(
        "lemma_id", "V", *reversed(CODES), "word_type_code", "wordform", *counted,
        F.coalesce(frequency, F.lit(0).cast("long")).alias("frequency"),
    )


def paradigm_variants(model: Model, paradigms: DataFrame) -> DataFrame:
    """Forms of paradigms (rows with Z, Y, X, W) that have a hash and a frequency row."""
    words = model.words.filter(F.col("anahash").isNotNull()).select("wordform", "anahash")
    return (
        model.paradigms.join(paradigms, CODES)
        .join(words, "wordform").join(model.word_frequency, "wordform")
    )


def variants_of_word(
    model: Model, words: Words, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Every form of a word's paradigms with its yearly series, as rows.

    A form without a series in the period has one row with NULLs there.  One plan for all
    words, paradigms, forms and years.
    """
    forms = paradigm_variants(model, paradigms_asked(model, words)).select(
        "lookup_word", paradigm_code().alias("paradigm_code"), "wordform", "word_type_code",
        "word_type_number", "V", "anahash", "frequency",
    )
    forms = stored(forms, "forms")
    lemmas = forms.filter(F.col("word_type_code") == LEMMA).groupBy(
        "lookup_word", "paradigm_code").agg(F.min("wordform").alias("lemma"))
    series = word_in_corpora_over_time(
        model, forms.select("wordform"), start, end, is_listed(words))
    return (
        forms.join(lemmas, ["lookup_word", "paradigm_code"], "left")
        .join(series.withColumnRenamed("name", "corpus_name"), "wordform", "left")
        .select(
            "lookup_word", "paradigm_code", "lemma", "wordform", "word_type_code",
            "word_type_number", "V", "anahash", "frequency", "corpus_name", "year",
            "term_frequency", "total", "freq", "rel_corpus_frequency", "total_number_of_words",
        )
    )


def variants_metadata(
    model: Model, words: Words, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Per paradigm of a word the ranges over its forms.

    A form without a series counts with year 0 and frequency 0; `min_year` is never before the
    first year of the period.
    """
    per_form = (
        variants_of_word(model, words, start, end)
        .groupBy("lookup_word", "paradigm_code", "wordform", "V")
        .agg(*[
            F.coalesce(f(c), F.lit(0)).alias(n) for n, f, c in (
                ("min_year", F.min, "year"), ("max_year", F.max, "year"),
                ("min_freq", F.min, "freq"), ("max_freq", F.max, "freq"))
        ])
    )
    ranges = per_form.groupBy("lookup_word", "paradigm_code").agg(
        F.min("min_year").alias("min_year"), F.max("max_year").alias("max_year"),
        F.min("min_freq").alias("min_freq"), F.max("max_freq").alias("max_freq"))
    return ranges.withColumns({
        "overall_min_year": year_bound(model, "min_year", start),
        "overall_max_year": year_bound(model, "max_year", end),
    }).withColumn("min_year", F.greatest("min_year", "overall_min_year"))


def variants_document(
    model: Model, words: Words, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """One row per looked-up word: its paradigms, their forms and the forms' series, nested.

    `paradigms` is an array by code; each has its lemma, the ranges of `variants_metadata` and
    `variants` by form number, each with `corpora` by name and `frequencies` by year.  A row
    holds the forms of one word's paradigms, for the words that are asked for.
    """
    rows = variants_of_word(model, words, start, end)
    form = ["lookup_word", "paradigm_code", "lemma", "V", "wordform", "word_type_code",
            "word_type_number", "anahash", "frequency"]
    point = F.struct("year", "freq", "total", "term_frequency", "rel_corpus_frequency")
    per_corpus = rows.groupBy(*form, "corpus_name").agg(
        F.first("total_number_of_words").alias("total_number_of_words"),
        F.sort_array(F.collect_list(point)).alias("frequencies"))
    series = F.when(F.col("corpus_name").isNotNull(), F.struct(
        "corpus_name", "total_number_of_words", "frequencies"))
    per_form = per_corpus.groupBy(*form).agg(
        F.sort_array(F.collect_list(series)).alias("corpora"))
    per_paradigm = per_form.groupBy(*form[:3]).agg(
        F.sort_array(F.collect_list(F.struct(*form[3:], "corpora"))).alias("variants"))
    ranges = variants_metadata(model, words, start, end)
    metadata = F.struct(*[c for c in ranges.columns if c not in form]).alias("metadata")
    return (
        per_paradigm.join(
            ranges.select("lookup_word", "paradigm_code", metadata),
            ["lookup_word", "paradigm_code"])
        .groupBy("lookup_word").agg(F.sort_array(F.collect_list(F.struct(
            "paradigm_code", "lemma", "metadata", "variants"))).alias("paradigms"))
    )


def corrections_document(
    model: Model, words: Words, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """`variants_document` with the ranked variants of the word, nearest first.

    A word with only one of the two has NULL for the other.
    """
    ranked = corrections(model, words).groupBy("lookup_word").agg(F.sort_array(F.collect_list(
        F.struct("levenshtein_distance", "wordform", "frequency"))).alias("corrections"))
    return variants_document(model, words, start, end).join(ranked, "lookup_word", "full")


def paradigm_count(
    model: Model, X: int | None = None, Y: int | None = None, Z: int | None = None,
) -> DataFrame:
    rows = model.paradigms
    for column, value in (("X", X), ("Y", Y), ("Z", Z)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.groupBy("X", "Y", "Z").agg(F.count("W").alias("num_paradigms")).orderBy(
        F.desc("num_paradigms"), "X", "Y", "Z")


def paradigm_size(model: Model, var: str = "X") -> DataFrame:
    if var not in ("X", "Y", "Z"):
        raise ValueError("var should be X, Y or Z")
    return model.paradigms.groupBy(var).agg(F.count("W").alias("num_paradigms")).orderBy(
        F.desc("num_paradigms"), var)


def with_frequency(rows: DataFrame, model: Model) -> DataFrame:
    return rows.join(model.word_frequency, "wordform", "left")


def variants_by_codes(model: Model, W: int, X: int, Y: int, Z: int) -> DataFrame:
    """Lemma and member forms of one paradigm; a missing frequency is 0."""
    rows = model.paradigms.filter(
        (F.col("W") == W) & (F.col("X") == X) & (F.col("Y") == Y) & (F.col("Z") == Z)
        & F.col("word_type_code").isin(LEMMA, MEMBER))
    return with_frequency(rows, model).select(
        "wordform", F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"))


def codes_of_word(model: Model, words: Words) -> DataFrame:
    """(paradigm_id, W, X, Y, Z) of a word, by equality of spelling."""
    return for_words(model.paradigms, words).select(
        F.col("wordform").alias("lookup_word"), "paradigm_id", *reversed(CODES)
    ).orderBy("paradigm_id")


def _lemmas(model: Model, Z: int, Y: int) -> DataFrame:
    rows = model.paradigms.filter(
        (F.col("Z") == Z) & (F.col("Y") == Y) & (F.col("word_type_code") == LEMMA))
    return with_frequency(rows, model)


def nearest_x(model: Model, X: int, Y: int, Z: int, limit: int = 50) -> DataFrame:
    """The X values nearest to one, with the frequency of their lemmas."""
    return _lemmas(model, Z, Y).groupBy("X").agg(F.sum("frequency").alias("sum_freq")).orderBy(
        F.abs(F.col("X") - X), "X").limit(limit)


def frequent_x(model: Model, Y: int, Z: int, limit: int = 50) -> DataFrame:
    """The X values whose lemmas are most frequent."""
    return _lemmas(model, Z, Y).groupBy("X").agg(F.sum("frequency").alias("sum_freq")).orderBy(
        F.desc("sum_freq"), "X").limit(limit)


def frequent_lemmas(model: Model, X: int, Y: int, Z: int, limit: int) -> DataFrame:
    """The most frequent lemmas of one X."""
    return _lemmas(model, Z, Y).filter(F.col("X") == X).select(
        "X", "W", "wordform", "frequency").orderBy(F.desc("frequency"), "wordform").limit(limit)


def top_lemma_per_x(model: Model, Y: int, Z: int) -> DataFrame:
    """The most frequent lemma of each X; of equally frequent ones the smallest."""
    best = F.min_by("wordform", F.struct(-F.coalesce("frequency", F.lit(0)), "wordform"))
    return _lemmas(model, Z, Y).groupBy("X").agg(
        best.alias("wordform"), F.max("frequency").alias("frequency"))


def paradigm_network(
    model: Model, words: Words, groups: int = 50, lemmas: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) around a word's first paradigm.

    The `groups` nearest X values become hubs, each linked to its `lemmas` most frequent
    lemmas; a hub with one lemma stands for it.  The hub of the word's own X carries the word
    and is linked to all other hubs.  Roots and chosen groups of listed words are at most
    1000 and 1000 x `groups` rows and are broadcast, so lemmas are not shuffled by X and each
    task keeps only its own top rows before the window.
    """
    small = F.broadcast if is_listed(words) else (lambda df: df)
    root = network_roots(for_words(model.paradigms, words))
    candidates = with_frequency(
        model.paradigms.filter(F.col("word_type_code") == LEMMA).join(
            small(root), ["Z", "Y"]), model,
    ).select(
        *root.columns, "X", "W", "wordform",
        F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"))
    nearest = Window.partitionBy("lookup_word").orderBy(F.abs(F.col("X") - F.col("root_x")), "X")
    own = F.col("X") == F.col("root_x")
    chosen = (
        candidates.select("lookup_word", "X", "root_x").distinct()
        .withColumn("near", F.row_number().over(nearest)).filter(F.col("near") <= groups)
        .withColumn("rooted", F.max(own).over(Window.partitionBy("lookup_word")))
        .select("lookup_word", "X", "rooted")
    )
    frequent = Window.partitionBy("lookup_word", "X").orderBy(F.desc("frequency"), "wordform")
    top = (
        candidates.join(small(chosen), ["lookup_word", "X"])
        .withColumn("place", F.row_number().over(frequent)).filter(F.col("place") <= lemmas)
    )
    return drawn_network(top.groupBy(*root.columns, "X", "rooted").agg(*members_of_hub()))


def network_roots(rows: DataFrame) -> DataFrame:
    """(lookup_word, Z, Y, root_x, root_w): the codes of each word's first paradigm."""
    return rows.groupBy(F.col("wordform").alias("lookup_word")).agg(
        F.min_by(F.struct(*CODES), "paradigm_id").alias("r")
    ).select(
        "lookup_word", F.col("r.Z").alias("Z"), F.col("r.Y").alias("Y"),
        F.col("r.X").alias("root_x"), F.col("r.W").alias("root_w"))


def members_of_hub() -> list[Column]:
    """Aggregates of a hub's rows, which are few, so they fit in an array."""
    member = F.struct("place", "wordform", "W", F.col("frequency").alias("f"))
    return [F.sum("frequency").alias("frequency"),
            F.sort_array(F.collect_list(member)).alias("members")]


def drawn_network(hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of hubs: the columns of `network_roots`, X, rooted and `members_of_hub`."""
    hubs = hubs.select(
        "*", F.format_string("Z%dY%dX%d", "Z", "Y", "X").alias("hub"),
        (F.col("X") == F.col("root_x")).alias("own"))
    shown = F.filter("members", lambda m: F.size("members") > 1)

    def node(name, W, kind: str, frequency, wordform):
        return F.struct(
            name.alias("id"), W.alias("W"), F.lit(kind).alias("type"),
            frequency.alias("frequency"), wordform.alias("wordform"))

    first = F.get("members", F.lit(0))
    hub_node = node(
        F.col("hub"), F.when(F.col("own"), F.col("root_w")).otherwise(first["W"]), "x",
        F.col("frequency"),
        F.when(F.col("own"), F.col("lookup_word")).otherwise(first["wordform"]))
    word_nodes = F.transform(
        shown, lambda m: node(m["wordform"], m["W"], "w", m["f"], m["wordform"]))
    nodes = hubs.select(
        "lookup_word", "Z", "Y", "X", F.inline(F.concat(word_nodes, F.array(hub_node))))

    def link(source, kind: str):
        return F.struct(source.alias("source"), F.lit(kind).alias("type"))

    to_hub = F.transform(shown, lambda m: link(m["wordform"], "XW"))
    to_root = F.filter(
        F.array(link(F.col("hub"), "XX")), lambda _: F.col("rooted") & ~F.col("own"))
    root_hub = F.format_string("Z%dY%dX%d", "Z", "Y", "root_x").alias("root_hub")
    links = hubs.select(
        "lookup_word", "hub", root_hub, F.inline(F.concat(to_hub, to_root)),
    ).withColumn("target", F.when(F.col("type") == "XW", F.col("hub")).otherwise(
        F.col("root_hub")))
    return nodes, links.select(
        "lookup_word", "source", "target", "type", F.concat("source", "target").alias("id"))
