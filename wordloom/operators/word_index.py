"""A stored index of words: by trigram for regular expressions, by reversed spelling for endings.

Both tables are derived from the words and their frequencies and are written once.  Trigrams are
range-partitioned and sorted by (trigram, word), so a few trigrams read a few row groups and a
trigram of a third of all words still spreads over many files.  Reversed words are laid out the
same way, so an ending is a range of them.  After words change, build the index anew.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.scratch import parts_for, stored

TRIGRAMS = "trigram STRING, wordform STRING"
REVERSED = "reversed STRING, wordform STRING, frequency LONG"
WORDS = "wordform STRING"

#: Most alternatives of a clause; a longer one is left out, so more words are tested.
MOST_STRINGS = 32
#: Trigrams whose presence is kept as bits of one long.
BITS = 60
#: Marks of a word's start and end, so that anchored beginnings and endings of two characters count.
START, END = "\x02", "\x03"
# What Java lets follow an end.
_LAST_BREAK = "(\r\n|[\n\r\u0085\u2028\u2029])\\z"

# A class without nesting, intersection or escapes, which every dialect reads alike.
_PLAIN_CLASS = re.compile(r"\[\^?[^\[\]&\\^]+\]")


def _alternatives(op: str, value) -> set[str] | None:
    """The strings that one part of an expression matches, if they are few."""
    if op == "LITERAL":
        return {chr(value)}
    if op == "AT" and str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING"):
        return {START}
    if op == "AT" and str(value) in ("AT_END", "AT_END_STRING"):
        return {END}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in value):
        return {chr(v) for _, v in value}
    if op == "SUBPATTERN" and not value[1] and not value[2]:
        return _spelled_out(value[3])
    if op == "BRANCH":
        found = [_spelled_out(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[:2] == (0, 1):
        once = _spelled_out(value[2])
        return None if once is None else once | {""}
    return None


def _spelled_out(parts) -> set[str] | None:
    found = {""}
    for op, value in parts:
        some = _alternatives(str(op), value)
        if some is None or len(found) * len(some) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in some}
    return found


def _clauses(parts) -> list[set[str]]:
    clauses: list[set[str]] = []
    run = {""}
    for op, value in [*parts, ("END", None)]:
        op = str(op)
        some = _alternatives(op, value)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        if all(map(_trigrams_of, run)):
            clauses.append(run)
        run = {""}
        if some is not None:
            run = some
        elif op == "SUBPATTERN" and not value[1] and not value[2]:
            clauses += _clauses(value[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            clauses += _clauses(value[2])
        elif op == "BRANCH":
            # Each branch has to give a clause; the longest strings are the rarest.
            each = [_clauses(branch) for branch in value[1]]
            if all(each):
                best = set().union(*(max(c, key=lambda s: min(map(len, s))) for c in each))
                if len(best) <= MOST_STRINGS:
                    clauses.append(best)
    return clauses


def required_strings(pattern: str) -> list[list[str]]:
    """Clauses of strings: of each clause, every match of `pattern` contains one string.

    Words are taken with the marks of their start and end.  Expressions that Java may read in
    another way (flags, nested classes, Java's own escapes) and those without three characters in a
    row, such a mark being one, give no clause.
    """
    bare = _PLAIN_CLASS.sub("", re.sub(r"(?s)\\.", "", pattern))
    if "[" in bare or re.search(r"\(\?[^:=!]", pattern) or "\\Q" in pattern:
        return []
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    return [sorted(c) for c in _clauses(parsed)]


def _trigrams_of(text: str) -> set[str]:
    """Trigrams of a string of a clause; none reaches over a start or an end, which repeat freely
    and, an end, may have a line break behind it."""
    pieces = re.findall(f"{START}?[^{START}{END}]*{END}?", text)
    return {p[i:i + 3] for p in pieces for i in range(len(p) - 2)}


def _each_trigram(word: Column) -> Column:
    """The distinct trigrams of a word with its marks; an end is also before a last line break."""
    def cut(text: Column) -> Column:
        whole = F.concat(F.lit(START), text, F.lit(END))
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(whole) - 2, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(whole, i, F.lit(3)))

    bare = F.regexp_replace(word, _LAST_BREAK, "")
    return F.array_distinct(F.concat(cut(word), F.when(bare != word, cut(bare)).otherwise(
        F.array().cast("array<string>"))))


@dataclass(frozen=True)
class WordIndex:
    """The tables of one index folder."""

    words: DataFrame
    trigrams: DataFrame
    reversed_words: DataFrame

    @staticmethod
    def build(model: Model, path: str) -> WordIndex:
        """Write the index of a model's words below `path` and open it."""
        # Words without a spelling match nothing; repeated ones are one word.
        words = model.words.select("wordform").filter("wordform is not null").distinct()
        words.write.parquet(f"{path}/words")
        spark = words.sparkSession
        kept = spark.read.schema(WORDS).parquet(f"{path}/words")
        size = kept.agg(
            F.count(F.lit(1)).alias("words"), F.sum(F.char_length("wordform")).alias("trigrams")
        ).first()
        kept.select(
            F.explode(_each_trigram(F.col("wordform"))).alias("trigram"), "wordform",
        ).repartitionByRange(
            parts_for(spark, size["trigrams"]), "trigram", "wordform").sortWithinPartitions(
            "trigram", "wordform").write.parquet(f"{path}/trigrams")
        model.word_frequency.filter("wordform is not null").select(
            F.reverse("wordform").alias("reversed"), "wordform", "frequency",
        ).repartitionByRange(parts_for(spark, size["words"]), "reversed").sortWithinPartitions("reversed").write.parquet(
            f"{path}/reversed")
        return WordIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> WordIndex:
        def read(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}")

        return WordIndex(
            read("words", WORDS), read("trigrams", TRIGRAMS), read("reversed", REVERSED))

    def _held(self, pattern: str) -> tuple[DataFrame, Column]:
        """Words with what they hold of the asked trigrams, and the test that this is enough.

        Postings of one word meet as bits, so a trigram of very many words is spread by word.
        """
        clauses = required_strings(pattern)
        if not clauses:
            return self.words, F.lit(True)
        asked = sorted({t for c in clauses for s in c for t in _trigrams_of(s)})
        place = {t: divmod(i, BITS) for i, t in enumerate(asked)}
        longs = [asked[i:i + BITS] for i in range(0, len(asked), BITS)]

        def bit(group: list[str]) -> Column:
            given = F.lit(0).cast("long")
            for i, trigram in enumerate(group):
                given = F.when(F.col("trigram") == trigram, F.lit(1 << i).cast("long")).otherwise(
                    given)
            return given

        met = self.trigrams.filter(F.col("trigram").isin(asked)).groupBy("wordform").agg(*[
            F.bit_or(bit(group)).alias(f"held_{n}") for n, group in enumerate(longs)])

        def holds(string: str) -> Column:
            masks = [0] * len(longs)
            for trigram in _trigrams_of(string):
                n, i = place[trigram]
                masks[n] |= 1 << i
            held = F.lit(True)
            for n, mask in enumerate(masks):
                if mask:
                    wanted = F.lit(mask).cast("long")
                    held &= F.col(f"held_{n}").bitwiseAND(wanted) == wanted
            return held

        enough = F.lit(True)
        for clause in clauses:
            any_of = F.lit(False)
            for string in clause:
                any_of |= holds(string)
            enough &= any_of
        return met, enough

    def candidates(self, pattern: str) -> DataFrame:
        """Words with the trigrams that a match of `pattern` must have; all, if it must have none."""
        met, enough = self._held(pattern)
        return met.filter(enough).select("wordform")

    def matching(self, pattern: str) -> DataFrame:
        """Words with a match of a Java regular expression; only candidates are tested."""
        met, enough = self._held(pattern)
        # One condition: a test of the word alone would move below the grouping, to every posting.
        return met.filter(
            F.when(enough, F.col("wordform").rlike(pattern)).otherwise(F.lit(False))
        ).select("wordform")

    def first_matches(self, pattern: str, limit: int = 500) -> DataFrame:
        """`(wordform, total)`: the first matching words by spelling and the number of all.

        The matches are written once, so words are tested once; without a match there is no row.
        """
        found = stored(self.matching(pattern), "regexp-matches")
        total = found.agg(F.count(F.lit(1))).scalar()
        return found.orderBy("wordform").limit(limit).withColumn("total", total)

    def ending_in(self, suffix: str) -> DataFrame:
        """`(wordform, frequency)` of the words with an ending, which is a range of the table."""
        rows = self.reversed_words
        if suffix:
            rows = rows.filter(F.col("reversed").startswith(suffix[::-1]))
        return rows.select("wordform", "frequency")

    def suffix_pairs(self, suffix_1: str, suffix_2: str = "", min_freq: int = 10) -> DataFrame:
        """Words ending in `suffix_1` whose form with `suffix_2` exists, both above `min_freq`."""
        def stems(suffix: str, word: str) -> DataFrame:
            rows = self.ending_in(suffix).filter(F.col("frequency") > min_freq)
            return rows.select(
                F.expr(f"left(wordform, char_length(wordform) - {len(suffix)})").alias("stem"),
                F.col("wordform").alias(word), F.col("frequency").alias(f"{word}_freq"))

        return stems(suffix_1, "word1").join(stems(suffix_2, "word2"), "stem").select(
            "word1", "word1_freq", "word2", "word2_freq")
