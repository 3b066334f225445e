"""Readers, on small files of every format."""

import bz2
import gzip

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wordloom.sources import (
    files, frequency_files, paradigm_files, tables, variant_files, word_lists, xml_tokens,
)


def put(folder, name, content, opener=open, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    with opener(folder / name, "wt", encoding=encoding) as handle:
        handle.write(content)
    return str(folder)


def test_frequency_files(spark, tmp_path):
    put(tmp_path, "a.1720.clean", "x\t1\ny z\t2\nx\t7\n" + "w" * 256 + "\t3\n")
    put(tmp_path, "b.tsv.bz2", "x\t5\nnull\t1\n", bz2.open)
    found = frequency_files.read_frequency_files(spark, str(tmp_path))
    assert rows_of(found, "file", "wordform", "frequency") == [
        ("a.1720.clean", "x", 7), ("a.1720.clean", "y z", 2), ("b.tsv.bz2", "null", 1),
        ("b.tsv.bz2", "x", 5)]


def test_last_duplicate_counts_across_blocks(spark, tmp_path):
    """The last line of a file that is read in several blocks."""
    body = "".join(f"w{i}\t{i}\n" for i in range(20_000))
    put(tmp_path, "f.clean", "w5\t1\n" + body + "w5\t42\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = frequency_files.read_frequency_files(spark, str(tmp_path))
        assert found.filter("wordform = 'w5'").first()["frequency"] == 42
        assert found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_frequency_file_stops_the_job(spark, tmp_path):
    folder = put(tmp_path, "a.clean", "no tab\n")
    with pytest.raises(Exception):
        frequency_files.read_frequency_files(spark, folder).collect()


def corpus(spark, folder, layout):
    documents, _ = frequency_files.read_corpus(spark, folder, frequency_files.LAYOUTS[layout])
    return rows_of(documents, "title", "language", "year_from", "year_to", "pub_year")


def test_corpus_names(spark, tmp_path):
    a = put(tmp_path / "a", "WR-P.x.wordfreqlist.clean.tsv.bz2", "x\t5\n", bz2.open)
    assert corpus(spark, a, "sonar") == [("WR-P", "nl", 1990, 2010, None)]
    b = put(tmp_path / "b", "t.1.1814.clean", "x\t5\n")
    put(tmp_path / "b", "empty.1815.clean", "x" * 300 + "\t1\n")
    assert corpus(spark, b, "sgd") == [
        ("empty.1815", "nl", None, None, 1815), ("t.1.1814", "nl", None, None, 1814)]
    put(tmp_path / "b", "u.18XX.clean", "x\t5\n")
    assert corpus(spark, b, "edbo") == [
        ("empty.1815", "nl", None, None, 1815), ("t.1.1814", "nl", None, None, 1814)]
    c = put(tmp_path / "c", "p.1720+2_01.clean", "x\t5\n")
    put(tmp_path / "c", "LIM q.1721.clean", "x\t5\n")
    put(tmp_path / "c", "r.1722+0.clean", "x\t5\n")
    assert corpus(spark, c, "dbnl") == [
        ("LIM q.1721", "lim", None, None, 1721), ("p.1720+2_01", "nl", 1720, 1722, None),
        ("r.1722+0", "nl", None, None, 1722)]


def test_word_lists(spark, tmp_path):
    folder = put(tmp_path / "l", "words.lst", "aap\nnull\nNA\n\nnoot, mies\n")
    assert rows_of(word_lists.read_word_list(spark, folder)) == [
        ("NA",), ("aap",), ("noot, mies",), ("null",)]
    folder = put(tmp_path / "c", "words.csv", 'wordform\naap\nnull\n"a,b"\nNA\n')
    assert rows_of(word_lists.read_word_csv(spark, folder)) == [
        ("NA",), ("a,b",), ("aap",), ("null",)]
    folder = put(tmp_path / "p", "pairs.tsv", "gaan\tging\nnull\tnan\n")
    assert rows_of(word_lists.read_pairs(spark, folder), "lemma", "variant") == [("gaan", "ging"), ("null", "nan")]


def test_correction_list(spark, tmp_path):
    folder = put(tmp_path, "t.txt", "\n".join([
        "*aan bod\t#aanbod#aan het bod", "*abc#ab c~ example # not this~", "no star#x",
        "*def \t[EXAMPL: d#e] #d\tef", "*ghi#" + "z" * 100 + "#ghj", "*jkl\tnothing", "*m# ##n",
        "*café#koffie",
    ]) + "\n", encoding="cp1252")
    found = rows_of(word_lists.read_correction_list(spark, folder, encoding="windows-1252"), "wf", "corr")
    assert found == [
        ("aan bod", "aan het bod"), ("aan bod", "aanbod"), ("abc", "ab c"),
        ("café", "koffie"), ("def", "def"), ("ghi", "ghj"), ("m", "n")]


def test_dictionaries(spark, tmp_path):
    folder = put(tmp_path / "95", "d.csv", 
        'aap;aap;;Ili/as;zn;de;apen;a-pen;aap\\;tje;"x;y";co@\\\\o;\n')
    row = word_lists.read_dictionary_1995(spark, folder).first()
    assert (row["word"], row["disambiguation"], row["plural/past/attrib"]) == (
        "aap", None, "apen")
    assert row["diminu/compara/past plural"] == "aap;tje"
    assert row["diminu/compara/past plural syllables"] == "x;y"
    assert row["past perfect/superla"] == "co@\\o"
    assert row["past perfect/superla syllables"] is None
    folder = put(tmp_path / "bad", "d.csv", ";" * 12 + "\n")
    with pytest.raises(Exception):
        word_lists.read_dictionary_1995(spark, folder).collect()
    cells = [str(i) for i in range(25)]
    folder = put(tmp_path / "05", "d.csv", ";".join(cells) + "\n")
    frame = word_lists.read_dictionary_2005(spark, folder)
    assert len(frame.columns) == 25 and frame.first()["word 05"] == "11"


def test_paradigm_file(spark, tmp_path):
    from wordloom.operators.corpora import paradigm_rows

    folder = put(tmp_path, "m.tsv", "\n".join("\t".join(cells) for cells in [
        ["noise", "", "Z0001Y0003X2578W00054662V0001_HDU001", "", "1", "1", "WNT_M1_s", "", ""],
        ["aa", "", "Z0001Y0007X2124W00006579V0001_HDU002", "", "1", "1",
         "WNT_M052997_m#MNW_12_s@@OTHER_3", "", ""],
        ["b b", "", "Z0001Y0003X2578W00054662V0001_HDU001#Z0001Y0003X2578W00054341V0001_HDU001#Z",
         "", "1", "1", "", "", ""],
    ]) + "\n")
    rows = paradigm_files.read_paradigm_file(spark, folder)
    assert rows_of(paradigm_rows(rows), "wordform", "X", "W", "word_type_code") == [
        ("aa", 2124, 6579, "HDU"), ("b_b", 2578, 54341, "HDU"), ("b_b", 2578, 54662, "HDU")]
    assert rows_of(paradigm_files.external_ids(rows)) == [
        ("aa", "MNW", "12"), ("aa", "WNT", "M052997")]


def test_variant_files(spark, tmp_path):
    folder = put(tmp_path / "c", "1.txt", "ws1#1303#wf1#500133773#1#R#153688271885\n")
    put(tmp_path / "c", "2.txt", "wf2#930#wf1#500133773#1#R#153688271885\n")
    found = variant_files.read_correction_candidates(spark, folder)
    assert (found.count(), len(found.drop("line_order").columns)) == (2, 7)
    folder = put(
        tmp_path / "r", "r.gz", "a#1#b#x#y#2#z\na#9#c#x#y#3#z\nd#4#e#x#y#1\n", gzip.open)
    found = variant_files.read_ranked_variants(spark, folder)
    assert rows_of(found, "wordform", "frequency", "wordform_source", "levenshtein_distance") == [
        ("a", 1, "b", 2), ("d", 4, "e", 1)]


def test_anagram_files(spark, tmp_path):
    folder = put(tmp_path / "a", "a.txt", "10~ab#ba\n20~c\n")
    assert rows_of(variant_files.read_anahash_file(spark, folder)) == [
        (10, 0, "ab"), (10, 1, "ba"), (20, 0, "c")]
    folder = put(tmp_path / "c", "c.txt", "5#x\n9#x#y\n7#z\n")
    assert rows_of(variant_files.read_confusions(spark, folder)) == [(5,), (7,)]
    folder = put(tmp_path / "i", "i.txt", "5#100,200\n6#300\n")
    assert rows_of(variant_files.read_confusion_index(spark, folder)) == [
        (5, 0, 100), (5, 1, 200), (6, 0, 300)]
    folder = put(tmp_path / "l", "alphabet", "a\t158803\t13382255776\nb\t46032\t22877577568\n")
    from wordloom.functions.anahash import alphabet_dict

    assert alphabet_dict(variant_files.read_alphabet(spark, folder)) == {
        "a": 13382255776, "b": 22877577568}


def test_xml(spark, tmp_path):
    folder = put(tmp_path, "d.xml", """<?xml version="1.0"?>
<doc xmlns="http://example.org/ns"><s>
<w class="WORD"><t>Honden</t><pos head="N"/><lemma class="hond"/></w>
<w class="PUNCTUATION"><t>.</t></w>
<w class="WORD"><t>honden</t><pos head="N"/><lemma class="hond"/></w>
</s></doc>""")
    tokens = xml_tokens.read_tokens(spark, folder)
    assert rows_of(tokens) == [("d.xml", "Honden", "N", "hond"), ("d.xml", "honden", "N", "hond")]
    made = xml_tokens.lemma_tables(tokens)
    assert made["lemmata"].count() == 1 and made["wordforms"].count() == 2


def test_model_round_trip(spark, golden, tmp_path):
    from wordloom.operators.corpus_queries import cardinalities

    tables.write_model(golden, str(tmp_path / "model"))
    again = tables.read_model(spark, str(tmp_path / "model"))
    assert rows_of(cardinalities(again)) == rows_of(cardinalities(golden))


def test_glob_pattern():
    import re

    pattern = re.compile(files.glob_pattern("*1[0-9][0-9][0-9].clean"))
    assert pattern.match("a.1812.clean") and not pattern.match("a.18XX.clean")


def test_relational_tables_by_name(spark, tmp_path):
    """Other files beside the tables and tables that are folders; a missing one is an error."""
    import pytest
    from pyspark.errors import AnalysisException

    from tests import golden_tables
    from wordloom.schema import RELATIONAL
    from wordloom.sources.tables import read_relational

    golden_tables.write(tmp_path)
    for n in range(40):
        (tmp_path / f"a{n}.tsv").write_text("x\n1\n")
    expected = read_relational(spark, str(tmp_path), RELATIONAL)
    lexica = tmp_path / "lexica.tsv"
    content = lexica.read_text()
    lexica.unlink()
    lexica.mkdir()
    (lexica / "part-00000.csv").write_text(content)
    found = read_relational(spark, str(tmp_path), RELATIONAL)
    assert found.lexica.count() == len(content.strip().split("\n")) - 1
    assert found.links.count() == expected.links.count()
    (lexica / "part-00000.csv").unlink()
    lexica.rmdir()
    with pytest.raises(AnalysisException):
        read_relational(spark, str(tmp_path))


def test_long_dictionary_cell(spark, tmp_path):
    from wordloom.sources.word_lists import COLUMNS_1995, read_dictionary_1995

    long = "x" * 200_000
    cells = [long, f'"{long};y"', r"a\;b", '"', *["c"] * (len(COLUMNS_1995) - 4)]
    (tmp_path / "d.txt").write_text(";".join(cells) + "\n")
    row = read_dictionary_1995(spark, str(tmp_path)).first()
    assert (row[0], row[1], row[2], row[3]) == (long, f"{long};y", r"a;b", '"')


def test_files_are_left_out_when_the_scan_is_planned(spark, tmp_path):
    from wordloom.sources.files import text_lines

    for n in range(5):
        (tmp_path / f"{n}.txt").write_text(f"{n}\n")
    lines = text_lines(spark, str(tmp_path), glob="3.*")
    assert [r["value"] for r in lines.collect()] == ["3"]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Filter") > plan.index("monotonically_increasing_id")


def test_the_first_of_repeated_pairs_counts(spark, tmp_path):
    """Whichever direction comes first in the file decides, with its own columns."""
    from wordloom.operators.links import both_directions

    folder = put(tmp_path / "p", "p.tsv", "zeta\talfa\nalfa\tzeta\nzeta\talfa\nb\tc\n")
    directed = both_directions(
        word_lists.read_pairs(spark, folder), "lemma", "variant", order_by="line_order")
    assert rows_of(directed.filter("forward"), "wordform_from", "wordform_to") == [
        ("b", "c"), ("zeta", "alfa")]
    folder = put(tmp_path / "l", "l.txt", "*b#a #c\n*a#b\n")
    found = word_lists.read_correction_list(spark, folder)
    assert rows_of(found.select("wf", "corr", F.rank().over(
        Window.partitionBy(F.lit(0)).orderBy("line_order")).alias("n"))) == [
        ("a", "b", 3), ("b", "a", 1), ("b", "c", 2)]
    folder = put(
        tmp_path / "c", "c.txt", "zeta#1#alfa#1#5#R#1\nalfa#1#zeta#1#9#R#1\nzeta#1#alfa#1#1#R#1\n")
    directed = both_directions(
        variant_files.read_correction_candidates(spark, folder), "ocr_variant",
        "correction_candidate", ["ld"], order_by="line_order")
    assert rows_of(directed.filter("forward"), "wordform_from", "wordform_to", "ld") == [
        ("zeta", "alfa", 5)]
