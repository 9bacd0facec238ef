"""Texts are dealt out in parts of a bounded size."""

from pyspark.sql import functions as F

from quern.functions import addresses as U
from quern.operators import drafting as G
from quern.operators import markup as K
from quern.plans import cards as C
from quern.runtime import dealt
from quern.sources import adapters as A


def test_parts_grow_with_the_texts(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>ab</p>"), 100).alias("html"))
    assert dealt(pages, "page_id", "html", 9_000).rdd.getNumPartitions() == 30
    assert dealt(pages.where("page_id < 0"), "page_id", "html").count() == 0
    assert dealt(pages, "page_id", "html", 9_000).select("page_id").distinct().count() == 300


def test_tokens_of_many_pages_come_in_more_parts_than_the_session_has(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.repeat(F.lit("ab "), 400_000)).alias("html"))
    assert K.tokens(pages).rdd.getNumPartitions() >= 12


def test_lines_of_a_small_file_are_dealt_out_over_all_cores(spark):
    found = A.lines(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(bool(p) for p in found.rdd.glom().collect()) > 2


def test_text_without_a_mark_is_looked_at_once(spark):
    """Text with any of the signs goes through all patterns; other text loses its white space only."""
    texts = ["a  b\tc", "!x (y) - + # | >", *(f"{a}q w{b} e" for a, b in (("**", "**"), ("*", "*"), ("__", "__"), ("_", "_"), ("`", "`"), ("~~", "~~"), ("[", "](u)"), ("![", "](u)"), ("<b>", "</b>"), ("\\#", "\\|"), ("[^", "]"), ("<https://", ">")))]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.without_marks(F.col("t")).alias("bare")).collect()
    assert {r.t: r.bare for r in found if r.t in texts[:2]} == {texts[0]: "a b c", texts[1]: texts[1]}
    assert [r.bare for r in found[2:]] == ["q w e", "q w e", "q w e", "q w e", "q w e", "q w e", "q w e", "e", "q w e", "#q w| e", "e", "e"]


def test_blocks_and_cards_are_worked_out_once(spark, tmp_path):
    """What comes after reads working tables: neither blocks nor sections are evaluated again for summaries, or for cards that stay."""
    for name, fixture in (("blocks", C.BLOCKS), ("sections", C.SECTIONS)):
        fixture.frame(spark).write.parquet(f"{tmp_path}/{name}")
    blocks, sections = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("blocks", "sections"))
    for found in (G.section_cards(blocks, sections), G.drafted(blocks, sections)):
        assert found.count() > 0 and not any(str(tmp_path) in x for x in found.inputFiles())
