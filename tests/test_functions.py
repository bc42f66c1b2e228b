import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.operators import chunks, jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("RM2652 not cooling on AC", ["rm2652", "not", "cooling"]), (None, []), ("élan ab abc abc", ["lan", "abc", "abc"])])
def test_tokenize(spark, text, want):
    assert value(spark, T.tokenize(F.lit(text).cast("string"))) == want


def test_page_refs(spark):
    assert sorted(value(spark, T.page_refs(F.lit("Page 007, page0, PAGE\n 12")))) == [0, 7, 12]


@pytest.mark.parametrize(
    "text, want",
    [("see section & page".ljust(79), False), ("see section & page".ljust(80), True), ("symptom cause page 4 and page 4".ljust(90), True), ("symptom cause page 4".ljust(90), False), ("no gas page 1 page 2 page 3 page 4".ljust(90), True), (None, False)],
)
def test_is_index_chart(spark, text, want):
    assert value(spark, T.is_index_chart(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize("text, want", [("PD converter", []), ("Progressive Dynamics PD9245", ["progressive dynamics", "pd"]), ("balance motor", ["bal"]), ("", [])])
def test_named_brands(spark, text, want):
    assert value(spark, T.named_brands(F.lit(text))) == want


def test_expand_terms(spark):
    assert sorted(value(spark, T.expand_terms(F.lit(""), F.lit("unit is level")))) == ["cooling", "level", "unit"]


@pytest.mark.parametrize("text, want", [("no repair yet. later replaced the board", False), ("replaced the board. still open", True), ("checked fuse", False), (None, False)])
def test_status(spark, text, want):
    assert value(spark, T.is_open_status(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize("n, want", [(0, [0]), (900, [900]), (901, [900, 121]), (1680, [900, 900]), (1681, [900, 900, 121])])
def test_chunk_lengths(spark, n, want):
    assert [len(x) for x in value(spark, T.chunk_texts(F.lit("x" * n)))] == want


def test_short_chunk_keeps_its_spaces(spark):
    assert value(spark, T.chunk_texts(F.lit("  abcdef  "))) == ["  abcdef  "]


@pytest.mark.parametrize(
    "key, want",
    [("documents/3_20250101120000_Americana-Manual_v2.pdf", "Americana Manual v2"), ("safety/docs/20250101120000_lockout.pptx", "lockout"), ("documents/_.pdf", "documents/_.pdf")],
)
def test_guess_title(spark, key, want):
    assert value(spark, T.guess_title(F.lit(key))) == want


@pytest.mark.parametrize("name, upload, relinked", [("a.PDF", "pdf", "pdf"), ("readme", "readme", "bin"), ("x.png", "png", "bin"), ("x.", "pdf", "bin")])
def test_file_types(spark, name, upload, relinked):
    assert value(spark, T.upload_type(F.lit(name))) == upload
    assert value(spark, T.relinked_type(F.lit(name))) == relinked


@pytest.mark.parametrize("json, want", [('{"test":"a"}', 0), ("nope", 0), ("[]", 0), (None, 0), ('[{"test":"a","result":"Pass"}]', 1)])
def test_parse_steps(spark, json, want):
    assert value(spark, F.size(jobs.parse_steps(F.lit(json).cast("string")))) == want


def test_screen_steps_accept_other_keys(spark):
    got = value(spark, jobs.screen_steps(F.lit('[{"step":"fuse","outcome":"ok","note":"n"},{}]')))
    assert [tuple(x) for x in got] == [("fuse", "ok", "n"), ("(unnamed step)", "—", "")]


def test_blank_pages_keep_their_numbers(spark):
    docs = spark.createDataFrame([(1, ["a", " \n", "c"])], "document_id long, pages array<string>")
    assert [(r.page, r.text) for r in chunks.page_source(docs).collect()] == [(1, "a"), (3, "c")]


def test_search(spark):
    match = lambda needle: value(spark, T.search_matches(F.lit(needle), F.lit("Norcold Manual"), F.lit(None).cast("string")))
    assert match(" ") and match("manual NOR") and not match("manual dometic")
