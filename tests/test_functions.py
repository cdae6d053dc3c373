"""Literal expectations of the expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelake.functions import dates, document, metrics, text, vectors
from quirelake.operators.normalize import KV


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def of(spark, f, *args):
    row = spark.createDataFrame([args], ", ".join(f"a{i} {'string' if isinstance(a, str) or a is None else 'int'}" for i, a in enumerate(args)))
    return row.select(f(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).head().v


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0965-08-31/0966-09-17", ("0965-08-31", "0966-09-17")),
        ("950/1300", ("950-01-01", "1300-12-31")),
        ("ca. 1050 - 1100", ("1050-01-01", "1100-12-31")),
        ("1050–1100", ("1050-01-01", "1100-12-31")),
        ("1050-1100", ("1050-01-01", "1050-12-31")),
        ("969-03-17", ("969-01-01", "969-12-31")),
        (" 1131-05-02 ", ("1131-05-02", "1131-05-02")),
        ("11th century", (None, None)),
        ("Unknown", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_dates(spark, raw, want):
    assert tuple(of(spark, dates.parse_date, raw)) == want


def test_years_and_periods(spark):
    assert of(spark, dates.century, "1050-01-01") == "11th century" and of(spark, dates.century, "969-01-01") is None and of(spark, dates.century, "1100-01-01") == "11th century"
    assert of(spark, dates.extract_year, "1050-01-01") == 1050 and of(spark, dates.extract_year, "969-01-01") is None and of(spark, dates.extract_year, "year 2024") is None
    assert of(spark, dates.strip_zeros, "0932-01-01") == "932-01-01" and of(spark, dates.strip_zeros_range, "0932-09-03/0933-09-22") == "932-09-03/933-09-22"
    assert of(spark, dates.strip_zeros, "0000-01-01") == "0-01-01"
    assert [of(spark, dates.period_class, x) for x in ("11th century", "110th", "14th century", "17th", "9th")] == ["early_medieval", "early_medieval", "late_medieval", "early_modern", "unknown"]
    assert of(spark, dates.donation_year, "given 1897 by") == 1897
    assert tuple(of(spark, dates.graph_period, "1050/1100")) == (1050, 1100, "11th") and of(spark, dates.graph_period, "x/1") is None


def test_pages(spark):
    assert [of(spark, text.roman_to_int, x) for x in ("iv", "XII", "abc", "MCMXC", "")] == [4, 12, None, 1990, None]
    assert [tuple(of(spark, text.page_number, x)) for x in ("58", "iv", "plate 2", None)] == [(58, None), (4, None), (0, "plate 2"), (0, None)]
    assert of(spark, text.page_doc_id, "x", 58) == "x_p058" and of(spark, text.page_doc_id, "x", 1234) == "x_p1234" and of(spark, text.page_doc_id, "x", 0, "plate 2") == "x_pplate_2"
    assert of(spark, text.file_page_number, "Page-012.png") == 12 and of(spark, text.file_page_number, "cover") is None
    assert of(spark, text.fenced_json, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}' and of(spark, text.fenced_json, " {} ") == "{}"


def test_text(spark):
    assert of(spark, text.direction, "a שלום") == "rtl" and of(spark, text.direction, "a") == "ltr"
    assert of(spark, text.ascii_fold, "Éñ שָׁ") == "En שָׁ"
    assert of(spark, text.hebrew_normalise, "שָׁלוֹם, x") == "שלום"
    assert of(spark, text.clean_popup, 'a\x01 \t "b"\r\n') == "a &quot;b&quot;"
    assert of(spark, lambda c: text.truncate(c, 3), "abcd") == "abc..."
    assert value(spark, text.widest_image(F.array(F.lit("i/200,/0"), F.lit("i/1200,/0"), F.lit("i/x")))) == "i/1200,/0"


@pytest.mark.parametrize(
    "mark, want",
    [
        ("MS-TS-AS-00033-00006", ("Cambridge University Library", "Taylor-Schechter", "Additional Series")),
        ("Manchester: A 639", ("John Rylands Library, University of Manchester", "Gaster", "Series A")),
        ("T-S 8J5.1", ("Cambridge University Library", "Taylor-Schechter", None)),
        ("ENA NS 1", ("Jewish Theological Seminary", "Elkan Nathan Adler", "New Series")),
        ("Paris VI.120", ("Alliance Israélite Universelle, Paris", "Fonds", "Series VI")),
        ("unknown 7", (None, None, None)),
    ],
)
def test_shelf_marks(spark, mark, want):
    assert tuple(of(spark, lambda c: document.shelf_mark_mapping(c, paris_collection="Fonds"), mark)) == want


def kv(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs]).cast(KV)


def test_document_fields(spark):
    assert tuple(of(spark, document.physical_info_json, '{"material":"Paper","dimensions":"133.00 × 107.00 mm","rows":12}')) == ("Paper", 133.0, 107.0, "12 lines")
    assert tuple(of(spark, document.physical_info_json, "no json")) == (None, None, None, None)
    p = value(spark, document.physical_info(kv(("support", "Paper"), ("height", "12.5 cm"), ("x-height", "bad"), ("Support2", "Vellum"), ("width", "7"))))
    assert tuple(p) == ("Vellum", None, None, 12.5, 7.0)
    assert of(spark, document.person_name, "Schechter, S. (Solomon), 1847-1915") == "Schechter, S."
    assert of(spark, document.document_type, "Marriage contract from the old town") == "ketubah" and of(spark, document.document_type, "nothing") is None
    assert of(spark, document.document_type, "letter", "given") == "given"
    t = value(spark, document.temporal_info(kv(("standard_date", "950/1300")), kv(("origDate", "1131-05-02"))))
    assert (t.date_start, t.date_end, t.date_display, t.date_certainty, t.century) == ("1131-05-02", "1131-05-02", "950/1300", "high", "12th century")
    info = value(spark, document.language_info(F.lit("Hebrew"), kv(("textLang {'mainLang': 'heb', 'otherLangs': 'jrb, arc'}", "x"))))
    assert (info.main_language, info.other_languages, info.script_type) == ("heb", ["jrb", "arc"], "hebrew")
    i = value(spark, document.institutional_info(F.lit(None).cast("string"), kv(("repository", "R")), F.lit("http://cambridge.x"), F.lit("Oxford 1")))
    assert tuple(i) == ("Oxford University", "Bodleian Library")
    assert of(spark, document.coordinate, "30°03′ ″N") == 30.03
    assert [of(spark, document.quality_bucket, x) for x in (1, 0)] == ["high", "minimal"]


def test_metrics(spark):
    assert metrics.error_rate("", "x") == 1.0 and metrics.error_rate("", "") == 0.0 and metrics.error_rate("abcd", "abxd") == 0.25
    assert of(spark, metrics.levenshtein_cer, "sitting", "kitten") == pytest.approx(3 / 7)
    assert of(spark, metrics.similarity, "abcd", "abcd") == 1.0 and of(spark, metrics.wer, "a b c", "a x c") == pytest.approx(1 / 3)
    assert metrics.rouge_scores("a b c", "a b d") == pytest.approx((2 / 3, 1 / 2, 2 / 3))
    c = lambda *a: value(spark, metrics.consensus(*[F.lit(x).cast("string") if i != 1 else F.lit(x).cast("double") for i, x in enumerate(a)], F.lit(False)))
    assert [c("o", 0.9, "p", "f", "o").strategy, c("o", 0.5, "p", "f", "o").strategy, c(None, None, "p", None, "p").strategy, c(None, None, None, "f", "f").strategy, c("o", 0.5, None, None, "o").strategy, c(None, None, None, None, None).strategy] == [
        "ocr_primary", "llm_pro_preferred", "llm_pro_only", "llm_flash_only", "fallback_first", "failed"
    ]


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, vectors.cosine(a(1, 2), a(2, 1))) == pytest.approx(0.8) and value(spark, vectors.cosine(a(0, 0), a(2, 1))) == 0.0
    assert value(spark, vectors.l2_normalise(a(3, 4))) == pytest.approx([0.6, 0.8])
