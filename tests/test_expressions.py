"""Column expressions on hand-written edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakscope.functions import creative as C
from leakscope.functions import labels
from leakscope.functions import names as N
from leakscope.functions import ratios, text


def values(spark, expression, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def check(spark, expression, cases, kind="string"):
    got = values(spark, expression, [c for c, _ in cases], kind)
    assert got == [e for _, e in cases]


def test_strip_and_fold(spark):
    check(spark, text.strip, [(" a\t", "a"), (" x　", "x"), ("\x1f", ""), (None, None)])
    check(spark, text.fold, [(" ÄB ", "äb")])


def test_blank_texts(spark):
    check(spark, text.is_blank, [
        (None, True), ("", True), (" N/A ", True), ("0", True), ("#n/a", True), ("00", False)])


def test_fixed_numbers(spark):
    check(spark, lambda c: text.fixed(c, 2), [
        (0.0, "0.00"), (1.005, "1.00"), (12.345, "12.35"), (0.999, "1.00"), (1234.5, "1234.50")],
        "double")
    check(spark, lambda c: text.percent(c, 3), [(0.00031, "0.031%")], "double")
    check(spark, text.grouped, [(1234567, "1,234,567"), (5, "5")], "bigint")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=6), min_size=1, max_size=20))
def test_strip_like_python(spark, inputs):
    # Surrogates and NUL do not survive the transport into the session.
    inputs = [s.encode("utf-8", "ignore").decode().replace("\0", "") for s in inputs]
    assert values(spark, text.strip, inputs) == [s.strip() for s in inputs]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 4, 2.0), (1, 0, 2.0)], "clicks long, impressions long, spend double")
    row = df.select(ratios.ctr(), ratios.cpm(), ratios.ratio("clicks", "impressions", None)).collect()
    assert [tuple(r) for r in row] == [(0.25, 500.0, 0.25), (0.0, 0.0, None)]


def test_app_junk(spark):
    check(spark, N.app_junk_category, [
        ("com.foo.bar", "Unresolved bundle"), ("1234567", "Unresolved bundle"), ("12345", None),
        ("Block Puzzle Deluxe", "Gaming app"), ("Slot", "Gaming app"), ("My.io", "Gaming app"),
        ("QR Scanner", "Junk app"), ("Flashlights", None), ("flashlight", "Junk app"),
        ("Weather", None), ("", None), (None, None)])


def test_placement_category(spark):
    check(spark, lambda c: N.placement_category(c)["category"], [
        ("", "Blank / Missing Name"), (None, "Blank / Missing Name"),
        ("YouCam Makeup", "Photo/Beauty Editor App"), ("Woodoku", "Rewarded / Casual Game"),
        ("Phone Cleaner", "Utility-Junk App"), ("(not set)", "Opaque / Unknown Inventory"),
        ("in-app", "Opaque / Unknown Inventory"), ("com.abc.def", "Unresolved App Bundle"),
        ("ABC Kids", "Kids / Coloring App"),
        ("Fox News Live", "Recognizable Publisher (audience-fit check)"),
        ("example.org", "Unclassified")])


def test_streaming_platform(spark):
    check(spark, N.is_streaming_platform, [
        ("Pluto TV - Roku", True), ("WATCH FREE+", True), ("cooking", False), (None, False)])


def test_blank_reason(spark):
    check(spark, N.blank_reason, [
        (None, "empty"), ("  ", "empty"), ("N/A", "placeholder"), ("ab", "placeholder"),
        ("Copy of Summer", "placeholder"), ("Copy of a very long creative name", None),
        ("creative 12", "placeholder"), ("creatively yours", None), ("Summer 300x250", None)])


def test_split_name_id(spark):
    check(spark, lambda c: F.concat_ws("|", N.split_name_id(c)["name"], N.split_name_id(c)["id"]), [
        ("QR: Home - Android (qr.reader)", "QR: Home - Android|qr.reader"),
        (" Game (123456) ", "Game|123456"), ("Game (Pro)", "Game (Pro)|Game (Pro)"),
        ("(com.x.y)", "com.x.y|com.x.y"), ("plain", "plain|plain")])


def test_looks_like_app(spark):
    check(spark, N.looks_like_app, [
        ("id123456789", True), ("Solitaire", True), ("com.foo.bar", True), ("foo.com", False),
        ("news.bbc.co.uk", False), ("a.b.unknown", True), ("", True), ("none", True)])


def test_family_and_developer(spark):
    check(spark, N.family_name, [("Contacts - Android ", "contacts"), ("Notes-iOS", "notes")])
    check(spark, N.developer_prefix, [
        ("com.easycalls.icontacts", "com.easycalls"), ("com.two", None), ("B00ABC", None)])


def test_category_flag(spark):
    check(spark, N.category_flag, [
        ("MFA + High CTR", "Quality + High CTR"), ("Low CTR / no conv", "Low CTR"),
        ("A + B", "Quality"), ("", "Quality"), (None, "Quality")])


def test_known_products(spark):
    df = spark.createDataFrame([("Video",), ("CTV",), ("Video",), ("leaked",), (None,)], "p string")
    assert df.agg(N.known_products(F.col("p"))).first()[0] == "CTV, Video"


def test_sizes(spark):
    check(spark, lambda c: F.array_join(C.sizes_in(c), ","), [
        ("A 300x250 b 728 X 90", "300x250,728x90"), ("v1.5x20", ""), ("12345x200", ""),
        ("1080×1920", "1080x1920"), ("300x2500.5", ""), (None, "")])
    check(spark, C.first_size, [("x 320x50 300x250", "320x50"), ("none", None), (None, None)])
    check(spark, C.size_family, [
        ("300x250", "IAB display"), ("1080x1080", "social native"), ("1920x800", "landscape/video"),
        ("400x900", "vertical/story"), ("500x500", "square-ish"), ("(not specified)", "unknown")])


def test_url_tags(spark):
    keys = ["utm_source", "utm_source_platform", "cid", "vmcid"]
    check(spark, lambda c: C.keys_present(c, keys), [
        ("https://a/?UTM_Source=x", "utm_source"),
        ("https://a/?utm_source_platform=x", "utm_source_platform"),
        ("https://a/?vmcid=1", "cid, vmcid"), (None, "")])
    check(spark, C.utm_status, [
        ("", "no clickthrough URL"), ("https://a", "no UTM codes"),
        ("https://a/?utm_source=1", "partially tagged"),
        ("a?utm_source=1&utm_medium=2&utm_campaign=3", "fully tagged")])


def test_site_domain(spark):
    check(spark, C.site_domain, [
        ("https://www.TMZ.com/foo", "tmz.com"), ("tmz.com.", "tmz.com"),
        ("http://a.com?x=1", "a.com"), (" WWW.b.org/x?y ", "b.org")])


@pytest.mark.parametrize("label,expected", [
    (labels.report_name, ["07/16/26 – 07/22/26", "07/23/26", "latest", "x – 07/22/26"]),
    (labels.range_label, ["07.16.26-07.22.26", "07.23.26", "latest", "x-07.22.26"]),
])
def test_labels(spark, label, expected):
    inputs = ["2026-07-16_to_2026-07-22", "2026-07-23", "latest", "x_to_2026-07-22"]
    assert values(spark, label, inputs) == expected
