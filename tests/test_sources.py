"""Readers, pooling, file selection, dimensions and sinks."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from leakscope.lineage import fresh_path
from leakscope.operators.creative_alert import creative_alert_rows
from leakscope.plans import facts
from leakscope.sinks import tables as T
from leakscope.sources import dimensions as D
from leakscope.sources import exports as X
from leakscope.sources import files as M
from leakscope.sources.creatives import normalize_creative
from leakscope.sources.headers import CREATIVE_HEADERS, canonical_columns, find_by_tokens
from leakscope.sources.pooling import pool_exports
from leakscope.streaming import incremental as I


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def jobs_of(spark, run):
    group = fresh_path(spark, "jobs")
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Campaign Pool ID` int, `CAMPAIGN id` int, "
                                               "campaign_id int, Margin int")
    out = canonical_columns(df, X.DELIVERY_HEADERS, X.DELIVERY_COLUMNS)
    assert out.columns == ["Campaign ID"] and out.first()[0] == 2
    assert find_by_tokens(df.columns, ("campaign", "id"), exclude=("pool",)) == "CAMPAIGN id"
    unknown = spark.createDataFrame([(1,)], "zzz int")
    assert canonical_columns(unknown, X.DELIVERY_HEADERS, X.DELIVERY_COLUMNS).columns == ["zzz"]
    assert CREATIVE_HEADERS["video_completions_75"] == "75% Completed"


def test_exports_with_different_layouts(spark):
    one, two = fresh_path(spark, "one"), fresh_path(spark, "two")
    spark.createDataFrame([("2026-01-02", "a.com", "5", "x")],
                          "date string, site_domain string, impressions string, ctr string"
                          ).write.option("header", True).csv(one)
    spark.createDataFrame([("7.0", "1/3/2026", "1.2345")],
                          "Impressions string, DATE string, `Billable Spend` string"
                          ).write.option("header", True).csv(two)
    df = X.read_delivery_export(spark, [one, two])
    got = {tuple(r) for r in df.select("Date", "Impressions", "Site Domain").collect()}
    assert got == {(dt.date(2026, 1, 2), 5, "a.com"), (dt.date(2026, 1, 3), 7, None)}
    assert df.agg(F.sum("Billable Spend").cast("double")).first()[0] == 1.2345


def as_file(spark, name, lines):
    """A CSV file with exactly these lines in the folder `name`."""
    text = "\n".join(lines)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(name)


def test_files_of_one_folder_with_other_headers(spark):
    path = fresh_path(spark, "mixed [1] {a}*")
    as_file(spark, path, ["Client,Impressions,Clicks", "Acme,10,2"])
    as_file(spark, path, ["Clicks,Client,Impressions", "3,Beta,20"])
    as_file(spark, path, ["", "Client,Impressions,Clicks", "Cee,30,4"])
    as_file(spark, path, [""])
    got = X.read_delivery_export(spark, X._literal(path)).select("Client", "Impressions", "Clicks")
    assert rows(got) == [("Acme", 10, 2), ("Beta", 20, 3), ("Cee", 30, 4)]


def test_many_files_of_a_few_layouts(spark):
    path = fresh_path(spark, "daily")
    layouts = ["Client,Impressions,Clicks", "Clicks,Client,Impressions", "client,impressions"]
    bodies = ["a,{0},1", "1,a,{0}", "a,{0}"]
    files = [f"{layouts[i % 3]}\n{bodies[i % 3].format(i)}\n" for i in range(30)]
    spark.createDataFrame([(i, t) for i, t in enumerate(files)], "i int, value string").repartition(
        30, "i").write.partitionBy("i").text(path)
    paths = [f"{path}/i={i}" for i in range(30)]
    df, jobs = jobs_of(spark, lambda: X.read_delivery_export(spark, paths))
    assert jobs == 1  # that of the header lines
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert df.agg(F.sum("Impressions"), F.count("*")).first() == (sum(range(30)), 30)


def test_odd_header_lines(spark):
    path = fresh_path(spark, "odd")
    as_file(spark, path, ['\ufeff"Client","Impr""x",,Client,IMPRESSIONS', "a,1,2,b,7"])
    df = X.read_delivery_export(spark, path)
    assert df.columns == ["Impressions"] and df.first()[0] == 7
    assert X._names('"a ""b""",,x,X') == ['a "b"', "_c1", "x2", "X3"]


def test_exchange_sheets(spark):
    path = fresh_path(spark, "exchange")
    as_file(spark, path, ["Post Click Conversions,SSP Exchange,View Conversions,Clicks,Impressions",
                          "1,E1,2,3,1000", "x,E2,,4,n/a"])
    got = X.read_exchange_export(spark, path)
    assert rows(got.select("exchange", "product", "impressions", "clicks", "conversions")) == [
        ("E1", "(all)", 1000, 3, 3), ("E2", "(all)", 0, 4, 0)]
    with pytest.raises(ValueError):
        X.exchange_rows(spark.createDataFrame([(1,)], "Clicks int"))


def test_headers_are_checked_on_used_columns_only(spark):
    path = fresh_path(spark, "same")
    as_file(spark, path, ["Client,Margin,Impressions", "Acme,1,10"])
    as_file(spark, path, ["Client,Margin,Impressions", "Beta,2,20"])
    df = X.read_delivery_export(spark, path)
    assert df.count() == 2 and df.agg(F.sum("Impressions")).first()[0] == 30


def test_creative_names_with_line_breaks(spark):
    path = fresh_path(spark, "breaks")
    as_file(spark, path, ["Creative Name,Impressions", '"a', 'b",7', "c,1"])
    got = rows(X.read_creative_export(spark, path).select("Creative Name", "Impressions"))
    assert got == [("a\nb", 7), ("c", 1)]


def test_coercion(spark):
    df = spark.createDataFrame(
        [("12",), ("x",), ("nan",), (None,), ("3.0",), ("12.7",)], "v string")
    assert [r[0] for r in df.select(X.count_of(F.col("v"))).collect()] == [12, 0, 0, 0, 3, 13]
    ids = spark.createDataFrame([("1001801.0",), ("A1.0",), (None,)], "v string")
    assert [r[0] for r in ids.select(X.id_of(F.col("v"))).collect()] == ["1001801", "A1.0", ""]


def test_app_identity(spark):
    df = spark.createDataFrame(
        [("Foo (com.foo.bar)", "Foo (com.foo.bar)", "NA"), ("com.x.y", "Kept", "Kept")],
        "`App ID` string, `App Name` string, `Final App Name` string")
    assert rows(X.clean_app_identity(df).select(
        "App ID", "App Name", "Final App Name", "Raw Value")) == [
        ("com.foo.bar", "Foo", "Foo", "Foo (com.foo.bar)"), ("com.x.y", "Kept", "Kept", "com.x.y")]


def test_split_inventory(spark):
    df = spark.createDataFrame(
        [("a.com", ""), ("b.com", "In-App"), ("Game (com.g.x)", ""), ("c.com", ""),
         ("cdn.desktop.aol.com", "Website"), ("Bare", "web")],
        "`App/URL` string, `Site/App` string")
    sites, apps = X.split_combined_inventory(df, force_app=["C.com"])
    assert rows(sites.select("Site Domain")) == [("Bare",), ("a.com",)]
    assert rows(apps.select("App Name", "App ID")) == [
        ("Game", "com.g.x"), ("b.com", "b.com"), ("c.com", "c.com"),
        ("cdn.desktop.aol.com", "cdn.desktop.aol.com")]
    assert {r[0] for r in sites.select("DSP").collect()} == {"TTD/DV360"}


def test_date_range_and_latest(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, d),) for d in range(1, 9)] + [(None,)], "Date date")
    assert X.filter_date_range(df, "2026-01-02", "2026-01-03").count() == 2
    assert X.filter_date_range(df.withColumnRenamed("Date", "x"), "2026-01-02", "2026-01-03").count() == 9
    other = spark.createDataFrame([(dt.date(2026, 1, 10),)], "Date date")
    a, b = X.latest_days([df, other], 3)
    assert (a.count(), b.count()) == (1, 1)


def export(spark, items):
    return spark.createDataFrame(
        items, "`Creative Name` string, Client string, Impressions long, file_date date")


def test_pooling(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
    a = export(spark, [(None, "c", 1, d1), (" ", "c", 2, d1), ("n", "c", 3, d1)])
    b = export(spark, [("n", "c", 30, d2), (None, "d", 4, d2)])
    once = rows(pool_exports([a, b], ["file_date"]))
    assert once == rows(pool_exports([b, a, b], ["file_date"]))
    assert [r[2] for r in once if r[0] == "n"] == [30]
    assert sum(r[0] is None for r in once) == 2 and len(once) == 4


def test_restated_key_with_many_copies(spark):
    """A key that holds most rows is reduced before the shuffle."""
    hot = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("Client"),
        F.col("id").alias("file_date"), F.col("id").alias("Impressions"))
    out = pool_exports([hot], ["file_date"])
    assert out.filter("Client = 'hot'").first()["Impressions"] == 19999
    assert out.count() == 6668
    plan = out._jdf.queryExecution().executedPlan().toString()
    # one candidate per key leaves a map task, each column is carried once
    assert re.search(r"WindowGroupLimit[^\n]*Partial", plan) and "SortAggregate" not in plan


def test_files(spark):
    at = dt.datetime(2026, 3, 9)
    df = spark.createDataFrame(
        [("x/site_2026-03-01.csv", at), ("x/app_20260302.csv", at), ("x/ttddv-siteapp.csv", at),
         ("x/creativeinsights_20260399_0.csv", at), ("x/readme_20260301.csv", at),
         ("x/site_20260301.pdf", at)], "path string, modified timestamp")
    got = rows(M.export_files(df).select("kind", "file_date"))
    assert got == [
        ("apps", dt.date(2026, 3, 2)), ("creatives", dt.date(2026, 3, 9)),
        ("sites", dt.date(2026, 3, 1)), ("ttddv", dt.date(2026, 3, 9))]
    none = M.select_range_files(df, "2026-01-01", "2026-01-02")
    assert [r.reason for r in none.collect()] == ["no site and app files in the window"]
    some = M.select_range_files(df, "2026-03-02", "2026-03-01")
    assert {r.kind for r in some.collect()} == {"sites", "apps", "ttddv", "creatives"}


def test_list_files(spark, small):
    kinds = M.list_files(spark, small)
    assert kinds.columns == ["path", "modified"] and kinds.count() == 14


def test_all_files_of_a_window(spark):
    at = dt.datetime(2026, 3, 9)
    names = [(f"x/{kind}_202603{d:02}_{i}.csv", at) for kind in ("site", "app")
             for d in range(1, 21) for i in range(3)]
    df = spark.createDataFrame(names, "path string, modified timestamp")
    assert M.select_range_files(df, "2026-03-01", "2026-03-20").count() == 120


@pytest.mark.parametrize("text,expected", [
    ("2026-05-01", dt.date(2026, 5, 1)), ("2026-1-5", dt.date(2026, 1, 5)),
    ("5/1/2026 0:00", dt.date(2026, 5, 1)), ("5/1/2026", dt.date(2026, 5, 1)),
    ("5/1/26", dt.date(2026, 5, 1)), ("2026-05-01 10:20:30", dt.date(2026, 5, 1)),
    ("2026-05-01T10:20:30", dt.date(2026, 5, 1)), ("2026-05-01junk", None), ("2026", None),
    ("", None), (None, None)])
def test_export_dates_are_read_whole(spark, text, expected):
    from leakscope.sources.exports import date_of

    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(date_of(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("text,expected", [
    ("Date(2026,3,29)", dt.date(2026, 4, 29)), ("Date(2026,12,1)", None),
    ("3/9/2026", dt.date(2026, 3, 9)), ("2026-03-09", dt.date(2026, 3, 9)),
    ("3/9/26", dt.date(2026, 3, 9)), ("soon", None), (None, None)])
def test_block_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(D.block_date(F.col("v"))).first()[0] == expected


def test_blocklist(spark):
    def tab(items):
        return spark.createDataFrame(items, "a string, b string, c string, d string, e string")

    dim = D.blocklist_dim(D.blocklist_rows({
        "CTV": tab([("Name", "Domain or App", "Type", "", "Date added"),
                    ("x", "A.com ", "", "", "2026-01-05"), ("x", "a.com", "", "", "2026-01-02")]),
        "Social Mirror": tab([("Domain or App", "Bundle", "", "", "Date added")]),
        "Excluded": tab([("Name", "Site", "Type", "x", "Added")]),
        "Audio": tab([("first", "kept.com", "", "", ""), ("x", "", "", "", "")]),
    }))
    assert rows(dim.select("match_key", "tab", "date_added")) == [
        ("a.com", "CTV", dt.date(2026, 1, 2)), ("kept.com", "Audio", None)]
    keys = {r.match_key: r for r in D.blocklist_by_key(dim).collect()}
    assert keys["kept.com"].since_audio == dt.date(1970, 1, 1)
    assert keys["kept.com"].date_added is None and keys["a.com"].lists == "CTV"


def test_compaction_keeps_the_newest_rows(spark):
    source, store, target, state = (
        fresh_path(spark, n) for n in ("arrivals", "store", "compacted", "state"))
    first = spark.sql("SELECT DATE'2026-01-01' served_date, 'a' client, 1 version, 5 impressions")
    again = spark.sql("SELECT DATE'2026-01-01' served_date, 'a' client, 2 version, 7 impressions "
                      "UNION ALL SELECT DATE'2026-01-02', NULL, 1, 3")
    keys, version, schema = ["served_date", "client"], ["version"], first.schema
    for batch in (first, again, again):
        batch.write.mode("append").parquet(source)
        I.incremental_pool(spark, schema, source, store, state, keys, version)
    I.compact_store(spark, store, target, schema, keys)
    columns = ["served_date", "client", "version", "impressions"]
    raw = spark.read.parquet(target)
    assert rows(raw.select(columns)) == rows(I.pooled_rows(spark, store, schema).select(columns))
    assert raw.count() == 2 and raw.where("client = 'a'").first().impressions == 7
    again.write.mode("append").parquet(source)
    I.incremental_pool(spark, schema, source, target, state, keys, version)
    assert rows(I.pooled_rows(spark, target, schema).select(columns)) == rows(raw.select(columns))


def day_rows(spark, *items):
    return spark.createDataFrame(
        [(d and dt.date(2026, 1, d), c, v, n) for d, c, v, n in items],
        "served_date date, client string, version int, impressions int")


def test_upserts_touch_only_the_days_of_a_batch(spark):
    store, keys, version = fresh_path(spark, "store"), ["served_date", "client"], ["version"]
    batches = [
        day_rows(spark, (1, "a", 2, 5), (2, "a", 1, 6), (None, "a", 1, 1)),
        day_rows(spark, (1, "a", 1, 99), (1, "b", 1, 7)),  # late: an older version of a row
        day_rows(spark, (30, "a", 1, 8), (None, "a", 3, 2)),
        day_rows(spark, (1, "b", 4, 70)),
    ]
    schema = batches[0].schema
    want = {(None, "a"): 2, (1, "a"): 5, (2, "a"): 6, (1, "b"): 70, (30, "a"): 8}

    def current():
        got = I.pooled_rows(spark, store, schema).collect()
        assert len({(r.served_date, r.client) for r in got}) == len(got)
        return {(r.served_date and r.served_date.day, r.client): r.impressions for r in got}

    for n, batch in enumerate(batches):
        I.upsert_days(batch, store, n, keys, version)
        if n in (1, 3):
            I.upsert_days(batch, store, n, keys, version)  # replayed after a failure
    assert current() == want
    files = spark.read.parquet(store).groupBy("served_date", "batch_id").count().collect()
    assert {(r.served_date.day, r.batch_id) for r in files if r.served_date} == {
        (1, 0), (1, 1), (1, 3), (2, 0), (30, 2)}
    # rows of a batch that failed before its days were listed are not read
    I._write_days(day_rows(spark, (2, "a", 9, 1)), store, 4, keys, "served_date", 1)
    assert current() == want
    stale = {tuple(r) for r in I.stale_generations(spark, store, schema).collect()}
    assert stale == {(dt.date(2026, 1, 1), 0), (None, 0)}
    assert I.prune_store(spark, store, schema) == 2
    I.upsert_days(batches[3], store, 3, keys, version)  # the last batch can still be replayed
    assert current() == want
    with pytest.raises(ValueError):
        I.upsert_days(batches[0], store, 5, ["client"], version)


def test_pooled_dates_prune_partitions(spark):
    store = fresh_path(spark, "store")
    batch = day_rows(spark, *[(d, "a", 1, d) for d in range(1, 9)])
    I.upsert_days(batch, store, 0, ["served_date", "client"], ["version"])
    kept = I.pooled_rows(spark, store, batch.schema).filter("served_date = DATE'2026-01-03'")
    assert [r.impressions for r in kept.collect()] == [3]
    scan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "2026-01-03" in scan
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = kept.selectExpr("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\n]*served_date#\d+ = 2026-01-03", plan)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_alert_of_any_split_is_that_of_the_feed(spark, small, parts):
    feed = facts.creative(spark, small).filter("campaign_id < 40")
    root = fresh_path(spark, "alerts")
    for i in range(parts):
        part = feed.filter(F.pmod(F.hash("date", "impressions", "campaign_id"), F.lit(parts)) == i)
        I.add_sums(part, f"{root}/state", i)
        if i % 2 == 0:
            I.add_sums(part, f"{root}/state", i)  # replayed
        I.judge(spark, f"{root}/state", f"{root}/out", i)
    whole = rows(creative_alert_rows(feed))
    assert len(whole) > 5 and rows(I.latest_alert(spark, f"{root}/out")) == whole
    assert spark.read.parquet(f"{root}/out/summary").count() == parts
    I.compact_sums(spark, f"{root}/state", f"{root}/folded")
    I.judge(spark, f"{root}/folded", f"{root}/again", 9)
    assert rows(I.latest_alert(spark, f"{root}/again")) == whole


def test_clean_delivery_has_no_alert(spark):
    root = fresh_path(spark, "alerts")
    clean = spark.createDataFrame(
        [(dt.date(2026, 1, 1), "B", "C", "Display", "P", "1", "7", "Summer sale", 1000, 3, 1.0, 0)],
        "date date, business_unit string, client string, product string, campaign string, "
        "campaign_id string, creative_id string, creative string, impressions long, clicks long, "
        "spend double, conversions long")
    blank = clean.withColumn("creative", F.lit(" "))
    for i, batch in enumerate((blank, clean)):
        I.add_sums(batch, f"{root}/state{i}", i)
        I.judge(spark, f"{root}/state{i}", f"{root}/out{i}", i)
    assert I.latest_alert(spark, f"{root}/out0").count() > 0
    assert I.latest_alert(spark, f"{root}/out1").count() == 0


def test_sinks_evaluate_a_table_once(spark):
    root = fresh_path(spark, "sinks")
    _, jobs = jobs_of(spark, lambda: T.write_tables(
        {"a": spark.range(9), "b": spark.range(0)}, root))
    assert jobs == 4  # each table once, and the copy of what was written
    assert spark.read.option("header", True).csv(f"{root}/csv/a").count() == 9
    names, jobs = jobs_of(spark, lambda: T.creative_findings_export(
        {"some": spark.range(3), "none": spark.range(0)}, {"more": spark.range(1)}, f"{root}/f"))
    assert names == ["some", "more"] and jobs == 5
    assert spark.read.option("header", True).csv(f"{root}/f/some").count() == 3


def test_last_buyer_of_the_file_wins(spark):
    path = fresh_path(spark, "buyers")
    as_file(spark, path, ["Partner,Buyer", "Acme,Zoe", "Acme,Bob", "Beta,Cy"])
    assert dict(rows(D.read_buyers(spark, path))) == {"Acme": "Bob", "Beta": "Cy"}


def test_buyers(spark):
    df = spark.createDataFrame(
        [(1, "Acme", "Ann"), (2, "Acme", "Bob"), (3, " ", "Cy"), (4, "acme ", "Dee")],
        "id int, `Partner Name` string, Trader string")
    dim = D.buyer_dim(df.select("Partner Name", "Trader", "id"), F.col("id"))
    assert dict(rows(dim)) == {"Acme": "Bob", "acme": "Dee"}
    asked = spark.createDataFrame([("Acme",), (" ACME",), ("other",), (None,)], "business_unit string")
    got = {r.business_unit: r.buyer for r in D.with_buyer(asked, dim).collect()}
    assert got["Acme"] == "Bob" and got["other"] == "" and got[None] == ""
    positional = D.buyer_dim(spark.createDataFrame([("x", "P", "B")], "a string, b string, c string"))
    assert rows(positional) == [("P", "B")]


def test_normalized_rows(spark):
    df = spark.createDataFrame(
        [("NA", "Blocked ", "com.a.b", "7", "3", "2", "1.5"), ("App", None, "x", "1", None, "1", "")],
        "`App Name` string, `Final App Name` string, `App ID` string, Impressions string, "
        "`Post Click Conversions` string, `Post View Conversions` string, Spend string")
    got = X.normalize_delivery(df, "app").select(
        "display", "is_block", "is_unresolved", "impressions", "clicks", "conversions", "client")
    assert rows(got) == [
        ("App", False, True, 1, 0, 1, "(not in export)"),
        ("com.a.b", True, False, 7, 0, 5, "(not in export)")]
    with pytest.raises(ValueError):
        X.normalize_delivery(spark.createDataFrame([(1,)], "x int"), "app")


def test_normalized_creatives(spark):
    df = spark.createDataFrame([(" ", "5", "2026-01-01")], "creative_name string, impressions string, Date string")
    out = normalize_creative(df)
    assert "preview_url" not in out.columns and out.first()["creative"] == " "
    assert out.first()["conversions"] == 0 and out.first()["impressions"] == 5
    with pytest.raises(ValueError):
        normalize_creative(spark.createDataFrame([(1,)], "x int"))


def test_total_rows(spark):
    df = spark.createDataFrame([(" total ", "5"), (None, "x"), ("A", "7")], "Unit string, Clicks string")
    assert rows(X.drop_total_row(df)) == [("A", 7.0), (None, 0.0)]


def test_report_windows(spark):
    path = fresh_path(spark, "windows")
    for window, n in (("a", 1), ("b", 2), ("a", 3)):
        T.write_report_window(spark.range(n), path, window)
    got = spark.read.parquet(path).groupBy("window_id").count()
    assert dict(rows(got)) == {"a": 3, "b": 2}


def test_serving_block_columns(spark):
    df = spark.createDataFrame([("u", "1970-01-01", "2026-01-01", ["x"])],
                               "buyer string, date_added string, last_served string, sites_list array<string>")
    assert rows(T.serving_block_columns(df)) == [("—", "2026-01-01")]
