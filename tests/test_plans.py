"""Plans that large inputs depend on."""

from pyspark.sql import functions as F

from leadflow.operators import audit, candidates, matching
from leadflow.operators.coverage import coverage_by_company
from leadflow.sources import markup


def plan(df):
    return df._jdf.queryExecution().toString()


def leads(spark):
    return spark.range(100).select(F.col("id").alias("lead_seq"), (F.col("id") % 3).cast("string").alias("source_id"), (F.col("id") % 7).cast("int").alias("attention_score"), F.lit(True).alias("reaches_cap"),
                                   F.lit("Acme title").alias("title"), F.lit("text").alias("text"))


def test_article_cap_limits_rows_before_the_shuffle(spark):
    text = plan(audit.apply_article_cap(leads(spark), "reaches_cap", 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_edition_head_is_a_top_k(spark):
    df = leads(spark).withColumn("eligible", F.lit(True)).withColumn("change", F.lit("new")).withColumn("event_type", F.lit("x")).withColumn("tickers", F.array(F.lit("1 JP")))
    assert "TakeOrderedAndProject" in plan(candidates.select_edition(df, 5))


def test_name_matching_has_no_nested_loop(spark):
    watch = spark.createDataFrame([("1 JP", "Acme", ["東京電力", "(X) Co"])], "ticker string, name string, aliases array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        text = plan(matching.match_terms(leads(spark), watch))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_sources_open_to_all_are_not_paired(spark):
    watch = spark.createDataFrame([("1 JP",)], "ticker string")
    reports = spark.createDataFrame([("a", "ok", [], None, "", False, None)], "id string, status string, tickers array<string>, scope_tickers array<string>, scope_market string, issuer_official boolean, successful_tickers array<string>")
    text = plan(coverage_by_company(watch, reports))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_list_travels_in_coverage(spark):
    watch = spark.createDataFrame([("1 JP",)], "ticker string")
    reports = spark.createDataFrame([("a", "ok", ["1 JP"], None, "", True, ["1 JP"]), ("b", "ok", [], None, "JP", False, ["1 JP"])], "id string, status string, tickers array<string>, scope_tickers array<string>, scope_market string, issuer_official boolean, successful_tickers array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", before):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        executed = coverage_by_company(watch, reports)._jdf.queryExecution().executedPlan().initialPlan()
        todo, exchanges = [executed], 0
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                exchanges += 1
                kinds = [node.output().apply(k).dataType().typeName() for k in range(node.output().size())]
                assert "array" not in kinds, node.nodeName()
            todo += [node.children().apply(k) for k in range(node.children().size())]
        assert exchanges


def test_only_needed_columns_are_read(spark):
    from leadflow.functions import urls

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "ReadSchema: struct<url:string>" in plan(pages.select(urls.canonical_url("url")))


def test_no_query_reshuffles_its_tables_by_size():
    """Round-robin exchanges come from repartition(n) only; none is in the library."""
    import pathlib

    for path in pathlib.Path("leadflow").rglob("*.py"):
        assert ".repartition(spark" not in path.read_text() and "defaultParallelism" not in path.read_text(), path


def test_texts_do_not_travel_to_the_names(spark):
    from leadflow.plans import signals

    text = plan(signals.scored_leads(spark, "/root/testdata/sf0.001").select("lead_seq", "attention_score"))
    assert "RoundRobin" not in text


def test_a_listing_is_parsed_and_read_once(spark):
    captures = spark.range(3).select(F.col("id").cast("string").alias("source_id"), F.lit("https://www.example.com/list").alias("url"), F.lit("20240115").alias("day"),
                                     F.concat(F.lit("<table><tr><td>"), F.col("id").cast("string"), F.lit("</td></tr></table>")).alias("body"))
    for layout in markup.LAYOUTS.values():
        for part in markup.explode_listing(captures, layout):
            text = part._jdf.queryExecution().executedPlan().toString()
            assert text.count("_index_batch(") == 1 and "Filter" not in text.split("ArrowEvalPython")[0]
