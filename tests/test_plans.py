"""Plan checks: the physical plans we rely on at scale."""
import __spark_entry__ as E
from pyspark.sql import functions as F

from helpline.operators.calls import format_items
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    q = E.queries()
    for name in ["vector_join", "approx_search", "lexical_join", "fuzzy_entity_match", "client_docs", "call_sessions",
                 "validate_client_company", "reply_pairs", "protocol_match"]:
        p = _plan(q[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_topk_uses_window_group_limit(spark):
    df = E.queries()["vector_join"](spark, SF)
    assert "WindowGroupLimit" in _plan(df)  # partial top-k before the shuffle by query


def test_transcript_formatting_stays_in_jvm(spark):
    items = spark.createDataFrame([([("1", "message", "user", ["hi"], False)],)],
                                  "items array<struct<id:string,type:string,role:string,content:array<string>,interrupted:boolean>>")
    p = _plan(items.select(format_items(F.col("items")).alias("t")))
    assert "Python" not in p and "ArrowEval" not in p and "Exchange" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = E.queries()["client_docs"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in p or "ReadSchema: struct<c_custkey" in p
    lang = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("lang") == "en").select("doc_id")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in _plan(lang)


def test_approx_search_broadcasts_only_bucket_sizes(spark):
    p = _plan(E.queries()["approx_search"](spark, SF))
    assert "FlatMapCoGroupsInPandas" in p and "WindowGroupLimit" in p
    # the broadcast sides are per-bucket counts (bounded by bands x 2^bits), never vectors
    assert p.count("BroadcastExchange") >= 1


def test_spread_leaves_fine_scans_alone(spark):
    from helpline.functions.columns import spread
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey")
    n = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        assert "Exchange hashpartitioning(l_orderkey" in _plan(spread(df, "l_orderkey"))
    many = df.repartition(n * 5)  # far finer than the cluster: left as is, nothing counted
    assert spread(many, "l_orderkey") is many
