"""Documents of large companies, and a folder of documents read back whole."""

import json
import os

import pytest
from pyspark.sql import functions as F

from helpline.functions import parts as P
from helpline.operators import kb
from helpline.plans import rebuild as R
from helpline.sinks import writers as K
from helpline.sources import files as S
from helpline.sources.files import load_index
from tests.conftest import SF


def tables(spark, n):
    """Company 1 has a third of all clients, with ids far apart."""
    companies = spark.createDataFrame([(i, f"E{i}", f"Company {i}") for i in (1, 2, 3)], "Id long, Codigo string, Nombre string")
    clients = spark.createDataFrame([(i * i * 10_000, f"C{i}", f"Client {i}") for i in range(n)], "Id long, CodigoCliente string, NombreCompleto string")
    pairs = spark.createDataFrame([(i * i * 10_000, 1 if i % 3 == 0 else 2 if i < 12 else 3) for i in range(n)], "ClienteId long, EmpresaId long")
    return clients, pairs, companies


def test_a_large_company_splits_and_small_ones_stay_whole(spark):
    t = tables(spark, 900)
    whole = {r["company_id"]: [c["client_id"] for c in r["clients"]] for r in kb.clients_by_company(*t).collect()}
    assert len(whole) == 3 and len(whole[1]) == 300
    got = {}
    for r in sorted(kb.clients_by_company(*t, part_bytes=4_000).collect(), key=lambda r: (r["company_id"], r["page_no"])):
        assert r["n_clients"] == len(r["clients"]) and sum(len(json.dumps(c.asDict())) for c in r["clients"]) < 6_000
        got.setdefault(r["company_id"], []).append([c["client_id"] for c in r["clients"]])
    assert {k: sum(v, []) for k, v in got.items()} == whole  # every member once, in order across the parts
    assert len(got[1]) >= 8 and len(got[2]) == 1
    ids = [r["doc_id"] for r in kb.client_docs_by_company(*t, part_bytes=4_000).collect()]
    assert len(ids) == len(set(ids)) == sum(map(len, got.values()))


def test_members_are_dealt_by_position_not_by_id(spark):
    rows = spark.createDataFrame([("a", 10**i, "x" * 10) for i in range(12)] + [("b", 5, "x" * 10)], "k string, n long, t string")
    got = P.deal_parts(rows, "k", "n", F.length("t"), limit=30).collect()
    assert sorted((r["k"], r["n"], r["page_no"]) for r in got) == sorted([("a", 10**i, i // 3) for i in range(12)] + [("b", 5, 0)])
    assert P.deal_parts(rows.limit(0), "k", "n", F.length("t")).count() == 0


def test_a_large_entity_is_spread_over_tasks(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("n"), F.lit("x" * 20).alias("t"))
    seen = []
    monkeypatch.setattr(P, "materialize", lambda df, name, f=P.materialize: seen.append((name, f(df, name))) or seen[-1][1])
    parts = P.deal_parts(rows, "k", "n", F.length("t"), limit=10_000)
    assert parts.groupBy("page_no").count().count() == 40
    members = dict(seen)["large-members"].groupBy("_task").count().collect()
    assert len(members) > 1 and max(r["count"] for r in members) < 20_000 * 0.6


DOC = "doc_id string, doc_kind string, entity_id long, page_no long, title string, body string"
BODIES = ["# A\n\ntwo\n", "form\ffeed\f", "\x1b escape \x1bf", "", "ends with -->", "a\\u003e b\\f <!-- x -->\n"]


def folder(spark, path, file_bytes=1 << 20):
    docs = spark.createDataFrame([(f"d{i} -->\f", "note" if i % 2 else "page", i, 0, f"t>{i}", b) for i, b in enumerate(BODIES * 2)], DOC)
    docs = docs.withColumn("doc_id", F.concat("doc_id", F.col("entity_id").cast("string"))).withColumn("content_hash", F.sha2("body", 256))
    K.write_documents(docs.where("doc_kind = 'note'"), f"{path}/json", file_bytes=file_bytes)
    K.write_markdown(docs.where("doc_kind = 'page'"), f"{path}/md", file_bytes=file_bytes)
    return docs


def test_every_document_comes_back_with_its_id(spark, tmp):
    docs = folder(spark, tmp)
    columns = [c for c in docs.columns]
    back = S.scan_documents(spark, tmp)
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, docs.collect()))
    assert {(r["doc_kind"], r["file_type"]) for r in back.collect()} == {("note", "application/json"), ("page", "text/markdown")}
    many = f"{tmp}/many"
    folder(spark, many, file_bytes=20)
    files = [f for d, _, fs in os.walk(many) for f in fs if f.startswith("part-")]
    assert len(files) > 4 and S.scan_documents(spark, many).count() == len(BODIES) * 2


def test_index_of_a_folder_equals_the_index_of_its_documents(spark, tmp):
    docs = folder(spark, f"{tmp}/kb").where("body <> ''")
    K.write_documents(docs.where("doc_kind = 'note'"), f"{tmp}/kb/json")
    K.write_markdown(docs.where("doc_kind = 'page'"), f"{tmp}/kb/md")
    R.index_folder(spark, f"{tmp}/kb", f"{tmp}/a", "v1")
    R.index_documents(spark, docs, f"{tmp}/b", "v1")
    rows = [sorted(map(str, load_index(spark, f"{tmp}/{x}")[0].select("node_id", "node_hash", "doc_hash", "text").collect())) for x in "ab"]
    assert rows[0] == rows[1] and rows[0]
    K.write_documents(docs, f"{tmp}/kb/json")
    with pytest.raises(ValueError, match="more than one file"):
        R.index_folder(spark, f"{tmp}/kb", f"{tmp}/a", "v2")


def test_documents_are_written_compressed_and_stored_ones_once(spark, tmp, monkeypatch):
    again = []
    monkeypatch.setattr(K, "materialize", lambda df, name, f=K.materialize: again.append(name) or f(df, name))
    docs = folder(spark, f"{tmp}/kb")
    assert len(again) == 2
    files = [f for d, _, fs in os.walk(f"{tmp}/kb") for f in fs if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    docs.write.parquet(f"{tmp}/stored")
    K.write_documents(spark.read.parquet(f"{tmp}/stored").where("doc_kind = 'note'"), f"{tmp}/kb/json", stored=True)
    assert len(again) == 2 and S.scan_documents(spark, f"{tmp}/kb").count() == len(BODIES) * 2


def test_documents_come_with_their_file(spark, tmp):
    folder(spark, tmp, file_bytes=40)
    files = {r["file_path"]: r for r in S.scan_document_dir(spark, tmp, recursive=True).where("file_size > 0").collect()}
    assert {r["file_type"] for r in files.values()} == {"application/json", "text/plain"}
    docs = S.scan_documents(spark, tmp).collect()
    assert len(docs) == len(BODIES) * 2 and {d["file_path"] for d in docs} <= set(files)
    for d in docs:
        f = files[d["file_path"]]
        assert (d["file_name"], d["file_size"], d["last_modified"]) == (f["file_name"], f["file_size"], f["last_modified"])
        assert d["doc_kind"] != "note" or d["doc_id"] in f["text"] or json.dumps(d["doc_id"])[1:-1] in f["text"]


def test_the_folder_query_reads_every_file_whole(spark):
    from __spark_entry__ import queries
    rows = queries()["scan_document_dir"](spark, SF).collect()
    assert rows and all(r["file_known"] and r["file_whole"] for r in rows)
    assert {r["file_dir"] for r in rows} == {"json/doc_kind=company", "json/doc_kind=client", "json/doc_kind=services", "md/doc_kind=protocol"}


def test_documents_are_written_where_they_lie(spark, tmp):
    docs = spark.range(400).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a/b").otherwise("c").alias("doc_kind"),
                                   F.repeat(F.lit("x"), F.when(F.col("id") % 4 == 0, 1000).otherwise(10).cast("int")).alias("body"))
    docs.coalesce(1).write.parquet(f"{tmp}/stored")
    stored = spark.read.parquet(f"{tmp}/stored")
    K.write_documents(stored, f"{tmp}/out", file_bytes=10_000, stored=True)
    # files follow each kind's own size: 100 documents of 1,000 bytes, 300 of 10
    parts = [d for d, _, fs in os.walk(f"{tmp}/out") for f in fs if f.startswith("part-") and f.endswith(".gz")]
    assert sum("c" == d.split("=")[-1] for d in parts) == 1 and len(parts) == 11
    back = spark.read.json(f"{tmp}/out")
    assert sorted(map(str, back.select("doc_id", "doc_kind", "body").collect())) == sorted(map(str, docs.collect()))
    K.write_documents(stored.where("doc_kind = 'c'"), f"{tmp}/out", stored=True)  # the other kind goes
    assert spark.read.json(f"{tmp}/out").count() == 300
    K.write_documents(stored.where("doc_kind = 'c'"), f"{tmp}/out", mode="append", stored=True)
    K.write_documents(stored, f"{tmp}/out", mode="ignore", stored=True)
    assert spark.read.json(f"{tmp}/out").count() == 600
    with pytest.raises(Exception, match="already exists"):
        K.write_documents(stored, f"{tmp}/out", mode="error", stored=True)
