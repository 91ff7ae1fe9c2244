import json
import os

from helpline.operators import kb
from helpline.sinks.writers import write_documents, write_markdown
from helpline.sources import fixtures as fx
from helpline.sources.files import scan_document_dir
from tests.conftest import SF


def test_documents_roundtrip_through_folder(spark, tmp):
    docs = kb.corpus(*(getattr(fx, n)(spark, SF) for n in
                       ["companies", "clients", "client_companies", "services", "protocols", "reasons", "protocol_steps"]))
    out = os.path.join(tmp, "kb")
    write_documents(docs, out)
    back = spark.read.json(out)
    assert back.count() == docs.count()
    assert {r["doc_kind"] for r in back.select("doc_kind").distinct().collect()} == {"company", "client", "services", "protocol"}
    md = os.path.join(tmp, "md")
    write_markdown(docs.filter("doc_kind = 'protocol'"), md)
    assert os.path.isdir(os.path.join(md, "doc_kind=protocol"))


def test_scan_document_dir_metadata(spark, tmp):
    os.makedirs(os.path.join(tmp, "kb"))
    with open(os.path.join(tmp, "kb", "enterprise_1.json"), "w") as f:
        json.dump({"enterprise_id": "EM1", "name": "Acme"}, f, indent=2)
    with open(os.path.join(tmp, "kb", "protocol_1.md"), "w") as f:
        f.write("# Title\n\n## Steps\n1. a\n2. b\n")
    rows = {r["file_name"]: r for r in scan_document_dir(spark, os.path.join(tmp, "kb")).collect()}
    assert rows["enterprise_1.json"]["file_type"] == "application/json"
    assert rows["protocol_1.md"]["file_type"] == "text/markdown"
    assert rows["protocol_1.md"]["text"].startswith("# Title\n\n## Steps")  # whole text, one row per file
    assert rows["protocol_1.md"]["file_size"] > 0


def test_markdown_pages_read_back_whole(spark, tmp):
    from helpline.sinks.writers import read_markdown
    pages = spark.createDataFrame([("# A\n\n## Steps\n1. x\n", "protocol"), ("# B\n\nline\n\n\nend", "protocol")],
                                  "body string, doc_kind string")
    write_markdown(pages, os.path.join(tmp, "md"))
    back = sorted(r["body"] for r in read_markdown(spark, os.path.join(tmp, "md")).collect())
    assert back == ["# A\n\n## Steps\n1. x\n", "# B\n\nline\n\n\nend"]


def test_transcripts_json_lines_round_trip(spark, tmp):
    from pyspark.sql import functions as F

    from helpline.operators import calls as C
    from helpline.sinks.writers import write_transcripts
    from helpline.sources.files import scan_transcripts
    turns = spark.createDataFrame([(7, 0, "assistant", "Hola"), (7, 1, "user", None), (7, 2, "user", "Ana")],
                                  "call_id long, pos long, role string, text string")
    t = C.build_transcripts(turns).withColumn("file_name", F.lit("transcript_2024-01-02_03-04-05_7.json"))
    write_transcripts(t, os.path.join(tmp, "tr"), mode="overwrite")
    r = scan_transcripts(spark, os.path.join(tmp, "tr"), multi_line=False).collect()
    assert len(r) == 1 and r[0]["call_id"] == 7 and not r[0]["malformed"]
    assert str(r[0]["started_at"]) == "2024-01-02 03:04:05"
    assert [i["content"] for i in r[0]["items"]] == [["Hola"], [], ["Ana"]]
