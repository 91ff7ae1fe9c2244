"""Sources and sinks as round trips.

Each query writes data that Spark derives from the test tables into a fresh
folder under the shared checkpoint folder (``session.scratch_path``), reads it
back with the library's reader and returns what was read, so the work grows
with the tables and the oracle checks that nothing was lost or altered on the
way. Every write is a partitioned Spark write; nothing passes through the
driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpline.functions.columns import PAGE_SPAN, components
from helpline.operators import calls as C
from helpline.operators import chunk as CH
from helpline.operators import kb
from helpline.operators.vector import DEFAULT_TOP_K
from helpline.operators.embed import DEFAULT_DIM, token_embedder, with_norm
from helpline.plans.catalog import register
from helpline.plans.q_calls import REQUEST_ID
from helpline.plans.q_kb import ALL, CORPUS_SQL, P5_SQL, corpus
from helpline.plans.q_kb import _t as kb_tables
from helpline.plans.q_text import CHUNK_SQL, STEP
from helpline.plans.rebuild import answer_from_index, ask, index_folder, rebuild_index
from helpline.plans.sqltext import components_sql, page, vector_sql
from helpline.schemas import CALLS
from helpline.session import materialize, scratch_path
from helpline.sinks import index as IX
from helpline.sinks import writers as K
from helpline.sources import fixtures as fx
from helpline.sources import files as S
from helpline.sources.fixtures import with_fixtures as W
from helpline.sources.tables import read_table

ROLE = "CASE WHEN role = 'assistant' THEN 'Assistant' ELSE 'User' END"
FILE_NAME_SQL = ("'transcript_' || strftime(c.started_at, '%Y-%m-%d_%H-%M-%S') || '_' || "
                 "CAST(t.call_id AS VARCHAR) || '.json'")
DOC_FILE_SCHEMA = ("doc_id string, entity_id long, page_no long, title string, body string, "
                   "content_hash string, doc_path string")


def _chunks_sql(docs_sql: str) -> str:
    """CHUNK_SQL over another ``(doc_id, text)`` relation."""
    return CHUNK_SQL.replace("FROM documents) c", f"FROM ({docs_sql}) d) c")


# ------------------------------------------------------------- S4 transcripts
@register("scan_transcripts", W(f"""SELECT t.call_id, t.page_no, {FILE_NAME_SQL} AS file_name, c.started_at,
    t.n_items, t.transcript, false AS malformed
    FROM (SELECT call_id, {page('pos', PAGE_SPAN)} AS page_no, count(*) AS n_items,
      coalesce(string_agg(CASE WHEN text IS NOT NULL THEN {ROLE} || ': ' || text END, chr(10) ORDER BY pos), '') AS transcript
      FROM turns GROUP BY 1, 2) t JOIN calls c ON c.call_id = t.call_id""", "turns", "calls"))
def q_s4(spark, d):
    """Transcripts built from the conversations are written by the sink (K4)
    and read back by the transcript reader; formatting runs on what was read."""
    t = C.build_transcripts(fx.turns(spark, d))
    c = fx.calls(spark, d).select("call_id", "started_at")
    files = t.join(c, "call_id").select("call_id", "page_no", "items",
                                        C.transcript_file_name("call_id", "started_at").alias("file_name"))
    path = scratch_path(spark, "transcripts")
    K.write_transcripts(files, path, mode="overwrite")
    back = S.scan_transcripts(spark, path, multi_line=False)
    return back.select("call_id", "page_no", "file_name", "started_at", F.size("items").cast("bigint").alias("n_items"),
                       C.format_items(F.col("items")).alias("transcript"), "malformed")


# ---------------------------------------------------------------- S8 requests
@register("scan_requests", W(f"SELECT {REQUEST_ID} AS request_id, call_id, evaluation_prompt FROM eval_requests", "eval_requests"))
def q_s8(spark, d):
    """Request bodies as JSON lines; a body without ``evaluation_prompt`` reads
    back with a NULL prompt (it is rejected later by P7)."""
    path = scratch_path(spark, "requests")
    fx.eval_requests(spark, d).write.mode("overwrite").json(path)  # NULL fields are left out of the body
    return S.scan_requests(spark, path)


# ------------------------------------------------------------- K1 documents
@register("write_documents", W(f"""SELECT doc_id, doc_kind, doc_id || '.json' AS doc_path, content_hash,
    sha256(body) AS body_hash FROM ({CORPUS_SQL}) x""", *ALL))
def q_k1(spark, d):
    path = scratch_path(spark, "documents")
    K.write_documents(corpus(spark, d), path)
    back = spark.read.schema(DOC_FILE_SCHEMA + ", doc_kind string").json(path)
    return back.select("doc_id", "doc_kind", "doc_path", "content_hash", F.sha2("body", 256).alias("body_hash"))


# ------------------------------------------------------------- K2 Markdown
@register("write_markdown", W(f"""SELECT 'protocol' AS doc_kind, doc_id, entity_id, title,
    CASE WHEN entity_id % 5 = 0 THEN CAST(body AS VARCHAR) || chr(12) || '## Page two' || chr(27) || 'f' ELSE CAST(body AS VARCHAR) END AS body
    FROM ({P5_SQL}) p""", "reasons", "protocols", "protocol_steps"))
def q_k2(spark, d):
    t = kb_tables(spark, d)
    pages = kb.protocol_docs(t["protocols"], t["reasons"], t["protocol_steps"]).withColumn("doc_kind", F.lit("protocol"))
    # one page in five holds a form feed and an escape of its own
    pages = pages.withColumn("body", F.when(F.col("entity_id") % 5 == 0, F.concat("body", F.lit("\f## Page two\x1bf"))).otherwise(F.col("body")))
    path = scratch_path(spark, "markdown")
    K.write_markdown(pages, path)
    return K.read_markdown(spark, path, S.DOCUMENT.replace("body string, ", "")).select("doc_kind", "doc_id", "entity_id", "title", "body")


# ------------------------------------------------------ S3 folder of files
@register("scan_document_dir", W(f"""SELECT doc_id, doc_kind, title, content_hash, sha256(body) AS body_hash,
      CASE doc_kind WHEN 'protocol' THEN 'text/markdown' ELSE 'application/json' END AS file_type,
      CASE doc_kind WHEN 'protocol' THEN 'md' ELSE 'json' END || '/doc_kind=' || doc_kind AS file_dir,
      true AS file_known, true AS file_whole FROM ({CORPUS_SQL}) x""", *ALL))
def q_s3(spark, d):
    """Both sinks write one knowledge-base folder. The folder scan reads every file whole, with
    its path, name, size and date, and the document scan gives every document of every
    file back with its id. ``file_known``: both scans tell the same name, size and date of the
    document's file; ``file_whole``: the file's text holds as many documents as were found in it."""
    base = scratch_path(spark, "kb")
    _write_folder(spark, d, base)
    back = S.scan_documents(spark, base)
    text, sep = F.col("text"), F.when(F.contains("file_path", F.lit("/json/doc_kind=")), F.lit("\n")).otherwise(F.lit(K.PAGE_BREAK))
    files = S.scan_document_dir(spark, base, recursive=True).select(  # every record ends with sep
        "file_path", *[F.col(c).alias(f"_{c}") for c in ("file_name", "file_size", "last_modified")],
        F.regexp_extract("file_path", r"/((?:json|md)/doc_kind=[^/]+)/[^/]+$", 1).alias("file_dir"),
        (F.octet_length(text) - F.octet_length(F.replace(text, sep, F.lit("")))).alias("_held"))
    found = back.groupBy("file_path").agg(F.count(F.lit(1)).alias("_found"))
    files = files.join(found, "file_path").withColumn("file_whole", F.col("_held") == F.col("_found"))
    known = (F.col("file_name") == F.col("_file_name")) & (F.col("file_size") == F.col("_file_size")) & (
        F.col("file_size") > 0) & (F.col("last_modified") == F.col("_last_modified"))
    return back.join(F.broadcast(files), "file_path", "left").select(  # a row per file
        "doc_id", "doc_kind", "title", "content_hash", F.sha2("body", 256).alias("body_hash"), "file_type",
        "file_dir", known.alias("file_known"), "file_whole")


def _write_folder(spark, d, base):
    """Protocols as Markdown pages, the other kinds as JSON lines."""
    docs = materialize(corpus(spark, d), "kb-documents")  # the export runs once
    K.write_documents(docs.where("doc_kind <> 'protocol'"), f"{base}/json", stored=True)
    K.write_markdown(docs.where("doc_kind = 'protocol'"), f"{base}/md", stored=True)


# ------------------------------------------------------ K5 calls register
@register("append_calls", W("SELECT call_id, room_name, started_at, ended_at, transcript_path FROM calls", "calls"))
def q_k5(spark, d):
    """Every call is delivered twice (the second batch is a redelivery); the
    register holds it once."""
    reg = scratch_path(spark, "calls-register")
    calls = fx.calls(spark, d).select(*CALLS.fieldNames())
    K.append_calls(calls, reg)
    K.append_calls(calls, reg)
    return spark.read.parquet(reg).select(*CALLS.fieldNames())


# --------------------------------------------------------- K3 / S6 index
def _doc_nodes(docs):
    n = CH.with_node_hash(CH.chunk_documents(docs.select("doc_id", "text")))
    return n.withColumn("embed_text", F.col("text"))


def _persist(spark, base, version, docs):
    nodes = _doc_nodes(docs)
    vec = with_norm(token_embedder()(nodes.select("node_id", F.col("embed_text").alias("text")))).select(
        "node_id", "model", "dim", "embedding", "norm")
    return IX.persist_index(nodes.drop("embed_text"), vec, base, version)


def _index_rows(nodes, vectors):
    v = vectors.select("node_id", "dim", (F.abs(F.col("norm") - F.lit(1.0)) < F.lit(1e-4)).alias("unit_norm"),
                       components(F.col("embedding")).alias("components"))
    return nodes.join(v, "node_id", "left").select(
        "node_id", "ref_doc_id", "chunk_no", "start_char", "end_char", "node_hash", F.col("dim").cast("int"), "unit_norm", "components")


def _index_sql(chunks: str) -> str:
    return f"""SELECT n.node_id, ref_doc_id, chunk_no, start_char, end_char, sha256(text) AS node_hash,
    CAST({DEFAULT_DIM} AS INTEGER) AS dim, v.node_id IS NOT NULL AS unit_norm, coalesce(v.components, '') AS components
    FROM ({chunks}) n LEFT JOIN ({components_sql(f"SELECT node_id, text FROM ({chunks}) m")}) v ON v.node_id = n.node_id"""


@register("persist_index", _index_sql(CHUNK_SQL))
def q_k3(spark, d):
    """Nodes and vectors of every document written as index version v1 and
    read back from that version: one vector per node, unit norm unless the
    chunk has no token."""
    base = scratch_path(spark, "index")
    _persist(spark, base, "v1", read_table(spark, d, "documents", ["doc_id", "text"]))
    return _index_rows(*S.load_index(spark, base, "v1"))


CURRENT_DOCS_SQL = f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN text || chr(10) || '(rev. 2)' ELSE text END AS text
    FROM documents WHERE lang <> 'de'
    UNION ALL SELECT item_id + {fx.NOT_FOUND_OFFSET} AS doc_id, text FROM benchmark"""


def _current_docs(spark, d):
    """Today's corpus (as in S5): German documents removed, French ones edited,
    the benchmark passages added."""
    docs = read_table(spark, d, "documents", ["doc_id", "text", "lang"]).filter(F.col("lang") != "de")
    text = F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("\n(rev. 2)"))).otherwise(F.col("text"))
    bench = read_table(spark, d, "benchmark", ["item_id", "text"]).select(
        (F.col("item_id") + F.lit(fx.NOT_FOUND_OFFSET)).alias("doc_id"), "text")
    return docs.select("doc_id", text.alias("text")).unionByName(bench)


@register("load_index", _index_sql(_chunks_sql(CURRENT_DOCS_SQL)))
def q_s6(spark, d):
    """Two versions are persisted (yesterday's and today's corpus); the loader
    finds the latest through the manifest and returns its nodes and vectors."""
    base = scratch_path(spark, "index")
    _persist(spark, base, "v1", read_table(spark, d, "documents", ["doc_id", "text"]))
    _persist(spark, base, "v2", _current_docs(spark, d))
    nodes, vectors = S.load_index(spark, base)
    return _index_rows(nodes, vectors)


# ------------------------------------------------------------- ask the index
def _ask_sql(questions: str) -> str:
    """CTEs ``nodes`` and ``ranked(query_id, item_id, score, hit_rank)`` for ``questions(node_id,
    text)``: every node by cosine of the token vectors."""
    return f"""nodes AS ({CHUNK_SQL}),
    nv AS ({vector_sql("SELECT node_id, text FROM nodes")}), qv AS ({vector_sql(questions)}),
    nn AS (SELECT node_id, sqrt(sum(x * x)) AS n FROM nv GROUP BY 1), qn AS (SELECT node_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY 1),
    dots AS (SELECT qv.node_id AS query_id, nv.node_id AS item_id, sum(qv.x * nv.x) AS dot FROM qv JOIN nv USING (b) GROUP BY 1, 2),
    scored AS (SELECT qn.node_id AS query_id, nn.node_id AS item_id, coalesce(dot, 0) / (qn.n * nn.n) AS score
      FROM qn CROSS JOIN nn LEFT JOIN dots ON dots.query_id = qn.node_id AND dots.item_id = nn.node_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank FROM scored)"""


@register("ask_index", f"""WITH {_ask_sql("SELECT item_id AS node_id, text FROM benchmark")}
    SELECT query_id, CAST(hit_rank AS INTEGER) AS hit_rank, item_id, ref_doc_id, round(score, 6) AS score
    FROM ranked r JOIN nodes ON nodes.node_id = r.item_id WHERE hit_rank <= {DEFAULT_TOP_K}""")
def q_ask(spark, d):
    """Every benchmark passage asked of an index of all documents that was
    written and loaded: node, source document and score of its best hits."""
    base = scratch_path(spark, "index")
    _persist(spark, base, "v1", read_table(spark, d, "documents", ["doc_id", "text"]))
    q = read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    hits = ask(q, *S.load_index(spark, base))
    return hits.select("query_id", F.col("hit_rank").cast("int"), "item_id", "ref_doc_id", F.round("score", 6).alias("score"))


_ASKED = f"""SELECT item_id AS node_id, text FROM benchmark UNION ALL
    SELECT item_id + {fx.NOT_FOUND_OFFSET}, '¿' || repeat('?', CAST(item_id % 5 AS BIGINT)) FROM benchmark"""


@register("answer_from_index", f"""WITH {_ask_sql(_ASKED)}
    SELECT q.node_id AS query_id, CASE WHEN r.item_id IS NULL THEN 'error' ELSE 'ok' END AS status, r.item_id AS answer_doc_id,
      CASE WHEN r.item_id IS NULL THEN 'ERROR: no matching document' ELSE 'SEARCH RESULTS:' || chr(10) || n.text END AS answer
    FROM ({_ASKED}) q LEFT JOIN (SELECT * FROM ranked WHERE hit_rank = 1) r ON r.query_id = q.node_id LEFT JOIN nodes n ON n.node_id = r.item_id""")
def q_answer(spark, d):
    """The whole ask path: every benchmark passage, and for each a question without words,
    answered from a stored index of all documents, with status and prefix."""
    base = scratch_path(spark, "index")
    _persist(spark, base, "v1", read_table(spark, d, "documents", ["doc_id", "text"]))
    q = read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    mute = q.select((F.col("query_id") + F.lit(fx.NOT_FOUND_OFFSET)).alias("query_id"),
                    F.concat(F.lit("¿"), F.expr("repeat('?', CAST(query_id % 5 AS INT))")).alias("text"))
    return answer_from_index(spark, base, q.unionByName(mute))


# ------------------------------------------------------------ X10 rebuild
_REBUILT = f"""SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR) AS node_id, doc_id AS ref_doc_id,
        CAST(i AS INTEGER) AS chunk_no, substr(body, CAST(i * {STEP} + 1 AS BIGINT), {CH.CHUNK_SIZE}) AS text,
        content_hash AS doc_hash, 'doc_kind: ' || doc_kind || chr(10) || 'title: ' || title || chr(10) || chr(10) AS head
      FROM (SELECT doc_id, doc_kind, title, body, content_hash,
          unnest(range(0, greatest(0, CAST(ceil((length(body) - {CH.CHUNK_SIZE}) / {STEP}) AS BIGINT)) + 1)) AS i
        FROM ({CORPUS_SQL}) x) c"""


_REBUILT_SQL = f"""WITH rebuilt AS ({_REBUILT})
    SELECT n.node_id, ref_doc_id, chunk_no, sha256(text) AS node_hash, doc_hash, CAST({DEFAULT_DIM} AS INTEGER) AS dim,
      coalesce(v.components, '') AS components
    FROM rebuilt n LEFT JOIN ({components_sql("SELECT node_id, head || text AS text FROM rebuilt")}) v ON v.node_id = n.node_id"""


@register("rebuild_index", W(_REBUILT_SQL, *ALL))
def q_x10(spark, d):
    """The rebuild job over changing tables: a full build without the clients of one
    company in ten and the steps of one protocol in ten (v1), then an incremental one
    (v2), whose segment holds only the new and changed documents. The latest version is
    returned."""
    base = scratch_path(spark, "kb-index")
    tables = kb_tables(spark, d)
    before = {**tables, "client_companies": tables["client_companies"].where("EmpresaId % 10 <> 3"),
              "protocol_steps": tables["protocol_steps"].where("ProtocolId % 10 <> 4")}
    full = rebuild_index(spark, before, base, "v1", incremental=False)
    r = rebuild_index(spark, tables, base, "v2")
    if r["previous_version"] != "v1" or not 0 < r["n_nodes"] < full["n_nodes"]:
        raise RuntimeError(f"the incremental rebuild did not build on v1: {r}")
    nodes, vectors = S.load_index(spark, base)
    return nodes.join(vectors.select("node_id", "dim", components(F.col("embedding")).alias("components")), "node_id", "left").select(
        "node_id", "ref_doc_id", "chunk_no", "node_hash", "doc_hash", F.col("dim").cast("int"), "components")


@register("rebuild_from_folder", W(_REBUILT_SQL, *ALL))
def q_x10_folder(spark, d):
    """The index built from a folder of documents that the sinks wrote: the same nodes,
    hashes and vectors as from the tables."""
    base = scratch_path(spark, "kb-folder")
    _write_folder(spark, d, f"{base}/kb")
    index_folder(spark, f"{base}/kb", f"{base}/index", "v1")
    nodes, vectors = S.load_index(spark, f"{base}/index")
    return nodes.join(vectors.select("node_id", "dim", components(F.col("embedding")).alias("components")), "node_id", "left").select(
        "node_id", "ref_doc_id", "chunk_no", "node_hash", "doc_hash", F.col("dim").cast("int"), "components")
