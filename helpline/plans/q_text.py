"""Text retrieval and matching queries (X1, A9, J10, J13, J11, J6, J12, X5,
X6, X2) over ``documents``, ``benchmark``, ``conversations`` and the
knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpline.functions.columns import components, spread
from helpline.operators import chunk as CH
from helpline.operators import kb
from helpline.operators import lexical as L
from helpline.operators import match as M
from helpline.operators import names as N
from helpline.operators.embed import DEFAULT_DIM, fit_corpus, load_corpus_model, save_corpus_model, with_norm
from helpline.plans.catalog import register
from helpline.plans.q_kb import P5_SQL
from helpline.plans.sqltext import components_sql
from helpline.session import scratch_path
from helpline.sources import fixtures as fx
from helpline.sources.fixtures import with_fixtures as W
from helpline.sources.tables import read_table

TOK = L.TOKEN_SPLIT
TOKS = f"list_filter(regexp_split_to_array(lower(text), '{TOK}'), lambda x: x <> '')"
STEP = CH.CHUNK_SIZE - CH.CHUNK_OVERLAP
PROTOCOL_THRESHOLD = 5.0


def bm25_sql(q_sql: str, d_sql: str, k: int) -> str:
    """DuckDB BM25 top-k: ``q_sql(query_id, text)``, ``d_sql(item_id, text)``."""
    k1, b = L.K1, L.B
    return f"""SELECT query_id, item_id, score, hit_rank FROM (
      SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS hit_rank
      FROM (SELECT qt.query_id, w.item_id, sum(w.w) AS score
        FROM (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TOKS}) AS term FROM ({q_sql}) q) a) qt
        JOIN (SELECT tf.item_id, tf.term,
                ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * {k1 + 1.0} / (tf.tf + {k1} * ({1.0 - b} + {b} * tf.dl / st.avgdl)) AS w
              FROM (SELECT item_id, dl, term, count(*) AS tf FROM (
                      SELECT item_id, len(tok) AS dl, unnest(tok) AS term FROM (SELECT item_id, {TOKS} AS tok FROM ({d_sql}) d) a) b
                    GROUP BY 1, 2, 3) tf
              JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, term FROM (
                      SELECT item_id, unnest({TOKS}) AS term FROM ({d_sql}) d) x) y GROUP BY 1) df ON df.term = tf.term,
              (SELECT count(*) AS n, avg(len({TOKS})) AS avgdl FROM ({d_sql}) d) st) w ON w.term = qt.term
        GROUP BY 1, 2) s) r WHERE hit_rank <= {k}"""


def _docs(spark, d):
    # tokenising and chunking are CPU-heavy and row-local: spread a coarse scan
    return spread(read_table(spark, d, "documents", ["doc_id", "text", "lang", "source"]), "doc_id")


def _nodes(spark, d):
    return CH.with_node_hash(CH.chunk_documents(_docs(spark, d).select("doc_id", "text")))


CHUNK_SQL = f"""SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR) AS node_id, doc_id AS ref_doc_id,
    CAST(i AS INTEGER) AS chunk_no, CAST(i * {STEP} AS INTEGER) AS start_char,
    CAST(least(i * {STEP} + {CH.CHUNK_SIZE}, length(text)) AS INTEGER) AS end_char,
    substr(text, CAST(i * {STEP} + 1 AS BIGINT), {CH.CHUNK_SIZE}) AS text
    FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - {CH.CHUNK_SIZE}) / {STEP}) AS BIGINT)) + 1)) AS i
      FROM documents) c"""


@register("chunk_documents", f"""SELECT node_id, ref_doc_id, chunk_no, start_char, end_char,
    CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS node_hash FROM ({CHUNK_SQL}) n""")
def q_x1(spark, d):
    n = _nodes(spark, d)
    return n.select("node_id", "ref_doc_id", "chunk_no", "start_char", "end_char",
                    F.length("text").cast("bigint").alias("n_chars"), "node_hash")


@register("doc_node_lists", f"""SELECT ref_doc_id, count(*) AS n_nodes, string_agg(node_id, ', ' ORDER BY chunk_no) AS node_ids
    FROM ({CHUNK_SQL}) n GROUP BY 1""")
def q_a9(spark, d):
    return CH.doc_node_lists(_nodes(spark, d))


@register("node_source_join", f"""SELECT n.node_id, n.ref_doc_id, d.lang, d.source, n.chunk_no,
    sha256('source: ' || d.source || chr(10) || 'lang: ' || d.lang || chr(10) || chr(10) || n.text) AS embed_hash
    FROM ({CHUNK_SQL}) n JOIN documents d ON d.doc_id = n.ref_doc_id""")
def q_j10(spark, d):
    docs = _docs(spark, d)
    n = CH.chunk_documents(docs.select("doc_id", "text"))
    j = CH.node_source_join(n, docs.select("doc_id", "lang", "source"))
    e = CH.embed_text(j, ["source", "lang"])
    return e.select("node_id", "ref_doc_id", "lang", "source", "chunk_no", F.sha2("embed_text", 256).alias("embed_hash"))


LEX_SQL = bm25_sql("SELECT item_id AS query_id, text FROM benchmark", "SELECT doc_id AS item_id, text FROM documents", 5)


def _lexical(spark, d, k=5):
    q = read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    return L.lexical_join(q, _docs(spark, d).select("doc_id", "text"), k=k)


@register("lexical_join", f"""SELECT query_id, item_id AS doc_id, CAST(hit_rank AS INTEGER) AS hit_rank, round(score, 6) AS score
    FROM ({LEX_SQL}) h""")
def q_j13(spark, d):
    h = _lexical(spark, d)
    return h.select("query_id", F.col("item_id").alias("doc_id"), F.col("hit_rank").cast("int"), F.round("score", 6).alias("score"))


@register("rag_prompt", f"""SELECT b.item_id AS query_id, CAST(count(h.item_id) AS BIGINT) AS n_hits,
    'Question: ' || b.text || chr(10) || chr(10) || 'Context:' || chr(10) ||
      coalesce(string_agg('[' || CAST(h.hit_rank AS VARCHAR) || '] ' || CAST(h.item_id AS VARCHAR) || ': ' || dd.text, chr(10) ORDER BY h.hit_rank), '') AS prompt
    FROM benchmark b LEFT JOIN ({LEX_SQL}) h ON h.query_id = b.item_id LEFT JOIN documents dd ON dd.doc_id = h.item_id
    GROUP BY b.item_id, b.text""")
def q_x5(spark, d):
    q = read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    return M.rag_prompt(q, _lexical(spark, d), _docs(spark, d))


# the passages, and for each one a question that no document answers
_ASKED_SQL = f"""SELECT item_id, text FROM benchmark UNION ALL
    SELECT item_id + {fx.NOT_FOUND_OFFSET}, '¿qq' || CAST(item_id AS VARCHAR) || 'zz?' FROM benchmark"""


def _asked(spark, d):
    q = read_table(spark, d, "benchmark", ["item_id", "text"]).withColumnRenamed("item_id", "query_id")
    return q.unionByName(q.select((F.col("query_id") + F.lit(fx.NOT_FOUND_OFFSET)).alias("query_id"),
                                  F.concat(F.lit("¿qq"), F.col("query_id").cast("string"), F.lit("zz?")).alias("text")))


@register("answer", f"""SELECT b.item_id AS query_id, CASE WHEN h.item_id IS NULL THEN 'error' ELSE 'ok' END AS status,
    h.item_id AS answer_doc_id,
    CASE WHEN h.item_id IS NULL THEN 'ERROR: no matching document' ELSE 'SEARCH RESULTS:' || chr(10) || dd.text END AS answer
    FROM ({_ASKED_SQL}) b LEFT JOIN (SELECT * FROM ({bm25_sql(f"SELECT item_id AS query_id, text FROM ({_ASKED_SQL}) a0",
                                                              "SELECT doc_id AS item_id, text FROM documents", 1)}) x) h ON h.query_id = b.item_id
    LEFT JOIN documents dd ON dd.doc_id = h.item_id""")
def q_x6(spark, d):
    q, docs = _asked(spark, d), _docs(spark, d)
    return M.answer(q, L.lexical_join(q, docs.select("doc_id", "text"), k=1), docs)


@register("fuzzy_entity_match", W(f"""SELECT query_id, spoken, person_id, matched_name, CAST(heard AS INTEGER) AS heard,
      CAST(distance AS INTEGER) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY heard DESC, distance, silent, person_id) AS rn FROM (
      SELECT query_id, any_value(spoken) AS spoken, person_id, any_value(full_name) AS matched_name,
        least(count(DISTINCT word), count(DISTINCT said)) AS heard, sum(d) FILTER (WHERE nearest = 1) AS distance,
        any_value(size) - count(DISTINCT word) AS silent FROM (
        SELECT q.query_id, q.spoken, q.said, n.person_id, n.full_name, n.word, n.size, v.d,
          row_number() OVER (PARTITION BY q.query_id, n.person_id, n.word ORDER BY v.d, q.said) AS nearest
        FROM (SELECT DISTINCT query_id, spoken, unnest(regexp_extract_all(lower(spoken), '[a-z]+')) AS said FROM caller_texts) q
        JOIN (SELECT s.said, r.word, levenshtein(s.said, r.word) AS d
          FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(spoken), '[a-z]+')) AS said FROM caller_texts) s
          JOIN (SELECT DISTINCT unnest(string_split(full_name, ' ')) AS word FROM people) r
            ON abs(length(s.said) - length(r.word)) <= 2 AND levenshtein(s.said, r.word) <=
              CASE WHEN length(r.word) < {N.ONE_EDIT} THEN 0 WHEN length(r.word) < {N.TWO_EDITS} THEN 1 ELSE 2 END) v USING (said)
        JOIN (SELECT person_id, full_name, len(words) AS size, unnest(words) AS word FROM (
            SELECT words, min(person_id) AS person_id, arg_min(full_name, person_id) AS full_name FROM (
              SELECT person_id, full_name, list_sort(list_distinct(string_split(full_name, ' '))) AS words
              FROM people WHERE full_name <> '') a GROUP BY words) b) n ON n.word = v.word) c
      GROUP BY query_id, person_id) e) f WHERE rn = 1""", "people", "caller_texts"))
def q_j11(spark, d):
    return N.find_names(fx.caller_texts(spark, d), fx.people(spark, d))


@register("whole_name_match", W(f"""SELECT query_id, spoken, person_id, matched_name, CAST(distance AS INTEGER) AS distance FROM (
    SELECT q.query_id, q.spoken, r.person_id, r.full_name AS matched_name, levenshtein(q.spoken, r.full_name) AS distance,
      row_number() OVER (PARTITION BY q.query_id ORDER BY levenshtein(q.spoken, r.full_name), r.person_id) AS rn
    FROM spoken_names q JOIN (SELECT full_name, min(person_id) AS person_id FROM people GROUP BY 1) r
      ON levenshtein(q.spoken, r.full_name) <= {M.MAX_DISTANCE}) x WHERE rn = 1""", "people", "spoken_names"))
def q_j11_whole(spark, d):
    """Whole names within two edits of what was said."""
    return M.fuzzy_entity_match(fx.spoken_names(spark, d), fx.people(spark, d))


def claims(spark, d):
    """Claims heard on calls, from every client-company pair: the true pair,
    the pair with the next company id, and an unregistered client."""
    cc = fx.client_companies(spark, d)
    cn = fx.clients(spark, d).select(F.col("Id").alias("ClienteId"), F.col("NombreCompleto").alias("cname"))
    en = fx.companies(spark, d).select(F.col("Id").alias("cid"), F.col("Nombre").alias("ename"))
    base = cc.join(cn, "ClienteId")
    key = F.concat_ws(":", F.col("ClienteId").cast("string"), F.col("EmpresaId").cast("string"))
    pair = (base.join(en, base.EmpresaId == en.cid)
            .select(F.concat(F.lit("pair:"), key).alias("claim_id"), F.col("cname").alias("client_name"), F.col("ename").alias("company_name")))
    nxt = base.withColumn("cid", F.col("EmpresaId") + 1).join(en, "cid", "left").select(
        F.concat(F.lit("next:"), key).alias("claim_id"), F.col("cname").alias("client_name"),
        F.coalesce(F.col("ename"), F.concat(F.lit("Unknown company "), F.col("cid").cast("string"))).alias("company_name"))
    stranger = base.join(en, base.EmpresaId == en.cid).select(
        F.concat(F.lit("stranger:"), key).alias("claim_id"),
        F.concat(F.lit("Unknown client "), F.col("ClienteId").cast("string")).alias("client_name"), F.col("ename").alias("company_name"))
    return pair.unionByName(nxt).unionByName(stranger)


_NORM = "trim(regexp_replace(lower(translate({x}, '{a}', '{u}')), '\\s+', ' ', 'g'))"


def _norm_sql(x: str) -> str:
    from helpline.functions.columns import ACCENTED, UNACCENTED
    return _NORM.format(x=x, a=ACCENTED, u=UNACCENTED)


CLAIMS_SQL = """SELECT 'pair:' || CAST(cc.ClienteId AS VARCHAR) || ':' || CAST(cc.EmpresaId AS VARCHAR) AS claim_id,
      c.NombreCompleto AS client_name, e.Nombre AS company_name
    FROM client_companies cc JOIN clients c ON c.Id = cc.ClienteId JOIN companies e ON e.Id = cc.EmpresaId
    UNION ALL SELECT 'next:' || CAST(cc.ClienteId AS VARCHAR) || ':' || CAST(cc.EmpresaId AS VARCHAR), c.NombreCompleto,
      coalesce(e.Nombre, 'Unknown company ' || CAST(cc.EmpresaId + 1 AS VARCHAR))
    FROM client_companies cc JOIN clients c ON c.Id = cc.ClienteId LEFT JOIN companies e ON e.Id = cc.EmpresaId + 1
    UNION ALL SELECT 'stranger:' || CAST(cc.ClienteId AS VARCHAR) || ':' || CAST(cc.EmpresaId AS VARCHAR),
      'Unknown client ' || CAST(cc.ClienteId AS VARCHAR), e.Nombre
    FROM client_companies cc JOIN clients c ON c.Id = cc.ClienteId JOIN companies e ON e.Id = cc.EmpresaId"""


@register("validate_client_company", W(f"""SELECT claim_id, ce AS client_exists, ee AS company_exists, aa AS associated,
    ce AND ee AND aa AS valid_strict, ce AND ee AS valid_relaxed FROM (
    SELECT k.claim_id,
      EXISTS (SELECT 1 FROM clients c WHERE {_norm_sql('c.NombreCompleto')} = {_norm_sql('k.client_name')}) AS ce,
      EXISTS (SELECT 1 FROM companies e WHERE {_norm_sql('e.Nombre')} = {_norm_sql('k.company_name')}) AS ee,
      EXISTS (SELECT 1 FROM client_companies cc JOIN clients c ON c.Id = cc.ClienteId JOIN companies e ON e.Id = cc.EmpresaId
              WHERE {_norm_sql('c.NombreCompleto')} = {_norm_sql('k.client_name')} AND {_norm_sql('e.Nombre')} = {_norm_sql('k.company_name')}) AS aa
    FROM ({CLAIMS_SQL}) k) x""", "companies", "clients", "client_companies"))
def q_j6(spark, d):
    return M.validate_client_company(claims(spark, d), fx.clients(spark, d), fx.companies(spark, d),
                                     fx.client_companies(spark, d))


def issues(spark, d):
    """The issue of each call: everything its client said, in order (the first
    turn alone would be the identification)."""
    t = fx.turns(spark, d).filter((F.col("role") == "user") & F.col("text").isNotNull())
    said = t.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("said"))
    return said.select("call_id", F.array_join(F.transform("said", lambda x: x["text"]), "\n").alias("text"))


ISSUES_SQL = "SELECT call_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM turns WHERE role = 'user' AND text IS NOT NULL GROUP BY 1"


@register("protocol_match", W(f"""SELECT i.call_id, h.item_id AS protocol_id, round(h.score, 6) AS score,
    CASE WHEN h.item_id IS NULL THEN '{M.NO_SOLUTION}' ELSE '{M.VERIFIED}' END AS verdict
    FROM ({ISSUES_SQL}) i LEFT JOIN (SELECT * FROM ({bm25_sql(f"SELECT call_id AS query_id, text FROM ({ISSUES_SQL}) i0",
                                                           f"SELECT entity_id AS item_id, body AS text FROM ({P5_SQL}) p", 1)}) x
      WHERE score >= {PROTOCOL_THRESHOLD}) h ON h.query_id = i.call_id""",
    "turns", "reasons", "protocols", "protocol_steps"))
def q_j12(spark, d):
    docs = kb.protocol_docs(fx.protocols(spark, d), fx.reasons(spark, d), fx.protocol_steps(spark, d))
    return M.protocol_match(issues(spark, d), docs, PROTOCOL_THRESHOLD)


_HELD = f"""SELECT g.b, count(h.b) AS held, (SELECT count(*) FROM documents) AS n FROM (SELECT unnest(range({DEFAULT_DIM})) AS b) g
    LEFT JOIN (SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % {DEFAULT_DIM} AS INTEGER) AS b FROM (
      SELECT doc_id, unnest({TOKS}) AS t FROM documents) a) h ON h.b = g.b GROUP BY 1"""


@register("embed", f"""WITH held AS ({_HELD}),
    model AS (SELECT 'token-idf-{DEFAULT_DIM}-' || substr(md5('(' || any_value(n) || ', (' || string_agg(held, ', ' ORDER BY b) || '))'), 1, 12) AS model FROM held)
    SELECT d.doc_id, m.model, {DEFAULT_DIM} AS dim, CASE WHEN v.node_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, coalesce(v.components, '') AS components
    FROM documents d CROSS JOIN model m LEFT JOIN ({components_sql("SELECT doc_id AS node_id, text FROM documents",
                                                                    "SELECT b, ln((n + 1) / (held + 1)) AS w FROM held")}) v ON v.node_id = d.doc_id""")
def q_x2(spark, d):
    """Document frequencies counted over the first and the other documents apart,
    added up, stored, loaded, and every document embedded with them."""
    docs = _docs(spark, d).select("doc_id", "text")
    path = scratch_path(spark, "corpus-model")
    parts = [fit_corpus(docs.where(f"doc_id % 2 = {i}")) for i in (0, 1)]
    save_corpus_model(spark, parts[0].add(parts[1]), path)
    v = with_norm(load_corpus_model(spark, path)(docs))
    return v.select("doc_id", "model", "dim", F.round("norm", 4).alias("norm"), components(F.col("embedding")).alias("components"))
