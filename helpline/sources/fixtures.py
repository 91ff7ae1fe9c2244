"""Call-centre view of the TPC-H-ish test tables (FIXTURES.md section 5).

Each function returns the operational table the knowledge-base export expects
(companies, clients, client_companies, services, reasons, protocols,
protocol_steps, calls, turns, eval_requests, people, spoken names). ``SQL``
holds the same definitions as DuckDB CTEs for the oracle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.functions.columns import fold_accents, fold_accents_sql
from helpline.sources.tables import read_table

# The canned evaluation prompt and the closing phrases appended to
# the last assistant turn of each call so outcome rules have something to find.
EVAL_PROMPT = "Check the greeting, the identification of the client and the resolution offered."
SECOND_PROMPT = "Check that the agent kept to Spanish."
NOT_FOUND_OFFSET = 1_000_000_000
# Openings put before some calls.
GREETING = "Buenos días, dígame su nombre y su empresa, por favor."
EARLY_SOLUTION = "Tengo una solución verificada para usted."


def companies(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    return (s.join(n, s.s_nationkey == n.n_nationkey, "inner")
            .select(F.col("s_suppkey").alias("Id"),
                    F.concat(F.lit("EM"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("Codigo"),
                    F.col("s_name").alias("Nombre"),
                    F.col("n_name").alias("Ciudad")))


def clients(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return c.select(F.col("c_custkey").alias("Id"),
                    F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")).alias("CodigoCliente"),
                    F.col("c_name").alias("NombreCompleto"))


def client_companies(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_suppkey"], spread_by="l_orderkey")
    # distinct on the join output; Spark plans a partial (map-side) distinct
    # before the shuffle, so hot customers are pre-reduced per task.
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("o_custkey").alias("ClienteId"), F.col("l_suppkey").alias("EmpresaId"))
            .distinct())


def services(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", ["l_suppkey", "l_partkey"], spread_by="l_partkey").distinct()
    p = read_table(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    return (li.join(p, li.l_partkey == p.p_partkey, "inner")
            .select(F.col("p_partkey").alias("Id"), F.col("p_name").alias("NombreServicio"),
                    F.col("p_type").alias("Descripcion"), F.col("l_suppkey").alias("CompanyId")))


def reasons(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", ["o_orderpriority"]).distinct()
    p = F.col("o_orderpriority")
    return o.select(F.substring(p, 1, 1).cast("bigint").alias("Id"),
                    F.concat(F.lit("R"), F.substring(p, 1, 1)).alias("CodigoMotivo"),
                    F.substr(p, F.lit(3)).alias("NombreMotivo"),
                    F.concat(F.lit("Orders with priority "), p).alias("Descripcion"))


def protocols(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"], spread_by="o_orderkey")
    return o.select(F.col("o_orderkey").alias("Id"),
                    F.concat(F.lit("Protocol "), F.col("o_orderkey").cast("string")).alias("NombreProtocolo"),
                    F.col("o_orderstatus").alias("Descripcion"),
                    F.substring("o_orderpriority", 1, 1).cast("bigint").alias("ReasonId"))


def protocol_steps(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"], spread_by="l_orderkey")
    return li.select(F.col("l_orderkey").alias("ProtocolId"),
                     F.col("l_linenumber").alias("CodigoPasoProtocolo"),
                     F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" part "),
                              F.col("l_partkey").cast("string")).alias("PasoProtocolo"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Flat transcript items: one row per (call, position)."""
    c = read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("pos"), "role", "text")


def turns_with_closings(spark: SparkSession, d: str) -> DataFrame:
    """Turns where the last assistant turn of each call carries one of the
    prescribed closing phrases, chosen by ``call_id % 5`` (FIXTURES.md)."""
    t = turns(spark, d)
    last = (t.filter(F.col("role") == "assistant").groupBy("call_id")
            .agg(F.max("pos").alias("last_pos")))
    k = F.col("call_id") % 5
    phrase = (F.when(k == 0, F.lit(" He encontrado una solución verificada. Qué bueno haberle ayudado."))
              .when(k == 1, F.lit(" No se encontró una solución verificada, le ofrezco una solución generada por IA. Me alegra que haya podido resolver su problema."))
              .when(k == 2, F.lit(" ¿Desea ser transferido a una persona real para que le ayude?"))
              .when(k == 3, F.lit(" No pudo ser identificado como un usuario registrado."))
              .otherwise(F.lit("")))
    return (t.join(last, "call_id", "left")
            .withColumn("text", F.when(F.col("pos") == F.col("last_pos"), F.concat(F.col("text"), phrase))
                        .otherwise(F.col("text")))
            .drop("last_pos"))


def call_turns(spark: SparkSession, d: str) -> DataFrame:
    """``turns_with_closings`` in every shape the call rules tell apart: some
    calls without any text, some opened by a greeting or by a solution before
    the client spoke, some turns interrupted (FIXTURES.md)."""
    t = turns_with_closings(spark, d)
    mute = F.col("call_id") % 11 == 5
    spoken = t.select("call_id", (F.col("pos") + 2).alias("pos"), "role", F.when(~mute, F.col("text")).alias("text"),
                      ((F.col("role") == "assistant") & ((F.col("call_id") + F.col("pos")) % 3 == 0)).alias("interrupted"))
    ids = t.filter(~mute).select("call_id").distinct()

    def opening(keep, pos: int, text: str) -> DataFrame:
        return ids.filter(keep).select("call_id", F.lit(pos).alias("pos"), F.lit("assistant").alias("role"),
                                       F.lit(text).alias("text"), F.lit(False).alias("interrupted"))
    return (spoken.unionByName(opening(F.col("call_id") % 6 == 2, 0, EARLY_SOLUTION))
            .unionByName(opening(F.col("call_id") % 4 == 1, 1, GREETING)))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls register: one row per conversation. Start is a fixed origin plus
    the call id in minutes; end adds 30 seconds per item."""
    t = turns(spark, d)
    g = t.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_items"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("call_id").cast("int"), F.lit(0))
    return g.select(
        "call_id",
        F.concat(F.lit("room-"), F.col("call_id").cast("string")).alias("room_name"),
        start.alias("started_at"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("n_items") * 30).cast("decimal(18,6)"))).alias("ended_at"),
        F.concat(F.lit("transcripts/transcript_"), F.date_format(start, "yyyy-MM-dd_HH-mm-ss"), F.lit("_"),
                 F.col("call_id").cast("string"), F.lit(".json")).alias("transcript_path"))


def eval_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per call (prompt missing when ``call_id % 7 == 3``), a second
    one with another prompt for every third call, and one per call for an id that
    does not exist, sent twice for every fifth."""
    ids = read_table(spark, d, "conversations", ["conv_id"]).distinct()
    known = ids.select(F.col("conv_id").alias("call_id"),
                       F.when(F.col("conv_id") % 7 == 3, F.lit(None).cast("string"))
                       .otherwise(F.lit(EVAL_PROMPT)).alias("evaluation_prompt"))
    unknown = ids.select((F.col("conv_id") + F.lit(NOT_FOUND_OFFSET)).alias("call_id"),
                         F.lit(EVAL_PROMPT).alias("evaluation_prompt"))
    second = ids.filter(F.col("conv_id") % 3 == 1).select(F.col("conv_id").alias("call_id"),
                                                           F.lit(SECOND_PROMPT).alias("evaluation_prompt"))
    again = unknown.filter((F.col("call_id") - F.lit(NOT_FOUND_OFFSET)) % 5 == 0)
    return known.unionByName(second).unionByName(unknown).unionByName(again)


def people(spark: SparkSession, d: str) -> DataFrame:
    """Registered names: first two words of every document, accents folded, lower case."""
    doc = read_table(spark, d, "documents", ["doc_id", "text"])
    words = F.regexp_extract_all(F.lower(fold_accents("text")), F.lit("[a-z]+"), F.lit(0))
    return (doc.select(F.col("doc_id").alias("person_id"),
                       F.array_join(F.slice(words, 1, 2), " ").alias("full_name")))


def spoken_names(spark: SparkSession, d: str) -> DataFrame:
    """Every registered name as heard on a call: the first ``n`` becomes ``m``."""
    p = people(spark, d)
    return p.select(F.col("person_id").alias("query_id"),
                    F.regexp_replace("full_name", "^([^n]*)n", "$1m").alias("spoken"))


def caller_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the caller of every registered name says: the last word alone, the words
    swapped, both inside a sentence, the second letter left out, or a letter changed."""
    p = people(spark, d).select(F.col("person_id").alias("query_id"), "full_name",
                                F.substring_index("full_name", " ", 1).alias("a"), F.substring_index("full_name", " ", -1).alias("b"))
    name = F.col("full_name")
    text = (F.when(F.col("query_id") % 5 == 0, F.col("b")).when(F.col("query_id") % 5 == 1, F.concat_ws(" ", "b", "a"))
            .when(F.col("query_id") % 5 == 2, F.concat(F.lit("Soy "), name, F.lit(", de la empresa.")))
            .when(F.col("query_id") % 5 == 3, F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1 << 20)))
            .otherwise(F.regexp_replace(name, "^([^n]*)n", "$1m")))
    return p.select("query_id", text.alias("spoken"))


# ---------------------------------------------------------------- DuckDB CTEs
SQL = {
    "companies": """SELECT s_suppkey AS Id, 'EM' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS Codigo,
        s_name AS Nombre, n_name AS Ciudad FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "clients": """SELECT c_custkey AS Id, c_mktsegment || '-' || CAST(c_custkey AS VARCHAR) AS CodigoCliente,
        c_name AS NombreCompleto FROM customer""",
    "client_companies": """SELECT DISTINCT o_custkey AS ClienteId, l_suppkey AS EmpresaId
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "services": """SELECT p_partkey AS Id, p_name AS NombreServicio, p_type AS Descripcion, l_suppkey AS CompanyId
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) li JOIN part ON l_partkey = p_partkey""",
    "reasons": """SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS Id, 'R' || substr(o_orderpriority, 1, 1) AS CodigoMotivo,
        substr(o_orderpriority, 3) AS NombreMotivo, 'Orders with priority ' || o_orderpriority AS Descripcion
        FROM (SELECT DISTINCT o_orderpriority FROM orders) o""",
    "protocols": """SELECT o_orderkey AS Id, 'Protocol ' || CAST(o_orderkey AS VARCHAR) AS NombreProtocolo,
        o_orderstatus AS Descripcion, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ReasonId FROM orders""",
    "protocol_steps": """SELECT l_orderkey AS ProtocolId, l_linenumber AS CodigoPasoProtocolo,
        l_returnflag || l_linestatus || ' part ' || CAST(l_partkey AS VARCHAR) AS PasoProtocolo FROM lineitem""",
    "turns": """SELECT conv_id AS call_id, turn AS pos, role, text FROM conversations""",
    "turns_with_closings": """SELECT t.call_id, t.pos, t.role,
        CASE WHEN t.pos = l.last_pos THEN t.text || CASE t.call_id % 5
            WHEN 0 THEN ' He encontrado una solución verificada. Qué bueno haberle ayudado.'
            WHEN 1 THEN ' No se encontró una solución verificada, le ofrezco una solución generada por IA. Me alegra que haya podido resolver su problema.'
            WHEN 2 THEN ' ¿Desea ser transferido a una persona real para que le ayude?'
            WHEN 3 THEN ' No pudo ser identificado como un usuario registrado.'
            ELSE '' END ELSE t.text END AS text
        FROM (SELECT conv_id AS call_id, turn AS pos, role, text FROM conversations) t
        LEFT JOIN (SELECT conv_id AS call_id, max(turn) AS last_pos FROM conversations WHERE role = 'assistant' GROUP BY 1) l
        ON t.call_id = l.call_id""",
    "call_turns": f"""SELECT call_id, pos + 2 AS pos, role, CASE WHEN call_id % 11 <> 5 THEN text END AS text,
        role = 'assistant' AND (call_id + pos) % 3 = 0 AS interrupted FROM turns_with_closings
        UNION ALL SELECT DISTINCT call_id, 0, 'assistant', '{EARLY_SOLUTION}', false FROM turns_with_closings
        WHERE call_id % 6 = 2 AND call_id % 11 <> 5
        UNION ALL SELECT DISTINCT call_id, 1, 'assistant', '{GREETING}', false FROM turns_with_closings
        WHERE call_id % 4 = 1 AND call_id % 11 <> 5""",
    "calls": """SELECT conv_id AS call_id, 'room-' || CAST(conv_id AS VARCHAR) AS room_name,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS INTEGER)) AS started_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS INTEGER)) + to_seconds(count(*) * 30) AS ended_at,
        'transcripts/transcript_' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS INTEGER)), '%Y-%m-%d_%H-%M-%S')
          || '_' || CAST(conv_id AS VARCHAR) || '.json' AS transcript_path
        FROM conversations GROUP BY conv_id""",
    "eval_requests": f"""SELECT conv_id AS call_id, CASE WHEN conv_id % 7 = 3 THEN NULL ELSE '{EVAL_PROMPT}' END AS evaluation_prompt
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        UNION ALL SELECT conv_id, '{SECOND_PROMPT}' FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE conv_id % 3 = 1
        UNION ALL SELECT conv_id + {NOT_FOUND_OFFSET}, '{EVAL_PROMPT}' FROM (SELECT DISTINCT conv_id FROM conversations) c
        UNION ALL SELECT conv_id + {NOT_FOUND_OFFSET}, '{EVAL_PROMPT}' FROM (SELECT DISTINCT conv_id FROM conversations) c
        WHERE conv_id % 5 = 0""",
    "people": f"""SELECT doc_id AS person_id,
        array_to_string(regexp_extract_all(lower({fold_accents_sql('text')}), '[a-z]+')[1:2], ' ') AS full_name
        FROM documents""",
    "spoken_names": "SELECT person_id AS query_id, regexp_replace(full_name, '^([^n]*)n', '\\1m') AS spoken FROM people",
    "caller_texts": """SELECT person_id AS query_id, CASE person_id % 5
        WHEN 0 THEN split_part(full_name, ' ', -1) WHEN 1 THEN split_part(full_name, ' ', -1) || ' ' || split_part(full_name, ' ', 1)
        WHEN 2 THEN 'Soy ' || full_name || ', de la empresa.'
        WHEN 3 THEN substr(full_name, 1, 1) || substr(full_name, 3) ELSE regexp_replace(full_name, '^([^n]*)n', '\\1m') END AS spoken
        FROM people""",
}


def with_fixtures(select_sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the fixture CTEs it uses."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    if not names:
        return select_sql
    body = select_sql.lstrip()
    if body[:5].upper() == "WITH ":  # merge the query's own CTEs after ours
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{select_sql}"
