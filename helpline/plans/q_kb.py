"""Knowledge-base export queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.operators import kb
from helpline.plans.catalog import register
from helpline.plans.sqltext import doc_id, lit
from helpline.sources import fixtures as fx
from helpline.sources.fixtures import with_fixtures as W

ALL = ("companies", "clients", "client_companies", "services", "reasons", "protocols", "protocol_steps")


def _t(spark, d):
    return {n: getattr(fx, n)(spark, d) for n in ALL}


# ---------------------------------------------------------------- SQL pieces
A1_SQL = f"""SELECT cc.ClienteId AS client_id, CAST(0 AS BIGINT) AS page_no,
    string_agg(CAST(e.Id AS VARCHAR), ', ' ORDER BY e.Id) AS enterprise_ids,
    string_agg(e.Nombre, ', ' ORDER BY e.Id) AS enterprise_names, count(*) AS n_companies
    FROM client_companies cc JOIN companies e ON e.Id = cc.EmpresaId GROUP BY 1, 2"""

P1_SQL = """SELECT 'enterprise_' || CAST(Id AS VARCHAR) AS doc_id, Id AS entity_id, CAST(0 AS BIGINT) AS page_no,
    Nombre AS title, to_json({'enterprise_id': Codigo, 'name': Nombre, 'type': 'Company', 'phoneNumber': '',
    'email': '', 'city': Ciudad, 'address': ''}) AS body FROM companies"""

P2_SQL = f"""SELECT {doc_id('client_', 'c.Id', 'l.page_no')} AS doc_id, c.Id AS entity_id, l.page_no,
    c.NombreCompleto AS title, l.enterprise_ids, l.enterprise_names,
    to_json({{'client_id': CAST(c.Id AS VARCHAR), 'name': c.NombreCompleto, 'enterprise_id': l.enterprise_ids,
      'enterprise_name': l.enterprise_names, 'type': 'client', 'carnetIdentidad': '', 'email': '',
      'phoneNumber': '', 'address': ''}}) AS body
    FROM ({A1_SQL}) l JOIN clients c ON c.Id = l.client_id"""

A4_SQL = f"""SELECT cc.EmpresaId AS company_id, CAST(0 AS BIGINT) AS page_no,
    list({{'client_id': CAST(c.Id AS VARCHAR), 'name': c.NombreCompleto, 'type': 'client', 'carnetIdentidad': '',
      'email': '', 'phoneNumber': '', 'address': ''}} ORDER BY c.Id) AS clients,
    string_agg(CAST(c.Id AS VARCHAR), ', ' ORDER BY c.Id) AS client_ids, count(*) AS n_clients
    FROM client_companies cc JOIN clients c ON c.Id = cc.ClienteId GROUP BY 1, 2"""

P3_SQL = f"""SELECT {doc_id('clients_enterprise_', 'g.company_id', 'g.page_no')} AS doc_id, g.company_id AS entity_id,
    g.page_no, e.Nombre AS title, g.n_clients,
    to_json({{'enterprise_ids': CAST(g.company_id AS VARCHAR), 'enterprises_names': e.Nombre, 'clients': g.clients}}) AS body
    FROM ({A4_SQL}) g JOIN companies e ON e.Id = g.company_id"""

A3_SQL = f"""SELECT CompanyId AS company_id, CAST(0 AS BIGINT) AS page_no,
    list({{'service_id': CAST(Id AS VARCHAR), 'name': NombreServicio, 'description': Descripcion, 'type': 'service'}} ORDER BY Id) AS services,
    string_agg(CAST(Id AS VARCHAR), ', ' ORDER BY Id) AS service_ids, count(*) AS n_services
    FROM services GROUP BY 1, 2"""

P4_SQL = f"""SELECT {doc_id('services_enterprise_', 'g.company_id', 'g.page_no')} AS doc_id, g.company_id AS entity_id,
    g.page_no, e.Nombre AS title, g.n_services,
    to_json({{'enterprise_id': CAST(g.company_id AS VARCHAR), 'enterprise_name': e.Nombre, 'services': g.services}}) AS body
    FROM ({A3_SQL}) g JOIN companies e ON e.Id = g.company_id"""

_LINE = "CAST(CodigoPasoProtocolo AS VARCHAR) || '. ' || PasoProtocolo"
A2_SQL = f"""SELECT ProtocolId AS protocol_id, CAST(0 AS BIGINT) AS page_no,
    string_agg({_LINE}, chr(10) ORDER BY CodigoPasoProtocolo, {_LINE}) AS steps, count({_LINE}) AS n_steps
    FROM protocol_steps GROUP BY 1, 2"""

P5_SQL = f"""SELECT {doc_id('protocol_', 'p.Id', 'coalesce(st.page_no, 0)')} AS doc_id, p.Id AS entity_id,
    coalesce(st.page_no, 0) AS page_no, p.NombreProtocolo AS title, st.steps IS NULL AS steps_defaulted,
    concat_ws(chr(10), '# ' || coalesce(p.NombreProtocolo, ''), '## protocol_id: ' || CAST(p.Id AS VARCHAR), '',
      '## Description', coalesce(p.Descripcion, ''), '', '## When to Use', coalesce(r.Descripcion, {lit(kb.WHEN_TO_USE_DEFAULT)}), '',
      '## Steps to Follow', coalesce(st.steps, {lit(kb.STEPS_DEFAULT)}), '', '## Resolution Options', {lit(kb.RESOLUTION_DEFAULT)}, '',
      '## Notes', '') AS body
    FROM protocols p JOIN reasons r ON p.ReasonId = r.Id LEFT JOIN ({A2_SQL}) st ON st.protocol_id = p.Id"""

A7_SQL = f"""SELECT count(*) AS n_clients, CASE WHEN count(*) > {kb.CLIENT_LAYOUT_THRESHOLD} THEN 'by_company' ELSE 'per_client' END AS layout
    FROM (SELECT DISTINCT client_id FROM ({A1_SQL}) a) x"""

CORPUS_SQL = f"""SELECT *, sha256(concat_ws('|', doc_kind, doc_id, body)) AS content_hash FROM (
    SELECT doc_id, 'company' AS doc_kind, entity_id, page_no, title, CAST(body AS VARCHAR) AS body FROM ({P1_SQL}) a
    UNION ALL SELECT doc_id, 'client', entity_id, page_no, title, CAST(body AS VARCHAR) AS body FROM ({P2_SQL}) b
    UNION ALL SELECT doc_id, 'services', entity_id, page_no, title, CAST(body AS VARCHAR) AS body FROM ({P4_SQL}) d
    UNION ALL SELECT doc_id, 'protocol', entity_id, page_no, title, CAST(body AS VARCHAR) AS body FROM ({P5_SQL}) e) u"""


def corpus(spark, d) -> DataFrame:
    t = _t(spark, d)
    return kb.corpus(t["companies"], t["clients"], t["client_companies"], t["services"], t["protocols"],
                     t["reasons"], t["protocol_steps"])


# ------------------------------------------------------------------- queries
@register("client_docs", W(P2_SQL, "companies", "clients", "client_companies"))
def q_client_docs(spark, d):
    """Flagship: which companies is each client registered with (J1 + A1 + P2)."""
    return kb.client_docs(fx.clients(spark, d), fx.client_companies(spark, d), fx.companies(spark, d))


@register("company_docs", W(P1_SQL, "companies"))
def q_company_docs(spark, d):
    return kb.company_docs(fx.companies(spark, d))


@register("client_docs_by_company", W(P3_SQL, "companies", "clients", "client_companies"))
def q_client_docs_by_company(spark, d):
    return kb.client_docs_by_company(fx.clients(spark, d), fx.client_companies(spark, d), fx.companies(spark, d))


@register("service_docs", W(P4_SQL, "companies", "services"))
def q_service_docs(spark, d):
    return kb.service_docs(fx.services(spark, d), fx.companies(spark, d))


@register("protocol_docs", W(P5_SQL, "reasons", "protocols", "protocol_steps"))
def q_protocol_docs(spark, d):
    return kb.protocol_docs(fx.protocols(spark, d), fx.reasons(spark, d), fx.protocol_steps(spark, d))


@register("clients_companies_join", W("""SELECT cc.ClienteId AS client_id, c.NombreCompleto AS client_name,
    cc.EmpresaId AS company_id, e.Nombre AS company_name FROM client_companies cc
    JOIN clients c ON c.Id = cc.ClienteId JOIN companies e ON e.Id = cc.EmpresaId""",
    "companies", "clients", "client_companies"))
def q_j1(spark, d):
    return kb.clients_companies_join(fx.clients(spark, d), fx.client_companies(spark, d), fx.companies(spark, d))


@register("services_companies_join", W("""SELECT s.Id AS service_id, s.NombreServicio AS service_name,
    s.CompanyId AS company_id, e.Nombre AS company_name FROM services s JOIN companies e ON e.Id = s.CompanyId""",
    "companies", "services"))
def q_j2(spark, d):
    return kb.services_companies_join(fx.services(spark, d), fx.companies(spark, d))


@register("protocols_reasons_join", W("""SELECT p.Id AS protocol_id, p.NombreProtocolo AS protocol_name,
    p.ReasonId AS reason_id, r.CodigoMotivo AS reason_code, r.NombreMotivo AS reason_name
    FROM protocols p JOIN reasons r ON r.Id = p.ReasonId""", "reasons", "protocols"))
def q_j3(spark, d):
    return kb.protocols_reasons_join(fx.protocols(spark, d), fx.reasons(spark, d))


@register("protocols_steps_left_join", W("""SELECT p.Id AS protocol_id, CAST(s.CodigoPasoProtocolo AS BIGINT) AS step_code,
    s.PasoProtocolo AS step_text FROM protocols p LEFT JOIN protocol_steps s ON s.ProtocolId = p.Id""",
    "protocols", "protocol_steps"))
def q_j4(spark, d):
    return kb.protocols_steps_left_join(fx.protocols(spark, d), fx.protocol_steps(spark, d))


@register("client_company_lists", W(A1_SQL, "companies", "client_companies"))
def q_a1(spark, d):
    return kb.client_company_lists(fx.client_companies(spark, d), fx.companies(spark, d))


@register("protocol_steps_text", W(A2_SQL, "protocol_steps"))
def q_a2(spark, d):
    return kb.protocol_steps_text(fx.protocol_steps(spark, d))


@register("services_by_company", W(f"""SELECT g.company_id, g.page_no, e.Nombre AS enterprise_name, g.service_ids,
    g.n_services, to_json(g.services) AS services_json FROM ({A3_SQL}) g JOIN companies e ON e.Id = g.company_id""",
    "companies", "services"))
def q_a3(spark, d):
    g = kb.services_by_company(fx.services(spark, d), fx.companies(spark, d))
    return g.select("company_id", "page_no", "enterprise_name",
                    F.array_join(F.transform("services", lambda x: x["service_id"]), ", ").alias("service_ids"),
                    "n_services", F.to_json("services").alias("services_json"))


@register("clients_by_company", W(f"""SELECT g.company_id, g.page_no, e.Nombre AS enterprise_name, g.client_ids,
    g.n_clients, to_json(g.clients) AS clients_json FROM ({A4_SQL}) g JOIN companies e ON e.Id = g.company_id""",
    "companies", "clients", "client_companies"))
def q_a4(spark, d):
    g = kb.clients_by_company(fx.clients(spark, d), fx.client_companies(spark, d), fx.companies(spark, d))
    return g.select("company_id", "page_no", "enterprise_name",
                    F.array_join(F.transform("clients", lambda x: x["client_id"]), ", ").alias("client_ids"),
                    "n_clients", F.to_json("clients").alias("clients_json"))


@register("first_name_per_company", W("""SELECT s.CompanyId AS company_id, e.Nombre AS enterprise_name,
    min(s.Id) AS first_service_id, arg_min(s.NombreServicio, s.Id) AS first_service_name
    FROM services s JOIN companies e ON e.Id = s.CompanyId GROUP BY s.CompanyId, e.Nombre""", "companies", "services"))
def q_a5(spark, d):
    return kb.first_name_per_company(fx.services(spark, d), fx.companies(spark, d))


@register("export_layout_policy", W(A7_SQL, "companies", "client_companies"))
def q_a7(spark, d):
    return kb.client_layout(kb.client_company_lists(fx.client_companies(spark, d), fx.companies(spark, d)))


@register("corpus_union", W(f"SELECT doc_id, doc_kind, entity_id, page_no, title, content_hash FROM ({CORPUS_SQL}) x", *ALL))
def q_u1(spark, d):
    return corpus(spark, d).select("doc_id", "doc_kind", "entity_id", "page_no", "title", "content_hash")


@register("export_counts", W(f"SELECT doc_kind, count(*) AS n_docs FROM ({CORPUS_SQL}) x GROUP BY 1", *ALL))
def q_a6(spark, d):
    return kb.export_counts(corpus(spark, d))


@register("find_documents_by_kind", W(f"""SELECT doc_id, entity_id, title FROM ({CORPUS_SQL}) x
    WHERE doc_kind = 'protocol' AND body LIKE '%## Steps to Follow%'""", *ALL))
def q_p9(spark, d):
    c = corpus(spark, d)
    return (c.filter((F.col("doc_kind") == "protocol") & F.col("body").contains("## Steps to Follow"))
            .select("doc_id", "entity_id", "title"))


@register("company_coverage", W("""SELECT e.Id AS company_id, e.Nombre AS company_name,
    coalesce(nc.n, 0) AS n_clients, coalesce(ns.n, 0) AS n_services FROM companies e
    LEFT JOIN (SELECT EmpresaId, count(*) AS n FROM client_companies GROUP BY 1) nc ON nc.EmpresaId = e.Id
    LEFT JOIN (SELECT CompanyId, count(*) AS n FROM services GROUP BY 1) ns ON ns.CompanyId = e.Id""",
    "companies", "client_companies", "services"))
def q_a12(spark, d):
    return kb.company_coverage(fx.companies(spark, d), fx.client_companies(spark, d), fx.services(spark, d))


# some rows gone from each side, so that every kind of dangling key is there
_GAPS = {"companies": "Id % 7 <> 3", "clients": "Id % 11 <> 5", "reasons": "Id <> 2", "client_companies": "ClienteId % 13 <> 4"}


def _gaps_sql(sql: str) -> str:
    for n, cond in _GAPS.items():
        sql = sql.replace(f"FROM {n} ", f"FROM (SELECT * FROM {n} WHERE {cond}) ")
    return sql


@register("dropped_by_join", W(_gaps_sql("""
    SELECT 'client_without_company' AS dropped_by, Id AS key_id FROM clients c
      WHERE NOT EXISTS (SELECT 1 FROM client_companies cc WHERE cc.ClienteId = c.Id)
    UNION ALL SELECT DISTINCT 'pair_without_company', EmpresaId FROM client_companies cc
      WHERE NOT EXISTS (SELECT 1 FROM companies e WHERE e.Id = cc.EmpresaId)
    UNION ALL SELECT DISTINCT 'pair_without_client', ClienteId FROM client_companies cc
      WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.Id = cc.ClienteId)
    UNION ALL SELECT 'service_without_company', Id FROM services s
      WHERE NOT EXISTS (SELECT 1 FROM companies e WHERE e.Id = s.CompanyId)
    UNION ALL SELECT 'protocol_without_reason', Id FROM protocols p
      WHERE NOT EXISTS (SELECT 1 FROM reasons r WHERE r.Id = p.ReasonId)"""), *ALL))
def q_j9(spark, d):
    t = {n: df.where(_GAPS[n]) if n in _GAPS else df for n, df in _t(spark, d).items()}
    return kb.dropped_by_join(t["clients"], t["client_companies"], t["companies"], t["services"],
                              t["protocols"], t["reasons"])


@register("scan_entities", W(" UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_known,
      CAST(sum(CAST('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM {n}"""
    for n in ALL for c in kb.REQUIRED[n]), *ALL))
def q_s1(spark, d):
    """Rows, known values and a checksum of the values of every required column."""
    t = _t(spark, d)
    parts = []
    for n, df in t.items():
        told = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_known"), F.sum(
            F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 8), 16, 10).cast("bigint")).alias("checksum")) for c in kb.REQUIRED[n]]
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*told).alias("c"))
        parts.append(one.select(F.lit(n).alias("table_name"), "n_rows", F.explode("c").alias("c")).select("table_name", "c.column_name", "n_rows", "c.n_known", "c.checksum"))
    return reduce(DataFrame.unionByName, parts)


def _readiness_sql() -> str:
    parts = []
    for n in ALL:
        for c in kb.REQUIRED[n] + kb.OPTIONAL.get(n, []):
            present = c in _FIXTURE_COLUMNS[n]
            req = "true" if c in kb.REQUIRED[n] else "false"
            if present:
                parts.append(f"SELECT '{n}' AS table_name, '{c}' AS column_name, {req} AS required, true AS present, "
                             f"count(*) - count({c}) AS n_null FROM {n}")
            else:
                parts.append(f"SELECT '{n}' AS table_name, '{c}' AS column_name, {req} AS required, false AS present, "
                             f"CAST(NULL AS BIGINT) AS n_null")
    return " UNION ALL ".join(parts)


# columns the fixture mapping produces (used only to write the oracle text)
_FIXTURE_COLUMNS = {
    "companies": ["Id", "Codigo", "Nombre", "Ciudad"], "clients": ["Id", "CodigoCliente", "NombreCompleto"],
    "client_companies": ["ClienteId", "EmpresaId"], "services": ["Id", "NombreServicio", "Descripcion", "CompanyId"],
    "reasons": ["Id", "CodigoMotivo", "NombreMotivo", "Descripcion"],
    "protocols": ["Id", "NombreProtocolo", "Descripcion", "ReasonId"],
    "protocol_steps": ["ProtocolId", "CodigoPasoProtocolo", "PasoProtocolo"],
}


@register("source_readiness", W(_readiness_sql(), *ALL))
def q_s2(spark, d):
    return kb.source_readiness(_t(spark, d))


@register("ordered_groups", W(f"""SELECT g.company_id, g.page_no, e.Nombre AS enterprise_name, g.n_services
    FROM ({A3_SQL}) g JOIN companies e ON e.Id = g.company_id ORDER BY g.company_id, g.page_no""", "companies", "services"))
def q_l2(spark, d):
    """L2: groups in ascending key order -- sorting only at presentation."""
    g = kb.services_by_company(fx.services(spark, d), fx.companies(spark, d))
    return g.select("company_id", "page_no", "enterprise_name", "n_services").orderBy("company_id", "page_no")
