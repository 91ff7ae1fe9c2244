"""Knowledge-base export: operational tables -> one document per entity.

Joins run in Spark (Catalyst picks broadcast or sort-merge from runtime sizes
under AQE; nothing is force-broadcast), list aggregates are pre-aggregated per
(entity, page) before any join so fan-out never multiplies the lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpline.functions.columns import content_hash, nullif_empty, opt, ordered_join, page_of
from helpline.functions.parts import PART_BYTES, deal_parts

# Default texts of the protocol page (line breaks are real here).
WHEN_TO_USE_DEFAULT = "This protocol should be used when a customer calls about this specific issue."
STEPS_DEFAULT = "1. Greet the customer\n2. Identify the issue\n3. Follow the appropriate resolution path"
RESOLUTION_DEFAULT = ("- Option 1: Resolve immediately\n- Option 2: Escalate to supervisor\n"
                      "- Option 3: Create a ticket for follow-up")
CLIENT_LAYOUT_THRESHOLD = 1000

_JSON = {"ignoreNullFields": "false"}


def _doc_id(prefix: str, entity: str, page: str = "page_no") -> F.Column:
    return F.concat(F.lit(prefix), F.col(entity).cast("string"),
                    F.when(F.col(page) > 0, F.concat(F.lit("_p"), F.col(page).cast("string"))).otherwise(F.lit("")))


# ------------------------------------------------------------------ joins J1-J4
def clients_companies_join(clients: DataFrame, client_companies: DataFrame, companies: DataFrame) -> DataFrame:
    """Clients x ClientCompanies x Companies, inner, m:n."""
    cc = client_companies.select("ClienteId", "EmpresaId")
    c = clients.select(F.col("Id").alias("ClienteId"), F.col("NombreCompleto").alias("client_name"))
    e = companies.select(F.col("Id").alias("EmpresaId"), F.col("Nombre").alias("company_name"))
    return (cc.join(c, "ClienteId").join(e, "EmpresaId")
            .select(F.col("ClienteId").alias("client_id"), "client_name",
                    F.col("EmpresaId").alias("company_id"), "company_name"))


def services_companies_join(services: DataFrame, companies: DataFrame) -> DataFrame:
    """Services x Companies, inner N:1."""
    e = companies.select(F.col("Id").alias("CompanyId"), F.col("Nombre").alias("company_name"))
    return (services.join(e, "CompanyId")
            .select(F.col("Id").alias("service_id"), F.col("NombreServicio").alias("service_name"),
                    F.col("CompanyId").alias("company_id"), "company_name"))


def protocols_reasons_join(protocols: DataFrame, reasons: DataFrame) -> DataFrame:
    """Protocols x Reasons, inner N:1."""
    r = reasons.select(F.col("Id").alias("ReasonId"), "CodigoMotivo", F.col("NombreMotivo").alias("reason_name"),
                       F.col("Descripcion").alias("reason_description"))
    return (protocols.join(r, "ReasonId")
            .select(F.col("Id").alias("protocol_id"), F.col("NombreProtocolo").alias("protocol_name"),
                    F.col("ReasonId").alias("reason_id"), F.col("CodigoMotivo").alias("reason_code"), "reason_name"))


def protocols_steps_left_join(protocols: DataFrame, steps: DataFrame) -> DataFrame:
    """Protocols left-join ProtocolSteps (stepless protocols kept with NULLs)."""
    s = steps.select(F.col("ProtocolId").alias("Id"), "CodigoPasoProtocolo", "PasoProtocolo")
    return (protocols.select("Id").join(s, "Id", "left")
            .select(F.col("Id").alias("protocol_id"), F.col("CodigoPasoProtocolo").cast("bigint").alias("step_code"),
                    F.col("PasoProtocolo").alias("step_text")))


# ----------------------------------------------------------- aggregates A1-A5
def client_company_lists(client_companies: DataFrame, companies: DataFrame, page_span: int | None = None) -> DataFrame:
    """A1: per client (and page), company ids and names joined by ', ', both in
    company-id order so the two lists align."""
    e = companies.select(F.col("Id").alias("EmpresaId"), F.col("Nombre"))
    g = (client_companies.select("ClienteId", "EmpresaId").join(e, "EmpresaId")
         .groupBy("ClienteId", page_of("EmpresaId", page_span).alias("page_no"))
         .agg(F.array_sort(F.collect_list(F.struct("EmpresaId", "Nombre"))).alias("cs")))
    return g.select(F.col("ClienteId").alias("client_id"), "page_no",
                    ordered_join(F.col("cs"), "EmpresaId", ", ").alias("enterprise_ids"),
                    nullif_empty(ordered_join(F.col("cs"), "Nombre", ", ")).alias("enterprise_names"),
                    F.size("cs").cast("bigint").alias("n_companies"))


def protocol_steps_text(steps: DataFrame, page_span: int | None = None) -> DataFrame:
    """A2: ordered ``code. text`` lines per protocol, ties broken by the rendered
    line. A step whose code or text is NULL renders NULL and is skipped."""
    line = F.concat(F.col("CodigoPasoProtocolo").cast("string"), F.lit(". "), F.col("PasoProtocolo"))
    g = (steps.select("ProtocolId", F.col("CodigoPasoProtocolo").cast("bigint").alias("code"), line.alias("line"))
         .groupBy("ProtocolId", page_of(F.coalesce(F.col("code"), F.lit(0)), page_span).alias("page_no"))
         .agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("code", "line")))).alias("ls")))
    return g.select(F.col("ProtocolId").alias("protocol_id"), "page_no",
                    nullif_empty(ordered_join(F.col("ls"), "line", "\n")).alias("steps"),
                    F.size("ls").cast("bigint").alias("n_steps"))


def services_by_company(services: DataFrame, companies: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One document per company with its services, ascending id; a company whose
    services pass ``part_bytes`` has several, split by position (``parts.deal_parts``)."""
    def svc(sid, name, description):
        return F.struct(sid.cast("string").alias("service_id"), name.alias("name"), description.alias("description"),
                        F.lit("service").alias("type"))
    s = services.select("CompanyId", F.col("Id").alias("sid"), F.col("NombreServicio").alias("name"), opt(services, "Descripcion").alias("description"))
    s = deal_parts(s, "CompanyId", "sid", F.octet_length(F.to_json(svc(*map(F.col, ("sid", "name", "description"))))), part_bytes)
    # only what differs is moved; the rest of a service is put around it afterwards
    g = s.groupBy("CompanyId", "page_no").agg(F.array_sort(F.collect_list(F.struct("sid", "name", "description"))).alias("ss"))
    e = companies.select(F.col("Id").alias("CompanyId"), F.col("Nombre").alias("enterprise_name"))
    # the names go to the parts, so the lists stay where they were grouped
    named = s.select("CompanyId", "page_no").distinct().join(e, "CompanyId")
    return (g.join(named, ["CompanyId", "page_no"])
            .select(F.col("CompanyId").alias("company_id"), "page_no", "enterprise_name",
                    F.transform("ss", lambda x: svc(x["sid"], x["name"], x["description"])).alias("services"),
                    F.size("ss").cast("bigint").alias("n_services")))


def clients_by_company(clients: DataFrame, client_companies: DataFrame, companies: DataFrame,
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """The intent of the large-client layout -- exploded client-company
    pairs grouped by company, clients ascending by id; parts as in A3."""
    c = clients.select(F.col("Id").alias("ClienteId"), F.struct(
        F.col("Id").cast("string").alias("client_id"), F.col("NombreCompleto").alias("name"),
        F.lit("client").alias("type"), opt(clients, "Ci").alias("carnetIdentidad"),
        opt(clients, "Email").alias("email"), opt(clients, "NumeroTelf").alias("phoneNumber"),
        opt(clients, "Direccion").alias("address")).alias("cl"))
    pairs = client_companies.select("ClienteId", "EmpresaId").join(c, "ClienteId")
    g = (deal_parts(pairs, "EmpresaId", "ClienteId", F.octet_length(F.to_json("cl")), part_bytes)
         .groupBy("EmpresaId", "page_no")
         .agg(F.array_sort(F.collect_list(F.struct("ClienteId", "cl"))).alias("cs")))
    e = companies.select(F.col("Id").alias("EmpresaId"), F.col("Nombre").alias("enterprise_name"))
    return (g.join(e, "EmpresaId")
            .select(F.col("EmpresaId").alias("company_id"), "page_no", "enterprise_name",
                    F.transform("cs", lambda x: x["cl"]).alias("clients"),
                    F.size("cs").cast("bigint").alias("n_clients")))


def first_name_per_company(services: DataFrame, companies: DataFrame) -> DataFrame:
    """A5: first service (lowest id) per company -- min_by, never bare first()."""
    g = services.groupBy("CompanyId").agg(F.min("Id").alias("first_service_id"),
                                          F.min_by("NombreServicio", "Id").alias("first_service_name"))
    e = companies.select(F.col("Id").alias("CompanyId"), F.col("Nombre").alias("enterprise_name"))
    return g.join(e, "CompanyId").select(F.col("CompanyId").alias("company_id"), "enterprise_name",
                                         "first_service_id", "first_service_name")


# ------------------------------------------------------------ documents P1-P5
def company_docs(companies: DataFrame) -> DataFrame:
    """Company document; optional columns default to '' only when absent."""
    doc = F.struct(F.col("Codigo").cast("string").alias("enterprise_id"), F.col("Nombre").alias("name"),
                   F.lit("Company").alias("type"), opt(companies, "Telefono").alias("phoneNumber"),
                   opt(companies, "Email").alias("email"), opt(companies, "Ciudad").alias("city"),
                   opt(companies, "Direccion").alias("address"))
    return companies.select(F.concat(F.lit("enterprise_"), F.col("Id").cast("string")).alias("doc_id"),
                            F.col("Id").alias("entity_id"), F.lit(0).cast("bigint").alias("page_no"),
                            F.col("Nombre").alias("title"), F.to_json(doc, _JSON).alias("body"))


def client_docs(clients: DataFrame, client_companies: DataFrame, companies: DataFrame,
                page_span: int | None = None) -> DataFrame:
    """P2 = J1 + A1: one document per client listing its companies. The list is
    aggregated from the bridge first, then joined to the client row."""
    lists = client_company_lists(client_companies, companies, page_span)
    c = clients.select(F.col("Id").alias("client_id"), F.col("NombreCompleto").alias("name"),
                       opt(clients, "Ci").alias("carnetIdentidad"), opt(clients, "Email").alias("email"),
                       opt(clients, "NumeroTelf").alias("phoneNumber"), opt(clients, "Direccion").alias("address"))
    j = lists.join(c, "client_id")
    doc = F.struct(F.col("client_id").cast("string").alias("client_id"), F.col("name"),
                   F.col("enterprise_ids").alias("enterprise_id"), F.col("enterprise_names").alias("enterprise_name"),
                   F.lit("client").alias("type"), "carnetIdentidad", "email", "phoneNumber", "address")
    return j.select(_doc_id("client_", "client_id").alias("doc_id"), F.col("client_id").alias("entity_id"),
                    "page_no", F.col("name").alias("title"), "enterprise_ids", "enterprise_names",
                    F.to_json(doc, _JSON).alias("body"))


def client_docs_by_company(clients: DataFrame, client_companies: DataFrame, companies: DataFrame,
                           part_bytes: int = PART_BYTES) -> DataFrame:
    """Above the threshold, one document per company with nested clients."""
    g = clients_by_company(clients, client_companies, companies, part_bytes)
    doc = F.struct(F.col("company_id").cast("string").alias("enterprise_ids"),
                   F.col("enterprise_name").alias("enterprises_names"), F.col("clients"))
    return g.select(_doc_id("clients_enterprise_", "company_id").alias("doc_id"),
                    F.col("company_id").alias("entity_id"), "page_no", F.col("enterprise_name").alias("title"),
                    "n_clients", F.to_json(doc, _JSON).alias("body"))


def service_docs(services: DataFrame, companies: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Services of a company as one JSON document."""
    g = services_by_company(services, companies, part_bytes)
    doc = F.struct(F.col("company_id").cast("string").alias("enterprise_id"), F.col("enterprise_name"),
                   F.col("services"))
    return g.select(_doc_id("services_enterprise_", "company_id").alias("doc_id"),
                    F.col("company_id").alias("entity_id"), "page_no", F.col("enterprise_name").alias("title"),
                    "n_services", F.to_json(doc, _JSON).alias("body"))


def protocol_docs(protocols: DataFrame, reasons: DataFrame, steps: DataFrame, page_span: int | None = None) -> DataFrame:
    """P5 = J3 + J4 + A2: Markdown page per protocol. Steps are aggregated before
    the left join; NULL steps take the default text and are flagged."""
    st = protocol_steps_text(steps, page_span).withColumnRenamed("protocol_id", "Id")
    r = reasons.select(F.col("Id").alias("ReasonId"), F.col("Descripcion").alias("reason_description"))
    j = protocols.join(r, "ReasonId").join(st, "Id", "left")
    page = F.coalesce(F.col("page_no"), F.lit(0).cast("bigint"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce(F.col("NombreProtocolo"), F.lit(""))),
        F.concat(F.lit("## protocol_id: "), F.col("Id").cast("string")),
        F.lit(""), F.lit("## Description"), F.coalesce(F.col("Descripcion"), F.lit("")),
        F.lit(""), F.lit("## When to Use"), F.coalesce(F.col("reason_description"), F.lit(WHEN_TO_USE_DEFAULT)),
        F.lit(""), F.lit("## Steps to Follow"), F.coalesce(F.col("steps"), F.lit(STEPS_DEFAULT)),
        F.lit(""), F.lit("## Resolution Options"), F.lit(RESOLUTION_DEFAULT),
        F.lit(""), F.lit("## Notes"), F.lit(""))
    return j.select(F.concat(F.lit("protocol_"), F.col("Id").cast("string"),
                             F.when(page > 0, F.concat(F.lit("_p"), page.cast("string"))).otherwise(F.lit(""))).alias("doc_id"),
                    F.col("Id").alias("entity_id"), page.alias("page_no"), F.col("NombreProtocolo").alias("title"),
                    F.col("steps").isNull().alias("steps_defaulted"), body.alias("body"))


# ------------------------------------------------------------- corpus U1, A6-A7
DOC_COLUMNS = ["doc_id", "doc_kind", "entity_id", "page_no", "title", "body"]


def client_layout(client_lists: DataFrame, threshold: int = CLIENT_LAYOUT_THRESHOLD) -> DataFrame:
    """One row ``(n_clients, layout)``; layout 'by_company' above threshold."""
    n = client_lists.select("client_id").distinct().agg(F.count(F.lit(1)).alias("n_clients"))
    return n.select("n_clients", F.when(F.col("n_clients") > threshold, F.lit("by_company"))
                    .otherwise(F.lit("per_client")).alias("layout"))


def corpus(companies: DataFrame, clients: DataFrame, client_companies: DataFrame, services: DataFrame,
           protocols: DataFrame, reasons: DataFrame, steps: DataFrame,
           layout: str = "per_client", page_span: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document kind in one DataFrame with a content hash. ``layout``:
    'per_client' or 'by_company'; A7 reports which one a client count suggests,
    but a growing table never changes the layout of an export by itself."""
    if layout not in ("per_client", "by_company"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout == "by_company":
        cl = client_docs_by_company(clients, client_companies, companies, part_bytes).withColumn("doc_kind", F.lit("clients"))
    else:
        cl = client_docs(clients, client_companies, companies, page_span).withColumn("doc_kind", F.lit("client"))
    kinds = [
        company_docs(companies).withColumn("doc_kind", F.lit("company")),
        cl,
        service_docs(services, companies, part_bytes).withColumn("doc_kind", F.lit("services")),
        protocol_docs(protocols, reasons, steps, page_span).withColumn("doc_kind", F.lit("protocol")),
    ]
    u = reduce(DataFrame.unionByName, [k.select(*DOC_COLUMNS) for k in kinds])
    return u.withColumn("content_hash", content_hash("doc_kind", "doc_id", "body"))


def export_counts(docs: DataFrame) -> DataFrame:
    """Documents per kind."""
    return docs.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n_docs"))


def company_coverage(companies: DataFrame, client_companies: DataFrame, services: DataFrame) -> DataFrame:
    """Clients and services per company; each side aggregated before the
    join so the two many-sides never multiply."""
    nc = client_companies.groupBy(F.col("EmpresaId").alias("company_id")).agg(F.count(F.lit(1)).alias("n_clients"))
    ns = services.groupBy(F.col("CompanyId").alias("company_id")).agg(F.count(F.lit(1)).alias("n_services"))
    e = companies.select(F.col("Id").alias("company_id"), F.col("Nombre").alias("company_name"))
    return (e.join(nc, "company_id", "left").join(ns, "company_id", "left")
            .select("company_id", "company_name",
                    F.coalesce("n_clients", F.lit(0)).cast("bigint").alias("n_clients"),
                    F.coalesce("n_services", F.lit(0)).cast("bigint").alias("n_services")))


def dropped_by_join(clients: DataFrame, client_companies: DataFrame, companies: DataFrame,
                    services: DataFrame, protocols: DataFrame, reasons: DataFrame) -> DataFrame:
    """Keys the inner joins of the export lose, one anti join each. The keys
    of the pairs are made distinct first, so the joins sort keys, not pairs."""
    cid = companies.select(F.col("Id").alias("k"))
    client = clients.select(F.col("Id").alias("k"))
    pair_client = client_companies.select(F.col("ClienteId").alias("k")).distinct()
    pair_company = client_companies.select(F.col("EmpresaId").alias("k")).distinct()
    parts = [
        client.join(pair_client, "k", "left_anti").select(F.lit("client_without_company").alias("dropped_by"), F.col("k").alias("key_id")),
        pair_company.join(cid, "k", "left_anti").select(F.lit("pair_without_company").alias("dropped_by"), F.col("k").alias("key_id")),
        pair_client.join(client, "k", "left_anti").select(F.lit("pair_without_client").alias("dropped_by"), F.col("k").alias("key_id")),
        services.select(F.col("Id").alias("sid"), F.col("CompanyId").alias("k")).join(cid, "k", "left_anti")
        .select(F.lit("service_without_company").alias("dropped_by"), F.col("sid").alias("key_id")),
        protocols.select(F.col("Id").alias("pid"), F.col("ReasonId").alias("k"))
        .join(reasons.select(F.col("Id").alias("k")), "k", "left_anti")
        .select(F.lit("protocol_without_reason").alias("dropped_by"), F.col("pid").alias("key_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------- readiness S2
# Required and optional columns per operational table.
REQUIRED = {
    "companies": ["Id", "Codigo", "Nombre"], "clients": ["Id", "CodigoCliente", "NombreCompleto"],
    "client_companies": ["ClienteId", "EmpresaId"], "services": ["Id", "NombreServicio", "CompanyId"],
    "reasons": ["Id", "CodigoMotivo", "NombreMotivo", "Descripcion"],
    "protocols": ["Id", "NombreProtocolo", "Descripcion", "ReasonId"],
    "protocol_steps": ["ProtocolId", "CodigoPasoProtocolo", "PasoProtocolo"],
}
OPTIONAL = {"companies": ["Telefono", "Email", "Ciudad", "Direccion"],
            "clients": ["Ci", "Email", "NumeroTelf", "Direccion"], "services": ["Descripcion"]}


def check_tables(tables: dict[str, DataFrame], every: bool = True) -> None:
    """Raises an error that names all missing tables and required columns, before any
    job is started. ``every=False`` checks only the tables given."""
    lacks = {n: [c for c in cols if n not in tables or c not in tables[n].columns]
             for n, cols in REQUIRED.items() if every or n in tables}
    absent = [n for n in lacks if n not in tables]
    if absent:
        raise ValueError(f"missing source tables: {absent}")
    columns = {n: c for n, c in lacks.items() if c}
    if columns:
        raise ValueError(f"source tables lack required columns: {columns}")


def source_readiness(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and expected column: present?, NULL count (one scan per
    table, all columns in one aggregate). Raises if a required column is absent."""
    parts = []
    check_tables(tables, every=False)
    for n, df in tables.items():
        cols = REQUIRED[n] + OPTIONAL.get(n, [])
        present = [c for c in cols if c in df.columns]
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("n_null"))
                                     for c in present])).alias("s")
        rows = agg.select(stack).select(F.lit(n).alias("table_name"), "s.column_name",
                                        F.col("s.column_name").isin(REQUIRED[n]).alias("required"),
                                        F.lit(True).alias("present"), "s.n_null")
        parts.append(rows)
        absent = [c for c in cols if c not in df.columns]
        if absent:
            parts.append(agg.select(F.explode(F.array(*[F.lit(c) for c in absent])).alias("column_name"))
                         .select(F.lit(n).alias("table_name"), "column_name", F.lit(False).alias("required"),
                                 F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("n_null")))
    return reduce(DataFrame.unionByName, parts)
