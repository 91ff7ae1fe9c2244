import json

from helpline.operators import kb


def _companies(spark, with_email=None):
    if with_email is None:
        return spark.createDataFrame([(1, "EM1", "Acme"), (2, "EM2", "Beta")], "Id long, Codigo string, Nombre string")
    return spark.createDataFrame([(1, "EM1", "Acme", with_email), (2, "EM2", "Beta", None)],
                                 "Id long, Codigo string, Nombre string, Email string")


def test_optional_column_absent_vs_null(spark):
    absent = {r["doc_id"]: json.loads(r["body"]) for r in kb.company_docs(_companies(spark)).collect()}
    assert absent["enterprise_1"]["email"] == ""
    present = {r["doc_id"]: json.loads(r["body"]) for r in kb.company_docs(_companies(spark, "a@b")).collect()}
    assert present["enterprise_1"]["email"] == "a@b"
    assert present["enterprise_2"]["email"] is None  # NULL kept as null, not defaulted


def test_client_company_lists_aligned_and_ordered(spark):
    comp = spark.createDataFrame([(3, "C3", "Gamma"), (1, "C1", "Alpha"), (2, "C2", "Beta")], "Id long, Codigo string, Nombre string")
    cc = spark.createDataFrame([(10, 3), (10, 1), (11, 2)], "ClienteId long, EmpresaId long")
    rows = {r["client_id"]: r for r in kb.client_company_lists(cc, comp).collect()}
    assert rows[10]["enterprise_ids"] == "1, 3" and rows[10]["enterprise_names"] == "Alpha, Gamma"
    assert rows[11]["n_companies"] == 1


def test_pages_bound_group_size(spark):
    comp = spark.createDataFrame([(i, f"C{i}", f"N{i}") for i in range(1, 8)], "Id long, Codigo string, Nombre string")
    cc = spark.createDataFrame([(1, i) for i in range(1, 8)], "ClienteId long, EmpresaId long")
    rows = kb.client_company_lists(cc, comp, page_span=3).collect()
    assert sorted(r["page_no"] for r in rows) == [0, 1, 2]
    assert max(r["n_companies"] for r in rows) <= 3
    assert sum(r["n_companies"] for r in rows) == 7


def test_protocol_steps_null_and_stepless(spark):
    protocols = spark.createDataFrame([(1, "P1", "d1", 1), (2, "P2", "d2", 1)],
                                      "Id long, NombreProtocolo string, Descripcion string, ReasonId long")
    reasons = spark.createDataFrame([(1, "R1", "why", "when text")], "Id long, CodigoMotivo string, NombreMotivo string, Descripcion string")
    steps = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, None), (1, 10, "tenth")],
                                  "ProtocolId long, CodigoPasoProtocolo int, PasoProtocolo string")
    docs = {r["entity_id"]: r for r in kb.protocol_docs(protocols, reasons, steps).collect()}
    assert "1. first\n2. second\n10. tenth" in docs[1]["body"]  # numeric order, NULL step skipped
    assert not docs[1]["steps_defaulted"]
    assert docs[2]["steps_defaulted"] and kb.STEPS_DEFAULT in docs[2]["body"]
    assert "when text" in docs[1]["body"]
    assert " n-" not in docs[1]["body"]  # real line breaks in the defaults


def test_layout_threshold(spark):
    lists = spark.createDataFrame([(i, 0) for i in range(5)], "client_id long, page_no long")
    assert kb.client_layout(lists, threshold=4).first()["layout"] == "by_company"
    assert kb.client_layout(lists, threshold=5).first()["layout"] == "per_client"


def test_dropped_by_join(spark):
    clients = spark.createDataFrame([(1, "c1", "A"), (2, "c2", "B")], "Id long, CodigoCliente string, NombreCompleto string")
    comp = spark.createDataFrame([(1, "E1", "X")], "Id long, Codigo string, Nombre string")
    cc = spark.createDataFrame([(1, 1), (1, 9)], "ClienteId long, EmpresaId long")
    services = spark.createDataFrame([(5, "s", "d", 7)], "Id long, NombreServicio string, Descripcion string, CompanyId long")
    protocols = spark.createDataFrame([(1, "P", "d", 4)], "Id long, NombreProtocolo string, Descripcion string, ReasonId long")
    reasons = spark.createDataFrame([(1, "R", "n", "d")], "Id long, CodigoMotivo string, NombreMotivo string, Descripcion string")
    got = {(r[0], r[1]) for r in kb.dropped_by_join(clients, cc, comp, services, protocols, reasons).collect()}
    assert got == {("client_without_company", 2), ("pair_without_company", 9),
                   ("service_without_company", 5), ("protocol_without_reason", 1)}


def test_dropped_by_join_joins_distinct_keys_of_the_pairs(spark):
    empty = spark.createDataFrame([], "Id long, CompanyId long, ReasonId long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (None, 2), (None, 2), (4, None)], "ClienteId long, EmpresaId long")
    clients = spark.createDataFrame([(1,), (9,), (9,), (None,)], "Id long")
    companies = spark.createDataFrame([(2,)], "Id long")
    out = kb.dropped_by_join(clients, pairs, companies, empty, empty, empty)
    assert out._jdf.queryExecution().analyzed().toString().count("Deduplicate [k") == 3  # keys, before the joins
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(
        [("client_without_company", 9)] * 2 + [("client_without_company", None), ("pair_without_client", 4), ("pair_without_client", None),
                                               ("pair_without_company", 3), ("pair_without_company", None)], key=key)
