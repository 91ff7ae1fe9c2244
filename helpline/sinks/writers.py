"""Sinks: documents (K1), Markdown pages (K2), transcripts (K4) and the calls register
(K5); the index (K3) is in ``index``. Writers are partitioned Spark
writes -- never one driver-side file per row; each row keeps the path it would
have had as a column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpline.operators.calls import first_of_rooms
from helpline.session import cut_lineage, materialize


MAX_DOCS_PER_FILE = 10_000  # transcripts of a part file
# Files of documents hold about this many bytes.
FILE_BYTES = 64 << 20
# Pages of a Markdown part file are separated by a form feed (the plain-text
# page break). In a page, ESC f stands for a form feed and ESC ESC for the escape character.
PAGE_BREAK, ESCAPE = "\f", "\x1b"
PAGE_HEAD, PAGE_HEAD_END = "<!-- ", " -->\n"


def _write_kinds(docs: DataFrame, path: str, mode: str, file_bytes: int, stored: bool, form: str, line=None, **options: str) -> None:
    """``docs``, written once as a table unless ``stored`` (their bytes are counted), then kind by
    kind from where they lie, without moving them: a kind's files are cut after as many
    documents as hold about ``file_bytes`` before compression."""
    docs = docs if stored else materialize(docs, "documents-to-write")
    spark, kinds = docs.sparkSession, [c for c in ("doc_kind",) if c in docs.columns]
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "ignore" and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return

    def writer(some: DataFrame):
        return (some if line is None else some.select(line.alias("value"), *[c for c in kinds if c in some.columns])).write.options(compression="gzip", **options).format(form)
    none = writer(docs.limit(0)).mode(mode)  # clears the folder, or refuses it, as ``mode`` says
    (none.partitionBy(*kinds) if kinds else none).save(path)
    sizes = docs.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"))
    for r in sizes.collect():  # one row per kind
        own, to = docs, path
        if kinds:
            own = docs.where(F.col("doc_kind").eqNullSafe(F.lit(r["doc_kind"]))).drop("doc_kind")
            to = f"{path}/{spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString('doc_kind', r['doc_kind'])}"
        if r["n"]:
            writer(own).mode("append").option("maxRecordsPerFile", max(1, file_bytes * r["n"] // max(1, r["bytes"]))).save(to)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES, stored: bool = False) -> None:
    """K1: JSON lines (gzip) partitioned by kind, with ``doc_path`` as the logical name.
    ``stored``: ``docs`` are a written table, cheap to read twice."""
    out = docs.withColumn("doc_path", F.concat(F.col("doc_id"), F.lit(".json")))
    _write_kinds(out, path, mode, file_bytes, stored, "json", ignoreNullFields="false")


def write_markdown(pages: DataFrame, path: str, mode: str = "overwrite", file_bytes: int = FILE_BYTES, stored: bool = False) -> None:
    """K2: Markdown pages as text files (gzip), pages separated by PAGE_BREAK, partitioned by
    kind. A page opens with a Markdown comment that holds its other columns as JSON, so it
    reads back with its ``doc_id``; any body survives."""
    kept = [c for c in pages.columns if c not in ("body", "doc_kind")]
    head = F.to_json(F.struct(*kept)) if kept else F.lit("{}")
    head = F.replace(head, F.lit(">"), F.lit("\\u003e"))  # no text closes the comment
    body = F.replace(F.replace(F.coalesce("body", F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(PAGE_BREAK), F.lit(ESCAPE + "f"))
    page = F.concat(F.lit(PAGE_HEAD), F.replace(head, F.lit(PAGE_BREAK), F.lit("\\f")), F.lit(PAGE_HEAD_END), body)
    _write_kinds(pages, path, mode, file_bytes, stored, "text", page, lineSep=PAGE_BREAK)


def read_markdown(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pages written by ``write_markdown``: ``body``, ``head`` (JSON of the other columns)
    and the partition column; ``schema``: columns to take out of the head."""
    raw = spark.read.text(path, lineSep=PAGE_BREAK).where(F.col("value") != "")
    end = F.locate(PAGE_HEAD_END, F.col("value"))
    said = F.substr("value", end + len(PAGE_HEAD_END))
    # doubled escapes pair up from the left
    parts = F.transform(F.split(said, ESCAPE * 2, -1), lambda p: F.replace(p, F.lit(ESCAPE + "f"), F.lit(PAGE_BREAK)))
    out = raw.select("*", F.substr("value", F.lit(len(PAGE_HEAD) + 1), end - len(PAGE_HEAD) - 1).alias("head"),
                     F.array_join(parts, ESCAPE).alias("body"))
    if schema:
        out = out.select("*", F.from_json("head", schema).alias("_h")).select("*", "_h.*").drop("_h")
    return out.drop("value")


def _read_if_there(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The Parquet table, or None if the path does not exist; other errors rise."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_transcripts(transcripts: DataFrame, path: str, mode: str = "append") -> None:
    """K4: JSON lines, one object per (call, page) with its file name as a
    field (read back with ``scan_transcripts(..., multi_line=False)``)."""
    cols = [c for c in ("call_id", "page_no", "file_name", "transcript_path", "items") if c in transcripts.columns]
    (transcripts.select(*cols).write.mode(mode).option("maxRecordsPerFile", MAX_DOCS_PER_FILE)
     .option("ignoreNullFields", "false").json(path))


def append_calls(new_calls: DataFrame, register_path: str) -> int:
    """K5: idempotent append to the calls register: rows whose ``room_name`` is
    already registered are skipped; of rows repeated in the batch the earliest
    (then the one of least id) is kept."""
    spark = new_calls.sparkSession
    batch = first_of_rooms(new_calls)
    existing = _read_if_there(spark, register_path)  # the first write creates the register
    if existing is not None:
        batch = batch.join(existing.select("room_name"), "room_name", "left_anti")
    # the batch reads the register it appends to: cut lineage first with a
    # reliable checkpoint in the shared spark.checkpoint.dir
    batch = cut_lineage(batch)
    n = batch.count()
    if n:
        batch.write.mode("append").parquet(register_path)
    return n
