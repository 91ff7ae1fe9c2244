"""File sources: a folder of documents (S3), transcript JSON files (S4),
evaluation requests (S8) and the persisted index (S6). All are Spark readers
with explicit schemas; file metadata comes from the ``_metadata`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpline.functions.columns import request_key
from helpline.schemas import EVAL_REQUEST, TRANSCRIPT, TRANSCRIPT_LINE

# MIME type by file extension.
MIME = {"json": "application/json", "md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf"}
TRANSCRIPT_NAME = r"transcript_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})(?:_(\d+))?\.json$"


def _file_columns() -> list:
    """Path, name, size and modification time of the file that a row comes from."""
    return [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file_path"), ("file_name", "file_name"), ("file_size", "file_size"),
                                                          ("file_modification_time", "last_modified"))]


def scan_document_dir(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """S3: every file of a folder as one document (whole text) with path, name,
    type, size and modification time. One row per file; files are split over
    tasks by Spark's file source. ``recursive`` also reads sub-folders (and
    turns partition discovery off)."""
    # wholetext must be a keyword: text() re-sets its own default (False) over
    # an earlier .option("wholetext", True)
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    ext = F.lower(F.regexp_extract(F.col("_metadata.file_name"), r"\.([^.]+?)(?:\.gz)?$", 1))
    mime = F.lit(None).cast("string")
    for e, m in MIME.items():
        mime = F.when(ext == e, F.lit(m)).otherwise(mime)
    path_, name, size, date = _file_columns()
    return df.select(F.col("_metadata.file_name").alias("doc_id"), path_, name, mime.alias("file_type"), size, date, F.col("value").alias("text"))


DOCUMENT = "doc_id string, entity_id long, page_no long, title string, body string, content_hash string"


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3: the documents of a knowledge-base folder, one row each with its id, whatever
    file holds it: JSON lines (``write_documents``) and Markdown pages
    (``write_markdown``), with the kind of their sub-folder. Files of both are split over
    tasks by Spark; none is read whole. A document that both hold comes twice, told apart
    by ``file_type``. Every document has the path, name, size and date of its file."""
    from helpline.sinks.writers import read_markdown
    columns = [c.split()[0] for c in DOCUMENT.split(", ")]

    def found(df: DataFrame, ext: str) -> DataFrame:
        return df.select("doc_kind", *columns, F.lit(MIME[ext]).alias("file_type"), *_file_columns())
    json = spark.read.schema(DOCUMENT + ", doc_kind string").option("pathGlobFilter", "*.{json,json.gz}").option("basePath", path).json(f"{path}/json")
    pages = read_markdown(spark, f"{path}/md", DOCUMENT.replace("body string, ", ""))
    return found(json, "json").unionByName(found(pages, "md"))


def scan_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transcript files ``{"items": [...]}``. ``multi_line=True`` is the
    stored layout, one (pretty-printed) transcript per file, named
    ``transcript_<yyyy-MM-dd_HH-mm-ss>[_<call id>].json``; ``False`` reads the
    JSON lines of ``write_transcripts``, where each line carries its call id,
    page, file name and path. Malformed records are kept with ``malformed`` set; a
    record without ``items`` yields an empty list. The call time (and id, when
    present) come from the file name."""
    schema = TRANSCRIPT if multi_line else TRANSCRIPT_LINE
    df = (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    name = F.col("_metadata.file_name") if multi_line else F.col("file_name")
    stamp = F.regexp_extract(name, TRANSCRIPT_NAME, 1)
    cid = F.when(F.regexp_extract(name, TRANSCRIPT_NAME, 2) != "", F.regexp_extract(name, TRANSCRIPT_NAME, 2).cast("bigint"))
    page_no = F.lit(0).cast("bigint") if multi_line else F.coalesce(F.col("page_no"), F.lit(0).cast("bigint"))
    return df.select(
        (cid if multi_line else F.coalesce(F.col("call_id"), cid)).alias("call_id"), page_no.alias("page_no"),
        name.alias("file_name"), F.col("_metadata.file_path").alias("file_path") if multi_line
        else F.coalesce("transcript_path", "file_name").alias("file_path"),
        F.when(stamp != "", F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd_HH-mm-ss"))).alias("started_at"),
        F.coalesce(F.col("items"), F.array()).alias("items"), F.col("_corrupt_record").isNotNull().alias("malformed"))


def scan_requests(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation requests as JSON lines (one request body per line); a body
    without ``request_id`` is known by the hash of its fields."""
    return (spark.read.schema(EVAL_REQUEST).option("mode", "PERMISSIVE").json(path)
            .select(F.coalesce("request_id", request_key("call_id", "evaluation_prompt")).alias("request_id"),
                    "call_id", "evaluation_prompt"))


def load_index(spark: SparkSession, base: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and vectors of the latest (or given) index version. Load once
    and reuse across query batches; a missing index is an error, not a string."""
    from helpline.sinks import index
    known = index.versions(spark, base)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no index under {base}" if not known else f"no version {version} under {base}")
    return index.read_version(spark, base, known[version] if version else list(known.values())[-1])
