"""Reusable Column expressions. All are built-in Spark functions, so they stay
inside whole-stage codegen (higher-order functions are interpreted but still
JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns of a call are split into pages of PAGE_SPAN positions, so no transcript
# row holds more turns, however long the call.
PAGE_SPAN = 100_000


def opt(df: DataFrame, name: str, default: str = "") -> Column:
    """Optional source column: the column if the table has it (NULLs kept as
    NULL), else the literal default. Absent and NULL are different cases."""
    return F.col(name) if name in df.columns else F.lit(default)


def page_of(key: Column | str, span: int | None = PAGE_SPAN) -> Column:
    """Page number by ranges of ``span`` keys; no span: one page."""
    if span is None:
        return F.lit(0).cast("bigint")
    k = F.col(key) if isinstance(key, str) else key
    return F.floor(k / F.lit(span)).cast("bigint")


def ordered_join(arr: Column, field: str, sep: str) -> Column:
    """Join one field of an (already sorted) array of structs into text."""
    return F.array_join(F.transform(arr, lambda x: x[field].cast("string")), sep)


def components(vector: Column) -> Column:
    """The non-zero components of a vector as text ``place:value``, values in
    ten-thousandths."""
    told = F.transform(vector, lambda x, i: F.when(x != 0, F.concat(
        i.cast("string"), F.lit(":"), F.round(x.cast("double") * 10000).cast("bigint").cast("string"))))
    return F.array_join(F.filter(told, lambda t: t.isNotNull()), ",")


def nullif_empty(c: Column) -> Column:
    """``array_join`` of an empty list gives '' where SQL string_agg gives NULL."""
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def content_hash(*cols: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]), 256)


def role_label(role: Column | str) -> Column:
    """Every role but ``assistant`` prints as ``User`` (system turns included)."""
    r = F.col(role) if isinstance(role, str) else role
    return F.when(r == F.lit("assistant"), F.lit("Assistant")).otherwise(F.lit("User"))


def word_count(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.size(F.split(F.trim(t), r"\s+")).cast("bigint")


# Accented letters and their unaccented forms (Spanish, French,
# German, Portuguese vowels, plus n-tilde and c-cedilla), same order in both.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def fold_accents(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.translate(t, ACCENTED, UNACCENTED)


def fold_accents_sql(expr: str) -> str:
    return f"translate({expr}, '{ACCENTED}', '{UNACCENTED}')"


_BUSY_SPLITS: dict[tuple, int] = {}


def _busy_splits(df: DataFrame) -> int:
    """Scan splits that hold rows. A Parquet row group is never split, so a
    file of one large row group leaves all its splits but one empty. Counted
    by a job that reads no column (row counts come from the footers); the
    answer is kept per input-file set, so a repeated query does not ask again."""
    key = tuple(sorted(df.inputFiles()))
    if key not in _BUSY_SPLITS:
        _BUSY_SPLITS[key] = df.select(F.spark_partition_id().alias("_split")).distinct().count()
    return _BUSY_SPLITS[key]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a freshly read table over the cluster's cores by ``keys``
    when fewer of its scan splits hold rows than there are cores (a few large
    files or row groups), so CPU-heavy row-local work that follows
    (tokenising, chunking, fact-table joins) runs on every core. A table with
    many more splits than cores is used as read without asking -- no extra
    shuffle at scale; only a scan of at most ``4 x`` the default parallelism
    splits is checked (a small job over footers). Hash, not round-robin, so a
    retried task rebuilds the same partitions. Call it on a scan only:
    inspecting a plan with shuffles would run them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * n or _busy_splits(df) >= n:
        return df
    return df.repartition(n, *keys) if keys else df.repartition(n)


def request_key(call_id: Column | str, prompt: Column | str) -> Column:
    """Id of an evaluation request without one of its own: a hash of its body
    (a missing field differs from an empty one)."""
    c, p = (F.col(x) if isinstance(x, str) else x for x in (call_id, prompt))
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("-")), F.lit("|"),
                          F.coalesce(F.concat(F.lit("="), p), F.lit("-"))))
