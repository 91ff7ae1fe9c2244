"""Small helpers to write DuckDB oracle text."""


def lit(s: str) -> str:
    """A SQL string literal; line breaks become ``chr(10)``."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def page(expr: str, span: int) -> str:
    return f"CAST(floor(({expr}) / {span}) AS BIGINT)"


def doc_id(prefix: str, entity: str, page_expr: str) -> str:
    return (f"'{prefix}' || CAST({entity} AS VARCHAR) || CASE WHEN {page_expr} > 0 "
            f"THEN '_p' || CAST({page_expr} AS VARCHAR) ELSE '' END")


def vector_sql(rows: str, weights: str | None = None) -> str:
    """``(node_id, b, x)``: non-zero components of the token-hash vectors of ``rows(node_id,
    text)``, single precision; ``weights``: relation ``(b, w)``."""
    from helpline.operators.embed import DEFAULT_DIM
    from helpline.operators.lexical import TOKEN_SPLIT
    w, join = ("w.w", f"JOIN ({weights}) w ON w.b = h.b") if weights else ("1", "")
    return f"""SELECT node_id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY node_id)) AS FLOAT) AS DOUBLE) AS x FROM (
      SELECT node_id, h.b, h.n * {w} AS c FROM (SELECT node_id, b, count(*) AS n FROM (
        SELECT node_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % {DEFAULT_DIM} AS INTEGER) AS b FROM (
          SELECT node_id, unnest(list_filter(regexp_split_to_array(lower(text), '{TOKEN_SPLIT}'), lambda x: x <> '')) AS t FROM ({rows}) r) a) e
        GROUP BY 1, 2) h {join}) z WHERE c <> 0"""


def components_sql(rows: str, weights: str | None = None) -> str:
    """``(node_id, components)`` as ``functions.components`` tells them."""
    return f"""SELECT node_id, string_agg(CAST(b AS VARCHAR) || ':' || CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY b) AS components
      FROM ({vector_sql(rows, weights)}) v GROUP BY 1"""
