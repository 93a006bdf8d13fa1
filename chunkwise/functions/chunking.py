"""Boundary-aware overlapping chunking as one native Spark expression.

Semantics (size/overlap in "tokens", 4 characters each; C = 4*size, V = 4*overlap):

* a text of at most C characters is one chunk ``(text, 0, n)``, not stripped;
* otherwise, from ``start = 0`` while ``start < n``: ``end = start + C``; when
  ``end < n`` the cut moves to just after the last ``"\\n\\n"`` lying fully inside
  ``[start + C//2, end + 200)``, else after the last ``". "`` inside
  ``[start + C//2, end + 100)``, else stays a hard cut.  The chunk text is the
  stripped slice ``text[start:end]``; blank chunks are dropped and take no
  ordinal; offsets are the unstripped ones (``end`` may pass ``n``).  Then
  ``start = end - V``.

The loop is a fold (``aggregate``) over a bounded ``sequence``: every step moves
``start`` forward by at least ``C//2 + 2 - V`` characters.  The "last delimiter
in a window" is found by searching the reversed window.  Windows are read from
fixed-width code-point blocks, so a step costs O(chunk size), not O(offset).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwise.functions.text import py_strip, sql_strip

# Fixed values of the reference chunker.
CHARS_PER_TOKEN = 4
PARAGRAPH_PAD = 200  # look-ahead for "\n\n"
SENTENCE_PAD = 100  # look-ahead for ". "
CHARS_PER_PAGE = 3000
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200

_SPAN_TYPE = "array<struct<s:int,e:int>>"
_TAIL = 64


def chunk_geometry(size: int, overlap: int) -> tuple[int, int, int, int]:
    """(C, V, half, minimum progress) with validation."""
    c = size * CHARS_PER_TOKEN
    v = overlap * CHARS_PER_TOKEN
    half = c // 2
    if size <= 0 or overlap < 0:
        raise ValueError("chunk size must be positive and overlap non-negative")
    progress = min(c, half + 2) - v
    if progress < 1:
        raise ValueError(
            f"overlap {overlap} too large for size {size}: the chunk loop would not advance"
        )
    return c, v, half, progress


def _piece(blocks: Column, width: int, start0: Column, length: Column) -> Column:
    """``text[start0 : start0 + length]`` assembled from fixed-width code-point blocks.

    Touches only the blocks the slice overlaps, so the cost does not grow with
    the offset (``substring`` on the whole text walks from its start).
    """
    first = F.floor(start0 / F.lit(width)).cast("int")
    within = start0 - first * F.lit(width)
    n_blocks = F.floor((within + length - F.lit(1)) / F.lit(width)).cast("int") + F.lit(1)
    joined = F.array_join(F.slice(blocks, first + F.lit(1), F.greatest(n_blocks, F.lit(1))), "")
    return F.substring(joined, within + F.lit(1), length)


def _last_delim_end(window: Column, delim: str) -> Column:
    """Length up to and including the last ``delim`` fully inside ``window`` (0 = none)."""
    pos = F.instr(F.reverse(window), delim[::-1])
    return F.when(pos > 0, F.length(window) - pos + 1).otherwise(F.lit(0))


def chunk_spans(text, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP) -> Column:
    """ARRAY<STRUCT<text STRING, chunk_start INT, chunk_end INT>> of the chunks of ``text``.

    Blank chunks are already removed; the array position is the chunk ordinal.
    The text is cut once into code-point blocks of ``C//2`` characters and its
    length computed once (both bound as lambda variables); every step then
    reads only the two or three blocks its window overlaps.
    """
    text = F.col(text) if isinstance(text, str) else text
    c, v, half, progress = chunk_geometry(size, overlap)
    width = max(half, 1)
    para_len = c + PARAGRAPH_PAD - half
    sent_len = c + SENTENCE_PAD - half

    def with_env(env: Column) -> Column:
        blocks, n = env["blocks"], env["n"]

        def end_of(start: Column) -> Column:
            hard = start + F.lit(c)
            lo = start + F.lit(half)

            def cut(window: Column) -> Column:
                # the sentence window is a prefix of the paragraph window
                para = _last_delim_end(window, "\n\n")
                sent = _last_delim_end(F.substring(window, 1, sent_len), ". ")
                return F.when(para > 0, lo + para).when(sent > 0, lo + sent).otherwise(hard)

            searched = F.transform(F.array(_piece(blocks, width, lo, F.lit(para_len))), cut)[0]
            return F.when(hard >= n, hard).otherwise(searched)

        def step(acc: Column, _i: Column) -> Column:
            start = acc["s"]
            tail = acc["tail"]
            full = F.size(tail) >= F.lit(_TAIL)
            # bind the computed end once (a one-element transform acts as a let)
            advanced = F.transform(
                F.array(end_of(start)),
                lambda e: F.struct(
                    (e - F.lit(v)).alias("s"),
                    F.when(full, F.array_append(acc["done"], tail)).otherwise(acc["done"]).alias("done"),
                    F.array_append(
                        F.when(full, F.array().cast(_SPAN_TYPE)).otherwise(tail),
                        F.struct(start.alias("s"), e.alias("e")),
                    ).alias("tail"),
                ),
            )[0]
            return F.when(start < n, advanced).otherwise(acc)

        # spans accumulate in a short tail that moves into ``done`` when full: appends
        # copy at most _TAIL entries (plus k/_TAIL references), not the whole list
        init = F.struct(
            F.lit(0).alias("s"),
            F.array().cast(f"array<{_SPAN_TYPE}>").alias("done"),
            F.array().cast(_SPAN_TYPE).alias("tail"),
        )
        steps = F.sequence(F.lit(0), (n / F.lit(progress)).cast("int") + F.lit(1))
        acc_end = F.aggregate(steps, init, step)
        folded = F.flatten(F.array_append(acc_end["done"], acc_end["tail"]))
        return F.filter(
            F.transform(
                folded,
                lambda sp: F.struct(
                    py_strip(_piece(blocks, width, sp["s"], sp["e"] - sp["s"])).alias("text"),
                    sp["s"].alias("chunk_start"),
                    sp["e"].alias("chunk_end"),
                ),
            ),
            lambda ch: ch["text"] != F.lit(""),
        )

    env = F.struct(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % width), 0).alias("blocks"),
        F.length(text).alias("n"),
    )
    long_chunks = F.transform(F.array(env), with_env)[0]
    n_all = F.length(text)
    short_chunk = F.array(
        F.struct(text.alias("text"), F.lit(0).alias("chunk_start"), n_all.alias("chunk_end"))
    )
    return F.when(text.isNull(), F.lit(None)).when(n_all <= F.lit(c), short_chunk).otherwise(long_chunks)


def estimate_page(offset) -> Column:
    """``offset // 3000 + 1``."""
    offset = F.col(offset) if isinstance(offset, str) else offset
    return (F.floor(offset / F.lit(CHARS_PER_PAGE)) + F.lit(1)).cast("int")


def estimated_chunk_count(n_chars) -> Column:
    """Closed-form chunk count used by the cost estimate: 1, or ceil((n-4000)/3200)+1."""
    n_chars = F.col(n_chars) if isinstance(n_chars, str) else n_chars
    c = DEFAULT_CHUNK_SIZE * CHARS_PER_TOKEN
    stride = (DEFAULT_CHUNK_SIZE - DEFAULT_CHUNK_OVERLAP) * CHARS_PER_TOKEN
    return F.when(n_chars <= c, F.lit(1)).otherwise(
        F.ceil((n_chars - F.lit(c)) / F.lit(stride)) + F.lit(1)
    ).cast("long")


# ---- SQL twin (DuckDB): recursive CTE over a relation with (document_name, text) ----


def sql_chunks(source: str, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP) -> str:
    """SQL producing (document_name, chunk_id, text, chunk_start, chunk_end) from ``source``."""
    c, v, half, _ = chunk_geometry(size, overlap)

    def end_sql(start: str) -> str:
        para = (
            f"length(regexp_extract(substring(text, {start} + {half} + 1, {c + PARAGRAPH_PAD - half}),"
            f" '(?s)^(.*\\n\\n)', 1))"
        )
        sent = (
            f"length(regexp_extract(substring(text, {start} + {half} + 1, {c + SENTENCE_PAD - half}),"
            f" '(?s)^(.*\\. )', 1))"
        )
        return (
            f"CASE WHEN {start} + {c} >= n THEN {start} + {c} "
            f"WHEN {para} > 0 THEN {start} + {half} + {para} "
            f"WHEN {sent} > 0 THEN {start} + {half} + {sent} "
            f"ELSE {start} + {c} END"
        )

    return f"""
    (WITH RECURSIVE src AS (
        SELECT document_name, text, length(text) AS n FROM {source} WHERE text IS NOT NULL
    ), steps(document_name, text, n, s, e) AS (
        SELECT document_name, text, n, 0, {end_sql('0')} FROM src WHERE n > {c}
        UNION ALL
        SELECT document_name, text, n, e - {v}, {end_sql(f'(e - {v})')}
        FROM steps WHERE e - {v} < n
    ), pieces AS (
        SELECT document_name, {sql_strip('substring(text, s + 1, e - s)')} AS text,
               s AS chunk_start, e AS chunk_end
        FROM steps
    ), kept AS (
        SELECT * FROM pieces WHERE text <> ''
        UNION ALL
        SELECT document_name, text, 0, n FROM src WHERE n <= {c}
    )
    SELECT document_name,
           CAST(row_number() OVER (PARTITION BY document_name ORDER BY chunk_start) - 1 AS INTEGER) AS chunk_id,
           text, CAST(chunk_start AS INTEGER) AS chunk_start, CAST(chunk_end AS INTEGER) AS chunk_end
    FROM kept)
    """


def sql_page(expr: str) -> str:
    return f"CAST(floor(({expr}) / {CHARS_PER_PAGE}) + 1 AS INTEGER)"
