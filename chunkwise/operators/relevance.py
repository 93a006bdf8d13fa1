"""Multi-signal relevance of chunks to annotation spans of the same document.

A (span, chunk) pair is relevant when any signal fires, in priority order:

1. offsets overlap (only when both chunk offsets are known)   -> confidence 1.0
2. normalised text containment either way, span text non-empty -> 0.95
3. token-overlap ratio >= threshold                            -> round(ratio, 4)

ratio = sum over tokens of min(count in span, count in chunk) / token count of
the span (multisets of lower-cased word tokens; 0 for a span without tokens).

Scaling: the labelling never forms all span x chunk pairs of a document.  Spans
and chunks both post keys to one index, a 64-bit hash of (document, kind, value),
and a pair is a candidate where two keys meet.  The kinds (posted by span / chunk):

* token -- signal 3 and signal 2, span inside chunk: a chunk reaching the threshold
  holds one of the span's first ``|A| - tau + 1`` token occurrences in any fixed
  order (longest first: longer tokens are rarer), and a token that stands between
  non-word characters inside the span is a whole token of every chunk around it.
  The span posts these, the chunk all its tokens;
* gram -- spans with edge tokens only: the first characters of the first token, met
  by the substrings of up to three characters of the chunk's tokens, which chunks
  post only in documents that have such spans;
* symbol -- spans without any word character: their first character, met by the
  chunk's distinct non-word characters, posted only where such spans exist;
* the mirrored three for signal 2, chunk inside span, and one key for empty chunks;
* place -- signal 1: a span posts the one or two buckets it touches at the level
  that fits its length (powers of two), a chunk its buckets of all levels, so a
  span of any length posts two keys; offsets are compared where the keys meet.

Every candidate is then verified exactly, document name included, so that equal
hashes cost time only.  Token overlap is the intersection of the numbered
occurrences of both token lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.arrays import named, run_ends, run_lengths
from chunkwise.functions.text import WORD_PATTERN, WS_CLASS, normalize_ws
from chunkwise.session import cut_lineage

DEFAULT_THRESHOLD = 0.5
CONF_OFFSET = 1.0
CONF_CONTAINS = 0.95
FIRST_LEVEL, LAST_LEVEL = 12, 33  # buckets of 4,096 positions and up; any distance of 32-bit offsets fits a level


def numbered(toks: Column) -> Column:
    """The tokens with their occurrence numbers ("a" 1, "a" 2, "b" 1): a multiset as a set."""

    def spread(run: Column, ends: Column) -> Column:
        counted = F.arrays_zip(ends.alias("end"), run_lengths(ends).alias("n"))
        return F.flatten(F.transform(counted, lambda r: F.transform(
            F.sequence(F.lit(1), r["n"]), lambda n: F.concat_ws(" ", F.get(run, r["end"]), n.cast("string"))
        )))

    occurrences = named(F.sort_array(toks), lambda run: named(run_ends(run), lambda ends: spread(run, ends)))
    return F.when(F.size(toks) > 0, occurrences).otherwise(_strings())


def shared_tokens(a: Column, b: Column) -> Column:
    """Sum over tokens of min(count in a, count in b), of two ``numbered`` arrays."""
    return F.size(F.array_intersect(a, b))


def _strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _shape(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by the normalised text, its tokens, these numbered, and how many stand between non-word characters."""
    out = rows.withColumn("an", normalize_ws("text")).drop("text")
    out = out.withColumn("toks", F.coalesce(F.regexp_extract_all("an", F.lit(WORD_PATTERN), 0), _strings()))
    sw = F.col("an").rlike("^" + WORD_PATTERN).cast("int")
    ew = F.col("an").rlike(WORD_PATTERN + "$").cast("int")
    return out.select("*", numbered(F.col("toks")).alias("occurrences"), sw.alias("sw"), (F.size("toks") - sw - ew).alias("n_inner"))


_EDGE = "n_inner <= 0 AND size(toks) > 0"  # no token stands between non-word characters
_BARE = "size(toks) = 0 AND an != ''"  # no word character at all


def _when(condition: str, values: Column) -> Column:
    return F.when(F.expr(condition), values).otherwise(_strings())


def _longest_first(toks: Column) -> Column:
    ordered = F.sort_array(F.transform(toks, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ordered, lambda s: s["t"])


def _longest_inner() -> Column:
    inner = F.slice("toks", F.col("sw") + F.lit(1), F.greatest("n_inner", F.lit(0)))
    return _when("n_inner > 0", F.slice(_longest_first(inner), 1, 1))


def _edge_gram() -> Column:
    return _when(_EDGE, _strings(F.substring(F.get("toks", F.lit(0)), 1, 3)))


def _first_symbol() -> Column:
    return _when(_BARE, _strings(F.substring("an", 1, 1)))


def _grams() -> Column:
    """The substrings of one to three characters of all tokens."""
    of_length = lambda t, g: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(t) - g + F.lit(1), F.lit(1))), lambda p: F.substring(t, p, g)
    )
    of_token = lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda g: of_length(t, g)))
    return F.flatten(F.transform(F.array_distinct("toks"), of_token))


def _symbols() -> Column:
    """The characters that are neither word characters nor white space."""
    bare = F.regexp_replace("an", "[\\p{L}\\p{N}_]|" + WS_CLASS, "")
    return F.coalesce(F.regexp_extract_all(bare, F.lit("(?s)."), 0), _strings())


def _keys(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.xxhash64(F.col("document_name"), F.lit(kind), v))


def _places(start: str, end: str, levels: Column) -> Column:
    """The buckets that the positions touch, of 2^level positions each, as level:bucket."""
    low, high = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    at = lambda level: F.transform(
        F.sequence(F.call_function("shiftright", low, level), F.call_function("shiftright", high, level)),
        lambda bucket: F.concat_ws(":", level.cast("string"), bucket.cast("string")),
    )
    return F.when(low.isNotNull() & high.isNotNull(), F.flatten(F.transform(levels, at))).otherwise(_strings())


def _postings(rows: DataFrame, ids: list[str], keys: list[Column], start: str, end: str, places: Column | None) -> DataFrame:
    """(key, ids, start, end): a row per key; only a key of a place carries the offsets."""
    plain = rows.select(*ids, F.explode(F.flatten(F.array(*keys))).alias("key"), F.lit(None).cast("long").alias(start), F.lit(None).cast("long").alias(end))
    if places is None:
        return plain
    spots = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return plain.unionByName(
        spots.select(*ids, F.explode(_keys("place", places)).alias("key"), F.col(start).cast("long"), F.col(end).cast("long"))
    )


def _candidates(spans: DataFrame, chunks: DataFrame, threshold: float, use_offsets: bool) -> DataFrame:
    """Candidate (ann_id, document_name, chunk_id) pairs, each once; a superset of the relevant pairs."""
    total = F.size("toks")
    tau = F.greatest(F.lit(1), F.ceil(total * F.lit(float(threshold))).cast("int") - F.lit(1))
    prefix = F.slice(_longest_first(F.col("toks")), F.lit(1), F.greatest(total - tau + F.lit(1), F.lit(0)))
    span_level = F.greatest(F.lit(FIRST_LEVEL), F.length(F.bin(F.abs(F.col("end_char").cast("long") - F.col("start_char")))))
    one = _postings(spans, ["ann_id"], [
        _keys("token", F.concat(prefix, _longest_inner())),
        _keys("gram", _edge_gram()),
        _keys("symbol", _first_symbol()),
        _keys("in-token", F.col("toks")),
        _keys("in-gram", _grams()),
        _keys("in-symbol", _symbols()),
        _keys("empty", _when("an != ''", _strings(F.lit("")))),
    ], "start_char", "end_char", _places("start_char", "end_char", F.array(span_level)) if use_offsets else None)
    other = _postings(chunks, ["document_name", "chunk_id"], [
        _keys("token", F.col("toks")),
        _keys("gram", _when("has_edge", _grams())),
        _keys("symbol", _when("has_bare", _symbols())),
        _keys("in-token", _longest_inner()),
        _keys("in-gram", _edge_gram()),
        _keys("in-symbol", _first_symbol()),
        _keys("empty", _when("an = ''", _strings(F.lit("")))),
    ], "chunk_start", "chunk_end",
        _places("chunk_start", "chunk_end", F.sequence(F.lit(FIRST_LEVEL), F.lit(LAST_LEVEL))) if use_offsets else None)
    touch = "start_char IS NULL OR chunk_start IS NULL OR (start_char < chunk_end AND end_char > chunk_start)"
    return one.join(other, "key").where(touch).select("ann_id", "document_name", "chunk_id").distinct()


def label_relevance(
    spans: DataFrame,
    chunks: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    use_offsets: bool = True,
) -> DataFrame:
    """(ann_id, document_name, chunk_id, ratio, confidence, signal) for every relevant pair.

    ``spans``: (ann_id, document_name, start_char, end_char, text);
    ``chunks``: (document_name, chunk_id, text[, chunk_start, chunk_end]).
    Missing offset columns, or ``use_offsets=False``, disable signal 1.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    has_offsets = "chunk_start" in chunks.columns and "chunk_end" in chunks.columns
    use_offsets = use_offsets and has_offsets
    cols = ["document_name", "chunk_id", "text"] + (["chunk_start", "chunk_end"] if has_offsets else [])
    # both are read by the index and by the verification: computed once, lineage cut (shared checkpoint folder)
    sp = cut_lineage(_shape(spans.select("ann_id", "document_name", "start_char", "end_char", "text")))
    wanted = sp.groupBy("document_name").agg(
        F.coalesce(F.max(F.expr(_EDGE)), F.lit(False)).alias("has_edge"), F.coalesce(F.max(F.expr(_BARE)), F.lit(False)).alias("has_bare")
    )
    ch = _shape(chunks.select(*cols).join(wanted, "document_name"))
    if not has_offsets:
        ch = ch.withColumn("chunk_start", F.lit(None).cast("int")).withColumn("chunk_end", F.lit(None).cast("int"))
    ch = cut_lineage(ch)
    full = (
        _candidates(sp, ch, threshold, use_offsets)
        .join(sp.select("ann_id", "document_name", "start_char", "end_char", "an", F.size("toks").alias("total"), F.col("occurrences").alias("in_span")), ["ann_id", "document_name"])
        .join(ch.select("document_name", "chunk_id", "chunk_start", "chunk_end", F.col("an").alias("cn"), F.col("occurrences").alias("in_chunk")), ["document_name", "chunk_id"])
        .withColumn("shared", shared_tokens(F.col("in_span"), F.col("in_chunk")))
    )
    ratio = F.when(F.col("total") > 0, F.col("shared") / F.col("total")).otherwise(F.lit(0.0))
    s1 = (
        F.lit(use_offsets) & F.col("chunk_start").isNotNull() & F.col("chunk_end").isNotNull()
        & (F.col("start_char") < F.col("chunk_end")) & (F.col("end_char") > F.col("chunk_start"))
    )
    s2 = (F.col("an") != "") & ((F.instr(F.col("cn"), F.col("an")) > 0) | (F.instr(F.col("an"), F.col("cn")) > 0))
    s3 = F.col("ratio") >= F.lit(float(threshold))
    labelled = full.withColumn("ratio", ratio.cast("double")).select(
        "ann_id", "document_name", "chunk_id", "ratio",
        F.when(s1, F.lit(CONF_OFFSET)).when(s2, F.lit(CONF_CONTAINS)).otherwise(F.round("ratio", 4)).alias("confidence"),
        F.when(s1, F.lit("offset")).when(s2, F.lit("contains")).when(s3, F.lit("tokens")).alias("signal"),
    )
    return labelled.filter(F.col("signal").isNotNull())
