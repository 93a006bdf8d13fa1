"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``k`` code points of a text has a hash (xxhash64 of its UTF-32
bytes, 33 bits kept); every window of ``w`` consecutive hashes selects its
minimum, the rightmost one among equal minima.  A fingerprint is the set of
selected hashes with their positions (code points, from 0).  So any passage of
``w + k - 1`` code points that two texts share gives them a common hash, and no
shared passage under ``k`` code points does.  A text with fewer than ``w`` hashes
has one window, a text under ``k`` code points one hash of all of it; an empty or
null text has an empty fingerprint.

A hash and its place travel as one long, ``hash * 2^31 + (2^31 - 1 - place)``
with ``place = 4 * position + 1`` (the byte in the text's UTF-32 form), so the
smallest long is the smallest hash at its rightmost place.  Window minima come
from ``log2(w)`` passes of pairwise minima, each over twice the span of the last;
long texts are worked through in blocks of ``BLOCK`` windows, so temporary arrays
stay small.

The fingerprint of a text made of a text's start and another's start is put
together: windows inside either part have their known minima, only the windows
over the seam are hashed (``spliced_keys``).

Documents meet the next one (descending id, then descending hash of the text; the
last one meets the first) in one shuffle of the texts: blocks of consecutive ids
come from a range partitioning of the ids alone, and every block also gets the
first row of the block after it.  Rows without an id come last.  Equal rows are
neighbours of each other; rows of one id with different texts spread over blocks.
An empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 16  # code points a hash covers
WINDOW = 32  # hashes a window covers: shared passages of 47 code points are always found
BLOCK = 1 << 15
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
HASH = (1 << 33) - 1


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _no_keys() -> Column:
    return F.expr("CAST(array() AS array<bigint>)")


def _window_minima(keys: Column, w: int) -> Column:
    """Minimum of every ``w`` keys from each place on; fewer at the end."""

    def paired(minima: Column, step: int) -> Column:
        return _once(minima, lambda m: F.zip_with(m, F.slice(m, step + 1, F.size(m)), lambda x, y: F.least(x, y)))

    span = 1
    while 2 * span <= w:
        keys, span = paired(keys, span), 2 * span
    return paired(keys, w - span) if span < w else keys


def winnow_keys(text: Column, k: int = K, w: int = WINDOW, block: int = BLOCK) -> Column:
    """Selected keys of a text, by position; see the module's text for their form."""

    def selected(code: Column) -> Column:
        n = (F.octet_length(code) / 4).cast("int")
        last = F.greatest(n - k, F.lit(0))  # the last hash
        windows = F.greatest(last - (w - 2), F.lit(1))

        def of_block(first: Column) -> Column:
            count = F.least(F.lit(block), windows - first)
            places = F.sequence(4 * first + 1, 4 * F.least(first + count + (w - 2), last) + 1, F.lit(4))
            keys = F.transform(places, lambda p: F.xxhash64(F.substring(code, p, F.lit(4 * k))).bitwiseOR(F.lit(PLACE).cast("long")) - p)
            return F.slice(_window_minima(keys, w), 1, count)

        blocks = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(block)), of_block)
        return F.when(n > 0, F.array_distinct(F.flatten(blocks))).otherwise(_no_keys())

    return _once(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), selected)


def key_hash(key: Column) -> Column:
    return F.shiftright(key, PLACE_BITS).bitwiseAND(F.lit(HASH))


def key_position(key: Column) -> Column:
    return F.shiftright(PLACE - 1 - key.bitwiseAND(F.lit(PLACE).cast("long")), 2)


def key_hashes(keys: Column) -> Column:
    """The set of hashes of some keys."""
    return F.array_distinct(F.transform(keys, key_hash))


def key_text(keys: Column) -> Column:
    """``hash:position`` of every key, hashes in hexadecimal, by position."""
    parts = F.transform(keys, lambda x: F.concat(F.lower(F.hex(key_hash(x))), F.lit(":"), key_position(x).cast("string")))
    return F.array_join(parts, " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def spliced_keys(keys: Column, text: Column, head: Column, next_keys: Column, next_text: Column, tail: Column,
                 k: int = K, w: int = WINDOW) -> Column:
    """Keys of the first ``head`` code points of ``text`` followed by the first ``tail`` of ``next_text``.

    ``keys`` and ``next_keys`` are those of the whole texts; ``head`` and ``tail``
    are within the texts, and ``head`` is 0 only for an empty result.
    """
    need = w + k - 1  # code points of a whole window

    def from_start(all_keys: Column, windows: Column) -> Column:
        """Keys that the first ``windows`` windows select."""

        def selects(a: Column) -> Column:
            def in_time(x: Column, j: Column) -> Column:
                before = F.get(a, j - 1)
                at_once = F.shiftright(x, PLACE_BITS) <= F.shiftright(before, PLACE_BITS)  # it wins as soon as it is in a window
                first = F.when(j == 0, 0).when(at_once, key_position(x) - (w - 1)).otherwise(key_position(before) + 1)
                return first < windows

            return F.filter(a, in_time)

        return _once(all_keys, selects)

    def shifted(some: Column, by: Column) -> Column:
        return F.transform(some, lambda x: x - 4 * by)

    start = F.greatest(head - (need - 1), F.lit(0))
    left = F.substring(text, start + 1, head - start)
    seam = F.concat(left, F.substring(next_text, F.lit(1), F.least(tail, F.lit(need - 1))))
    whole = (F.length(seam) >= need) | (head + tail < need)
    over = F.when(whole, shifted(winnow_keys(seam, k, w), start)).otherwise(_no_keys())
    parts = F.concat(from_start(keys, head - (need - 1)), over, shifted(from_start(next_keys, tail - (need - 1)), head))
    return F.array_distinct(parts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """(id, n_chars, fingerprint): an array of (hash, position) per document, in the scan."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    pairs = F.transform(winnow_keys(F.col("__text"), k, w), lambda x: F.struct(key_hash(x).alias("hash"), key_position(x).cast("int").alias("position")))
    return rows.select(id_col, F.length("__text").cast("long").alias("n_chars"), pairs.alias("fingerprint"))


def block_heads(keyed: DataFrame, blocks: int) -> list:
    """First keys of ``blocks`` blocks of rows in descending order of ``key``: at most one row a block."""
    dealt = keyed.select("key").repartitionByRange(blocks, F.desc("key"))
    heads = dealt.groupBy(F.spark_partition_id().alias("block")).agg(F.max("key").alias("key"))
    return [r.key for r in heads.orderBy(F.desc("key")).collect()]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys=None, blocks: int | None = None) -> DataFrame:
    """(id, text, keys, next_text, next_keys): every document beside the next one, texts null-free.

    ``keys(text)`` is computed once per document after the shuffle.  ``blocks``
    is the number of blocks and tasks, by default that of shuffle partitions.
    """
    keys = keys or winnow_keys
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.struct("id", F.xxhash64("text").alias("hash")).alias("key"))
    heads = block_heads(rows, blocks)
    listed = F.array(*[F.struct(F.lit(h["id"]).cast(kind).alias("id"), F.lit(h["hash"]).cast("long").alias("hash")) for h in heads])
    if not heads:
        listed = F.expr(f"CAST(array() AS array<struct<id:{kind.simpleString()},hash:bigint>>)")
    own = F.size(F.filter(listed, lambda h: h >= F.col("key"))) - 1  # heads fall from block to block
    place = lambda block, guest: F.struct(block.alias("block"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("own") - 1, F.lit(max(len(heads), 1)))
    places = F.when(F.col("is_head"), F.array(place(F.col("own"), False), place(before, True))).otherwise(F.array(place(F.col("own"), False)))
    rows = rows.withColumn("own", own).withColumn("is_head", F.get(listed, F.col("own")) == F.col("key"))
    rows = rows.select("id", "text", "key", F.explode(places).alias("at")).select("id", "text", "key", "at.block", "at.guest")
    dealt = rows.repartitionById(max(len(heads), 1), "block").withColumn("keys", keys(F.col("text")))
    order = Window.partitionBy("block").orderBy("guest", F.desc("key"))
    beside = dealt.withColumn("next", F.lead(F.struct("text", "keys")).over(order)).where(~F.col("guest"))
    return beside.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "keys", F.col("next.text").alias("next_text"), F.col("next.keys").alias("next_keys"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """Keys of every document, of the next one, and of its edited text, with both texts.

    The edited text's last half (rounded down) is the next document's start, as
    many code points or all of it.  Columns: id, text, n_chars, head, keys,
    next_text, next_keys, tail, edited_keys.
    """
    pairs = with_next(docs, id_col, text_col, lambda text: winnow_keys(text, k, w))
    n = F.length(text_col)
    half = F.floor(n / 2).cast("int")
    sized = pairs.select("*", n.alias("n_chars"), (n - half).alias("head"), F.least(half, F.length("next_text")).alias("tail"))
    edited = spliced_keys(F.col("keys"), F.col(text_col), F.col("head"), F.col("next_keys"), F.col("next_text"), F.col("tail"), k, w)
    return sized.withColumn("edited_keys", edited)
