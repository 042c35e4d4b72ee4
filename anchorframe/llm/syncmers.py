"""Document fingerprints from closed syncmers, with DataFrame functions only.

A string of ``k`` bytes is a closed syncmer if, of its inner strings of ``s`` bytes, one with the smallest hash stands at its
start or its end. Whether it is one depends on its own bytes alone, so equal passages have equal anchors wherever they stand,
and the anchors of a text that is put together from parts are those of the parts and of the places where they meet.

``anchors_sql`` gives the place (byte) and the 32-bit hash of each syncmer of a text; a text without any (it has less than
two ``k`` bytes) has one anchor, all of it, at place -1. A fingerprint is made of the ``width`` smallest distinct hashes as hex digits, eight each; equal texts
have equal fingerprints. The likeness of two fingerprints is the share of hashes in both among the ``width`` smallest of their
union, an estimate of the Jaccard similarity of all anchors.

Texts are read in blocks, so that what is held beside a text and its anchors does not grow with its length. Null texts are
empty (the anchor of the empty text), null ids come last, rows with one id are ordered by a hash of their text; the only row of
a table is its own next document, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorframe.session import materialize

K, S, WIDTH = 20, 6, 64
_BLOCK = 1 << 16  # bytes
_ROWS = 2048  # documents in a bucket


def _mark(k: int, s: int) -> str:
    """SQL: whether the k bytes from index i of the hashes h are a syncmer; x is h[i]. Null behind the last."""
    last = k - s
    start = " AND ".join(f"x <= get(h, i + {n})" for n in range(1, last + 1))
    end = " AND ".join([f"get(h, i + {last}) <= x", *(f"get(h, i + {last}) <= get(h, i + {n})" for n in range(last - 1, 0, -1))])
    return f"({start}) OR ({end})"


def _hash(data: str) -> str:
    return f"shiftrightunsigned(xxhash64({data}), 32)"


def anchors_sql(data: str, k: int = K, s: int = S) -> str:
    """SQL: array of (place, hash) of the syncmers of a binary expression.

    ``transform(array(e), v -> ...)[0]`` gives an expression a name, so that it is computed (and a binary value copied) once.
    """
    whole = f"array(struct(-1 AS place, {_hash('bb')} AS hash))"
    inner = (f"transform(array(transform(sequence(1, length(cc) - {s - 1}), i -> xxhash64(substring(cc, i, {s})))), h -> "
             f"array_compact(transform(h, (x, i) -> CASE WHEN {_mark(k, s)} THEN struct(o + i AS place, "
             f"{_hash(f'substring(cc, i + 1, {k})')} AS hash) END)))[0]")
    blocks = f"flatten(transform(sequence(0, length(bb) - {k}, {_BLOCK}), o -> transform(array(substring(bb, o + 1, {_BLOCK + k - 1})), cc -> {inner})[0]))"
    found = f"CASE WHEN length(bb) < {k} THEN array() ELSE {blocks} END"
    return f"transform(array({data}), bb -> transform(array({found}), f -> CASE WHEN size(f) = 0 THEN {whole} ELSE f END)[0])[0]"


def sketch_sql(hashes: str, width: int = WIDTH) -> str:
    """SQL: the smallest distinct hashes of an array."""
    return f"slice(sort_array(array_distinct({hashes})), 1, {width})"


def fingerprint_sql(sketch: str) -> str:
    return f"concat_ws('', transform({sketch}, x -> lpad(lower(hex(x)), 8, '0')))"


def likeness_sql(a: str, b: str, width: int = WIDTH) -> str:
    union = sketch_sql(f"array_union({a}, {b})", width)
    return f"transform(array({union}), u -> CAST(size(array_intersect(array_intersect(u, {a}), {b})) AS DOUBLE) / size(u))[0]"


def with_next(rows: DataFrame, columns: list[str], per_bucket: int = _ROWS) -> DataFrame:
    """Rows (doc_id, text, ...) ready for ``next_of``: dealt by ranges of ids, with each range's next row as a guest.

    Ranges are equal in width and hold ``per_bucket`` rows where ids are evenly spread; of a bucket one row goes to another too.
    """
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    step = max(1, ((high or 0) - (low or 0) + 1) * per_bucket // max(1, n))
    # Ids may span more than a long holds.
    bucket = F.coalesce(F.expr(f"(CAST(doc_id AS DECIMAL(38,0)) - CAST('{low or 0}' AS DECIMAL(38,0))) div CAST('{step}' AS DECIMAL(38,0))"), F.lit(-1)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    order, every = Window.orderBy(F.desc("bucket")), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The first row of a bucket follows the last one of the bucket before; that of the first bucket follows the very last.
    heads = heads.withColumn("guest_in", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(every)))
    heads = materialize(heads.withColumnRenamed("bucket", "head_bucket"))
    rows = rows.join(heads, (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    places = F.when(F.col("head_bucket").isNull(), F.array("bucket")).otherwise(F.array("bucket", "guest_in"))
    rows = rows.select(*columns, F.posexplode(places).alias("guest", "bucket"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), F.xxhash64("text"))


def next_of(dealt: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the value of the next row by descending id, and drops the guests."""
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.xxhash64("text"))
    return dealt.withColumn(name, F.lead(value).over(order)).where("guest = 0")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last half of characters replaced by as many first ones of the next text by descending id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = with_next(rows, ["doc_id", "text"])
    dealt = dealt.withColumn("found", F.expr(anchors_sql("encode(text, 'UTF-8')", k, s)))
    dealt = dealt.withColumn("sketch", F.expr(sketch_sql("found.hash", width)))
    both = next_of(dealt, F.struct("text", "found", "sketch"), "next")
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("CAST(n_chars div 2 AS INT)"))
    both = both.withColumn("kept", F.expr("left(text, CAST(n_chars AS INT) - half)")).withColumn("new", F.expr("left(next.text, half)"))
    kept, new = F.octet_length("kept"), F.octet_length("new")
    both = both.withColumn("kept_n", kept).withColumn("new_n", new)
    # Anchors of the edited text: those of its two parts, and of the bytes around the place where they meet.
    edge = f"concat(substring(encode(kept, 'UTF-8'), greatest(kept_n - {k - 2}, 1), {k - 1}), substring(encode(new, 'UTF-8'), 1, {k - 1}))"
    met = f"transform(filter({anchors_sql(edge, k, s)}, a -> a.place >= 0), a -> a.hash)"
    parts = (f"concat(transform(filter(found, a -> a.place >= 0 AND a.place + {k} <= kept_n), a -> a.hash), {met}, "
             f"transform(filter(next.found, a -> a.place >= 0 AND a.place + {k} <= new_n), a -> a.hash))")
    parts = f"transform(array({parts}), p -> CASE WHEN size(p) = 0 THEN array({_hash("encode(concat(kept, new), 'UTF-8')")}) ELSE p END)[0]"
    both = both.withColumn("edited", F.expr(sketch_sql(parts, width)))
    return both.select("doc_id", "n_chars", F.sha2(F.concat("kept", "new"), 256).alias("edited_sha256"),
                       F.expr(fingerprint_sql("sketch")).alias("fingerprint"), F.expr(fingerprint_sql("edited")).alias("edited_fingerprint"),
                       F.expr(likeness_sql("sketch", "edited", width)).alias("near_edited"), F.expr(likeness_sql("sketch", "next.sketch", width)).alias("near_next"))
