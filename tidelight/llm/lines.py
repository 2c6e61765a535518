"""Line dedup by a deletion-neighbourhood join. DataFrame operations only.

A line goes if an earlier line (by doc_id, then line number) equals it, or differs from it by one word
replaced, added or left out and both have ``SHORTEST`` words or more. Lines are compared after lower-casing
and squeezing white space; blank lines stay. Earlier lines count whether they themselves stay or not, so
the result needs no order of work.

Each distinct line emits its one-word deletions as hashed keys. Two lines of equal length within the bound
share the key (length, place, rest); a line and one with a word more share the key (shorter length, rest).
Which line the others of a key need to meet, the earliest of its kind, is an aggregate, so no pairs of a key
are listed. Met lines are verified word by word. Before that, hashes of a line's first and last words (about half of it
each, one of which any partner within the bound must share) leave out lines that can have no partner.

Defined cases: a null text stays null and an empty one empty. Rows with equal doc_id and text count as one
document and are treated alike; a null doc_id comes last. Long lines cost time in proportion to their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.session import cut

#: Words from which on one differing word is within the bound.
SHORTEST = 8
#: What a key says of its line: it lacks a word at a place, it is whole, or it lacks a word.
SAME, OWN, LESS = 0, 1, 2
#: Words of a block of the running XOR.
BLOCK = 64


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no (from 0), place (orders lines by doc_id, nulls last, and line number), line (as compared); blank lines left out."""
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    uneven = F.contains("line", F.lit("  "))
    for sign in "\t\r\x0b\x0c":
        uneven = uneven | F.contains("line", F.lit(sign))
    line = F.lower(F.trim(F.when(uneven, F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")).otherwise(F.col("line"))))
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)"), F.lit("1" + "0" * 30).cast("decimal(31,0)")) + F.col("line_no").cast("decimal(10,0)")
    return lines.select("doc_id", "text_hash", "line_no", place.cast("decimal(33,0)").alias("place"), line.alias("line")).filter("line <> ''")


def _words() -> Column:
    """Number of words of ``line``, which are one space apart."""
    return F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1


def _ends(shortest: int) -> list[Column]:
    """Keys end1 to end4 of a ``line`` of ``n`` words: of its first and of its last q words; null where there is none.

    q is at most half of the words of a partner, so one end of both is whole. It is rounded down to
    three leading bits, so that lines of n and n - 1 words mostly have the same two keys; else there are four.
    """

    def short(m: Column) -> Column:
        half = F.floor(m / 2).cast("int")
        step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(half.cast("double") + 0.5)) - 2))
        return (F.floor(half / step) * step).cast("int")

    def key(side: str, q: Column) -> Column:
        count = q if side == "first" else -q
        return F.xxhash64(q, F.lit(side), F.call_function("substring_index", F.col("line"), F.lit(" "), count))

    n = F.col("n")
    one, two = short(n), short(n - 1)
    keys = []
    for q, wanted in ((one, n >= shortest), (two, (n > shortest) & (two != one))):
        keys += [F.when(wanted, key(side, q)) for side in ("first", "last")]
    return [k.alias(f"end{i + 1}") for i, k in enumerate(keys)]


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _running_xor(block: Column) -> Column:
    """0, then the XOR of the first, of the first two ... values."""
    return F.aggregate(block, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))


def keys_of(lines: DataFrame) -> DataFrame:
    """h1, h2, first, key, role: the deletion neighbourhood of lines given by their word hashes ``w``.

    A rest is the XOR of its words hashed with their places, so equal keys mean equal rests. Without word i, words
    before it keep their places and words after it move up by one: a running XOR gives each rest from the one
    before. It is made in blocks of ``BLOCK`` words with a carry each, so a key costs nearly the same however long the line.
    """
    n = F.size("w")
    # each word is hashed with its own place and with the one before, once
    lines = lines.select("*", F.transform("w", lambda x, i: F.xxhash64(x, i + 1)).alias("here"), F.transform("w", lambda x, i: F.xxhash64(x, i)).alias("back"))
    lines = lines.select("*", _xor(F.col("here")).alias("placed"), _xor(F.col("back")).alias("up"), F.zip_with("here", "back", lambda x, y: x.bitwiseXOR(y)).alias("moved"))

    def block(b: Column) -> Column:
        return _running_xor(F.slice("moved", b * BLOCK + 1, F.lit(BLOCK)))

    lines = lines.select("*", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block).alias("blocks"))
    carries = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(F.element_at(x, -1)))))
    before = F.flatten(F.zip_with("blocks", F.slice(carries, F.lit(1), F.size("blocks")), lambda x, carry: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y.bitwiseXOR(carry))))
    # 2n tells that a word of n is missing at a place, 2n + 1 that a rest has n words
    lines = lines.select("h1", "h2", "first", "here", "back", "placed", "up", before.alias("before"), n.alias("n"), (2 * n).alias("at"), (2 * n - 1).alias("without"))
    same = F.transform("here", lambda x, i: F.xxhash64("at", i, F.col("placed").bitwiseXOR(x)))
    less = F.zip_with("before", "back", lambda x, y: F.xxhash64("without", x.bitwiseXOR(F.col("up").bitwiseXOR(y))))
    own = F.array(F.xxhash64(F.col("at") + 1, "placed"))
    # n keys without a word at its place, the whole line's, then those without a word, which repeat where words do
    keys = lines.select("h1", "h2", "first", "n", F.posexplode(F.concat(same, own, F.array_distinct(less))).alias("i", "key"))
    role = F.when(F.col("i") < F.col("n"), SAME).when(F.col("i") == F.col("n"), OWN).otherwise(LESS)
    return keys.select("h1", "h2", "first", "key", role.alias("role"))


def within_one(a: Column, b: Column) -> Column:
    """Do two word arrays differ by at most one word replaced, added or left out?"""

    def agree(x: Column, y: Column) -> Column:
        place = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(place == 0, F.least(F.size(x), F.size(y))).otherwise(place - 1)

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= longer - 1)


def dropped(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_hash, gone (array of line numbers that go) of documents that lose lines."""
    lines = lines_of(docs)
    ends = [f"end{i}" for i in range(1, 5)]
    pair = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2")]  # together the identity of a line
    marks = lines.select("doc_id", "text_hash", "line_no", "place", *pair, "line", _words().alias("n"))
    # lines that can have a partner keep their words, so that texts are split once
    marks = cut(marks.select("doc_id", "text_hash", "line_no", "place", "h1", "h2", *_ends(shortest), F.when(F.col("n") >= shortest, F.col("line")).alias("line")), "lines")
    firsts = cut(marks.groupBy("h1", "h2").agg(F.min("place").alias("first"), *[F.min(e).alias(e) for e in ends]), "lines")

    # lines that can have a partner: an end occurs with another line
    ended = firsts.filter("end1 is not null").select("h1", "h2", "first", F.explode(F.array(*ends)).alias("end")).filter("end is not null")
    same = Window.partitionBy("end")
    chosen = ended.select("*", F.min("h1").over(same).alias("low"), F.max("h1").over(same).alias("high")).filter("low <> high")
    chosen = cut(chosen.select("h1", "h2", "first").distinct(), "lines")
    texts = marks.filter("line is not null").select("h1", "h2", "place", "line").join(chosen.withColumnRenamed("first", "place"), ["h1", "h2", "place"])
    texts = cut(texts.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.col("place").alias("first"), F.transform(F.split("line", " "), lambda x: F.xxhash64(x)).alias("w")), "lines")

    keys = keys_of(texts)
    # a line meets the earliest of its length, a longer line the one it becomes, and that one the earliest of the longer
    longer = F.col("role") == LESS
    earliest = keys.groupBy("key").agg(F.min(F.when(~longer, F.col("first"))).alias("a"), F.min(F.when(longer, F.col("first"))).alias("b"), F.max("first").alias("high"))
    met = keys.join(earliest.filter("least(a, b) < high").drop("high"), "key").select("h1", "h2", "first", F.when(F.col("role") == OWN, F.col("b")).otherwise(F.col("a")).alias("e"))
    met = met.filter("e < first").select("h1", "h2", "e").distinct()
    other = texts.select(F.col("first").alias("e"), F.col("w").alias("x"))
    near = met.join(texts.select("h1", "h2", "w"), ["h1", "h2"]).join(other, "e").filter(within_one(F.col("w"), F.col("x")))
    near = cut(near.select("h1", "h2", F.lit(True).alias("near")).distinct(), "lines")

    judged = marks.select("doc_id", "text_hash", "line_no", "place", "h1", "h2").join(firsts.select("h1", "h2", "first").join(near, ["h1", "h2"], "left"), ["h1", "h2"])
    gone = judged.filter(F.coalesce("near", F.lit(False)) | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))


def dedup(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the lines that go, then n_lines and n_dropped (null text: 0).

    Columns of ``docs`` with the names of the two counts give way to them.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = dropped(docs.select("doc_id", "text"), shortest).select(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone"))
    rows = docs.withColumn("_text", F.xxhash64("text"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_hash")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1  # counted, not split: most texts keep all lines
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.coalesce(n, F.lit(0)).alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"))


def shortened(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with texts deduplicated and ``n_chars`` counted again; a document all of whose lines went is left out."""
    out = dedup(docs, shortest).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns if c in out.columns])
