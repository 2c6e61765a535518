"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units of measure are replaced with typed placeholders, and what is
replaced is remembered as the filling of its slot. Windows of template tokens of benchmark items are
hash-joined with those of documents. Along an alignment, slots must be filled consistently: one value of
the item stands for one value of the document; new values may coincide. A document leaks an item if
consistent windows cover enough of the item, so questions with other numbers and names are found too.

A window with few literal tokens says too little as a template: of "What is 7 times 8?" two words are left. An item
with such a window is also looked for word by word, as it stands, in windows of words. The better cover counts.

Tokens: words without leading and trailing signs, A-Z lower-cased; words without letter or digit are left
out. A word with a digit is a number; a known unit is a unit; a word with a first upper-case letter and a
small one after it, not at the start of a sentence or line, is a name, and neighbouring names are one.

Defined cases: null and empty texts and items leak nothing. Items shorter than a window are one window of
their own length. Rows that repeat give one result per (doc_id, item_id); a null doc_id is one group of its
own. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm import words
from tidelight.session import cut

#: Tokens of a window, literal tokens it must have, share of an item's windows that makes a leak.
WINDOW, LITERAL, COVER = 8, 4, 0.3
#: Bits of the filter that lets through document windows that may be an item's: 2 MB, whatever the input.
FILTER_BITS = 24
# Units of measure and money, singular and plural.
UNITS = """mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs
ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres
dollar dollars cent cents euro euros usd eur degree degrees celsius fahrenheit percent watt watts kwh volt volts mph kmh""".split()
_NUMBER, _UNIT, _NAME = (words.mix(np.array([k], np.uint64))[0] for k in (1, 2, 3))
_UNIT_HASHES = np.sort([words.span((t := words.Texts(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]))).prefix(), np.array([0]), np.array([len(u)]))[0] for u in UNITS])
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:;\n\""]] = True


def templates(texts: words.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, fillings (0 at literal tokens), literal flags, bounds of the texts among them; words and their bounds."""
    starts, ends, owner = texts.words()
    raw = texts.raw
    good = np.concatenate([[0], np.cumsum(_ALNUM[raw])])
    places = np.flatnonzero(_ALNUM[raw])
    has = good[ends] > good[starts]
    left, right = np.zeros_like(starts), np.zeros_like(ends)
    left[has], right[has] = places[good[starts[has]]], places[good[ends[has]] - 1] + 1
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    # a sentence starts where, since the last token, a stop or the start of the text lies
    starts, ends, owner, left, right = starts[has], ends[has], owner[has], left[has], right[has]
    before = np.concatenate([[0], right[:-1]]) if len(right) else right
    opens = (stops[left] > stops[before]) | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
    hashed = words.span(texts.prefix(), left, right)
    plain = hashed, np.searchsorted(owner, np.arange(len(texts) + 1))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = digits[right] > digits[left]
    unit = ~number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, hashed), len(_UNIT_HASHES) - 1)] == hashed)
    first, second = raw[left], raw[np.minimum(left + 1, len(raw) - 1)] if len(raw) else raw[left]
    wide = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)  # capitals of Latin-1 in UTF-8
    third = raw[np.minimum(left + 2, len(raw) - 1)] if len(raw) else second
    capital = ((first >= 65) & (first <= 90) & (right - left > 1) & ~((second >= 65) & (second <= 90))) | (wide & (right - left > 2) & ~((third >= 65) & (third <= 90)))
    name = capital & ~opens & ~number & ~unit
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, hashed)))
    filling = np.where(number | unit | name, hashed, np.uint64(0))
    joins = name & np.concatenate([[False], name[:-1] & (owner[1:] == owner[:-1])])[: len(name)]
    if joins.any():  # neighbouring names: one token, filled with all of them
        run = np.cumsum(~joins) - 1
        place = np.arange(len(joins)) - np.flatnonzero(~joins)[run]
        total = np.zeros(run[-1] + 1, np.uint64)
        np.add.at(total, run, words.mix(filling + place.astype(np.uint64)))
        token, owner, name = token[~joins], owner[~joins], name[~joins]
        filling = np.where(name, total, filling[~joins])
        filling = filling.astype(np.uint64)
    else:
        filling = np.where(name, words.mix(words.mix(filling)), filling) if len(filling) else filling
    return token, filling, filling == 0, np.searchsorted(owner, np.arange(len(texts) + 1)), *plain


def _windows(token: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window that starts at each token (the last size - 1 ones have none)."""
    out, weight = np.zeros(max(0, len(token) - size + 1), np.uint64), words.mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    for k in range(size):
        out += words.mix(token[k : k + len(out)] * weight[k] + np.uint64(k))
    return words.mix(out + np.uint64(size))


_SCHEMA = "window long, at long, tokens int, literal boolean, fillings array<long>"
_LITERAL = words.mix(np.array([4], np.uint64))[0]


def windows(table: DataFrame, key: str, sizes: list[int] | None, window: int, literal: int, seen: np.ndarray | None = None, plain: list[int] | None = None) -> DataFrame:
    """key, window (hash), at (token number), tokens (of the window), literal (of words as they stand), fillings (of its tokens, 0 at literal ones; none for words).

    ``sizes`` and ``plain``: sizes of template and of word windows to cut. Without ``sizes``, as for items: ``window``, or the
    whole text if that is shorter; word windows are cut of texts that have a window with too few literal tokens.
    ``seen``: filter of window hashes that are wanted.
    """
    shared = table.sparkSession.sparkContext.broadcast(seen) if seen is not None else None
    kind = table.schema[key].dataType.simpleString()

    def wanted(hashed: np.ndarray) -> np.ndarray:
        if shared is None:
            return np.ones(len(hashed), bool)
        bit = (hashed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def whole(token: np.ndarray, bounds: np.ndarray, cut_to: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sizes, with the tokens where a window begins and their texts."""
        length = np.diff(bounds)
        owner = np.repeat(np.arange(len(length)), length)
        for size in sorted({window, *[int(n) for n in length if 0 < n < window]}) if cut_to is None else cut_to:
            at = np.arange(max(0, len(token) - size + 1))
            fits = owner[at] == owner[at + size - 1]
            if cut_to is None and size < window:
                fits &= length[owner[at]] == size
            yield size, at[fits], owner[at[fits]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in words.slices(batch.column(1)):
                token, filling, literals, bounds, word, word_bounds = templates(texts)
                count = np.concatenate([[0], np.cumsum(literals)])
                poor = np.zeros(len(texts), bool)

                def rows(size: int, at: np.ndarray, of: np.ndarray, hashed: np.ndarray, first: np.ndarray, by_word: bool) -> Iterator[pa.RecordBatch]:
                    for a in range(0, len(at), 20_000):
                        part, whose = at[a : a + 20_000], of[a : a + 20_000]
                        width = 0 if by_word else size
                        flat = filling[part[:, None] + np.arange(width)].view(np.int64).ravel() if width else np.zeros(0, np.int64)
                        slots = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(flat))
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(row + whose)), pa.array(hashed[part].view(np.int64)), pa.array(part - first[whose]),
                            pa.array(np.full(len(part), size, np.int32)), pa.array(np.full(len(part), by_word)), slots,
                        ], [key, "window", "at", "tokens", "literal", "fillings"])

                for size, at, of in whole(token, bounds, sizes):
                    rich = count[at + size] - count[at] >= min(literal, size)
                    poor[of[~rich]] = True
                    hashed = _windows(token, size)
                    fits = rich & wanted(hashed[at])
                    yield from rows(size, at[fits], of[fits], hashed, bounds, False)
                if sizes is None and not poor.any():
                    continue
                for size, at, of in whole(word, word_bounds, plain if sizes is not None else None):
                    hashed = words.mix(_windows(word, size) ^ _LITERAL)
                    fits = wanted(hashed[at]) & (poor[of] if sizes is None else True)
                    yield from rows(size, at[fits], of[fits], hashed, word_bounds, True)

    return table.select(key, "text").mapInArrow(run, f"{key} {kind}, {_SCHEMA}")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched (its distinct windows met with consistent slots), n_slots (values replaced), cover.

    Windows are those of the kind, templates or words as they stand, that covers more of the item.
    """
    wanted = cut(windows(items, "item_id", None, window, literal), "leaks")
    of_item = wanted.select("item_id", "literal", "window").distinct().groupBy("item_id", "literal").agg(F.count(F.lit(1)).alias("n_windows"))
    byte = F.shiftrightunsigned("window", 64 - FILTER_BITS)
    marks = wanted.groupBy(F.shiftright(byte, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(window, {64 - FILTER_BITS}) & 7 as int))")).alias("bits")).toPandas()  # at most 2^(FILTER_BITS - 3) rows
    seen = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    seen[marks["byte"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).astype(np.uint8)
    cuts = [(r["literal"], r["tokens"]) for r in wanted.select("literal", "tokens").distinct().collect()]  # at most twice ``window``
    sizes, plain = [sorted(n for by_word, n in cuts if by_word == kind) for kind in (False, True)]
    found = windows(docs, "doc_id", sizes, window, literal, seen, plain).drop("literal", "tokens")
    met = wanted.select("item_id", "window", "literal", F.col("at").alias("item_at"), F.col("fillings").alias("item_fillings")).join(found, "window")
    met = cut(met.select("doc_id", "item_id", "window", "literal", (F.col("at") - F.col("item_at")).alias("shift"), "item_fillings", "fillings"), "leaks")
    # an alignment is a document, an item and the distance between their tokens; words as they stand need none
    place = ["doc_id", "item_id", "shift"]
    slots = met.filter(~F.col("literal") & F.exists("fillings", lambda x: x != 0)).select(*place, F.explode(F.arrays_zip(F.col("item_fillings").alias("a"), F.col("fillings").alias("b"))).alias("slot"))
    slots = slots.select(*place, F.col("slot.a").alias("a"), F.col("slot.b").alias("b")).filter("b <> 0").distinct()
    one = slots.groupBy(*place, "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    wrong = one.filter("n > 1").select(*place).distinct()
    changed = one.groupBy("doc_id", "item_id").agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_slots"))

    def same(x: str) -> list:
        return [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), *[F.col(c).alias(c) for c in ("item_id", "shift")]]

    good = met.filter(~F.col("literal")).select("*", *same("")[:2]).join(wrong.select(*same("")), ["k", "none", "item_id", "shift"], "left_anti")
    good = good.select("k", "none", "item_id", "literal", "window").unionByName(met.filter("literal").select(*same("")[:2], "item_id", "literal", "window"))
    kept = good.distinct().groupBy("k", "none", "item_id", "literal").agg(F.count(F.lit(1)).alias("n_matched"))
    changed = changed.select(*same("")[:2], "item_id", "n_slots").withColumn("literal", F.lit(False))
    out = kept.join(of_item, ["item_id", "literal"]).withColumn("cover", F.col("n_matched") / F.col("n_windows"))
    out = out.join(changed, ["k", "none", "item_id", "literal"], "left")
    best = F.max_by(F.struct("n_windows", "n_matched", "n_slots", "cover"), F.struct("cover", ~F.col("literal")))
    out = out.groupBy("k", "none", "item_id").agg(best.alias("best"))
    return out.select(F.when(~F.col("none"), F.col("k")).alias("doc_id"), "item_id", "best.n_windows", "best.n_matched", F.coalesce("best.n_slots", F.lit(0)).alias("n_slots"), "best.cover")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, literal: int = LITERAL, cover: float = COVER) -> DataFrame:
    """The (document, item) pairs of ``matches`` that cover enough of the item."""
    return matches(docs, items, window, literal).filter(F.col("cover") >= cover)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that leak no item."""
    found = leaks(docs, items).select(F.col("doc_id").alias("_of")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_of")), "left_anti")
