"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked
with other values has the same template. Windows of template tokens are joined by hash; matches on
one diagonal (document position less item position) are added up, and the values in the
slots must map one to one between item and document. Names are told by their capital, so a second, literal form of both
sides keeps them as words: it finds copies in another letter case. Words that were added or left out move the rest of an item to another
diagonal; diagonals in a narrow band count together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

#: Template tokens of a window, least share of an item's tokens and least tokens that a leak covers, most windows of the benchmark that are broadcast.
WINDOW, SHARE, TOKENS, BROADCAST = 8, 0.5, 10, 1_000_000
#: Shifts in a band; any two at most half of it apart are in one. Bands overlap by half.
BAND = 16

# Placeholders (private-use characters), units that may follow a number.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "mm cm dm m km inch inches in ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl dl l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "usd eur mph kmh kph degree degrees c f k w kw v hz khz mhz ghz kb mb gb tb"
).split()

# Java regular expressions. A name is a capitalised word (not one in capitals) inside a sentence, after a lower-case letter or a comma and one space.
# Scripts without spaces between words: each character is a token.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# Code points among which all characters of these scripts are (other scripts' as well): a text without any is read without asking for the script of each character.
_MAYBE = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{19FF}\x{2E80}-\x{9FFF}\x{A9E0}-\x{AA7F}\x{F900}-\x{FAFF}\x{FE30}-\x{FFEF}\x{10000}-\x{10FFFF}]"
_LETTER = rf"[\p{{L}}\p{{M}}&&[^{_SINGLE}]]"
_CHARACTER = rf"[\p{{L}}\p{{M}}&&[{_SINGLE}]]"
_NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
_RAW = rf"{_LETTER}+|{_CHARACTER}|{_NUMBER}"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain(text: Column) -> Column:
    """The text without characters that stand for placeholders."""
    marks = NUMBER + NAME + UNIT
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "   ")).otherwise(text)


def marked(text: Column) -> Column:
    """Lower-case tokens of a text, with numbers and units as placeholders and names behind the mark of a name; as many as ``values`` has."""

    def tokens(letter: str, others: str) -> Column:
        name = rf"\p{{Lu}}(?<=[\p{{Ll}},] \p{{Lu}})\p{{Ll}}{letter}*"
        unit = rf"({NUMBER} ?)(?i:{'|'.join(UNITS)})(?!{letter})"
        slots = F.regexp_replace(F.regexp_replace(_plain(text), name, NAME + "$0"), _NUMBER, NUMBER)
        return F.regexp_extract_all(F.lower(F.regexp_replace(slots, unit, "$1" + UNIT)), F.lit(rf"{NAME}?{letter}+{others}|[{NUMBER}{UNIT}]"), F.lit(0))

    return F.when(text.rlike(_MAYBE), tokens(_LETTER, "|" + _CHARACTER)).otherwise(tokens(r"[\p{L}\p{M}]", ""))


def _form(tokens: Column, named: bool) -> Column:
    """Marked tokens with names as a placeholder, or (``named``) as words."""
    name = (lambda t: F.substring(t, 2, 1 << 30)) if named else (lambda t: F.lit(NAME))
    return F.transform(tokens, lambda t: F.when(t.startswith(NAME), name(t)).otherwise(t))


def template(text: Column) -> Column:
    """Lower-case template tokens of a text; as many as ``values`` has."""
    return _form(marked(text), False)


def forms(tokens: Column) -> Column:
    """The template and the literal form of marked tokens."""
    return _bind(tokens, lambda t: F.array(*[F.struct(F.lit(named).alias("named"), _form(t, named).alias("tokens")) for named in (False, True)]))


def values(text: Column) -> Column:
    """The tokens of a text as they stand, lower-cased."""
    lower = F.lower(_plain(text))
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(lower, F.lit(_RAW), F.lit(0))).otherwise(
        F.regexp_extract_all(lower, F.lit(rf"[\p{{L}}\p{{M}}]+|{_NUMBER}"), F.lit(0)))


def _paired(hashes: Column, apart: int) -> Column:
    """Hash of each element and the one ``apart`` places later."""
    return _bind(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - apart), F.slice(h, F.lit(1 + apart), F.size(h) - apart), lambda a, b: F.xxhash64(a, b)))


def _rolled(hashes: Column, window: int) -> Column:
    """Hash of each window of token hashes."""
    width = 1
    while width * 2 <= window:
        hashes, width = _paired(hashes, width), width * 2
    return _paired(hashes, window - width) if width < window else hashes


def window_hashes(tokens: Column, window: int = WINDOW) -> Column:
    """Hash of each window; a shorter text is one window that only another whole text can equal.

    Tokens are hashed once, then pairs, pairs of pairs and so on; two overlapping powers of two cover any other length.
    """

    def of(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= window, _rolled(F.transform(t, lambda x: F.xxhash64(x)), window)).when(n > 0, F.array(F.xxhash64(t, F.lit("whole")))).otherwise(F.array().cast("array<long>"))

    return _bind(tokens, of)


def document_windows(tokens: Column, window: int, lengths: list[int]) -> Column:
    """Position (doc_at) and hash of each window of a document, and of each run of tokens as long as a shorter item (``lengths``)."""

    def of(t: Column) -> Column:
        hashed = [F.transform(window_hashes(t, window), lambda h, i: F.struct(i.alias("doc_at"), h.alias("hash")))]
        for n in lengths:
            runs = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.struct(i.alias("doc_at"), F.xxhash64(F.slice(t, i + 1, F.lit(n)), F.lit("whole")).alias("hash")))
            hashed.append(F.when(F.size(t) > n, runs).otherwise(F.array().cast("array<struct<doc_at:int,hash:bigint>>")))
        return F.concat(*hashed) if lengths else hashed[0]

    return _bind(tokens, of)


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Forms of the benchmark's items: item_id, items, named, variant, tokens, words.

    Items with one template and the same pattern of equal slots are one class, named after its smallest item_id; ``items`` counts them. A class has
    one template and a literal form (``named``) for each different set of names; ``variant`` is the smallest item_id of a form.
    """
    rows = benchmark.select("item_id", marked(F.col("text")).alias("marked"), values(F.col("text")).alias("words")).where("size(marked) > 0")
    rows = rows.withColumns({"tokens": _form(F.col("marked"), False), "literal": _form(F.col("marked"), True)})
    pattern = F.transform("words", lambda w, i: F.when(_is_slot(F.get("tokens", i)), F.array_position("words", w)))
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct("tokens", pattern.alias("pattern"))), 256))
    first = [F.min("item_id").alias("variant"), F.min_by("words", "item_id").alias("words")]
    classes = keyed.groupBy("key", "tokens").agg(*first, F.count(F.lit(1)).alias("items"))
    names = classes.select("key", F.col("variant").alias("item_id"), "items")
    literal = keyed.groupBy("key", F.col("literal").alias("tokens")).agg(*first).join(names, "key")
    columns = ["item_id", "items", "named", "variant", "tokens", "words"]
    plain = classes.withColumns({"item_id": F.col("variant"), "named": F.lit(False)})
    return plain.select(columns).unionByName(literal.withColumn("named", F.lit(True)).select(columns))


def covered(starts: Column, window: Column) -> Column:
    """Tokens that windows at the sorted, distinct ``starts`` cover together."""
    zero = F.struct(F.lit(-1_000_000_000).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(window, s - a["last"])).cast("int").alias("n")), lambda a: a["n"])


def _key() -> Column:
    """Tells rows apart that share a doc_id, or have none."""
    return F.xxhash64(F.col("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, tokens: int = TOKENS, inside: bool = False) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, text_key, item_id, items, item_tokens, matched_tokens, slots, kind.

    One row per document and class of items. A leak covers at least ``share`` of the item's tokens and at least ``tokens`` of them (or the whole of a shorter
    item) on the diagonals of one band, in the template or the literal form. An item of fewer tokens than a window is found inside a longer document where ``inside`` is set, otherwise only where it is
    the whole document; without a word among its slots it is found with its own values only. ``kind`` is ``exact`` where the slots hold the item's values and ``reparameterised`` where other
    values map to them one to one; where they don't, only windows without a slot count (``partial``).

    Null or empty texts on either side match nothing. Null doc_id and rows sharing a doc_id are told apart by their text; repeated rows are
    one row of the result. Ties between bands and forms go to the larger cover, then to more slots. Empty tables give no rows; extra columns are ignored; texts are searched whole.
    """
    items = cut_lineage(item_classes(benchmark), "leak-items")
    windows = cut_lineage(items.select("variant", "named", F.posexplode(window_hashes(F.col("tokens"), window)).alias("item_at", "hash")), "leak-windows")
    lengths = []
    if inside:  # below the window, so a few at most
        lengths = sorted(r.n for r in items.where(F.size("tokens") < window).select(F.size("tokens").alias("n")).distinct().collect())
    known = windows.select("hash").distinct()
    if windows.count() <= BROADCAST:  # otherwise Spark joins the two by shuffle
        known = F.broadcast(known)
    texts = docs.where("text is not null").select("doc_id", "text")

    def all_hashes(t: Column) -> Column:
        if lengths:
            return F.transform(document_windows(t, window, lengths), lambda w: w["hash"])
        return window_hashes(t, window)

    # without a name both forms are one
    def of_both(t: Column) -> Column:
        named = F.exists(t, lambda x: x.startswith(NAME))
        return F.when(named, F.concat(all_hashes(_form(t, False)), all_hashes(_form(t, True)))).otherwise(all_hashes(t))

    both = _bind(marked(F.col("text")), of_both)
    seen = texts.select("doc_id", _key().alias("text_key"), F.explode(both).alias("hash"))
    suspects = cut_lineage(seen.join(known, "hash", "left_semi").select("doc_id", "text_key").distinct(), "leak-suspects")

    # Only the suspects are looked at closely.
    keyed = texts.withColumn("text_key", _key())
    near = keyed.join(suspects.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["doc_id", "text_key"])
    read = cut_lineage(near.select("doc_id", "text_key", F.inline(forms(marked(F.col("text")))), values(F.col("text")).alias("doc_words")), "leak-read").withColumnRenamed("tokens", "doc_tokens")
    places = read.select("doc_id", "text_key", "named", F.inline(document_windows(F.col("doc_tokens"), window, lengths)))
    shift = F.col("doc_at") - F.col("item_at")
    # A band holds as many places as an item has windows, times its shifts.
    met = places.join(windows, ["hash", "named"]).select("doc_id", "text_key", "named", "variant", F.struct(F.col("item_at").alias("at"), shift.alias("shift")).alias("place"))
    half = F.floor(F.col("place.shift") / F.lit(BAND // 2))
    hits = met.withColumn("band", F.explode(F.array(half, half + 1))).groupBy("doc_id", "text_key", "named", "variant", "band").agg(F.array_sort(F.collect_set("place")).alias("starts"))
    width = F.least(F.lit(window), F.size("tokens"))
    need = F.least(F.size("tokens"), F.greatest(F.lit(tokens), F.ceil(F.size("tokens") * F.lit(share))))

    def cover(places: Column) -> Column:
        return covered(F.array_distinct(F.transform(places, lambda p: p["at"])), width)

    whole = read.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("named").alias("_named"), "doc_tokens", "doc_words")
    same = hits.join(items, ["variant", "named"]).where(cover(F.col("starts")) >= need).join(
        whole, (F.col("text_key") == F.col("_key")) & (F.col("named") == F.col("_named")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    ).drop("_doc", "_key", "_named")
    # hashes only suggest: the tokens under each window must be equal
    starts = F.filter("starts", lambda s: F.slice("tokens", s["at"] + 1, width) == F.slice("doc_tokens", s["at"] + s["shift"] + 1, width))
    under = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(s["at"], s["at"] + width - 1), lambda i: F.struct(i.alias("at"), (i + s["shift"]).alias("doc_at"))))))
    pairs = F.array_distinct(F.transform(
        F.filter("under", lambda u: _is_slot(F.get("tokens", u["at"]))),
        lambda u: F.struct(F.get("tokens", u["at"]).alias("type"), F.get("words", u["at"]).alias("item"), F.get("doc_words", u["doc_at"]).alias("doc")),
    ))
    plain = F.filter("starts", lambda s: ~F.exists(F.slice("tokens", s["at"] + 1, width), _is_slot))

    def distinct(side: str) -> Column:
        return F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["type"], p[side]))))

    worded = (F.size("tokens") >= window) | F.exists("tokens", lambda t: ~_is_slot(t))
    one_to_one = worded & (distinct("item") == F.size("pairs")) & (distinct("doc") == F.size("pairs"))
    judged = cut_lineage(same.withColumn("starts", starts), "leak-same").withColumn("under", under)
    judged = cut_lineage(judged.withColumn("pairs", pairs).drop("under", "words", "doc_words", "doc_tokens"), "leak-pairs").withColumn(
        "kind", F.when(F.forall("pairs", lambda p: p["item"] == p["doc"]), "exact").when(one_to_one, "reparameterised").otherwise("partial")
    ).withColumn("matched_tokens", F.when(F.col("kind") == "partial", cover(plain)).otherwise(cover(F.col("starts"))))
    found = judged.where(F.col("matched_tokens") >= need).select(
        "doc_id", "text_key", "item_id", "items", F.size("tokens").alias("item_tokens"), "matched_tokens", F.size("pairs").alias("slots"), "kind"
    )
    best = F.struct("matched_tokens", "slots", "kind", "items", "item_tokens")
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max(best).alias("b")).select(
        "doc_id", "text_key", "item_id", "b.items", "b.item_tokens", "b.matched_tokens", "b.slots", "b.kind"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, inside: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = cut_lineage(leaks(docs, benchmark, inside=inside).select("text_key").distinct(), "leak-found")
    return docs.join(found, F.xxhash64(docs["text"]) == found["text_key"], "left_anti")
