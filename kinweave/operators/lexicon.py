"""Terms of a lexicon table in texts: an index by first words instead of one pattern of all terms.

A term is found where it stands between characters that are no letters, in any case, as by
:func:`kinweave.functions.text.terms`. Terms that begin and end with a letter are looked up whole: a
text asks once for each run of as many words as terms have, and an equi-join on that run is the answer.
Every other term is filed under its first two words, or its only one; every place of a text where a
word begins asks for its own first one and two words, and takes along as many characters as the longest
of these terms has. An equi-join brings both together, and only then the characters are compared. So
the work for a text does not grow with the lexicon, nor with the length of terms of few words.

Found terms are not shuffled: a text asks for a run once, so only texts that share an id, and terms filed
under first words, have something to make distinct. Of a large lexicon the terms listed most often are sent
to every task; for the others a text asks by a shuffle, but only for keys that a table of bits has marked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.operators.skew import cut, cut_counted

# Lexicons of up to so many terms are sent to every task; of larger ones so many terms, the others are joined by a shuffle.
SENT_TERMS = 200_000
# Bits for each term that is not sent, and for all of them together: 128 MB.
TERM_BITS, ALL_BITS = 32, 1 << 30
# Bits are kept in rows of 64 longs.
ROW_BITS = 64 * 64
ONE, TWO = "^[a-z]+", "^[a-z]+[^a-z]+[a-z]+"
# Terms that begin and end with a letter, of up to so many words, are looked up as a whole.
WHOLE_WORDS = 4
WHOLE = rf"^[a-z]++([^a-z]++[a-z]++){{0,{WHOLE_WORDS - 1}}}\z"


def _index(terms: DataFrame) -> DataFrame:
    """(key, term, low, words, listed): terms by themselves, or by their first two words, one word, or first character where that is no letter."""
    some = lambda pattern: F.nullif(F.regexp_extract("low", pattern, 0), F.lit(""))
    listed = terms.where(F.trim("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("listed")).withColumn("low", F.lower("term"))
    words = F.when(F.col("low").rlike(WHOLE), F.size(F.split("low", "[^a-z]+"))).otherwise(0)
    key = F.when(F.col("words") > 0, F.col("low")).otherwise(F.coalesce(some(TWO), some(ONE), F.substring("low", 1, 1)))
    return listed.withColumn("words", words).select(key.alias("key"), "term", "low", "words", "listed")


def _places(text: Column, longest: int, letters_only: bool) -> Column:
    """The characters from each place on where a term may begin, one more than the longest term has, distinct."""
    first = "[A-Za-z]" if letters_only else r"\S"
    pattern = rf"(?s)(?<![A-Za-z])(?={first})(?=(.{{1,{longest + 1}}}))"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower))


def _runs(low: Column, words: int) -> Column:
    """Each run of so many words in a lower-case text, from letter to letter, once."""
    pattern = "(?<![a-z])(?=([a-z]++" + "[^a-z]++[a-z]++" * (words - 1) + "))[a-z]++"
    return F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))


def _sent_or_not(index: DataFrame) -> DataFrame:
    """The index with a column ``sent``: true for at most SENT_TERMS terms, those of the keys listed most often, short ones first."""
    keys = index.groupBy("key").agg(F.sum("listed").alias("often"), F.count(F.lit(1)).alias("n"))
    keys = keys.withColumn("length", F.least(F.length("key"), F.lit(100)))
    # A key listed k times takes k rows of the lexicon, so the square root of these bounds the number of classes.
    classes = keys.groupBy("often", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("often"), "length").collect()
    sent, total = F.lit(False), 0
    for c in classes:
        if (total := total + c["n"]) > SENT_TERMS:
            break
        sent = (F.col("often") > c["often"]) | ((F.col("often") == c["often"]) & (F.col("length") <= c["length"]))
    return cut(index.select("key", "term", "low").join(keys.select("key", sent.alias("sent")), "key"))


def _marked(asked: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The asked rows whose key may be in an index of n terms: all that are, and few others."""
    rows = min(n * TERM_BITS, ALL_BITS) // ROW_BITS + 1
    place = F.pmod(F.xxhash64("key"), F.lit(rows * ROW_BITS).cast("long")).alias("_place")
    row, word, bit = F.floor(F.col("_place") / ROW_BITS), (F.col("_place") % ROW_BITS / 64).cast("int"), (F.col("_place") % 64).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = index.select(place).groupBy(row.alias("_row"), word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    bits = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits")).select("_row", F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long"))).alias("_bits"))
    met = asked.select("*", place).withColumn("_row", row).join(F.broadcast(bits), "_row")
    return met.where(F.get("_bits", word).bitwiseAND(mask) != 0).select(*asked.columns)


def _met(asked: DataFrame, index: DataFrame, n: int, join: str) -> DataFrame:
    if n <= SENT_TERMS:
        return asked.join(F.broadcast(index.select("key", "term", "low")), "key")
    index = _sent_or_not(index)
    sent, others = index.where("sent").drop("sent"), index.where("NOT sent").drop("sent")
    left = others.count()
    by_shuffle = _marked(asked, others, left).join(others.hint(join), "key")
    return by_shuffle if left == n else asked.join(F.broadcast(sent), "key").unionByName(by_shuffle)


def _whole(texts: DataFrame, index: DataFrame, n: int, id_col: str, text_col: str, words: list[int]) -> DataFrame:
    runs = [_runs(F.col("low"), w) for w in words]
    asked = texts.select(id_col, F.lower(text_col).alias("low")).select(id_col, F.explode(F.concat(*runs)).alias("key"))
    # A key has no more terms than it has ways to write it, so a task can hold its share of the index and needs no sort.
    return _met(asked, index, n, "shuffle_hash").select(id_col, "term")


def _by_first_words(texts: DataFrame, index: DataFrame, n: int, id_col: str, text_col: str, longest: int, letters_only: bool) -> DataFrame:
    asked = texts.select(F.col(id_col), F.explode(_places(F.col(text_col), longest, letters_only)).alias("ahead"))
    some = lambda pattern: F.nullif(F.regexp_extract("ahead", pattern, 0), F.lit(""))
    keys = F.array_compact(F.array(some(TWO), F.coalesce(some(ONE), F.substring("ahead", 1, 1))))
    asked = asked.select(id_col, "ahead", F.explode(keys).alias("key"))
    behind = F.substr("ahead", F.length("low") + 1, F.lit(1))
    found = _met(asked, index, n, "merge").where(F.col("ahead").startswith(F.col("low")) & ~behind.rlike("[a-z]"))
    return found.select(id_col, "term").distinct()


def _by_repeated_id(texts: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts whose id no other text has, and those, if any, that share theirs."""
    again, n = cut_counted(texts.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("again")))
    if not n:
        return texts, None
    same = texts[id_col].eqNullSafe(again["again"])
    return texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")


def tag(texts: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text", term_col: str = "term") -> DataFrame:
    """(id, term): each term of the lexicon that stands in the text, once. Null texts and blank terms hold nothing."""
    index = cut(_index(lexicon.select(F.col(term_col).alias("term"))))
    # One row for each number of words, none above WHOLE_WORDS.
    shapes = {r["words"]: r for r in index.groupBy("words").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("low")).alias("longest"), F.bool_and(F.col("low").rlike(ONE)).alias("letters")).collect()}
    parts = []
    if whole := sorted(w for w in shapes if w):
        once, shared = _by_repeated_id(texts, id_col)
        asked_for = index.where("words > 0"), sum(shapes[w]["n"] for w in whole), id_col, text_col, whole
        parts.append(_whole(once, *asked_for))
        if shared is not None:
            parts.append(_whole(shared, *asked_for).distinct())
    if rest := shapes.get(0):
        parts.append(_by_first_words(texts, index.where("words = 0"), rest["n"], id_col, text_col, rest["longest"], rest["letters"]))
    if not parts:
        return texts.select(F.col(id_col), F.lit(None).cast("string").alias("term")).limit(0)
    return reduce(DataFrame.unionByName, parts)
