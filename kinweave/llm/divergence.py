"""How the sources of a language differ in their terms: divergence of every source from every other.

The terms of a language form one axis, its sources two. Sources and terms are cut into blocks, and a task
owns one cell (source block, source block, term block): it gets the two slices of counts that meet there,
computes the share of every divergence that these terms make up, and the shares are summed along the
term axis. Slices are sparse; a term that neither slice holds adds the same amount to a pair whatever
the term, so such terms come in as a number, not as rows. No task holds a whole source or a whole
vocabulary, whatever share of the rows one source has.

All arithmetic is in whole numbers. A term that occurs ``c`` times among the ``N`` kept occurrences of a
source, in a language of ``V`` kept terms, has ``p = 1 + floor(10^9 (c + 1) / (N + V))``; the divergence of
``p`` from ``q`` at a term is ``floor((p - q)^2 / q)``. Exact while ``N + V`` of a language stays below
9 * 10^15.

Null texts, languages and sources count as empty texts; a source without terms still takes part, with a
count of 0 everywhere. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinweave.llm.words import LOWER, Texts, blocks_of
from kinweave.operators.skew import cut, cut_counted, join_counted

#: Sources and terms in a block, on average. A cell holds 2 * 32 * 4,096 counts, 4 MB as whole numbers.
SOURCES = 32
TERMS = 4096
#: Tables of totals up to so many rows are sent to every task; larger ones are joined by a shuffle.
SENT = 20_000
#: Text worked on at once by the term counter.
BLOCK_BYTES = 16 << 20

SCALE = 10**9
#: ASCII letters and all bytes of characters beyond ASCII make up terms.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ---------------------------------------------------------------- counting ----


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a few megabytes of texts at a time."""
    for block in blocks_of(batches, "text", BLOCK_BYTES):
        texts = Texts(block.column("text"))
        letters = TERM_BYTE[texts.data]
        starts, ends, first = texts.runs(~letters)
        if not len(starts):
            continue
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        terms = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[texts.data][letters])]
        ).dictionary_encode()
        code, size = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        lang, source = (block.column(c).dictionary_encode() for c in ("lang", "source"))
        named = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, of_text = np.unique(named, return_index=True, return_inverse=True)[1:]
        in_text, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * size + code, return_counts=True)
        key, place = np.unique(of_text[in_text // size] * size + in_text % size, return_inverse=True)
        group = groups[key // size]
        yield pa.RecordBatch.from_pydict({
            "lang": block.column("lang").take(pa.array(group)), "source": block.column("source").take(pa.array(group)),
            "term": terms.dictionary.take(pa.array(key % size)).cast(pa.large_string()),
            "n": np.bincount(place, times).astype(np.int64), "docs": np.bincount(place).astype(np.int64),
        })


def kept_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of terms that at least ``min_docs`` texts of the language hold.

    ``lang_n`` counts the term in the whole language; ``first`` marks one row of each (lang, term).
    Tasks sum up a few megabytes before the one shuffle, by language and term, which serves both sums.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    each = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    return (
        each.withColumn("_docs", F.sum("docs").over(term)).where(F.col("_docs") >= min_docs)
        .withColumn("lang_n", F.sum("n").over(term))
        .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
        .drop("_docs", "docs")
    )


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, sources, rows): one row for every source of every language."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("firsts"), F.count(F.lit(1)).alias("rows"))
    each = docs.select(*named).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "firsts", "rows"])
    lang = W.partitionBy("lang")
    return each.select(
        "lang", "source", F.col("n").alias("total"), F.sum("n").over(lang).alias("lang_total"),
        F.sum("firsts").over(lang).alias("terms"), F.count(F.lit(1)).over(lang).alias("sources"), "rows",
    )


def with_totals(left: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """The rows with the totals of their source: sent where they are few, else joined with hot sources dealt out."""
    if n_groups <= SENT:
        return left.join(F.broadcast(groups.drop("rows")), ["lang", "source"])
    return join_counted(left, groups, ["lang", "source"], count="rows")


# ------------------------------------------------------------- whole numbers ----


def probability(count: str, total: str) -> Column:
    """1 + floor(10^9 * count / total) for 0 < count <= total, by long division, so nothing passes 63 bits."""
    rest, out = count, "1L"
    for power in (1_000_000, 1_000, 1):
        rest = f"(({rest}) * 1000L)"
        out += f" + ({rest} div ({total})) * {power}L"
        rest = f"({rest} % ({total}))"
    return F.expr(out)


def probabilities(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    rest, out = count, np.ones_like(count)
    for power in (1_000_000, 1_000, 1):
        high, rest = np.divmod(rest * 1000, total)
        out = out + high * power
    return out


# -------------------------------------------------------------------- cube ----


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """The share of a cell in the divergences between the sources of its two blocks, both ways round."""
    first = key[3].as_py() == 0
    head = rows.filter(pc.is_null(rows["term"]))
    body = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
    source, block, whole = head["source"].to_pylist(), head["block"].to_numpy(), head["n"].to_numpy() + head["terms"].to_numpy()
    names = {name: i for i, name in enumerate(source)}
    size = 0
    p = np.zeros((len(source), 0), np.int64)
    if len(body):
        coded = body["term"].combine_chunks().dictionary_encode()
        size = len(coded.dictionary)
        counts = np.ones((len(source), size), np.int64)
        counts[[names[name] for name in body["source"].to_pylist()], coded.indices.to_numpy()] += body["n"].to_numpy()
        p = probabilities(counts, whole[:, None])
    # What a term adds that neither source has; the cells of the first term block add it for the whole vocabulary.
    bare = probabilities(np.ones(len(source), np.int64), np.maximum(whole, 1))
    times = (head["terms"][0].as_py() if first else 0) - size
    out: dict[str, list] = {"source": [], "item": [], "part": []}
    low, high = (np.flatnonzero(block == key[i].as_py()) for i in (1, 2))
    for mine, theirs in [(low, high), (high, low)][:1 if key[1] == key[2] else 2]:
        for i in mine:
            others = theirs[theirs != i]
            q = p[others]
            value = ((p[i] - q) ** 2 // q).sum(axis=1) + (bare[i] - bare[others]) ** 2 // bare[others] * times
            out["source"] += [source[i]] * len(others)
            out["item"] += [source[j] for j in others]
            out["part"] += value.tolist()
    return pa.table({"lang": pa.array([key[0].as_py()] * len(out["part"]), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "part": pa.array(out["part"], pa.int64())})


def pair_divergence(kept: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): divergence of each source from each other source of its language."""
    n_blocks = F.ceil(F.col("sources") / SOURCES).cast("int")
    n_terms = F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int")
    # A row for each source in each of its cells, with its totals, also where it has no term there.
    heads = groups.where("sources > 1").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms", n_blocks.alias("_blocks"),
        F.explode(F.sequence(F.lit(0), n_terms - 1)).alias("term_block"))
    body = with_totals(kept.select("lang", "source", "term", "n"), groups, n_groups).where("sources > 1").select(
        "lang", "source", "term", "n", "terms", n_blocks.alias("_blocks"),
        F.pmod(F.xxhash64("term"), n_terms.cast("long")).cast("int").alias("term_block"))
    meets = (
        heads.unionByName(body)
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("_blocks").cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("lang", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "term_block",
                "source", "block", "term", "n", "terms")
    )
    shares = meets.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, "lang string, source string, item string, part long")
    return shares.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def term_divergence(kept: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): terms that a source uses more than its language does, and how much."""
    rated = with_totals(kept.drop("first"), groups, n_groups).select(
        "lang", "source", F.col("term").alias("item"),
        probability("n + 1", "total + terms").alias("_p"), probability("lang_n + 1", "lang_total + terms").alias("_q"))
    return rated.where("_p > _q").select("lang", "source", "item", F.expr("(_p - _q) * (_p - _q) div _q").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources (``pair``), and each source's ``top`` terms (``term``)."""
    kept = cut(kept_counts(docs, min_docs))
    groups, n_groups = cut_counted(totals(docs, kept))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(kept, groups, n_groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = term_divergence(kept, groups, n_groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms.where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
