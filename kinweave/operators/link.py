"""Which candidates describe the same person.

Every way of matching becomes a blocking key. Candidates sharing a key are tied
to the smallest id of the key (a star), never to each other, so the number of
edges is linear in the number of keys whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions import standardize as N
from kinweave.operators.components import connected_components
from kinweave.operators.skew import cut, cut_counted, join_counted

# Name similarity: shared / all tokens >= 17/20, kept in whole numbers.
NUM, DEN = 17, 20
# The smallest set that matches a different one has six tokens (6/7).
FUZZY_TOKENS = 6
# Up to this many distinct tokens a name is filed under itself and itself less one
# token (14 keys at most); longer names meet in their rarest tokens.
DELETION_TOKENS = 13
# Members of a group of names with a common rare token that are compared in one block.
BLOCK_SETS = 1024


# ----------------------------------------------------- pairwise predicates ----


def name_tokens(c: Column) -> Column:
    """Distinct lower-case tokens, sorted."""
    words = F.filter(F.split(N.squeeze(F.lower(N.trim(c))), " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def token_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared.cast("double"), F.size(F.array_union(a, b)))


def name_match(a: Column, b: Column) -> Column:
    """Equal names, or token sets overlapping by at least 0.85; false when either is empty."""
    x, y = name_tokens(a), name_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    close = shared * DEN >= F.size(F.array_union(x, y)) * NUM
    return F.coalesce((a != "") & (b != "") & close, F.lit(False))


def place_match(a: Column, b: Column) -> Column:
    """Same city in any case, or same country; false when either is absent."""
    city = (F.lower(a["city"]) == F.lower(b["city"])) & (a["city"] != "")
    nation = (a["country"] == b["country"]) & (a["country"] != "")
    return F.coalesce(city, F.lit(False)) | F.coalesce(nation, F.lit(False))


def signal_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


# ------------------------------------------------------------ blocking keys ----


def _own_id(records: DataFrame) -> DataFrame:
    return records.where(F.col("candidate_id") != "")


def strong_signals(records: DataFrame) -> DataFrame:
    """Distinct (candidate_id, kind, key): mail addresses, phones and account handles."""
    urls = F.transform(F.col("links"), lambda x: x["url"])

    def keyed(kind: str, arr: Column) -> Column:
        return F.transform(
            F.coalesce(arr, F.array().cast("array<string>")),
            lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")),
        )

    every = F.concat(
        keyed("email", F.transform("emails", F.lower)),
        keyed("phone", F.col("phones")),
        keyed("github", F.transform(urls, lambda u: F.lower(N.github_handle(u)))),
        keyed("linkedin", F.transform(urls, lambda u: F.lower(N.linkedin_handle(u)))),
    )
    return (
        _own_id(records)
        .select("candidate_id", F.explode(every).alias("s"))
        .select("candidate_id", "s.kind", "s.key")
        .where(F.col("key") != "")
        .distinct()
    )


def _names(records: DataFrame) -> DataFrame:
    return (
        _own_id(records)
        .where(F.col("full_name") != "")
        .select("candidate_id", name_tokens(F.col("full_name")).alias("tokens"))
        .distinct()
    )


def _places(records: DataFrame) -> DataFrame:
    city, nation = F.lower(F.col("location.city")), F.col("location.country")
    both = F.array(
        F.struct(F.lit("city").alias("place_kind"), city.alias("place")),
        F.struct(F.lit("country").alias("place_kind"), nation.alias("place")),
    )
    return (
        _own_id(records)
        .select("candidate_id", F.explode(both).alias("p"))
        .select("candidate_id", "p.place_kind", "p.place")
        .where(F.col("place") != "")
        .distinct()
    )


def _shared(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by at least two candidates; only those can link anything."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def name_places(records: DataFrame) -> DataFrame:
    """(candidate_id, tokens, place_kind, place): every name of a candidate with every place.

    A name and a place may come from different records of a candidate. Names and
    places nobody else has are dropped before the two meet, except names long
    enough to match a different one.
    """
    names, n_names = cut_counted(_names(records))
    places, n_places = cut_counted(_places(records))
    short = names.where(F.size("tokens") < FUZZY_TOKENS)
    useful_names = join_counted(short, _shared(short, ["tokens"]), ["tokens"], total=n_names).unionByName(
        names.where(F.size("tokens") >= FUZZY_TOKENS)
    )
    on = ["place_kind", "place"]
    useful_places = join_counted(places, _shared(places, on), on, total=n_places)
    return useful_names.join(useful_places, "candidate_id")


def star_edges(keys: DataFrame, on: list[str], total: int | None = None) -> DataFrame:
    """(a, b): each candidate with the smallest candidate sharing a key."""
    hubs = (
        keys.groupBy(*on)
        .agg(F.min("candidate_id").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    return (
        join_counted(keys, hubs, on, total=total)
        .select("a", F.col("candidate_id").alias("b"))
        .where(F.col("a") != F.col("b"))
    )


def strong_edges(records: DataFrame) -> DataFrame:
    signals, total = cut_counted(strong_signals(records))
    return star_edges(signals, ["kind", "key"], total).distinct()


# ------------------------------------------------------- similar, not equal ----


def _deletion_keys(sets: DataFrame, max_tokens: int) -> DataFrame:
    """(…, kept, deleted): each token set with few enough tokens left out to still match.

    Two sets match exactly when they meet in their common tokens with
    deletions a + b such that common * (DEN - NUM) >= NUM * (a + b).
    """
    level = sets.where(F.size("tokens") <= max_tokens).select(
        "candidate_id", "place_kind", "place",
        F.col("tokens").alias("kept"), F.lit(0).alias("deleted"), F.lit(1).alias("_from"),
    )
    out = level
    deepest = 0
    while (max_tokens - deepest - 1) * (DEN - NUM) >= NUM * (deepest + 1):
        deepest += 1
        level = (
            level.where((F.size("kept") - 1) * (DEN - NUM) >= NUM * deepest)
            .where(F.col("_from") <= F.size("kept"))
            .withColumn("_from", F.explode(F.sequence(F.col("_from"), F.size("kept"))))
            .withColumn(
                "kept",
                F.concat(
                    F.slice("kept", F.lit(1), F.col("_from") - 1),
                    F.slice("kept", F.col("_from") + 1, F.size("kept")),
                ),
            )
            .withColumn("deleted", F.lit(deepest))
        )
        out = out.unionByName(level)
    return out.drop("_from")


def _deletion_edges(sets: DataFrame, max_tokens: int) -> DataFrame:
    """Star edges between similar sets of up to ``max_tokens`` tokens.

    In the group of one common token set the member with the fewest deletions is
    the hub. Any two members that match also match the hub, so a star per group
    connects exactly what all pairs would.
    """
    keys, total = cut_counted(_deletion_keys(sets, max_tokens))
    on = ["place_kind", "place", "kept"]
    hubs = (
        keys.groupBy(*on)
        .agg(F.min(F.struct("deleted", "candidate_id")).alias("hub"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    near = F.size("kept") * (DEN - NUM) >= NUM * (F.col("deleted") + F.col("hub.deleted"))
    return (
        join_counted(keys, hubs, on, total=total)
        .where(near & (F.col("hub.candidate_id") != F.col("candidate_id")))
        .select(F.col("hub.candidate_id").alias("a"), F.col("candidate_id").alias("b"))
    )


def _rare_tokens(sets: DataFrame) -> DataFrame:
    """(set_id, place_kind, place, candidate_id, tokens, at, token): each set under its rarest tokens.

    The tokens of a set are put in one order for the whole place, rarest first. Two similar sets
    share a token among as many of their first ones as the larger may have apart from the smaller,
    and one more; ``at`` is its place in the order, from 1.
    """
    on = ["place_kind", "place", "token"]
    each = sets.select("set_id", "place_kind", "place", F.explode("tokens").alias("token"))
    counts = each.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        join_counted(each, counts.withColumn("rarity", F.col("n")), on)
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_list(F.struct("rarity", "token"))).alias("by_rarity"))
    )
    size = F.size("by_rarity")
    first = F.slice("by_rarity", F.lit(1), size - F.ceil(size * NUM / DEN).cast("int") + 1)
    return (
        ordered.select("set_id", F.col("by_rarity.token").alias("tokens"), F.posexplode(first).alias("at", "p"))
        # A token that no other set of the place has brings nothing together.
        .where(F.col("p.rarity") > 1)
        .join(sets.drop("tokens"), "set_id")
        .select("set_id", "place_kind", "place", "candidate_id", "tokens", (F.col("at") + 1).alias("at"), F.col("p.token").alias("token"))
    )


def _similar(a: Column, b: Column) -> Column:
    # shared * DEN >= NUM * (a + b - shared), with the intersection taken once.
    return F.size(F.array_intersect(a, b)) * (NUM + DEN) >= NUM * (F.size(a) + F.size(b))


def _token_bits(tokens: str) -> Column:
    """64 parities: each token flips one bit, so two sets differ in at least as many tokens as bits."""
    return F.expr(f"aggregate({tokens}, 0L, (bits, t) -> bits ^ shiftleft(1L, cast(pmod(xxhash64(t), 64L) AS int)))")


def _bits_allow(a: Column, b: Column, sizes: Column) -> Column:
    """False only for sets that cannot be similar: those differ in at most ``sizes`` * (DEN - NUM) / (NUM + DEN) tokens."""
    return F.bit_count(a.bitwiseXOR(b)) * (NUM + DEN) <= sizes * (DEN - NUM)


def _prefix_edges(sets: DataFrame, max_tokens: int) -> DataFrame:
    """Edges that connect every set of more than ``max_tokens`` tokens with all sets similar to it.

    Sets meet under a common rare token of a place. First all of a group are compared with its
    smallest set; those similar to it form its star. Then groups are dealt into blocks, and each
    two blocks are compared, but for pairs of one star, pairs of unlike sizes, and pairs whose order
    leaves too few tokens behind the common one or whose parities differ in too many bits. Of the similar sets that a set has in one star a
    single edge is kept, summed up where the pairs are made, so there is no table of pairs.
    """
    on = ["place_kind", "place", "token"]
    shortest = -(-(max_tokens + 1) * NUM // DEN)
    numbered = cut(sets.where(F.size("tokens") >= shortest).withColumn("set_id", F.monotonically_increasing_id()))
    held, total = cut_counted(_rare_tokens(numbered))
    size = F.size("tokens")
    groups = cut(
        held.groupBy(*on)
        .agg(F.min(F.struct("set_id", "candidate_id", "tokens")).alias("hub"), F.count(F.lit(1)).alias("n"), F.max(size).alias("longest"))
        .where((F.col("n") > 1) & (F.col("longest") > max_tokens))
        .drop("longest")
    )
    met = cut(join_counted(held, groups.withColumn("members", F.col("n")), on, total=total))
    near = met.where((F.col("set_id") != F.col("hub.set_id")) & _similar(F.col("tokens"), F.col("hub.tokens")))
    stars = near.select("set_id", F.col("hub.set_id").alias("star"), F.col("hub.candidate_id").alias("a"), F.col("candidate_id").alias("b"))
    # A set may be near several hubs; hubs that are near smaller ones belong to those.
    star_of = stars.groupBy("set_id").agg(F.min("star").alias("star"))
    blocks = F.ceil(F.col("members") / BLOCK_SETS)
    dealt = (
        met.drop("hub").join(star_of, "set_id", "left")
        .withColumn("star", F.coalesce("star", "set_id"))
        .withColumn("bits", _token_bits("tokens"))
        .withColumn("block", F.pmod(F.xxhash64("set_id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(*on, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "block", "set_id", "star", "candidate_id", "tokens", size.alias("size"), "at", "bits")
    )
    x, y = dealt.alias("x"), dealt.alias("y")
    both = lambda pick, c: pick(F.col(f"x.{c}"), F.col(f"y.{c}"))
    behind = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + 1
    pairs = x.join(y, [*on, "low", "high"]).where(
        (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.star") != F.col("y.star"))
        & ((F.col("low") == F.col("high")) | (F.col("x.block") != F.col("y.block")))
        & (both(F.greatest, "size") > max_tokens) & (both(F.least, "size") * DEN >= both(F.greatest, "size") * NUM)
        & (behind * (NUM + DEN) >= NUM * (F.col("x.size") + F.col("y.size")))
        & _bits_allow(F.col("x.bits"), F.col("y.bits"), F.col("x.size") + F.col("y.size"))
        & _similar(F.col("x.tokens"), F.col("y.tokens"))
    )
    across = pairs.groupBy(F.col("x.candidate_id").alias("a"), F.col("y.star").alias("star")).agg(F.min("y.candidate_id").alias("b"))
    return stars.select("a", "b").unionByName(across.select("a", "b")).where(F.col("a") != F.col("b"))


def weak_edges(records: DataFrame, max_tokens: int = DELETION_TOKENS) -> DataFrame:
    """Edges between candidates with a matching name and a common city or country."""
    pairs, total = cut_counted(name_places(records))
    on = ["place_kind", "place", "tokens"]
    edges = star_edges(pairs, on, total)
    # From here one candidate stands for all that share a token set and place.
    sets = (
        pairs.where(F.size("tokens") >= FUZZY_TOKENS).groupBy(*on).agg(F.min("candidate_id").alias("candidate_id"))
    )
    longest = pairs.agg(F.max(F.size("tokens"))).first()[0] or 0
    if longest >= FUZZY_TOKENS:
        edges = edges.unionByName(_deletion_edges(sets, min(max_tokens, longest)))
    if longest > max_tokens:
        edges = edges.unionByName(_prefix_edges(sets, max_tokens))
    return edges.distinct()


# ------------------------------------------------------------- resolution ----


def resolve(records: DataFrame, weak: bool = True) -> DataFrame:
    """Rewrite table (old_id, new_id) for every id that is linked to another."""
    edges = strong_edges(records)
    if weak:
        edges = edges.unionByName(weak_edges(records))
    return connected_components(edges).select(F.col("id").alias("old_id"), F.col("root").alias("new_id"))


def apply_rewrite(records: DataFrame, rewrite: DataFrame, total: int | None = None) -> DataFrame:
    """Give every record its final id and its place in the merged group.

    ``total`` is the number of records, where known.

    ``group_seq`` is the first position of the record's old group: merged groups
    are read in the order their parts first appeared.
    """
    held = _own_id(records)
    groups = held.groupBy("candidate_id").agg(
        F.min("record_seq").alias("group_seq"), F.count(F.lit(1)).alias("n")
    )
    target = groups.join(rewrite, F.col("candidate_id") == F.col("old_id"), "left").select(
        "candidate_id", F.coalesce("new_id", "candidate_id").alias("new_id"), "group_seq", "n"
    )
    return (
        join_counted(held, target, ["candidate_id"], total=total)
        .withColumnRenamed("candidate_id", "old_id")
        .withColumnRenamed("new_id", "candidate_id")
    )


def merge_audit(rewrite: DataFrame) -> DataFrame:
    """One row per id that was merged into another."""
    return rewrite.where(F.col("old_id") != F.col("new_id")).select(
        F.col("old_id").alias("from_id"), F.col("new_id").alias("into_id")
    )


def orphans(records: DataFrame) -> DataFrame:
    """Records without any id."""
    return records.where(F.col("candidate_id").isNull() | (F.col("candidate_id") == ""))
