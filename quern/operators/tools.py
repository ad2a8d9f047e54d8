"""Analytic tools with a fixed result: coverage, promotions, discounts, declines, similar items, voucher profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import cosine, shared_depth
from quern.functions.text import all_nines, jaccard, tokens
from quern.operators.order import ALL, join_equal, medians_of_groups, quantiles, scaled
from quern.operators.relational import ContractError, best_of
from quern.operators.vectors import cosine_candidates

PROFILE_WEIGHTS = (0.4, 0.3, 0.3)
#: Weights of the parts of a pair's similarity, and of words and cosine in a resolved entity.
SIMILARITY_WEIGHTS = {"text_sim": 0.4, "category_overlap_depth": 0.25, "brand_match": 0.15, "price_distance": 0.1, "same_shelf_bonus": 0.1}
LEXICAL, DENSE = 0.45, 0.55
#: Queries of a stated set in a block that is sent to all tasks, and in all.
QUERY_BLOCK, MOST_QUERIES, MOST_MENTIONS = 1000, 1_000_000, 50_000


def at_latest(df: DataFrame, date: str, *group: str) -> DataFrame:
    """The rows of the latest date (of each group)."""
    last = df.groupBy(*group).agg(F.max(date).alias("__last"))
    on = [df[g] == last[g] for g in group] + [df[date] == last["__last"]]
    return df.join(F.broadcast(last) if not group else last, on, "left_semi")


def as_of(df: DataFrame, date: str, day) -> DataFrame:
    """The rows that were known on a day."""
    return df.where(F.col(date) <= F.lit(day))


def dataset_coverage(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_distinct(date).alias("n_dates"))


def promotion_observation(df: DataFrame, flag: str, value: str, key: str) -> DataFrame:
    """Per flag: listings in scope, mean and median of those that can be measured, and how many can't."""
    counted = df.groupBy(flag).agg(F.count_distinct(key).alias("listings"), F.avg(value).alias("mean"), F.count_if(F.col(value).isNull()).alias("excluded"))
    return join_equal(counted, quantiles(df, [flag], value, {"median": 0.5}), [flag], "left")


def flagged_by_market(df: DataFrame, markets: DataFrame, market: str, flag: Column, key: str) -> DataFrame:
    """Flagged listings of each market; a market without any has 0."""
    found = df.where(flag).groupBy(market).agg(F.count_distinct(key).alias("n"))
    return markets.select(market).distinct().join(found, market, "left").select(market, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def around(df: DataFrame, column: str, target: float, reach: float, value: str) -> DataFrame:
    """How many rows lie within reach of target, and their median (null if there is none)."""
    near = df.where(F.col(column).between(target - reach, target + reach)).withColumn(ALL, F.lit(0))
    found = near.groupBy(ALL).agg(F.count(F.lit(1)).alias("n")).join(quantiles(near, [ALL], value, {"median": 0.5}), ALL, "left")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("median").alias("median"))


def similar_items(items: DataFrame, queries: DataFrame, key: str, path: str, vector: str, k: int = 5) -> DataFrame:
    """For each query, a row of a stated set, the k items of its first path level that share most levels, then are most alike.

    A query whose path is empty or null is unmapped and has no items.
    """
    a = queries.select(F.col(key).alias("query"), F.col(path).alias("__qp"), F.col(vector).alias("__qv"), F.get(path, 0).alias("__top"))
    b = items.select(F.col(key), F.col(path).alias("__p"), F.col(vector).alias("__v"), F.get(path, 0).alias("__top"))
    if a.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        a = F.broadcast(a)  # then no level, however common, meets in one task
    pairs = b.join(a, "__top").where(F.col("query") != F.col(key))
    scored = pairs.select("query", key, shared_depth(F.col("__qp"), F.col("__p")).alias("depth"), F.round(cosine(F.col("__qv"), F.col("__v")), 6).alias("similarity"))
    return best_of(scored, ["query"], key, [F.col("depth").desc(), F.col("similarity").desc_nulls_last(), F.col(key).asc()], k)


def similarity_parts(pairs: DataFrame) -> DataFrame:
    """The measures of a pair (structs a and b of vector, brand, price, path, shop, shelves) and their weighted sum.

    text_sim, category_overlap_depth, brand_match (a half where a brand is missing), price_distance (1 for equal
    prices), same_shelf_bonus (of the shelves of one shop) and similarity_score; a missing part counts as 0.
    """
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    longest = F.greatest(F.size(a("path")), F.size(b("path")))
    made = {
        "text_sim": F.round(cosine(a("vector"), b("vector")), 6),
        "category_overlap_depth": F.round(F.try_divide(F.size(F.array_intersect(a("path"), b("path"))).cast("double"), longest), 6),
        "brand_match": F.when(a("brand").isNull() | b("brand").isNull(), 0.5).otherwise((a("brand") == b("brand")).cast("double")),
        "price_distance": F.when(a("price") > 0, F.round(1 - F.least(F.lit(1.0), F.abs(a("price") - b("price")) / a("price")), 6)),
        "same_shelf_bonus": F.coalesce((a("shop") == b("shop")) & F.arrays_overlap(a("shelves"), b("shelves")), F.lit(False)).cast("double"),
    }
    total = sum((w * F.coalesce(F.col(n), F.lit(0.0)) for n, w in SIMILARITY_WEIGHTS.items()), F.lit(0.0))
    return pairs.withColumns(made).withColumn("similarity_score", F.round(total, 6))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k vectors most like each query, by cosine. queries: a stated set, met by all vectors in blocks of a bounded size.

    Some blocks of queries at a time travel to every task of the vectors, where chunks meet them as matrices; how
    many queries there are is counted first, and more than `MOST_QUERIES` are refused, as their pairs with all vectors would not be a stated set's any more.
    """
    n = queries.count()
    if n > MOST_QUERIES:
        raise ContractError("QUERY_SET", f"{n} queries")
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n // block + 1)).cast("int"))
    scored = cosine_candidates(vectors, asked, key, vector, k, n // block + 1).withColumn("similarity", F.round("similarity", 6))
    return best_of(scored, ["query"], key, [F.col("similarity").desc_nulls_last(), F.col(key).asc()], k)


def voucher_profile(df: DataFrame, shop: str, key: str, voucher: str, discount: str, price: str, value: str, least: int = 5) -> DataFrame:
    """Shops by voucher rate, median discount share and the gap in median value with and without a voucher.

    Each is scaled to 0..1 over the shops with enough listings and both groups, and weighted .4, .3, .3.
    """
    has = F.col(voucher)
    depth, worth = F.try_divide(F.col(discount).cast("double"), F.col(price)), F.col(value).cast("double")
    sides = {"__depth": depth, "__with": F.when(has, worth), "__without": F.when(~F.coalesce(has, F.lit(False)), worth)}
    rated = df.where(F.col(shop).isNotNull()).select(shop, F.col(key).alias("__key"), has.cast("double").alias("__has"), *(c.alias(n) for n, c in sides.items()))
    shops = medians_of_groups(rated, [shop], list(sides), {"listings": "__key"}, {"rate": F.avg("__has")})
    able = shops.where((F.col("listings") >= least) & F.col("__with").isNotNull() & F.col("__without").isNotNull()).withColumns({"depth": F.col("__depth"), "gap": F.col("__with") - F.col("__without")})
    made = scaled(able, [], {"__rate": "rate", "__deep": "depth", "__wide": "gap"})
    total = sum((w * F.col(c) for w, c in zip(PROFILE_WEIGHTS, ("__rate", "__deep", "__wide"), strict=True)), F.lit(0.0))
    return made.select(shop, "listings", F.round("rate", 6).alias("rate"), F.round("depth", 6).alias("depth"), F.round("gap", 4).alias("gap"), F.round(total, 4).alias("profile_score"))


def best_profile(profiles: DataFrame, shop: str) -> DataFrame:
    """The shop of the highest score; ties go to the smallest id."""
    return profiles.orderBy(F.col("profile_score").desc_nulls_last(), F.col(shop).asc()).limit(1)


def resolve_entities(mentions: DataFrame, names: DataFrame, key: str, accept: float = 0.5, margin: float = 0.05, k: int = 20, rare: float = 0.05) -> DataFrame:
    """What each mention (mention, text and maybe vector) names among names (key, name and maybe vector).

    A mention that is a key is that key. Else candidates are names that share a word with it, no matter how
    common, of which the k best by words, the k best by cosine and those that hold every rare word of the
    mention are scored: words alone, or .45 of words and .55 of cosine where both have a vector. A name that
    shares no word is none. outcome: not_found (empty text), invalid_extraction (no candidate, or the best
    below `accept`), ambiguous_broad (the next within `margin`) or resolved.

    Mentions are a stated set: their words, not the names, are sent to every task, so a word that all names
    share is not gathered in one.
    """
    dense = "vector" in mentions.columns and "vector" in names.columns
    asked = mentions.select("mention", F.trim("text").alias("text"), tokens(F.col("text")).alias("__mt"), *(["vector"] if dense else []))
    named = names.select(key, tokens(F.col("name")).alias("__nt"), *([F.col("vector").alias("__nv")] if dense else []))
    direct = asked.join(names.select(key, F.col(key).cast("string").alias("__id")), F.col("text") == F.col("__id")).select("mention", key, F.lit(1.0).alias("score"))
    if (n := asked.count()) > MOST_MENTIONS:
        raise ContractError("QUERY_SET", f"{n} mentions")
    lists = asked.where(~F.col("text").rlike("^[0-9]+$")).agg(F.collect_list(F.struct("mention", "__mt", *(["vector"] if dense else []))).alias("__asked"))
    met = named.withColumn(ALL, F.lit(0)).join(F.broadcast(lists.withColumn(ALL, F.lit(0))), ALL).select(*named.columns, F.explode("__asked").alias("__a"))
    met = met.where(F.arrays_overlap("__nt", "__a.__mt"))
    lexical = F.round(jaccard(F.col("__nt"), F.col("__a.__mt")), 6)
    scored = met.select(F.col("__a.mention").alias("mention"), key, lexical.alias("__lex"), F.col("__nt"), F.col("__a.__mt").alias("__mt"), *([F.round(F.greatest(F.coalesce(cosine(F.col("__nv"), F.col("__a.vector")), F.lit(0.0)), F.lit(0.0)), 6).alias("__dense")] if dense else []))
    common = token_frequency(names, key, tokens(F.col("name")), rare).where(~F.col("rare")).agg(F.collect_list("token").alias("__common"))
    scored = scored.withColumn(ALL, F.lit(0)).join(F.broadcast(common.withColumn(ALL, F.lit(0))), ALL).drop(ALL)
    needed = F.array_except("__mt", "__common")
    all_rare = (F.size(needed) > 0) & (F.size(F.array_except(needed, "__nt")) == 0)
    flat = scored.select("mention", key, "__lex", *(["__dense"] if dense else []), all_rare.alias("__rare"))
    ways = [best_of(flat, ["mention"], key, [F.col(c).desc(), F.col(key).asc()], k).drop("position") for c in ("__lex", *(["__dense"] if dense else []))]
    ways.append(best_of(flat.where("__rare"), ["mention"], key, [F.col(key).asc()], k).drop("position"))
    candidates = reduce(DataFrame.union, ways).distinct()
    final = F.round(LEXICAL * F.col("__lex") + DENSE * F.col("__dense"), 6) if dense else F.col("__lex")
    rows = candidates.select("mention", key, final.alias("score")).union(direct)
    w = Window.partitionBy("mention").orderBy(F.col("score").desc(), F.col(key).asc())  # of a few times k rows
    best = rows.withColumns({"__i": F.row_number().over(w), "__next": F.lead("score").over(w)}).where("__i = 1")
    clear = F.col("__next").isNull() | (F.round(F.col("score") - F.col("__next"), 6) >= margin)
    outcome = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "not_found").when(F.col("score").isNull() | (F.col("score") < accept), "invalid_extraction").when(clear, "resolved").otherwise("ambiguous_broad")
    return asked.select("mention", "text").join(best.select("mention", key, "score", "__next"), "mention", "left").select("mention", key, "score", outcome.alias("outcome"))


def token_frequency(df: DataFrame, key: str, tokens: Column, rare: float = 0.05) -> DataFrame:
    """(token, documents, share, rare) over all rows."""
    total = df.agg(F.count_distinct(key)).first()[0]
    found = df.select(key, F.explode(tokens).alias("token")).groupBy("token").agg(F.count_distinct(key).alias("documents"))
    out = found.withColumn("share", F.round(F.col("documents") / F.lit(total), 6))
    return out.withColumn("rare", F.col("share") <= rare)


def review_candidates(df: DataFrame, group: list[str], value: str, p: float = 0.999, nines: int = 7) -> DataFrame:
    """Rows whose value is all nines, or above the p-th percentile of their group."""
    edges = quantiles(df, group, value, {"edge": p})
    return join_equal(df, edges, group, "left").where((F.col(value) > F.col("edge")) | all_nines(F.col(value), nines)).drop("edge")


def value_index(df: DataFrame, ref: str, market: str, value: str, folded: Column) -> DataFrame:
    """(ref, market, folded, originals, ambiguous): what a folded spelling may stand for."""
    out = df.where(F.col(value).isNotNull()).select(F.lit(ref).alias("ref"), F.col(market).alias("market"), folded.alias("folded"), F.col(value).alias("v")).distinct()
    return out.groupBy("ref", "market", "folded").agg(F.sort_array(F.collect_list("v")).alias("originals")).withColumn("ambiguous", F.size("originals") > 1)
