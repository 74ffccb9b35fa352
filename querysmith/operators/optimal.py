"""Optimal queries by exhaustive search, for all entities at once.

A document's score for a query is a sum over its terms, so each term's contributions are looked up once, rather than searched one
by one. Only terms that an entity shares with its matches can find a match; what else is in a query can only take places from it.

Queries of an entity are measured on the `HEAD` best documents of each of its terms and on its matches, whose scores are exact. Other
documents have at most the last head weight of each term. So a query is settled if as many documents as are asked for are above its
best match there, or if the last weights add up to less than the match has. Where only the best queries are asked for, it is settled too
if more documents are above than above the best one that is sure. For queries that are left open the documents above are counted, block of
documents by block: each posting goes to its block once and each block has all open queries, so what is written grows with postings
and with queries, but not with their product.

From three terms on, sets are cut before they are joined (branch and bound): weights aren't negative, so with more terms no document
loses score, and a match gains at most its largest other weights. Documents that are above a match by more than that stay above it, which
bounds the rank that any larger set with these two terms can reach. Only sets all of whose pairs may do as well as the best that is
known of the entity are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled
from .search import ranked

#: Documents of a term on which its queries are measured first.
HEAD = 64

#: Postings of a block of documents, and bytes of open queries that a block has at a time.
BLOCK, PACKED = 500_000, 32_000_000


def match_terms(truth: DataFrame, external_signals: DataFrame) -> DataFrame:
    """(local_id, keyword): terms of an entity's matches in the index."""
    return truth.join(external_signals.select(F.col("id").alias("external_id"), "keyword"), "external_id").select("local_id", "keyword").distinct()


def overlap_terms(local_signals: DataFrame, truth: DataFrame, external_signals: DataFrame) -> DataFrame:
    """(local_id, keyword): an entity's terms that one of its matches has. Entities without a match have none."""
    own = local_signals.select(F.col("id").alias("local_id"), "keyword")
    return own.join(match_terms(truth, external_signals).withColumnRenamed("keyword", "k").withColumnRenamed("local_id", "l"), (F.col("local_id") == F.col("l")) & (F.lower("keyword") == F.col("k")), "left_semi")


def nonoverlap_terms(local_signals: DataFrame, truth: DataFrame, external_signals: DataFrame) -> DataFrame:
    """(local_id, keyword): the other terms of entities that have a match."""
    own = local_signals.select(F.col("id").alias("local_id"), "keyword").join(truth.select("local_id"), "local_id", "left_semi")
    return own.join(overlap_terms(local_signals, truth, external_signals), ["local_id", "keyword"], "left_anti")


def out_of_vocabulary(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms that no external document has."""
    return terms.join(vocabulary.select("keyword"), "keyword", "left_anti")


def combinations(terms: DataFrame, size: int) -> DataFrame:
    """(local_id, query): all sets of `size` terms of an entity, each sorted. Entities are small; pairs are of one entity only."""
    out = terms.select("local_id", F.array("keyword").alias("query"), F.col("keyword").alias("last"))
    for _ in range(size - 1):
        more = terms.select(F.col("local_id").alias("l"), F.col("keyword").alias("k"))
        out = out.join(more, (F.col("local_id") == F.col("l")) & (F.col("k") > F.col("last"))).select("local_id", F.concat("query", F.array("k")).alias("query"), F.col("k").alias("last"))
    return out.select("local_id", "query")


def measured_by_join(queries: DataFrame, weighted: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """`reciprocal_ranks` over all postings of the queries' terms."""
    terms = queries.select("local_id", "query", F.explode("query").alias("keyword"))
    hits = terms.join(weighted.withColumnRenamed("id", "external_id"), "keyword").groupBy("local_id", "query", "external_id").agg(F.round(F.sum("w"), 6).alias("score"))
    best = ranked(hits, k, ["local_id", "query"]).join(truth.select("local_id", "external_id").distinct(), ["local_id", "external_id"], "left_semi")
    rr = best.groupBy("local_id", "query").agg((1 / F.min("rank")).alias("rr"))
    return queries.join(rr, ["local_id", "query"], "left").select("local_id", "query", F.coalesce("rr", F.lit(0.0)).alias("rr"))


def heads(terms: DataFrame, weighted: DataFrame, truth: DataFrame, head: int = HEAD) -> DataFrame:
    """(local_id, external_id, is_match, keyword, w): what an entity's terms (local_id, keyword) add to the best documents of each and to
    its matches. Rows without a document have the last head weights of terms that have more postings, or none."""
    terms = settled(terms.select("local_id", "keyword").distinct(), "terms")
    # The words are written, so that they are sent along, and each task keeps the first of a word before postings are dealt out.
    words = settled(terms.select("keyword").distinct(), "words")
    posts = weighted.join(words, "keyword", "left_semi").withColumnRenamed("id", "external_id")
    # One more than a head has, so that it is known whether there are more.
    place = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("w"), "external_id"))
    best = settled(posts.withColumn("n", place).filter(F.col("n") <= head + 1), "heads")
    last = best.groupBy("keyword").agg(F.min(F.when(F.col("n") == head, F.col("w"))).alias("w"), F.max("n").alias("n")).filter(F.col("n") > head).select("keyword", "w")
    about = terms.join(last, "keyword", "left").select("local_id", F.lit(None).cast("string").alias("external_id"), F.lit(False).alias("is_match"), "keyword", "w")
    near = terms.join(best.filter(F.col("n") <= head), "keyword").select("local_id", "external_id", F.lit(False).alias("is_match"))
    near = near.unionByName(truth.select("local_id", "external_id", F.lit(True).alias("is_match")).join(terms.select("local_id").distinct(), "local_id", "left_semi"))
    near = settled(near.groupBy("local_id", "external_id").agg(F.max("is_match").alias("is_match")), "near")
    known = settled(near.select("external_id").distinct(), "near")
    rows = near.join(posts.join(known, "external_id", "left_semi"), "external_id").join(terms, ["local_id", "keyword"])
    return rows.select("local_id", "external_id", "is_match", "keyword", "w").unionByName(about)


def _measure(queries: pd.DataFrame, docs: pd.DataFrame, k: int, best_only: bool) -> pd.DataFrame:
    """An entity's queries with rr on its heads, and whether it is that on all documents. For those that aren't sure: the best match with
    its score in millionths, and the last rank that matters. With `best_only`, queries that aren't among the best are left out."""
    lone = docs["external_id"].isna().to_numpy()
    place = {w: i for i, w in enumerate(docs["keyword"][lone])}
    last = docs["w"][lone].to_numpy(float)
    docs = docs[~lone]
    row, ids = pd.factorize(docs["external_id"].to_numpy(object), sort=True)
    at, n = docs["keyword"].map(place).to_numpy(int), len(ids)
    w, there, match = np.zeros((len(place), n)), np.zeros((len(place), n), bool), np.zeros(n, bool)
    w[at, row], there[at, row], match[row] = docs["w"], True, docs["is_match"]
    match = np.flatnonzero(match)
    sure, rank_, own_, match_ = np.ones(len(queries), bool), np.full(len(queries), k + 1), np.zeros(len(queries), np.int64), np.full(len(queries), None, object)
    sizes = queries["query"].map(len).to_numpy()
    for size in np.unique(sizes) if len(match) else ():
        of = np.flatnonzero(sizes == size)
        q = np.array([place[t] for query in queries["query"].iloc[of] for t in query]).reshape(-1, size)
        best, own = np.zeros(len(q), int), np.full(len(q), -1, np.int64)
        for some in np.array_split(np.arange(len(q)), -(-len(q) * len(match) * size // 1_000_000)):
            score = np.rint(w[:, match][q[some]].sum(axis=1) * 1e6)  # as they are rounded before ranking
            score[~there[:, match][q[some]].any(axis=1)] = -1
            best[some], own[some] = match[score.argmax(axis=1)], score.max(axis=1)  # of equal scores the first by id
        some = np.flatnonzero(own >= 0)
        of, q, best, own = of[some], q[some], best[some], own[some]
        rank_[of] = _above(w, there, ids, q, own, ids[best], k) + 1
        sure[of] = (rank_[of] > k) | np.isnan(last[q]).all(axis=1) | (np.rint(np.nan_to_num(last)[q].sum(axis=1) * 1e6) + 1 < own)
        own_[of], match_[of] = own, ids[best]
    rr = np.where(rank_ <= k, 1 / rank_, 0)
    limit = min(k, rank_[sure].min(initial=k)) if best_only else k
    out = queries.assign(rr=rr, sure=sure, own=own_, match=match_, most=limit)[["local_id", "query", "rr", "sure", "own", "match", "most"]]
    return out[rank_ <= limit] if best_only else out


def reciprocal_ranks(queries: DataFrame, weighted: DataFrame, truth: DataFrame, k: int = 20, head: int = HEAD, best_only: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """(local_id, query, rr) of queries (local_id, query): the reciprocal rank of the best match among the k best documents. Weights
    aren't negative. With `best_only`, queries that are behind others of their entity may be missing; those that are best are all there.
    `docs` are `heads` of at least the queries' terms, where several calls share them."""
    queries = settled(queries.select("local_id", "query"), "queries")
    if docs is None:
        docs = heads(queries.select("local_id", F.explode("query").alias("keyword")), weighted, truth, max(head, k))
    schema = "local_id string, query array<string>, rr double, sure boolean, own long, match string, most int"
    tried = queries.groupBy("local_id").cogroup(docs.groupBy("local_id")).applyInPandas(lambda q, d: _measure(q, d, k, best_only), schema)
    tried = settled(tried, "tried")
    known, rest = tried.filter("sure").select("local_id", "query", "rr"), tried.filter("not sure")
    return known if rest.isEmpty() else known.unionByName(counted_by_blocks(rest, weighted))


def _pack(queries: pd.DataFrame) -> pd.DataFrame:
    """An entity's open queries of one size as a row: its terms, and sets of their places."""
    terms, at = np.unique(np.array([t for q in queries["query"] for t in q], object), return_inverse=True)
    matches, match = np.unique(queries["match"].to_numpy(object), return_inverse=True)
    row = (queries["local_id"].iloc[0], len(queries["query"].iloc[0]), list(terms), at.astype(np.int32).tobytes(), queries["own"].to_numpy(np.int64).tobytes(), list(matches), match.astype(np.int32).tobytes(), queries["most"].iloc[0])
    return pd.DataFrame([row], columns=["local_id", "size", "terms", "sets", "own", "matches", "match", "most"])


def _above(w: np.ndarray, there: np.ndarray, ids: np.ndarray, sets: np.ndarray, own: np.ndarray, match: np.ndarray, most: int) -> np.ndarray:
    """How many documents (columns of w) are above each query's match; `most` where it's more.

    Those with the largest weights come first, so that most queries that can be dropped are dropped early; a query ends at the first
    document whose largest weights add up to less than its match has."""
    top = np.rint(np.partition(w, len(w) - sets.shape[1], axis=0)[len(w) - sets.shape[1] :].sum(axis=0) * 1e6) + 1
    order = np.argsort(-top, kind="stable")
    w, there, ids, n = w[:, order], there[:, order], ids[order], len(ids)
    end = np.searchsorted(-top[order], -own, side="right")
    count, open_, a, width = np.zeros(len(sets), int), np.flatnonzero(end > 0), 0, 32
    while len(open_):
        b = min(a + width, n)
        part = np.ascontiguousarray(w[:, a:b])
        for some in np.array_split(open_, -(-len(open_) * (b - a) // 200_000)):
            q = sets[some]
            score = part[q[:, 0]]
            for i in range(1, q.shape[1]):
                score += part[q[:, i]]
            at, doc = np.nonzero(score >= (own[some] / 1e6 - 1e-6)[:, None])
            score, least, of = np.rint(score[at, doc] * 1e6), own[some][at], some[at]
            ahead = score > least
            tie = np.flatnonzero(score == least)
            ahead[tie] = (ids[a + doc[tie]] < match[of[tie]]) & ((least[tie] > 0) | there[sets[of[tie]], (a + doc[tie])[:, None]].any(axis=1))
            count += np.bincount(of[ahead], minlength=len(sets))
        a, width = b, width * 2
        open_ = open_[(end[open_] > a) & (count[open_] < most)]
    return np.minimum(count, most)


def _count(packed: pa.Table, posts: pa.Table) -> Iterator[tuple[str, int, bytes]]:
    """For each row of `_pack` how many of a block's documents are above, as 32-bit integers."""
    codes = [posts[c].combine_chunks().dictionary_encode() if len(posts) else None for c in ("keyword", "id")]
    if not len(posts):
        return
    (word, words), (doc, ids) = ((c.indices.to_numpy(), c.dictionary.to_numpy(zero_copy_only=False)) for c in codes)
    order = np.argsort(word, kind="stable")
    doc, weight, start = doc[order], posts["w"].to_numpy()[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    place = {t: i for i, t in enumerate(words)}
    for x in packed.to_pylist():
        w, there = np.zeros((len(x["terms"]), len(ids))), np.zeros((len(x["terms"]), len(ids)), bool)
        for i, t in enumerate(x["terms"]):
            if (p := place.get(t)) is not None:
                rows = slice(start[p], start[p + 1])
                w[i, doc[rows]], there[i, doc[rows]] = weight[rows], True
        some = np.flatnonzero(there.any(axis=0))
        sets, own, match = np.frombuffer(x["sets"], np.int32).reshape(-1, x["size"]), np.frombuffer(x["own"], np.int64), np.array(x["matches"], object)[np.frombuffer(x["match"], np.int32)]
        if len(some):
            yield x["local_id"], x["size"], _above(w[:, some], there[:, some], ids[some], sets, own, match, x["most"]).astype(np.int32).tobytes()


def _ranked_sets(packed: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The queries of a row of `_pack`, from what is above in each block."""
    x = packed.iloc[0]
    sets = np.frombuffer(x["sets"], np.int32).reshape(-1, x["size"])
    rank = sum((np.frombuffer(c, np.int32).astype(int) for c in counts["above"]), np.ones(len(sets), int))
    terms = np.array(x["terms"], object)
    return pd.DataFrame({"local_id": x["local_id"], "query": list(terms[sets]), "rr": np.where(rank <= x["most"], 1 / rank, 0)})


def counted_by_blocks(queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """(local_id, query, rr) of queries (local_id, query, own, match, most): documents that score more than `own` millionths, or as much
    with a smaller id than `match`, are above. rr is 0 from `most` of them on."""
    columns = "terms array<string>, sets binary, own binary, matches array<string>, match binary, most int"
    packed = queries.withColumn("size", F.size("query")).groupBy("local_id", "size").applyInPandas(_pack, f"local_id string, size int, {columns}")
    packed = settled(packed, "packed")
    size = packed.agg(F.sum(F.length("sets") + F.length("own") + F.length("match"))).first()[0]
    groups, blocks = -(-size // PACKED), max(1, -(-weighted.count() // BLOCK))
    packed = packed.withColumn("part", F.pmod(F.xxhash64("local_id"), F.lit(groups)))
    asked = settled(packed.select("part", F.explode("terms").alias("keyword")).distinct(), "asked")
    posts = weighted.join(asked, "keyword").select("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "keyword", "id", "w")
    sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names, sizes, above = zip(*_count(left, right), strict=True) if len(left) and len(right) else ((), (), ())
        rows = list(zip(names, sizes, above, strict=True))
        return pa.table({"local_id": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int32()), "above": pa.array([r[2] for r in rows], pa.binary())})

    counts = sent.groupBy("part", "block").cogroup(posts.groupBy("part", "block")).applyInArrow(count, "local_id string, size int, above binary")
    counts = settled(counts, "counts")
    return packed.groupBy("local_id", "size").cogroup(counts.groupBy("local_id", "size")).applyInPandas(_ranked_sets, "local_id string, query array<string>, rr double")


def match_weights(overlap: DataFrame, weighted: DataFrame, truth: DataFrame) -> DataFrame:
    """(local_id, external_id, ws): for each match the weights (keyword, w) of the terms that it shares with the entity, largest first."""
    pairs = overlap.join(truth.select("local_id", "external_id").distinct(), "local_id")
    rows = pairs.join(weighted.withColumnRenamed("id", "external_id"), ["external_id", "keyword"])
    order = lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).otherwise(0)
    return rows.groupBy("local_id", "external_id").agg(F.array_sort(F.collect_list(F.struct("keyword", "w")), order).alias("ws"))


def pair_reach(pairs: DataFrame, weighted: DataFrame, truth: DataFrame, of_matches: DataFrame, size: int, k: int = 20) -> DataFrame:
    """(local_id, query, reach): the largest reciprocal rank that a set of `size` terms with this pair may have; pairs that can't reach
    the k best have none.

    Rivals are the k best documents of the pair that aren't matches. A match is at best behind those that are above what the pair gives
    it and its largest other weights."""
    terms = pairs.select("local_id", "query", F.explode("query").alias("keyword"))
    hits = terms.join(weighted.withColumnRenamed("id", "external_id"), "keyword").groupBy("local_id", "query", "external_id").agg(F.sum("w").alias("score"))
    others = hits.join(truth.select("local_id", "external_id").distinct(), ["local_id", "external_id"], "left_anti")
    rivals = ranked(others, k, ["local_id", "query"]).groupBy("local_id", "query").agg(F.collect_list("score").alias("rivals"))
    rows = pairs.join(rivals, ["local_id", "query"], "left").join(of_matches, "local_id")
    total = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, x: s + x["w"])
    own, rest = F.filter("ws", lambda x: F.array_contains("query", x["keyword"])), F.filter("ws", lambda x: ~F.array_contains("query", x["keyword"]))
    rows = rows.withColumn("most", total(own) + total(F.slice(rest, 1, size - 2)) + 2e-6)  # more than rounding can make up for
    rank = F.coalesce(F.size(F.filter("rivals", lambda r: r > F.col("most"))), F.lit(0)) + 1
    return rows.filter(rank <= k).groupBy("local_id", "query").agg((1 / F.min(rank)).alias("reach"))


def bounded_sets(overlap: DataFrame, weighted: DataFrame, truth: DataFrame, size: int, k: int = 20, seeds: int = 10) -> DataFrame:
    """(local_id, query): sets of `size` terms, three or more, among which are all that are best of their entity.

    What is known to be reached comes from the best pairs, at most `seeds` an entity, with every other term, and for larger sets again
    with every other term."""
    pairs = settled(combinations(overlap, 2), "pairs")
    grown = best_queries(reciprocal_ranks(pairs, weighted, truth, k, best_only=True), seeds)
    for _ in range(size - 2):
        more = grown.select("local_id", "query").join(overlap.select("local_id", "keyword"), "local_id").filter(~F.array_contains("query", F.col("keyword")))
        more = settled(more.select("local_id", F.array_sort(F.concat("query", F.array("keyword"))).alias("query")).distinct(), "seeds")
        measured = settled(reciprocal_ranks(more, weighted, truth, k, best_only=True), "seeds")
        grown = best_queries(measured, seeds)
    known = best_rr(measured).withColumnRenamed("best_rr", "known")
    reach = pair_reach(pairs, weighted, truth, settled(match_weights(overlap, weighted, truth), "match-weights"), size, k)
    kept = reach.join(known, "local_id", "left").filter(F.col("reach") >= F.coalesce("known", F.lit(0.0)) - 1e-9)
    kept = settled(kept.select("local_id", F.col("query")[0].alias("a"), F.col("query")[1].alias("b")), "kept")
    # Sets all of whose pairs are kept: each term more has to make a kept pair with every one before.
    out = kept.select("local_id", F.array("a", "b").alias("query"), F.col("b").alias("last"))
    for _ in range(size - 2):
        n = F.size("query")
        next_ = kept.select("local_id", F.col("a").alias("last"), F.col("b").alias("c"))
        out = out.join(next_, ["local_id", "last"]).select("local_id", "query", "c").select("*", F.explode("query").alias("a"))
        out = out.join(kept.withColumnRenamed("b", "c"), ["local_id", "a", "c"], "left_semi").groupBy("local_id", "query", "c").agg(F.count("*").alias("pairs"))
        out = out.filter(F.col("pairs") == n).select("local_id", F.concat("query", F.array("c")).alias("query"), F.col("c").alias("last"))
    return out.select("local_id", "query")


def best_queries(measured: DataFrame, most: int = 100) -> DataFrame:
    """The best queries of each entity that find a match, in alphabetical order, `most` of them at most."""
    entity = Window.partitionBy("local_id")
    top = measured.filter("rr > 0").withColumn("__r", F.rank().over(entity.orderBy(F.desc("rr")))).filter("__r = 1").drop("__r")
    return top.withColumn("n", F.row_number().over(entity.orderBy("query")).cast("long")).filter(F.col("n") <= most)


def best_rr(measured: DataFrame) -> DataFrame:
    return measured.groupBy("local_id").agg(F.max("rr").alias("best_rr"))


def filler_queries(shorter_best: DataFrame, shorter_rr: DataFrame, longer_rr: DataFrame, fillers: DataFrame) -> DataFrame:
    """(local_id, query): where a longer query of shared terms alone does worse, the best shorter ones with one filler more."""
    worse = shorter_rr.withColumnRenamed("best_rr", "s").join(longer_rr.withColumnRenamed("best_rr", "l"), "local_id", "left").filter(F.col("s") > F.coalesce("l", F.lit(0.0))).select("local_id")
    base = shorter_best.join(worse, "local_id", "left_semi").select("local_id", "query")
    rows = base.join(fillers.select("local_id", "keyword"), "local_id").filter(~F.array_contains("query", F.col("keyword")))
    return rows.select("local_id", F.array_sort(F.concat("query", F.array("keyword"))).alias("query")).distinct()


def reduced_fillers(fillers: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """Fillers where those that no document has count as one kind: the first size - 1 of them stand for all."""
    absent = out_of_vocabulary(fillers, vocabulary)
    few = absent.withColumn("__n", F.row_number().over(Window.partitionBy("local_id").orderBy("keyword"))).filter(F.col("__n") < size).drop("__n").select("local_id", "keyword")
    return fillers.join(absent, ["local_id", "keyword"], "left_anti").unionByName(few)


def partial_queries(overlap: DataFrame, fillers: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(local_id, query): sets of `size` terms with at least one shared term and at least one filler."""
    every = overlap.withColumn("shared", F.lit(1)).unionByName(reduced_fillers(fillers, vocabulary, size).withColumn("shared", F.lit(0)))
    sets = combinations(every.select("local_id", "keyword"), size)
    terms = sets.select("local_id", "query", F.explode("query").alias("keyword")).join(every, ["local_id", "keyword"])
    return terms.groupBy("local_id", "query").agg(F.sum("shared").alias("s")).filter((F.col("s") > 0) & (F.col("s") < size)).select("local_id", "query")


def optimal_queries(local_signals: DataFrame, truth: DataFrame, external_signals: DataFrame, weighted: DataFrame, least: int = 1, most: int = 3, k: int = 20, sample: DataFrame | None = None, keep: int = 100) -> dict[int, DataFrame]:
    """For each length from `least` to `most` the best queries (local_id, query, rr, n) of every entity, or of a sample (id).

    Fillers come in where a longer query of shared terms does worse than the best shorter one, and at the least length, if it is
    above one and no query of shared terms reaches rank one.
    """
    known = truth.join(external_signals.select(F.col("id").alias("external_id")).distinct(), "external_id", "left_semi")
    if sample is not None:
        known = known.join(sample.select(F.col("id").alias("local_id")), "local_id", "left_semi")
    # What each length starts from is written, so that plans don't grow with the length and nothing stays in memory.
    overlap = settled(overlap_terms(local_signals, known, external_signals), "overlap")
    fillers = settled(nonoverlap_terms(local_signals, known, external_signals), "fillers")
    vocabulary = weighted.select("keyword").distinct()
    docs = settled(heads(overlap.unionByName(fillers), weighted, known, max(HEAD, k)), "heads")
    out: dict[int, DataFrame] = {}
    last: DataFrame | None = None
    for size in range(least, most + 1):
        sets = combinations(overlap, size) if size < 3 else bounded_sets(overlap, weighted, known, size, k)
        full = settled(reciprocal_ranks(settled(sets, "sets"), weighted, known, k, best_only=True, docs=docs), "measured")
        if last is not None:
            more = filler_queries(best_queries(last, keep), best_rr(last), best_rr(full), fillers)
        elif least > 1:
            short = known.select("local_id").distinct().join(best_rr(full).filter("best_rr >= 1"), "local_id", "left_anti")
            more = partial_queries(overlap.join(short, "local_id", "left_semi"), fillers.join(short, "local_id", "left_semi"), vocabulary, size)
        else:
            more = None
        last = full if more is None else settled(full.unionByName(reciprocal_ranks(more, weighted, known, k, best_only=True, docs=docs)), "measured")
        out[size] = best_queries(last, keep)
    return out
