"""Forward and inverted indexes, document frequencies and normalized weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, is_stop_word, stems, tokens
from ..sources.store import settled


def unpivot(entities: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """(id, attr_ix, attr, cell): one row an attribute; the first column is the id. One pass, no shuffle."""
    key = entities.columns[0]
    names = attrs if attrs is not None else entities.columns[1:]
    cells = F.array(*[F.struct(F.lit(i).alias("attr_ix"), F.lit(a).alias("attr"), F.col(f"`{a}`").cast("string").alias("cell")) for i, a in enumerate(names)])
    return entities.select(F.col(f"`{key}`").cast("string").alias("id"), F.inline(cells))


def token_rows(entities: DataFrame, attrs: list[str] | None = None, stop: bool = True) -> DataFrame:
    """(id, ord, attr, token): every token with its place in the entity; stop words are dropped unless `stop` is False."""
    cells = unpivot(entities, attrs)
    rows = cells.select("id", "attr_ix", "attr", F.posexplode(tokens(F.col("cell"))).alias("pos", "token"))
    rows = rows.select("id", (F.col("attr_ix").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("ord"), "attr", "token")
    return rows.filter(~is_stop_word(F.col("token"))) if stop else rows


def occurrences(entities: DataFrame, attrs: list[str] | None = None, stem: bool = False, stop: bool = True) -> DataFrame:
    """(id, keyword, token, attr, cnt, ord): how often a token with its keyword is in an attribute, and where it is first.

    The keyword is the lower-cased token, or its stem. The same column positions of one token are summed map-side before
    they are shuffled.
    """
    rows = token_rows(entities, attrs, stop)
    counted = rows.groupBy("id", "token", "attr").agg(F.count("*").alias("cnt"), F.min("ord").alias("ord"))
    if not stem:
        return counted.select("id", F.lower("token").alias("keyword"), "token", "attr", "cnt", "ord")
    return counted.join(stems(counted.select("token").distinct()), "token").select("id", "keyword", "token", "attr", "cnt", "ord")


def signals(occ: DataFrame) -> DataFrame:
    """(id, keyword, tf, ord): an entity's terms with their total frequency and first place."""
    return occ.groupBy("id", "keyword").agg(F.sum("cnt").alias("tf"), F.min("ord").alias("ord"))


def nested_signals(occ: DataFrame, is_local: bool = True) -> DataFrame:
    """(id, keyword, origins, tf, is_local): origins in the order in which they were first seen."""
    origins = F.transform(F.array_sort(F.collect_list(F.struct("ord", "token", "attr", "cnt"))), lambda o: F.struct(o["token"].alias("token"), o["attr"].alias("attr"), o["cnt"].alias("cnt")))
    return occ.groupBy("id", "keyword").agg(origins.alias("origins"), F.sum("cnt").alias("tf")).withColumn("is_local", F.lit(is_local))


def origin_columns(nested: DataFrame) -> DataFrame:
    """Origins as three arrays: tokens, attributes, counts."""
    return nested.select("id", "keyword", F.col("origins.token").alias("tokens"), F.col("origins.attr").alias("attrs"), F.col("origins.cnt").alias("counts"))


def same_signal(a: str = "a", b: str = "b"):
    """Whether two nested signals have the same keyword and origins, as a condition between aliases."""
    return (F.col(f"{a}.keyword") == F.col(f"{b}.keyword")) & (F.col(f"{a}.origins") == F.col(f"{b}.origins"))


def split_by_attribute(occ: DataFrame, *more: Column) -> DataFrame:
    """(id, keyword, attr, tf_attr, tf_total, ord, attr_ord): a term once for each attribute it occurs in, with its frequency there
    and in the whole entity; ord is the term's first place, attr_ord that of the attribute within the term. Then come `more`
    aggregates over the term's tokens in the attribute."""
    per = occ.groupBy("id", "keyword", "attr").agg(F.sum("cnt").alias("tf_attr"), F.min("ord").alias("attr_ord"), *more)
    whole = Window.partitionBy("id", "keyword")  # an entity's rows of one term: as many as it has attributes
    return per.select("id", "keyword", "attr", "tf_attr", F.sum("tf_attr").over(whole).alias("tf_total"), F.min("attr_ord").over(whole).alias("ord"), "attr_ord", *per.columns[5:])


def document_frequency(sig: DataFrame) -> DataFrame:
    return sig.groupBy("keyword").agg(F.count("*").alias("df"))


def idf(sig: DataFrame, entities: DataFrame) -> DataFrame:
    """(keyword, df, idf): ln(N / df) over its largest value; N counts distinct ids, empty entities included. All zero if the largest is."""
    n = entities.agg(F.count_distinct(entities.columns[0]).alias("n"))
    df = document_frequency(sig)
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") / F.col("df")))  # one row
    top = raw.agg(F.max("raw").alias("top"))
    return raw.join(F.broadcast(top)).select("keyword", "df", F.coalesce(F.try_divide("raw", "top"), F.lit(0.0)).alias("idf"))


def max_tf(sig: DataFrame) -> DataFrame:
    return sig.groupBy("id").agg(F.max("tf").alias("max_tf"))


def norm_tf(sig: DataFrame) -> DataFrame:
    """(id, keyword, tf, ord, norm_tf): frequency over the entity's largest."""
    return sig.withColumn("norm_tf", F.col("tf") / F.max("tf").over(Window.partitionBy("id")))


def lengths(sig: DataFrame) -> DataFrame:
    return sig.groupBy("id").agg(F.sum("tf").alias("dl"))


def postings(sig: DataFrame) -> DataFrame:
    """(keyword, id, tf, dl): the inverted index in long form, with document lengths."""
    return sig.select("keyword", "id", "tf", F.sum("tf").over(Window.partitionBy("id")).alias("dl"))


def term_lists(entities: DataFrame, stop: bool = True) -> DataFrame:
    """(id, words): the lower-cased tokens of each row, repeats included. One pass, no shuffle."""
    key = entities.columns[0]
    cells = [tokens(F.col(f"`{a}`").cast("string")) for a in entities.columns[1:]]
    words = F.transform(F.flatten(F.array(*cells)) if len(cells) > 1 else cells[0], F.lower)
    words = F.filter(words, lambda t: ~t.isin(STOP_WORDS)) if stop else words
    return entities.select(F.col(f"`{key}`").cast("string").alias("id"), words.alias("words"))


#: So many words at most are looked for inside of lists; more are joined to the lists' words.
FEW = 1_000


def listed(lists: DataFrame, keywords: DataFrame, once: bool = False) -> DataFrame:
    """(id, size, keyword) of `term_lists`: those words that are among `keywords` (keyword), and for each list a row with the empty
    word, which no token is. With `once`, words of a list come once."""
    # Written with the empty word, so that Spark knows how few they are and sends them along, instead of dealing out all words.
    empty = keywords.sparkSession.range(1).select(F.lit("").alias("keyword"))
    asked = settled(keywords.select("keyword").union(empty).distinct(), "keywords")
    few = [r["keyword"] for r in asked.filter("keyword <> ''").limit(FEW + 1).collect()]
    words = F.filter("words", lambda w: w.isin(few)) if len(few) <= FEW else F.col("words")
    words = F.array_distinct(words) if once else words
    rows = lists.select("id", F.size("words").alias("size"), F.explode(F.concat(words, F.array(F.lit("")))).alias("keyword"))
    return rows if len(few) <= FEW else rows.join(asked, "keyword").select("id", "size", "keyword")


def postings_of(lists: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyword, id, tf, dl) of some keywords (keyword) alone, and (n, avgdl) of all entities with a term, from `term_lists`.

    One pass over the lists: other tokens are dropped before anything is shuffled, and a row for each list brings its length along.
    Ids that repeat count as one entity.
    """
    counted = listed(lists, keywords).repartition("id").groupBy("id", "keyword").agg(F.count("*").alias("tf"), F.sum("size").alias("size"))
    dl = F.max(F.when(F.col("keyword") == "", F.col("size"))).over(Window.partitionBy("id"))
    counted = settled(counted.select("keyword", "id", "tf", dl.alias("dl")), "postings")
    totals = counted.filter("keyword = '' AND dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return counted.filter("keyword <> ''"), totals


def nested_postings(sig: DataFrame) -> DataFrame:
    """(keyword, df, docs): a posting list of (id, tf) for each term. For small vocabularies; long lists belong in the long form."""
    return sig.groupBy("keyword").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("docs"))


def with_idf(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds idf to terms; 0 for terms that the table doesn't know."""
    return terms.join(weights.select("keyword", "idf"), "keyword", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
