"""Feature vectors of terms, in a fixed order that is part of the contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_non_alpha, is_title, is_upper
from .buckets import Buckets, find_buckets, one_hot
from .index import norm_tf, signals, split_by_attribute, with_idf
from .lemmas import lemmas

#: Parts of speech in the order of their features.
POS = ("noun", "verb", "adj", "adv")


@dataclass(frozen=True)
class Layout:
    """What a vector is made of: buckets, attributes and optional parts."""

    attrs: tuple[str, ...]
    idf: Buckets = field(default_factory=list)
    length: Buckets = field(default_factory=list)
    tf: Buckets = field(default_factory=list)
    borrowed: bool = False
    external: bool = False
    unsupervised: bool = False

    @property
    def names(self) -> list[str]:
        out = [f"idf_{i}" for i in range(len(self.idf))] + ["norm_tf"] + [f"tf_{i}" for i in range(len(self.tf))]
        out += [f"share_{a}" for a in self.attrs] + [f"in_{a}" for a in self.attrs] + [f"length_{i}" for i in range(len(self.length))]
        out += ["non_alpha", "title", "upper", *POS]
        return out + ["borrowed"] * self.borrowed + ["external_tf"] * self.external + ["unsupervised_tf"] * self.unsupervised

    @property
    def external_names(self) -> list[str]:
        return [f"idf_{i}" for i in range(len(self.idf))] + ["unsupervised_tf"] * self.unsupervised


def local_layout(occ: DataFrame, weights: DataFrame, attrs: list[str], **flags: bool) -> Layout:
    """Buckets from the local side: 7 of idf over terms, 6 of term length and 6 of normalized frequency over entity terms."""
    sig = norm_tf(signals(occ)).withColumn("len", F.length("keyword"))
    return Layout(tuple(attrs), find_buckets(weights, "idf", 7), find_buckets(sig, "len", 6), find_buckets(sig, "norm_tf", 6), **flags)


def external_tf_buckets(external_signals: DataFrame) -> Buckets:
    """6 buckets of normalized frequency over the external side."""
    return find_buckets(norm_tf(external_signals), "norm_tf", 6)


def shapes(occ: DataFrame) -> DataFrame:
    """(id, keyword, title, upper): whether any original token is in title case, in capitals."""
    return occ.groupBy("id", "keyword").agg(F.bool_or(is_title(F.col("token"))).alias("title"), F.bool_or(is_upper(F.col("token"))).alias("upper"))


def pos_shares(occ: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """(id, keyword, noun, verb, adj, adv): shares of senses of the original tokens' lemmas. lexicon: (form, pos, n_senses) of lemmas."""
    terms = occ.select("id", "keyword", F.lower("token").alias("form")).distinct()
    if lexicon is None:
        return terms.select("id", "keyword").distinct().select("id", "keyword", *[F.lit(0.0).alias(p) for p in POS])
    senses = lemmas(terms.select("form").distinct(), lexicon)
    found = terms.join(senses, "form", "left").groupBy("id", "keyword").agg(*[F.coalesce(F.sum(F.when(F.col("pos") == p, F.col("n_senses"))), F.lit(0)).alias(p) for p in POS])
    total = F.greatest(sum((F.col(p) for p in POS[1:]), F.col(POS[0])), F.lit(1))
    return found.select("id", "keyword", *[(F.col(p) / total).alias(p) for p in POS])


def sense_counts(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(form, noun, verb, adj, adv): numbers of senses of the lemmas of distinct forms, null where there are none."""
    return lemmas(forms, lexicon).groupBy("form").agg(*[F.sum(F.when(F.col("pos") == p, F.col("n_senses"))).alias(p) for p in POS])


def external_frequency(matched: DataFrame, external_signals: DataFrame) -> DataFrame:
    """(local_id, keyword, external_tf): a term's normalized frequency in the entity's matches, those without it counting 0.
    matched: (local_id, external_id)."""
    pairs = matched.select("local_id", "external_id").distinct()
    n = pairs.groupBy("local_id").agg(F.count("*").alias("n"))
    terms = norm_tf(external_signals).select(F.col("id").alias("external_id"), "keyword", "norm_tf")
    total = pairs.join(terms, "external_id").groupBy("local_id", "keyword").agg(F.sum("norm_tf").alias("s"))
    return total.join(n, "local_id").select("local_id", "keyword", (F.col("s") / F.col("n")).alias("external_tf"))


def feature_columns(layout: Layout) -> list[Column]:
    """The vector from a row's columns: is_local, idf, norm_tf, keyword, tf_total, tf_<i>, title, upper, the parts of speech."""
    local = F.col("is_local")
    weight, share = F.when(local, F.col("idf")).otherwise(0.0), F.when(local, F.col("norm_tf")).otherwise(0.0)
    out = [*one_hot(weight, layout.idf), share, *one_hot(share, layout.tf)]
    out += [F.when(local, F.col("attr_tf")[i] / F.col("tf_total")).otherwise(0.0) for i in range(len(layout.attrs))]
    out += [F.when(local & (F.col("attr_tf")[i] > 0), 1.0).otherwise(0.0) for i in range(len(layout.attrs))]
    out += [*one_hot(F.length("keyword").cast("double"), layout.length), has_non_alpha(F.col("keyword")).cast("double"), F.col("title").cast("double"), F.col("upper").cast("double"), *[F.col(p) for p in POS]]
    out += [F.coalesce(F.col("is_borrowed").cast("double"), F.lit(0.0))] * layout.borrowed
    out += [F.coalesce(F.col("external_tf"), F.lit(0.0))] * layout.external + [F.coalesce(F.col("unsupervised_tf"), F.lit(0.0))] * layout.unsupervised
    return [c.cast("double") for c in out]


def _sum_of(structs: str, field_name: str) -> Column:
    return F.aggregate(structs, F.lit(0).cast("long"), lambda total, s: total + s[field_name])


def featurize(occ: DataFrame, weights: DataFrame, layout: Layout, lexicon: DataFrame | None = None, is_local: bool = True, extra: DataFrame | None = None, max_tf: DataFrame | None = None) -> DataFrame:
    """(id, keyword, attr, ord, attr_ord, is_local, x): one vector a query candidate, that is a term in an attribute.

    A candidate's other attributes count 0 in its shares, which are taken of the whole entity's frequency.
    extra: (id, keyword) with is_borrowed, external_tf, unsupervised_tf, as far as the layout asks for them.
    All that is counted by entity is one aggregation and two windows: where `occ` is dealt out by id, none of them shuffles.
    """
    # Title and capitals of a candidate look at its own attribute's tokens.
    shape = [F.bool_or(is_title(F.col("token"))).alias("title"), F.bool_or(is_upper(F.col("token"))).alias("upper")]
    if lexicon is None:
        rows = split_by_attribute(occ, *shape)
        rows = rows.select("*", *[F.lit(0.0).alias(p) for p in POS])
    else:
        forms = occ.withColumn("form", F.lower("token"))
        forms = forms.join(sense_counts(forms.select("form").distinct(), lexicon), "form", "left")
        known = F.struct("form", *[F.coalesce(F.col(p), F.lit(0)).cast("long").alias(p) for p in POS])
        rows = split_by_attribute(forms, *shape, F.collect_set(known).alias("__forms"))  # of one term: its unstemmed forms
        rows = rows.select("*", *[_sum_of("__forms", p).alias(f"__{p}") for p in POS])
        total = F.greatest(sum((F.col(f"__{p}") for p in POS[1:]), F.col(f"__{POS[0]}")), F.lit(1))
        rows = rows.select("*", *[(F.col(f"__{p}") / total).alias(p) for p in POS]).drop("__forms", *[f"__{p}" for p in POS])
    top = F.max("tf_total").over(Window.partitionBy("id"))
    rows = with_idf(rows.withColumn("norm_tf", F.col("tf_total") / top), weights)
    rows = rows.withColumn("attr_tf", F.array(*[F.when(F.col("attr") == a, F.col("tf_attr")).otherwise(F.lit(0)) for a in layout.attrs])).withColumn("is_local", F.lit(is_local))
    if extra is not None:
        rows = rows.join(extra, ["id", "keyword"], "left")
    for name in ("is_borrowed", "external_tf", "unsupervised_tf"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("boolean" if name == "is_borrowed" else "double"))
    return rows.select("id", "keyword", "attr", "ord", "attr_ord", "is_local", F.array(*feature_columns(layout)).alias("x"))


def featurize_external(terms: DataFrame, weights: DataFrame, layout: Layout, frequency: DataFrame | None = None) -> DataFrame:
    """(id, keyword, x): the short vector of terms that were borrowed without supervision."""
    rows = with_idf(terms.select("id", "keyword"), weights)
    if frequency is not None:
        rows = rows.join(frequency.select(F.col("local_id").alias("id"), "keyword", "external_tf"), ["id", "keyword"], "left")
    else:
        rows = rows.withColumn("external_tf", F.lit(0.0))
    x = [*one_hot(F.col("idf"), layout.idf)] + [F.coalesce("external_tf", F.lit(0.0))] * layout.unsupervised
    return rows.select("id", "keyword", F.array(*x).alias("x"))
