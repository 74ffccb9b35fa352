"""Lemmas by detaching endings: each distinct form is looked up as it is, then without an ending of its part of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of inflected forms by part of speech, and what takes their place, in the order in which they are tried.
ENDINGS: dict[str, tuple[tuple[str, str], ...]] = {
    "noun": (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "verb": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "adj": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "adv": (),
}


def lemmas(forms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(form, pos, lemma, n_senses): for each form (form: distinct, lower case) and part of speech the first lemma that the lexicon has.

    exceptions, (form, pos, lemma), come first, then the form itself, then the endings in their order. A form that leads nowhere in a
    part of speech has no row. Candidates are a few a form and are checked by one join; texts aren't touched.
    """
    form = F.col("form")
    tried = []
    for pos, endings in ENDINGS.items():
        tried.append(F.struct(F.lit(pos).alias("pos"), F.lit(0).alias("place"), form.alias("lemma")))
        for place, (ending, instead) in enumerate(endings, 1):
            cut = F.when(form.endswith(ending), F.concat(form.substr(F.lit(1), F.length(form) - len(ending)), F.lit(instead)))
            tried.append(F.struct(F.lit(pos).alias("pos"), F.lit(place).alias("place"), cut.alias("lemma")))
    candidates = forms.select("form", F.inline(F.array(*tried))).filter("lemma <> ''")
    if exceptions is not None:
        known = exceptions.join(forms.select("form"), "form", "left_semi")
        candidates = candidates.unionByName(known.select("form", "pos", F.lit(-1).alias("place"), "lemma"))
    there = lexicon.select(F.col("form").alias("lemma"), "pos", "n_senses")
    found = candidates.join(there, ["lemma", "pos"])
    return found.groupBy("form", "pos").agg(F.min_by(F.struct("lemma", "n_senses"), "place").alias("l")).select("form", "pos", "l.lemma", "l.n_senses")
