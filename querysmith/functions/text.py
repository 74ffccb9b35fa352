"""Text preparation as column expressions; only the stemmer is Python, and runs on distinct tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII punctuation without the hyphen.
PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"
#: Words that are written together and count as two tokens, with the place of the cut.
CONTRACTIONS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))
#: English stop words. Those with apostrophes can't occur, as apostrophes are deleted before.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn "
    "hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
#: Quotation marks that are tokens of their own.
QUOTES = "«»“”‘’„"
#: A token: anything but white space.
TOKEN = r"[^ \t\n\r\f\x0B]+"
#: What is between tokens.
GAP = r"[ \t\n\r\f\x0B]+"


def strip_punctuation(text: Column) -> Column:
    """Deletes ASCII punctuation except hyphens."""
    return F.regexp_replace(text, f"[{re.escape(PUNCTUATION)}]+", "")


def prepared(text: Column) -> Column:
    """Text whose white space separates tokens: no punctuation, contractions and dashes set apart."""
    given = F.coalesce(text, F.lit(""))
    out = strip_punctuation(given)
    # Whole words, none of whose halves is one again: so all of them go in one pass.
    out = F.regexp_replace(out, rf"(?i)\b({'|'.join(f'{a}(?={b}\\b)' for a, b in CONTRACTIONS)})", "$1 ")
    quoted = reduce(lambda a, b: a | b, [F.contains(given, F.lit(q)) for q in QUOTES])  # told by bytes, most texts need no pass for them
    out = F.when(quoted, F.regexp_replace(out, f"([{QUOTES}])", " $1 ")).otherwise(out)
    return F.replace(out, F.lit("--"), F.lit(" -- "))


def tokens(text: Column) -> Column:
    """The tokens of a text, in order."""
    return F.filter(F.split(prepared(text), GAP), lambda t: t != "")


def is_stop_word(token: Column) -> Column:
    return F.lower(token).isin(STOP_WORDS)


def has_non_alpha(term: Column) -> Column:
    return term.rlike(r"[^\p{L}]")


def is_title(token: Column) -> Column:
    """Every run of letters begins with an upper-case letter and goes on in lower case."""
    return token.rlike(r"^[^\p{Lu}\p{Ll}\p{Lt}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Ll}\p{Lt}]+|$))+$")


def is_upper(token: Column) -> Column:
    return (F.upper(token) == token) & (F.lower(token) != token)


def row_string(df: DataFrame) -> Column:
    """A row as one string, cells joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])


def truncated(sequence: Column, most: int = 4094, prefix: int = 0) -> Column:
    """A token sequence cut to what a model takes beside its prefix."""
    return F.slice(sequence, 1, max(0, most - prefix))


def subword_ids(text: Column, path: str, lead: bool = True) -> Column:
    """The ids of a text's sub-words by the tokenizer file at `path`, which executors must see under that name; with `lead`, as of a
    text inside another (a space before it). A null text has none. Texts are encoded whole, in batches; a worker reads the file once."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            known = batch.fillna("")
            found = tokenizer.encode_batch([" " + t if lead and t else t for t in known], add_special_tokens=False)
            yield pd.Series([e.ids for e in found], dtype=object)

    return encode(text.cast("string"))


def matches_at(sequence: Column, pattern: Column) -> Column:
    """Starts (from 0) at which a token sequence holds a pattern."""
    starts = F.sequence(F.lit(0), F.size(sequence) - F.size(pattern))
    found = F.filter(starts, lambda i: F.slice(sequence, i + 1, F.size(pattern)) == pattern)
    return F.when((F.size(pattern) > 0) & (F.size(pattern) <= F.size(sequence)), found).otherwise(F.array().cast("array<int>"))


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y; words of two letters too if they are vowel, consonant."""
    shape = _shape(word)
    return shape.endswith("cvc") and word[-1] not in "wxy" or len(word) == 2 and shape == "vc"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: Fixed values of the published suffix-stripping algorithm, with the usual later additions: (suffix, replacement).
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words that are not stemmed by rule.
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def stem(token: str) -> str:
    """Porter's suffix stripping on the lower-cased token; tokens of one or two letters stay."""
    word = token.lower()
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    cut = None
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    # Derivations, in two passes.
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    for suffix, new in sorted(_STEP2, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            if _measure(word[: -len(suffix)]) > 0:
                word = word[: -len(suffix)] + new
            break
    else:
        if word.endswith("logi") and _measure(word[:-3]) > 0:
            word = word[:-1]
    for suffix, new in sorted(_STEP3, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            if _measure(word[: -len(suffix)]) > 0:
                word = word[: -len(suffix)] + new
            break
    for suffix in sorted(_STEP4, key=lambda s: -len(s)):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if _measure(left) > 1 and (suffix != "ion" or left[-1] in "st"):
                word = left
            break
    # The end.
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or _measure(left) == 1 and not _short(left):
            word = left
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stems(distinct: DataFrame, col: str = "token") -> DataFrame:
    """(token, keyword) for a DataFrame of distinct tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"token": batch[col], "keyword": batch[col].map(stem)})

    return distinct.select(col).mapInPandas(run, "token string, keyword string")
