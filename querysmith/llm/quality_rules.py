"""Line-first cleaning of documents by rules.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are
removed, then documents that lost too much of their text are rejected. Document-wide counts
(repeated lines and word windows, symbols) are taken on the whole text in the same pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Phrases of lines that belong to a site rather than to a text.
BOILERPLATE = re.compile(r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|lorem ipsum|click here|read more|sign (?:in|up) (?:to|for|now)|log ?in|subscribe (?:to|now)|skip to (?:main )?content|share (?:on|this)|follow us|powered by|back to top)\b")
#: Of a line: most symbols a word, marks of shouting a word, separators a word, share of capitals.
MAX_SYMBOLS, MAX_MARKS, MAX_SEPARATORS, MAX_CAPITALS = 0.5, 0.5, 0.34, 0.6
#: Most of a document's word characters that failing lines may hold.
MAX_LOST = 0.3


def line_verdict(line: str, words: int) -> str | None:
    """The rule that a line with `words` words fails, or None. Lines without a word fail none.

    Punctuation: more than one symbol or exclamation run for every other word. Navigation: separators (| > » • ·) between
    short items. Capitals: five words or more, mostly in capitals. Boilerplate: a phrase of a site's frame in a short line.
    """
    if not words:
        return None
    symbols = sum(map(line.count, "#*$%&<>{}[]\\^~=_@"))
    if symbols > MAX_SYMBOLS * words and symbols > 2:
        return "punctuation"
    marks = line.count("!") + line.count("?")
    if marks > MAX_MARKS * words and marks > 2:
        return "punctuation"
    separators = sum(map(line.count, "|»•·›")) + line.count(" > ")
    if separators > 1 and separators > MAX_SEPARATORS * words:
        return "navigation"
    if words >= 5:
        letters = sum(map(str.isalpha, line))
        if letters and sum(map(str.isupper, line)) > MAX_CAPITALS * letters:
            return "capitals"
    if words <= 20 and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of `width` words that occurs at least twice, the first occurrence included. Exact."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    codes, distinct = ids, len(seen)
    if distinct == len(words):
        return 0
    whole = ids[:n]
    for k in range(1, width):
        if distinct > (1 << 62) // max(len(seen), 1):
            kept, whole = np.unique(whole, return_inverse=True)
            distinct = len(kept)
        whole = whole * len(seen) + codes[k : k + n]
        distinct *= len(seen)
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, failing lines, share lost."""
    text = text or ""
    # Surrogates can't come from Spark's strings; "surrogatepass" keeps the function total.
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeated_words(words)
    base_failed = n < 10 or 100 * repeats > 20 * n
    seen: set[str] = set()
    dups, failing, lost, good = 0, 0, 0, []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            if line in seen:
                dups += 1
            seen.add(line)
        if line_verdict(line, len(own)):
            failing += 1
            lost += len(line) - sum(map(line.count, " \t\v\f\r"))
        else:
            good.append(line)
    share = lost / chars if chars else 0.0
    return n, chars, symbols, dups, repeats, base_failed, not base_failed and share <= MAX_LOST, "\n".join(good) if failing else text, failing, share


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_failed_lines", "lost_share"]


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string, n_failed_lines long, lost_share double"


def _run(clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch.column("text")]
            found = {name: pa.array([None if name == "clean_text" and not clean else r[i] for r in rows], kinds[i]) for i, name in enumerate(_NAMES)}
            yield pa.record_batch({"row": batch.column("row")} | found)

    return run


def apply_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, clean: bool = True, out: str = "quality") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`: a struct of the counts, base_failed, kept, clean_text
    (null unless `clean`), n_failed_lines and lost_share.

    Words are runs of anything but ASCII white space; lines are split at line feeds. `kept` is false if base_failed, or if
    failing lines hold more than MAX_LOST of the word characters. Null and empty texts have no words: zeros, base_failed, not
    kept, empty clean_text. Ties can't occur; repeated rows are judged each; an empty table stays empty. The other columns,
    nulls in them included, are handed through. A column named as `out` is replaced. One pass, no shuffle.
    """
    kept = [c for c in keep or docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(_FIELDS)])
    return rows.mapInArrow(_run(clean), schema).select("row.*", F.struct(*_NAMES).alias(out))
