"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    judged = apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"], clean=False)
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_share")])


def op3_latent_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0), keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolated_lm import score_text

    scored = score_text(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    back = round_trip(table(spark, sf_dir, "pages"), least=0)
    # Responses are measured and digested on the payload that was read; revisits have the figures of their headers.
    return back.select(
        "page_id",
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )


def op6_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, fold("doc_id", 4) != 2), keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    rows = mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)
    return rows.select("doc_id", *[f"mix.{c}" for c in ("size", "source_size", "target", "taken", "copies", "rate")])


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], decoded=True)
    return coded.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_peak_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .concurrency import open_sales

    return open_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "clients"), grid=60, days=7)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), most=2000, longest=4, least=30, cover=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_packing": op1_mixture_packing,
    "op2_line_first_rules": op2_line_first_rules,
    "op3_latent_knn_quality": op3_latent_knn_quality,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_subword_language": op6_subword_language,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_page_differencing": op8_page_differencing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_entropy_mixing": op10_entropy_mixing,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_peak_sweep": op12_peak_sweep,
    "op13_phrase_collocations": op13_phrase_collocations,
}

_BASE32 = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, {1 + 5 * g}, 5))::BIGINT // {32 ** (3 - k)} % 32)::INT, 1)" for g in range(8) for k in range(4)).removeprefix(" || ")

_W = r"'[^\x20\x09-\x0D]+'"


def _count(chars: str, col: str = "line") -> str:
    return f"len(regexp_extract_all({col}, '[{chars}]'))"


def _rules_sql() -> str:
    from .quality_rules import BOILERPLATE, MAX_CAPITALS, MAX_LOST, MAX_MARKS, MAX_SEPARATORS, MAX_SYMBOLS

    noise, letters, capitals, blanks = r"#*$%&<>{}\[\]\\^~=_@", r"\p{L}", r"\p{Lu}", r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM (SELECT rid, regexp_extract_all(text, {_W}) AS l FROM d)),
win AS (SELECT rid, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS k FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, k) AS c FROM win WHERE k[5] IS NOT NULL) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT pos + i) AS n FROM rep, range(0, 5) r(i) GROUP BY rid),
l AS (SELECT rid, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM (SELECT rid, string_split(text, chr(10)) AS a FROM d)),
m AS (SELECT *, len(regexp_extract_all(line, {_W})) AS words, {_count(noise)} AS symbols, {_count('!?')} AS marks, {_count('|»•·›')} + len(regexp_extract_all(line, ' > ')) AS seps, {_count(letters)} AS letters, {_count(capitals)} AS capitals,
      row_number() OVER (PARTITION BY rid, line ORDER BY no) AS nth, length(line) - {_count(blanks)} AS chars FROM l),
f AS (SELECT *, words > 0 AND ((symbols > {MAX_SYMBOLS}::DOUBLE * words AND symbols > 2) OR (marks > {MAX_MARKS}::DOUBLE * words AND marks > 2) OR (seps > 1 AND seps > {MAX_SEPARATORS}::DOUBLE * words)
      OR (words >= 5 AND letters > 0 AND capitals > {MAX_CAPITALS}::DOUBLE * letters) OR (words <= 20 AND regexp_matches(line, '{BOILERPLATE.pattern}'))) AS failed FROM m),
g AS (SELECT rid, sum(words) AS n_words, count(*) FILTER (words > 0 AND nth > 1) AS dups, count(*) FILTER (failed) AS failed_lines, coalesce(sum(chars) FILTER (failed), 0) AS lost FROM f GROUP BY rid),
t AS (SELECT doc_id, g.n_words::BIGINT AS n_words, (length(text) - {_count(blanks, 'text')})::BIGINT AS word_chars, {_count('#*$%&|<>', 'text')}::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
      failed_lines::BIGINT AS n_failed_lines, lost FROM d JOIN g USING (rid) LEFT JOIN cov USING (rid)),
u AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars = 0 THEN 0 ELSE lost::DOUBLE / word_chars END AS lost_share FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_share <= {MAX_LOST}::DOUBLE AS kept, n_failed_lines, lost_share FROM u"""


ORACLES: dict[str, str] = {
    "op2_line_first_rules": _rules_sql(),
    "op5_warc_round_trip": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q""",
    "op7_hilbert_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_peak_sweep": """
WITH ends AS (SELECT sale_id, epoch(date_trunc('minute', min(shipped_at)))::BIGINT + 7 * 86400 AS stop FROM sale_lines GROUP BY sale_id),
own AS (SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY client_id),
s AS (SELECT coalesce(own.nation, -1) AS nation, epoch(date_trunc('minute', sold_at))::BIGINT AS start, stop, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS cents
      FROM sales LEFT JOIN ends USING (sale_id) LEFT JOIN own USING (client_id) WHERE sold_at IS NOT NULL),
i AS (SELECT * FROM s WHERE stop IS NULL OR stop > start),
e AS (SELECT nation, start AS moment, 1 AS n, cents FROM i UNION ALL SELECT nation, stop, -1, -cents FROM i WHERE stop IS NOT NULL),
b AS (SELECT nation, moment, n, cents FROM e UNION ALL SELECT -2, moment, n, cents FROM e),
m AS (SELECT nation, moment, sum(n) AS n, sum(cents) AS cents FROM b GROUP BY nation, moment HAVING sum(n) <> 0 OR sum(cents) <> 0),
r AS (SELECT nation, moment, lead(moment) OVER w AS until, sum(n) OVER w AS n, sum(cents) OVER w AS cents FROM m WINDOW w AS (PARTITION BY nation ORDER BY moment)),
h AS (SELECT *, max(n) OVER (PARTITION BY nation ORDER BY moment) AS high, max(cents) OVER (PARTITION BY nation) AS top FROM r)
SELECT nation::INTEGER AS nation_id, moment AS from_s, until AS to_s, n::BIGINT AS n_open, cents::BIGINT AS open_cents, high::BIGINT AS high_open, cents = top AS is_peak FROM h""",
    "op13_phrase_collocations": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT rid, lang, generate_subscripts(l, 1) AS piece, unnest(l) AS text FROM (SELECT rid, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS l FROM d)),
w AS (SELECT rid, lang, piece, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM (SELECT rid, lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS l FROM p)),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY rid, piece ORDER BY pos)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM (
        SELECT lang, w1 AS phrase, 1 AS size FROM g UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM g WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM g WHERE w4 IS NOT NULL
      ) AS x GROUP BY lang, phrase, size),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lw, array_to_string(ws[k + 1:size], ' ') AS rw FROM c, range(1, 4) t(k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f::HUGEINT + y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lw JOIN f y ON y.lang = cut.lang AND y.phrase = rw),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
i AS (SELECT lang, a AS longer, array_to_string(ws[b:b + k - 1], ' ') AS phrase FROM c, range(2, 4) t(k), range(1, 4) u(b) WHERE k < size AND b + k - 1 <= size),
j AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY lang, phrase),
o AS (SELECT m.lang, m.phrase, a, l, r, score FROM m LEFT JOIN j ON j.lang = m.lang AND j.phrase = m.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000""",
}
