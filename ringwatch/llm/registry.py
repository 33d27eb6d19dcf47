"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import fingerprint, jaccard, lexical, lm, neighbours, packing, pii, quality, resample, rules, sharding, tokenfile, unigram
from ringwatch.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: Stands for a secret that a deployment keeps elsewhere.
PII_KEY = "rotate-me"


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op3_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"), PIECES)


def op4_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(tokenfile.rebase(tokenfile.write(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)))


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_suffix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op13_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_label_propagation_shards, op2_feistel_pseudonyms, op3_max_plus_pieces, op4_one_bit_neighbours, op5_token_files, op6_cotrained_quality, op7_fingerprints, op8_ngram_jaccard_join, op9_packing, op10_pitman_yor_scores, op11_suffix_resampling, op12_block_max_search, op13_weak_supervision)}


_JACCARD = """WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws FROM documents),
    lists AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) ss FROM w),
    sizes AS (SELECT doc_id, len(ss) n_shingles, CASE WHEN len(ss) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(ss, chr(10)))) END class_id FROM lists),
    reps AS (SELECT doc_id, unnest(ss) s FROM lists JOIN sizes USING (doc_id) WHERE doc_id = class_id),
    pairs AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM reps a JOIN reps b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)),
    near AS (SELECT x a, y b FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT a x, a y FROM near UNION SELECT r.x, n.b FROM reach r JOIN near n ON n.a = r.y),
    least AS (SELECT x class_id, min(y) least FROM reach GROUP BY 1),
    degree AS (SELECT a class_id, count(*) n_links FROM near GROUP BY 1)
    SELECT doc_id, n_shingles, coalesce(least, class_id) component_id, class_id, coalesce(n_links, 0) n_links FROM sizes LEFT JOIN least USING (class_id) LEFT JOIN degree USING (class_id)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Buckets are CRC-32 of the word's bytes, bit by bit.
_RESAMPLE = rf"""WITH
    d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) w FROM d),
    q AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w FROM benchmark),
    v AS (SELECT w, hex(encode(w)) hx FROM (SELECT w FROM u UNION SELECT w FROM q)),
    b AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(1, 9)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 10000 bucket FROM v),
    s AS (SELECT bucket, count(*) s FROM u JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) t FROM q JOIN b USING (w) GROUP BY 1),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM u) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM q) + 10000.0::DOUBLE))))::BIGINT gain FROM s FULL JOIN t USING (bucket)),
    x AS (SELECT doc_id, count(*) n, floor(sum(gain)::DOUBLE / count(*))::BIGINT weight FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
    y AS (SELECT doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT score
        FROM documents LEFT JOIN x USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) rank, count(*) OVER () total FROM y WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END rank FROM y LEFT JOIN r USING (doc_id)"""

_SEARCH = rf"""WITH
    d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
    lens AS (SELECT doc_id, len(ws)::BIGINT n FROM d WHERE len(ws) > 0),
    tot AS (SELECT count(*)::BIGINT nd, sum(n)::BIGINT l FROM lens),
    u AS (SELECT doc_id, unnest(ws) w FROM d), f AS (SELECT doc_id, w, count(*)::BIGINT tf FROM u GROUP BY ALL),
    df AS (SELECT w, count(*)::BIGINT df FROM f GROUP BY 1),
    wt AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT weight FROM df, tot),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w FROM benchmark),
    m AS (SELECT doc_id, 10 + (90 * n * nd) // l m FROM lens, tot),
    s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score FROM q JOIN wt USING (w) JOIN f USING (w) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10"""


_QUOTED = rules.MARKS.replace("'", "''")


def _weak_supervision() -> str:
    """The counts, the votes, and each round of the estimates as one common table of one row."""
    a, b = "100 * {0} > {1} * {2}", "100 * {0} <= {1} * {2}"
    cases = [
        ("n_words < 20", "n_words >= 100"),
        (a.format("n_symbols", 10, "n_words"), b.format("n_symbols", 1, "n_words")),
        (a.format("n_repeat_words", 20, "n_words"), "n_repeat_words = 0 AND n_words >= 20"),
        (a.format("n_dup_lines", 20, "n_lines"), "n_dup_lines = 0 AND n_lines >= 3"),
        (a.format("n_capitals", 30, "word_chars"), b.format("n_capitals", 10, "word_chars")),
        (a.format("n_marks", 12, "word_chars"), b.format("n_marks", 6, "word_chars")),
        ("100 * n_pairs < 40 * (n_words - 1)", "100 * n_pairs >= 70 * (n_words - 1) AND n_words >= 20"),
        ("word_chars > 12 * n_words OR word_chars < 3 * n_words", "word_chars <= 9 * n_words AND word_chars >= 4 * n_words"),
    ]
    rule = range(len(cases))
    votes = ", ".join(f"CASE WHEN {no} THEN -1 WHEN {yes} THEN 1 ELSE 0 END v{i}" for i, (no, yes) in enumerate(cases))
    names = ", ".join(f"v{i}" for i in rule)
    odds = "ln(share) - ln(1 - share) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln(a{i}) - ln(1 - b{i}) WHEN -1 THEN ln(1 - a{i}) - ln(b{i}) ELSE 0 END" for i in rule)
    start = ", ".join(f"{rules.START[1]}::DOUBLE a{i}, {rules.START[2]}::DOUBLE b{i}" for i in rule)
    sums = lambda v, x: f"coalesce(sum(n * {x}) FILTER (v{v}), 0)"
    again = ", ".join(f"({sums(f'{i} = 1', 'p')} + 1) / (coalesce(sum(n * p) FILTER (v{i} <> 0), 0) + 2) a{i}, ({sums(f'{i} = -1', '(1 - p)')} + 1) / (coalesce(sum(n * (1 - p)) FILTER (v{i} <> 0), 0) + 2) b{i}" for i in rule)
    rounds = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT (sum(n * p) + 1) / (sum(n) + 2) share, {again} FROM (SELECT *, 1 / (1 + exp(-({odds}))) p FROM patterns, m{k}))" for k in range(rules.ROUNDS))
    return rf"""WITH
    t AS (SELECT doc_id, coalesce(text, '') text FROM documents),
    d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM t),
    g AS (SELECT *, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) gs FROM d),
    e AS (SELECT doc_id, unnest(gs) g, generate_subscripts(gs, 1) i FROM g),
    twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM e) WHERE c > 1),
    rep AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) r FROM twice GROUP BY 1),
    c AS (SELECT doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars, length(text) - length(translate(text, '{rules.SYMBOLS}', '')) n_symbols,
        length(text) - length(translate(text, '{rules.CAPITALS}', '')) n_capitals, length(text) - length(translate(text, '{_QUOTED}', '')) n_marks, len(ls) n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
        len(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) n_pairs, coalesce(r, 0)::BIGINT n_repeat_words FROM g LEFT JOIN rep USING (doc_id)),
    v AS (SELECT *, {votes} FROM c),
    patterns AS MATERIALIZED (SELECT {names}, count(*) n FROM v GROUP BY ALL),
    m0 AS (SELECT {rules.START[0]}::DOUBLE share, {start}), {rounds},
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed, 1 / (1 + exp(-({odds}))) quality FROM v, m{rules.ROUNDS})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 kept FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are tested by brute force, round trips and held-out documents."""
    return {"op8_ngram_jaccard_join": _JACCARD, "op11_suffix_resampling": _RESAMPLE, "op12_block_max_search": _SEARCH, "op13_weak_supervision": _weak_supervision()}
