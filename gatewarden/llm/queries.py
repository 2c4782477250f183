"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewarden.llm import byte_bpe, conversations, language_id, lm_scoring, mixing, quality_rules, simhash, substrings, token_counts, topk, url_filter, warc, whitening
from gatewarden.llm.workers import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(spark, read) -> DataFrame``; ``read`` opens a table of the folder."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def _quality_sql(risk: quality_rules.Risk = quality_rules.Risk()) -> str:
    """The quality rules once more, with the binomial sums from the gamma function."""
    rules = quality_rules.RULES
    share = risk.false_rejections / len(rules)
    levels = " UNION ALL ".join(
        f"SELECT lang, good, '{rule}' AS rule, len(list_filter({sorted(grid)}, lambda c: {rule} > c)) AS level FROM holdout"
        for rule, grid in rules.items()
    )
    grids = " ".join(f"WHEN '{rule}' THEN {sorted(grid)}[level]" for rule, grid in rules.items())
    limits = ", ".join(f"max(cutoff) FILTER (rule = '{rule}') AS {rule}_limit" for rule in rules)
    fired = ", ".join(f"CASE WHEN {rule} > {rule}_limit THEN '{rule}' END" for rule in rules)
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY rid),
counts AS (
  SELECT p.doc_id, p.lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM parts p LEFT JOIN covered c USING (rid)),
facts AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) AS long_word_mean,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
judged AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT f.*, j.good FROM facts f JOIN judged j USING (doc_id) WHERE NOT base_failed),
levels AS ({levels}),
ranked AS (
  SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS place, sum(n) OVER (ORDER BY n DESC, lang ROWS UNBOUNDED PRECEDING) AS so_far,
    (SELECT count(*) FILTER (good) FROM holdout) AS total
  FROM (SELECT lang, count(*) FILTER (good) AS n FROM holdout WHERE lang IS NOT NULL GROUP BY lang)),
needed AS (SELECT *, ln({risk.error / len(rules)} / (place + 1)) / ln({1 - share}) AS need FROM ranked),
named AS (
  SELECT lang FROM ranked WHERE place <= (SELECT max(place) FROM needed WHERE n >= need AND total - so_far >= need)),
tally AS (
  SELECT coalesce(n.lang, '*') AS stratum, rule, level, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad
  FROM levels l LEFT JOIN named n ON n.lang = l.lang GROUP BY 1, 2, 3),
found AS (
  SELECT *, sum(good) OVER whole AS n_good, sum(bad) OVER whole AS n_bad, sum(good) OVER above AS good_rejected, sum(bad) OVER above AS bad_rejected
  FROM tally WINDOW whole AS (PARTITION BY stratum, rule),
    above AS (PARTITION BY stratum, rule ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sizes AS (
  SELECT stratum, max(n_good) AS n, {risk.error} / ({len(rules)} * (SELECT count(DISTINCT stratum) FROM tally)) AS error
  FROM found GROUP BY stratum),
sums AS (
  SELECT stratum, error, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))
    OVER (PARTITION BY stratum ORDER BY i) AS below
  FROM (SELECT *, unnest(range(0, CAST(ceil(n * {share}) AS BIGINT) + 1)) AS i FROM sizes) WHERE i <= n),
allowed AS (SELECT stratum, max(i) AS k FROM sums WHERE below <= error GROUP BY stratum),
chosen AS (
  SELECT stratum, rule, level, CASE rule {grids} END AS cutoff,
    row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_rejected / n_bad - coalesce(good_rejected / nullif(n_good, 0), 0) DESC, level DESC) AS place
  FROM found JOIN allowed USING (stratum)
  WHERE level > 0 AND good_rejected <= k AND n_bad > 0 AND bad_rejected / n_bad >= {risk.min_capture}
    AND bad_rejected / n_bad - coalesce(good_rejected / nullif(n_good, 0), 0) > 0),
limits AS (SELECT stratum, {limits} FROM chosen WHERE place = 1 GROUP BY stratum),
fired AS (
  SELECT f.*, array_to_string(list_filter([{fired}], lambda x: x IS NOT NULL), ',') AS rules_fired
  FROM facts f LEFT JOIN named n ON n.lang = f.lang LEFT JOIN limits l ON l.stratum = coalesce(n.lang, '*'))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules_fired = '' AS kept, rules_fired FROM fired
"""


@query("op1_quality_rules", _quality_sql())
def quality(spark, read):
    return quality_rules.quality_verdicts(read("documents"), read("labels"))


REPEATS_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE doc_id IS NOT NULL AND len(ws) >= 13),
windows AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM starts),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j
  FROM (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS later FROM windows) WHERE later),
marked AS (
  SELECT w.rid, w.doc_id, w.j, w.word, g.j IS NOT NULL AS removed
  FROM (SELECT rid, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM words) w LEFT JOIN gone g ON g.rid = w.rid AND g.j = w.j),
kept AS (
  SELECT rid, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT removed), '') AS text
  FROM marked GROUP BY rid)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (rid)
"""


@query("op4_substring_dedup", REPEATS_SQL)
def repeats(spark, read):
    return substrings.digest(substrings.deduplicated(read("documents")))


@query("op2_simhash_groups")
def near_copies(spark, read):
    return simhash.components(read("documents"))


SCORES_SQL = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
    FROM documents)),
grams AS (
  SELECT *, lag(w, 1) OVER (PARTITION BY rid ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS q FROM words),
total AS (SELECT count(*) AS n FROM words),
own0 AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
all1 AS (SELECT w, count(*) AS n FROM grams GROUP BY w),
own1 AS (SELECT rid, w, count(*) AS n FROM grams GROUP BY rid, w),
all2 AS (SELECT p, w, count(*) AS n FROM grams WHERE p IS NOT NULL GROUP BY p, w),
own2 AS (SELECT rid, p, w, count(*) AS n FROM grams WHERE p IS NOT NULL GROUP BY rid, p, w),
all3 AS (SELECT q, p, w, count(*) AS n FROM grams WHERE q IS NOT NULL GROUP BY q, p, w),
own3 AS (SELECT rid, q, p, w, count(*) AS n FROM grams WHERE q IS NOT NULL GROUP BY rid, q, p, w),
counted AS (
  SELECT g.rid, g.i, (SELECT n FROM total) - own0.n AS c0, all1.n - own1.n AS c1,
         h1.n - o1.n AS d1, coalesce(all2.n - own2.n, 0) AS c2, h2.n - o2.n AS d2, coalesce(all3.n - own3.n, 0) AS c3
  FROM grams g JOIN own0 USING (rid)
  JOIN all1 ON all1.w = g.w JOIN own1 ON own1.rid = g.rid AND own1.w = g.w
  LEFT JOIN all1 h1 ON h1.w = g.p LEFT JOIN own1 o1 ON o1.rid = g.rid AND o1.w = g.p
  LEFT JOIN all2 ON all2.p = g.p AND all2.w = g.w LEFT JOIN own2 ON own2.rid = g.rid AND own2.p = g.p AND own2.w = g.w
  LEFT JOIN all2 h2 ON h2.p = g.q AND h2.w = g.p LEFT JOIN own2 o2 ON o2.rid = g.rid AND o2.p = g.q AND o2.w = g.p
  LEFT JOIN all3 ON all3.q = g.q AND all3.p = g.p AND all3.w = g.w
  LEFT JOIN own3 ON own3.rid = g.rid AND own3.q = g.q AND own3.p = g.p AND own3.w = g.w),
scored AS (
  SELECT rid, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS best,
         CASE WHEN c3 > 0 THEN ln(c3 / d2) WHEN c2 > 0 THEN ln(c2 / d1) WHEN c1 > 0 THEN ln(c1 / c0) ELSE -ln(greatest(c0, 1)) END
           + ln(0.4) * (least(i, 3) - CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END) AS value
  FROM counted)
SELECT d.doc_id, count(s.rid) AS n_words, count(*) FILTER (WHERE s.best = 3) AS n_full,
       count(*) FILTER (WHERE s.best = 0) AS n_unseen, round(coalesce(sum(s.value), 0), 4) + 0.0 AS log_score,
       round(avg(s.value), 6) + 0.0 AS mean_log_score
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN scored s USING (rid)
GROUP BY d.rid, d.doc_id
"""


@query("op7_lm_scores", SCORES_SQL)
def language_model(spark, read):
    found = lm_scoring.scores(read("documents"))
    return found.withColumns(
        {"log_score": F.round("log_score", 4) + 0.0, "mean_log_score": F.round("mean_log_score", 6) + 0.0}
    )


@query("op8_byte_bpe")
def tokens(spark, read):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encoded(read("documents"), path, public_tokenizers.PATTERN))


@query("op9_language_id")
def languages(spark, read):
    docs = read("documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predicted(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous"
    )


NEAREST_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op10_top_k", NEAREST_SQL)
def nearest(spark, read):
    return topk.top_k(read("embeddings"), F.col("vec_id") % 100 == 0)


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@query("op5_url_filter")
def urls(spark, read):
    pages = read("pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES, url_filter.labelled(spark)).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query("op6_warc")
def archives(spark, read):
    index = warc.write_archive(read("pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_mixing")
def mixture(spark, read):
    return mixing.mixed(read("documents")).select("doc_id", "source", "lang", "topic", "probability", "kept")


def _best(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edited(cost: int | str, letter: str, state: int) -> str:
    """Cost and letters of the edits from a row on that begin with ``letter`` and go on from ``state``."""
    return f"{{'c': v[{state + 1}].c + {cost}, 'a': '{letter}' || v[{state + 1}].a}}"


def _inserting(state: int) -> str:
    """The best edits from a state, up to two rows being inserted first."""
    own, one = f"b[{state + 1}]", conversations.NEXT[state]
    two = conversations.NEXT[one]
    return _best(own, f"{{'c': b[{one + 1}].c + 5, 'a': 'I' || b[{one + 1}].a}}", f"{{'c': b[{two + 1}].c + 10, 'a': 'II' || b[{two + 1}].a}}")


def _repair_sql() -> str:
    """The repair as a recursion from each conversation's last row: the four best (cost, letters) per row."""
    consumed = []
    for state in conversations.STATES:
        keeps = [
            f"CASE WHEN fault < 2 AND i = '{i}' THEN {_edited('5 * fault', 'K', to[state])} END"
            for i, to in conversations.KEPT.items() if state in to
        ]
        rerole = f"CASE WHEN fault < 2 THEN {_edited('1 + 5 * fault', 'R', conversations.NEXT[state])} END"
        consumed.append(f"list_min(list_filter([{', '.join([_edited(2, 'D', state), *keeps, rerole])}], lambda x: x IS NOT NULL))")
    closed = ", ".join(_inserting(s) for s in conversations.STATES)
    return rf"""
WITH RECURSIVE faults AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT rid, 0 AS i, CAST(4294967295 AS BIGINT) AS c, key FROM faults
  UNION ALL
  SELECT rid, i + 1, list_reduce([xor(c, CAST(ascii(key[i + 1]) AS BIGINT)), 1, 1, 1, 1, 1, 1, 1, 1],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), key
  FROM crc WHERE i < strlen(key)),
hit AS (SELECT rid, xor(c, 4294967295) % 20 AS f FROM crc WHERE i = strlen(key)),
damaged AS (
  SELECT rid, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM faults JOIN hit USING (rid)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS nth,
    left(role, 1) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN t = '' THEN 3 WHEN nth > 1 THEN 2 WHEN right(t, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS pos, {_inserts_at_end()} AS v FROM facts
  UNION ALL
  SELECT conv_id, pos - 1, [{closed}]
  FROM (SELECT j.conv_id, j.pos, [{', '.join(consumed)}] AS b FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos)),
found AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM walk WHERE pos = 0),
edits AS (
  SELECT conv_id, unnest(range(1, 1 + length(audit))) AS k, audit FROM found),
steps AS (
  SELECT conv_id, k, audit[k] AS e,
    count(*) FILTER (audit[k] <> 'I') OVER before AS pos, count(*) FILTER (audit[k] <> 'D') OVER before AS place,
    count(*) FILTER (audit[k] <> 'D') OVER (PARTITION BY conv_id) AS kept
  FROM edits WINDOW before AS (PARTITION BY conv_id ORDER BY k)),
lines AS (
  -- The last row kept is an assistant's, so the distance from it tells whose turn it is.
  SELECT s.conv_id, s.place, CASE WHEN s.e = 'K' THEN j.role WHEN (s.kept - s.place) % 2 = 0 THEN 'assistant' ELSE 'user' END
    || ':' || CASE WHEN s.e = 'I' THEN '' ELSE j.text END AS line
  FROM steps s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.pos = s.pos WHERE s.e <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS repaired FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _inserts_at_end() -> str:
    """The four states behind the last row: nothing to do, or one or two inserts."""
    return "[{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}]"


@query("op11_conversation_repair", _repair_sql())
def conversations_repaired(spark, read):
    return conversations.repaired(conversations.damaged(read("conversations")))


@query("op12_whitening")
def white(spark, read):
    return whitening.whitening(read("embeddings"))


@query("op13_token_counts")
def token_lengths(spark, read):
    return token_counts.counts(read("documents"), public_tokenizers.path("word_bpe_49k.json"))
