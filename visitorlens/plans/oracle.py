"""The registered queries as SQL for a second engine, over the same tables.

Written from the rules, not from the Spark plans: windows and joins where the
operators use array functions, so that an error on one side shows.
"""

from __future__ import annotations

from visitorlens.functions.html import INTERSTITIAL_PHRASES, INTERSTITIAL_URL_PARTS
from visitorlens.functions.text import ENGLISH_STOP_WORDS, WHITESPACE
from visitorlens.operators.topics import ARCHITECTURE_SEEDS, UX_SEEDS
from visitorlens.plans.fixtures import (
    AS_OF,
    BOOSTERS,
    CUTOFF,
    KEYWORDS,
    LETTERS,
    LEXICON,
    NEGATIONS,
    PROGRESS_TARGET,
    REVIEWS_SQL,
    TARGET_CAP,
    TEXTS_SQL,
)
from visitorlens.plans.queries import N_PASSES

ORACLE: dict[str, str] = {}

# Fixed values of the rules, written out here once more: date labels and word marks.
RELATIVE = r"^(an?|[0-9]+)\s+(day|week|month|year)s?\s+ago$"
MONTH_DAY_YEAR = r"^([a-z]+)\s+([0-9]{1,2}),\s*([0-9]{4})$"
DAY_MONTH_YEAR = r"^([0-9]{1,2})\s+([a-z]+)\s+([0-9]{4})$"
MONTH_YEAR = r"^([a-z]+)\s+([0-9]{4})$"
SLASHED = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WORD_MARKS = ["?!?!", "!?!?", "!!!", "???", "?!?", "!?!", "!!", "??", *".!?,;:'\"-"]


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {q(WHITESPACE)})"


def mojibake(x: str) -> str:
    return f"replace(replace(replace({x}, '‚Ä¶', '…'), 'â€¦', '…'), 'Â', '')"


R = f"r AS ({REVIEWS_SQL.format(documents='documents')})"
WHOLE = f"r AS ({TEXTS_SQL.format(documents='documents')})"
DAY = f"DATE '{AS_OF}'"


def date_of(t: str) -> str:
    """Date meant by the stripped, lower-cased label ``t``."""

    def g(pattern: str, group: int) -> str:
        return f"regexp_extract({t}, {q(pattern)}, {group})"

    def month(pattern: str, group: int) -> str:
        listed = "[" + ", ".join(map(q, MONTHS)) + "]"
        found = f"nullif(list_position({listed}, left({g(pattern, group)}, 3)), 0)"
        return f"lpad(CAST({found} AS VARCHAR), 2, '0')"

    def day(pattern: str, group: int) -> str:
        return f"lpad({g(pattern, group)}, 2, '0')"

    def made(y: str, m: str, d: str) -> str:
        return f"TRY_CAST({y} || '-' || {m} || '-' || {d} AS DATE)"

    n = f"CASE WHEN {g(RELATIVE, 1)} IN ('a', 'an') THEN 1 ELSE TRY_CAST({g(RELATIVE, 1)} AS INT) END"
    return f"""CASE
      WHEN {t} = '' THEN NULL
      WHEN {t} = 'today' THEN {DAY}
      WHEN {t} = 'yesterday' THEN {DAY} - 1
      WHEN regexp_matches({t}, {q(RELATIVE)}) THEN
        CASE {g(RELATIVE, 2)}
          WHEN 'day' THEN {DAY} - ({n})
          WHEN 'week' THEN {DAY} - 7 * ({n})
          WHEN 'month' THEN CAST({DAY} - to_months(({n})) AS DATE)
          ELSE CAST({DAY} - to_months(12 * ({n})) AS DATE) END
      WHEN regexp_matches({t}, {q(MONTH_DAY_YEAR)})
        THEN {made(g(MONTH_DAY_YEAR, 3), month(MONTH_DAY_YEAR, 1), day(MONTH_DAY_YEAR, 2))}
      WHEN regexp_matches({t}, {q(DAY_MONTH_YEAR)})
        THEN {made(g(DAY_MONTH_YEAR, 3), month(DAY_MONTH_YEAR, 2), day(DAY_MONTH_YEAR, 1))}
      WHEN regexp_matches({t}, {q(MONTH_YEAR)})
        THEN {made(g(MONTH_YEAR, 2), month(MONTH_YEAR, 1), "'01'")}
      WHEN regexp_matches({t}, {q(SLASHED)})
        THEN {made(g(SLASHED, 3), day(SLASHED, 1), day(SLASHED, 2))}
    END"""


def iso_of(raw: str) -> str:
    return f"coalesce(CAST({date_of('lower(' + strip(raw) + ')')} AS VARCHAR), {strip(raw)})"


ISO_DATE = (
    "CASE WHEN regexp_full_match(review_date, '\\d{4}-\\d{2}-\\d{2}') "
    "THEN TRY_CAST(review_date AS DATE) END"
)
TOTAL = "replace(regexp_extract(contributor_blob, '(?i)(\\d[\\d,]*)\\s+reviews?', 1), ',', '')"
KEY = """CASE WHEN coalesce(review_id, '') <> '' THEN 'id:' || review_id ELSE 'fb:' || sha256(
    length({a}) || ':' || {a} || length({r}) || ':' || {r} || length({d}) || ':' || {d}
    || length({t}) || ':' || {t}) END""".format(
    a=strip("reviewer_name"),
    r=strip("rating"),
    d=strip("review_date"),
    t="substring(coalesce(review_text, ''), 1, 80)",
)

NORMALIZED = f"""{R},
n0 AS (
  SELECT ingest_seq, venue, lang,
    nullif({strip("review_id")}, '') AS review_id,
    nullif({mojibake(strip("reviewer_name"))}, '') AS reviewer_name,
    TRY_CAST({TOTAL} AS INT) AS reviewer_total_reviews,
    regexp_matches(contributor_blob, '(?i)local guide') AS is_local_guide,
    nullif({strip("rating")}, '') AS rating,
    {mojibake(strip("raw_date"))} AS label,
    nullif({mojibake(strip("review_text"))}, '') AS review_text
  FROM r),
n1 AS (SELECT *, nullif({iso_of("label")}, '') AS review_date FROM n0),
n AS (SELECT *, {ISO_DATE} AS review_dt, {KEY} AS review_key FROM n1)"""
HAS_CONTENT = "(reviewer_name IS NOT NULL OR review_text IS NOT NULL)"
IN_RANGE = f"(review_dt IS NULL OR review_dt >= DATE '{CUTOFF}')"
STORED = f"{NORMALIZED}, stored AS (SELECT * FROM n WHERE ingest_seq IN (SELECT doc_id FROM labels))"
FRESH = f"""{STORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY review_key ORDER BY ingest_seq) AS rn
  FROM n WHERE {HAS_CONTENT} AND {IN_RANGE}),
fresh AS (SELECT * FROM ranked
  WHERE rn = 1 AND review_key NOT IN (SELECT review_key FROM stored))"""

# Keywords

# One constant pattern per keyword; dynamic patterns would be compiled for every row.
_HITS = ", ".join(
    f"CASE WHEN regexp_matches(lower(review_text), {q('(^|[^' + w + '])' + kw + '($|[^' + w + '])')}) "
    f"THEN {q(kw)} END"
    for w in ("\\p{L}\\p{N}_",)
    for kw in KEYWORDS
)


def mentions(source: str) -> str:
    return (
        f"hits AS (SELECT *, unnest([{_HITS}]) AS keyword FROM {source}), "
        "m AS (SELECT * FROM hits WHERE keyword IS NOT NULL)"
    )


STANDARD = f"lower({strip('rating')})"
STAR_COLUMNS = ", ".join(
    f"coalesce(count(*) FILTER (WHERE rating = '{r}'), 0) AS \"{r}\""
    for r in ("1 star", "2 stars", "3 stars", "4 stars", "5 stars")
)


ORACLE["keyword_mentions"] = f"""WITH {WHOLE}, {mentions("r")}
SELECT keyword, {STANDARD} AS rating, count(*) AS n FROM m GROUP BY ALL"""

_REPORT = f"""s AS (SELECT keyword, venue, {STANDARD} AS rating FROM m)"""
ORACLE["keyword_by_rating"] = f"""WITH {WHOLE}, {mentions("r")}, {_REPORT}
SELECT k.kw AS keyword, {STAR_COLUMNS}
FROM {values([(k,) for k in KEYWORDS])} k(kw) LEFT JOIN s ON s.keyword = k.kw GROUP BY k.kw"""
ORACLE["keyword_by_venue"] = f"""WITH {WHOLE}, {mentions("r")}, {_REPORT}
SELECT v.venue AS venue, k.kw AS keyword, {STAR_COLUMNS}
FROM (SELECT DISTINCT venue FROM r) v CROSS JOIN {values([(k,) for k in KEYWORDS])} k(kw)
LEFT JOIN s ON s.keyword = k.kw AND s.venue IS NOT DISTINCT FROM v.venue GROUP BY v.venue, k.kw"""
ORACLE["keyword_by_month"] = f"""WITH {WHOLE},
n0 AS (SELECT *, {iso_of("raw_date")} AS review_date FROM r),
n AS (SELECT *, {ISO_DATE} AS review_dt FROM n0), {mentions("n")}
SELECT CAST(CAST(date_trunc('month', review_dt) AS DATE) AS VARCHAR) AS month, keyword,
  count(*) AS n FROM m GROUP BY ALL"""
ORACLE["keyword_table_mentions"] = f"""WITH {WHOLE},
k AS (SELECT DISTINCT unnest(string_split_regex(
    lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[ .,]+')) AS keyword FROM pages),
plain AS (SELECT keyword FROM k WHERE regexp_full_match(keyword, '[\\p{{L}}\\p{{N}}_]+')),
t AS (SELECT DISTINCT ingest_seq, {STANDARD} AS rating,
    unnest(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM r),
oddk AS MATERIALIZED (SELECT keyword, CASE WHEN regexp_matches(keyword, '^[\\p{{L}}\\p{{N}}_]')
      THEN '(^|[^\\p{{L}}\\p{{N}}_])' ELSE '[\\p{{L}}\\p{{N}}_]' END || regexp_escape(keyword)
    || CASE WHEN regexp_matches(keyword, '[\\p{{L}}\\p{{N}}_]$') THEN '($|[^\\p{{L}}\\p{{N}}_])'
      ELSE '[\\p{{L}}\\p{{N}}_]' END AS pattern
  FROM k WHERE keyword <> '' AND NOT regexp_full_match(keyword, '[\\p{{L}}\\p{{N}}_]+')),
maybe AS MATERIALIZED (SELECT ingest_seq, {STANDARD} AS rating, lower(review_text) AS t, keyword, pattern
  FROM r JOIN oddk ON contains(lower(review_text), keyword)),
odd AS (SELECT ingest_seq, rating, keyword FROM maybe WHERE regexp_matches(t, pattern)),
found AS (SELECT ingest_seq, rating, keyword FROM t JOIN plain USING (keyword)
  UNION ALL SELECT ingest_seq, rating, keyword FROM odd)
SELECT keyword, rating, count(*) AS n FROM found GROUP BY ALL"""

ORACLE["keyword_table_phrases"] = f"""WITH {WHOLE},
k AS (SELECT DISTINCT lower(regexp_extract(html, '<title>([\\p{{L}}\\p{{N}}_]+ [\\p{{L}}\\p{{N}}_]+)', 1))
    AS keyword FROM pages),
maybe AS MATERIALIZED (SELECT {STANDARD} AS rating, lower(review_text) AS t, keyword
  FROM r JOIN k ON keyword <> '' AND contains(lower(review_text), keyword))
SELECT keyword, rating, count(*) AS n FROM maybe
WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || keyword || '($|[^\\p{{L}}\\p{{N}}_])')
GROUP BY ALL"""

# Scalars and the review table

ORACLE["fix_mojibake"] = f"""WITH {R}
SELECT ingest_seq, {mojibake("review_text")} AS fixed FROM r"""
ORACLE["clean_text"] = f"""WITH {WHOLE} SELECT ingest_seq,
  trim(regexp_replace(regexp_replace(lower(coalesce(review_text, '')), '[^a-z\\s]', ' ', 'g'),
    '\\s+', ' ', 'g')) AS cleaned FROM r"""
ORACLE["normalize_dates"] = f"""WITH {R},
d AS (SELECT ingest_seq, raw_date, {iso_of("raw_date")} AS review_date FROM r)
SELECT *, CAST({ISO_DATE} AS VARCHAR) AS review_dt FROM d"""
ORACLE["shift_dates"] = """
SELECT o_orderkey,
  CAST(CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 50 - 25 AS INT)) AS DATE)
    AS VARCHAR) AS by_months,
  CAST(CAST(CAST(o_orderdate AS DATE) + to_months(CAST(12 * (o_orderkey % 50 - 25) AS INT))
    AS DATE) AS VARCHAR) AS by_years
FROM orders"""
ORACLE["venue_slug"] = f"""WITH names AS (SELECT DISTINCT upper(left(source, 1)) || substring(source, 2)
    || ', ' || upper(left(lang, 1)) || substring(lang, 2) || ' – Théâtre & Co. ' AS name
  FROM documents)
SELECT name,
  replace({strip("regexp_replace(name, '[^\\p{L}\\p{N} _-]', '', 'g')")}, ' ', '_') AS directory,
  regexp_replace(replace(lower(name), ' ', '_'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS file
FROM names"""
ORACLE["contributor_meta"] = f"""WITH {R} SELECT ingest_seq,
  regexp_matches(contributor_blob, '(?i)local guide') AS is_local_guide,
  {TOTAL} AS total_reviews FROM r"""
ORACLE["normalize_reviews"] = f"""WITH {NORMALIZED}
SELECT ingest_seq, venue, lang, review_id, reviewer_name,
  CAST(reviewer_total_reviews AS VARCHAR) AS reviewer_total_reviews, is_local_guide, rating,
  review_date, review_text FROM n WHERE {HAS_CONTENT}"""
ORACLE["review_keys"] = f"WITH {NORMALIZED} SELECT ingest_seq, review_key FROM n"
ORACLE["seen_keys"] = f"WITH {NORMALIZED} SELECT DISTINCT review_key FROM n"
ORACLE["cutoff_filter"] = f"""WITH {NORMALIZED}
SELECT ingest_seq, review_date FROM n WHERE {IN_RANGE}"""
ORACLE["dedup_first_seen"] = f"""WITH {NORMALIZED}, k AS (SELECT *, row_number()
    OVER (PARTITION BY review_key ORDER BY ingest_seq) AS rn FROM n)
SELECT review_key, ingest_seq, venue, rating FROM k WHERE rn = 1"""
ORACLE["dedup_longest_text"] = f"""WITH {NORMALIZED}, k AS (SELECT *, row_number() OVER (
    PARTITION BY review_key ORDER BY length(coalesce(review_text, '')) DESC, ingest_seq) AS rn
  FROM n)
SELECT review_key, ingest_seq, CAST(length(review_text) AS VARCHAR) AS n_text FROM k WHERE rn = 1"""
ORACLE["incremental_new_rows"] = f"WITH {FRESH} SELECT ingest_seq, review_key, review_date FROM fresh"
ORACLE["union_stored_new"] = f"""WITH {FRESH}, u AS (
  SELECT venue, ingest_seq FROM stored UNION ALL SELECT venue, ingest_seq FROM fresh)
SELECT venue, count(*) AS n_rows, CAST(sum(ingest_seq) AS BIGINT) AS seq_sum FROM u GROUP BY venue"""
_CUT = f"(ends_with({strip('review_text')}, '...') OR ends_with({strip('review_text')}, '…'))"
ORACLE["text_quality_counts"] = f"""WITH {NORMALIZED}
SELECT venue, count(*) AS n_rows,
  count(*) FILTER (WHERE review_text IS NULL) AS n_empty_text,
  count(*) FILTER (WHERE review_text IS NOT NULL) AS n_with_text,
  count(*) FILTER (WHERE {_CUT}) AS n_truncated,
  count(*) FILTER (WHERE review_dt IS NULL) AS n_unparsed_date,
  count(*) FILTER (WHERE NOT regexp_full_match(lower(rating), '1 star|[2-5] stars'))
    AS n_unbucketed_rating,
  round(avg(TRY_CAST(regexp_extract(lower(rating), '^([1-5]) stars?$', 1) AS INT)), 6) AS avg_stars
FROM n GROUP BY venue"""
ORACLE["sample_gate"] = f"""WITH {NORMALIZED}, s AS (SELECT *, row_number()
    OVER (PARTITION BY venue ORDER BY ingest_seq) AS rn FROM n),
g AS (SELECT venue, count(*) AS n_sample,
    count(*) FILTER (WHERE review_text IS NOT NULL) AS n_nonempty FROM s WHERE rn <= 20 GROUP BY venue)
SELECT *, NOT (n_sample >= 20 AND n_nonempty < 3) AS passed FROM g"""
ORACLE["target_cap"] = f"""WITH {STORED},
have AS (SELECT venue, count(*) AS n_stored FROM stored GROUP BY venue),
s AS (SELECT n.venue, n.ingest_seq, row_number() OVER (PARTITION BY n.venue ORDER BY n.ingest_seq)
    + coalesce(have.n_stored, 0) AS place FROM n LEFT JOIN have ON have.venue IS NOT DISTINCT FROM n.venue)
SELECT venue, ingest_seq FROM s WHERE place <= {TARGET_CAP}"""

# Terms

STOPS = values([(w,) for w in sorted(ENGLISH_STOP_WORDS)])
TOKENS = f"""{WHOLE},
stops AS (SELECT w FROM {STOPS} s(w)),
lists AS (SELECT ingest_seq, coalesce(venue, '(null)') AS venue,
    regexp_extract_all(lower(coalesce(review_text, '')), '[a-z]+') AS l FROM r),
tok AS (SELECT ingest_seq, venue, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM lists)"""
GRAMS = f"""{TOKENS},
kept AS (SELECT * FROM tok WHERE length(w) >= 2 AND w NOT IN (SELECT w FROM stops)),
pairs AS (SELECT ingest_seq, venue, w,
    lead(w) OVER (PARTITION BY ingest_seq ORDER BY pos) AS next FROM kept),
grams AS (SELECT ingest_seq, venue, w AS term, 1 AS size FROM pairs
  UNION ALL SELECT ingest_seq, venue, w || ' ' || next, 2 FROM pairs WHERE next IS NOT NULL)"""


def tfidf(by: str) -> str:
    """TF-IDF ranking, over everything or per ``venue``."""
    comma = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"({comma}term)"
    totals = (
        f"SELECT coalesce({by}, '(null)') AS {by}, count(*) AS total FROM r GROUP BY ALL"
        if by
        else "SELECT count(*) AS total FROM r"
    )
    with_total = f"JOIN totals USING ({by})" if by else "CROSS JOIN totals"
    return f"""WITH {GRAMS},
counts AS (SELECT {comma}term, count(*) AS n, count(DISTINCT ingest_seq) AS df FROM grams GROUP BY ALL),
vocab AS (SELECT * FROM counts
  QUALIFY row_number() OVER ({part}ORDER BY n DESC, term) <= 50),
totals AS ({totals}),
idf AS (SELECT {comma}term, ln((1 + total) / (1 + df)) + 1 AS idf FROM vocab {with_total}),
tf AS (SELECT {comma}ingest_seq, term, count(*) AS tf FROM grams JOIN vocab USING {using} GROUP BY ALL),
w AS (SELECT {comma}ingest_seq, term, tf * idf AS w FROM tf JOIN idf USING {using}),
norm AS (SELECT ingest_seq, sqrt(sum(w * w)) AS norm FROM w GROUP BY ingest_seq),
score AS (SELECT {comma}term, sum(w / norm) AS score FROM w JOIN norm USING (ingest_seq) GROUP BY ALL)
SELECT {f"nullif({by}, '(null)') AS {by}, " if by else ""}term, round(score, 6) AS score FROM score
QUALIFY row_number() OVER ({part}ORDER BY score DESC, term) <= 20"""


_COUNTED = "SELECT term, count(*) AS n, count(DISTINCT ingest_seq) AS n_docs FROM grams {where} GROUP BY term"
ORACLE["tokenize_counts"] = f"WITH {TOKENS} SELECT w AS term, count(*) AS n FROM tok GROUP BY w"
ORACLE["term_doc_frequency"] = f"WITH {GRAMS} {_COUNTED.format(where='')}"
ORACLE["top_terms_by_count"] = f"""WITH {GRAMS}, c AS ({_COUNTED.format(where='')})
SELECT * FROM c ORDER BY n DESC, term LIMIT 50"""
ORACLE["top_bigrams"] = f"""WITH {GRAMS}, c AS ({_COUNTED.format(where='WHERE size = 2')})
SELECT * FROM c ORDER BY n DESC, term LIMIT 20"""
ORACLE["tfidf_top_terms"] = tfidf("")
ORACLE["tfidf_by_venue"] = tfidf("venue")


# Phrases


def rake(by: str) -> str:
    comma = f"{by}, " if by else ""
    return f"""{TOKENS},
marked AS (SELECT *, w IN (SELECT w FROM stops) AS is_stop FROM tok),
islands AS (SELECT *, sum(CASE WHEN is_stop THEN 1 ELSE 0 END)
    OVER (PARTITION BY ingest_seq ORDER BY pos) AS island FROM marked),
occ AS (SELECT ingest_seq, venue, island, string_agg(w, ' ' ORDER BY pos) AS phrase,
    count(*) AS len FROM islands WHERE NOT is_stop GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4),
phrases AS (SELECT {comma}phrase, count(*) AS n FROM occ GROUP BY ALL),
words AS (SELECT {comma}phrase, len, unnest(string_split(phrase, ' ')) AS word FROM occ),
stats AS (SELECT {comma}word, count(*) AS freq, CAST(sum(len) AS BIGINT) AS degree,
    sum(len) / count(*) AS score FROM words GROUP BY ALL),
parts AS (SELECT {comma}phrase, n, unnest(string_split(phrase, ' ')) AS word FROM phrases),
ranked AS (SELECT {comma}phrase, n, sum(score) AS rake
  FROM parts JOIN stats USING ({comma}word) GROUP BY ALL)"""


ORACLE["phrase_frequency"] = f"""WITH {rake("")}
SELECT phrase, n, round(n / (SELECT max(n) FROM phrases), 6) AS freq FROM phrases"""
ORACLE["rake_word_scores"] = f"""WITH {rake("")}
SELECT word, freq, degree, round(score, 6) AS score FROM stats"""
ORACLE["rake_phrases"] = f"WITH {rake('')} SELECT phrase, n, round(rake, 6) AS rake FROM ranked"
ORACLE["rake_ranked_with_repeats"] = f"""WITH {rake("")}
SELECT occ.phrase, round(rake, 6) AS rake FROM occ JOIN ranked USING (phrase)"""
ORACLE["rake_by_venue"] = f"""WITH {rake("venue")}
SELECT nullif(venue, '(null)') AS venue, phrase, n, round(rake, 6) AS rake FROM ranked"""

# Topics

SIMILAR = """seeds AS (SELECT CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS topic,
    CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS s FROM embeddings GROUP BY label),
items AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sim AS (SELECT item_id, label, topic, max(list_cosine_similarity(e, s)) AS similarity
  FROM items, seeds GROUP BY ALL)"""
ASSIGNED = f"""{SIMILAR},
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
freq AS (SELECT label, n / (SELECT max(n) FROM sizes) AS freq FROM sizes),
sc AS (SELECT item_id, topic, 0.7 * similarity + 0.3 * freq AS score FROM sim JOIN freq USING (label)),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, topic) = 1),
assigned AS (SELECT * FROM best WHERE score >= 0.35)"""
ORACLE["seed_similarity"] = f"""WITH {SIMILAR}
SELECT item_id, topic, round(similarity, 6) AS similarity FROM sim"""
ORACLE["topic_items"] = f"""WITH {ASSIGNED}
SELECT item_id, topic, round(score, 6) AS score FROM assigned"""
ORACLE["topic_top_items"] = f"""WITH {ASSIGNED}, t AS (SELECT topic, row_number()
    OVER (PARTITION BY topic ORDER BY score DESC, item_id DESC) AS rank, item_id, score FROM assigned)
SELECT topic, rank, item_id, round(score, 6) AS score FROM t WHERE rank <= 10"""

_LETTERS = ", ".join(
    f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in LETTERS
)
_SEEDS = values([(t, s) for t, words in (("ux", UX_SEEDS), ("architecture", ARCHITECTURE_SEEDS)) for s in words])
ORACLE["phrase_topic_letters"] = f"""WITH {rake("")},
seeds AS MATERIALIZED (SELECT topic, [{_LETTERS.format("seed")}] AS s FROM {_SEEDS} x(topic, seed)),
found AS MATERIALIZED (SELECT phrase, n, n / (SELECT max(n) FROM ranked) AS freq,
    [{_LETTERS.format("phrase")}] AS e FROM ranked),
sim AS (SELECT phrase, n, freq, topic, max(list_cosine_similarity(e, s)) AS similarity
  FROM found, seeds GROUP BY ALL),
sc AS (SELECT *, 0.7 * similarity + 0.3 * freq AS score FROM sim),
best AS (SELECT * FROM sc QUALIFY row_number()
    OVER (PARTITION BY phrase ORDER BY score DESC, topic DESC) = 1)
SELECT phrase, topic, n, round(score, 6) AS score FROM best WHERE score >= 0.35"""



def trigrams(source: str, text: str, keys: str) -> str:
    """Counts of a text's character trigrams by place, for texts that are not empty."""
    char = "unicode(substr(' ' || lower({t}) || ' ', CAST(i + {k} AS INT), 1))"
    code = " + ".join(f"{char.format(t=text, k=k)} * {m}" for k, m in enumerate((961, 31, 1)))
    return f"""SELECT {keys}, ({code}) % 512 AS place, count(*) AS c
  FROM {source}, range(1, length({text}) + 1) AS r(i) GROUP BY ALL"""


ORACLE["phrase_topic_hashed"] = f"""WITH {rake("")},
seeds AS (SELECT * FROM {_SEEDS} x(topic, seed)),
sg AS MATERIALIZED ({trigrams("seeds", "seed", "topic, seed")}),
pg AS MATERIALIZED ({trigrams("ranked", "phrase", "phrase")}),
sn AS (SELECT topic, seed, sqrt(sum(c * c)) AS norm FROM sg GROUP BY ALL),
pn AS (SELECT phrase, sqrt(sum(c * c)) AS norm FROM pg GROUP BY ALL),
dots AS (SELECT phrase, topic, seed, sum(pg.c * sg.c) AS dot FROM pg JOIN sg USING (place) GROUP BY ALL),
sim AS (SELECT phrase, topic, max(dot / (pn.norm * sn.norm)) AS similarity
  FROM dots JOIN pn USING (phrase) JOIN sn USING (topic, seed) GROUP BY ALL),
found AS (SELECT phrase, n, rake, n / (SELECT max(n) FROM ranked) AS freq FROM ranked),
sc AS (SELECT phrase, n, rake, topic, 0.7 * coalesce(similarity, 0) + 0.3 * freq AS score
  FROM found CROSS JOIN (VALUES ('ux'), ('architecture')) AS t(topic) LEFT JOIN sim USING (phrase, topic)),
best AS (SELECT * FROM sc QUALIFY row_number()
    OVER (PARTITION BY phrase ORDER BY score DESC, topic DESC) = 1),
placed AS (SELECT topic, row_number() OVER (PARTITION BY topic
    ORDER BY round(score, 9) DESC, rake DESC, phrase DESC) AS rank, phrase, n, score
  FROM best WHERE score >= 0.35)
SELECT topic, rank, phrase, n, round(score, 6) AS score FROM placed WHERE rank <= 10"""

# Sentiment


def without_mark(word: str) -> str:
    """A word of two plain characters or more without one known mark before or behind it."""
    marks = "[" + ", ".join(map(q, WORD_MARKS)) + "]"
    front, behind = "'^[[:punct:]]+'", "'[[:punct:]]+$'"
    return f"""CASE
      WHEN regexp_full_match({word}, '[[:punct:]]+[^[:punct:]]{{2,}}')
        AND list_contains({marks}, regexp_extract({word}, {front})) THEN regexp_replace({word}, {front}, '')
      WHEN regexp_full_match({word}, '[^[:punct:]]{{2,}}[[:punct:]]+')
        AND list_contains({marks}, regexp_extract({word}, {behind})) THEN regexp_replace({word}, {behind}, '')
      ELSE {word} END"""


def sentiment(source: str, key: str, text: str) -> str:
    """CTE ``scored(key columns, compound)`` for a table with unique ``key``."""
    boosters = values(sorted(BOOSTERS.items()))
    negations = ", ".join(map(q, NEGATIONS))

    def upper(w: str) -> str:
        return f"(upper({w}) = {w} AND lower({w}) <> {w})"

    def emphasis(v: str, w: str) -> str:
        return (
            f"CASE WHEN mixed AND {upper(w)} THEN CASE WHEN {v} > 0 THEN 0.733 ELSE -0.733 END "
            "ELSE 0 END"
        )

    def step(i: int, special: str, damping: float, so_factor: float) -> str:
        w, v = f"p{i}", f"s{i - 1}"
        boost = (
            f"coalesce((CASE WHEN {v} < 0 THEN -b{i} ELSE b{i} END + {emphasis(v, w)}) * {damping}, 0)"
        )
        negated = f"(lower({w}) IN ({negations}) OR contains(lower({w}), 'n''t'))"
        factor = (
            f"CASE WHEN {special} THEN {so_factor} WHEN {negated} THEN -0.74 ELSE 1 END"
        )
        return (
            f"c{i} AS (SELECT *, CASE WHEN {w} IS NOT NULL AND v{i} IS NULL "
            f"THEN ({v} + {boost}) * {factor} ELSE {v} END AS s{i} FROM c{i - 1})"
        )

    so = "coalesce({} IN ('so', 'this'), false)"
    never2 = f"(p2 = 'never' AND {so.format('p1')})"
    never3 = f"((p3 = 'never' AND {so.format('p2')}) OR {so.format('p1')})"
    doc = "PARTITION BY id ORDER BY pos"
    marks = f"(length(t) - length(replace(t, '{{}}', '')))"
    shouts, asks = marks.format("!"), marks.format("?")
    return f"""
docs AS (SELECT {key} AS id, coalesce({text}, '') AS t FROM {source}),
split AS (SELECT id, list_filter(string_split_regex({strip("t")}, '\\s+'), lambda x: length(x) > 1) AS l
  FROM docs),
lex AS (SELECT * FROM {values(sorted(LEXICON.items()))} x(term, valence)),
boost AS (SELECT * FROM {boosters} x(term, weight)),
w0 AS (SELECT id, generate_subscripts(l, 1) AS pos,
    unnest(list_transform(l, lambda x: {without_mark("x")})) AS w
  FROM split),
w1 AS (SELECT w0.*, CAST(valence AS DOUBLE) AS v, CAST(weight AS DOUBLE) AS b FROM w0
  LEFT JOIN lex ON lex.term = lower(w) LEFT JOIN boost ON boost.term = lower(w)),
w2 AS (SELECT *,
    lag(w, 1) OVER ({doc}) AS p1, lag(w, 2) OVER ({doc}) AS p2, lag(w, 3) OVER ({doc}) AS p3,
    lag(v, 1) OVER ({doc}) AS v1, lag(v, 2) OVER ({doc}) AS v2, lag(v, 3) OVER ({doc}) AS v3,
    lag(b, 1) OVER ({doc}) AS b1, lag(b, 2) OVER ({doc}) AS b2, lag(b, 3) OVER ({doc}) AS b3,
    lead(w) OVER ({doc}) AS nx,
    min(pos) OVER (PARTITION BY id, w) AS first_pos,
    count(*) FILTER (WHERE {upper("w")}) OVER (PARTITION BY id) AS n_upper,
    count(*) OVER (PARTITION BY id) AS n_words,
    min(pos) FILTER (WHERE lower(w) = 'but') OVER (PARTITION BY id) AS but_pos
  FROM w1),
firsts AS (SELECT *, n_upper > 0 AND n_upper < n_words AS mixed FROM w2
  WHERE v IS NOT NULL AND b IS NULL AND pos = first_pos
    AND NOT (lower(w) = 'kind' AND coalesce(lower(nx) = 'of', false))),
c0 AS (SELECT *, v + {emphasis("v", "w")} AS s0 FROM firsts),
{step(1, "false", 1.0, 1.0)},
{step(2, never2, 0.95, 1.5)},
{step(3, never3, 0.9, 1.25)},
word AS (SELECT id, w, s3 * CASE WHEN v1 IS NULL AND lower(p1) = 'least'
    AND NOT coalesce(lower(p2) IN ('at', 'very'), false) THEN -0.74 ELSE 1 END AS s FROM c3),
sums AS (SELECT id, sum(s * CASE WHEN but_pos IS NULL OR pos = but_pos THEN 1
    WHEN pos < but_pos THEN 0.5 ELSE 1.5 END) AS s FROM w2 JOIN word USING (id, w) GROUP BY id),
emph AS (SELECT docs.id, coalesce(s, 0) + sign(coalesce(s, 0)) * (least({shouts}, 4) * 0.292 + CASE
    WHEN {asks} > 3 THEN 0.96 WHEN {asks} > 1 THEN {asks} * 0.18 ELSE 0 END) AS s
  FROM docs LEFT JOIN sums ON sums.id = docs.id),
scored AS (SELECT id, round(s / sqrt(s * s + 15), 4) AS compound FROM emph),
labelled AS (SELECT id, CASE WHEN compound <= -0.05 THEN 'Negative'
    WHEN compound >= 0.05 THEN 'Positive' ELSE 'Neutral' END AS sentiment FROM scored)"""


SENTIMENT = f"WITH {WHOLE}, {sentiment('r', 'ingest_seq', 'review_text')}"
ORACLE["sentiment_scores"] = f"{SENTIMENT} SELECT id AS ingest_seq, compound FROM scored"
ORACLE["sentiment_labels"] = f"""{SENTIMENT}
SELECT ingest_seq, venue, rating, sentiment FROM r JOIN labelled ON id = ingest_seq"""
ORACLE["sentiment_counts"] = f"""{SENTIMENT}
SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment"""
ORACLE["sentiment_by_venue"] = f"""{SENTIMENT}
SELECT venue, sentiment, count(*) AS n FROM r JOIN labelled ON id = ingest_seq GROUP BY ALL"""
ORACLE["sentiment_conservation"] = f"""{SENTIMENT}
SELECT (SELECT count(*) FROM r) AS n_rows, count(sentiment) AS n_labelled,
  (SELECT count(*) FROM r) = count(sentiment) AS conserved FROM labelled"""
ORACLE["sentiment_conversations"] = f"""
WITH {sentiment("conversations", "conv_id * 100000 + turn", "text")}
SELECT conv_id, turn, role, sentiment FROM conversations
JOIN labelled ON id = conv_id * 100000 + turn"""

# Pages


def inner(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return strip(out)


ORACLE["page_cards"] = f"""WITH
bare AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)>', '', 'g')
    AS html FROM pages),
cut AS (SELECT page_id, CASE WHEN contains(html, '<p>') THEN string_split(html, '<p>')[2:]
    ELSE string_split(html, '<li>')[2:] END AS l, contains(html, '<p>') AS is_p FROM bare),
cards AS (SELECT page_id, is_p, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS card FROM cut),
texts AS (SELECT *, {inner("regexp_extract(card, '(?s)^(.*?)</p>', 1)")} AS body FROM cards)
SELECT page_id, CAST(pos AS INT) AS pos, '' AS id, '' AS author,
  CASE WHEN is_p THEN body ELSE '' END AS text, false AS is_local_guide,
  '' AS reviewer_total_reviews FROM texts"""
ORACLE["review_cards"] = f"""WITH
links AS (SELECT page_id, {inner("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS l FROM pages),
c AS (SELECT page_id, title, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS name FROM links)
SELECT page_id, CAST(pos AS INT) AS pos, page_id || '-' || pos AS id, {inner("name")} || ' of here' AS author,
  (pos % 5 + 1) || ' stars' AS rating, 'a year ago' AS date,
  CASE pos % 3 WHEN 0 THEN title WHEN 1 THEN title || ' by ' || {inner("name")} || ' and a tail'
    ELSE 'Late ' || title || ' end!' END AS text, true AS is_local_guide, CAST(pos + 2 AS VARCHAR) AS reviewer_total_reviews FROM c"""
ORACLE["page_longest_paragraph"] = f"""WITH
b AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p,
    regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS li FROM pages),
c AS (SELECT page_id, 1 AS kind, generate_subscripts(p, 1) AS pos, unnest(p) AS x FROM b
  UNION ALL SELECT page_id, 2, generate_subscripts(li, 1), unnest(li) FROM b),
t AS (SELECT page_id, kind, pos, {inner("x")} AS x FROM c),
best AS (SELECT * FROM t WHERE x <> '' AND (kind = 1 OR length(x) < 5000)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY kind, length(x) DESC, pos) = 1)
SELECT pages.page_id, coalesce(x, '') AS longest FROM pages LEFT JOIN best ON best.page_id = pages.page_id"""
ORACLE["page_interstitial_flag"] = f"""SELECT page_id,
  {" OR ".join(f"contains(lower(url), {q(p)})" for p in INTERSTITIAL_URL_PARTS)}
  OR {" OR ".join(f"contains(lower(html), {q(p)})" for p in INTERSTITIAL_PHRASES)} AS is_interstitial,
  contains(lower(url), 'contrib') AS is_profile FROM pages"""

# Progress


def passes(cutoff: str) -> str:
    in_range = f"(review_dt IS NULL OR review_dt >= DATE '{cutoff}')"
    return f"""{NORMALIZED},
p AS (SELECT *, CAST(floor(ingest_seq * {N_PASSES} / (SELECT max(doc_id) + 1 FROM documents)) AS BIGINT)
    AS batch FROM n),
seen AS (SELECT venue, batch, count(*) AS n_rows,
    count(DISTINCT CASE WHEN NOT {in_range} THEN review_key END) AS n_skipped_old,
    count(*) FILTER (WHERE review_text IS NULL) AS n_empty_text,
    count(*) FILTER (WHERE {_CUT}) AS n_truncated, min(review_dt) AS oldest_date
  FROM p GROUP BY venue, batch),
firsts AS (SELECT * FROM p WHERE {HAS_CONTENT} AND {in_range}
  QUALIFY row_number() OVER (PARTITION BY venue, review_key ORDER BY ingest_seq) = 1),
added AS (SELECT venue, batch, count(*) AS n_added FROM firsts GROUP BY venue, batch),
counters AS (SELECT seen.*, coalesce(n_added, 0) AS n_added FROM seen
  LEFT JOIN added ON added.venue IS NOT DISTINCT FROM seen.venue AND added.batch = seen.batch),
progress AS (SELECT *,
    CAST(sum(n_added) OVER (PARTITION BY venue ORDER BY batch) AS BIGINT) AS total_added,
    last_value(oldest_date IGNORE NULLS) OVER (PARTITION BY venue ORDER BY batch
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS oldest_seen FROM counters)"""


EVENT_PASSES = """e AS (SELECT event_type AS venue, user_id, date_trunc('hour', ts) AS batch, event_id
  FROM events),
seen AS (SELECT venue, batch, count(*) AS n_rows FROM e GROUP BY ALL),
firsts AS (SELECT venue, user_id, arg_min(batch, event_id) AS batch FROM e GROUP BY ALL),
added AS (SELECT venue, batch, count(*) AS n_added FROM firsts GROUP BY ALL),
counters AS (SELECT seen.venue, seen.batch, n_rows, coalesce(n_added, 0) AS n_added FROM seen
  LEFT JOIN added ON added.venue = seen.venue AND added.batch = seen.batch),
runs AS (SELECT *, sum(CASE WHEN n_added > 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY venue ORDER BY batch) AS run FROM counters),
streaks AS (SELECT venue, batch, n_rows, n_added, count(*) FILTER (WHERE n_added = 0)
    OVER (PARTITION BY venue, run ORDER BY batch) AS stagnant,
    CAST(sum(n_added) OVER (PARTITION BY venue ORDER BY batch) AS BIGINT) AS total_added,
    date_diff('second', min(batch) OVER (PARTITION BY venue), batch) AS elapsed FROM runs)"""
_STAMP = "strftime(batch, '%Y-%m-%d %H:%M:%S')"
ORACLE["batch_progress"] = f"""WITH {passes(CUTOFF)}
SELECT venue, batch, n_rows, n_skipped_old, n_empty_text, n_truncated, n_added, total_added,
  CAST(oldest_date AS VARCHAR) AS oldest_date, CAST(oldest_seen AS VARCHAR) AS oldest_seen FROM progress"""
ORACLE["progress_state"] = f"""WITH {passes(CUTOFF)},
last AS (SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY venue ORDER BY batch DESC) = 1)
SELECT venue, '{{"batch":' || batch || ',"n_added":' || n_added || ',"total_added":' || total_added
  || '}}' AS state FROM last"""
ORACLE["stagnation_streak"] = f"""WITH {EVENT_PASSES}
SELECT venue, {_STAMP} AS batch, n_rows, n_added, stagnant FROM streaks"""
_STOPS = {
    "target": f"WHEN total_added >= {PROGRESS_TARGET} THEN 'target' WHEN stagnant >= 35 THEN 'stagnant'",
    "stagnant": "WHEN stagnant >= 35 THEN 'stagnant'",
    "time": f"WHEN elapsed > 86400 THEN 'time' WHEN total_added >= {PROGRESS_TARGET} THEN 'target' "
    "WHEN stagnant >= 35 THEN 'stagnant'",
}
ORACLE["stop_reason"] = f"""WITH {EVENT_PASSES}, x AS (""" + " UNION ALL ".join(
    f"SELECT *, '{run}' AS run, CASE {rule} END AS stop_reason FROM streaks"
    for run, rule in _STOPS.items()
) + f"""), s AS (SELECT * FROM x WHERE stop_reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run, venue ORDER BY batch) = 1)
SELECT venue, {_STAMP} AS batch, total_added, stop_reason, run FROM s"""
ORACLE["stop_at_cutoff"] = f"""WITH {passes("2024-06-01")},
m AS (SELECT *, coalesce(oldest_seen < DATE '2024-06-01' AND n_added = 0, false) AS past,
    n_added = 0 AS idle FROM progress),
g AS (SELECT *, sum(CASE WHEN past THEN 0 ELSE 1 END) OVER (PARTITION BY venue ORDER BY batch) AS pr,
    sum(CASE WHEN idle THEN 0 ELSE 1 END) OVER (PARTITION BY venue ORDER BY batch) AS ir FROM m),
s AS (SELECT *, count(*) FILTER (WHERE past) OVER (PARTITION BY venue, pr ORDER BY batch) AS past_n,
    count(*) FILTER (WHERE idle) OVER (PARTITION BY venue, ir ORDER BY batch) AS idle_n FROM g),
x AS (SELECT *, CASE WHEN past_n >= 2 THEN 'cutoff' WHEN idle_n >= 35 THEN 'stagnant' END AS stop_reason
  FROM s)
SELECT venue, batch, total_added, stop_reason FROM x WHERE stop_reason IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY venue ORDER BY batch) = 1"""
