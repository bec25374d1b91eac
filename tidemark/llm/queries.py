"""The queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_tree, toxicity
from .chat_format import format_turns, json_turns, read_back, table_turns
from .codes import compress_vectors
from .collocations import collocations
from .common import table
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_classes
from .licenses import scan_licenses
from .media import media_features
from .mixing import mix_sources
from .pieces import sample_segmentations
from .url_filter import Rule, filter_urls
from .wrappers import extract_pages

#: The rules of op1.
URL_RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


#: Conversation -7 of op2, in the layout with a list of messages.
CONTROL_CONVERSATION = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
#: The vocabulary file of op5 and the pipeline, on every machine.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_turns(table(spark, sf_dir, "conversations"))
    record = spark.createDataFrame([(-7, CONTROL_CONVERSATION)], "conv_id long, record string")
    turns = rows.unionByName(json_turns(record, "conv_id", "record"))
    return read_back(format_turns(turns))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document repeated towards shares by the square root of each source's size, as many rows as the input is expected to have."""
    return mix_sources(table(spark, sf_dir, "documents"), power=0.5, seed=17)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), PIECES, k=2)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_chat_format": op2_chat_format,
        "op3_toxicity": op3_toxicity,
        "op4_mix_sources": op4_mix_sources,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_media": op7_media,
        "op8_licenses": op8_licenses,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_collocations": op11_collocations,
        "op12_vector_codes": op12_vector_codes,
        "op13_html_extraction": op13_html_extraction,
    }


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = ", ".join(f"('{r.action}', '{r.pattern}', '{r.host}', '{r.path}')" for r in URL_RULES)

OP1_SQL = f"""
WITH rules(action, rule, rhost, rpath) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS seq, page_id, translate(regexp_extract(r, '^[^/?#]*'), {_ABC}) AS host,
          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT seq, rule, action, row_number() OVER (PARTITION BY seq ORDER BY length(rule) DESC, length(rhost) DESC, rule DESC) AS k
        FROM parts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (seq)
"""

_COUNTS = "SELECT source, count(*) AS n, pow(count(*), 0.5) AS share FROM {docs} GROUP BY source"


def mix_sql(docs: str, seed: int = 17) -> str:
    """SQL for mix_sources over the relation docs, with shares by the square root and rates up to 16."""
    u = "(('0x' || substr(sha256('{s}:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT / 4503599627370496.0)".format(s=seed)
    return f"""
WITH RECURSIVE counts AS ({_COUNTS.format(docs=docs)}),
rates AS (SELECT source, share / sum(share) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM counts),
terms(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < 90),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM terms GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= {u})) AS times FROM {docs} d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       substr(sha256('{seed}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM (SELECT * EXCLUDE (times), unnest(range(1, times + 1)) AS copy FROM drawn)
"""


OP9_SQL = r"""
WITH n AS (SELECT doc_id, row_number() OVER () AS seq, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY doc_id NULLS LAST, seq)
"""


OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_ABC}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts, range(1, 4) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covered AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k)) AS i FROM cand WHERE k = 3) GROUP BY ALL),
left_ AS (SELECT b.* FROM best b LEFT JOIN covered c USING (lang, phrase) WHERE c.most IS NULL OR 100 * c.most < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM left_ JOIN n USING (lang) QUALIFY rank <= 2000
"""


def _codes_sql() -> str:
    """Vectors of 64 components in 16 parts, three assignments to 64 entries written out."""
    four = range(1, 5)
    cut = ", ".join(f"x[4 * part + {k}] AS x{k}" for k in four)
    near = " + ".join(f"(x{k} - c{k}) * (x{k} - c{k})" for k in four)
    mean = ", ".join(f"(sum(x{k}) - (sum(x{k}) % count(*) + count(*)) % count(*)) // count(*) AS c{k}" for k in four)
    now = ", ".join(f"coalesce(m.c{k}, b.c{k})::BIGINT AS c{k}" for k in four)
    steps = ", ".join(
        f"""a{r} AS (SELECT seq, part, min({{'d': {near}, 'entry': entry}}) AS best FROM cut JOIN b{r} USING (part) GROUP BY seq, part),
m{r} AS (SELECT part, best.entry AS entry, {mean} FROM cut JOIN a{r} USING (seq, part) GROUP BY part, best.entry),
b{r + 1} AS (SELECT part, entry, {now} FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"""
        for r in range(2)
    )
    return f"""
WITH v AS (SELECT row_number() OVER () AS seq, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT seq, part, {cut} FROM v, range(16) t(part)),
start AS (SELECT seq, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v QUALIFY entry < 64),
b0 AS (SELECT part, entry, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4 FROM cut JOIN start USING (seq)),
{steps},
a2 AS (SELECT seq, part, min({{'d': {near}, 'entry': entry}}) AS best FROM cut JOIN b2 USING (part) GROUP BY seq, part),
coded AS (SELECT seq, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY seq),
sha AS (SELECT sha256(string_agg(c1 || ',' || c2 || ',' || c3 || ',' || c4, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (seq), sha
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": OP11_SQL, "op12_vector_codes": _codes_sql(), "op1_url_filters": OP1_SQL, "op4_mix_sources": mix_sql("documents"), "op9_exact_dedup": OP9_SQL}
