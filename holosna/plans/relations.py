"""Queries over spans and lexicons as relations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.functions.structural import ENGLISH_WORD
from holosna.normal.lexicon import BRANDS, ENGLISH, LATIN_WORDS
from holosna.operators import relations
from holosna.operators.gating import spread, uncertain_rows
from holosna.plans.queries import _q, _t
from holosna.sources import lexicons, texts
from holosna.sources.shared import new_path

TAG, WORD = "<[^>]*>", "[A-Za-z0-9]+"


def ua_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents, by place and byte offsets."""
    return relations.exploded_matches(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", r"\p{L}+", "doc_id")


def ua_outer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole pages that lie in no tag."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "html")
    spans = lambda pattern: relations.exploded_matches(pages, "html", pattern, "page_id")
    return relations.without_inside(spans(WORD).drop("place"), spans(TAG), "page_id")


def ua_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, then brands, then English words: the first lexicon that has a word gives its reading."""
    words = _t(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    user = words.groupBy("word").agg(F.concat(F.lit("слово "), F.count("*").cast("string")).alias("reading"))
    known = lambda table: spark.createDataFrame(list(table.items()), "word string, reading string")
    return relations.by_rank("word", user, known(BRANDS), known(ENGLISH))


def ua_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, read with a vocabulary of all words of the benchmark."""
    words = F.explode(F.regexp_extract_all(relations.folded(F.col("text")), F.lit(ENGLISH_WORD), F.lit(0)))
    vocabulary = _t(spark, sf_dir, "benchmark").select(words.alias("word")).distinct().withColumn("reading", F.concat(F.lit("«"), "word", F.lit("»")))
    docs = spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return relations.with_readings(docs, "text", "spoken", vocabulary, ENGLISH_WORD, "doc_id").drop("text")


def ua_lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names, written as lexicon files and read back, with the letters of each by name."""
    words = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("latin")).groupBy(F.lower("latin").alias("latin")).agg(F.count("*").alias("n"))
    path = new_path(spark, "lexicon")
    texts.write(words.select("latin", F.concat(F.lit("слово "), F.col("n").cast("string")).alias("cyrillic")), path, "tsv")
    return lexicons.vocabulary(spark, f"{path}/*.csv")


def ua_uncertain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain spans of whole turns: those of Latin words alone by built-in functions, the rest by the kernel."""
    return uncertain_rows(_t(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


QUERIES = {f.__name__: f for f in (ua_uncertain_turns, ua_matches, ua_outer_spans, ua_lexicon, ua_vocabulary, ua_lexicon_files)}

# ---- SQL ---------------------------------------------------------------------------------------------------------


def _spans(table: str, key: str, text: str, pattern: str) -> str:
    """Matches with byte offsets: the pieces between them, and sums of what stands before."""
    return f"""SELECT {key}, place - 1 AS place, CAST(upto - strlen(match) AS BIGINT) AS start, CAST(upto AS BIGINT) AS stop, match FROM (
  SELECT *, sum(strlen(gap) + strlen(match)) OVER (PARTITION BY {key} ORDER BY place) AS upto FROM (
    SELECT {key}, generate_subscripts(found, 1) AS place, unnest(gaps[:len(found)]) AS gap, unnest(found) AS match FROM (
      SELECT {key}, regexp_split_to_array({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS found FROM {table})))"""


_ENTRIES = lambda table: ", ".join(f"({_q(k)}, {_q(v)})" for k, v in table.items())
_LATIN_WORD = r"\b[A-Za-z](?:[A-Za-z''’-]*[A-Za-z])?\b"
ORACLE_SQL = {
    "ua_matches": _spans("documents", "doc_id", "text", r"\p{L}+"),
    # turns hold Latin words, blanks, commas and full stops alone
    "ua_uncertain_turns": f"""
SELECT conv_id, turn, start, stop, match AS text, 'foreign word (transliteration is approximate)' AS reason, 'foreign_word' AS category, 'info' AS severity
FROM ({_spans("conversations", "conv_id, turn", "text", "[A-Za-z]+")}) WHERE NOT regexp_full_match(match, '[A-Z]{{2,6}}') AND lower(match) NOT IN ({", ".join(map(_q, LATIN_WORDS))})""",
    "ua_outer_spans": f"""
WITH w AS ({_spans("pages", "page_id", "html", WORD)}), t AS ({_spans("pages", "page_id", "html", TAG)})
SELECT page_id, start, stop, match FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = w.page_id AND t.start <= w.start AND w.stop <= t.stop)""",
    "ua_lexicon": f"""
WITH l AS (
  SELECT word, 'слово ' || count(*) AS reading, 0 AS rank FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word
  UNION ALL SELECT *, 1 FROM (VALUES {_ENTRIES(BRANDS)}) UNION ALL SELECT *, 2 FROM (VALUES {_ENTRIES(ENGLISH)}))
SELECT word, arg_min(reading, rank) AS reading, CAST(min(rank) AS INT) AS rank FROM l GROUP BY word""",
    "ua_lexicon_files": "SELECT word, 'слово ' || count(*) AS reading FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word",
    "ua_vocabulary": rf"""
WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_LATIN_WORD}')) AS word FROM benchmark),
p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS s FROM (SELECT doc_id, regexp_extract_all(text, '(?s){_LATIN_WORD}|[0-9A-Za-z_]+|.') AS x FROM documents))
SELECT doc_id, coalesce(string_agg(CASE WHEN word IS NULL THEN s ELSE '«' || word || '»' END, '' ORDER BY i), '') AS spoken
FROM p LEFT JOIN v ON v.word = lower(s) AND regexp_full_match(s, '[A-Za-z].*') GROUP BY doc_id
UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL OR text = ''""",
}
