"""Cleaning queries over pages and documents.

RE2, the twin's regex engine, knows only ASCII classes, so blanks and word
characters are spelled out there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.functions import textclean as tc
from talkgauge.plans.registry import register
from talkgauge.plans.tables import texts

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
SOLID = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}\p{M}_]"


def markup_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&{WORD}+;', '', 'g')"


def urls_sql(x: str, token: str = "[URL]") -> str:
    return f"regexp_replace({x}, 'http{SOLID}+|www\\.{SOLID}+', '{token}', 'g')"


def emails_sql(x: str, token: str = "[EMAIL]") -> str:
    return f"regexp_replace({x}, '{SOLID}+@{SOLID}+', '{token}', 'g')"


def blanks_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'), ' ')"


def words_sql(x: str) -> str:
    return f"CASE WHEN {x}='' THEN 0 ELSE len(string_split({x}, ' ')) END"


def clean_sql(x: str, url: str = "[URL]", email: str = "[EMAIL]", normal: str = "nfc_normalize") -> str:
    text = blanks_sql(emails_sql(urls_sql(markup_sql(f"coalesce({x},'')"), url), email))
    return f"(SELECT CASE WHEN {words_sql('z.t')}>=3 THEN z.t ELSE '' END FROM (SELECT {text} AS t) z)"


def _digest(rows: DataFrame, key: str, text) -> DataFrame:
    return rows.select(key, F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("digest"))


def _digest_sql(key: str, text: str, source: str) -> str:
    return f"SELECT {key}, length(t) AS chars, sha256(t) AS digest FROM (SELECT {key}, {text} AS t FROM {source})"


@register(_digest_sql("page_id", markup_sql("html"), "pages"))
def page_markup_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "pages"), "page_id", tc.strip_markup(F.col("html")))


@register(_digest_sql("page_id", urls_sql("html"), "pages"))
def page_urls_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "pages"), "page_id", tc.mark_urls(F.col("html")))


@register(_digest_sql("page_id", urls_sql("url || ' ' || html", ""), "pages"))
def page_urls_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "pages"), "page_id", tc.mark_urls(F.concat_ws(" ", "url", "html"), "remove"))


@register(_digest_sql("doc_id", emails_sql("text"), "documents"))
def document_emails_replaced(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.mark_emails(F.col("text")))


@register(_digest_sql("doc_id", blanks_sql("text"), "documents"))
def document_blanks_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.collapse_blanks(F.col("text")))


@register(_digest_sql("doc_id", f"regexp_replace(text, '[^a-zA-Z0-9\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}.,!?;:\\-''\"]', '', 'g')", "documents"))
def document_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.keep_plain(F.col("text")))


@register(_digest_sql("doc_id", "regexp_replace(text, '[^a-zA-Z0-9\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]', '', 'g')", "documents"))
def document_plain_words(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.keep_plain(F.col("text"), punctuation=False))


@register(_digest_sql("doc_id", f"CASE WHEN {words_sql(blanks_sql('text'))}>=3 THEN {blanks_sql('text')} ELSE '' END", "documents"))
def document_min_words(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.require_words(tc.collapse_blanks(F.col("text"))))


@register(_digest_sql("doc_id", clean_sql("text"), "documents"))
def cleaned_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.clean(F.col("text")))


@register(_digest_sql("page_id", clean_sql("html"), "pages"))
def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "pages"), "page_id", tc.clean(F.col("html")))


@register(_digest_sql("page_id", clean_sql("html", "", ""), "pages"))
def cleaned_pages_links_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Both replace flags off: links vanish."""
    text = tc.clean_joint(F.col("html"), replace_urls=False, replace_emails=False)
    return _digest(texts(spark, folder, "pages"), "page_id", text)


@register(_digest_sql("doc_id", "CASE WHEN n_chars%7=0 THEN '' ELSE text END", "documents"))
def missing_as_empty(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh length is treated as missing text."""
    gone = F.when(F.col("n_chars") % 7 != 0, F.col("text"))
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.present(gone))


@register(_digest_sql("doc_id", "nfc_normalize(text)", "documents"))
def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Compatibility forms do not occur in these texts, so the canonical form must agree."""
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.normalize(F.col("text")))


@register(_digest_sql("doc_id", r"regexp_replace(text, '\p{Cf}', '', 'g')", "documents"))
def invisible_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(texts(spark, folder, "documents"), "doc_id", tc.drop_invisible(F.col("text")))


@register(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{fffd}\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}]'))::INTEGER AS corrupt_chars FROM documents"""
)
def corrupt_characters(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents").select("doc_id", tc.corrupt_count(F.col("text")).alias("corrupt_chars"))


@register(
    f"""WITH b AS (SELECT doc_id, {blanks_sql('text')} AS t FROM documents)
    SELECT doc_id, {words_sql('t')}>512 AS is_long,
      sha256(array_to_string(list_slice(string_split(t,' '),1,512),' ')) AS digest FROM b"""
)
def long_documents(spark: SparkSession, folder: str) -> DataFrame:
    text = tc.collapse_blanks(F.col("text"))
    return texts(spark, folder, "documents").select(
        "doc_id", tc.is_long(text).alias("is_long"), F.sha2(tc.first_words(text), 256).alias("digest")
    )
