"""Dataset queries: files, profile, labels, copies, splits, tokens, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.operators import neardup, prepare, profile
from talkgauge.plans.registry import register
from talkgauge.plans.tables import labelled, table, texts
from talkgauge.plans.text_queries import blanks_sql, clean_sql, words_sql
from talkgauge.session import materialize, scratch_path
from talkgauge.sources import datasets

LABELLED_SQL = "l AS (SELECT d.doc_id, d.text, d.lang, d.source, quality, toxic FROM documents d JOIN labels USING (doc_id))"
CLEAN_SQL = f"{LABELLED_SQL}, k AS MATERIALIZED (SELECT *, {clean_sql('text')} AS t FROM l)"
KEPT_SQL = f"{CLEAN_SQL}, kept AS (SELECT * FROM k WHERE t<>'' AND doc_id IN (SELECT min(doc_id) FROM k WHERE t<>'' GROUP BY t))"
CLEAN_DOCS_SQL = f"k AS MATERIALIZED (SELECT doc_id, lang, {clean_sql('text')} AS t FROM documents)"


def split_sql(source: str, key: str = "doc_id", label: str = "label") -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY sha256('42:' || {key}))-1 AS rk, count(*) OVER (PARTITION BY {label}) AS n FROM {source}),
    sp AS (SELECT *, CASE WHEN rk < floor(n*0.70+0.5) THEN 'train' WHEN rk < floor(n*0.85+0.5) THEN 'val' ELSE 'test' END AS split FROM r)"""


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.cleaned(labelled(spark, folder), keep_empty=False)
    return prepare.first_copies(materialize(rows, "cleaned"), "doc_id")


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cleaned, with the language as label: the large dataset.

    Written once: the split passes over keys and labels must not clean again.
    """
    rows = prepare.cleaned(texts(spark, folder, "documents").select("doc_id", "text", "lang"), keep_empty=False)
    return materialize(prepare.as_dataset(rows, label="lang", key="doc_id"), "cleaned")


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.split(_dataset(spark, folder))


SPLITS_SQL = f"{CLEAN_DOCS_SQL}, ds AS (SELECT doc_id AS id, t AS text, lang AS label FROM k WHERE t<>''), {split_sql('ds', 'id')}"


# --- files -------------------------------------------------------------------------------

ROUND_TRIP_SQL = "SELECT doc_id, sha256(text) AS digest, lang FROM documents"


def _round_trip(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    rows = texts(spark, folder, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "labelled") + suffix
    if suffix == ".csv":
        rows.write.options(**datasets.CSV_OPTIONS).csv(path)
    elif suffix == ".jsonl":
        rows.write.json(path)
    else:
        # One JSON array per file, each of at most a hundred neighbouring ids.
        part = F.floor(F.col("doc_id") / 100).alias("part")
        arrays = rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
        arrays.write.partitionBy("part").text(path)
    again = datasets.read_dataset(spark, path, rows.schema)
    datasets.require_columns(again, "text", "lang")
    return again.select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


@register(ROUND_TRIP_SQL)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, ".csv")


@register(ROUND_TRIP_SQL)
def json_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, ".jsonl")


@register(ROUND_TRIP_SQL)
def json_array_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, ".json")


@register(f"{'WITH ' + SPLITS_SQL} SELECT id, sha256(text) AS digest, label, split FROM sp")
def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Splits written one folder each; every folder read back on its own."""
    path = scratch_path(spark, "splits")
    splits = _splits(spark, folder)
    datasets.write_splits(splits, path)
    schema = splits.drop("split").schema
    train, val, test = (datasets.read_split(spark, path, s, schema).withColumn("split", F.lit(s)) for s in ("train", "val", "test"))
    return train.unionByName(val).unionByName(test).select("id", F.sha2("text", 256).alias("digest"), "label", "split")


@register("SELECT lang AS label, CAST(row_number() OVER (ORDER BY lang)-1 AS INTEGER) AS label_id FROM (SELECT DISTINCT lang FROM documents)")
def label_map_file(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    mapping = prepare.label_map(table(spark, folder, "documents").select(F.col("lang").alias("label")))
    datasets.write_json(mapping, path)
    return datasets.read_json_lines(spark, path, mapping.schema)


# --- labels ------------------------------------------------------------------------------


@register("""WITH m AS (SELECT source, CAST(row_number() OVER (ORDER BY source)-1 AS INTEGER) AS label_id FROM (SELECT DISTINCT source FROM documents))
    SELECT doc_id, source, label_id FROM documents JOIN m USING (source)""")
def sorted_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return prepare.encode_labels(docs, prepare.label_map(docs, "source"), "source")


@register("""WITH m AS (SELECT lang, CAST(row_number() OVER (ORDER BY min(doc_id))-1 AS INTEGER) AS label_id FROM documents GROUP BY lang)
    SELECT doc_id, lang, label_id FROM documents JOIN m USING (lang)""")
def appearance_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return prepare.encode_labels(docs, prepare.label_map_by_appearance(docs, "lang", "doc_id"), "lang")


# --- profile -----------------------------------------------------------------------------


@register("SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts FROM documents")
def dataset_size(spark: SparkSession, folder: str) -> DataFrame:
    return profile.size(table(spark, folder, "documents"))


@register(f"WITH {LABELLED_SQL} SELECT quality, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM l),6) AS percent FROM l GROUP BY quality")
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return r6(profile.class_distribution(labelled(spark, folder).select("quality"), "quality"), "percent")


@register("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT max(n) AS largest, min(n) AS smallest, round(max(n)/min(n),6) AS ratio, max(n)/min(n)>1.5 AS imbalanced FROM c""")
def class_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    return r6(profile.imbalance(table(spark, folder, "documents"), "lang"), "ratio")


WORDS_SQL = f"b AS (SELECT doc_id, lang, text, {blanks_sql('text')} AS bt FROM documents), w AS (SELECT *, {words_sql('bt')} AS words FROM b)"


@register(
    f"""WITH {WORDS_SQL} SELECT round(avg(words),6) AS mean, min(words)::INTEGER AS shortest, max(words)::INTEGER AS longest,
      round(quantile_cont(words,0.5),6) AS median, round(quantile_cont(words,0.25),6) AS p25, round(quantile_cont(words,0.75),6) AS p75,
      round(quantile_cont(words,0.95),6) AS p95, round(100.0*avg(CASE WHEN words>256 THEN 1.0 ELSE 0 END),6) AS percent_above,
      10*count(*) FILTER (words>256) > count(*) AS cut_warning,
      CASE WHEN 10*count(*) FILTER (words>256) > count(*) THEN floor(quantile_cont(words,0.95))::INTEGER ELSE 256 END AS suggested_length FROM w"""
)
def length_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = profile.length_stats(texts(spark, folder, "documents"))
    return r6(stats, "mean", "median", "p25", "p75", "p95", "percent_above")


@register(
    f"""WITH {WORDS_SQL}, c AS (SELECT lang, count(*) AS n FROM w GROUP BY lang)
    SELECT (SELECT count(*) FROM w) AS total_samples, (SELECT count(*) FROM c) AS num_classes,
      (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM c) AS class_distribution, round((SELECT avg(words) FROM w),6) AS text_length_mean,
      round((SELECT quantile_cont(words,0.5) FROM w),6) AS text_length_median, (SELECT max(words)::INTEGER FROM w) AS text_length_max"""
)
def stats_record(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics row after a trip through its JSON file; the class map as text."""
    record = profile.stats_record(texts(spark, folder, "documents"), label="lang")
    path = scratch_path(spark, "stats")
    datasets.write_json(record, path)
    again = datasets.read_json_lines(spark, path, record.schema)
    entries = F.transform(F.array_sort(F.map_entries("class_distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return r6(again.withColumn("class_distribution", F.array_join(entries, ",")), "text_length_mean", "text_length_median")


@register(
    f"""WITH {CLEAN_DOCS_SQL} SELECT count(*) AS original, count(*) FILTER (t='') AS emptied,
      count(*) FILTER (t<>'') - count(DISTINCT CASE WHEN t<>'' THEN t END) AS duplicates, count(DISTINCT CASE WHEN t<>'' THEN t END) AS cleaned,
      count(*) - count(DISTINCT CASE WHEN t<>'' THEN t END) AS removed,
      round(100.0*(count(*) - count(DISTINCT CASE WHEN t<>'' THEN t END))/count(*),6) AS removed_percent FROM k"""
)
def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.cleaned(texts(spark, folder, "documents").select("doc_id", "text"))
    return r6(profile.cleaning_report(rows), "removed_percent")


@register("SELECT count(*)-count(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_count(table(spark, folder, "documents"))


SPECIAL_SQL = r"round(CASE WHEN length(text)>0 THEN len(regexp_extract_all(text, '[^\p{L}\p{N}\p{M}\p{Z}\x09-\x0d]'))/length(text) ELSE 0 END, 4)"


@register(
    f"""WITH {WORDS_SQL}, v AS (SELECT doc_id, words::INTEGER AS words, {SPECIAL_SQL} AS special FROM w),
    q AS (SELECT quantile_cont(words,0.01) AS lo, quantile_cont(words,0.99) AS hi, quantile_cont(special,0.99) AS sp FROM v)
    SELECT doc_id, words, special, words<lo AS too_short, words>hi AS too_long, special>sp AS too_special FROM v, q"""
)
def outlier_documents(spark: SparkSession, folder: str) -> DataFrame:
    return profile.outliers(texts(spark, folder, "documents"), "doc_id")


@register("SELECT sha256(text) AS text_key, count(*) AS n, count(DISTINCT source) AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT source)>1")
def conflicting_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of one text that carry different sources."""
    return profile.conflicting_labels(table(spark, folder, "documents"), label="source")


@register(
    """WITH h AS (SELECT ('0x' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, text, lang)),1,15))::BIGINT::HUGEINT AS v FROM documents)
    SELECT count(*) AS n, sha256(count(*) || ':' || sum(v)) AS version FROM h"""
)
def data_version(spark: SparkSession, folder: str) -> DataFrame:
    return profile.version_hash(table(spark, folder, "documents"), "doc_id", "text", "lang")


# --- cleaning and copies -----------------------------------------------------------------


@register(f"WITH {CLEAN_DOCS_SQL} SELECT doc_id, sha256(t) AS digest FROM k WHERE t<>''")
def emptied_dropped(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.cleaned(texts(spark, folder, "documents").select("doc_id", "text"), keep_empty=False)
    return rows.select("doc_id", F.sha2("text_cleaned", 256).alias("digest"))


@register(f"WITH {CLEAN_DOCS_SQL} SELECT min(doc_id) AS doc_id, sha256(t) AS digest FROM k WHERE t<>'' GROUP BY t")
def copies_dropped(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.cleaned(texts(spark, folder, "documents").select("doc_id", "text"), keep_empty=False)
    kept = prepare.first_copies(materialize(rows.select("doc_id", "text_cleaned"), "cleaned"), "doc_id")
    return kept.select("doc_id", F.sha2("text_cleaned", 256).alias("digest"))


@register(f"WITH {KEPT_SQL} SELECT doc_id AS id, sha256(t) AS digest, quality AS label FROM kept")
def prepared_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents cleaned, emptied rows and copies dropped, columns renamed."""
    rows = prepare.as_dataset(_kept(spark, folder), label="quality", key="doc_id")
    return rows.select("id", F.sha2("text", 256).alias("digest"), "label")


@register(
    f"""WITH b AS (SELECT doc_id, string_split({blanks_sql('text')}, ' ') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w)-2, 1)+1), lambda i: coalesce(w[i],'') || ' ' || coalesce(w[i+1],'') || ' ' || coalesce(w[i+2],''))) AS s FROM b),
    z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s=b.s AND a.doc_id>b.doc_id GROUP BY 1,2),
    j AS (SELECT x, y, c/(zx.n+zy.n-c) AS sim FROM o JOIN z zx ON zx.doc_id=x JOIN z zy ON zy.doc_id=y)
    SELECT x AS doc_id, min(y) AS first FROM j WHERE sim>0.95 GROUP BY x"""
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged near copies; the twin compares all pairs exactly."""
    return neardup.near_duplicates(texts(spark, folder, "documents"), earliest=True).select("doc_id", "first")


# --- splits ------------------------------------------------------------------------------


@register(f"WITH {SPLITS_SQL} SELECT id, label, split FROM sp")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder).select("id", "label", "split")


@register(f"WITH {SPLITS_SQL} SELECT coalesce(split,'all') AS split, coalesce(label,'all') AS label, count(*) AS n FROM sp GROUP BY ROLLUP(split,label)")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.split_sizes(_splits(spark, folder))


@register(f"WITH {SPLITS_SQL} SELECT sha256(text) AS text_key, count(DISTINCT split) AS splits, count(*) AS n FROM sp GROUP BY text HAVING count(DISTINCT split)>1")
def texts_in_two_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Copies that were not dropped before the split leak across it."""
    return prepare.shared_texts(_splits(spark, folder))


@register(
    f"""WITH b AS MATERIALIZED (SELECT item_id, ' ' || {blanks_sql('text')} || ' ' AS bt FROM benchmark),
    d AS MATERIALIZED (SELECT doc_id, ' ' || {blanks_sql('text')} || ' ' AS dt FROM documents)
    SELECT doc_id, item_id FROM d JOIN b ON contains(dt, bt) WHERE trim(bt)<>''"""
)
def held_out_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage in full: the test data would not be independent."""
    docs = texts(spark, folder, "documents").select("doc_id", "text")
    return prepare.contained_passages(docs, table(spark, folder, "benchmark"), "doc_id", "item_id")


@register(
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id))-1 AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, quality, CAST((rk>=floor(n*0.2+0.5))::INT + (rk>=floor(n*0.4+0.5))::INT + (rk>=floor(n*0.6+0.5))::INT + (rk>=floor(n*0.8+0.5))::INT AS INTEGER) AS fold FROM r"""
)
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select("doc_id", "quality")
    return prepare.folds(rows, 5, "doc_id", "quality")


@register(
    """WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id))-1 AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels),
    f AS (SELECT toxic, (rk>=floor(n*0.2+0.5))::INT + (rk>=floor(n*0.4+0.5))::INT + (rk>=floor(n*0.6+0.5))::INT + (rk>=floor(n*0.8+0.5))::INT AS fold FROM r),
    v AS (SELECT fold, avg(toxic) AS x FROM f GROUP BY fold) SELECT round(avg(x),6) AS mean, round(stddev_samp(x),6) AS spread, count(*) AS folds FROM v"""
)
def fold_metric_spread(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.folds(table(spark, folder, "labels"), 5, "doc_id", "quality")
    return r6(prepare.fold_summary(rows.groupBy("fold").agg(F.avg("toxic").alias("x")), "x"), "mean", "spread")


# --- balance -----------------------------------------------------------------------------


@register("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, n, round((SELECT sum(n) FROM c)/((SELECT count(*) FROM c)*n),6) AS class_weight FROM c""")
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return r6(prepare.class_weights(table(spark, folder, "labels"), "quality"), "class_weight")


@register("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT doc_id, quality, round((SELECT sum(n) FROM c)/((SELECT count(*) FROM c)*n),6) AS class_weight FROM labels JOIN c USING (quality)""")
def weighted_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.with_class_weight(table(spark, folder, "labels").select("doc_id", "quality"), "quality")
    return r6(rows, "class_weight")


RANKED_SQL = "r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id))-1 AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels)"


@register(f"WITH {RANKED_SQL} SELECT doc_id, quality FROM r WHERE rk < (SELECT min(n) FROM r)")
def undersampled(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.undersample(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality")


@register(
    f"""WITH {RANKED_SQL}, m AS (SELECT max(n) AS top FROM r), t AS (SELECT doc_id, quality, top//n + CASE WHEN rk < top%n THEN 1 ELSE 0 END AS times FROM r, m)
    SELECT doc_id, quality, CAST(unnest(range(1, times+1)) AS INTEGER) AS copy FROM t"""
)
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.oversample(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality")


# --- tokens and augmentation -------------------------------------------------------------

# CRC-32 of every distinct word, byte by byte from its table.
CRC_SQL = """tab AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)),
bytes AS (SELECT x, list_transform(range(octet_length(encode(x))), lambda b: ('0x' || substr(hex(encode(x)), 2*b+1, 2))::BIGINT) AS bs FROM (SELECT DISTINCT x FROM u)),
crcs AS (SELECT x, xor(list_reduce(bs, lambda c, b: xor(t[(xor(c, b) & 255)+1], c >> 8), 4294967295), 4294967295) AS crc FROM bytes, tab)"""

@register(
    f"""WITH b AS (SELECT doc_id, {blanks_sql('lower(text)')} AS t FROM documents),
    w AS (SELECT doc_id, list_slice(list_filter(string_split(t,' '), lambda x: x<>''),1,256) AS w FROM b),
    u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w,1) AS k FROM w), {CRC_SQL},
    i AS (SELECT doc_id, count(*) AS used, sum((crc % 29998 + 2)*k)::BIGINT AS checksum FROM u JOIN crcs USING (x) GROUP BY doc_id)
    SELECT doc_id, coalesce(used,0)::BIGINT AS used, coalesce(checksum,0)::BIGINT AS checksum, 256::INTEGER AS width FROM w LEFT JOIN i USING (doc_id)"""
)
def tokenized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed word ids of fixed length, summed up by position."""
    rows = prepare.tokenized(texts(spark, folder, "documents").select("doc_id", "text"))
    total = F.aggregate(F.transform("input_ids", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    used = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("doc_id", used.alias("used"), total.alias("checksum"), F.size("input_ids").alias("width"))


def _bytes_tokenizer():
    """Stands in for a sub-word tokenizer: one id per byte."""

    def encode(texts):
        return [[b + 2 for b in t.encode("utf-8")] for t in texts]

    return encode


@register(
    """SELECT conv_id, turn, least(128, octet_length(encode(text)))::BIGINT AS used, 128::INTEGER AS width FROM conversations"""
)
def tokenized_with_plugin(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.tokenized(table(spark, folder, "conversations"), 128, make_tokenizer=_bytes_tokenizer)
    used = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", used.alias("used"), F.size("input_ids").alias("width"))


def seed_sql(tag: str, key: str = "id") -> str:
    return f"('0x' || substr(md5('{tag}:' || {key}),1,15))::BIGINT"


def unit_sql(seed: str, place: str) -> str:
    """The number sequence of a row: two squarings modulo 2^31-1, widened so that nothing overflows."""
    low = f"((({seed} & 2147483647) + ({place})*40503) % 2147483647)::HUGEINT"
    once = f"(({low}*{low} + ({seed} >> 31)) % 2147483647)"
    return f"(({once}*{once} + ({place}) + 6789) % 2147483647)::DOUBLE/2147483647.0"


def seeded_sql(tag: str, source: str = "wd") -> str:
    return f"sd AS (SELECT *, {seed_sql(tag)} AS s0 FROM {source})"


CHANCE_SQL = unit_sql("s0", "i-1")


VARIANT_SQL = f"""{SPLITS_SQL}, wd AS (SELECT id, label, split, string_split(text,' ') AS w FROM sp WHERE split='train'),
orig AS (SELECT id, split, 'original' AS variant, sha256(text) AS digest FROM sp)"""


@register(
    f"""WITH {VARIANT_SQL}, {seeded_sql('42-delete')}, d AS (SELECT id, split, list_filter(w, lambda x, i: {CHANCE_SQL} >= 0.1) AS v, w FROM sd)
    SELECT * FROM orig UNION ALL SELECT id, split, 'deletion', sha256(array_to_string(CASE WHEN len(v)>0 THEN v ELSE w[1:1] END,' ')) FROM d"""
)
def words_deleted(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.augmented(_splits(spark, folder), lambda w, k: prepare.delete_words(w, k, 0.1), "deletion")
    return rows.select("id", "split", "variant", F.sha2("text", 256).alias("digest"))


@register(
    f"""WITH {VARIANT_SQL}, {seeded_sql('42-insert')}, d AS (SELECT id, split, flatten(list_transform(w, lambda x, i: CASE WHEN {CHANCE_SQL} < 0.1
        THEN [x, w[CAST(floor({CHANCE_SQL}/0.1*len(w)) AS BIGINT)+1]] ELSE [x] END)) AS v FROM sd)
    SELECT * FROM orig UNION ALL SELECT id, split, 'insertion', sha256(array_to_string(v,' ')) FROM d"""
)
def words_inserted(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.augmented(_splits(spark, folder), lambda w, k: prepare.insert_words(w, k, 0.1), "insertion")
    return rows.select("id", "split", "variant", F.sha2("text", 256).alias("digest"))


SYNONYM_SQL = """CASE x WHEN 'the' THEN 'that' WHEN 'of' THEN 'from' WHEN 'en' THEN 'dans' WHEN 'der' THEN 'jener' ELSE x END"""


def _synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("the", "that"), ("of", "from"), ("en", "dans"), ("der", "jener")], "word string, synonym string")


SYNONYMS_SQL = f"""WITH {VARIANT_SQL}, {seeded_sql('42-synonym')}, d AS (SELECT id, split, list_transform(w, lambda x, i: CASE WHEN {CHANCE_SQL} < 0.5 THEN {SYNONYM_SQL} ELSE x END) AS v FROM sd)
    SELECT * FROM orig UNION ALL SELECT id, split, 'synonym', sha256(array_to_string(v,' ')) FROM d"""


@register(SYNONYMS_SQL)
def words_replaced(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare.augmented_by_synonyms(_splits(spark, folder), _synonyms(spark), 0.5)
    return rows.select("id", "split", "variant", F.sha2("text", 256).alias("digest"))


@register(SYNONYMS_SQL)
def words_replaced_by_join(spark: SparkSession, folder: str) -> DataFrame:
    """The path for a synonym table too long for a map."""
    rows = prepare.augmented_by_synonyms(_splits(spark, folder), _synonyms(spark), 0.5, max_rows=1)
    return rows.select("id", "split", "variant", F.sha2("text", 256).alias("digest"))
