"""Importance resampling towards a target distribution, in Spark SQL functions only.

Documents and targets are described by counts of hashed word n-grams. A bucket's gain tells how much likelier it is in
the target; a document's weight is the mean gain of its features, and a Gumbel draw added to it makes the highest
scores a sample without replacement. Counts are grouped before they are shuffled, the gains are a table of as many rows
as there are buckets, and ranks are positions in range-sorted partitions plus the partitions' offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and small letters, after capitals are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
#: Buckets are a broadcast table, so their number is bounded.
MOST_BUCKETS = 1_000_000
POSITION_BITS = 33  # of monotonically_increasing_id: the position in the partition


def words_of(text: Column) -> Column:
    """The words of a text in order; of a null or empty one none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def grams_of(words: Column, most: int) -> Column:
    """All runs of 1 to `most` consecutive words, joined by one space, repeats included."""
    grams = runs = words
    for n in range(2, most + 1):  # a run of n words is one of n - 1 and the word that follows it
        rest = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
        runs = F.zip_with(rest, F.slice(words, F.lit(n), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        grams = F.concat(grams, runs)
    return grams


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, grams: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts: counted in each task first, so a common word costs a row a task."""
    words = texts.select(words_of(F.col(text_col)).alias("words"))
    features = words.select(F.explode(grams_of(F.col("words"), grams)).alias("gram"))
    return features.groupBy(bucket_of(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), in doubles."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")
    spark = docs.sparkSession
    counts = written(bucket_counts(docs, text_col, grams, buckets), "source-buckets")
    wanted = written(bucket_counts(target, target_col, grams, buckets), "target-buckets")
    total, aim = (t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (counts, wanted))
    every = spark.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts.select("bucket", F.col("n").alias("s")), "bucket", "left").join(wanted.select("bucket", F.col("n").alias("t")), "bucket", "left")
    plus = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1
    ratio = plus(F.col("t")) * F.lit(float(total + buckets)) / (plus(F.col("s")) * F.lit(float(aim + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, grams: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean gain of its features, 0 without any.

    Features are exploded, meet the gains, which every task holds (one row a bucket), and are summed in the task that
    read the document: what is shuffled is one row a document. Rows are told apart by their place in the input, so
    repeated and null ids stay rows of their own.
    """
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"), F.monotonically_increasing_id().alias("_row"))
    counted = words.select("_row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(grams_of(F.col("words"), grams)).alias("gram"))
    met = counted.withColumn("bucket", bucket_of(F.col("gram"), buckets)).join(F.broadcast(gain), "bucket", "left")
    summed = met.groupBy("_row", "doc_id", "n_words").agg(F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0)
    return summed.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256("seed:id"); a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """rows with `rank` 1, 2, 3 ... in the order given, null beyond `most`.

    Rows are sorted over ranges; a row's rank is its position in its partition plus the rows of the partitions before.
    Only the partitions' sizes, one row each, meet in one place.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("_at", POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("parts"))
    # the offset of partition k is the sum of the sizes before it: one array as long as there are partitions
    offsets = F.expr("transform(parts, p -> struct(p._part AS _part, aggregate(filter(parts, q -> q._part < p._part), 0L, (a, q) -> a + q.n) AS _before))")
    before = sizes.select(F.explode(offsets).alias("o")).select("o.*")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << POSITION_BITS) - 1) + 1
    met = placed.withColumn("_part", part).join(F.broadcast(before), "_part", "left")
    return met.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs: rank tells the draw, and is null for rows that aren't drawn.

    Of the N rows with `least_words` words or more, floor(percent * N / 100) of the highest scores are drawn; ties go to the
    smaller id, null ids come last, then fewer features. Null and empty texts have no features and the weight 0; they and other short
    rows are never drawn. Repeated rows are rows of their own, with equal scores and successive ranks. Whole texts are
    read, however long. Without rows there is no result; without targets all counts of theirs are 0. Further columns are
    ignored, whatever their names.
    """
    scored = weighed(docs, gains(docs, target, grams, buckets, text_col, target_col), grams, buckets, id_col, text_col)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scores")
    fit = F.col("n_words") >= least_words
    most = percent * scored.where(fit).count() // 100
    drawn = ranked(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")], most)
    told = drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten percent of documents drawn towards the benchmark's distribution of words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a blob column's bytes in SQL: the byte table comes from its polynomial, eight steps a value.
CRC_TABLE = "SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))"
CRC_BYTES = "list_transform(range(1, 2 * octet_length(b), 2), lambda k: ('0x' || substr(hex(b), k, 2))::BIGINT)"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295)"

ORACLE = rf"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '')) AS w FROM benchmark),
e AS (SELECT r, unnest(w) AS w FROM d),
v AS (SELECT w, encode(w) AS b FROM (SELECT w FROM e UNION SELECT w FROM b)),
y AS (SELECT w, {CRC_BYTES} AS bytes FROM v),
h AS (SELECT w, {CRC} % {BUCKETS} AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM e JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
n AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= (SELECT 10 * count(*) // 100 FROM z WHERE n_words >= 20) THEN k END::BIGINT AS rank FROM n
"""
