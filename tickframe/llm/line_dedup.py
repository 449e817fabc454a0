"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points stay only in the smallest doc_id that holds them; every other
document loses all its lines with that key. Other lines stay, joined by ``\\n``.

Documents arrive in batches of ascending doc_id. ``LineRuns`` keeps what has been seen as
sorted runs bucketed by the key's hash, like the levels of a log-structured merge tree: each
batch merge-anti-joins all runs, what is new becomes a run of level 0, and ``fanout`` runs of
one level are compacted into one run of the next. Since batches ascend, the first batch that
brings a key holds its smallest doc_id.

Keys are compared by two independent 64-bit hashes. A key that a third of all documents share
is reduced by a map-side ``min`` before the shuffle; the decision join uses (hash, doc_id), so
such a key spreads over all tasks. The text is shuffled at most once, to meet its own list of
dropped positions.

Null texts and empty texts are one empty line. Documents without an id neither hold keys nor
lose lines. Repeated rows of one document keep and lose the same lines. An empty table gives
an empty result. All other columns are carried; an input column named like a result column
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BLANKS, LOWER, UPPER, fresh_path, staged

HASH = ["__h1", "__h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Levelled store of sorted runs (h1, h2, doc_id), each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        path = fresh_path(self.spark, f"line-run-l{level}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        (rows.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", path).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.names.append(name)
        return name

    def close(self) -> None:
        """Take the runs' names out of the catalog; frames that read a run have its files and go on."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, doc_id); return its new keys with their first document."""
        new = lines.groupBy(*HASH).agg(F.min("doc_id").alias("doc_id"))
        for run in (r for level in self.levels for r in level):
            new = new.join(self.spark.table(run).select(*HASH).hint("merge"), HASH, "left_anti")
        firsts = self.spark.table(self._write(new, 0))
        self._compact()
        return firsts

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self.spark.table(runs[0])
            for r in runs[1:]:
                merged = merged.unionByName(self.spark.table(r))
            self._write(merged, level + 1)
            level += 1


def dedup_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10, buckets: int | None = None,
                fanout: int = 2) -> DataFrame:
    """Documents with ``text`` reduced to the kept lines, ``n_lines`` (before) and ``n_dropped``.

    ``batches`` is how many ascending doc_id ranges are fed to the runs, ``buckets`` the number
    of sorted files of a run (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    key = line_key(F.col("__line"))
    lines = (docs.filter(F.col("doc_id").isNotNull())
             .select("doc_id", F.xxhash64(text).alias("__text"), batch.alias("__batch"),
                     F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
             .select("doc_id", "__text", "__batch", "__pos", key.alias("__key"))
             .filter(F.char_length("__key") >= min_chars)
             .select("doc_id", "__text", "__batch", "__pos", F.xxhash64("__key").alias(HASH[0]),
                     F.xxhash64(F.lit("line"), "__key").alias(HASH[1])))
    path = fresh_path(spark, "lines")
    lines.write.partitionBy("__batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    runs = LineRuns(spark, buckets, fanout)
    dropped = []
    for b in range(len(set(cuts)) + 1):
        part = lines.filter(F.col("__batch") == b).drop("__batch")
        firsts = runs.add(part.select(*HASH, "doc_id"))
        dropped.append(part.join(firsts, [*HASH, "doc_id"], "left_anti").select("doc_id", "__text", "__pos"))
    runs.close()
    gone = dropped[0]
    for d in dropped[1:]:
        gone = gone.unionByName(d)
    gone = gone.groupBy("doc_id", "__text").agg(F.collect_set("__pos").alias("__gone"))

    result = ("text", "n_lines", "n_dropped")
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in result]
    split = docs.select(*carried, F.xxhash64(text).alias("__text"), F.split(text, "\n", -1).alias("__lines"))
    at = F.when(F.col("__gone").isNull(), F.lit(None)).otherwise(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")))
    kept = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(at, lambda i: F.get("__lines", i)), "\n"))
    return (split.join(gone, ["doc_id", "__text"], "left")
            .select(*carried, kept.alias("text"), F.size("__lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped")))


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rows),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(length(k.key) >= 10 AND k.doc_id <> f.first_doc, false) AS gone
           FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
