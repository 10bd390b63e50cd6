"""Lines repeated across one site's documents (problem 7).

State tables under one path hold, per site, how many documents each line stands in. A new partition of documents is merged
as a delta of counts; lines that cross the threshold, either way (new documents also raise the site's total), tell which
documents are to be rebuilt. Lines travel as 128-bit hashes; texts are read once.

A delta only adds files: lines, counts, sites and documents of one number, which count from the moment its marker is
written. All tables but the documents' are sorted by a hash of the site, and a merge reads only the row groups that may hold
the delta's sites. ``compact`` puts the counts of many deltas together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.session import file_system, materialize, names_in, read_table, scratch, write_marker

#: A line is repeated excessively from so many documents, and from this share of the site's documents.
MIN_DOCUMENTS, MIN_SHARE = 5, 0.1
#: Parts that the state's tables are sorted into, by site.
BUCKETS = 256
#: Until when documents belong to the queries' first delta.
FIRST_DELTA = "2026-06-01 00:00:00"
_BLANK = r"[\s\p{Z}\x1C-\x1F\x85]+"
_KEYS = ["site", "h1", "h2"]


def site_of(url: Column) -> Column:
    """The host of an address in lower case, without port and user; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#\s]*)", 1)), F.lit(""))


def document_lines(documents: DataFrame) -> DataFrame:
    """site, doc_id, line_no, h1, h2 of every line with a letter or digit; line 0 stands for the document itself."""
    zero = F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    same = lambda line: F.lower(F.regexp_replace(line, _BLANK, ""))
    found = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).cast("long").alias("line_no"), F.when(line.rlike(r"[\p{L}\p{N}]"), same(line)).alias("same")))
    rows = documents.select("site", "doc_id", F.filter(found, lambda x: x["same"].isNotNull()).alias("found"))
    hashed = F.transform("found", lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["same"]).alias("h1"), F.xxhash64(F.reverse(x["same"]), F.lit(1)).alias("h2")))
    return rows.select("site", "doc_id", F.explode(F.concat(zero, hashed)).alias("x")).select("site", "doc_id", "x.*")


class SiteLines:
    """The state under ``path``: the tables ``lines`` (site, doc_id, line_no, h1, h2), ``counts`` (site, h1, h2, n_documents), ``sites`` (site, n_documents) and ``documents`` (doc_id), each in deltas."""

    #: Columns of the tables, with the type of doc_id left open.
    TABLES = {"lines": "site string, doc_id {id}, line_no long, h1 long, h2 long, bucket int", "counts": "site string, h1 long, h2 long, n_documents long, bucket int", "sites": "site string, n_documents long, bucket int", "documents": "doc_id {id}"}

    def __init__(self, spark: SparkSession, path: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, id_type: str = "long") -> None:
        self.spark, self.path, self.min_documents, self.min_share, self.id_type = spark, path.rstrip("/"), min_documents, min_share, id_type

    def deltas(self) -> list[int]:
        """Numbers of the deltas that count. A compaction stands in place of the counts and sites before it."""
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/_done"))

    def table(self, name: str, deltas: list[int] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of the state, of some deltas and buckets only where they are given."""
        deltas = self.deltas() if deltas is None else deltas
        if name in ("counts", "sites"):
            merged = [int(n) for n in names_in(self.spark, f"{self.path}/_compacted")]
            last = max((m for m in merged if m in deltas and min(deltas) == 1), default=None)
            if last is not None:
                paths = [f"{self.path}/{name}/compacted={last}", *(f"{self.path}/{name}/delta={k}" for k in deltas if k > last)]
            else:
                paths = [f"{self.path}/{name}/delta={k}" for k in deltas]
        else:
            paths = [f"{self.path}/{name}/delta={k}" for k in deltas]
        schema = self.TABLES[name].format(id=self.id_type)
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Each delta is read by itself, as its folders' names are no columns.
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        df = reduce(DataFrame.unionByName, parts)
        return df if buckets is None or name == "documents" else df.where(F.col("bucket").isin(buckets))

    def _write(self, df: DataFrame, name: str, folder: str) -> None:
        """One file a task, sorted by bucket: a reader of some buckets skips the row groups of the others."""
        if name != "documents":
            df = df.withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(BUCKETS)).cast("int")).sortWithinPartitions("bucket")
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{folder}")

    def _over(self, counts: DataFrame, sites: DataFrame, n: str, n_site: str) -> DataFrame:
        """``counts`` joined with its site's number, and whether a line is over the threshold."""
        # In whole thousandths: 0.1 * 70 is more than 7 in binary fractions.
        enough = (F.col(n) >= self.min_documents) & (F.col(n) * 1000 >= F.col(n_site) * round(self.min_share * 1000))
        return counts.join(sites, "site").withColumn("over", enough)

    def repeated(self) -> DataFrame:
        """site, h1, h2 of the lines that are over the threshold."""
        counts = self.table("counts").groupBy(*_KEYS).agg(F.sum("n_documents").alias("n"))
        sites = self.table("sites").groupBy("site").agg(F.sum("n_documents").alias("n_site"))
        return self._over(counts.where(F.col("n") >= self.min_documents), sites, "n", "n_site").where("over").select(*_KEYS)

    def merge(self, documents: DataFrame) -> DataFrame:
        """Merges new documents (site, doc_id, text) as one delta; returns the doc_ids to be rebuilt.

        These are the documents whose repeated lines aren't what they were: old ones with a line that crossed the
        threshold, and new ones with a line over it. Documents that the state knows already, and second deliveries within
        the delta, change nothing. A delta that broke off before its end is done again under its number. Defined cases: a
        null text, site or id takes no part; an empty text counts among the site's documents and has no lines.
        """
        done = self.deltas()
        number = max(done, default=0) + 1
        folder = f"delta={number}"
        new = documents.select("site", "doc_id", "text").where("site is not null and doc_id is not null and text is not null")
        if done:
            new = new.join(self.table("documents", done), "doc_id", "left_anti")
        self._write(document_lines(new), "lines", folder)
        delta = self.spark.read.schema(self.TABLES["lines"].format(id=self.id_type)).parquet(f"{self.path}/lines/{folder}")
        # A document counts once for a line, however often the line stands in it or the document was delivered.
        once = delta.groupBy(*_KEYS, "doc_id").agg(F.min("line_no").alias("first"))
        sums = materialize(once.groupBy(*_KEYS).agg(F.count("*").alias("n_documents"), F.min("first").alias("first")))
        # The documents' own line 0 has no other's hashes.
        self._write(sums.where("first > 0").select(*_KEYS, "n_documents"), "counts", folder)
        self._write(sums.where("first = 0").select("site", "n_documents"), "sites", folder)
        self._write(delta.where("line_no = 0").select("doc_id").distinct(), "documents", folder)
        write_marker(self.spark, f"{self.path}/_done/{number}")

        # Only the sites of the delta can have crossings, and only their buckets are read.
        buckets = [r[0] for r in self.table("sites", [number]).select("bucket").distinct().collect()]
        fresh = materialize(self.table("sites", [number]).select("site", F.col("n_documents").alias("n_new")))
        if done:
            before = self.table("sites", done, buckets).groupBy("site").agg(F.sum("n_documents").alias("n_old"))
            totals = fresh.join(before, "site", "left").select("site", F.coalesce("n_old", F.lit(0)).alias("n_old"), "n_new")
        else:
            totals = fresh.select("site", F.lit(0).cast("long").alias("n_old"), "n_new")
        totals = totals.select("site", "n_old", (F.col("n_old") + F.col("n_new")).alias("n_site"))
        old = self.table("counts", done, buckets) if done else self.spark.createDataFrame([], self.TABLES["counts"])
        both = old.select(*_KEYS, F.col("n_documents").alias("old"), F.lit(0).cast("long").alias("new")).unionByName(self.table("counts", [number]).select(*_KEYS, F.lit(0).cast("long").alias("old"), F.col("n_documents").alias("new")))
        lines = both.groupBy(*_KEYS).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).withColumn("n", F.col("old") + F.col("new")).where(F.col("n") >= self.min_documents)
        judged = self._over(lines, totals, "n", "n_site").withColumnRenamed("over", "now")
        was = (F.col("old") >= self.min_documents) & (F.col("old") * 1000 >= F.col("n_old") * round(self.min_share * 1000))
        judged = materialize(judged.withColumn("was", was).where("now or was").select(*_KEYS, "now", "was"))
        rebuild = delta.join(judged.where("now").select(*_KEYS), _KEYS, "left_semi").select("doc_id")
        if done:
            crossed = judged.where("now <> was").withColumn("bucket", F.pmod(F.xxhash64("site"), F.lit(BUCKETS)).cast("int"))
            touched = [r[0] for r in crossed.select("bucket").distinct().collect()]
            if touched:
                rebuild = rebuild.unionByName(self.table("lines", done, touched).join(crossed.select(*_KEYS), _KEYS, "left_semi").select("doc_id"))
        return rebuild.distinct()

    def compact(self) -> None:
        """Puts the counts and sites of all deltas together, so that a merge opens few files; lines stay as they are."""
        done = self.deltas()
        if not done:
            return
        folder = f"compacted={max(done)}"
        counts = self.table("counts").groupBy(*_KEYS).agg(F.sum("n_documents").alias("n_documents"))
        sites = self.table("sites").groupBy("site").agg(F.sum("n_documents").alias("n_documents"))
        self._write(counts, "counts", folder)
        self._write(sites, "sites", folder)
        write_marker(self.spark, f"{self.path}/_compacted/{max(done)}")
        for name in ("counts", "sites"):
            for k in done:
                fs, target = file_system(self.spark, f"{self.path}/{name}/delta={k}")
                fs.delete(target, True)

    def places(self, doc_ids: DataFrame | None = None) -> DataFrame:
        """doc_id and line_no of every place of a repeated line, of some documents only where they are given."""
        lines = self.table("lines").where("line_no > 0")
        if doc_ids is not None:
            lines = lines.join(doc_ids, "doc_id", "left_semi")
        return lines.join(self.repeated(), _KEYS, "left_semi").select("doc_id", "line_no").distinct()


def without_lines(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Every document's text (doc_id, text) without the lines named in ``places`` (doc_id, line_no); other texts stay."""
    gone = places.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", (i + 1).cast("long")))
    return documents.join(gone, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def _deltas(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The captures as documents, in two partitions by the time of their ingestion."""
    captures = read_table(spark, sf_dir, "captures")
    early = F.coalesce(F.col("ingested_at") < F.lit(FIRST_DELTA).cast("timestamp"), F.lit(False))
    of = lambda rows: rows.select(site_of(F.col("url")).alias("site"), F.col("capture_id").alias("doc_id"), F.col("markdown").alias("text"))
    return of(captures.where(early)), of(captures.where(~early))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """The places after two deltas: those of the documents that the second one names, and those that others had before."""
    state = SiteLines(spark, scratch(spark))
    first, second = _deltas(spark, sf_dir)
    state.merge(first)
    before = materialize(state.places())
    rebuild = materialize(state.merge(second))
    return before.join(rebuild, "doc_id", "left_anti").unionByName(state.places(rebuild)).withColumnRenamed("doc_id", "capture_id")


def p7_clean(spark, sf_dir: str) -> DataFrame:
    """Every capture's markdown without its site's repeated lines; captures without such lines keep theirs.

    The first delta's documents are built once; of them the second delta rebuilds only those it names.
    """
    state = SiteLines(spark, scratch(spark))
    first, second = (d.where("text is not null").dropDuplicates(["doc_id"]) for d in _deltas(spark, sf_dir))
    state.merge(first)
    built = materialize(without_lines(first.select("doc_id", "text"), state.places()))
    rebuild = materialize(state.merge(second))
    fresh = second.select("doc_id", "text").join(built.select("doc_id"), "doc_id", "left_anti")
    again = fresh.unionByName(first.select("doc_id", "text").join(rebuild, "doc_id", "left_semi"))
    built = built.join(rebuild, "doc_id", "left_anti").unionByName(without_lines(again, state.places(rebuild)))
    return built.select(F.col("doc_id").alias("capture_id"), F.col("text").alias("markdown"))


P7_SQL = r"""
WITH doc AS (
  SELECT DISTINCT ON (capture_id) capture_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]*)', 1)) AS site, markdown FROM captures WHERE markdown IS NOT NULL ORDER BY capture_id
), line AS (
  SELECT capture_id, site, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS line_no FROM doc
), same AS (
  SELECT capture_id, site, line_no, lower(regexp_replace(line, '[\s\pZ\x{85}\x{1c}-\x{1f}\x{0b}]+', '', 'g')) AS line FROM line WHERE regexp_matches(line, '[\pL\pN]')
), total AS (SELECT site, count(*) AS n FROM doc GROUP BY site),
often AS (
  SELECT s.site, s.line FROM same s JOIN total t ON t.site = s.site GROUP BY s.site, s.line, t.n HAVING count(DISTINCT capture_id) >= 5 AND count(DISTINCT capture_id) * 10 >= t.n
)
SELECT capture_id, line_no FROM same JOIN often USING (site, line)
"""
P7_CLEAN_SQL = f"""
WITH found AS ({P7_SQL}), gone AS (SELECT capture_id, list(line_no) AS lines FROM found GROUP BY 1),
doc AS (SELECT DISTINCT ON (capture_id) capture_id, markdown FROM captures WHERE markdown IS NOT NULL ORDER BY capture_id)
SELECT capture_id, CASE WHEN lines IS NULL THEN markdown ELSE array_to_string(list_filter(string_split(markdown, chr(10)), lambda line, i: NOT list_contains(lines, i)), chr(10)) END AS markdown FROM doc LEFT JOIN gone USING (capture_id)
"""
