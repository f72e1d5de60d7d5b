"""Pinned snapshots of folders of Parquet files: what a training run read can be read again after later appends.

A snapshot is a tree of digests. A file's digest is that of its rows (``row_digest``), a folder's that of its files' names and digests, the
snapshot's that of its folders. A folder's list of files is stored under its digest, so snapshots share the lists of folders that did
not change, and two snapshots are compared folder by folder: only lists of folders whose digests differ are opened. A new snapshot
opens only data files that its predecessor did not know by name, size and time.

Spark lists and digests the files; to the driver come names of files (as in any scan) and one digest per snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featureline.errors import FeaturelineError
from featureline.operators.profile import row_digest

FILES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("modified", T.TimestampType()),
    T.StructField("n_rows", T.LongType()), T.StructField("file_digest", T.StringType()), T.StructField("digest", T.StringType())])
FOLDERS = T.StructType([
    T.StructField("folder", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n_files", T.LongType()),
    T.StructField("n_rows", T.LongType()), T.StructField("n_bytes", T.LongType())])
_AS_TEXT = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_STAMP = ["folder", "file", "n_bytes", "modified"]


def _place() -> list[Column]:
    return [F.regexp_extract("_at", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("_at", "([^/]*)$", 1).alias("file")]


class SnapshotBroken(FeaturelineError):
    """Files of a snapshot are gone or hold other rows."""


class Snapshots:
    """Snapshots of the files below ``path``, kept in ``store`` (a folder outside it)."""

    def __init__(self, spark: SparkSession, path: str, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._target = jvm.org.apache.hadoop.fs.Path
        self._files = self._target(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = self._files.makeQualified(self._target(path)).toString().rstrip("/")

    def _there(self, path: str) -> bool:
        return self._files.exists(self._target(path))

    def _relative(self) -> Column:
        """The path of a row's file below ``path``; metadata hold it as a URI."""
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return F.substring(F.regexp_replace(plain, "^file:/+", "file:/"), len(self.path) + 2, 1_000_000)

    def listing(self) -> DataFrame:
        """``folder`` (below the path, empty for the path itself), ``file``, ``n_bytes``, ``modified`` of all Parquet files; nothing is opened."""
        if not self._there(self.path):
            return self.spark.createDataFrame([], T.StructType([T.StructField("folder", T.StringType()), *FILES.fields[:3]]))
        found = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path)
                 .select(self._relative().alias("_at"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")))
        return found.select(*_place(), "n_bytes", "modified")

    def _names(self, files: DataFrame) -> list[str]:
        at = F.concat_ws("/", F.lit(self.path), F.when(F.col("folder") != "", F.col("folder")), "file")
        return [r[0] for r in files.select(at).orderBy(at).collect()]

    def _digests(self, files: DataFrame) -> DataFrame:
        """``folder``, ``file``, ``n_rows`` and ``file_digest`` of the given files; files without rows are left out.

        Columns count by name and null as absent, so a file's digest doesn't depend on the files it is read with, nor on the session's zone.
        """
        found = self.spark.createDataFrame([], "folder string, file string, n_rows long, file_digest string")
        tables: dict[str, list[str]] = {}
        for name in self._names(files):  # folders like day=1 belong to the table above them
            folder = name[len(self.path) + 1:].rpartition("/")[0]
            tables.setdefault("/".join(p for p in folder.split("/") if "=" not in p), []).append(name)
        for names in tables.values():
            rows = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*names)
            whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), _AS_TEXT)
            found = found.unionByName(rows.select(whole.alias("_row"), self._relative().alias("_at")).groupBy(*_place()).agg(
                F.count(F.lit(1)).alias("n_rows"), row_digest(["_row"]).alias("file_digest")))
        return found

    def take(self, since: str | None = None) -> str:
        """The id of a snapshot of what is there now. Files that the snapshot ``since`` has with the same name, size and time are not opened.

        The same rows in files of the same names give the same id. A file without rows has the digest of none.
        """
        now = self.listing()
        if since:
            known = self.files(since).select(*_STAMP, "n_rows", "file_digest")
            kept, fresh = now.join(known, _STAMP), now.join(known, _STAMP, "left_anti")
        else:
            kept, fresh = None, now
        made = fresh.join(self._digests(fresh), ["folder", "file"], "left").withColumns({
            "n_rows": F.coalesce("n_rows", F.lit(0).cast("long")), "file_digest": F.coalesce("file_digest", F.lit("0-0"))})
        columns = [*_STAMP, "n_rows", "file_digest"]
        whole = made.select(*columns) if kept is None else made.select(*columns).unionByName(kept.select(*columns))
        draft = f"{self.store}/drafts/{self.spark.range(1).select(F.uuid()).first()[0]}"
        whole.write.parquet(draft)  # what follows reads the same digests
        whole = self.spark.read.schema(whole.schema).parquet(draft)
        folders = whole.groupBy("folder").agg(
            F.md5(row_digest(["file", "n_rows", "file_digest"]).cast("binary")).alias("digest"), F.count(F.lit(1)).alias("n_files"),
            F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        snapshot = folders.agg(F.md5(row_digest(["folder", "digest"]).cast("binary"))).first()[0]
        if not self._there(f"{self.store}/snapshots/{snapshot}/_SUCCESS"):
            listed = self._stored().select("digest").distinct()
            new = folders.join(listed, "digest", "left_anti").groupBy("digest").agg(F.min("folder").alias("folder"))
            (whole.join(new, "folder").select(*FILES.fieldNames()).repartition("digest")
             .write.mode("append").partitionBy("digest").parquet(f"{self.store}/folders"))
            folders.select(*FOLDERS.fieldNames()).write.mode("overwrite").parquet(f"{self.store}/snapshots/{snapshot}")
        self._files.delete(self._target(draft), True)
        return snapshot

    def _stored(self, digests: list[str] | None = None) -> DataFrame:
        """Stored lists of files, or those of the given folder digests; no others are opened."""
        base = f"{self.store}/folders"
        paths = [base] if digests is None else [f"{base}/digest={d}" for d in digests]
        if not paths or not self._there(base):
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).option("basePath", base).parquet(*paths)

    def folders(self, snapshot: str) -> DataFrame:
        """``folder``, ``digest``, ``n_files``, ``n_rows``, ``n_bytes`` of a snapshot."""
        return self.spark.read.schema(FOLDERS).parquet(f"{self.store}/snapshots/{snapshot}")

    def _files_of(self, folders: DataFrame) -> DataFrame:
        digests = sorted(r[0] for r in folders.select("digest").distinct().collect())
        lists = self._stored(digests).dropDuplicates(["digest", "file"])  # two writers may have stored one list twice
        return folders.select("folder", "digest").join(lists, "digest")

    def files(self, snapshot: str, table: str | None = None) -> DataFrame:
        """All files of a snapshot, or those below one folder of it (or that one file)."""
        folders = self.folders(snapshot)
        if table is None:
            return self._files_of(folders)
        parent, _, name = table.rpartition("/")
        below = (F.col("folder") == table) | F.col("folder").startswith(f"{table}/")
        files = self._files_of(folders.where(below | (F.col("folder") == parent)))
        return files.where(below | ((F.col("folder") == parent) & (F.col("file") == name)))

    def diff(self, before: str, after: str) -> DataFrame:
        """Files that two snapshots don't share: ``folder``, ``file``, ``change`` (added, removed, changed), ``n_rows_before``, ``n_rows_after``."""
        old, new = self.folders(before), self.folders(after)
        same = old.join(new, ["folder", "digest"], "left_semi").select("folder")
        side = lambda folders, name: self._files_of(folders.join(same, "folder", "left_anti")).select(
            "folder", "file", F.col("n_rows").alias(f"n_rows_{name}"), F.col("file_digest").alias(f"_{name}"))
        both = side(old, "before").join(side(new, "after"), ["folder", "file"], "full")
        change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
        return both.where(~F.col("_before").eqNullSafe(F.col("_after"))).select(
            "folder", "file", change.alias("change"), "n_rows_before", "n_rows_after")

    def broken(self, snapshot: str, table: str | None = None) -> DataFrame:
        """Files of a snapshot that are gone or hold other rows: ``folder``, ``file``. Opens only files whose size or time differ."""
        kept = self.files(snapshot, table).select(*_STAMP, "file_digest")
        now = self.listing()
        gone = kept.join(now, ["folder", "file"], "left_anti").select("folder", "file")
        touched = now.join(kept, _STAMP, "left_anti").join(kept, ["folder", "file"], "left_semi")
        held = self._digests(touched).select("folder", "file", F.col("file_digest").alias("_now"))
        other = kept.join(touched.select("folder", "file"), ["folder", "file"]).join(held, ["folder", "file"], "left").where(
            F.col("file_digest") != F.coalesce("_now", F.lit("0-0")))
        return gone.unionByName(other.select("folder", "file"))

    def read(self, snapshot: str, table: str | None = None) -> DataFrame:
        """The rows of a snapshot, or of one folder of it, whatever was appended since. Folder names like ``day=1`` are columns, as in any scan."""
        names = self._names(self.files(snapshot, table))
        if not names:
            raise SnapshotBroken(f"{snapshot} has no files in {table or self.path}")
        if wrong := [f"{r['folder']}/{r['file']}" for r in self.broken(snapshot, table).take(5)]:
            raise SnapshotBroken(", ".join(wrong))
        base = f"{self.path}/{table}" if table and names != [f"{self.path}/{table}"] else self.path
        return self.spark.read.option("basePath", base).parquet(*names)
