"""Versioned Parquet tables under one atomic pointer, and the maintenance of the index on them.

A table is cut into buckets by a hash of its key, and every bucket has a version of its own. One small file names the
current version of each bucket of all tables and is replaced as a whole, by an atomic rename, after everything new is
written: a reader sees all tables before a change or all after it, and a write that fails anywhere changes nothing. A
change rewrites the buckets it touches, whose number grows with the documents, so that a bucket stays of one size.
All file access goes through Hadoop's file systems, so a home on shared storage works as a local one does. There is
one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("hash", "subject", "kind")]))
_TEXTS = ("question", "answer", "answer_summary", "summary", "branch", "cwd", "session_title", "session_id", "agent", "lang", "root", "sha", "full_sha")
DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "source_type", "repo", "path", "title", "text")]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("tools", "files")]
    + [T.StructField("commits", COMMIT), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("version", T.LongType())]
)
SCHEMAS = {
    "documents": DOCUMENT,
    "postings": T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]),
    "doc_len": T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("dl", T.IntegerType())]),
    "vectors": T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("model_id", T.StringType())]),
    "index_state": T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]),
}


KEYS = {"documents": "id", "postings": "doc_id", "doc_len": "doc_id", "vectors": "doc_id", "index_state": "key"}
#: Buckets of a new index, and documents of a bucket from which their number is multiplied by GROWTH.
BUCKETS, BUCKET_DOCUMENTS, GROWTH = 16, 200_000, 4


def conform(df: DataFrame, schema: T.StructType = DOCUMENT) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are NULL, further ones are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def last_writer(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` put in or replaced by ``key``; of several new rows of a key the one of the largest
    ``version`` counts (then the smallest by all columns as text). Rows of ``new`` without key are ignored."""
    tie = F.to_json(F.struct(*[c for c in new.columns if c != "version"]))
    order = [F.desc_nulls_last("version"), tie] if "version" in new.columns else [tie]
    new = new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``new`` whose ``value`` is not what ``old`` has for the key (also where ``old`` has none)."""
    before = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return new.join(before, new[key] == F.col("_k"), "left").where(~F.col("_v").eqNullSafe(F.col(value)) | F.col("_k").isNull()).drop("_k", "_v")


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that ``old`` has and ``new`` lacks."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


class Store:
    """The tables of an index under one home folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.home))

    # -- versions ---------------------------------------------------------------------------------------------
    def _manifest(self) -> dict:
        """The current versions: {buckets, rows, tables: {name: {bucket: version}}, before: {name: [version]}}."""
        p = self._path(f"{self.home}/CURRENT")
        if not self._fs.exists(p):
            if any(self._versions(name) for name in SCHEMAS):
                raise RuntimeError(f"{self.home} has tables but no CURRENT file; nothing is read or deleted before it is restored")
            return {"buckets": BUCKETS, "rows": 0, "tables": {}, "before": {}}
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.home}/{name}")
        return [f.getPath().getName() for f in self._fs.listStatus(folder) if f.isDirectory()] if self._fs.exists(folder) else []

    def _point(self, manifest: dict) -> None:
        """Replaces the pointer by an atomic rename."""
        tmp = f"{self.home}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(tmp), True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(self._path(tmp)), context.makeQualified(self._path(f"{self.home}/CURRENT")), how)

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """The current version of a table, or of some of its buckets; empty before the first."""
        of = self._manifest()["tables"].get(name, {})
        paths = [f"{self.home}/{name}/{v}/_b={b}" for b, v in of.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame) -> None:
        """A new version of a whole table."""
        self.replace({name: df})

    def replace(self, tables: dict[str, DataFrame], touched: set[int] | None = None, rows: int | None = None, buckets: int | None = None) -> None:
        """New versions of tables, or of their ``touched`` buckets, all at once. What they replace stays until the next
        change, as plans may still read it. ``rows``: documents after the change; ``buckets``: their new number."""
        m = self._manifest()
        count, v = buckets or m["buckets"], f"v-{uuid.uuid4().hex}"
        after = {name: dict(of) for name, of in m["tables"].items()}
        for name, df in tables.items():
            key = KEYS[name]
            order = ["_b", "token", "doc_id"] if name == "postings" else ["_b", key]  # by token, so that a prefix reads few row groups
            out = conform(df, SCHEMAS[name]).withColumn("_b", self._bucket(F.col(key), count))
            out.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("_b").parquet(f"{self.home}/{name}/{v}")
            new = {f.getPath().getName()[3:]: v for f in self._fs.listStatus(self._path(f"{self.home}/{name}/{v}")) if f.getPath().getName().startswith("_b=")}
            kept = {} if touched is None else {b: x for b, x in after.get(name, {}).items() if int(b) not in touched}
            after[name] = kept | new
        before = {name: sorted(set(of.values())) for name, of in m["tables"].items()}
        self._point({"buckets": count, "rows": m["rows"] if rows is None else rows, "tables": after, "before": before})
        for name in SCHEMAS:  # only what neither this pointer nor the last one names goes
            for x in self._versions(name):
                if x not in after.get(name, {}).values() and x not in before.get(name, []):
                    self._fs.delete(self._path(f"{self.home}/{name}/{x}"), True)

    @staticmethod
    def _bucket(key: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def _touched(self, ids: DataFrame) -> set[int]:
        """The buckets of keys (one column)."""
        return {r[0] for r in ids.select(self._bucket(F.col(ids.columns[0]), self._manifest()["buckets"])).distinct().collect()}

    # -- documents --------------------------------------------------------------------------------------------
    def upsert(self, docs: DataFrame, masked: bool = True, vectors: DataFrame | None = None, high_entropy: bool = False) -> int:
        """Puts documents in by id, masks their secrets first, and refreshes postings, lengths and vectors; returns their number.

        A stored vector stays only while its document's text does. ``vectors``: (doc_id, vec, model_id) of the new ones;
        ``high_entropy`` masks tokens that look secret too.
        """
        from ..functions.redact import redact_columns
        from ..session import cut
        from .search import doc_lengths, postings

        new = conform(docs)
        if masked:
            texts = ["text", "title", "question", "answer", "answer_summary", "summary"]
            new = redact_columns(new, texts, high_entropy=high_entropy).drop("n_masked")
        new = cut(last_writer(self.spark.createDataFrame([], DOCUMENT), new))
        n = new.count()
        if not n:
            return 0
        m = self._manifest()
        grown = m["rows"] + n > BUCKET_DOCUMENTS * m["buckets"]
        touched = None if grown else self._touched(new.select("id"))
        old = self.read("documents", touched)
        same = new.join(old.select("id", F.col("text").alias("_t")), "id").where(F.col("text").eqNullSafe(F.col("_t"))).select(F.col("id").alias("doc_id"))
        ids = new.select(F.col("id").alias("doc_id"))
        indexed = new.withColumn("text", F.when(F.coalesce("summary", F.lit("")) != "", F.concat_ws("\n", "summary", "text")).otherwise(F.col("text")))
        kept = self.read("vectors", touched).join(ids.join(same, "doc_id", "left_anti"), "doc_id", "left_anti")
        if vectors is not None:
            fresh = conform(vectors, SCHEMAS["vectors"])
            kept = kept.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
        tables = {
            "documents": old.join(new.select("id"), "id", "left_anti").unionByName(new),
            "postings": self.read("postings", touched).join(ids, "doc_id", "left_anti").unionByName(conform(postings(indexed), SCHEMAS["postings"])),
            "doc_len": self.read("doc_len", touched).join(ids, "doc_id", "left_anti").unionByName(conform(doc_lengths(indexed), SCHEMAS["doc_len"])),
            "vectors": kept,
        }
        known = old.join(ids.withColumnRenamed("doc_id", "id"), "id", "left_semi").count()
        self.replace(tables, touched, m["rows"] + n - known, m["buckets"] * GROWTH if grown else None)
        return n

    def get(self, doc_id: str) -> DataFrame:
        """The document of an id, read from its bucket alone."""
        return self.read("documents", self._touched(self.spark.createDataFrame([(doc_id,)], "id string"))).where(F.col("id") == doc_id)

    def _delete(self, gone: DataFrame) -> int:
        from ..session import cut

        gone = cut(gone.select(F.col("id").alias("doc_id")))
        n = gone.count()
        if n:
            touched = self._touched(gone)
            tables = {name: self.read(name, touched).join(gone.withColumnRenamed("doc_id", KEYS[name]), KEYS[name], "left_anti") for name in ("documents", "postings", "doc_len", "vectors")}
            self.replace(tables, touched, self._manifest()["rows"] - n)
        return n

    def delete_by_path(self, source_type: str, repo: str, path: str) -> int:
        """Removes the documents of a path with all that hangs on them; returns their number."""
        return self._delete(self.read("documents").where((F.col("source_type") == source_type) & (F.col("repo") == repo) & (F.col("path") == path)))

    def delete_paths(self, source_type: str, repo: str, paths: DataFrame) -> int:
        """The same for a table of paths (path)."""
        d = self.read("documents").where((F.col("source_type") == source_type) & (F.col("repo") == repo))
        return self._delete(d.join(paths, "path", "left_semi"))

    def forget_repo(self, repo: str) -> dict[str, int]:
        """Removes a repository's documents and its code and commit state; states of sessions stay."""
        n = self._delete(self.read("documents").where(F.col("repo") == repo))
        state = self.read("index_state")
        own = F.col("key").startswith(f"code:{repo}:") | (F.col("key") == f"commits:{repo}")
        gone = state.where(own).count()
        if gone:
            self.write("index_state", state.where(~own))
        return {"documents": n, "states": gone}

    def reset(self) -> int:
        """Empties all tables; returns the number of documents there were."""
        n = self.read("documents").count()
        self.replace({name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}, rows=0)
        return n

    def rescan(self) -> int:
        """Masks what is stored already and indexes the changed documents again; returns their number. Vectors stay."""
        from ..functions.redact import redact_columns
        from ..session import cut

        texts = ["text", "title", "question", "answer", "answer_summary", "summary"]
        hit = cut(redact_columns(self.read("documents"), texts).where("n_masked > 0").drop("n_masked"))
        vectors = cut(self.read("vectors").join(hit.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
        return self.upsert(hit, masked=False, vectors=vectors)

    def paths(self, source_type: str, repo: str) -> DataFrame:
        """(path) of the distinct paths of a type and repository."""
        return self.read("documents").where((F.col("source_type") == source_type) & (F.col("repo") == repo)).select("path").distinct()

    def put_vectors(self, vectors: DataFrame) -> None:
        """Puts vectors (doc_id, vec, model_id) in by document."""
        touched = self._touched(vectors.select("doc_id"))
        if touched:
            self.replace({"vectors": last_writer(self.read("vectors", touched), conform(vectors, SCHEMAS["vectors"]), "doc_id")}, touched)

    def migrate_vectors(self, legacy: DataFrame, model_id: str | None = None) -> int:
        """Takes over vectors stored as JSON text (doc_id, vec_json); rows that are no list of numbers are skipped."""
        v = legacy.select("doc_id", F.from_json("vec_json", "array<float>").alias("vec"), F.lit(model_id).alias("model_id")).where("vec is not null")
        self.put_vectors(v)
        return v.count()

    # -- state ------------------------------------------------------------------------------------------------
    def get_state(self, key: str) -> str | None:
        row = self.read("index_state").where(F.col("key") == key).first()
        return row["value"] if row else None

    def set_states(self, states: DataFrame | dict[str, str]) -> None:
        """Puts many states (key, value) in at once."""
        df = self.spark.createDataFrame(list(states.items()), SCHEMAS["index_state"]) if isinstance(states, dict) else states
        df = conform(df, SCHEMAS["index_state"]).where("key is not null")
        touched = self._touched(df.select("key"))
        if touched:
            self.replace({"index_state": last_writer(self.read("index_state", touched), df, "key")}, touched)

    def delete_states(self, keys: list[str]) -> None:
        drop = reduce(lambda a, b: a | b, [F.col("key") == k for k in keys], F.lit(False))
        self.write("index_state", self.read("index_state").where(~drop))

    MODEL = "meta:embedder_model_id"

    def embedder_id(self) -> str | None:
        return self.get_state(self.MODEL)
