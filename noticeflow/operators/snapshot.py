"""Public snapshot: tables without private columns, checks, a hash tree over them, publication of what has changed."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are emptied before publication, by table.
PRIVATE = {"notices": ("editorial_notes", "content_hash"), "sources": ("last_success_at", "last_error", "technical_notes"), "attachments": ("content_hash", "extracted_text", "indexed_at")}
DEMO_TYPE, SCHEMA_VERSION, MISSING = "third-sector-hub", "1", "\x00"
_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), below a folder of
    our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="noticeflow-"))
        base = "file://" + _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _without(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns if c in rows.columns})


def public_tables(notices: DataFrame, sources: DataFrame, attachments: DataFrame, keep=None) -> dict[str, DataFrame]:
    """The approved notices of sources that are no demo, those sources, and those notices' attachments, each without its
    private columns; sources count as active. keep(rows, name) may write the rows out and read them back; the other tables
    then meet the notices so read, which are joined once."""
    approved = notices.where("editorial_status = 'approved'")
    real = sources.where(F.col("source_type") != DEMO_TYPE)
    shown = _without(approved.hint("merge").join(real.select(F.col("id").alias("source_id")).hint("merge"), "source_id", "left_semi"), PRIVATE["notices"])
    if keep:
        shown = keep(shown, "notices")
    used = real.hint("merge").join(shown.select(F.col("source_id").alias("id")).distinct().hint("merge"), "id", "left_semi").withColumn("status", F.lit("active"))
    held = attachments.hint("merge").join(shown.select(F.col("id").alias("notice_id")).hint("merge"), "notice_id", "left_semi")
    others = {name: _without(rows, PRIVATE[name]) for name, rows in (("sources", used), ("attachments", held))}
    return {"notices": shown} | ({name: keep(rows, name) for name, rows in others.items()} if keep else others)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _bucket(key: str) -> Column:
    return F.substring(F.sha2(_text(key), 256), 1, 2)


def _sum60(c: str) -> Column:
    """The sum of numbers below 2**60 in digits: high and low 30 bits are summed as longs, which is exact for 2**33 rows."""
    high, low = F.sum(F.shiftright(c, 30)), F.sum(F.col(c).bitwiseAND((1 << 30) - 1))
    return (high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("string")


def bucket_digests(rows: DataFrame, columns: list[str], key: str = "id", counted: dict[str, Column] | None = None) -> DataFrame:
    """(bucket, n, digest): leaves of a hash tree. A row lies in the bucket of its key's hash; a bucket's digest is that of the
    number of its rows and of the sums of their hashes' halves, so order and partitions don't matter. With conditions to be
    counted also `broken`, an array of (rule, violations), from the same scan."""
    checks = {} if counted is None else counted
    named = {f"__{k}": c for k, c in enumerate(checks.values())}
    hashed = rows.select(_bucket(key).alias("bucket"), F.sha2(F.concat_ws("\x1f", *map(_text, columns)), 256).alias("h"), *[c.alias(k) for k, c in named.items()])
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    parts = hashed.select("bucket", part(1).alias("a"), part(33).alias("b"), *named)
    broken = F.array(*[F.struct(F.lit(rule).alias("rule"), F.count_if(k).alias("violations")) for rule, k in zip(checks, named, strict=True)]).alias("broken")
    sums = parts.groupBy("bucket").agg(F.count("*").alias("n"), _sum60("a").alias("a"), _sum60("b").alias("b"), *([broken] if checks else []))
    return sums.select("bucket", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "a", "b"), 256).alias("digest"), *(["broken"] if checks else []))


def hash_tree(tables: dict[str, DataFrame], columns: dict[str, list[str]], check: bool = False) -> DataFrame:
    """(table_name, bucket, n, digest) of all tables; at most 256 rows for each. With check also `broken`, how many rows of the
    bucket break each of the table's rules."""
    leaves = [bucket_digests(rows, columns[name], counted=_checks(name, rows) if check else None).select(F.lit(name).alias("table_name"), "*") for name, rows in tables.items()]
    return functools.reduce(DataFrame.unionByName, leaves)


def content_digest(tree: DataFrame) -> str:
    """The root of a hash tree."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "table_name", "bucket", F.col("n").cast("string"), "digest"))), "\n")
    return tree.agg(F.sha2(lines, 256)).first()[0]


def metadata(tree: DataFrame, generated_at: str) -> DataFrame:
    """(key, value): schema version, time, rows of each table, root digest."""
    counts = {r.table_name: r.n for r in tree.groupBy("table_name").agg(F.sum("n").alias("n")).collect()}
    values = {"schema_version": SCHEMA_VERSION, "generated_at": generated_at, "content_digest": content_digest(tree)} | {f"{t}_count": str(counts.get(t, 0)) for t in PRIVATE}
    return tree.sparkSession.createDataFrame(sorted(values.items()), "key string, value string")


def _checks(name: str, rows: DataFrame) -> dict[str, Column]:
    """The rules of a table's rows: what must not be true."""
    rules = {"notices": {"only_approved": F.col("editorial_status") != "approved", "title_missing": F.coalesce("title", F.lit("")) == ""}, "sources": {"name_missing": F.coalesce("name", F.lit("")) == ""}, "attachments": {}}
    links = {"notices": ("official_url", "organization_url"), "sources": ("base_url",), "attachments": ("url",)}
    checks = {f"{name}_{rule}": check for rule, check in rules[name].items()}
    urls = [c for c in links[name] if c in rows.columns]
    private = [c for c in PRIVATE[name] if c in rows.columns]
    checks[f"{name}_url_credentials"] = functools.reduce(lambda a, b: a | b, (F.coalesce(F.col(c).contains("@") & F.col(c).rlike("://[^/?#]*@"), F.lit(False)) for c in urls))
    checks[f"{name}_private"] = functools.reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in private), F.lit(False))
    return checks


def violations(tables: dict[str, DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """(rule, violations): one scan for all rules of a table, and those on the metadata."""
    spark = next(iter(tables.values())).sparkSession
    found, counts = [], {}
    for name, rows in tables.items():
        if name not in PRIVATE:
            found.append(spark.createDataFrame([(f"unexpected_table_{name}", 1)], "rule string, violations long"))
            continue
        checks = _checks(name, rows)
        if meta is not None:
            counts[name] = rows
        found.append(rows.agg(*[F.count_if(c).alias(k) for k, c in checks.items()]).unpivot([], list(checks), "rule", "violations"))
    if meta is not None:
        value = dict(map(tuple, meta.collect()))  # a handful of rows
        bad = {"schema_version": value.get("schema_version") != SCHEMA_VERSION, "content_digest": not re.fullmatch("[0-9a-f]{64}", value.get("content_digest") or ""), "generated_at": not re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?", value.get("generated_at") or "")}
        bad |= {f"{t}_missing": t not in tables for t in PRIVATE}
        bad |= {f"{name}_count": value.get(f"{name}_count") != str(rows.count()) for name, rows in counts.items()}
        found.append(spark.createDataFrame([(f"metadata_{k}", int(v)) for k, v in sorted(bad.items())], "rule string, violations long"))
    return functools.reduce(DataFrame.unionByName, found)


class Publication:
    """Versions of the public tables below a path. A version writes the buckets whose digest has changed and a manifest that
    says for every bucket in which version it lies; it counts once its line in the pointers is there."""

    POINTER = "version long, digest string"
    MANIFEST = "table_name string, bucket string, n long, digest string, written long"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _last(self):
        try:
            return self.spark.read.schema(self.POINTER).json(f"{self.base}/pointer").orderBy(F.col("version").desc()).first()
        except Exception as e:  # there is no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _manifest(self, version: int | None) -> DataFrame:
        return self.spark.createDataFrame([], self.MANIFEST) if version is None else self.spark.read.schema(self.MANIFEST).parquet(f"{self.base}/manifest/version={version}")

    def _refuse(self, found: DataFrame) -> None:
        if broken := found.where("violations > 0").collect():
            raise ValueError(f"not fit for publication: {sorted(r.rule for r in broken)}")

    def publish(self, tables: dict[str, DataFrame], columns: dict[str, list[str]], check: bool = True) -> DataFrame:
        """(table_name, bucket, change) of what was added, changed or removed; without rows nothing was published. Tables that
        break a rule are refused."""
        if check and not tables.keys() <= PRIVATE.keys():
            self._refuse(violations(tables))
        last = self._last()
        old = self._manifest(last and last.version).select("table_name", "bucket", F.col("digest").alias("old"), "written")
        path = scratch(self.spark, "tree")
        hash_tree(tables, columns, check).write.parquet(path)
        tree = self.spark.read.parquet(path)
        if check:
            self._refuse(tree.select(F.explode("broken").alias("b")).groupBy("b.rule").agg(F.sum("b.violations").alias("violations")))
        version = 1 if last is None else last.version + 1
        both = tree.join(old.hint("merge"), ["table_name", "bucket"], "full")
        change = F.when(F.col("digest").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("digest") != F.col("old"), "changed")
        leaves = both.select("table_name", "bucket", change.alias("change")).collect()  # at most 512 for each table
        changes = [r for r in leaves if r.change]
        for name, rows in tables.items():
            held = {r.bucket: r.change for r in leaves if r.table_name == name and r.change != "removed"}
            fresh = sorted(b for b, c in held.items() if c)
            if fresh:
                marked = rows.withColumn("bucket", _bucket("id"))
                some = marked if len(fresh) == len(held) else marked.where(F.col("bucket").isin(*fresh))
                some.repartition(len(fresh), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{name}/version={version}")
        if changes:
            written = F.when(F.col("old").isNull() | (F.col("digest") != F.col("old")), F.lit(version)).otherwise(F.col("written")).cast("long")
            both.where("digest is not null").select("table_name", "bucket", "n", "digest", written.alias("written")).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/version={version}")
            self.spark.createDataFrame([(version, content_digest(tree))], self.POINTER).coalesce(1).write.mode("append").json(f"{self.base}/pointer")
        return self.spark.createDataFrame(changes, "table_name string, bucket string, change string")

    def current(self, name: str, schema) -> DataFrame:
        last = self._last()
        held = self._manifest(last and last.version).where(F.col("table_name") == name).select("bucket", "written").collect()
        paths = [f"{self.base}/{name}/version={r.written}/bucket={r.bucket}" for r in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
