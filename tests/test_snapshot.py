"""The public snapshot: what it leaves out, its hash tree, publication by buckets, and every rule of the checks."""

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import snapshot

COLUMNS = {"notices": ["id", "source_id", "title", "editorial_status", "official_url"], "sources": ["id", "name", "base_url", "status"], "attachments": ["id", "notice_id", "url"]}


@pytest.fixture(scope="module")
def given(spark):
    notices = [(i, i % 5, f"Bando {i}", "approved" if i % 4 else "hidden", "note" if i % 3 else None, f"https://e.example/{i}") for i in range(600)]
    sources = [(i, f"Fonte {i}", "third-sector-hub" if i == 4 else "html-list", f"https://s{i}.example", "retired", "err") for i in range(7)]
    held = [(f"{i}-{k}", i, f"https://e.example/{i}/{k}.pdf", "text") for i in range(600) for k in range(2)]
    return (
        spark.createDataFrame(notices, "id long, source_id long, title string, editorial_status string, editorial_notes string, official_url string"),
        spark.createDataFrame(sources, "id long, name string, source_type string, base_url string, status string, last_error string"),
        spark.createDataFrame(held, "id string, notice_id long, url string, extracted_text string"),
    )


def test_export(given):
    tables = snapshot.public_tables(*given)
    ids = {i for i in range(600) if i % 4 and i % 5 != 4}
    assert {r.id for r in tables["notices"].collect()} == ids
    assert {(r.id, r.status, r.last_error) for r in tables["sources"].collect()} == {(i, "active", None) for i in range(4)}
    assert {(r.notice_id, r.extracted_text) for r in tables["attachments"].collect()} == {(i, None) for i in ids}
    assert {r.rule: r.violations for r in snapshot.violations(tables).collect() if r.violations} == {}


def test_tree_ignores_order_and_tells_nulls_apart(spark, given):
    tables = snapshot.public_tables(*given)
    tree = snapshot.hash_tree(tables, COLUMNS)
    root = snapshot.content_digest(tree)
    assert root == snapshot.content_digest(snapshot.hash_tree({k: v.repartition(7).orderBy(F.desc("id")) for k, v in tables.items()}, COLUMNS))
    a, b = (spark.createDataFrame([(1, x, y)], "id long, a string, b string") for x, y in ((None, "t"), ("t", None)))
    assert snapshot.bucket_digests(a, ["id", "a", "b"]).first().digest != snapshot.bucket_digests(b, ["id", "a", "b"]).first().digest


def test_a_changed_row_writes_one_bucket(spark, given, tmp_path):
    tables = snapshot.public_tables(*given)
    target = snapshot.Publication(spark, str(tmp_path))
    count = lambda changes: sorted((r.table_name, r.change) for r in changes.collect())
    leaves = snapshot.hash_tree(tables, COLUMNS).count()
    assert len(count(target.publish(tables, COLUMNS))) == leaves
    assert count(target.publish(tables, COLUMNS)) == [] and target._last().version == 1
    other = tables | {"notices": tables["notices"].withColumn("title", F.when(F.col("id") == 7, "altro").otherwise(F.col("title")))}
    assert count(target.publish(other, COLUMNS)) == [("notices", "changed")] and target._last().version == 2
    assert len(list((tmp_path / "notices" / "version=2").glob("bucket=*"))) == 1 and not (tmp_path / "sources" / "version=2").exists()
    less = other | {"sources": other["sources"].where("id <> 3")}
    assert count(target.publish(less, COLUMNS)) == [("sources", "removed")]
    more = less | {"sources": less["sources"].unionByName(tables["sources"].where("id = 3").withColumn("id", F.lit(99).cast("long")))}
    assert count(target.publish(more, COLUMNS)) == [("sources", "added")] and target._last().version == 4
    for name, rows in more.items():
        assert sorted(map(tuple, target.current(name, rows.schema).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    # a version that broke off before its line counts for nothing and is written again
    (tmp_path / "notices" / "version=5" / "bucket=00").mkdir(parents=True)
    assert count(target.publish(tables | {"sources": more["sources"]}, COLUMNS)) == [("notices", "changed")]
    assert target.current("notices", tables["notices"].schema).count() == tables["notices"].count()


def test_every_rule_finds_its_case(spark, given):
    tables = snapshot.public_tables(*given)
    meta = snapshot.metadata(snapshot.hash_tree(tables, COLUMNS), "2026-05-31T06:00:00+00:00")
    broken = lambda t, m=meta: {r.rule: r.violations for r in snapshot.violations(t, m).collect() if r.violations}
    assert broken(tables) == {}
    n, s, a = tables["notices"], tables["sources"], tables["attachments"]
    when = lambda c, i, v: F.when(F.col("id") == i, v).otherwise(F.col(c))
    cases = [
        (tables | {"notices": n.withColumn("editorial_status", when("editorial_status", 1, F.lit("pending")))}, {"notices_only_approved": 1}),
        (tables | {"notices": n.withColumn("title", when("title", 1, F.lit("")))}, {"notices_title_missing": 1}),
        (tables | {"notices": n.withColumn("official_url", when("official_url", 1, F.lit("https://u:p@e.example")))}, {"notices_url_credentials": 1}),
        (tables | {"notices": n.withColumn("editorial_notes", when("editorial_notes", 1, F.lit("x")))}, {"notices_private": 1}),
        (tables | {"sources": s.withColumn("base_url", when("base_url", 1, F.lit("https://u@e.example/a")))}, {"sources_url_credentials": 1}),
        (tables | {"sources": s.withColumn("last_error", when("last_error", 1, F.lit("x")))}, {"sources_private": 1}),
        (tables | {"attachments": a.withColumn("url", F.when(F.col("id") == "1-0", "http://u@x").otherwise(F.col("url")))}, {"attachments_url_credentials": 1}),
        (tables | {"attachments": a.withColumn("extracted_text", F.when(F.col("id") == "1-0", "x"))}, {"attachments_private": 1}),
        (tables | {"notices": n.unionByName(n.where("id = 1"))}, {"metadata_notices_count": 1}),
        (tables | {"email_logs": n}, {"unexpected_table_email_logs": 1}),
        ({k: v for k, v in tables.items() if k != "sources"}, {"metadata_sources_missing": 1}),
    ]
    for made, expected in cases:
        assert broken(made) == expected
    for key, value in (("schema_version", "9"), ("content_digest", "xyz"), ("generated_at", "ieri"), ("sources_count", "5")):
        other = meta.withColumn("value", F.when(F.col("key") == key, value).otherwise(F.col("value")))
        assert broken(tables, other) == {f"metadata_{key}": 1}
    with pytest.raises(ValueError, match="notices_private"):
        snapshot.Publication(spark, "/nonexistent").publish(cases[3][0], COLUMNS)


def test_a_version_is_read_once(spark, given, tmp_path):
    tables = snapshot.public_tables(*given)
    target = snapshot.Publication(spark, str(tmp_path))
    target.publish(tables, COLUMNS)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert target.publish({name: rows.mapInArrow(passed, rows.schema) for name, rows in tables.items()}, COLUMNS).count() == 0
    assert seen.value == sum(rows.count() for rows in tables.values())


def test_rules_counted_with_the_tree(spark, given):
    tables = snapshot.public_tables(*given)
    tables |= {"notices": tables["notices"].withColumn("official_url", F.when(F.col("id") % 7 == 0, "https://u:p@e.example").when(F.col("id") % 7 == 1, "https://e.example/a@b").when(F.col("id") % 7 == 2, None).otherwise(F.col("official_url"))), "sources": tables["sources"].withColumn("last_error", F.when(F.col("id") == 1, "x"))}
    tree = snapshot.hash_tree(tables, COLUMNS, check=True)
    counted = tree.select(F.explode("broken").alias("b")).groupBy("b.rule").agg(F.sum("b.violations")).collect()
    found = {r.rule: r.violations for r in snapshot.violations(tables).collect()}
    assert dict(map(tuple, counted)) == found and found["notices_url_credentials"] > 0 and found["sources_private"] == 1
    assert sorted(map(tuple, tree.drop("broken").collect())) == sorted(map(tuple, snapshot.hash_tree(tables, COLUMNS).collect()))


def test_sums_of_60_bits_are_exact(spark):
    values = [(1 << 60) - 1 - i * 977 for i in range(1000)]
    assert spark.createDataFrame([(v,) for v in values], "v long").agg(snapshot._sum60("v")).first()[0] == str(sum(values))
