"""Notice tables derived from the given tables; the same SQL serves Spark and, with VARCHAR for STRING, DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Reference time of every query that depends on time.
AS_OF = "1998-06-01 12:00:00"

VIEWS = {
    "fx_sources": """
SELECT CAST(c.c_custkey AS BIGINT) AS id, CONCAT('Fonte ', c.c_name) AS name,
 CASE c.c_custkey % 5 WHEN 0 THEN 'html-list' WHEN 1 THEN 'public-json-api' WHEN 2 THEN 'hospital-html-hub' WHEN 3 THEN 'xml-index' ELSE 'third-sector-hub' END AS source_type,
 CONCAT('https://ente', CAST(c.c_custkey AS STRING), '.example.org/bandi', CASE WHEN c.c_custkey % 9 = 0 THEN '?s=psicolog' ELSE '' END) AS base_url,
 r.r_name AS region, c.c_name AS organization,
 CASE WHEN c.c_custkey % 8 = 7 THEN 'retired' ELSE 'active' END AS status,
 CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(CONCAT('1998-05-', lpad(CAST(c.c_custkey % 28 + 1 AS STRING), 2, '0'), ' 06:00:00') AS TIMESTAMP) END AS last_success_at
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "fx_notices": """
SELECT CAST(o.o_orderkey AS BIGINT) AS id, CAST(o.o_custkey AS BIGINT) AS source_id,
 CONCAT('ext-', CAST(o.o_orderkey % 9000 AS STRING)) AS external_id,
 CONCAT(CASE o.o_orderkey % 8 WHEN 0 THEN 'Avviso pubblico per psicologo' WHEN 1 THEN 'Concorso pubblico dirigente psicoterapeuta'
  WHEN 2 THEN 'Borsa di ricerca in neuropsicologia' WHEN 3 THEN 'Mobilità volontaria assistente sociale' WHEN 4 THEN 'Graduatoria finale psicologo'
  WHEN 5 THEN 'Manifestazione di interesse sportello ascolto scolastico' WHEN 6 THEN 'Concorsi e selezioni' ELSE 'Incarico professionale LM-51 in RSA' END,
  ' n. ', CAST(o.o_orderkey % 7 AS STRING), ' posti') AS title,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Richiesta laurea in psicologia e iscrizione all''albo degli psicologi, sezione A.' WHEN 1 THEN 'Servizio psicologico per minori e famiglia.'
  WHEN 2 THEN 'Approvazione graduatoria e presa d''atto dell''esito.' WHEN 3 THEN 'Esperienza minima nelle cure primarie; salute mentale.' ELSE NULL END AS description,
 c.c_name AS organization, c.c_mktsegment AS entity_type, r.r_name AS region, n.n_name AS province, o.o_orderpriority AS category,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'minori-famiglia,psicoterapia' WHEN 1 THEN 'anziani' WHEN 2 THEN 'ricerca,neuropsicologia,anziani' ELSE '' END AS areas_csv,
 CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'review' END AS stored_status,
 CASE o.o_orderkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'hidden' WHEN 2 THEN 'hidden' ELSE 'approved' END AS editorial_status,
 CASE o.o_orderkey % 10 WHEN 1 THEN 'Nascosto automaticamente: scadenza superata.' WHEN 2 THEN 'Nota redazionale manuale' ELSE NULL END AS editorial_notes,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderdate END AS deadline,
 CONCAT('Scadenza domande: ', lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o.o_orderdate) AS STRING)) AS deadline_text,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate END AS published_at, o.o_orderdate AS updated_at,
 CAST(o.o_orderkey % 101 AS INT) AS relevance_score, o.o_orderkey % 13 = 0 AS is_featured,
 CASE WHEN o.o_orderkey % 6 = 0 THEN CONCAT('https://Ente', CAST(o.o_custkey AS STRING), '.example.org/bandi/', CAST(o.o_orderkey % 500 AS STRING), '/')
  WHEN o.o_orderkey % 6 = 1 THEN CONCAT('https://ente', CAST(o.o_custkey AS STRING), '.example.org/bandi?s=psicolog')
  ELSE CONCAT('https://ente', CAST(o.o_custkey AS STRING), '.example.org/bandi/', CAST(o.o_orderkey AS STRING)) END AS official_url
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "fx_attachments": """
SELECT CONCAT(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '-', CAST(l.l_partkey AS STRING)) AS id,
 CAST(l.l_orderkey AS BIGINT) AS notice_id,
 CASE l.l_linenumber % 4 WHEN 0 THEN 'Bando integrale' WHEN 1 THEN 'Graduatoria finale' WHEN 2 THEN 'Istruzioni compilazione' ELSE 'Nomina commissione' END AS title,
 CONCAT('https://ente.example.org/doc/', CAST(l.l_partkey AS STRING), CASE l.l_suppkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '' END) AS url
FROM lineitem l
""",
    "fx_runs": """
SELECT e.event_id AS id, CAST(e.user_id AS BIGINT) AS source_id,
 CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status, e.ts AS started_at,
 CAST(e.event_id % 5 AS INT) AS created_count, CAST(e.event_id % 3 AS INT) AS updated_count, CAST(e.event_id % 2 AS INT) AS skipped_count,
 CASE e.event_type WHEN 'error' THEN CASE e.event_id % 3 WHEN 0 THEN 'SSL: CERTIFICATE_VERIFY_FAILED' WHEN 1 THEN 'ssl handshake failure' ELSE 'Name or service not known' END ELSE NULL END AS error_message
FROM events e
""",
    "fx_subscriptions": """
SELECT CAST(c.c_custkey AS BIGINT) AS id, CONCAT('u', CAST(c.c_custkey AS STRING), '@example.org') AS email,
 CASE c.c_custkey % 40 WHEN 30 THEN 'unsubscribed' WHEN 20 THEN 'pending' ELSE 'active' END AS status,
 CASE WHEN c.c_custkey % 20 = 0 THEN '' ELSE r.r_name END AS regions_csv,
 CASE c.c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '1-URGENT,2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS categories_csv,
 CASE WHEN c.c_custkey % 50 = 0 THEN 'anziani,ricerca' ELSE '' END AS areas_csv,
 CASE c.c_custkey % 3 WHEN 0 THEN 'psicologo' WHEN 1 THEN 'incarico,rsa' ELSE '' END AS keywords_csv,
 CASE WHEN c.c_custkey % 20 = 0 THEN 'daily' ELSE 'weekly' END AS frequency,
 CASE WHEN c.c_custkey % 30 = 10 THEN NULL ELSE CAST(CONCAT('1998-05-', lpad(CAST(c.c_custkey % 28 + 1 AS STRING), 2, '0'), ' 12:00:00') AS TIMESTAMP) END AS last_sent_at
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
}
TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; the given tables are read as temporary views of their own names."""
    sql = VIEWS[name]
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"given_{table}")
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {table} ", f"{word} given_{table} ")
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """SQL for DuckDB with the derived tables it names in front."""
    views = ", ".join(f"{n} AS ({VIEWS[n].strip().replace('AS STRING', 'AS VARCHAR')})" for n in names)
    sql = sql.strip()
    if not views:
        return sql
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"
