"""Cases that results must equal: links, professions, keys, delimiters."""

import hashlib

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import urls
from noticeflow.functions.text import normalize
from noticeflow.operators import classify
from noticeflow.sources import payloads


def test_deep_link_scores(spark):
    rows = [
        ("Privacy", "/privacy", "", 0),
        ("Centro ascolto", "/servizi/centro-ascolto", "", 0),
        ("Avviso psicologo", "/competition/avviso-psicologo", "", 23),
        ("Bandi di concorso", "/amministrazione-trasparente/bandi-di-concorso/", "", 13),
        ("Pagina successiva", "/concorsi/?page=2", "next", 6),
        ("Pagina psicologi", "/concorsi/?page=2", "", 15),
        ("altre", "/x?q=1&pagina=3", None, 5),
        ("altre", "/x?page=", "", 0),
        ("Pagina 3", "/x", "", 3),
        ("Facebook", "/facebook/concorsi", "", 0),
        ("Servizio salute mentale", "/servizi/salute-mentale", "", 10),
        ("Leggi", "/dettaglio/7", "", 8),
        ("", "", "", 0),
    ]
    table = spark.createDataFrame(rows, "label string, href string, rel string, score int")
    got = table.select("href", "label", "score", classify.deep_link_score(F.col("label"), F.col("href"), F.coalesce("rel", F.lit(""))).alias("found")).collect()
    assert [(r.label, r.href, r.found) for r in got] == [(r.label, r.href, r.score) for r in got]


def test_professional_match(spark):
    rows = [
        ("Psicologo", "Avviso pubblico per psicologo", "Servizio tutela minori", "direct"),
        ("Insegnante", "Concorso per insegnante scuola infanzia", "Richieste conoscenze pedagogiche e psicologiche.", None),
        ("Funzionario amministrativo", "Mobilita presso il Consiglio Nazionale dell'Ordine degli Psicologi per funzionario amministrazione contabilita", "Attivita amministrativa e contabile.", None),
        ("Psicologo", "Revoca del concorso per psicologo", "", None),
        ("", "Avviso: la revoca della delega non vale; psicologo", "", "direct"),
        ("", "Elenco di laureati in psicologia", "", "direct"),
        ("", "Elenco educatori", "Laurea in psicologia e iscrizione all'albo", "eligible"),
        ("", "Elenco educatori", "Si cerca un esperto psicologo", "direct"),
        ("", "Elenco educatori", "Richiesta la laurea in psicologia", "eligible"),
        ("", "Elenco", "Scienze comportamentali e salute mentale", "eligible"),
        (None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "f string, t string, d string, kind string")
    got = table.select("t", "kind", classify.professional_match(*(normalize(F.col(c)) for c in "ftd")).alias("found")).collect()
    assert [(r.t, r.found) for r in got] == [(r.t, r.kind) for r in got]


def test_keys_keep_missing_parts(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    table = spark.createDataFrame([("s", None, "u"), ("s", "u", None)], "a string, b string, c string")
    assert [r[0] for r in table.select(urls.external_key(F.col("a"), F.col("b"), F.col("c"))).collect()] == [sha("s||u"), sha("s|u|")]
    made = table.select(urls.fingerprint(F.lit("Avviso Psicologo!"), F.lit("COMUNE DI ROMA"), F.lit("2026/06/14")), urls.fingerprint(F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()
    assert list(made) == [sha("avviso psicologo|comune di roma|2026 06 14"), sha("x||")]


def test_each_file_has_its_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;title\n1;"uno; due"\n2;tre, quattro, cinque\n')
    (tmp_path / "b.csv").write_text("id,title\n3,x;y\n4,z\n")
    (tmp_path / "c.csv").write_bytes("id|title\n5|città\n".encode("latin-1"))
    (tmp_path / "d.csv").write_text("id\tsolo\n")
    got = payloads.read_csv_export(spark, str(tmp_path), "id int, title string").collect()
    assert sorted((r.id, r.title) for r in got) == [(1, "uno; due"), (2, "tre, quattro, cinque"), (3, "x;y"), (4, "z"), (5, "città")]


@pytest.mark.parametrize("text, bare", [("Mobilità ½ ﬁne ℡ ́x", "mobilita 1 2 fine tel x"), ("", ""), (None, "")])
def test_normalize_longer_forms(spark, text, bare):
    assert spark.createDataFrame([(text,)], "t string").select(normalize(F.col("t"))).first()[0] == bare
