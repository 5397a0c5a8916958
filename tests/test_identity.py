"""Probable duplicates and containment against brute force."""

import difflib
import functools
import random
from datetime import datetime

import pytest

from noticeflow.functions.text import plain
from noticeflow.operators import identity
from noticeflow.operators.matching import ratios
from noticeflow.plans import registry
from noticeflow.plans.notices import enriched


def test_probable_duplicates(spark, monkeypatch):
    rng = random.Random(4)
    titles = ["Avviso pubblico per psicologo", "Avviso pubblico per psicologa", "Avviso pubblico psicologo clinico", "Concorso dirigente", "Concorso dirigenti", "Bando", "", "Selezione pubblica per titoli ed esami n. 3"]
    names = ["ASL Roma 1", "ASL Roma 2", "Asl di Roma 1", "Comune di Pisa", "Comune di Pisa (PI)", "Regione Lazio", "", "Università di Bari"]
    days = [None, None, datetime(2026, 5, 1), datetime(2026, 5, 1, 12), datetime(2026, 6, 1)]
    rows = [(i, rng.randrange(6), rng.choice(titles) + rng.choice(["", "", " n. 1"]), rng.choice(names), rng.choice(days), rng.choice(["approved", "approved", "hidden"]), rng.choice(["open", "review", "closed"])) for i in range(260)]
    ratio = functools.cache(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
    expected = {}
    for a in rows:
        for b in sorted(rows):
            if b[0] >= a[0]:
                break
            if b[1] == a[1] or b[5] != "approved" or b[6] == "closed" or (a[4] and b[4] and a[4].date() != b[4].date()):
                continue
            if ratio(plain(a[2]), plain(b[2])) >= 0.88 and ratio(plain(a[3]), plain(b[3])) >= 0.75:
                expected[a[0]] = b[0]
                break
    notices = spark.createDataFrame(rows, "id long, source_id long, title string, organization string, deadline timestamp, editorial_status string, status string")
    for most, asks in ((512, 2048), (2, 3)):
        monkeypatch.setattr(identity, "LIST", most)
        monkeypatch.setattr(identity, "ASKS", asks)
        assert dict(map(tuple, identity.probable_duplicates(notices).collect())) == expected and len(expected) > 100
    assert identity.probable_duplicates(notices.limit(0)).count() == 0


def test_overlapping_region(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7)))
    issuers = sorted({text() for _ in range(60)})
    sources = [(k, rng.choice(["r1", "r2", "r3"]), text()) for k in range(60)] + [(60, "r9", "")]
    got = {tuple(r) for r in identity.overlapping_region(spark.createDataFrame([(x,) for x in issuers], "i string"), spark.createDataFrame(sources, "id long, region string, o string")).collect()}
    expected = set()
    for i in issuers:
        met = [(min(len(i), len(o)), -k, r) for k, r, o in sources if o and (i in o or o in i)]
        if met:
            expected.add((i, max(met)[2]))
    assert got == expected and len(got) > 30


def test_ratios_equal_the_standard_library():
    rng = random.Random(1)
    text = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    pairs = [(text("ab ", 0, 14), text("ab ", 0, 14)) for _ in range(3000)] + [(text("abcdefgh ", 150, 320), text("abcdefgh ", 150, 320)) for _ in range(60)]
    for _ in range(40):
        x = text("abcdefghijklmnopqrstuvwxyz0123456789éàù", 300, 300)
        pairs.append((x, x[:100] + "zz" + x[110:250] + x[:30]))
    pairs += [("a" * 300, "a" * 299), ("a" * 300, "a" * 300), ("", ""), ("", "a"), ("😀a", "a😀")]
    assert ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@pytest.mark.parametrize("least,q", [(0.88, 3), (0.75, 2)])
def test_similar_texts(spark, least, q):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 26))) for _ in range(60)]
    texts = set(base)
    for x in base:
        for _ in range(4):
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "z", "bc"])
            texts.add("".join(y))
    texts = sorted(texts - {""})
    some = texts[::3]
    frame = lambda c, rows: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    got = {tuple(r) for r in identity.similar_texts(frame("a", some), frame("b", texts), least, q).collect()}
    expected = {(a, b) for a in some for b in texts if difflib.SequenceMatcher(None, a, b).ratio() >= least}
    assert got == expected and len(got) > len(some) + 40


def test_fuzzy_duplicate_over_whole_tables(spark):
    """The registered query against comparing every notice with every target."""
    d = "/root/testdata/sf0.001"
    got = dict(map(tuple, registry.QUERIES["fuzzy_duplicate"](spark, d).collect()))
    rows = [(r.id, r.source_id, plain(r.title), plain(r.organization), r.deadline and r.deadline.date(), r.editorial_status == "approved" and r.status != "closed") for r in enriched(spark, d).orderBy("id").collect()]
    ratio = functools.cache(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
    expected = {}
    for i, source, t, o, day, _ in rows:
        for j, other, tb, ob, day_b, target in rows:
            if j >= i:
                break
            if target and other != source and (not day or not day_b or day == day_b) and ratio(t, tb) >= 0.88 and ratio(o, ob) >= 0.75:
                expected[i] = j
                break
    assert got == expected and len(got) > 1000


def test_search_is_cut_into_bounded_batches():
    """No more than ASKS asking classes together, unless one row has them; all rows, in order."""
    import pyarrow as pa

    sizes = [1, identity.ASKS, 3, identity.ASKS - 3, 1, identity.ASKS + 5, 0, 2, *[700] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(range(len(sizes))), pa.array([[0] * n for n in sizes])], ["t", "of", "asks"])
    cut = list(identity._by_asks([batch, batch.slice(0, 0), batch.slice(5)]))
    assert [x for b in cut for x in b.column(0).to_pylist()] == [*range(len(sizes)), *range(5, len(sizes))]
    assert all(b.num_rows == 1 or sum(map(len, b.column(2).to_pylist())) <= identity.ASKS for b in cut) and len(cut) < 20
