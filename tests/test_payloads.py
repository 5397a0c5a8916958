"""Payload readers against plain Python readers: each stop rule, linked pages, CSV files of many splits and encodings, nested
draft texts."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from noticeflow.sources import payloads


def paged(spark, pages, **options):
    rows = [(s, p, json.dumps(body)) for s, some in pages.items() for p, body in enumerate(some)]
    df = spark.createDataFrame(rows, "source_id long, page long, body string")
    out = {}
    for r in payloads.read_paged_json(df, **options).collect():
        out.setdefault(r.source_id, {})[r.id] = r.title
    return out


def content(*ids, mark=""):
    return [{"id": i, "title": f"{i}{mark}"} for i in ids]


def test_each_stop_rule_of_paged_json(spark):
    got = paged(
        spark,
        {
            1: [{"totalPages": 2, "content": content("a")}, {"totalPages": 2, "content": content("b")}, {"totalPages": 2, "content": content("c")}],
            2: [{"last": False, "content": content("a")}, {"last": True, "content": content("b")}, {"content": content("c")}],
            3: [{"content": content("a")}, {"content": []}, {"content": content("c")}],
            4: [{"entitiesCount": 9, "content": content("a", "b")}, {"entitiesCount": 9, "content": content("b", "a")}, {"entitiesCount": 9, "content": content("c")}],
            5: [{"entitiesCount": 3, "content": content("a", "b")}, {"entitiesCount": 3, "content": content("b", "c")}, {"entitiesCount": 3, "content": content("d")}],
            6: [{"content": content("a", mark="1")}, {"content": content("a", mark="2") + [{"id": None, "title": "x"}, {"id": "", "title": "y"}, {"title": "z"}]}],
            7: [{"content": [{"id": "a", "title": "t"}]}, {"content": [{"id": "a", "title": None}]}],
            8: [{"content": None}, {"content": content("b")}],
        },
    )
    assert got == {1: {"a": "a", "b": "b"}, 2: {"a": "a", "b": "b"}, 3: {"a": "a"}, 4: {"a": "a", "b": "b"}, 5: {"a": "a", "b": "b", "c": "c"}, 6: {"a": "a2"}, 7: {"a": None}}
    assert paged(spark, {1: [{"content": content("a", "b")}, {"content": content("c")}, {"content": content("d", "e")}]}, size=2) == {1: {"a": "a", "b": "b", "c": "c"}}


def test_linked_pages(spark):
    """Chains of several lengths, one that runs into itself, a page off the way and a source without pages."""
    rows, expected = [], set()
    for s, n in enumerate((1, 2, 3, 17, 40)):
        names = [f"/p{s}/{(k * 7919) % 101}" for k in range(n)]
        for k, name in enumerate(names):
            after = names[k + 1] if k + 1 < n else names[n // 2] if s == 4 else None
            rows.append((s, name, json.dumps({"batching": {"next": after}})))
            expected.add((s, k))
        rows.append((s, f"/off/{s}", json.dumps({"batching": {"next": names[0]}})))
    starts = [(s, f"/p{s}/0") for s in range(5)] + [(9, "/none")]
    made = payloads.linked_pages(spark.createDataFrame(rows, "source_id long, url string, body string"), spark.createDataFrame(starts, "source_id long, url string"))
    got = made.collect()
    assert {(r.source_id, r.page) for r in got} == expected and len(got) == len(expected)
    follow = {(s, json.loads(b)["batching"]["next"]) for s, _, b in rows}
    for r in got:
        assert r.body in [b for s, u, b in rows if s == r.source_id and (r.page == 0 or (s, u) in follow)]


def test_csv_of_many_splits_in_each_encoding(spark, tmp_path):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    expected = []
    for name, encoding, letters, sep in (("a", "utf-8-sig", 'abcè€数 ";,|\n', ";"), ("b", "cp1252", 'abcè€ ";,\n', ","), ("c", "latin-1", 'abcè\x81 "|\n', "|"), ("d", "utf-8", "abc ;", "\t")):
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep, lineterminator="\n")
        w.writerow(["id", "title", "note"])
        for k in range(400):
            row = [f"{name}{k}", "x" + word(letters), "y" + word(letters) + "z"]
            w.writerow(row)
            expected.append(tuple(row))
            if k % 50 == 0:
                out.write("\n")
        w.writerow(["id", "title", "note"])  # a record that is like the header is a record
        expected.append(("id", "title", "note"))
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode(encoding))
        rows = list(csv.reader(io.StringIO((tmp_path / f"{name}.csv").read_bytes().decode(encoding)), delimiter=sep))
        assert sorted(map(tuple, (r for r in rows[1:] if r))) == sorted(x for x in expected[-401:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = payloads.read_csv_export(spark, str(tmp_path), "id string, title string, note string")
            assert sorted(map(tuple, got.collect())) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def draft_text(value):
    if isinstance(value, list):
        return " ".join(filter(None, map(draft_text, value)))
    if not isinstance(value, dict):
        return ""
    if isinstance(value.get("blocks"), list):
        return " ".join(str(b["text"]).strip() for b in value["blocks"] if isinstance(b, dict) and b.get("text"))
    return " ".join(filter(None, map(draft_text, value.values())))


def test_draft_texts_at_any_depth(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.random()
        if depth > 6 or kind < 0.2:
            return rng.choice([None, 1, "text", True, '{"blocks": [{"text": "in a string"}]}'])
        if kind < 0.45:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        if kind < 0.7:
            return {"blocks": [rng.choice([{"text": rng.choice(["uno", " due  tre ", "", "  ", "quàttro \"q\"", 5, 0])}, {"other": 1}, "no", {"text": "t", "children": [{"text": "never"}]}]) for _ in range(rng.randint(0, 4))], "z": {"blocks": [{"text": "never"}]}}
        return {rng.choice("zyxwvabc") + str(k): value(depth + 1) for k in range(rng.randint(0, 4))} | ({"blocks": "no list"} if rng.random() < 0.2 else {})

    values = [value(0) for _ in range(300)]
    deep = {"blocks": [{"text": "bottom"}]}
    for k in range(60):
        deep = {"k": [deep]} if k % 2 else [{"a": 1, "b": deep}]
    values.append(deep)
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(-1, None), (-2, "no json {"), (-3, "")]
    got = dict(map(tuple, spark.createDataFrame(rows, "id long, body string").select("id", payloads.json_text_flatten(F.col("body"))).collect()))
    assert got == {k: draft_text(v) for k, v in enumerate(values)} | {-1: "", -2: "", -3: ""}
    assert sum(bool(x) for x in got.values()) > 80 and got[300] == "bottom"


def test_draft_texts_are_those_of_plain_python_in_odd_bodies(spark):
    """Texts that are zero, false, numbers or the string 0; repeated keys; deep and wide bodies in one pass."""
    wide = {str(k): {"blocks": [{"text": f"t{k}"}]} for k in range(3000)}
    deep = '{"a":' * 900 + '{"blocks":[{"text":"end"}]}' + "}" * 900
    bodies = [json.dumps(v) for v in ({"blocks": [{"text": t} for t in ("0", 0, 0.0, False, True, 5.0, None, " x ")]}, wide, [[{"blocks": []}], {"blocks": {"blocks": [{"text": "y"}]}}])] + [deep, '{"a": NaN}', '{"blocks": [{"text": "\\ud800"}]}', '{"a": 1, "a": {"blocks": [{"text": "last"}]}} ']
    got = [r[0] for r in spark.createDataFrame(list(enumerate(bodies)), "id long, body string").orderBy("id").select(payloads.json_text_flatten(F.col("body"))).collect()]
    assert got == ["0 True 5.0 x", " ".join(f"t{k}" for k in range(3000)), "y", "end", "", "?", "last"]


def test_large_and_small_sources_are_numbered_alike_and_small_ones_in_one_round(spark, monkeypatch):
    """Loops and several starts, walked and doubled; a chain of many pages takes no round of its own when walked."""
    rng = random.Random(9)
    rows = [(s, f"/{k}", json.dumps({"batching": {"next": f"/{rng.randrange(n)}" if rng.random() < 0.05 else f"/{k + 1}"}})) for s, n in enumerate((1, 5, 30, 90)) for k in range(n)]
    df = spark.createDataFrame(rows, "source_id long, url string, body string")
    starts = spark.createDataFrame([(s, u) for s in range(4) for u in ("/0", "/3")], "source_id long, url string")
    doubling, calls = payloads._doubled, []
    monkeypatch.setattr(payloads, "_doubled", lambda *x: calls.append(1) or doubling(*x))
    walked = sorted(map(tuple, payloads.linked_pages(df, starts).collect()))
    assert not calls and len(walked) > 20
    monkeypatch.setattr(payloads, "WALK_PAGES", 20)
    assert sorted(map(tuple, payloads.linked_pages(df, starts).collect())) == walked and calls
