import itertools
import json
import random
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evokit.llm import chat_format, decontaminate, jaccard_join, quality_rules
from evokit.llm import queries as llm_queries
from tests.llm.test_text import prose
from tests.test_queries import rows as rows_of


def shingles(words, k=5):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def norm(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "new" + str(r.randrange(999))
    return " ".join(w)


def test_decontamination(spark):
    r = random.Random(1)
    items = [prose(r, 40, 2) for _ in range(12)] + ["tiny item", "one", None, "", "exactly five words are here"]
    docs = [prose(r) for _ in range(20)]
    docs += [prose(r) + "\n" + items[i] + "\n" + prose(r) for i in range(6)]
    docs += [prose(r) + " " + edited(r, items[i].replace("\n", " "), k) + " " + prose(r) for i in (6, 7, 8) for k in (1, 2, 5)]
    docs += ["Here is a TINY, item!", items[9][: len(items[9]) // 2] + " gap " + prose(r) + items[9][len(items[9]) // 2 :], None, "", " ".join(prose(r) for _ in range(300)) + items[0]]
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)] + [(20, docs[20], "c"), (None, docs[20], "c")], "doc_id long, text string, item string")
    b = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(0, items[0], 0), (None, items[0], 0)], "item_id long, text string, n int")
    expected = {}
    for (i, t), (j, q) in itertools.product(enumerate(docs), enumerate(items)):
        q = norm(q)
        s = shingles(q)
        found = len(s & shingles(norm(t), min(5, len(q)))) if s else 0
        if s and found >= 0.8 * len(s) - 1e-9:
            expected[i, j] = (len(s), found)
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_found) for x in decontaminate.contaminated(d, b).collect()}
    assert got == expected and len(got) >= 10
    # Rows are judged by their own text: (None, docs[20]) goes, and what shares its id with a document that goes stays.
    more = d.unionByName(spark.createDataFrame([(20, docs[0], "c"), (None, docs[1], "c"), (None, None, "c")], d.schema)).withColumn("text_key", F.lit(1))
    kept = decontaminate.clean(more, b)
    assert kept.columns == more.columns
    ids = [(x.doc_id, x.text) for x in kept.collect()]
    clean = [(i, t) for i, t in enumerate(docs) if i not in {i for i, _ in expected}] + [(20, docs[0]), (None, docs[1]), (None, None)]
    assert sorted(map(str, ids)) == sorted(map(str, clean))
    assert decontaminate.clean(d.where("false"), b).count() == 0 and decontaminate.clean(d, b.where("false")).count() == d.count()
    assert decontaminate.contaminated(d.where("false"), b).count() == 0 == decontaminate.contaminated(d, b.where("false")).count()


def test_sketches_lose_nothing(spark):
    """Whatever a document lacks of an item, up to the threshold, enough of the sketch is left; and the sketch is a part only."""
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in (*range(1, 60), 100, 200, 500, 3000)]
    shingles = decontaminate.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    by = {}
    for x in decontaminate.sketches(shingles).collect():
        by.setdefault(x.item, []).append(x)
    for n, _ in items:
        rows, lacks = by[n], int(0.2 * n + 1e-9)
        assert {x.n for x in rows} == {n} and len({(x.bound, x.need) for x in rows}) == 1
        assert 1 <= rows[0].need == len(rows) - lacks and rows[0].need >= 0.25 * lacks - 1
    assert len(by[3000]) < 1300 and len(by[200]) < 120


def brute_classes(rows):
    """{id: (class, links)} of (id, text) rows with distinct ids."""
    sets = {i: shingles((t or "").encode().split()) for i, t in rows}
    near = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        out[i] = (min(seen), len(near[i]))
    return out


def near_fixture(seed=3):
    r = random.Random(seed)
    texts = [prose(r) for _ in range(30)]
    base = prose(r, 150, 3)
    texts += [edited(r, base, r.randrange(3)) for _ in range(60)]  # a large group of near copies
    passage = prose(r, 60, 1)
    texts += [passage + " " + prose(r, 60, 2) for _ in range(60)]  # a passage that many share
    texts += [texts[0]] * 9 + [edited(r, texts[k], n) for k in (1, 2, 3, 4) for n in (1, 2, 4)] + [None, "", "", "two words", "two words", "one", "a b c d e", "a b c d e f"]
    texts += [" ".join(prose(r) for _ in range(200))]
    texts += [edited(r, texts[-1], 30)]
    return list(enumerate(texts))


@pytest.mark.parametrize("small, block", [(256, 1024), (8, 16)])
def test_jaccard_join(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_fixture()
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, class_id string, rep int")
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.near_duplicates(d).collect()}
    assert got == brute_classes(rows)


def test_jaccard_edges(spark):
    r = random.Random(9)
    t = prose(r)
    d = spark.createDataFrame([(5, t), (5, t), (7, t), (None, t), (None, None), (9, prose(r))], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.class_id, x.n_links) for x in jaccard_join.near_duplicates(d).collect())
    assert got == [(-1, None, 0), (-1, None, 0), (5, 5, 1), (5, 5, 1), (7, 5, 1), (9, 9, 0)]
    # The row without an id that copies 5 goes; the one without a text stays.
    assert sorted((x.doc_id or -1) for x in jaccard_join.keep_one(d).collect()) == [-1, 5, 9]
    other, third = prose(r), prose(r)
    more = d.unionByName(spark.createDataFrame([(9, t), (9, other), (9, other), (None, other), (None, third), (None, third)], d.schema)).withColumn("row_key", F.lit("c"))
    kept = jaccard_join.keep_one(more)
    assert kept.columns == more.columns
    left = kept.collect()
    assert [x.doc_id for x in left if x.text == t] == [5] and sum(x.text == other for x in left) == 1 and [x.doc_id for x in left if x.text == third] == [None] and len(left) == 5
    assert jaccard_join.near_duplicates(d.where("false")).count() == 0
    assert jaccard_join.runs_for(0.99) > jaccard_join.runs_for(0.9) >= 1


def test_chat_format(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    rows = [
        (1, 0, "user", 'hi "x" é/\n'),
        (1, 1, "assistant", call({"id": "b", "name": "search", "arguments": {"query": "q", "limit": "3", "zz": 1}, "after": ["a"]}, {"id": "a", "name": "weather", "arguments": {"days": 2, "city": "Rome"}}, {"id": "a", "name": "weather", "arguments": []})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [1.5, None]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "q", "content": "x"})), (1, 4, "tool", None), (2, 0, None, None), (2, 1, "assistant", "{broken"), (None, 0, "user", ""), (2, 2, "user", "x" * 100_000),
        (3, 0, "assistant", call({"id": "x", "name": "calculate", "arguments": {}, "after": ["y"]}, {"id": "y", "name": "nope", "after": ["x"]}, {"name": "calculate", "arguments": {"expression": "1"}})),
        (4, 0, "assistant", call(*({"id": f"c{k}", "name": "calculate", "arguments": {"expression": str(k)}, "after": [f"c{j}" for j in range(k)]} for k in range(5)))),
        (4, 1, "tool", json.dumps({"tool_call_id": "c4", "content": 1})), (4, 2, "tool", json.dumps({"tool_call_id": "c4", "content": 2})),
    ]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, line string")
    out = chat_format.format_chats(d).collect()
    assert len(out) == 12 - 3 + 3 + 3 + 5 + 1
    by = {}
    for x in out:
        parsed = json.loads(x.line)
        assert x.line == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        by.setdefault((x.conv_id, parsed.get("id")), []).append(x)
    assert [(x.status, x.errors) for x in by[1, "b"]] == [("unanswered", "limit is no integer; unknown zz")]
    assert sorted(x.status for x in by[1, "a"]) == ["duplicate", "linked", "result"]
    assert by[1, "q"][0].status == "orphan"
    assert {x.status for k in "xy" for x in by[3, k]} == {"cycle"} and by[3, "x"][0].errors == "missing expression" and by[3, "y"][0].errors == "unknown tool"
    four = sorted((x for x in out if x.conv_id == 4), key=lambda x: (x.pos_turn, x.pos_level, x.pos_call, x.pos_kind, x.turn))
    assert [json.loads(x.line)["id"] for x in four] == ["c0", "c1", "c2", "c3", "c4", "c4", "c4"] and [x.status for x in four][-2:] == ["result", "result"]
    assert chat_format.format_chats(d.where("false")).count() == 0


def test_chat_text_of_call_turns(spark):
    call = {"id": "a", "name": "calculate", "arguments": {"expression": "1"}}
    texts = [
        json.dumps({"content": "none needed", "tool_calls": []}), json.dumps({"content": 'see "é"', "tool_calls": [call]}), json.dumps({"content": [{"type": "text", "text": "p"}], "tool_calls": [call, call]}),
        json.dumps({"content": None, "tool_calls": [call]}), json.dumps({"tool_calls": [call]}), json.dumps({"content": "", "tool_calls": [call]}), json.dumps({"content": "x", "tool_calls": None}),
    ]
    d = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    expected = []
    for k, t in enumerate(texts):
        calls, content = json.loads(t).get("tool_calls"), json.loads(t).get("content")
        if not calls:
            expected.append((k, 0, "assistant", t))
        elif content is not None:
            expected.append((k, 0, "assistant", content))
        expected += [(k, 1, "call", None) for _ in calls or []]
    got = []
    for x in sorted(chat_format.format_chats(d).collect(), key=lambda x: (x.pos_turn, x.pos_level, x.pos_call, x.pos_kind)):
        parsed = json.loads(x.line)
        assert x.line == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert x.pos_kind or (x.status, x.errors, x.pos_level, x.pos_call) == ("message", "", 0, 0)
        got.append((x.turn, x.pos_kind, parsed["role"], parsed.get("content")))
    assert got == expected


def brute_levels(after):
    """{id: level} of {id: ids it follows}, by taking calls off whose predecessors are done."""
    level, left = {}, {i: [x for x in xs if x in after] for i, xs in after.items()}
    while ready := [i for i, xs in left.items() if all(x in level for x in xs)]:
        level |= {i: 1 + max((level[x] for x in left.pop(i)), default=-1) for i in ready}
    return level | dict.fromkeys(left, -1)


def test_chat_levels(spark):
    r = random.Random(5)
    graphs = [{f"c{k}": [f"c{k - 1}"] if k else [] for k in range(70)}, {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a"], "e": ["d", "f"], "f": [], "g": ["g"], "h": ["f", "gone"]}]
    graphs += [{f"c{k}": [f"c{r.randrange(k + r.choice([0, 0, 0, 2]))}" for _ in range(r.choice([0, 1, 1, 1, 2, 3])) if k] for k in range(30)} for _ in range(6)]
    rows = [(g, 0, "assistant", "\n " + json.dumps({"tool_calls": [{"id": i, "name": "calculate", "arguments": {"expression": "1"}, "after": xs} for i, xs in after.items()]})) for g, after in enumerate(graphs)]
    rows += [rows[0], (None, 0, "assistant", rows[0][3])]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(x.conv_id, json.loads(x.line)["id"]): (x.pos_level, x.status) for x in out if x.conv_id is not None}
    expected = {(g, i): (v, "cycle" if v < 0 else "unanswered") for g, after in enumerate(graphs) for i, v in brute_levels(after).items()}
    assert got == expected and len(out) == sum(map(len, graphs)) + 2 * len(graphs[0])


def test_sketches_leave_documents_out(spark):
    """Most windows of the documents never reach the join, with items of every size and the shortest among them."""
    r = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(prose(r, 60, 1).split()[:n])) for i, n in enumerate([*range(1, 24), 60, 140, 300])], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(prose(r) for _ in range(20))) for i in range(20)], "doc long, text string")
    sketch = decontaminate.sketches(decontaminate.item_shingles(items))
    bounds = {x["size"]: x.bound for x in sketch.groupBy("size").agg(F.max("bound").alias("bound")).collect()}
    through = decontaminate._sketched(docs, {5: bounds[5]}, *decontaminate.marked(sketch)).count()
    every = docs.select(decontaminate.words(F.col("text")).alias("w")).select(F.explode(decontaminate._shingle_hashes(F.col("w"), 5)))
    assert through < 0.1 * every.count()
    # A full bitmap lets more through, and the same minima are found.
    full = decontaminate._sketched(docs, {5: bounds[5]}, F.array_repeat(F.lit(-1).cast("long"), 64), 4096)
    found = [x.join(sketch, ["size", "h"], "left_semi").count() for x in (decontaminate._sketched(docs, {5: bounds[5]}, *decontaminate.marked(sketch)), full)]
    assert through < full.count() and found[0] == found[1]


def test_chat_long_texts(spark):
    """Arguments, results and contents of a million characters, plain and escaped, stay whole."""
    for x in ("x" * 1_000_000, '\n"\\' * 333_334, "é1.50e3 " * 125_000):
        turns = [
            (1, 0, "user", x), (1, 1, "assistant", json.dumps({"content": x, "tool_calls": [{"id": "a", "name": "search", "arguments": {"query": x, "limit": 1.0}}]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": [x, 2.50]})),
        ]
        out = sorted(chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r.pos_turn, r.pos_kind))
        lines = [json.loads(r.line) for r in out]
        assert [r.status for r in out] == ["message", "message", "linked", "result"]
        assert lines[0]["content"] == x and lines[1]["content"] == x and lines[2]["arguments"] == {"query": x, "limit": 1} and lines[3]["content"] == [x, 2.5]


def test_chat_numbers(spark):
    numbers = "0 -0 -0.0 1.0 1.50 -2.5 1e2 1E-7 1.5e3 12345678.25 1e22 -3.25e-5 0.1 100 123456789012345678901234567890".split()
    rows = [(k, 0, "tool", f'{{"tool_call_id":"a","content":{{"x":[{v}],"y":"{v} \\" 1.0"}}}}') for k, v in enumerate(numbers)]
    rows += [(100, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "weather", "arguments": {"city": "1.0", "days": v}} for v in (1.0, 1.5, 2, 1e2)]}))]
    out = sorted(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda x: (x.conv_id, x.pos_call))
    for x, v in zip(out, numbers, strict=False):
        plain = format(Decimal(v), "f")
        plain = "0" if float(v) == 0 else plain.rstrip("0").rstrip(".") if "." in plain else plain
        assert f'"content":{{"x":[{plain}],"y":"{v} \\" 1.0"}}' in x.line, (v, x.line)
    assert [x.errors for x in out[-4:]] == ["", "days is no integer", "", ""] and '"arguments":{"city":"1.0","days":100}' in out[-1].line


def test_sql(spark):
    """The queries with SQL against it, on the smallest tables."""
    duck = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, text in llm_queries.oracle_sql().items():
        assert rows_of(llm_queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()) == rows_of(duck.sql(text).df()), name


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    item = prose(r, 40, 2)
    good = [prose(r) for _ in range(6)]
    texts = [*good, good[0], edited(r, good[1].replace("\n", " "), 0), good[2] + "\n" + item, "too short.", None, "\n".join(" | ".join("menu item link".split()) for _ in range(40)), prose(r) + "\nMy password = hunter2hunter2 is here."]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, sizes, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [], None
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, d, str(tmp_path)).write.parquet(out)
        d = spark.read.parquet(out)
        sizes.append({x.doc_id for x in d.collect()})
        if name != "encode":
            assert d.columns == [c.split()[0] for c in columns.split(", ")]
            kept = d
    assert sizes[0] == {0, 1, 2, 3, 4, 5, 6, 7, 8, 12} and sizes[1] == sizes[0] - {6, 7} and sizes[2] == sizes[1] - {8} == sizes[3] == sizes[4]
    assert "[assign]" in kept.where("doc_id = 12").first().text and "hunter2" not in kept.where("doc_id = 12").first().text
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, d.collect()))


def test_registered():
    names = list(llm_queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and names[13:] == ["chat_calls"]
    assert len(corpus_pipeline.STAGES) == 5 and set(llm_queries.oracle_sql()) < set(names)


def test_native_plans(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for df in (quality_rules.judge(d), quality_rules.clean(d), decontaminate.contaminated(d, d.withColumnRenamed("doc_id", "item_id"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
