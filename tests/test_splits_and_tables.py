import json

import pytest
from lodestone.operators import generation, golden, pages, splits
from lodestone.operators.filters import parsed_output
from lodestone.sources import tables
from lodestone.streaming import annotations
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"{c}-{i}", c, "ood" if c == "sk" else "in_domain", "x" * (100 if i % 10 == 0 else 200)) for c in ("tk", "gk", "sk") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id string, code string, group string, text string")


def test_split_invariants(spark, docs):
    s = splits.make_splits(docs, held_out=0.1, test=(20, 6), dev=(15, 4)).toPandas()
    of = lambda split, name=None: set(s[(s["split"] == split) & ((s["slice"] == name) if name else True)].doc_id)
    held, train = of("held_out"), of("train")
    assert len(held) == 12 and not held & train and len(held | train) == 120
    assert not (of("test") & of("dev"))
    for split in ("test", "dev"):
        assert of(split, "seen") <= train and of(split, "unseen_articles") <= held
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(len(text[d]) >= 150 for d in of("test") | of("dev"))
    assert of("test", "unseen_codes") == {d for d, t in text.items() if d.startswith("sk") and len(t) >= 150}
    for _, g in s[s["split"].isin(["test", "dev"])].groupby(["split", "slice"]):
        n = g.qtype.value_counts()
        assert n.max() - n.min() <= 1 or len(n) < 3
    again = splits.make_splits(docs.repartition(5), held_out=0.1, test=(20, 6), dev=(15, 4)).toPandas()
    key = ["doc_id", "split", "slice"]
    assert s.sort_values(key).fillna("").values.tolist() == again.sort_values(key).fillna("").values.tolist()


def test_samples(spark, docs):
    assert splits.stratified_sample(docs.limit(25), ["group"], "doc_id", 0.1).count() == 2  # 2.5 rounds to even
    assert splits.proportional_sample(docs, ["code"], "doc_id", 10).count() == 9
    assert splits.stratified_pick(docs, ["code"], "doc_id", 10).count() == 9
    small = {r.doc_id for r in splits.nested_fraction(docs, "doc_id", 0.25).collect()}
    large = {r.doc_id for r in splits.nested_fraction(docs, "doc_id", 0.5).collect()}
    assert len(small) == 45 and len(large) == 90 and small < large
    assert splits.nested_fraction(docs, "doc_id", 1.0).count() == 180


def test_json_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"key": "a", "n": 1}\n\n{"n": 2}\n{"key": "b", "n"', encoding="utf-8")
    got = tables.read_jsonl_lenient(spark, str(p), "key string, n long", "key").collect()
    assert [r.key for r in got] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_jsonl(spark, str(p), "key string, n long").collect()
    tables.write_jsonl(spark.createDataFrame([("ё", None)], "a string, b string"), str(tmp_path / "out"))
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*.json"))
    assert json.loads(line) == {"a": "ё", "b": None} and "ё" in line


def test_runs_upserts_and_exports(spark, tmp_path):
    run = spark.createDataFrame([(1, "a", 0.123456, 1), (1, "b", 0.1, 2), (2, "a", 0.5, 1)], "qid long, doc_id string, score double, rank long")
    tables.save_run(run, str(tmp_path / "run"), depth=1)
    assert {(r.qid, r.score) for r in tables.load_run(spark, str(tmp_path / "run")).collect()} == {(1, 0.12346), (2, 0.5)}
    back = tables.flat_run(tables.nested_run(run)).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, r["rank"]) for r in back] == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    old = spark.createDataFrame([("t", "c", 1), ("d", "c", 2)], "set string, protocol string, v int")
    new = spark.createDataFrame([("t", "c", 9)], "set string, protocol string, v int")
    assert {tuple(r) for r in tables.upserted(old, new, ["set", "protocol"]).collect()} == {("d", "c", 2), ("t", "c", 9)}
    q = spark.createDataFrame([("q1", "x", None, "search", "tk", "d1", "train", None), ("q2", "y", "seen", "legal", "tk", "d2", "test", {"d2": 1, "d3": 1})], "qid string, text string, slice string, qtype string, code string, doc_id string, split string, qrels map<string,int>")
    d = spark.createDataFrame([("d1", "T", "x", "tk")], "doc_id string, title string, text string, code string")
    c = spark.createDataFrame([("d1#0", "d1", "x")], "chunk_id string, doc_id string, text string")
    counts = {r.split: (r.queries, r.qrels) for r in tables.export_benchmark(d, c, q, str(tmp_path / "out")).collect()}
    assert counts == {"train": (1, 1), "test": (1, 2)}
    assert spark.read.json(str(tmp_path / "out/queries")).where("slice = 'train'").count() == 1
    ext = spark.createDataFrame([(1, "q", ["81", "22.1"]), (2, "r", [])], "id long, question string, articles array<string>")
    got = tables.external_queries(ext).collect()
    assert [(r.qid, r.doc_id, r.qrels) for r in got] == [("ext-1", "tk-81", {"tk-81": 1, "tk-22.1": 1})]


def test_reports_config_and_fetch(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345), ("b", None)], "m string, v double")
    tables.write_csv(df.where("m = 'a'"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part*.csv")).read_text().split() == ["m,v", "a,0.1235"]
    assert tables.markdown(df, ["m", "v"], F.col("m")).splitlines()[2:] == ["| a | 0.123 |", "| b |  |"]
    assert [r.p for r in spark.createDataFrame([(0.0002,), (0.04,)], "p double").select(tables.shown_p(F.col("p")).alias("p")).collect()] == ["<0.001", "0.040"]
    (tmp_path / "c.yaml").write_text("a: [1, 2]")
    assert tables.load_yaml("c.yaml", str(tmp_path)) == {"a": [1, 2]}

    class Client:
        n = 0

        def get(self, url):
            self.n += 1
            if self.n < 3:
                raise OSError
            return url

    waits = []
    assert tables.fetched(Client(), "u", sleep=waits.append) == "u" and waits == [3.0, 6.0]
    with pytest.raises(OSError):
        tables.fetched(Client(), "u", tries=2, sleep=waits.append)
    (tmp_path / "dev.jsonl").write_text('{"qid": "1"}\n')
    assert list(tables.query_sets(spark, str(tmp_path), ["dev", "test"], "qid string")) == ["dev"]


def test_generation(spark):
    def stub():
        def call(system, user, seed):
            if "bad" in user:
                raise RuntimeError
            return json.dumps({"everyday": user, "answerable": "YES"})

        return call

    d = spark.createDataFrame([("tk-1", "h", "good text"), ("tk-2", "h", "bad"), ("tk-3", "h", "y\n" * 5000)], "doc_id string, header string, text string")
    tasks = generation.train_tasks(d)
    assert {r.key for r in tasks.collect()} == {"tk-1|0", "tk-2|0", "tk-3|0", "tk-3|1", "tk-3|2"}
    left = tables.remaining(tasks, spark.createDataFrame([("tk-3|0",), ("tk-3|1",), ("tk-3|2",)], "key string"), "key")
    out = generation.answered(left, stub, "sys", generation.prompt("{header}: {text}", header=F.col("header"), text=F.col("text")), "stub")
    got = {r.key: r for r in generation.verdicts(parsed_output(out)).collect()}
    assert got["tk-1|0"].output.everyday == "h: good text" and got["tk-1|0"].answerable == "yes"
    assert got["tk-2|0"].reason == "invalid_json" and got["tk-2|0"].answerable == "invalid"
    hard = generation.hard_tasks(d, spark.createDataFrame([("tk-1",)], "doc_id string"), spark.createDataFrame([("tk-3",)], "doc_id string"), min_chars=1)
    assert {(r.key, r.slice) for r in hard.collect()} == {(f"tkhard|{x}|{t}", s) for x, s in (("tk-2", "seen"), ("tk-3", "unseen_articles")) for t in ("everyday", "search")}
    assert generation.limited(tasks, 2).count() == 2 and generation.limited(tasks, 0).count() == 5


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "n": 1, "v": "x", "ts": "2024-01-01T00:01:00"}\n{"k": "a", "n": 3, "v": "z", "ts": "2024-01-01T00:02:00"}\n{"k": "b", "n": 2, "v": "y", "ts": "2024-01-01T00:07:00"}\n')
    stream = lambda: spark.readStream.schema("k string, n long, v string, ts timestamp").json(str(src))
    annotations.run_once(annotations.latest_stream(stream(), "k", "n"), "latest", str(tmp_path / "c1"))
    assert {(r.k, r.v) for r in spark.table("latest").collect()} == {("a", "z"), ("b", "y")}
    annotations.run_once(annotations.windowed_counts(stream(), "ts", ["k"]), "counts", str(tmp_path / "c2"))
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
    annotations.run_once(annotations.deduplicated_stream(stream(), "k", "ts"), "once", str(tmp_path / "c3"), "append")
    assert spark.table("once").count() == 2


def test_entry_has_queries_and_oracles(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert entry.entry(spark).limit(1).count() == 1


def test_tasks_are_asked_in_parallel_and_logged_as_they_end(spark, tmp_path):
    tasks = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(12)], "key string, text string")
    marks = str(tmp_path)

    def model(marks=marks):
        import os

        def call(system, user, seed):
            n = int(user.split()[-1])
            path = f"{marks}/tried-{n}"
            first = not os.path.exists(path)
            open(path, "a").close()
            if n == 3 or (n == 5 and first):  # one fails always, one the first time
                raise OSError("connection lost")
            return f"answer {n}"

        return call

    ask = lambda df: generation.answered(df, model, "s", generation.prompt("{t}", t=F.col("text")), "m", tries=2, wait=0.01, workers=3)
    got = {r.key: r for r in ask(tasks).collect()}
    assert got["k3"].raw is None and got["k3"].error == "OSError: connection lost" and got["k5"].raw == "answer 5" and got["k0"].seconds >= 0
    log = f"file://{tmp_path}/log"
    assert generation.run_tasks(tasks, log, ask, slices=3).count() == 11  # what failed isn't logged
    more = tasks.unionByName(spark.createDataFrame([("k99", "text 99")], tasks.schema))
    assert {r.key for r in generation.run_tasks(more, log, ask, slices=3).collect()} == {f"k{i}" for i in range(12) if i != 3} | {"k99"}
    assert generation.run_tasks(more, log, ask, slices=3).count() == 12

    def broken():
        def call(system, user, seed):
            raise TypeError("a fault of the program")

        return call

    with pytest.raises(Exception, match="a fault of the program"):
        generation.answered(tasks, broken, "s", F.col("text"), "m").collect()


def test_layouts_of_laws(spark):
    full = '<h1>Law (ред. от 01.01.2020)</h1><div class="main-center-block"><p>Глава 1. Общие</p><p>Статья 1. Первая</p><p>Текст один.</p><p>Статья 2. Вторая</p><p>Текст два.</p></div>'
    single = '<h1>Статья 7. Седьмая</h1><div class="main-center-block-article-text"><p>Текст семь.</p></div>'
    rows = spark.createDataFrame([("a", "/x/a", full), ("b", "/x/b/glava-3/", single), ("b", "/x/b/none", "<h1>Other</h1>")], "code string, url string, html string")
    laws = spark.createDataFrame([("a", "full", "in_domain"), ("b", "pages", "ood")], "code string, layout string, group string")
    got = {r.doc_id: (r.title, r.chapter, r.text, r.group, r.status) for r in pages.articles_of(rows, laws).collect()}
    assert got == {"a-1": ("Первая", "1", "Текст один.", "in_domain", "active"), "a-2": ("Вторая", "1", "Текст два.", "in_domain", "active"), "b-7": ("Седьмая", "3", "Текст семь.", "ood", "active")}
    bad = spark.createDataFrame([("a", "/x/a", "<p>no root</p>")], rows.schema)
    with pytest.raises(Exception, match="no main-center-block on page /x/a"):
        pages.articles_of(bad, laws).collect()


def test_annotation_reads(spark):
    items = spark.createDataFrame([(1, "s", [10, 11], 10), (2, "t", [12], 12)], "qid long, slice string, candidates array<long>, gold long")
    log = spark.createDataFrame([(1, "ok", True)], "qid long, question_status string, gold_relevant boolean")
    assert sorted(tuple(r) for r in golden.listed(items, log).collect()) == [(1, "s", True), (2, "t", False)]
    r = golden.item(items, log, 1).first()
    assert r.candidates == [10, 11] and r.annotation.question_status == "ok" and golden.item(items, log, 2).first().annotation is None
