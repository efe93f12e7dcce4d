"""The page source, sketches, exact quantiles and event streams."""

import datetime
import glob
import random
import zlib

import numpy as np
import pytest
from lodestone.operators import sketches
from lodestone.sources import fetching
from lodestone.streaming import events
from pyspark.sql import functions as F


def test_fetch_goes_on_after_a_crash(spark, tmp_path):
    rows = [(f"http://h{i % 3}.x/{i}", f"<p>{i}" if i else None) for i in range(60)]
    site = fetching.sited(spark.createDataFrame(rows, "url string, html string"), str(tmp_path / "site"), 4)
    tasks = spark.createDataFrame([(str(i), u) for i, (u, _) in enumerate(rows)] + [("0", rows[0][0]), ("gone", "http://h1.x/gone")], "key string, url string")
    store, how = str(tmp_path / "store"), {"client": "lodestone.sources.fetching:site_client", "argument": site, "delay": 0.0, "wait": 0.0, "hosts_at_once": 2}
    few = fetching.fetch(tasks, store, limit=5, **how)
    assert few.count() == 5 and set(few.columns) == {x.split()[0] for x in fetching.SCHEMA.split(", ")}
    assert {r.key for r in fetching.fetch(tasks, store, only=["7", "8"], **how).collect()} >= {"7", "8"}
    first = {r.key: r.fetched_at for r in fetching.stored_pages(spark, store).collect()}
    # one file of the site is broken: the run ends in the middle
    broken = glob.glob(f"{tmp_path}/site/bucket=2/*.parquet")[0]
    whole = open(broken, "rb").read()
    open(broken, "wb").write(b"no parquet")
    for crc in glob.glob(f"{tmp_path}/site/bucket=2/.*.crc"):
        open(crc, "wb").close()
    with pytest.raises(Exception, match="(?i)parquet"):
        fetching.fetch(tasks, store, slices=6, **how)
    middle = {r.key: r.fetched_at for r in fetching.stored_pages(spark, store).collect()}
    assert len(first) <= len(middle) < 60
    open(broken, "wb").write(whole)
    got = {r.key: r for r in fetching.fetch(tasks, store, slices=6, **how).collect()}
    assert {k: r.html for k, r in got.items()} == {str(i): h for i, (_, h) in enumerate(rows)}
    assert all(got[k].fetched_at == at for k, at in {**middle, **first}.items())
    # nothing is left but the page that the site doesn't have
    before = {r.key: r.fetched_at for r in fetching.stored_pages(spark, store).collect()}
    assert {r.key: r.fetched_at for r in fetching.fetch(tasks, store, **how).collect()} == before and "gone" not in before


def test_pages_are_tried_again():
    reader = fetching.PageReader({"urls": "", "client": "", "wait": "0"})
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "page"

    assert reader.fetched(get, "u")[:3] == ("page", None, 3)

    def down(url):
        raise ConnectionError("down")

    assert reader.fetched(down, "u")[:3] == (None, "ConnectionError: down", 3)
    with pytest.raises(ValueError):  # what is no failure of the web ends the job
        reader.fetched(lambda u: int("x"), "u")


def test_exact_quantiles_are_percentiles(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BUCKETS", 8)
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "far": np.append(rng.random(200), [1e300, -1e300]), "one": np.array([7.0]), None: rng.exponential(size=101)}
    rows = [(g, float(v)) for g, own in values.items() for v in own] + [("one", None), ("none", None), ("ties", float("nan")), ("ties", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    names = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.953, "e": 1.0}
    got = {r.g: r for r in sketches.exact_quantiles(df, ["g"], "v", names).collect()}
    assert got.keys() == values.keys()
    for g, own in values.items():
        assert got[g].n == len(own)
        assert np.allclose([got[g][n] for n in names], np.quantile(own, list(names.values())), rtol=1e-9, atol=1e-12)
    assert sketches.exact_quantiles(df.limit(0), ["g"], "v", names).collect() == []
    assert sketches.exact_quantiles(df.where("g = 'one'"), [], "v", {"m": 0.5}).first().m == 7.0


def test_merged_sketches_keep_their_error(spark):
    rng = random.Random(2)
    rows = [(d, "g", rng.gauss(0, 1), f"k{rng.randrange(3000)}") for d in range(20) for _ in range(500)] + [(0, "empty", None, None)]
    df = spark.createDataFrame(rows, "day int, g string, v double, k string")
    days = sketches.sketched(df, ["g", "day"], "v", "k")
    got = {r.g: r for r in sketches.estimated(sketches.merged(days, ["g"]), {"p10": 0.1, "p90": 0.9}).collect()}
    own = sorted(v for _, g, v, _ in rows if g == "g")
    rank = lambda x: np.searchsorted(own, x) / len(own)
    assert abs(rank(got["g"].p10) - 0.1) < 0.02 and abs(rank(got["g"].p90) - 0.9) < 0.02 and got["g"].n == 10_000
    n = len({k for *_, k in rows if k})
    assert abs(got["g"].n_distinct - n) < 0.03 * n
    assert (got["empty"].n, got["empty"].p10, got["empty"].n_distinct) == (0, None, 0)


AT = datetime.datetime(2024, 1, 1)


def put(spark, path, rows):
    schema = "id long, u string, ts timestamp, v double"
    spark.createDataFrame([(i, u, AT + datetime.timedelta(minutes=m), float(m)) for i, u, m in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_sessions_go_on_over_runs_and_drop_what_is_late(spark, tmp_path):
    path, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    run = lambda: events.append_once(events.sessions(events.read(spark, path), "ts", ["u"], "10 minutes", "30 minutes"), out, progress)
    put(spark, path, [(1, "a", 0), (2, "a", 5), (3, "b", 0)])
    assert run().collect() == []  # the watermark has passed none
    put(spark, path, [(4, "a", 12), (5, "a", 60)])
    minutes = lambda t: (t - AT).total_seconds() / 60
    got = sorted((r.u, minutes(r.start), minutes(r.end), r.n) for r in run().collect())
    assert got == [("a", 0, 22, 3), ("b", 0, 10, 1)]  # the first run's session has grown
    put(spark, path, [(6, "a", 1), (7, "a", 200)])
    got = sorted((r.u, minutes(r.start), r.n) for r in run().collect())
    assert got == [("a", 0, 3), ("a", 60, 1), ("b", 0, 1)]  # what came an hour late is dropped


def test_streams_join_within_a_gap(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [(1, "a", 0), (2, "a", 9), (3, "a", 11), (4, "b", 5), (5, None, 1), (6, None, 2)])
    side = lambda p: events.read(spark, path).select("u", F.col("id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    got = events.append_once(events.within(side("l"), side("r").where("r_id > 1"), ["u"], "l_ts", "r_ts"))
    assert sorted((r.l_id, r.r_id) for r in got.collect()) == [(1, 2), (2, 2), (2, 3), (3, 3), (4, 4)]


def test_upserts_are_idempotent(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    up = events.Upserts(spark, table, "u", "id")
    assert up.table() is None
    put(spark, path, [(1, "a", 0), (3, "a", 5), (2, "b", 0)])
    assert {(r.u, r.id) for r in up.run(events.read(spark, path)).collect()} == {("a", 3), ("b", 2)}
    put(spark, path, [(2, "a", 7), (9, "b", 0), (4, "c", 0)])
    want = {("a", 3), ("b", 9), ("c", 4)}
    assert {(r.u, r.id) for r in up.run(events.read(spark, path)).collect()} == want
    # a batch that comes again, and all of them after the progress was lost, change nothing
    up.apply(spark.read.parquet(path), up.versions()[-1])
    assert {(r.u, r.id) for r in up.table().collect()} == want
    again = up.run(events.read(spark, path), str(tmp_path / "new-progress"))
    assert {(r.u, r.id) for r in again.collect()} == want


def test_files_of_a_site_are_bounded_and_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fetching, "FILE_PAGES", 4)
    rows = [(f"http://h{i % 2}.x/{i}", f"<p>{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "url string, html string")
    site = fetching.sited(df, str(tmp_path / "site"))
    files = int(site.split()[0])
    assert files == 30
    tasks = spark.createDataFrame([(str(i), u) for i, (u, _) in enumerate(rows)], "key string, url string")
    got = fetching.fetch(tasks, str(tmp_path / "store"), "lodestone.sources.fetching:site_client", site, slices=2, hosts_at_once=2, delay=0.0, order=fetching.site_order(site)).collect()
    assert {(r.url, r.html) for r in got} == set(rows)
    # in the order in which the pages of a host in a slice came, no file is met again
    slices = {r.key: r.s for r in spark.createDataFrame([(r.key,) for r in got], "key string").select("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("s")).collect()}
    for part in {(r.url[:9], slices[r.key]) for r in got}:
        own = [zlib.crc32(r.url.encode()) % files for r in sorted(got, key=lambda r: r.fetched_at) if (r.url[:9], slices[r.key]) == part]
        assert own == sorted(own)
