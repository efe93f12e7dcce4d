"""Near duplicates, decontamination, WARC, line dedup and surrogates against brute force."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from lodestone.llm import common, decontamination, line_dedup, near_dup, pii, registry, warc
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash") for r in rows], DOC)


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, k, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_rows(seed=1):
    """Chains: each copy differs a little from the one before, so that links go along the chain."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(6):
        t = [word() for _ in range(80)]
        for _ in range(rng.randint(1, 12)):
            out.append(" ".join(t))
            t = list(t)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
    out += ["", None, "one", "ONE", "one two", " one\ttwo ", "É", "é"] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_brute_force(spark, k):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows), k).collect()}
    assert got == brute_components(rows, k, 80)


@pytest.mark.parametrize("block,shingles", [(3, 1 << 20), (100, 130)])
def test_late_links_that_stars_miss(spark, monkeypatch, block, shingles):
    # one band's bucket with everything, and blocks of three: all that isn't linked to the least id comes later
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(3):
                t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    keys = near_dup._bands

    def by_column(classes):
        return keys(classes).withColumn("key", F.lit(0).cast("long"))

    monkeypatch.setattr(near_dup, "_bands", by_column)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows), 2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_pruning_keeps_what_can_reach_the_threshold():
    looks = near_dup.least_matches(0.8)
    assert [n for n, _ in looks] == list(range(32, 161, 32))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (4000, 160), dtype=np.uint64).astype("<u4")
    for s, low, high in ((0.85, 0.999, 1), (0.3, 0, 0.001)):
        b = np.where(rng.random(a.shape) < s, a, a ^ 1).astype("<u4")
        assert low <= near_dup.survives(a, b, 0.8)[0].mean() <= high


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1500], np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))])
    true = 1500 / (len(a) + 300)
    assert abs((near_dup.signature(a) == near_dup.signature(b)).mean() - true) < 0.12


def test_a_worker_keeps_the_hashes_of_few_short_words():
    from xxhash import xxh3_64_intdigest

    held = near_dup._WordHashes()
    for i in range(3 * near_dup.KEPT_WORDS):
        word = b"w%d" % i
        assert held[word] == xxh3_64_intdigest(word) == held[word]
        assert len(held) <= near_dup.KEPT_WORDS
    before = len(held)
    long = b"x" * (near_dup.KEPT_BYTES + 1)
    assert held[long] == xxh3_64_intdigest(long) and len(held) == before


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d E f"), (None, "a b c d e f"), (None, None), (3, "z " * 100_000), (4, "z " * 90_000), (5, None), (6, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, rows), 2).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True)], key=repr)
    assert near_dup.near_duplicates(docs(spark, rows).limit(0), 2).count() == 0
    kept = near_dup.deduplicated(docs(spark, rows), 2)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 7


def test_near_dedup_stage_leaves_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    other = "one two three four five six seven eight nine ten"
    rows = [(7, base), (7, base), (7, base + " extra"), (3, other), (None, other), (None, other), (None, "a text of no other row is kept as well"), (8, other.upper()), (9, "quite another text under an id of its own"), (9, "and this one has got the same id but other words"), (10, None), (10, None), (11, "")]
    df = docs(spark, rows)
    kept = cp.near_deduplicated(spark, df, SMALL)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    firsts = {t for _, t in got}
    assert len(got) == 7 and (3, other) in got and sum(d == 9 for d, _ in got) == 2 and sum(d == 7 for d, _ in got) == 1
    assert (10, None) in got and (11, "") in got and rows[6] in got and len(firsts) == 7
    unique = docs(spark, near_rows())
    assert {r.doc_id for r in near_dup.deduplicated(unique, 2, by_row=True).collect()} == {r.doc_id for r in near_dup.deduplicated(unique, 2).collect()}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 50))
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        near_dup.components(spark.createDataFrame(edges, "a long, b long"), limit=2)


def test_near_duplicates_leave_only_what_the_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = near_dup.near_duplicates(docs(spark, near_rows()), 2)
    assert sorted(x.name.split("-")[1] for x in tmp_path.iterdir()) == ["places", "signed"] and out.count() == len(near_rows())


def test_shared_folder_is_local_on_a_local_master_only():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, applicationId = "spark://somewhere:7077", "a1"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Context.master = "local[2]"
    assert common.shared_dir(Session) == common.shared_dir(Session) and common.shared_dir(Session).startswith("file:///")


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        m = min(n, len(b))
        wins = {tuple(b[j : j + m]) for j in range(len(b) - m + 1)} if b else set()
        for j in range(len(w) - m + 1):
            if m and tuple(w[j : j + m]) in wins:
                hit.update(range(j, j + m))
                found.add(str(i))
    return len(w), [j + 1 for j in sorted(hit)], sorted(found)


def bench_rows(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "cat", "Σας", "ΣΑΣ", "é", "É", "sat", "on2", "don't"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, "solo"), (52, "???")]
    rows = []
    for i in range(40):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        for _, x in rng.sample(items, 2):
            t += rng.choice(["  ", ". ", "\n"]) + (x or "").upper() + "! " + " ".join(word() for _ in range(3))
        rows.append((i, t))
    return items, [*rows, (100, None), (101, ""), (102, "solo SOLO solo"), (103, "x " * 50_000)]


def test_decontamination_is_brute_force(spark):
    items, rows = bench_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontamination.scan(docs(spark, rows), bench).collect()}
    assert got == {d: brute_hits(t, items) for d, t in rows}
    assert any(h for _, h, _ in got.values()) and any(not h for _, h, _ in got.values())


def test_decontamination_without_broadcast(spark, monkeypatch):
    items, rows = bench_rows(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: brute_hits(t, items) for d, t in rows}
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 1)
    monkeypatch.setattr(decontamination, "MOST_WORDS", 64)  # a bit set that is far too small only lets more through
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontamination.scan(docs(spark, rows), bench).collect()}
    assert got == want


def test_decontaminated_documents_and_spans(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "solo")], "item_id long, text string")
    rows = [(1, "Start A b c d e f, g h i j k end."), (1, "Start A b c d e f, g h i j k end."), (None, "x solo y"), (3, "clean text"), (4, None), (5, "")]
    df = docs(spark, rows)
    assert sorted((r.doc_id, len(r.hits)) for r in decontamination.scan(df.where("doc_id is not null"), bench).collect()) == [(1, 11), (1, 11), (3, 0), (4, 0), (5, 0)]
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(kept.toPandas().doc_id) == [3, 4, 5]
    spans = {(r.doc_id, r.text) for r in decontamination.decontaminated(df, bench, "spans").collect()}
    assert spans == {(1, "Start  end."), (None, "x  y"), (3, "clean text"), (4, None), (5, "")}
    assert decontamination.decontaminated(df, bench.limit(0)).count() == 6
    assert decontamination.decontaminated(df.limit(0), bench).count() == 0


# ---------------------------------------------------------------- WARC


def page_rows(spark):
    big = "é" * 60
    rows = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (4, "u", big), (None, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "x" * 300_000), (11, "u", "x" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    archive = warc.write(page_rows(spark))
    want = sorted([(3, 120, "response", None), (4, 120, "revisit", 3), (5, 120, "revisit", 3), (None, 120, "revisit", 3), (7, 5, "response", None), (8, 5, "response", None), (9, 0, "response", None), (10, 0, "response", None), (11, 300_000, "response", None), (11, 300_000, "response", None)], key=repr)
    for size in (200, 777, 1 << 20):
        rows = warc.read(spark, archive, range_bytes=size).collect()
        ids = lambda u: None if not u or u.endswith(":>") else int(re.search(r"(-?\d+)>", u)[1])
        assert sorted([(ids(r.record_id), r.payload_bytes, r.record_type, ids(r.refers_to)) for r in rows], key=repr) == want
        assert all(r.valid for r in rows)
        assert {hashlib.sha256(r.payload).hexdigest() for r in rows if r.payload is not None} <= {r.payload_digest for r in rows}
    assert warc.write(page_rows(spark).limit(0)).agg(F.sum("records")).first()[0] is None
    assert warc.read(spark, warc.write(page_rows(spark).limit(0))).count() == 0


def test_warc_reader_reads_each_byte_about_once():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            self.n += len(out)
            return out

    rng = random.Random(4)
    html = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 4000))) for _ in range(400)]
    made = [warc.record(i, "u", x, hashlib.sha256(x).hexdigest(), None, False, "2024-01-01T00:00:00Z") for i, x in enumerate(html)]
    raw = b"".join(x + (warc.MAGIC + b"junk" if i % 9 == 0 else b"") for i, x in enumerate(made))
    for step in (len(raw), 3 * warc.BLOCK, 100_000):
        n, got = 0, []
        for start in range(0, len(raw), step):
            source = Counted(raw)
            got += [r["payload"] for _, r in warc.records_in(source, len(raw), start, min(len(raw), start + step))]
            n += source.n
        assert got == html
        assert n <= (1.1 * len(raw) if step == len(raw) else len(raw) + (len(raw) // step + 1) * (warc.BLOCK + 8000))


def test_warc_reader_skips_false_magic_and_lists_files(spark, tmp_path):
    date = "2020-01-01T00:00:00Z"
    junk = b"\x1f\x8b\x08" + b"\0" * 40 + gzip.compress(b"not a record") + b"\x1f\x8b\x08"
    parts = [warc.record(i, "u", bytes([97 + i]) * 50, hashlib.sha256(bytes([97 + i]) * 50).hexdigest(), None, False, date) for i in range(5)]
    raw = b"".join(p + junk for p in parts)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = list(warc.records_in(io.BytesIO(raw), len(raw), 0, len(raw)))
    assert [r["payload"][:1] for _, r in got] == [b"a", b"b", b"c", b"d", b"e"]
    for cut in range(1, len(raw), 97):
        two = [o for a, b in ((0, cut), (cut, len(raw))) for o, _ in warc.records_in(io.BytesIO(raw), len(raw), a, b)]
        assert two == [o for o, _ in got]
    files = warc.files_of(spark, str(tmp_path))
    records = warc.read(spark, files, range_bytes=64)
    assert records.count() == 5 and records.rdd.getNumPartitions() >= len(raw) // 64
    lost = {(r.bytes, r.skipped) for r in warc.skipped(files, records).collect()}
    assert (len(raw), 5 * len(junk)) in lost and lost <= {(len(raw), 5 * len(junk)), (0, 0)}


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, min_words=line_dedup.MIN_WORDS):
    """Per later document, the places of all lines in common runs of enough words with any earlier one: every pair, every diagonal."""
    own = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in rows}
    out = {d: set() for d in own}
    for d, mine in own.items():
        for e, other in own.items():
            if e >= d:
                continue
            for shift in range(-len(other), len(mine)):
                run = []
                for i in range(len(mine) + 1):
                    if i < len(mine) and 0 <= i - shift < len(other) and mine[i] == other[i - shift]:
                        run.append(i)
                    else:
                        if sum(len(mine[k].split()) for k in run) >= min_words:
                            out[d].update(run)
                        run = []
    return out


def lis(values):
    best = [1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if values[j] < values[i]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_patience_is_a_longest_common_order():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 12)
        own = sorted(zip(rng.sample(range(50), n), rng.sample(range(50), n), [1] * n, strict=True))
        kept, moved = line_dedup.patience(own)
        assert sorted(kept + moved) == own and [x[1] for x in kept] == sorted(x[1] for x in kept)
        assert len(kept) == lis([x[1] for x in own])
    assert line_dedup.patience([]) == ([], [])


def test_patience_aligns_between_anchors_and_leaves_repeats():
    # (0, 0) and (50, 50) are anchors; of what repeats between them one place is unique inside the gap
    own = [(0, 0, 5), (10, 10, 3), (50, 50, 5), (70, 10, 3)]
    assert line_dedup.patience(own) == ([(0, 0, 5), (10, 10, 3), (50, 50, 5)], [(70, 10, 3)])
    twice = [(0, 0, 5), (9, 0, 5)]
    assert line_dedup.patience(twice) == ([], twice)
    assert line_dedup.blocks([(0, 5, 2), (1, 6, 3), (4, 9, 1), (7, 9, 1)]) == [(0, 5, 5), (7, 9, 1)]


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_aligned_blocks_are_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i} " + "w " * rng.randint(0, 30) for i in range(12)]
    rows = [(d, "\n".join(rng.choice([*pool, *pool, "", f"own {d} {i}"]) for i in range(rng.randint(0, 25)))) for d in range(25)]
    got = {d: set() for d, _ in rows}
    for r in line_dedup.aligned(docs(spark, rows)).collect():
        got[r.doc_id] = {i for s in r.spans for i in range(s["at"], s["at"] + s["n"])}
    assert got == brute_lines(rows) and any(got.values())


def test_lines_that_are_no_passage_of_one_document_stay(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(22)) for x in "ab")
    far = "\n".join([a, *[f"line {i}" for i in range(50)], b])
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, far), (5, f"{a}\n\n{b}"), (6, f"{a}\n{b}\nown")]
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_moved_lines) for r in line_dedup.deduplicated(docs(spark, rows), 40).collect()}
    # no earlier document holds both lines as neighbours before the third does
    assert got == {1: (a, 0, 0), 2: (b, 0, 0), 3: (f"{a}\n{b}", 0, 0), 4: (far, 0, 0), 5: ("", 2, 0), 6: ("own", 2, 0)}


def test_line_dedup_deletes_blocks_from_the_later_document(spark):
    passage = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(3)]
    head = "A short heading."
    first = "\n".join([head, "intro of one", *passage, "end of one"])
    second = "\n".join([head, "other intro", passage[0], "", *passage[1:], "other end"])
    moved = "\n".join(["third", passage[2], "between", passage[0], "x"])
    rows = [(1, first), (2, second), (3, moved), (4, None), (5, ""), (6, head), (7, first), (7, first), (None, "only null id")]
    got = {}
    for r in line_dedup.deduplicated(docs(spark, rows), 40).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed_lines))
    assert got[1] == [(first, 0)]
    assert got[2] == [("\n".join([head, "other intro", "", "other end"]), 3)]
    assert got[3] == [(moved, 0)]  # single lines of 30 words are below a block of 40
    assert got[4] == [(None, 0)] and got[5] == [("", 0)] and got[6] == [(head, 0)]
    assert got[7] == [("", 6), ("", 6)]
    assert line_dedup.deduplicated(docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_leaves_lines_of_no_other_document(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in df.collect()}
    holders = {}
    for d, t in rows.items():
        for x in {x.strip() for x in t.split("\n")}:
            holders.setdefault(x, set()).add(d)
    changed = 0
    for r in registry.op9_line_dedup(spark, SMALL).collect():
        left, all_ = r.text.split("\n") if r.text else [], rows[r.doc_id].split("\n")
        rest = iter(all_)
        assert all(x in rest for x in left)  # what is left is in order
        gone = list(all_)
        for x in left:
            gone.remove(x)
        assert all(min(holders[x.strip()]) < r.doc_id for x in gone if x.strip())
        changed += bool(gone)
    assert changed


def test_line_dedup_recall_over_documents(spark):
    """Of the lines of five words or more that an earlier document holds, hardly one is left."""
    held = lambda t: {x.strip() for x in (t or "").split("\n") if len(x.split()) >= 5}
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    left = {r.doc_id: r.text for r in registry.op9_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    first = {}
    for d in sorted(rows):
        for x in held(rows[d]):
            first.setdefault(x, d)
    before = {(d, x) for d in rows for x in held(rows[d]) if first[x] < d}
    after = {(d, x) for d, x in before if x in held(left[d])}
    assert len(before) > 1000 and len(after) <= 0.1 * len(before)


def surviving(rows, after, min_words):
    """Runs of lines of enough words that an earlier text holds and that still stand in a later one's result."""
    own = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in rows}
    runs = lambda v: {tuple(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1) if sum(len(x.split()) for x in v[i:j]) >= min_words}
    held = {d: runs(v) for d, v in own.items()}
    left = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in after.items()}
    # runs of the result that are no longer neighbours in the text aren't passages of it
    return [(e, d) for d in own for e in own if e < d and held[e] & held[d] & runs(left[d])]


def passage(name, n_lines=3, n_words=20):
    return [" ".join(f"{name}{i}w{j}" for j in range(n_words)) for i in range(n_lines)]


def test_passages_in_another_order_than_the_first_holder(spark, monkeypatch):
    p, q = passage("p"), passage("q")
    rows = [(1, "\n".join([*p, "between one", *q])), (2, "\n".join(["two", *q])), (3, "\n".join([*q, "own three", *p]))]
    got = {r.doc_id: (r.text, r.n_moved_lines) for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    # the passage is aligned in order with its other holder
    assert got == {1: (rows[0][1], 0), 2: ("two", 0), 3: ("own three", 0)}
    # and is a moved one where each run has one partner
    monkeypatch.setattr(line_dedup, "RARE", 1)
    got = {r.doc_id: (r.text, r.n_moved_lines) for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("two", 0), 3: ("own three", 3)}


def test_passages_with_lines_that_occur_more_often_elsewhere(spark):
    p = passage("p", 2, 30)
    whole = [p[0], "Read more", p[1]]
    rows = [(1, "\n".join(["one", *whole])), (2, "\n".join(["two", "Read more", "own", *whole, "end"])), (3, "\n".join([*whole, "own three", *whole]))]
    got = {r.doc_id: (r.text, r.n_removed_lines, r.n_removed_words) for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("two\nRead more\nown\nend", 3, 62), 3: ("own three", 6, 124)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_shared_passage_survives(spark, seed):
    rng = random.Random(seed)
    pool = [passage(f"s{k}x", rng.randint(1, 4), rng.choice([12, 25, 45])) for k in range(8)]
    rows = []
    for d in range(30):
        parts = [x for k in range(rng.randint(0, 4)) for x in [*rng.choice(pool), rng.choice(["Read more", "", f"own {d} {k}"])]]
        rows.append((d, "\n".join(parts)))
    after = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert not surviving(rows, after, line_dedup.MIN_WORDS)
    held = {x for t in after.values() for x in t.split("\n")}
    assert all(x in held for _, t in rows for x in t.split("\n") if x)  # every line is left somewhere


# ---------------------------------------------------------------- surrogates

MENTIONS = [
    (1, "Mail Joe.Blow12@Mail3.example.com or joe.blow12@mail3.example.com."),
    (2, "call +1 (337) 555-7349 or 337-555-7349; card 4952935900253052, 4952-9359-0025-3052"),
    (3, "ip 169.122.221.182, v1.2.3; token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" password: 'hunter2!x'"),
    (4, "Mr. John Smith met Mrs. Mary SMITH and Mr Smith; г-жа Анна Иванова."),
    (5, "ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00"),
    (6, "nothing 2024-01-02 12345 here"), (7, ""), (8, None), (9, "joe.blow12@mail3.example.com"), (9, "joe.blow12@mail3.example.com"), (None, "169.122.221.182"),
]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_surrogates_keep_types_and_coreference(spark):
    rows = {}
    out = pii.pseudonymised(docs(spark, MENTIONS), "k")
    assert set(out.columns) == {"doc_id", "text", "lang", "component_id", "n_entities"}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append((r.text, r.n_entities))
    assert all(len(v) == (2 if d == 9 else 1) for d, v in rows.items()) and len(rows) == 10
    said = {d: v[0][0] for d, v in rows.items()}
    a, b = re.findall(r"\S+@\S+com", said[1])
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{3}\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", a)
    assert rows[9] == [(b, 1), (b, 1)]
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}); card (\d{16}), ([\d-]{19})", said[2])
    assert m and f"{m[1]}-{m[2]}" == m[3] != "337-555-7349" and m[4] == m[5].replace("-", "") != "4952935900253052"
    assert luhn(m[4]) % 10 == 0
    assert "v1.2.3" in said[3] and re.search(r"[0-9a-f]{40}", said[3]) and "b44e" not in said[3] and "hunter2" not in said[3]
    assert said[None] == re.search(r"ip ([\d.]+),", said[3])[1] != "169.122.221.182"
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr (\w+); г-жа (\w+) (\w+)\.", said[4])
    assert m and m[2].upper() == m[4] == m[5].upper() and m[2] != "Smith"
    assert not m[1].endswith("na") and m[3].endswith("na") and m[6].endswith("на") and m[7].endswith("ва")
    assert "123-45-6789" not in said[5] and re.search(r"DE\d\d( \d{4}){4} \d\d", said[5])
    assert rows[6] == [(MENTIONS[5][1], 0)] and rows[7] == [("", 0)] and rows[8] == [(None, 0)]
    other = {r.doc_id: r.text for r in pii.pseudonymised(docs(spark, MENTIONS), "another").collect()}
    assert other[1] != said[1]
    assert pii.pseudonymised(docs(spark, MENTIONS).limit(0), "k").count() == 0


FORMS = [
    "06 12 34 56 78", "01.42.68.53.00", "030 1234567", "+49 (0)30 1234567", "+33 6 12 34 56 78", "612 345 678", "912 34 56 78", "089/1234567", "(030) 1234567",
    "0033 6 12 34 56 78", "020 7946 0958", "07911 123456", "3782 822463 10005", "3782-822463-10005", "0612345678", "+34 612 34 56 78", "+44 20 7946 0958", "+12345",
]
NAMES = ["Dr. Meier", "Prof. Dr. Weber", "Don Quijote", "Doña Inés", "Herr Dr. Hans Meier", "Wolfgang Schmidt", "Céline Dupont", "Hans-Peter Krause", "Álvaro García", "Emily Watson", "Lady Ashton"]


def test_national_phones_cards_and_further_names(spark):
    rows = [(i, f"see {x}, or not") for i, x in enumerate([*FORMS, *NAMES])]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymised(docs(spark, rows), "k").collect()}
    digits = lambda t: re.sub("[^0-9]", "", t)
    for i, x in enumerate(FORMS):
        text, n = got[i]
        assert n == 1 and re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", rows[i][1]), x
        assert digits(text)[-6:] != digits(x)[-6:], x
    # the same number with and without its country's code is one entity
    end = lambda x, n: digits(got[FORMS.index(x)][0])[-n:]
    assert end("06 12 34 56 78", 9) == end("+33 6 12 34 56 78", 9) == end("0033 6 12 34 56 78", 9)
    assert end("030 1234567", 9) == end("+49 (0)30 1234567", 9)
    for i, x in enumerate(NAMES, len(FORMS)):
        family = x.split()[-1]
        assert got[i][1] and family not in got[i][0], x
    assert got[len(FORMS) + 1][0].startswith("see Prof. Dr. ")
    clean = ["on 01.02.2024 12:30 or 01-02-2024 10", "x = 5 + 1 2 3", "pages 010-020, 2024 12 31", "1.234.567", "The Meier", "Emily said", "3782 82246 3"]
    assert all(r.n_entities == 0 for r in pii.pseudonymised(docs(spark, list(enumerate(clean))), "k").collect())


def test_surrogates_are_injective_under_collisions(spark):
    # all digits but one are taken: only a permutation without fixed points is left, and no entity may be hit
    norms = [("ssn", f"00000000{i}") for i in range(1, 8)] + [("family", f"name{i}") for i in range(3000)]
    rows = pii.surrogates(spark.createDataFrame(norms, "kind string, norm string"), "k").collect()
    assert len(rows) == len(norms) and len({(r.kind, r.sur) for r in rows}) == len(norms)
    assert not {(r.kind, r.sur) for r in rows} & set(norms)


def test_surrogates_end_where_their_space_is_full(spark):
    # every number of five digits and every secret of this form is taken: surrogates get longer
    norms = [("ssn", f"{i:02d}") for i in range(100)] + [("secret", f"*****{i}") for i in range(10)] + [("iban", "DE00"), ("email", "a@b.de")]
    rows = pii.surrogates(spark.createDataFrame(norms, "kind string, norm string"), "k").collect()
    assert len({(r.kind, r.sur) for r in rows}) == len(norms) and not {(r.kind, r.sur) for r in rows} & set(norms)
    wide = spark.createDataFrame([("ssn", "1-2", "345"), ("ssn", "+4 1-2", "34"), ("iban", "DE1 2", "DE345"), ("email", "A@b.de", "xya@c.de")], "kind string, raw string, sur string")
    assert [r[0] for r in wide.select(pii.poured(F.col("kind"), F.col("raw"), F.col("sur"))).collect()] == ["34-5", "+4 3-4", "DE34 5", "XYA@c.de"]
    with pytest.raises(RuntimeError):
        pii.surrogates(spark.createDataFrame(norms, "kind string, norm string"), "k", most=1)


def test_hostile_texts_end(spark):
    n = 1 << 18
    texts = ['config: password="********" end', "config: password='парольный1' end", "a@" + "b." * (n // 2) + "com", "a%" * (n // 2) + "@x.de", "1 " * (n // 2), "12-" * (n // 3), "Mr " * (n // 3), "Aa " * (n // 3)]
    texts += ["AB12 " * (n // 5), "f" * n, "9" * n, "+1 (2" * (n // 5), "1.2.3." * (n // 6), "token='" + "x" * 200_000 + "'", "Mr " + "A" * n, "x@" + "a" * n, "James " * (n // 6), "=" * n, "0 1" * (n // 3), "password=\"" * (n // 10)]
    rows = {r.doc_id: r for r in pii.pseudonymised(docs(spark, list(enumerate(texts))).repartition(8), "k").collect()}
    assert len(rows) == len(texts) and rows[0].text == texts[0] and rows[0].n_entities == 0
    said = re.fullmatch("config: password='([а-я]+)([0-9])' end", rows[1].text)
    assert said and len(said[1]) == 9 and said[1] != "парольный"
    assert re.fullmatch("token='[a-z]{200000}'", rows[13].text) and rows[13].text != texts[13]


def test_card_numbers_have_to_check_and_family_names_are_found_alone(spark):
    rows = [(1, "4952935900253053 and 9807915762804490, 4952935900253052"), (2, "Mr John Smith came. Smith and Blacksmith left; SMITH. Mrs Smith too."), (3, "Smith alone"), (4, "κ. x; Mr Παύλος Νικολάου said")]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymised(docs(spark, rows), "k").collect()}
    assert got[1][1] == 1 and got[1][0].startswith("4952935900253053 and 9807915762804490, ") and not got[1][0].endswith("4952935900253052")
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+) and Blacksmith left; SMITH\. Mrs (\w+) too\.", got[2][0])
    assert m and m[2] == m[3] == m[4] != "Smith" and got[2][1] == 4
    assert got[3] == ("Smith alone", 0) and re.fullmatch(r"κ\. x; Mr [α-ωΑ-Ω]+ [α-ωΑ-Ω]+ said", got[4][0])


def test_surrogates_over_documents(spark):
    planted = re.compile(r"[\w.+-]+@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)|\b[0-9a-f]{40}\b|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    after = {r.doc_id: r.text for r in registry.op4_pii(spark, SMALL).collect()}
    assert set(before) == set(after)
    real = {m for t in before.values() for m in planted.findall(t) if not re.fullmatch(r"\d{16}", m) or (luhn(m) % 10 == 0 and m[0] in "23456")}
    assert real and not any(m in t for m in real for t in after.values())
    for d, t in before.items():
        if not planted.search(t) and not re.search(r"\d{3}", t):
            assert after[d] == t


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = docs_
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs_.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.mode("overwrite").parquet(path)
        rows, kept = {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in spark.read.parquet(path).collect()}
        assert set(kept) <= set(rows)
        if name == "near_dedup":
            want = brute_components(rows.items(), 5, 80)
            assert set(kept) == {d for d, (_, c) in want.items() if c == d}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert set(kept) == {d for d, t in rows.items() if not brute_hits(t, items)[1]}
        now = spark.read.parquet(path)
    out = cp.run(spark, SMALL)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_language_and_line_stages_send_a_text_to_python_once(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"words {i} and lines enough to keep here\nand {i} others", "en", 40) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:2]:
        plan = stage(spark, table, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("ArrowEvalPython", plan)) == 1, (name, plan)


def test_stages_with_inner_names_as_columns(spark):
    """Further columns of any name come back as they are; so do those of empty tables."""
    import corpus_pipeline as cp

    names = ["__id", "__th", "__at", "__n", "__m", "__c", "__p", "__x", "__s", "__f", "__row", "__hash", "__hits", "__gaps", "component", "n_removed_lines", "score", "len", "items", "window", "further 0"]
    few = spark.read.parquet(f"{SMALL}/documents.parquet")
    wide = few.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns, name
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == {r.doc_id for r in stage(spark, few, SMALL).collect()}, name
        assert all(r[n] == f"kept {n}" for r in got.values() for n in names), name
        assert stage(spark, wide.limit(0), SMALL).collect() == []
    assert cp.packed(spark, wide, SMALL).count() >= wide.count()
    for f in (lambda d: pii.pseudonymised(d, "k"), lambda d: decontamination.decontaminated(d, few.limit(0).withColumnRenamed("doc_id", "item_id"), "spans")):
        assert {r["__x"] for r in f(wide).collect()} == {"kept __x"}
