"""Merkle manifest, license scan and filter audit against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from lodestone.llm import filter_audit, license_scan, merkle, registry
from lodestone.llm.license_scan import Template
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
#: Inner names of the operators, as further columns of their input.
CLASH = ["row", "grp", "leaf", "now", "no", "at", "part", "i", "n", "block", "blocks", "words", "own", "template", "label", "base", "digest", "first", "fails", "step", "t", "w", "x", "A", "E", "good", "bad", "score", "labels", "root", "proof"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


# ---------------------------------------------------------------- Merkle manifest


def brute_manifest(rows, changed):
    """Each row's result, from a tree that holds everything at once."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)

    def proofs(nodes):
        """Per node the list of (left, right) siblings, and the top."""
        places, steps, level = list(range(len(nodes))), [[] for _ in nodes], nodes
        while len(level) > 1:
            for k, p in enumerate(places):
                run = level[p // 8 * 8 : p // 8 * 8 + 8]
                steps[k].append((run[: p % 8], run[p % 8 + 1 :]))
                places[k] = p // 8
            level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        return steps, level[0]

    made, tops = [], []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        steps, top = proofs([leaf(r) for r in own])
        made.append((own, steps, top))
        tops.append(top)
    upper, root = proofs(tops)
    out = []
    for (own, steps, top), last in zip(made, upper, strict=True):
        for r, s in zip(own, steps, strict=True):
            now, said = leaf(changed(r)), []
            for left, right in s + last:
                said += left + right
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), top, root, h(*said), now, now == root))
    return sorted(out, key=str)


def lowered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
    return (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])) if hit else r


def manifested(df):
    text = F.translate("text", merkle_upper, merkle_upper.lower())
    now = merkle.leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    return merkle.manifest(df, COLUMNS, candidate=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, now))


merkle_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(rows):
    return sorted([tuple(r)[:7] for r in rows], key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 300])
def test_manifest_is_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 - 5, rng.choice(["a", None]), rng.choice(["en", "de", "é", "", None]), rng.randrange(99), rng.choice(["Text", "text", "", None, "Ä\n"]) if i % 4 else f"T {i}") for i in range(n)]
    rng.shuffle(rows)
    got = manifested(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert plain(got.collect()) == brute_manifest(rows, lowered)


def test_manifest_in_several_rounds(spark, monkeypatch):
    # small blocks and a small top: blocks of nodes are reduced too, twice
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "TOP", 4)
    rows = [(i, "s", "en" if i % 5 else "de", i, f"Text {i}") for i in range(700)]
    assert plain(manifested(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_manifest(rows, lowered)


def test_manifest_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS).collect()]
    got = registry.op11_merkle(spark, SMALL).collect()
    assert plain(got) == brute_manifest(rows, lowered)
    upper = {r[0] for r in rows if lowered(r) != r}
    assert {r.doc_id for r in got if not r.verified} == upper and upper


def test_manifest_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (3, "s", None, 1, "AB"), (3, "s", None, 1, "AB"), (3, "s", None, 2, "ab"), (1, "s", "en", 1, "X" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    want = brute_manifest(rows, lowered)
    assert plain(manifested(df).collect()) == plain(manifested(clash).collect()) == want
    assert manifested(df.limit(0)).collect() == []
    proofs = merkle.manifest(df, COLUMNS, with_proofs=True).collect()
    assert all(r.verified and r.proof_sha256 == h(*r.proof) for r in proofs)


# ---------------------------------------------------------------- license scan


def brute_scan(rows, templates, threshold):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    stride = max(32, *(len(t.words()) for t in templates))
    out = {}
    for key, text in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels, base, score = [], set(), set(), 0.0
        at = 0
        while w:
            block = w[at : at + 2 * stride]
            for t in templates:
                own = t.words()
                share = len(set(own) & set(block)) / len(set(own))
                if not t.phrase and share >= threshold - 1e-12:
                    labels.add(t.label)
                    score = max(score, share)
                for i in range(len(block)):
                    if t.phrase and block[i : i + len(own)] == own:
                        labels.add(t.label)
                        score = 1.0
                        if t.base:
                            base.add(t.label)
                            places.append((t.text, at + i))
            if at + 2 * stride >= len(w):
                break
            at += stride
        p = {x for x in places}
        at = sorted(i for _, i in p)
        out[key] = (len(w), len(p), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))
    return out


def scanned(df, templates=license_scan.TEMPLATES, threshold=license_scan.THRESHOLD):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan.scan(df, templates, threshold).collect()}


def licensed_rows(seed):
    rng = random.Random(seed)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in t.words()}) + [f"w{i}" for i in range(60)]
    rows = []
    for key in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            t = list(rng.choice(license_scan.TEMPLATES).words())
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            w += t
        rows.append((key, rng.choice([" ", "-", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_license_scan_is_brute_force(spark, threshold):
    rows = licensed_rows(int(threshold * 10))
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold)
    want = brute_scan(rows, license_scan.TEMPLATES, threshold)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len({v[5] for v in want.values()}) > 10


def test_phrases_across_blocks_lines_and_overlaps(spark):
    far = " ".join(f"w{i}" for i in range(62))
    rows = [(1, f"{far} GNU General\nPublic-License {far} mit license"), (2, "mit license mit license"), (3, "CC-BY cc by"), (4, "MitK license"), (5, "apache2 license"), (6, far * 40 + " apache license")]
    own = [Template("twice", "ha ha ha", phrase=True), Template("kin", "kelvin k", phrase=True), *license_scan.BASE]
    rows += [(7, "ha ha ha ha"), (8, "ha ha"), (9, "kelvin K"), (10, "Kelvin K")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert scanned(df, own) == brute_scan(rows, own, 0.8)
    got = scanned(df, own)
    assert got[7][5] == "twice" and got[8][5] == "" and got[9][5] == "" and got[10][5] == "kin" and got[1][1] == 2


def test_license_scan_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: (*tuple(r)[1:7], round(r.score, 9)) for r in registry.op12_license_scan(spark, SMALL).collect()}
    assert got == brute_scan(rows, license_scan.TEMPLATES, 0.8)


def test_license_scan_odd_rows(spark):
    long = "word " * 200_000 + "MIT License"
    df = spark.createDataFrame([(1, None), (2, ""), (3, " . "), (4, long), (5, "mit license"), (5, "mit license"), (None, "mit license")], "doc_id long, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    got = sorted((tuple(r) for r in license_scan.scan(df).collect()), key=str)
    none, mit = (0, 0, None, None, "", "", 0.0), (2, 1, 0, 0, "mit", "mit", 1.0)
    assert got == sorted([(1, *none), (2, *none), (3, *none), (4, 200_002, 1, 200_000, 200_000, "mit", "mit", 1.0), (5, *mit), (5, *mit), (None, *mit)], key=str)
    assert license_scan.scan(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        license_scan.scan(df, [Template("x", "...")])


# ---------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    """Replays every order document by document."""
    first, flags = {}, []
    for key, _, text in rows:
        t = text or ""
        if key is not None:
            first[t] = min(key, first.get(t, key))
    for key, lang, text in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), key is not None and first[t] < key]
        flags.append((lang or "", dict(zip("ABCDE", fails, strict=True)), any(q == 1 for k, q, _ in labels if k == key and key is not None), any(x == 1 for k, _, x in labels if k == key and key is not None)))
    parts, out, total = {p for p, *_ in flags}, {}, {}
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for s in range(1, 6):
                out[part, order, s] = [0] * 6
    for part, f, good, toxic in flags:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for s, x in enumerate(order, 1):
                c = out[part, order, s]
                if f[x] and gone:
                    c[2] += 1
                elif f[x]:
                    c[1] += 1
                    c[4] += good
                    c[5] += toxic
                    total[part, x] = total.get((part, x), 0) + 1
                    gone = True
                c[0] += not gone
                c[3] += f[x] and sum(f.values()) == 1
    return {k: (*v, total.get((k[0], k[1][k[2] - 1]), 0)) for k, v in out.items()}


def audit(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audited(docs, labels).collect()}


def test_audit_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice([None, "", "A#", "a b " * 150, " ".join(f"w{k}" for k in range(250)), "X Y Z " + " ".join(f"v{k}" for k in range(220)), f"own {i}"])) for i in range(60)]
    rows += [(None, "en", "A#"), (None, None, None), rows[0], rows[0], (70, "fr", "\x85" * 3 + "É" * 50)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(0, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    assert audit(df, lab) == want
    clash = [F.lit("x").alias(c) for c in CLASH]
    assert audit(df.select("*", *clash), lab.select("*", *clash)) == want
    assert audit(df.limit(0), lab) == {} and audit(df, lab.limit(0)).keys() == want.keys()


def test_audit_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in registry.op13_filter_audit(spark, SMALL).collect()}
    assert got == brute_audit(rows, labels)


def test_replay_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), (None, False, True)], "part string, x boolean, y boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.replayed(rows, ["x", "y"]).collect()}
    assert got["p", "xy", 1] == (0, 2, 0, 1, 3) and got["p", "xy", 2] == (0, 0, 1, 0, 1)
    assert got["p", "yx", 1] == (1, 1, 0, 0, 1) and got[None, "xy", 2] == (0, 1, 0, 1, 2)
    with pytest.raises(ValueError):
        filter_audit.replayed(rows, ["long"])
