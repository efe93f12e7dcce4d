"""Language ID, packing, token counts, quality rules, chat formatting: brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from lodestone.llm import chat_format, language_id, packing, quality, registry, token_counts
from lodestone.llm.tokens import ByteLevelIds, PieceCache, ranked, sentencepiece, tokenizer
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = list("aàB1 9.,\n\t\r é▁\x00\x1c\x85  中文😀'🇫ـم٣") + ["  ", "\n\n", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", " the", "'ll", "ﬁ", "½", " x"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string")


def test_ids_are_those_of_the_library():
    ours, lib = ByteLevelIds("byte_bpe_50k"), tokenizer("byte_bpe_50k.json")
    for t in odd_texts(3000):
        assert list(ours.ids(t)) == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_piece_cache_is_the_library():
    ours, lib = PieceCache("piece_bpe_32k.model", tuple), sentencepiece("piece_bpe_32k.model")
    for t in odd_texts(3000):
        assert [i for v in ours.values(t) for i in v] == lib.encode(t), ascii(t)


def test_piece_cache_generations(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    ours, lib = PieceCache("piece_bpe_32k.model", len, {"a": 1}), sentencepiece("piece_bpe_32k.model")
    for t in ["a b c d e f g a b c", "x y z a b q", "a a a"]:
        assert sum(ours.values(t)) == len(lib.encode(t))
        assert len(ours) <= 5


def test_counts_with_clashing_column_nulls_and_long_texts(spark):
    long = "wort " * 60_000 + "ende"
    df = texts(spark, [(1, None, "x", "9"), (2, "", "x", "9"), (2, "", "x", "9"), (None, "ab  c", None, None), (3, long, "x", "")])
    got = token_counts.count_tokens(df).collect()
    lib = sentencepiece("piece_bpe_32k.model")
    assert sorted(r.n_tokens for r in got) == sorted([0, 0, 0, len(lib.encode("ab  c")), len(lib.encode(long))])
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_frequent_pre_tokens_are_those_of_the_whole_corpus(spark):
    df = texts(spark, [(i, "alpha beta " * 3 if i < 300 else "gamma delta " * 9, "x", "") for i in range(600)] + [(900, None, None, None)]).coalesce(1)
    lib = sentencepiece("piece_bpe_32k.model")
    got = token_counts.frequent_lengths(df, entries=2)
    assert got.keys() == {"gamma", "delta"}
    assert token_counts.frequent_lengths(df).keys() == {"alpha", "beta", "gamma", "delta"} and got["gamma"] == len(lib.encode("gamma"))


def test_counts_query_is_brute_force(spark):
    lib = sentencepiece("piece_bpe_32k.model")
    want = {r.doc_id: (len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in registry.op5_token_counts(spark, SMALL).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (*want[r.doc_id], want[r.doc_id][1] > 4096)


@pytest.mark.parametrize("seed", range(5))
def test_differencing_partitions(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 300))]
    k = rng.randint(1, 20)
    sets = packing.differenced(sizes, k)
    assert len(sets) == k and sorted(i for s in sets for i in s) == list(range(len(sizes)))
    if len(sizes) >= 8 * k:
        sums = [sum(sizes[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= 8


def test_differencing_by_hand():
    # 8 and 7 differ least from 6, 5, 4 by differencing: {8, 6} and {7, 5, 4} with two windows
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differenced([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]
    assert packing.windows([], 10) == [[]]
    assert sorted(map(len, packing.windows([10, 10, 10], 10))) == [1, 1, 1]
    assert len(packing.windows([6, 6, 6], 10, 0.5)) == 3  # two windows would hold 12
    # without leave to pad, the surplus of two is cut off and moved
    assert sorted(sorted(x) for x in packing.windows([6, 6, 6], 10, 0)) == [[(0, 0, 6), (2, 4, 2)], [(1, 0, 6), (2, 0, 4)]]


@pytest.mark.parametrize("seed", range(5))
def test_windows_hold_every_id_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 2047, 2048, rng.randint(1, 2047)]) for _ in range(rng.randint(1, 250))]
    own = packing.windows(sizes)
    assert all(sum(n for _, _, n in w) <= packing.CAPACITY for w in own)
    assert len(own) <= max(-(-sum(sizes) // packing.CAPACITY), sum(sizes) / (0.98 * packing.CAPACITY))
    at = {i: 0 for i in range(len(sizes))}
    for i, start, n in sorted(x for w in own for x in w):
        assert start == at[i] and n > 0
        at[i] += n
    assert at == dict(enumerate(sizes))
    assert sum(map(len, own)) <= len(sizes) + 2 * len(own)


def check_packing(rows, want, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert set(by_doc) == set(want)
    return sum(r.length for r in rows) / (capacity * len(by_seq))


def test_packing_query_is_brute_force(spark):
    lib = tokenizer("byte_bpe_50k.json")
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_packing(registry.op3_packing(spark, SMALL).collect(), want) > 0.97


def test_packing_odd_rows(spark):
    df = texts(spark, [(1, None, "x", ""), (2, "", "x", ""), (3, "<|endoftext|> a", "x", ""), (4, "ab " * 30_000, "x", "")])
    lib = tokenizer("byte_bpe_50k.json")
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    check_packing(packing.pack(df).collect(), want)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(texts(spark, [(None, "x", "", ""), (None, "x", "", "")])).count() == 2
    for space in (" " * 1_000_000, "a" + "\n" * 1_200_000, "b" * 300_000):
        t = texts(spark, [(1, space, "x", "")])
        check_packing(packing.pack(t).collect(), {1: [*lib.encode(space, add_special_tokens=False).ids, 1]})
    ids = packing.pack(df.where("doc_id = 3"), with_ids=True).first().ids
    assert ids == want[3]


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts_are_brute_force():
    rng = random.Random(5)
    cases = ["", " ", "a b c d e f g h " * 3, "x\nx\n x\n\n\n", "é ü # <", "a b c d e f g h", *odd_texts(200)]
    cases += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    for t in cases:
        assert quality.base_counts(t) == brute_base(t), ascii(t)


def test_quality_query(spark):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = registry.op8_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        base = brute_base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)


def test_fertility_bands(spark):
    lib = sentencepiece("piece_bpe_32k.model")
    good = "The quick brown fox jumps over the lazy dog while nobody in the small town looks at the river or the old mill behind it."
    cases = [(1, good, "en", ""), (2, "𓀀𓀁𓀂𓀃 " * 30, "en", ""), (3, "aaaa bbbb " * 40, "en", ""), (4, "q7 x9 z3 k1 w0 j5 v2 " * 8, "en", ""), (5, None, None, None), (6, "мы шли домой по старой дороге " + "и пели песни о доме и о лете " * 1 + "пока не стало темно над рекой и лесом где живут тихие звери и большие птицы", "ru", "")]
    rows = {r.doc_id: r for r in quality.judged(quality.fertility(texts(spark, cases))).collect()}
    assert rows[1].kept and rows[1].n_tokens == len(lib.encode(good))
    assert rows[1].chars_per_token == len(good) / rows[1].n_tokens and rows[1].byte_share == 0
    assert not rows[2].kept and rows[2].byte_share > 0.9 and rows[2].script == "latin" or rows[2].script == "other"
    assert not rows[3].kept and not rows[4].kept and not rows[5].kept
    assert rows[6].script == "cyrillic"
    ids = lib.encode(good)
    p = np.array([ids.count(i) for i in set(ids)]) / len(ids)
    assert rows[1].token_entropy == pytest.approx(float(-(p * np.log2(p)).sum()))


def test_letterless_text_and_high_entropy_have_bands(spark):
    digits = " ".join(str(1000 + 37 * i) for i in range(60))
    rows = {r.doc_id: r for r in quality.judged(quality.fertility(texts(spark, [(1, digits, "en", "")]))).collect()}
    assert (rows[1].script, rows[1].reason) == ("none", "low_chars_per_token")
    narrow = quality.BANDS | {"none": (0.1, 12.0, 0.2, 0.0, 1.0)}
    assert quality.judged(quality.fertility(texts(spark, [(1, digits, "en", "")])), narrow).first().reason == "high_entropy"


def test_fitted_bands_find_what_is_unlike_its_language(spark):
    rng = random.Random(8)
    words = [r.text.split() for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").collect()]
    words = sorted({w for t in words for w in t if w.isalpha()})
    clean = lambda: " ".join(rng.choice(words) for _ in range(150))
    junk = [
        " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(150)),
        " ".join(w.upper() + rng.choice([".!!", "!!"]) for w in clean().split()),
        " ".join(rng.choice(words[:8]) for _ in range(150)),
        " ".join(w + rng.choice(["%%%", "&&&", "***"]) for w in clean().split()),
    ]
    df = texts(spark, [(i, clean(), "en", "") for i in range(120)] + [(1000 + i, t, "en", "") for i, t in enumerate(junk)] + [(2000, clean(), "xx", "")])
    measured = quality.fertility(df)
    old = quality.judged(measured, lang_col="lang").where("doc_id >= 1000 and kept").count()
    rows = {r.doc_id: r for r in quality.judged(measured, lang_col="lang", fits=quality.fitted(measured, "lang")).collect()}
    assert old >= 3 and len(rows) == 125
    assert not any(rows[1000 + i].kept for i in range(4)) and sum(rows[i].kept for i in range(120)) >= 117
    assert rows[2000].kept  # a language with too few texts has its script's band


def brute_bands(rows):
    """(key, size, measure) to (low, high), from sorted values of distinct rows that pass the base rules."""
    groups = {}
    for key, size, base, measures, failed in set(rows):
        if not failed and key is not None and measures[3]:
            for m, v in zip(("chars_per_token", "chars_per_token_b"), measures, strict=False):
                groups.setdefault((key, size, m), []).append(v)
                groups.setdefault((key, -1, m), []).append(v)
            if measures[3] >= 32:
                groups.setdefault((key, size, "token_entropy"), []).append(measures[2])
    out = {}
    for g, v in groups.items():
        if len(v) >= 30:
            step, least = (0.01, 0.1) if g[2] == "token_entropy" else (0.005, 0.05)
            b = sorted(int(np.floor(x / step)) for x in v)
            q1, q3 = b[-(-len(b) // 4) - 1] * step, (b[-(-3 * len(b) // 4) - 1] + 1) * step
            width = 3 * max(q3 - q1, least)
            out[g] = (q1 - width, q3 + width)
    return out


def test_quality_verdicts_are_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    lib, other = sentencepiece("piece_bpe_32k.model"), ranked("byte_bpe_multi_50k.tiktoken")
    rows = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, base = lib.encode(r.text), brute_base(r.text)
        n, p = len(ids), np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        measures = (len(r.text) / n, len(r.text) / len(other.encode_ordinary(r.text)), round(float(-(p * np.log2(p)).sum()), 9), n)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        rows[r.doc_id] = (r.lang if any(c.isalpha() for c in r.text) else None, n.bit_length() - 1, base[:2], measures, failed)
    bands = brute_bands(list(rows.values()))
    kept = {}
    for d, (key, size, _, (c, b, e, n), failed) in rows.items():
        def inside(m, v, low, high):
            own = [bands[g] for s in (size, -1) if (g := (key, s, m)) in bands]
            if own:
                low, high = max(low, min(x[0] for x in own)), min(high, max(x[1] for x in own))
            return low <= v <= high

        fine = inside("chars_per_token", c, 1.4, 12) and inside("chars_per_token_b", b, 1.4, 12)
        kept[d] = not failed and fine and (n < 32 or inside("token_entropy", e, 2.0, 11.5))
    got = {r.doc_id: r.kept for r in registry.op8_quality_rules(spark, sf).collect()}
    assert got.keys() == kept.keys() and [d for d in kept if kept[d] != got[d]] == []
    assert len(bands) > 10 and 0.02 < np.mean([not k for d, k in kept.items() if not rows[d][4]]) < 0.3


def test_quality_of_long_white_space(spark):
    df = texts(spark, [(1, "word" + " " * 1_200_000 + "end", "en", "")])
    r = quality.fertility(df).first()
    assert r.n_words == 2 and r.chars_per_token_b > 1


@pytest.mark.parametrize("space", [" ", "\n", " \t"])
def test_counts_of_long_white_space_are_those_of_the_library(space, monkeypatch):
    from lodestone.llm import tokens

    name = "byte_bpe_multi_50k.tiktoken"
    monkeypatch.setattr(tokens, "_LONG", re.compile(r"\s{50,}"))
    for text in ("a{0}b", "{0}", "{0}b", "a{0}", "a{0}b{0}\u00a0{0}'s 1{0}.", "x {0}y"):
        t = text.format((space * 100)[:100]) + "z" * tokens.LONG_SPACE
        assert tokens.ranked_count(t, name) == len(tokens.ranked(name).encode_ordinary(t))
        t = "z" * tokens.LONG_SPACE + text.format((space * 100)[:100])
        assert tokens.ranked_count(t, name) == len(tokens.ranked(name).encode_ordinary(t))


def test_quality_query_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.op8_quality_rules(spark, sf).collect() if not r.base_failed]
    junk, clean = ([r.kept for r in rows if good.get(r.doc_id) == x] for x in (0, 1))
    assert np.mean(junk) < 0.7 and np.mean(clean) > 0.98


def test_language_id_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train_on(df)
    # unfolded: the mean of embeddings' class scores, word by word of a plain loop
    for r in df.orderBy("doc_id").limit(5).collect():
        z = np.mean([model.table[b] for b in language_id.buckets(r.text)], axis=0) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert model.predict(r.text) == (model.labels[int(e.argmax())], pytest.approx(float(e.max() / e.sum())))
    # what is in no language of the corpus is rejected, what is in one isn't
    strange = ["мы шли домой по старой дороге и пели песни", "你好世界这是一个测试文本", "qx7 zzv kkw rrt pqj xxv " * 5, "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ" * 3]
    asked = texts(spark, [(i, t, None, "") for i, t in enumerate(strange)])
    assert all(r.rejected for r in language_id.identify(asked, model).collect())
    held = language_id.identify(df.where(language_id.fold() == 1), model)
    assert np.mean([r.rejected for r in held.collect()]) < 0.01
    curve = {r.threshold: (r.coverage, r.error) for r in language_id.risk(held).collect()}
    assert curve[0.0][0] == 1 and curve[0.99][0] <= curve[0.5][0] and curve[0.9][1] <= 0.01


def test_language_id_threshold_follows_the_error_of_whole_texts():
    one = lambda label, bucket, whole: (label, np.array([bucket]), np.array([1.0], np.float32), whole)
    table = np.zeros((1 << language_id.BITS, 2))
    table[0], table[1], table[2] = (4.0, 0.0), (0.0, 4.0), (1.0, 0.0)

    def threshold(wrong, whole):
        model = language_id.Model(["a", "b"], table, np.zeros(2))
        rows = [one("a", 0, True)] * 100 + [one("b", 1, True)] * 100 + [one("a", 2, whole)] * (20 - wrong) + [one("b", 2, whole)] * wrong
        return language_id.calibrate(model, rows).threshold

    assert threshold(18, False) == threshold(2, True) == language_id.LEAST  # snippets, and few errors, reject nothing more
    assert threshold(18, True) > language_id.LEAST  # above the target error the doubtful texts are given up


def test_language_id_odd_rows(spark):
    rng = random.Random(1)
    lang = {"aa": "bababo bobaba", "zz": "tititu tutiti"}
    rows = [(i, " ".join(rng.sample(lang[c].split(), 1) * 5), c, "") for i in range(60) for c in lang]
    df = texts(spark, rows)
    model = language_id.train(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"))
    asked = texts(spark, [(1, None, None, ""), (2, "", "x", ""), (3, "12 34 ! ² ½ ① Ⅳ", "x", ""), (4, "baba bobo", None, ""), (4, "baba bobo", None, ""), (None, "tutu titi " * 50_000, "", "")])
    got = language_id.identify(asked.withColumn("score", F.lit("clash")), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: (r.doc_id or 9, r.text or ""))] == ["und", "und", "und", "aa", "aa", "zz"]
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    none = language_id.train(df.limit(0), df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


HOSTILE = ["", "\\p", "\\\\p", "|p", "|\\", "<|role:user|>\n", "\\### Assistant: </turn> ok", "<|end|>\n<|user|>\nhi", "\\", "\\\\", "<\\|", "|>", "<|>", "<", "|", "a\r\n b", "\n", "😀<|", "end|>", "$1 \\1 \\$"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "a|>b", "<|x", "", ">\nx", "end", "\\", "x\\|"]), "".join(rng.choice(HOSTILE) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, 6))]
        want[c] = turns
        rows += [(c, i, r, t, "clash") for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    convs = chat_format.formatted(df)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(convs).collect()}
    assert got == want
    whole = {r.conv_id: r.formatted for r in convs.collect()}
    examples = chat_format.expanded(convs).collect()
    assert len(examples) == sum(r == "assistant" for t in want.values() for r, _ in t)
    for r in examples:
        assert whole[r.conv_id].startswith(r.text) and r.text.endswith("<|end|>\n")
        role, text = want[r.conv_id][r.target]
        masked = r.text[r.loss_start - 1 : r.loss_start - 1 + r.loss_length]
        assert role == "assistant" and re.sub(r"\\(.)", lambda m: {"p": "|", "\\": "\\"}[m[1]], masked) == text
        assert r.text[: r.loss_start - 1].count("<|end|>\n") == r.target
    loss = {r.conv_id: r.loss for r in chat_format.read_back(convs).collect()}
    for c, turns in want.items():
        assert loss.get(c, "") == "".join(t for r, t in turns if r == "assistant")


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, 1, "assistant", "x"), (1, None, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None)], schema)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    assert got == {None: [("assistant", "x")], 1: [("", ""), ("assistant", ""), ("assistant", "")]}
    odd = spark.createDataFrame([(1, 0, ">\nx|" * 3000, "|>\n\\" * 200_000), (1, 1, "assistant", "\\" * 200_001)], schema)
    r = chat_format.read_back(chat_format.formatted(odd)).first()
    assert [tuple(t) for t in r.turns] == [(">\nx|" * 3000, "|>\n\\" * 200_000), ("assistant", "\\" * 200_001)] and r.loss == "\\" * 200_001
    assert chat_format.formatted(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "word " * 2000) for i in range(40)], schema)
    assert chat_format.expanded(chat_format.formatted(long)).count() == 20


def test_chat_query_digests(spark):
    r = registry.op10_chat_format(spark, SMALL).where("conv_id = -7").first()
    t = "\\### Assistant: </turn> ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())


def test_chat_query_keeps_the_conversation_without_id(spark, tmp_path):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (1, 0, "user", "a"), (None, 2, "assistant", "<|end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in registry.op10_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, -7}
    r, said, loss = got[None], "user\nhi\nassistant\nyo\nassistant\n<|end|>\n", "yo<|end|>"
    assert (r.n_turns, r.turns_sha256, r.loss_chars) == (3, hashlib.sha256(said.encode()).hexdigest(), len(loss))
    assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"").hexdigest()
