"""Quality rules, phrases and importance resampling against plain versions, on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance, phrases, quality_rules, words

from .test_operators import CLASHES, WORDS, awkward_texts


def texts():
    rng = random.Random(11)
    vocabulary = WORDS[:9]
    prose = [". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(3, 14))) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    return awkward_texts() + [(100 + k, t) for k, t in enumerate(prose)] + [(300, "tab\there,two\rthree. four;four four\n\nfour five! a a a a a a a a a a a a a a a"), (301, "É É É é É, É É É É É É É É É É"), (302, "# $ % & | < > *\n#\n#\n \n\nx"), (303, "a\x00b \x1f c\x7f \xa0d")]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, (None, "en", "de")[k % 3]) for k, (i, t) in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for c in (*CLASHES, "phrase", "mark", "f", "k", "ws", "bs", "closed", "place", "trusted_id", "gain"):
        df = df.selectExpr("*", f"'extra' as `{c}`")
    return df.cache()


# ---- quality rules


def form(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + o for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for o in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]+", low)


def mixed(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def hashed(token):
    raw, s = token.encode(), 0
    for b in reversed(raw):
        s = (s * words._BASE + b + 1) % (1 << 64)
    return mixed((s + len(raw)) % (1 << 64))


def buckets(text):
    hs = [hashed(t) for t in tokens(text)]
    step = int(words._STEP)
    pairs = [mixed((((2 * step + a) * step) + b) % (1 << 64)) for a, b in zip(hs, hs[1:], strict=False)]
    return [h >> 48 for h in hs + pairs]


def test_quality_rules_as_by_hand(spark, rows, docs):
    trusted = {1, 7, 9, 100, 105, 120, 999}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(1, 0), (2, 0), (None, 1), (7, 1)], "doc_id int, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    raw, good = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(buckets(t))
        good.update(buckets(t) if i in trusted else [])
    share = sum(good.values()) / sum(raw.values())
    gain = {b: math.floor(1_000_000 * math.log((good[b] + 16) / (share * s + 16))) for b, s in raw.items()}
    want = []
    for i, t, _ in rows:
        bs = buckets(t)
        *counts, failed = form(t)
        total = sum(gain[b] for b in bs)
        want.append((i, *counts, failed, not failed and total >= -120_000 * len(bs), len(bs), total))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_features", "gain"]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got) == sorted(map(str, want))


def test_quality_without_trusted_rows_leaves_the_base_rules(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, none)
    assert got.where("kept = base_failed or gain <> 0").count() == 0 and got.where("kept").count() > 0
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0


def test_junk_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choices(WORDS, k=80))
    junk = lambda: " | ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=80))
    made = [(k, clean() if k % 5 else junk()) for k in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 400, 2)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(kept[k] == (k % 5 > 0) for k in range(400))


def test_long_texts_in_quality_rules_agree_with_short_ones():
    """A text of several slices, its form and buckets as in plain Python."""
    rng = random.Random(8)
    text = " ".join(rng.choices(WORDS, k=420_000))
    (part,) = words.slices(pa.array([text + "\n"]))
    assert len(part.data) > 2 * words.SLICE_BYTES
    assert [int(c[0]) for c in quality_rules._form(part)] == list(form(text)[:5])
    one, two, bounds = quality_rules.feature_buckets(part)
    assert len(one) == bounds[1] == 420_000 and one[:50].tolist() == buckets(" ".join(text.split()[:50]))[:50] and (two >= 0).all()


# ---- phrases


def counted(rows):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def mined(rows, least, inside, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            score, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in f.items() if len(q) == 3 and len(p) == 2 and c >= least and p in (q[:2], q[1:])]
            if not any(100 * c >= inside * a for c in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


@pytest.mark.parametrize(("least", "inside", "top", "dense", "shard"), [(10, 50, 2000, 32, 4 << 20), (2, 90, 7, 4, 300), (1, 50, 40, 1, 2000), (3, 50, 2000, 10**9, 1)])
def test_phrases_as_by_hand(docs, rows, monkeypatch, least, inside, top, dense, shard):
    """Shards of many sizes; all words with packed bits, none, and some."""
    monkeypatch.setattr(phrases, "DENSE", dense)
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    shards = list(phrases.shards(iter([pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": ["a b c a b. a b c\n", "a b\n"]})])))
    assert len(shards) == (2 if shard < 17 else 1)
    got = phrases.mine_phrases(docs, least, inside, top).collect()
    assert sorted(tuple(r) for r in got) == sorted(mined(rows, least, inside, top))


@pytest.mark.parametrize("dense", [1, 4, 10**9])
def test_a_shard_counts_with_bits_and_with_lists(monkeypatch, dense):
    monkeypatch.setattr(phrases, "DENSE", dense)
    rng = random.Random(dense)
    text = "".join(rng.choice(["a ", "b ", "c ", "a ", "d ", ". ", "eé "]) for _ in range(3000)) + "\n"
    (_, shard), = phrases.shards(iter([pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text]})]))
    assert len(shard.dense) == {1: 0, 4: 1, 10**9: 5}[dense]  # no word, the most frequent one, all
    found = Counter()
    for ws, counts in shard.phrases(None, lambda a, b: np.ones(len(a), bool), 3):
        for p, c in zip(shard.text(ws).to_pylist(), counts.tolist(), strict=True):
            assert p not in found
            found[p] = c
    want = counted([(0, text, "x")])["x"]
    assert found == Counter({" ".join(p): c for p, c in want.items() if len(p) > 1})


def test_no_phrases_without_words(docs, spark):
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([(None, None), ("", "en"), (" ,. ", "en")], "text string, lang string")).count() == 0


# ---- importance


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (40, 3), (100, 0)])
def test_importance_as_by_hand(spark, docs, rows, percent, least):
    items = ["alpha beta gamma delta", None, "Straße école 12", "omega psi chi phi " * 9]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = importance.importance_ranks(docs, target, percent=percent, min_words=least).collect()
    assert len(got) == len(rows)
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x, _ in rows for f in features(x)[1]), Counter(bucket(f) for x in items for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    want = []
    for i, text, _ in rows:
        ws, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert sorted(str((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in got) == sorted(map(str, want))
    drawn = percent * sum(w[1] >= least for w in want) // 100
    order = sorted((w for w in want if w[1] >= least), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    placed = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in placed] == list(range(1, drawn + 1)) and [(r["doc_id"], r["score"]) for r in placed] == [(w[0], w[4]) for w in order[:drawn]]
    ranks = importance.importance_ranks(docs, target, percent=percent, min_words=least)
    kept = importance.resampled(docs, ranks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in placed}


def test_importance_of_empty_tables(docs):
    none = docs.limit(0)
    assert importance.importance_ranks(none, docs).count() == 0
    got = importance.importance_ranks(docs, none)
    assert got.count() == docs.count() and got.where("n_words >= 20 and weight = 0").count() == 0


def test_scoring_neither_explodes_nor_shuffles(docs):
    """What is scored is a projection over the scan: one literal array, no exchange, no generator."""
    gain = F.split(F.lit(",".join(["1"] * 10_000)), ",").cast("array<bigint>")
    placed = docs.select(importance.words_of(F.col("text")).alias("ws")).select(importance.buckets_of("ws").alias("bs"))
    plan = placed.select(F.aggregate("bs", F.lit(0).cast("long"), lambda x, b: x + F.element_at(gain, b + 1)).alias("weight"))._jdf.queryExecution().optimizedPlan().toString()
    assert "generate" not in plan.lower().split("inmemoryrelation")[0] and "split(1,1" not in plan


# ---- language ID


def plain_table(rows):
    """Slots of byte trigrams in a loop over words, counted by language."""
    out = {}
    for text, lang in rows:
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()):
            run = b" " + word + b" "
            for end in range(1, len(run)):
                two = run[end - 2] if end >= 2 else 0x20
                one, byte = run[end - 1], run[end]
                slot = ((((two if one != 0x20 else 0x20) << 16) | (one << 8) | byte) * 2654435761 % (1 << 32)) >> 16
                out.setdefault(lang, Counter())[slot] += 1
    return out


def plain_mixture(word):
    """Shares of a text's languages by loops: the full mixture's leading ones, all set sizes, penalised."""
    n, langs = len(word), len(word[0])
    word = [[max(x, 1e-30) for x in row] for row in word]

    def expect(share, steps):
        for _ in range(steps):
            total = [0.0] * langs
            for row in word:
                whole = sum(a * b for a, b in zip(row, share, strict=True))
                for k in range(langs):
                    total[k] += row[k] * share[k] / whole
            share = [t / n for t in total]
        return share, sum(math.log(sum(a * b for a, b in zip(row, share, strict=True))) for row in word)

    share, _ = expect([1 / langs] * langs, 12)
    order = sorted(range(langs), key=lambda k: -share[k])
    best = ([float(k == order[0]) for k in range(langs)], sum(math.log(row[order[0]]) for row in word))
    for size in range(2, langs + 1):
        within = [max(share[k], 1e-6) if k in order[:size] else 0.0 for k in range(langs)]
        fit, value = expect([x / sum(within) for x in within], 6)
        worth = value - 3.0 * (size - 1) * math.log(n + 1)
        if worth > best[1]:
            best = (fit, worth)
    return best[0]


def test_languages_as_by_plain_loops(spark):
    from gridloom.llm.language_id import fit_languages, identify_languages, likelihoods

    rng = random.Random(5)
    words_of = {"aa": WORDS[:8], "bb": ["über", "straße", "nicht", "und", "der", "mit"], "cc": ["école", "très", "avec", "une", "dans", "les"]}
    prose = lambda lang, n: " ".join(rng.choices(words_of[lang], k=n))
    shown = [(prose(lang, 40), lang) for lang in words_of for _ in range(5)]
    langs, table = fit_languages(spark.createDataFrame([*shown, (None, "aa"), ("word", None)], "text string, lang string"))
    counts = plain_table(shown)
    assert langs == sorted(words_of)
    for k, lang in enumerate(langs):
        total = sum(counts[lang].values()) + 0.5 * 65536
        want = np.log((np.array([counts[lang][s] for s in range(65536)]) + 0.5) / total)
        assert np.allclose(table[:, k], want, atol=1e-5)
    texts = [prose("aa", 30), prose("aa", 60) + " " + prose("bb", 40), prose("cc", 25) + " " + prose("bb", 25) + " " + prose("aa", 30), "über", "", None, "12 34", prose("cc", 50)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), langs, table).collect()}
    for i, text in enumerate(texts):
        found = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode())
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, [])
            continue
        logs = []
        for w in found:
            one = plain_table([(w.decode(), "x")])["x"]
            logs.append([sum(n * float(table[s, k]) for s, n in one.items()) for k in range(3)])
        share = plain_mixture([[math.exp(x - max(row)) for x in row] for row in logs])
        assert got[i]["lang_pred"] == langs[max(range(3), key=lambda k: share[k])] and abs(got[i]["score"] - max(share)) < 1e-3
        assert got[i]["languages"] == [langs[k] for k in sorted(range(3), key=lambda k: -share[k]) if share[k] > 0]
    slots, first = np.array([1, 2, 3, 4, 5, 6]), np.array([0, 2, 3])
    import gridloom.llm.language_id as module

    whole = likelihoods(table, slots, first)
    module.WORDS_AT_ONCE, before = 1, module.WORDS_AT_ONCE
    try:
        assert (likelihoods(table, slots, first) == whole).all()
    finally:
        module.WORDS_AT_ONCE = before


def test_labels_that_disagree_have_a_defined_class(spark):
    from gridloom.llm.toxicity import fit_toxicity

    table = spark.range(400).selectExpr("id doc_id", "if(id % 2 = 1, 'foul', 'fair') text", "cast(id % 2 as int) toxic")
    doubled = table.unionByName(table.selectExpr("doc_id", "text", "0 as toxic").where("doc_id = 1"))
    again = table.where("doc_id <> 1").unionByName(spark.createDataFrame([(1, "foul", 0)], "doc_id long, text string, toxic int"))
    one, two = fit_toxicity(table, doubled), fit_toxicity(table, again)
    assert np.allclose(one.curve, two.curve) and (one.model.grams.values == two.model.grams.values).all()
    many = table.unionByName(spark.range(3000).selectExpr("1 as doc_id", "concat('other text ', id) text", "1 as toxic"))
    assert fit_toxicity(many, table).model.grams.values.sum() <= one.model.grams.values.sum() + 100
